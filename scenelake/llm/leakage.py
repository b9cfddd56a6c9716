"""Held-out passages inside training texts (problem 8).

The passages are the indexed side: a BM25 inverted index whose terms are runs of
five words, its postings in blocks with the largest contribution of each. Every
stretch of every training text is a query, answered by block-max WAND: a cursor
for each term of the stretch; the pivot is the first item at which the largest
contributions of the cursors up to it reach the threshold; where the maxima of
the blocks it lies in do not, the cursors leap behind the nearest block's end;
only what is left is scored. Stretches whose terms together cannot reach the
threshold are first put aside in arrays, many texts at a time. The threshold is
the least score that a passage's own 25 words keep after the allowed alterations,
so pruning loses nothing. What is retrieved is aligned word by word with the
passage, and the words of the item's question and answers are looked up in the text.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 5
LEAST_WORDS = 25
ALTERED = 0.1
BUCKET = 10
REACH = 4  # buckets in a query stretch: any LEAST_WORDS + BUCKET words lie within one
BLOCK = 8  # postings in a block
GAP = 12  # words between two runs of one quote
SHARD_CHARS = 8_000_000
ROWS_AT_ONCE = 256
_WORDS = re.compile(r"[^\W_]+")
_FACTORS = np.random.default_rng(20).integers(1, 2**63, GRAM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def tokens(text: str | None) -> list[str]:
    """Words without case, punctuation, spacing and soft hyphens."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.replace("\xad", "")).casefold()
    return _WORDS.findall(text.lower())


def _grams(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the runs of known words, and where each begins."""
    if len(ids) < GRAM:
        return np.array([], np.uint64), np.array([], np.int64)
    wide = ids.astype(np.uint64)
    n = len(ids) - GRAM + 1
    known = np.ones(n, bool)
    for i in range(GRAM):
        known &= ids[i : i + n] > 0
    at = np.flatnonzero(known)
    keys = np.zeros(len(at), np.uint64)
    for i in range(GRAM):
        keys += wide[at + i] * _FACTORS[i]
    return keys, at


class Index:
    """Block-max index of one shard of items: (item, passage) each, perhaps with question and answers."""

    def __init__(self, items: list[tuple], least: int = LEAST_WORDS, altered: float = ALTERED):
        self.least = least
        self.words: dict[str, int] = {}
        self.items, self.passages, self.questions, self.answers = [], [], [], []
        number = lambda text: [self.words.setdefault(w, len(self.words) + 1) for w in tokens(text)]
        for key, passage, *told in items:
            question, answers = (*told, None, None)[:2]
            ids = number(passage)
            if len(ids) >= least:
                self.items.append(key)
                self.passages.append(np.array(ids, np.int64))
                self.questions.append(number(question))
                self.answers.append([number(a) for a in answers or []])
        grams = [_grams(p)[0] for p in self.passages]
        owner = np.concatenate([np.full(len(g), i) for i, g in enumerate(grams)]) if grams else np.array([], int)
        every = np.concatenate(grams) if grams else np.array([], np.uint64)
        self.keys, term = np.unique(every, return_inverse=True)
        pairs, tf = np.unique(term.astype(np.int64) * (len(self.items) + 1) + owner, return_counts=True)
        terms, post_item = pairs // (len(self.items) + 1), pairs % (len(self.items) + 1)
        df = np.bincount(terms, minlength=len(self.keys))
        idf = np.log1p((len(self.items) - df + 0.5) / (df + 0.5))
        k1 = 1.5  # b = 0: a quote is short whatever the passage's length
        post_score = idf[terms] * tf * (k1 + 1) / (tf + k1)
        self.top = np.zeros(len(self.keys))
        np.maximum.at(self.top, terms, post_score)
        first = np.searchsorted(terms, np.arange(len(self.keys) + 1))
        # Blocks of BLOCK postings of one term, each with its largest contribution.
        block = (np.arange(len(terms)) - first[terms]) // BLOCK if len(terms) else np.array([], int)
        blocks_of = -(-df // BLOCK)
        self.block_at = np.concatenate([[0], np.cumsum(blocks_of)]).astype(int).tolist()
        block_max = np.zeros(self.block_at[-1])
        np.maximum.at(block_max, np.array(self.block_at)[terms] + block, post_score)
        self.block_max = block_max.tolist()
        self.post_at, self.post_item, self.post_score = first.tolist(), post_item.tolist(), post_score.tolist()
        # Least score of any qualifying quote: of each window, the smallest contributions that the alterations must leave.
        self.threshold = np.inf
        self.lost = lost = int(least * altered)
        self.stay = stay = max(1, least - GRAM + 1 - GRAM * lost)
        self.places: dict[int, dict[tuple[int, ...], list[int]]] = {}
        for passage in self.passages:
            keys, _ = _grams(passage)
            own = idf[np.searchsorted(self.keys, keys)]
            if len(own) >= least - GRAM + 1:
                windows = np.sort(np.lib.stride_tricks.sliding_window_view(own, least - GRAM + 1), axis=1)
                self.threshold = min(self.threshold, windows[:, :stay].sum(axis=1).min())
        self.threshold -= 1e-9

    def ids(self, text: str | None) -> list[int]:
        return [self.words.get(w, 0) for w in tokens(text)]

    def wand(self, terms: dict[int, int]) -> list[int]:
        """Items whose score for the terms, each with how often the stretch has it, reaches the threshold."""
        # A cursor: where it stands, the end and begin of its postings, its first block, its weight and its largest contribution.
        cursors = [[self.post_at[t], self.post_at[t + 1], self.post_at[t], self.block_at[t], n, n * float(self.top[t])] for t, n in terms.items()]
        item, score, found = self.post_item, self.post_score, []
        while cursors:
            cursors.sort(key=lambda c: item[c[0]])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[5]
                if bound >= self.threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            at = item[cursors[pivot][0]]
            while pivot + 1 < len(cursors) and item[cursors[pivot + 1][0]] == at:
                pivot += 1
            # The blocks in which the pivot lies: their maxima may not reach the threshold though the terms' do.
            inner, behind = 0.0, item[cursors[pivot + 1][0]] if pivot + 1 < len(cursors) else len(self.items)
            for c in cursors[: pivot + 1]:
                spot = bisect_left(item, at, c[0], c[1])
                if spot == c[1]:
                    continue
                block = (spot - c[2]) // BLOCK
                inner += c[4] * self.block_max[c[3] + block]
                behind = min(behind, item[min(c[1], c[2] + (block + 1) * BLOCK) - 1] + 1)
            if inner < self.threshold:
                to = max(at + 1, behind)
                for c in cursors[: pivot + 1]:
                    c[0] = bisect_left(item, to, c[0], c[1])
            elif item[cursors[0][0]] == at:
                total = 0.0
                for c in cursors[: pivot + 1]:
                    total += c[4] * score[c[0]]
                    c[0] += 1
                if total >= self.threshold:
                    found.append(at)
            else:
                for c in cursors[:pivot]:
                    c[0] = bisect_left(item, at, c[0], c[1])
            cursors = [c for c in cursors if c[0] < c[1]]
        return found

    def candidates(self, docs: list[list[int]]) -> dict[tuple[int, int], list[int]]:
        """(position in docs, item number) of every pair that reaches the threshold, with the first words of the stretches that do."""
        found: dict[tuple[int, int], list[int]] = defaultdict(list)
        if not len(self.keys):
            return found
        pad = BUCKET * REACH
        sizes = [-(-len(d) // BUCKET) * BUCKET + pad for d in docs]
        flat = np.zeros(sum(sizes), np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        for d, s in zip(docs, starts):
            flat[s : s + len(d)] = d
        keys, at = _grams(flat)
        spot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[spot] == keys
        term, bucket = spot[hit], at[hit] // BUCKET
        if not len(term):
            return found
        n_buckets = len(flat) // BUCKET
        sums = np.bincount(bucket, self.top[term], n_buckets)
        bound = sums.copy()
        for i in range(1, REACH):
            bound[:-i] += sums[i:]
        # One search takes in all stretches that begin in REACH buckets running: whatever one of them retrieves, it retrieves.
        order = np.searchsorted(bucket, np.arange(n_buckets + 1))
        live = np.flatnonzero((bound >= self.threshold) & (np.diff(order) > 0)).tolist()
        of = (np.searchsorted(starts, np.array(live, np.int64) * BUCKET, side="right") - 1).tolist()
        past = -1
        for first, doc in zip(live, of):
            if first < past:
                continue
            past = first + REACH
            terms = Counter(term[order[first] : order[min(n_buckets, past + REACH - 1)]].tolist())
            for item in self.wand(terms):
                found[doc, item].append(int(first * BUCKET - starts[doc]))
        return found

    def overlap(self, doc: list[int], item: int) -> tuple[float, float]:
        """Share of the question's words, and the greatest share of an answer's words, that the text holds; 0 where there are none."""
        held = set(doc)
        share = lambda words: sum(w in held for w in words) / len(words) if words else 0.0
        return share(self.questions[item]), max(map(share, self.answers[item]), default=0.0)

    def quoted(self, doc: list[int], item: int, stretches: list[int]) -> int:
        """Words of the passage that the text holds in order with few alterations, 0 under the minimum; only around the stretches is looked."""
        passage, width = self.passages[item].tolist(), 0
        margin, end = self.least, -1
        for first in sorted(stretches):
            if first + BUCKET * REACH > end:
                begin, end = max(0, first - margin), first + 2 * BUCKET * REACH + margin
                if self.aligned(doc[begin:end], item, passage):
                    width = max(width, longest_quote(doc[begin:end], passage, self.least))
        return width

    def aligned(self, doc: list[int], item: int, passage: list[int]) -> bool:
        """Whether so many terms stand in the same order, up to the shift of the allowed alterations, as any quote keeps."""
        places = self.places.get(item)
        if places is None:
            places = self.places[item] = defaultdict(list)
            for j in range(len(passage) - GRAM + 1):
                places[tuple(passage[j : j + GRAM])].append(j)
        shifts = Counter(j - i for i in range(len(doc) - GRAM + 1) for j in places.get(tuple(doc[i : i + GRAM]), ()))
        return any(sum(shifts.get(s + k, 0) for k in range(self.lost + 1)) >= self.stay for s in shifts)


def longest_quote(doc: list[int], passage: list[int], least: int = LEAST_WORDS, altered: float = ALTERED) -> int:
    """Widest stretch of the passage that a chain of equal runs covers with few enough altered words; 0 under `least`."""
    places = defaultdict(list)
    for j in range(len(passage) - 1):
        places[passage[j], passage[j + 1]].append(j)
    runs, open_runs = [], {}
    for i in range(len(doc) - 1):
        here = {}
        if doc[i] and (found := places.get((doc[i], doc[i + 1]))):
            for j in found:
                run = open_runs.get(j - 1)
                if run is None:
                    run = [i, j, 2]
                    runs.append(run)
                else:
                    run[2] += 1
                here[j] = run
        open_runs = here
    # A quote of that width has so many words in runs of two and more, whatever stands between them.
    if sum(n for _, _, n in runs) < least - 4 * int(least * altered) - 1:
        return 0
    runs.sort()
    most, longest = altered * len(passage), max((n for _, _, n in runs), default=0)
    chains: list[dict[int, int]] = []  # of each last run: where the chain begins in the passage, and the fewest altered words
    lean = [j - i for i, j, _ in runs]
    width = 0
    for b, (i, j, n) in enumerate(runs):
        mine = {j: 0}
        for a in range(b - 1, -1, -1):
            pi = runs[a][0]
            if i - pi - longest > GAP:
                break
            if not -GAP <= lean[b] - lean[a] <= GAP or i <= pi:
                continue
            _, pj, pn = runs[a]
            di, dj = i - pi - pn, j - pj - pn
            over = max(0, -di, -dj)
            if over >= n or max(di, dj) > GAP or j <= pj:
                continue
            if over:
                cost = max(di + over, dj + over) or 1
            else:
                cost = max(di, dj)
                if cost > 1 and di and dj:
                    cost -= _equal(doc[i - di : i], passage[j - dj : j])
            for begin, lost in chains[a].items():
                if lost + cost <= most and lost + cost < mine.get(begin, len(passage)):
                    mine[begin] = lost + cost
        chains.append(mine)
        for begin, lost in mine.items():
            span = j + n - begin
            if span >= least and lost <= altered * span:
                width = max(width, span)
    return width


def _equal(a: list[int], b: list[int]) -> int:
    """Most words that two short stretches have in common in order."""
    best = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b, 1):
            before, best[k] = best[k], before + 1 if x == y and x else max(best[k], best[k - 1])
    return best[-1]


def leaks(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", text: str = "text", item_key: str = "item_id", passage: str = "passage", question: str = "query_text", answers: str = "ground_truth", least: int = LEAST_WORDS) -> DataFrame:
    """(doc_key, item_key, words, question, answer) of each text that holds at least `least` words of a passage.

    question and answer are the shares of the question's words and of the best
    answer's words that the text holds; 0 where the item has none or the column is missing. Null and empty
    texts or passages, and passages under `least` words, give no row; repeated rows
    count once; a tie between items gives a row for each. Only the named columns are
    read. Items travel to the executors in shards of at most SHARD_CHARS characters;
    one pass over the texts searches all shards, each loaded once a task, so either side may grow.
    """
    spark = documents.sparkSession
    told = lambda c, kind: F.col(c) if c in items.columns else F.lit(None).cast(kind)
    cases = items.select(F.col(item_key).alias("item"), F.col(passage).alias("passage"), told(question, "string").alias("question"), told(answers, "array<string>").alias("answers")).where("item is not null and passage is not null").distinct()
    chars = cases.agg(F.sum(F.length("passage"))).first()[0] or 0
    shards = 1 + chars // SHARD_CHARS
    rows = documents.select(F.col(doc_key).alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    kinds = f"doc {rows.schema['doc'].dataType.simpleString()}, item {cases.schema['item'].dataType.simpleString()}, words int, question double, answer double"
    indices = []
    for shard in range(shards):
        own = cases.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == shard)
        indices.append(spark.sparkContext.broadcast(Index(sorted(((r["item"], r["passage"], r["question"], r["answers"]) for r in own.collect()), key=lambda r: r[:2]), least)))

    def search(batches):
        for batch in batches:
            for start in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.iloc[start : start + ROWS_AT_ONCE]
                keys = part["doc"].tolist()
                for index in indices:
                    seek = index.value
                    docs = [seek.ids(t) for t in part["text"]]
                    out = [(keys[d], seek.items[i], w, *seek.overlap(docs[d], i)) for (d, i), at in seek.candidates(docs).items() if (w := seek.quoted(docs[d], i, at))]
                    if out:
                        yield pd.DataFrame(out, columns=["doc", "item", "words", "question", "answer"])

    found = rows.mapInPandas(search, kinds)
    best = found.groupBy("doc", "item").agg(*(F.max(c).alias(c) for c in ("words", "question", "answer")))
    return best.select(F.col("doc").alias(doc_key), F.col("item").alias(item_key), "words", "question", "answer")
