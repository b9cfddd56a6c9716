"""Corpus encoding with a public byte-level BPE tokenizer (problem 7).

The frequent words of the whole corpus are compiled into a minimal acyclic
transducer: states with equal right languages are shared, each arc carries the
number of words that sort before it, and the sum along a path is the word's
number, under which its ids are kept. The compiled arrays are one file in the
shared folder, handed to every executor and memory-mapped there. Words outside
the lexicon are pre-tokenised and merged by rank, so the result never depends
on which words are frequent.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake import runtime

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEXICON_WORDS = 32768
MEMO_WORDS = 100_000
ROWS_AT_ONCE = 128

# Fixed: the published pre-tokenisation pattern of this vocabulary.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space of the published pattern leaves out U+001C to U+001F, which Python's own classes hold.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_OTHER_SPACE = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n") + "]")


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Byte sequences and their ids, in merge order."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank is joined until none is known."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 200:
        return _merge_long(parts, ranks)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """merge() for very long pre-tokens: a heap of pairs over a linked list, n log n."""
    import heapq

    n = len(parts)
    text: list[bytes | None] = list(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, text[i], text[i + 1]) for i in range(n - 1) if (r := ranks.get(text[i] + text[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if text[i] != a or j >= n or text[j] != b:
            continue
        text[i], text[j] = a + b, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(text[i] + text[after[i]])) is not None:
                heapq.heappush(heap, (r, i, text[i], text[after[i]]))
        if before[i] >= 0 and (r := ranks.get(text[before[i]] + text[i])) is not None:
            heapq.heappush(heap, (r, before[i], text[before[i]], text[i]))
    return [ranks[t] for t in text if t is not None]


def pieces(text: str) -> list[str]:
    """Pre-tokens of a text under the published pattern."""
    if _SEPARATORS.search(text):
        return _STRICT.findall(text)
    return PIECES.findall(text)


_WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F)
_STRICT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")


def encode(text: str, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a text without any lexicon."""
    return [i for p in pieces(text) for i in merge(p.encode("utf-8", "replace"), ranks)]


def words(text: str) -> list[str] | None:
    """The text cut before every space that stands between two visible characters; None where a space touches other white space."""
    if "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or _OTHER_SPACE.search(text):
        return None
    head, *rest = text.split(" ")
    return [head, *(" " + w for w in rest)]


class Transducer:
    """A minimal acyclic transducer from words to id sequences, held in one flat array."""

    def __init__(self, flat: np.ndarray):
        arcs, states, count, ids = (int(x) for x in flat[:4])
        at = 4
        cuts = []
        for size in (arcs, arcs, arcs, states, count + 1, ids):
            cuts.append(flat[at : at + size])
            at += size
        self.keys, self.next, self.skip, self.final, self.offsets, self.ids = cuts
        self.states, self.count = states, count

    @classmethod
    def build(cls, entries: dict[bytes, list[int]]) -> "Transducer":
        """Words in byte order are added one by one; a finished suffix is replaced by its registered equal."""
        ordered = sorted(w for w in entries if w)
        register: dict[tuple, int] = {}
        finals: list[bool] = []
        arcs: list[dict[int, int]] = []

        def state() -> int:
            finals.append(False)
            arcs.append({})
            return len(finals) - 1

        root, path, last = state(), [], b""
        dropped: list[int] = []

        def settle(depth: int) -> None:
            while len(path) > depth:
                parent, label, child = path.pop()
                shape = (finals[child], tuple(arcs[child].items()))
                known = register.setdefault(shape, child)
                if known != child:
                    arcs[parent][label] = known
                    dropped.append(child)

        for word in ordered:
            shared = 0
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
            settle(shared)
            at = path[-1][2] if path else root
            for label in word[shared:]:
                if dropped:
                    child = dropped.pop()
                    finals[child], arcs[child] = False, {}
                else:
                    child = state()
                arcs[at][label] = child
                path.append((at, label, child))
                at = child
            finals[at] = True
            last = word
        settle(0)
        # States in post-order; the words reachable from each give the numbers on the arcs.
        number, reach, order, stack = {}, {}, [], [(root, iter(arcs[root].values()))]
        seen = {root}
        while stack:
            at, rest = stack[-1]
            child = next((c for c in rest if c not in seen), None)
            if child is None:
                stack.pop()
                reach[at] = finals[at] + sum(reach[c] for c in arcs[at].values())
                order.append(at)
            else:
                seen.add(child)
                stack.append((child, iter(arcs[child].values())))
        for i, at in enumerate(reversed(order)):
            number[at] = i
        keys, nexts, skips = [], [], []
        final = [0] * len(order)
        for at in reversed(order):
            final[number[at]] = int(finals[at])
            before = int(finals[at])
            for label, child in sorted(arcs[at].items()):
                keys.append(number[at] << 8 | label)
                nexts.append(number[child])
                skips.append(before)
                before += reach[child]
        offsets, ids = [0], []
        for word in ordered:
            ids.extend(entries[word])
            offsets.append(len(ids))
        parts = [[len(keys), len(final), len(ordered), len(ids)], keys, nexts, skips, final, offsets, ids]
        return cls(np.concatenate([np.asarray(p, dtype=np.int64) for p in parts]))

    def payload(self) -> bytes:
        head = np.array([len(self.keys), self.states, self.count, len(self.ids)], dtype=np.int64)
        return np.concatenate([head, self.keys, self.next, self.skip, self.final, self.offsets, self.ids]).tobytes()

    @classmethod
    def open(cls, path: str) -> "Transducer":
        return cls(np.memmap(path, dtype=np.int64, mode="r"))

    def find(self, asked: list[bytes]) -> np.ndarray:
        """The number of each word, or -1; all words walk the automaton together."""
        sizes = np.array([len(w) for w in asked], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(asked) else sizes
        letters = np.frombuffer(b"".join(asked), dtype=np.uint8).astype(np.int64)
        at, number = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        alive = np.flatnonzero(sizes > 0) if len(self.keys) else np.array([], np.int64)
        found = np.full(len(asked), -1, np.int64)
        depth = 0
        while len(alive):
            key = at[alive] << 8 | letters[starts[alive] + depth]
            spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[spot] == key
            alive, spot = alive[hit], spot[hit]
            number[alive] += self.skip[spot]
            at[alive] = self.next[spot]
            depth += 1
            done = sizes[alive] == depth
            ends = alive[done]
            ends = ends[self.final[at[ends]] == 1]
            found[ends] = number[ends]
            alive = alive[~done]
        return found

    def output(self, number: int) -> list[int]:
        return self.ids[self.offsets[number] : self.offsets[number + 1]].tolist()


@lru_cache(maxsize=2)
def _opened(name: str) -> Transducer:
    return Transducer.open(SparkFiles.get(name))


def frequent_words(documents: DataFrame, text: str, most: int) -> DataFrame:
    """The words of the whole corpus by falling frequency, counted in each task before the shuffle."""

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for value in batch[text]:
                if value:
                    seen.update(words(value) or PIECES.findall(value))
            if len(seen) > 400_000:
                yield pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})
                seen = Counter()
        if seen:
            yield pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})

    return (
        documents.select(text).mapInPandas(count, "word string, n long").where("word <> ''")
        .groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
        .orderBy(F.desc("n"), "word").limit(most)
    )


def compile_lexicon(spark: SparkSession, documents: DataFrame, text: str, ranks, most: int = LEXICON_WORDS) -> str:
    """Name of the published file. At most `most` words come to the driver."""

    def ids(batches):
        for batch in batches:
            yield pd.DataFrame({"word": batch["word"], "ids": [encode(w, ranks.value) for w in batch["word"]]})

    chosen = frequent_words(documents, text, most).select("word").mapInPandas(ids, "word string, ids array<int>")
    entries = {r["word"].encode("utf-8", "replace"): r["ids"] for r in chosen.collect()}
    return runtime.publish(spark, Transducer.build(entries).payload(), "lexicon")


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """(key, ids) of every row, no special tokens; text that spells a special token is ordinary text.

    Null and empty texts give the empty list; a null key is kept. Repeated rows
    give repeated results. Other columns are ignored, an empty table gives an
    empty result, and texts of any length are encoded whole.
    """
    spark = documents.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(vocabulary))
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    name = compile_lexicon(spark, rows, "text", ranks, lexicon_words)

    def run(batches):
        memo: dict[str, list[int]] = {}
        parts: dict[str, list[int]] = {}
        lexicon, table = _opened(name), ranks.value

        def unseen(word: str) -> list[int]:
            found: list[int] = []
            for piece in pieces(word):
                ids = parts.get(piece)
                if ids is None:
                    ids = parts[piece] = merge(piece.encode("utf-8", "replace"), table)
                found += ids
            return found

        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                cut = [(words(t) or pieces(t)) if t else [] for t in part.column(1).to_pylist()]
                for known in (memo, parts):
                    if len(known) > MEMO_WORDS:
                        known.clear()
                missing = [w for w in set().union(*cut) if w not in memo]
                for word, number in zip(missing, lexicon.find([w.encode("utf-8", "replace") for w in missing]).tolist()):
                    memo[word] = lexicon.output(number) if number >= 0 else unseen(word)
                get = memo.__getitem__
                ids = [list(chain.from_iterable(map(get, doc))) for doc in cut]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(ends[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["key", "ids"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
