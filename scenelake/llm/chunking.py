"""Oversized texts and dialogues cut at natural boundaries (problem 5).

All places where a piece may begin or end are numbered over a whole batch of
items. Each is joined to its farthest legal successor (the last place within the
limit, of the best kind there is), and from there to where the next piece begins
once the overlap is taken back. Squaring that successor table again and again,
and adding what each power reaches from the places already reached, gives the
beginnings of all pieces of all items in a logarithmic number of steps.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLOT_LIMIT, PLOT_OVERLAP = 2000, 200
DIALOGUE_LIMIT = 1500
_PARAGRAPH = re.compile(r"\s*\n\s*\n\s*|\s*\n\s*")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”»’')\]]*\s+")
_SPACE = re.compile(r"\s+")


def reached(successor: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """All places that are reached from the starts by following successors; a place that leads to itself ends its chain."""
    marked = np.zeros(len(successor), bool)
    marked[starts] = True
    power = successor.copy()
    while True:
        before = np.flatnonzero(marked)
        marked[power[before]] = True
        squared = power[power]
        if np.array_equal(squared, power):
            return marked
        power = squared


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places where a piece may end, rising, and their kinds: 3 paragraph, 2 sentence, 1 word, 0 within a word."""
    kinds = {0: 3, len(text): 3}
    for kind, pattern in ((1, _SPACE), (2, _SENTENCE), (3, _PARAGRAPH)):
        for m in pattern.finditer(text):
            if kind > kinds.get(m.end(), 0):
                kinds[m.end()] = kind
    at = np.array(sorted(kinds), np.int64)
    return at, np.array([kinds[i] for i in at.tolist()], np.int64)


def text_cuts(texts: list[str], limit: int, overlap: int) -> list[list[tuple[int, int]]]:
    """(begin, end) of the pieces of each text.

    A piece ends at the last paragraph end in the second half of its limit, else
    the last sentence end there, else the last word end there, else at the limit.
    The next begins at the first sentence end, else word end, within the overlap
    before that end.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be under half the limit")
    places, kinds, owner = [], [], []
    base = 0
    spans = []
    for n, text in enumerate(texts):
        at, kind = boundaries(text)
        gaps = np.flatnonzero(np.diff(at) > limit // 4)
        if len(gaps):  # stretches without any boundary get places of kind 0
            extra = np.concatenate([np.arange(at[g] + 1, at[g + 1]) for g in gaps])
            order = np.argsort(np.concatenate([at, extra]), kind="stable")
            at, kind = np.concatenate([at, extra])[order], np.concatenate([kind, np.zeros(len(extra), np.int64)])[order]
        spans.append((base, base + len(at)))
        places.append(at)
        kinds.append(kind)
        owner.append(np.full(len(at), n))
        base += len(at)
    if not base:
        return [[] for _ in texts]
    at, kind, own = np.concatenate(places), np.concatenate(kinds), np.concatenate(owner)
    wide = int(at.max()) + 2 * limit + 2
    line = own * wide + at  # one rising line of places over all texts
    index = np.arange(base)
    last = np.array([spans[n][1] - 1 for n in own])

    def latest(level: int) -> np.ndarray:
        return np.maximum.accumulate(np.where(kind >= level, index, -1))

    def earliest(level: int) -> np.ndarray:
        return np.minimum.accumulate(np.where(kind >= level, index, base)[::-1])[::-1]

    far = np.searchsorted(line, line + limit, side="right") - 1
    end = far.copy()
    done = far == last
    for level in (3, 2, 1):
        spot = latest(level)[far]
        good = ~done & (spot >= 0) & (line[np.maximum(spot, 0)] > line + limit // 2)
        end = np.where(good, spot, end)
        done |= good
    end = np.maximum(end, np.minimum(index + 1, last))
    begin = np.searchsorted(line, line[end] - overlap, side="left")
    start, done = end.copy(), end == last
    for level in (2, 1):
        spot = earliest(level)[np.minimum(begin, base - 1)]
        good = ~done & (spot < end) & (spot > index)
        start = np.where(good, spot, start)
        done |= good
    start = np.where(end == last, last, np.maximum(start, np.minimum(index + 1, last)))
    marked = reached(start, np.array([s for s, _ in spans]))
    out = []
    for s, e in spans:
        begins = [i for i in np.flatnonzero(marked[s:e]) + s if i != e - 1]
        out.append([(int(at[i]), int(at[end[i]])) for i in begins])
    return out


def entry_cuts(sizes: list[list[int]], limit: int) -> list[list[tuple[int, int]]]:
    """(first, last) entries of the pieces of each dialogue, last not included.

    Entries are joined by one space. A piece takes as many entries as fit; the
    next repeats the entry before it if that still leaves room for a new one. An
    entry over the limit stands alone.
    """
    base = [0]
    for s in sizes:
        base.append(base[-1] + len(s) + 1)
    total = np.zeros(base[-1], np.int64)
    for b, s in zip(base, sizes):
        total[b + 1 : b + 1 + len(s)] = np.cumsum(np.array(s, np.int64) + 1)
    own = np.repeat(np.arange(len(sizes)), [len(s) + 1 for s in sizes])
    wide = int(total.max(initial=0)) + limit + 3
    line = own * wide + total
    index, last = np.arange(base[-1]), np.array([base[n + 1] - 1 for n in own], np.int64)
    end = np.minimum(np.maximum(np.searchsorted(line, line + limit + 1, side="right") - 1, index + 1), last)
    back = np.maximum(end - 1, 0)
    after = np.minimum(end + 1, last)
    room = (back > index) & (line[after] - line[back] - 1 <= limit)
    start = np.where(end == last, last, np.where(room, back, end))
    marked = reached(start, np.array(base[:-1], np.int64)) if sizes else np.zeros(0, bool)
    return [[(int(i - b), int(end[i] - b)) for i in np.flatnonzero(marked[b : b + len(s)]) + b] for b, s in zip(base, sizes)]


def visible(column):
    """Whether a string has anything but white space."""
    return F.coalesce(column, F.lit("")).rlike(r"(?U)[^\s​﻿]")


def _numbered(keys: list, pieces: list[list[str]], overlaps: list[list[int]]) -> pd.DataFrame:
    out = [(k, n, p, o) for k, ps, os in zip(keys, pieces, overlaps) for n, (p, o) in enumerate(zip(ps, os))]
    return pd.DataFrame(out, columns=["key", "piece_no", "piece", "repeated"])


def split_texts(items: DataFrame, key: str, text: str, limit: int = PLOT_LIMIT, overlap: int = PLOT_OVERLAP) -> DataFrame:
    """(key, piece_no, piece, repeated) of every text over the limit; `repeated` characters stood in the piece before.

    The pieces without what they repeat, joined, are the text. Null keys and texts
    and texts within the limit give no row; repeated rows count once, and a key
    with several texts has the pieces of each. Only the named columns are read.
    """
    rows = items.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("key").isNotNull() & (F.length("text") > limit)).distinct()
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), 200):
                part = batch.iloc[start : start + 200]
                texts = part["text"].tolist()
                cuts = text_cuts(texts, limit, overlap)
                pieces = [[t[a:b] for a, b in c] for t, c in zip(texts, cuts)]
                repeated = [[max(0, p[1] - a) if p else 0 for p, (a, _) in zip([None, *c], c)] for c in cuts]
                yield _numbered(part["key"].tolist(), pieces, repeated)

    return rows.mapInPandas(run, f"key {kind}, piece_no int, piece string, repeated int").withColumnRenamed("key", key)


def split_dialogues(scenes: DataFrame, key: str = "scene_id", dialogue: str = "dialogue", limit: int = DIALOGUE_LIMIT) -> DataFrame:
    """(key, piece_no, piece, repeated) of every dialogue whose entries "CHARACTER: line" take more than the limit.

    Entries with a blank or null character or line are left out. A piece is cut
    between entries; an entry that is too long alone is cut as split_texts() cuts
    texts, without overlap. `repeated` is the length of the repeated entry.
    """
    spoken = F.filter(F.col(dialogue), lambda d: visible(d["character"]) & visible(d["line"]))
    entries = F.transform(spoken, lambda d: F.concat(d["character"], F.lit(": "), d["line"]))
    rows = scenes.select(F.col(key).alias("key"), entries.alias("entries")).where(F.col("key").isNotNull() & (F.length(F.concat_ws(" ", "entries")) > limit)).distinct()
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), 200):
                part = batch.iloc[start : start + 200]
                entries = [list(e) for e in part["entries"]]
                cuts = entry_cuts([[len(x) for x in e] for e in entries], limit)
                long = [x for e in entries for x in e if len(x) > limit]
                within = dict(zip(long, text_cuts(long, limit, 0))) if long else {}
                pieces, repeated = [], []
                for e, c in zip(entries, cuts):
                    ps, os, before = [], [], 0
                    for a, b in c:
                        if b == a + 1 and e[a] in within:
                            parts = [e[a][i:j] for i, j in within[e[a]]]
                        else:
                            parts = [" ".join(e[a:b])]
                        ps += parts
                        os += [len(e[a]) if a < before else 0] + [0] * (len(parts) - 1)
                        before = b
                    pieces.append(ps)
                    repeated.append(os)
                yield _numbered(part["key"].tolist(), pieces, repeated)

    return rows.mapInPandas(run, f"key {kind}, piece_no int, piece string, repeated int").withColumnRenamed("key", key)


def oversized(metadata: DataFrame, scenes: DataFrame) -> DataFrame:
    """(item_kind, item_key) of the plots and dialogues that come out in more than one piece."""
    plots = split_texts(metadata, "tmdb_id", "wiki_plot").where("piece_no = 1").select(F.lit("wiki_plot").alias("item_kind"), F.col("tmdb_id").alias("item_key"))
    spoken = split_dialogues(scenes).where("piece_no = 1").select(F.lit("dialogue").alias("item_kind"), F.col("scene_id").alias("item_key"))
    return plots.unionByName(spoken).distinct()
