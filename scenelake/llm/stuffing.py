"""Keyword-stuffed pages, link lists and tag lists (problem 9).

A text is cut at line ends into blocks. Each block is compressed twice: as it
stands, which shows repeated words, and as its skeleton, in which words,
addresses and numbers are one mark each and only short words and punctuation
stay, which shows repeated links, tags and wares whose words differ. Either
ratio is divided by what blocks of the same language and length have in the
whole corpus (the median, from one aggregation over all blocks), so that 1 is
ordinary. Blocks of extreme redundancy are flagged, and confirmed by a low
density of sentence ends; lists whose lines are entries (numbered, dated, scene
headings, questions, roles) are no spam and aren't confirmed. A text is spam if
more than half of its characters lie in confirmed blocks.
"""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake import runtime

BLOCK_CHARS = 600
REDUNDANT = 1.45  # times the ordinary ratio of the text
REGULAR = 1.3  # times the ordinary ratio of the skeleton
SENTENCE_ENDS = 0.03  # a word, under which a block has no sentences
EXTREME = 1.7  # times the ordinary ratio of the text: stuffed sentences
SENTENCES = 0.12  # ends a word, from which on a block is sentences however redundant
LISTED = 0.5  # share of lines that are entries, from which on a block is a list
LEAST_BLOCKS = 30  # under which a language has no ordinary ratio of its own for a length, and that of all languages stands in, then that of all lengths
SPAM_SHARE = 0.5

_END = re.compile(r"[.!?…][\"”»’')]*(?=\s|$)")
_CLOSED = re.compile(r"[.!?…][\"”»’')]*\s*$")
_ADDRESS = re.compile(r"(?:https?://|www\.)[^\s\"'<>)\]]+|\b[\w-]+(?:\.[\w-]+)+/[^\s\"'<>)\]]*", re.I)
_LONG_WORD = re.compile(r"[^\W\d_]{4,}|[A-Z]+[^\W\d_]*")
_NUMBER = re.compile(r"[-+]?\w*\d[\w.,%]*")
_ENTRY = re.compile(r"(?m)^\s*(?:\d{1,4}\s*[-.:)–]|(?:INT|EXT|I/E)\b|[QA]:|.*\s\.{2,}\s|.*\bas\b\s)")
_LEVEL = re.compile(r"^(en|fr|de|es)\b", re.I)


def language(value: str | None) -> str:
    """en, fr, de or es, or '' for anything else."""
    found = _LEVEL.match(value.strip()) if value else None
    return found.group(1).lower() if found else ""


def blocks(text: str, size: int = BLOCK_CHARS) -> list[str]:
    """Pieces of about `size` characters made of whole lines, either all or none ending as sentences do; a longer line is cut at spaces."""
    lines = []
    for line in text.splitlines():
        while len(line) > size * 3 // 2:
            at = line.rfind(" ", size // 2, size)
            at = at if at > 0 else size
            lines.append(line[:at])
            line = line[at:]
        if line.strip():
            lines.append(line)
    found, held, chars, kind = [], [], 0, None
    for line in lines:
        sentence = bool(_CLOSED.search(line))
        if held and (chars + len(line) > size or sentence != kind):
            found.append("\n".join(held))
            held, chars = [], 0
        held.append(line)
        chars += len(line)
        kind = sentence
    if held:
        found.append("\n".join(held))
    return found


def skeleton(block: str) -> str:
    """The block with addresses, words of four letters and more or in capitals, and numbers as one mark each."""
    return _NUMBER.sub("0", _LONG_WORD.sub("w", _ADDRESS.sub("_", block)))


def traits(block: str) -> tuple[int, float, float, float, float]:
    """Characters, compression ratio of the text and of its skeleton (against the text's size), sentence ends a word, share of lines that are entries."""
    raw = block.encode("utf-8", "replace")
    lines = [x for x in block.split("\n") if x.strip()]
    return (
        len(block), len(raw) / len(zlib.compress(raw, 6)), len(raw) / len(zlib.compress(skeleton(block).encode("utf-8", "replace"), 6)),
        len(_END.findall(block)) / max(1, len(block.split())), sum(bool(_ENTRY.match(x)) for x in lines) / max(1, len(lines)),
    )


def is_stuffed(text: Column, shape: Column, ends: Column, listed: Column) -> Column:
    """Whether a block is repeated keywords, links or wares; text and shape are ratios relative to the ordinary ones."""
    flagged = (text >= REDUNDANT) | (shape >= REGULAR)
    return flagged & (ends < SENTENCE_ENDS) & (listed < LISTED) | (text >= EXTREME) & (ends < SENTENCES)


def spam_share(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, share) of every text with visible characters: the share of characters in stuffed blocks.

    Null, empty and blank texts give no row; repeated rows count once; an unknown
    or null language has its own ordinary ratio. Only the named columns are read,
    and an empty table gives an empty result. Whole texts are measured.
    """
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("key is not null and text is not null")
    kind = rows.schema["key"].dataType.simpleString()

    def measure(batches):
        for batch in batches:
            out = []
            for k, t, l in zip(batch["key"], batch["text"], batch["lang"]):
                known, sizes = language(l), set()
                for x in map(traits, blocks(t)):
                    size = min(x[0] // 100, 9)
                    out.append((k, known, size, size not in sizes, *x))
                    sizes.add(size)
            yield pd.DataFrame(out, columns=["key", "lang", "size", "lead", "chars", "ratio", "shape", "ends", "listed"])

    measured = runtime.cut(rows.mapInPandas(measure, f"key {kind}, lang string, size int, lead boolean, chars int, ratio double, shape double, ends double, listed double"))
    medians = lambda rows, end: rows.agg(F.count("*").alias(f"n{end}"), *(F.percentile_approx(c, 0.5, 1000).alias(f"{c}{end}") for c in ("ratio", "shape")))
    lead = measured.where("lead")  # one block of each length of a text, so that no long text outweighs the others
    by_lang, by_size, whole = medians(lead.groupBy("lang", "size"), "_own"), medians(lead.groupBy("size"), "_size"), medians(lead.groupBy(), "_all")
    enough = lambda end: F.col(f"n{end}") >= LEAST_BLOCKS
    usual = lambda c: F.when(enough("_own"), F.col(f"{c}_own")).when(enough("_size"), F.col(f"{c}_size")).otherwise(F.col(f"{c}_all")).alias(f"usual_{c}")
    ordinary = by_lang.join(F.broadcast(by_size), "size").crossJoin(F.broadcast(whole)).select("lang", "size", usual("ratio"), usual("shape"))  # one row of medians of all
    # At most five languages times ten sizes.
    judged = measured.join(F.broadcast(ordinary), ["lang", "size"])
    stuffed = is_stuffed(F.col("ratio") / F.col("usual_ratio"), F.col("shape") / F.col("usual_shape"), F.col("ends"), F.col("listed"))
    # A repeated row repeats all its blocks, which leaves the share as it is.
    return judged.groupBy("key").agg((F.sum(F.when(stuffed, F.col("chars")).otherwise(0)) / F.sum("chars")).alias("share")).withColumnRenamed("key", key)


def spam(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", share: float = SPAM_SHARE) -> DataFrame:
    """(key) of the texts of which more than `share` is keywords, links or wares instead of sentences."""
    return spam_share(documents, key, text, lang).where(F.col("share") > share).select(key)
