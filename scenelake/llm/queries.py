"""The queries of the nine training-data problems over the data folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scenelake.llm import canonical, chunking, encoding, leakage, lexicon, linkage, names, scans, stuffing
from scenelake.runtime import read


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unresolved files with the record of the same movie."""
    return p1_linked(spark, sf_dir).select("filename", "tmdb_id")


def p1_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unresolved files with the record of the same movie and the confidence of the match."""
    return linkage.link(read(spark, sf_dir, "manifest"), read(spark, sf_dir, "metadata"), read(spark, sf_dir, "characters"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings and action lines with noise of scanning."""
    return scans.noisy_fields(read(spark, sf_dir, "scenes"))


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean headings and continuous paragraphs of every scene."""
    return scans.repaired_scenes(read(spark, sf_dir, "scenes"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings of one character within a movie."""
    return names.same_character(read(spark, sf_dir, "characters"), read(spark, sf_dir, "scenes"))


def p3_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with the profile it belongs to: membership instead of pairs."""
    return names.resolve(names.spellings(read(spark, sf_dir, "characters"), read(spark, sf_dir, "scenes")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled action lines and dialogue lines."""
    return encoding.garbled(read(spark, sf_dir, "scenes")).select("scene_id", "field_name", "pos").distinct()


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled lines with the text as far as it can be brought back."""
    return encoding.restored(read(spark, sf_dir, "scenes"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plots over 2,000 characters and dialogues over 1,500."""
    return chunking.oversized(read(spark, sf_dir, "metadata"), read(spark, sf_dir, "scenes"))


def p5_plot_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized plot."""
    return chunking.split_texts(read(spark, sf_dir, "metadata"), "tmdb_id", "wiki_plot")


def p5_dialogue_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized dialogue."""
    return chunking.split_dialogues(read(spark, sf_dir, "scenes"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed genres and excluded titles with the reference entry meant, or -1."""
    plans, genres, titles = (read(spark, sf_dir, t) for t in ("query_plans", "genre_ref", "title_ref"))
    return canonical.canonical_values(plans, genres, titles).select("plan_id", "field_name", "pos", "ref_id").distinct()


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return lexicon.encode_corpus(read(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the held-out items they leak."""
    return leakage.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "heldout_cases")).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the items they leak: words of the passage, shares of the question's and the answer's words."""
    return leakage.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "heldout_cases"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are mainly keywords, links or wares."""
    return stuffing.spam(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_linked, p2_found, p2_repaired, p3_found, p3_profiles, p4_found, p4_restored, p5_found, p5_plot_pieces, p5_dialogue_pieces, p6_found, p7_ids, p8_found, p8_leaks, p9_found)}

_SPOKEN = "array_to_string(list_transform(list_filter(dialogue, lambda d: regexp_matches(coalesce(d.character, ''), '\\S') AND regexp_matches(coalesce(d.line, ''), '\\S')), lambda d: d.character || ': ' || d.line), ' ')"
SQL: dict[str, str] = {
    "p5_found": f"""
        SELECT DISTINCT 'wiki_plot' AS item_kind, tmdb_id AS item_key FROM metadata WHERE length(wiki_plot) > 2000 AND tmdb_id IS NOT NULL
        UNION ALL SELECT DISTINCT 'dialogue', scene_id FROM scenes WHERE length({_SPOKEN}) > 1500 AND scene_id IS NOT NULL""",
}
