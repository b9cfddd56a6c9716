"""Quality checks; each gives (check, severity, slug, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenelake.functions import text as X
from scenelake.operators.index import latest_metadata

# Fixed: words of titles that mean nothing by themselves.
TITLE_STOPWORDS = "the a an of and in to".split()
OVERLAP, YEARS, WORDS, EMPTY_SHARE, SPEECHES, MATCH_RATE, CHARACTERS = 0.4, 1, 10, 0.2, 300, 0.4, 5


def _issue(rows: DataFrame, check: str, severity, message: Column, where: Column | str | None = None) -> DataFrame:
    rows = rows if where is None else rows.where(where)
    return rows.select(F.lit(check).alias("check"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), "slug", message.alias("message"))


def missing_metadata(manifest: DataFrame, metadata: DataFrame) -> DataFrame:
    gone = manifest.select("slug", "tmdb_id").distinct().join(metadata.select("tmdb_id").distinct(), "tmdb_id", "left_anti").select("slug").distinct()
    return _issue(gone, "missing_metadata", "CRITICAL", F.lit("no metadata"))


def title_and_year(manifest: DataFrame, metadata: DataFrame) -> DataFrame:
    """Titles whose meaningful words overlap too little, other differences, and years too far apart."""
    rows = manifest.select("filename", "slug", "tmdb_id", "title").distinct().join(latest_metadata(metadata).select("tmdb_id", F.col("title").alias("known"), "release_date"), "tmdb_id")
    stop = F.array(*map(F.lit, TITLE_STOPWORDS))
    words = lambda c: F.array_distinct(F.array_except(X.non_empty(F.split(X.audit_title(c), " +")), stop))
    rows = rows.withColumn("a", words("title")).withColumn("b", words("known"))
    rows = rows.withColumn("overlap", F.size(F.array_intersect("a", "b")) / F.greatest(F.size("a"), F.size("b"), F.lit(1)))
    differs = X.audit_title("title") != X.audit_title("known")
    title = _issue(rows, "title_mismatch", F.when(F.col("overlap") < OVERLAP, "CRITICAL").otherwise("INFO"), F.concat(F.col("title"), F.lit(" / "), F.col("known")), differs)
    gap = F.abs(X.file_year("filename").cast("int") - F.expr("try_cast(substring(release_date, 1, 4) as int)"))
    return title.unionByName(_issue(rows, "year_mismatch", "WARNING", F.concat(F.col("filename"), F.lit(" / "), F.col("release_date")), gap > YEARS))


def ambiguous_titles(manifest: DataFrame, titles: list[str]) -> DataFrame:
    return _issue(manifest.select("slug", "title").distinct(), "ambiguous_title", "INFO", F.col("title"), F.lower("title").isin([t.lower() for t in titles]))


def scene_checks(manifest: DataFrame, scenes: DataFrame) -> DataFrame:
    """Movies without scenes or dialogue, with few words or many empty scenes, and scenes with too many speeches."""
    latest = scenes.dropDuplicates(["scene_id"]).withColumn("speeches", F.coalesce(F.when(F.col("dialogue").isNotNull(), F.size("dialogue")), F.lit(0)))
    bare = (F.coalesce(F.when(F.col("action_lines").isNotNull(), F.size("action_lines")), F.lit(0)) == 0) & (F.col("speeches") == 0)
    per = latest.groupBy("slug").agg(
        F.count("*").alias("scenes"), F.sum("speeches").alias("speeches"), F.avg(F.coalesce("word_count", F.lit(0))).alias("words"), F.avg(bare.cast("int")).alias("bare"), F.max("speeches").alias("most")
    )
    rows = manifest.select("slug").distinct().join(per, "slug", "left")
    checks = [
        _issue(rows, "no_scenes", "CRITICAL", F.lit("0 scenes"), "scenes is null"),
        _issue(rows, "no_dialogue", "WARNING", F.lit("0 dialogue entries"), "speeches = 0"),
        _issue(rows, "few_words", "WARNING", F.format_string("%.1f words a scene", "words"), F.col("words") < WORDS),
        _issue(rows, "empty_scenes", F.when(F.col("bare") > EMPTY_SHARE, "WARNING").otherwise("INFO"), F.format_string("%.3f empty", "bare"), F.col("bare") > 0),
        _issue(rows, "long_dialogue", "WARNING", F.format_string("%d entries in a scene", "most"), F.col("most") > SPEECHES),
    ]
    return reduce(DataFrame.unionByName, checks)


def completeness(manifest: DataFrame, metadata: DataFrame) -> DataFrame:
    """Metadata without overview or cast, or without directors, genres or poster."""
    slugs = manifest.where("trim(tmdb_id) not in ('', '0')").select("slug", "tmdb_id").distinct()
    rows = slugs.join(latest_metadata(metadata), "tmdb_id")
    empty = lambda c: F.col(c).isNull() | (F.size(c) == 0)
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    checks = {"no_overview": ("CRITICAL", blank("overview")), "no_cast": ("CRITICAL", empty("cast")), "no_directors": ("WARNING", empty("directors")), "no_genres": ("WARNING", empty("genres")), "no_poster": ("WARNING", blank("poster_url"))}
    return reduce(DataFrame.unionByName, [_issue(rows, k, s, F.lit(k), c) for k, (s, c) in checks.items()])


def match_rates(characters: DataFrame) -> DataFrame:
    """(slug, n, matched, rate) of the characters of each movie, and of all in the row with slug null."""
    rows = characters.dropDuplicates(["char_id"])
    hit = (F.col("match_type") != "unmatched").cast("int")
    return rows.rollup("slug").agg(F.count("*").alias("n"), F.sum(hit).alias("matched"), F.round(F.avg(hit) * 100, 2).alias("rate"))


def match_checks(characters: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Movies with a low rate of matched characters, with the most frequent unmatched ones; with a manifest also its movies without characters."""
    rows = characters.dropDuplicates(["char_id"])
    lost = F.when(F.col("match_type") == "unmatched", F.struct((-F.col("scene_count")).alias("n"), F.col("screenplay_name").alias("name")))
    per = rows.groupBy("slug").agg(F.count("*").alias("n"), F.avg((F.col("match_type") != "unmatched").cast("int")).alias("rate"), F.transform(F.slice(F.array_sort(F.collect_list(lost)), 1, 5), lambda x: x["name"]).alias("lost"))
    low = _issue(per, "match_rate", F.when(F.col("n") > CHARACTERS, "WARNING").otherwise("INFO"), F.array_join("lost", ", "), (F.col("rate") < MATCH_RATE))
    if manifest is None:
        return low
    bare = manifest.select("slug").where("slug is not null").distinct().join(characters.select("slug").distinct(), "slug", "left_anti")
    return low.unionByName(_issue(bare, "no_characters", "WARNING", F.lit("0 characters")))


def duplicates(manifest: DataFrame) -> DataFrame:
    """tmdb_ids and slugs that several files share; unresolved ids and repeated rows do not count."""
    files = manifest.select("filename", "tmdb_id", "slug").distinct()
    ids = files.where("trim(tmdb_id) not in ('', '0')").groupBy("tmdb_id").agg(F.count("*").alias("n"), F.min("slug").alias("slug"))
    slugs = files.groupBy("slug").agg(F.count("*").alias("n"))
    return _issue(ids, "duplicate_id", "CRITICAL", F.col("tmdb_id"), "n > 1").unionByName(_issue(slugs, "duplicate_slug", "CRITICAL", F.col("slug"), "n > 1"))


def missing_outputs(manifest: DataFrame, outputs: dict[str, DataFrame]) -> DataFrame:
    """Slugs that an output table lacks."""
    slugs = manifest.select("slug").distinct()
    return reduce(DataFrame.unionByName, [_issue(slugs.join(t.select("slug").distinct(), "slug", "left_anti"), "missing_output", "CRITICAL", F.lit(name)) for name, t in outputs.items()])


def middle_scenes(scenes: DataFrame) -> DataFrame:
    """(slug, scene_id, heading, first_action) of the scene in the middle of each movie, to look at."""
    latest = scenes.where("slug is not null").dropDuplicates(["scene_id"]).select("slug", "scene_id", "scene_number", "heading", F.try_element_at("action_lines", F.lit(1)).alias("first_action"))
    sizes = latest.groupBy("slug").agg(F.count("*").alias("n"))
    w = Window.partitionBy("slug").orderBy(F.asc_nulls_last("scene_number"), "scene_id")
    placed = latest.withColumn("place", F.row_number().over(w)).join(sizes, "slug")
    return placed.where(F.col("place") == F.floor(F.col("n") / 2) + 1).select("slug", "scene_id", "heading", "first_action")


def ambiguous_by_metadata(manifest: DataFrame, metadata: DataFrame) -> DataFrame:
    """Files whose title more than one metadata record has."""
    shared = latest_metadata(metadata).where("title is not null").groupBy(F.lower("title").alias("low")).agg(F.count("*").alias("n")).where("n > 1").select("low")
    rows = manifest.select("slug", "title").distinct().withColumn("low", F.lower("title")).join(shared, "low", "left_semi")
    return _issue(rows, "ambiguous_title", "INFO", F.col("title"))


def audit(manifest: DataFrame, metadata: DataFrame, scenes: DataFrame, characters: DataFrame, ambiguous: list[str] = ()) -> DataFrame:
    """All checks."""
    parts = [missing_metadata(manifest, metadata), title_and_year(manifest, metadata), scene_checks(manifest, scenes), completeness(manifest, metadata), match_checks(characters, manifest), duplicates(manifest)]
    if ambiguous:
        parts.append(ambiguous_titles(manifest, list(ambiguous)))
    return reduce(DataFrame.unionByName, parts)
