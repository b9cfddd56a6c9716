"""Registry of movies and the structured indices over people, genres, characters and locations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.operators.index import latest_metadata


def registry(manifest: DataFrame, metadata: DataFrame, scenes: DataFrame | None = None) -> DataFrame:
    """(movie_id, title, slug, year, genres, directors, overview, poster_url, tmdb_url, scene_count): one row for each movie with metadata.

    year is the first four characters of the date, '' without one; scene_count is the true number of distinct scenes.
    """
    latest = latest_metadata(metadata)
    slugs = manifest.where("tmdb_id is not null and trim(tmdb_id) not in ('', '0')").groupBy(F.col("tmdb_id").alias("movie_id")).agg(F.min("slug").alias("slug"))
    out = latest.select(
        F.col("tmdb_id").alias("movie_id"), "title", F.substring(F.coalesce("release_date", F.lit("")), 1, 4).alias("year"),
        F.coalesce("genres", F.array().cast("array<string>")).alias("genres"), F.coalesce("directors", F.array().cast("array<string>")).alias("directors"),
        "overview", "poster_url", "tmdb_url",
    ).join(slugs, "movie_id", "left")
    if scenes is None:
        return out.withColumn("scene_count", F.lit(None).cast("bigint"))
    counts = scenes.groupBy("movie_id").agg(F.countDistinct("scene_id").alias("scene_count"))
    return out.join(counts, "movie_id", "left").withColumn("scene_count", F.coalesce("scene_count", F.lit(0)))


def titled(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows with the title of their movie, 'Movie {id}' where the registry has none."""
    return rows.join(registry.select("movie_id", "title"), "movie_id", "left").withColumn("title", F.coalesce("title", F.concat(F.lit("Movie "), F.col("movie_id"))))


def people_index(metadata: DataFrame) -> DataFrame:
    """(kind, key, movie_ids): sets of movies by actor, director and genre, keys in lower case."""
    latest = latest_metadata(metadata)
    kinds = {"actor": F.col("cast.name"), "director": F.col("directors"), "genre": F.col("genres")}

    def keyed(kind: str, values):
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), F.lower(x).alias("key")))

    keys = F.flatten(F.array(*(keyed(k, v) for k, v in kinds.items())))
    rows = latest.select(F.col("tmdb_id").alias("movie_id"), F.explode(keys).alias("x")).select("x.kind", "x.key", "movie_id").where("key <> ''")
    return rows.groupBy("kind", "key").agg(F.sort_array(F.collect_set("movie_id")).alias("movie_ids"))


def character_index(characters: DataFrame, metadata: DataFrame) -> DataFrame:
    """(key, entries): matched characters by screenplay name in lower case; entries may repeat, as rows do."""
    titles = latest_metadata(metadata).select(F.col("tmdb_id").alias("movie_id"), "title")
    rows = characters.where("match_type <> 'unmatched' and screenplay_name <> ''").join(titles, "movie_id")
    entry = F.struct("movie_id", "title", "tmdb_character", "actor", "scene_count")
    return rows.groupBy(F.lower("screenplay_name").alias("key")).agg(F.sort_array(F.collect_list(entry)).alias("entries"))


def location_index(scenes: DataFrame, metadata: DataFrame) -> DataFrame:
    """(key, entries): scenes by location in lower case."""
    titles = latest_metadata(metadata).select(F.col("tmdb_id").alias("movie_id"), "title")
    rows = scenes.select("scene_id", "movie_id", "location").distinct().where("location <> ''").join(titles, "movie_id")
    return rows.groupBy(F.lower("location").alias("key")).agg(F.sort_array(F.collect_list(F.struct("movie_id", "title", "scene_id"))).alias("entries"))


def merged_index(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two set indices of (kind, key, movie_ids) as one."""
    both = old.unionByName(new).select("kind", "key", F.explode("movie_ids").alias("movie_id"))
    return both.groupBy("kind", "key").agg(F.sort_array(F.collect_set("movie_id")).alias("movie_ids"))
