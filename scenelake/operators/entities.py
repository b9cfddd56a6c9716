"""People in queries, and screenplay names matched with the cast."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenelake.functions import text as X

FUZZY = 0.80
LEAST_TOKENS = 2


def people(metadata: DataFrame) -> DataFrame:
    """(name, movie_id, role) of every actor and director of at least two words."""
    cast = metadata.select(F.col("tmdb_id").alias("movie_id"), F.explode(F.col("cast.name")).alias("name"), F.lit("actor").alias("role"))
    led = metadata.select(F.col("tmdb_id").alias("movie_id"), F.explode("directors").alias("name"), F.lit("director").alias("role"))
    return cast.unionByName(led).where(F.size(X.tokens_ascii("name")) >= LEAST_TOKENS).distinct()


def people_in_queries(people: DataFrame, queries: DataFrame, query_id: str = "query_id", query_text: str = "query_text", threshold: float = FUZZY) -> DataFrame:
    """(query_id, name, movie_id, match) of the people a query names: 'exact' if it holds all their words, else 'fuzzy' if each word has one alike.

    Exact matches are found by an equi-join on words; only names that miss it are
    compared letter by letter, and only with words whose lengths allow the threshold.
    """
    from scenelake.operators.search import small

    asked = queries.select(F.col(query_id).alias("query_id"), F.array_distinct(X.tokens_ascii(query_text)).alias("words"))
    names = people.select("name").distinct().withColumn("parts", F.array_distinct(X.tokens_ascii("name")))
    parts = names.select("name", F.size("parts").alias("n"), F.explode("parts").alias("part"))
    words = asked.select("query_id", F.explode("words").alias("part"))
    exact = parts.join(words, "part").groupBy("query_id", "name", "n").count().where("count = n").select("query_id", "name", F.lit("exact").alias("match"))
    # ratio >= t asks for 2 * min / (a + b) >= t, so lengths must lie close together. Each distinct pair of words is compared once.
    short = threshold / (2 - threshold)
    known = parts.select("part", F.length("part").alias("size")).distinct()
    pairs = known.join(small(words.select(F.col("part").alias("word")).distinct()), (F.length("word") >= F.col("size") * short) & (F.length("word") * short <= F.col("size")))

    def alike(batches):
        known: dict[str, SequenceMatcher] = {}  # a word's letters are counted once; the words are the queries' and few for each task
        for batch in batches:
            keep = []
            for part, word in zip(batch["part"], batch["word"]):
                if word not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[word] = SequenceMatcher(None, "", word)
                m = known[word]
                m.set_seq1(part)
                keep.append(m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and m.ratio() >= threshold)  # the first two are upper bounds
            yield batch[pd.Series(keep, index=batch.index, dtype=bool)]

    close = pairs.mapInPandas(alike, pairs.schema).select("part", "word")
    near = parts.join(close, "part").join(words.withColumnRenamed("part", "word"), "word").groupBy("query_id", "name", "n").agg(F.countDistinct("part").alias("hit")).where("hit = n")
    fuzzy = near.select("query_id", "name", F.lit("fuzzy").alias("match")).join(exact, ["query_id", "name"], "left_anti")
    return exact.unionByName(fuzzy).join(people.select("name", "movie_id").distinct(), "name").select("query_id", "name", "movie_id", "match")


def people_in_query(people: DataFrame, text: str) -> DataFrame:
    return people_in_queries(people, people.sparkSession.createDataFrame([(0, text)], "query_id int, query_text string"))


def reconcile(scenes: DataFrame, metadata: DataFrame) -> DataFrame:
    """(slug, movie_id, screenplay_name, tmdb_character, actor, match_type, scene_count, tmdb_order) of every speaker of every movie.

    Equal names first, in order of billing; else all words of one in the other;
    else one within the other. A blank role matches nobody. Unmatched names come last, with order -1.
    """
    latest = scenes.dropDuplicates(["scene_id"])
    seen = latest.select("slug", "movie_id", "scene_id", F.explode("characters").alias("screenplay_name")).where("screenplay_name <> ''")
    counted = seen.groupBy("slug", "movie_id", "screenplay_name").agg(F.countDistinct("scene_id").alias("scene_count"))
    return match_cast(counted, cast_roles(metadata))


def cast_roles(metadata: DataFrame) -> DataFrame:
    """(movie_id, tmdb_order, tmdb_character, actor) with blank roles left out."""
    from scenelake.operators.index import latest_metadata

    roles = latest_metadata(metadata).select(F.col("tmdb_id").alias("movie_id"), F.posexplode("cast").alias("tmdb_order", "c"))
    return roles.select("movie_id", "tmdb_order", F.col("c.character").alias("tmdb_character"), F.col("c.name").alias("actor")).where("trim(tmdb_character) <> ''")


def match_cast(names: DataFrame, roles: DataFrame) -> DataFrame:
    """The best role for each (slug, movie_id, screenplay_name); see reconcile()."""
    a, b = X.plain_name("screenplay_name"), X.plain_name("tmdb_character")
    mine, theirs = X.name_tokens("screenplay_name"), X.name_tokens("tmdb_character")
    within = (F.size(mine) > 0) & (F.size(theirs) > 0) & ((F.size(F.array_except(mine, theirs)) == 0) | (F.size(F.array_except(theirs, mine)) == 0))
    priority = F.when(a == b, 0).when(within, 1).when((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)), 2)
    pairs = names.join(roles, "movie_id").withColumn("priority", priority).where("priority is not null")
    w = Window.partitionBy("slug", "movie_id", "screenplay_name").orderBy("priority", "tmdb_order")
    best = pairs.withColumn("n", F.row_number().over(w)).where("n = 1").select("slug", "movie_id", "screenplay_name", "tmdb_character", "actor", "priority", "tmdb_order")
    kind = F.when(F.col("priority") == 0, "exact").when(F.col("priority") == 1, "token").when(F.col("priority") == 2, "substring").otherwise("unmatched")
    return names.join(best, ["slug", "movie_id", "screenplay_name"], "left").select(
        "slug", "movie_id", "screenplay_name", "tmdb_character", "actor", kind.alias("match_type"), "scene_count", F.coalesce("tmdb_order", F.lit(-1)).alias("tmdb_order")
    )


def by_scenes(characters: DataFrame, key: str = "screenplay_name") -> DataFrame:
    """Characters with their place in their movie: most scenes first, ties by key."""
    w = Window.partitionBy("slug").orderBy(F.desc_nulls_last("scene_count"), key)
    return characters.withColumn("place", F.row_number().over(w))
