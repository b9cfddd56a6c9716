"""Ranking metrics of queries with known answers."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def judged(results: DataFrame, cases: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Results (query_id, rank, title) with `hit`: any expected string lies within the title, in any case."""
    return results.join(cases.select(query_id, "ground_truth"), query_id).withColumn("hit", F.exists("ground_truth", lambda g: F.contains(F.lower("title"), F.lower(g))).cast("int"))


def per_query(results: DataFrame, cases: DataFrame, k: int = 5, query_id: str = "query_id") -> DataFrame:
    """(query_id, rr, hit, precision, recall, ndcg_ref, ndcg, intent_correct); cases without results score 0.

    precision is over the results returned; recall equals hit; ndcg_ref takes 1 as
    ideal and may exceed 1, ndcg the ideal of as many hits as there are.
    """
    top = judged(results.where(F.col("rank") <= k), cases, query_id)
    gain = F.col("hit") / F.log2(F.col("rank") + 1)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.sum("hit"), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    scored = top.groupBy(query_id).agg(
        F.coalesce(F.max(F.when(F.col("hit") == 1, 1 / F.col("rank"))), F.lit(0.0)).alias("rr"), F.max("hit").cast("double").alias("hit"), F.avg("hit").alias("precision"),
        F.max("hit").cast("double").alias("recall"), F.sum(gain).alias("ndcg_ref"), (F.sum(gain) / ideal).alias("ndcg"),
    )
    out = cases.select(query_id, "expected_intent", *(["intent"] if "intent" in cases.columns else [])).join(scored, query_id, "left").fillna(0.0, ["rr", "hit", "precision", "recall", "ndcg_ref", "ndcg"])
    right = (F.col("intent") == F.col("expected_intent")).cast("int") if "intent" in cases.columns else F.lit(None).cast("int")
    return out.withColumn("intent_correct", F.when(F.col("expected_intent").isNotNull(), right))


def means(scores: DataFrame) -> DataFrame:
    """Means over the valid queries; intent accuracy over those with an expectation. A row with `error` set does not count."""
    valid = scores.where("error is null") if "error" in scores.columns else scores
    return valid.agg(F.count("*").alias("queries"), *(F.round(F.avg(c), 4).alias(c) for c in ("rr", "hit", "precision", "recall", "ndcg_ref", "ndcg")), F.round(F.avg("intent_correct"), 4).alias("intent_accuracy"))


def run(spark: SparkSession, cases: list[dict], search: Callable[[str], list[str]], classify: Callable[[str], str] | None = None, k: int = 5) -> DataFrame:
    """per_query() with `error` and `latency` of each case (query, ground_truth, expected_intent), searched one by one.

    search gives titles in order. A case whose search or classification fails has
    its error and no results; the others go on. Cases are written by hand, so they are few.
    """
    hits, asked = [], []
    for n, case in enumerate(cases):
        began, error, intent = time.perf_counter(), None, None
        try:
            intent = classify(case["query"]) if classify else None
            hits += [(n, rank, title) for rank, title in enumerate(search(case["query"])[:k], 1)]
        except Exception as e:  # one bad query must not end the run
            error = f"{type(e).__name__}: {e}"[:200]
        asked.append((n, case["query"], case.get("ground_truth") or [], case.get("expected_intent"), intent, error, time.perf_counter() - began))
    held = spark.createDataFrame(asked, "query_id int, query string, ground_truth array<string>, expected_intent string, intent string, error string, latency double")
    scores = per_query(spark.createDataFrame(hits, "query_id int, rank int, title string"), held, k)
    return scores.join(held.select("query_id", "query", "error", F.round("latency", 2).alias("latency")), "query_id")


def write_scores(scores: DataFrame, path: str) -> None:
    """Scores of a run as lines of JSON, numbers to four places."""
    rounded = [F.round(c, 4).alias(c) if kind == "double" and c != "latency" else F.col(c) for c, kind in scores.dtypes]
    scores.select(*rounded).orderBy("query_id").coalesce(1).write.mode("overwrite").json(path)
