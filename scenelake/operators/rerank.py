"""Reordering of the few best results by a judge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenelake.functions import text as X

TEXT_LISTWISE, TEXT_PAIRWISE = 300, 2000


def candidates(movies: DataFrame, registry: DataFrame, docs: DataFrame, scenes: int = 3, most: int = TEXT_LISTWISE) -> DataFrame:
    """(movie_id, title, year, scenes): what a list-wise judge is shown, texts cut to `most` characters."""
    top = movies.select("movie_id", F.posexplode(F.slice("top_scenes", 1, scenes)).alias("pos", "doc_key"))
    texts = docs.select("doc_key", "text").dropDuplicates(["doc_key"])
    shown = top.join(texts, "doc_key").groupBy("movie_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", X.ellipsis("text", most).alias("text")))), lambda s: s["text"]).alias("scenes"))
    return movies.select("movie_id").join(registry.select("movie_id", "title", "year"), "movie_id", "left").join(shown, "movie_id", "left")


def apply_order(ranked: DataFrame, order: DataFrame, within: list[str], key: str = "movie_id", ids: str = "ranked_ids") -> DataFrame:
    """Ranked rows in the order a judge returned: unknown and repeated ids are dropped, omitted rows follow in their old order."""
    told = order.select(*within, F.posexplode(F.array_distinct(ids)).alias("pos", key))
    placed = ranked.join(told, [*within, key], "left")
    w = Window.partitionBy(*within).orderBy(F.coalesce("pos", F.lit(2**31 - 1)), "rank")
    return placed.withColumn("new_rank", F.row_number().over(w)).drop("rank", "pos").withColumnRenamed("new_rank", "rank")


def list_wise(ranked: DataFrame, judge: Callable[[str, list[dict]], list] | None, top_k: int, query: str = "", registry: DataFrame | None = None, docs: DataFrame | None = None, key: str = "movie_id") -> DataFrame:
    """The top_k rows as the judge orders them; as they are without one, or where it fails.

    The judge gets the query and the rows in order, and with registry and docs
    also title, year and the texts of the best scenes; it gives ids back.
    """
    spark = ranked.sparkSession
    best = ranked.where(F.col("rank") <= top_k)
    if judge is None:
        return best
    shown = best if registry is None or docs is None else best.join(candidates(best, registry, docs), key, "left")
    rows = [r.asDict(recursive=True) for r in shown.orderBy("rank").collect()]
    try:
        told = [str(x) for x in judge(query, rows)]
    except Exception:  # a judge is an outside service; its failure leaves the order
        told = []
    order = spark.createDataFrame([(0, told)], "_q int, ranked_ids array<string>")
    return apply_order(best.withColumn("_q", F.lit(0)), order, ["_q"], key).drop("_q")


def pair_wise(items: list, better: Callable[[object, object], bool | None], key: Callable = id) -> list:
    """A few items in insertion order by a judge of pairs.

    Each pair is asked both ways and counts only if both answers agree; without
    agreement the order stays. Answers are remembered.
    """
    known: dict[tuple, bool | None] = {}

    def ahead(a, b) -> bool:
        pair = (key(a), key(b))
        if pair not in known:
            one, two = better(a, b), better(b, a)
            known[pair] = True if one is True and two is False else False if one is False and two is True else None
            known[pair[::-1]] = None if known[pair] is None else not known[pair]
        return known[pair] is True

    out: list = []
    for item in items:
        at = len(out)
        while at > 0 and ahead(item, out[at - 1]):
            at -= 1
        out.insert(at, item)
    return out
