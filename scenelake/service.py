"""What a server or a command line needs: status, planning, search, movies, clips, and the steps of a build."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake import runtime
from scenelake.operators import entities, index, registry, rerank, search, video
from scenelake.plans.query_plan import QueryPlan, classify
from scenelake.sources import files, screenplay

STEPS = ("sync", "convert", "parse", "reconcile", "index")
MODES = ("faiss", "bm25", "hybrid")


class NotFound(LookupError):
    """No such movie or step."""


def checked(query: str, top_k: int, mode: str) -> str:
    """The query without outer white space; ValueError outside the bounds of the interface."""
    if not query or not query.strip():
        raise ValueError("the query is blank")
    if not 1 <= top_k <= 20:
        raise ValueError("top_k must lie between 1 and 20")
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    return query.strip()


class Service:
    """Search over the tables of one store folder; reload() takes up what a build has written since."""

    def __init__(self, spark: SparkSession, store: str, planner: Callable[[str], str] | None = None, judge: Callable | None = None, embed: Callable[[str], list[float]] | None = None):
        self.spark, self.store, self.planner, self.judge, self.embed = spark, store, planner, judge, embed
        self.reload()

    def reload(self) -> None:
        table = lambda n: self.spark.read.parquet(f"{self.store}/{n}")
        self.registry, self.docs, self.people = table("registry"), table("documents"), table("people")
        vectors = table("vectors")
        width = len((vectors.select("vec").first() or {"vec": []})["vec"])
        # The build stores hashed vectors, so queries are hashed alike where no embedder is given.
        embed = self.embed or (lambda text: index.hashed_vector(self.spark, text, width))
        self.retriever = search.Retriever(self.docs, self.registry, vectors, embed, self.people, index.SparseIndex(self.spark, f"{self.store}/sparse"))

    def status(self) -> dict:
        return {"status": "ok", "movies": self.registry.count(), "full_index": not self.docs.where(F.col("index") == "full").isEmpty()}

    def classify(self, query: str) -> QueryPlan:
        return classify(checked(query, 1, "bm25"), self.planner)

    def search(self, query: str, plan: QueryPlan, mode: str = "hybrid", top_k: int = 5) -> DataFrame:
        """(rank, movie_id, title, score, scene_ids) by an explicit plan, reordered by the judge with the original query."""
        text = checked(query, top_k, mode)
        found = rerank.list_wise(self.retriever.retrieve(plan, text, mode, top_k), self.judge, top_k, text, self.registry, self.docs)
        return registry.titled(found, self.registry).select("rank", "movie_id", "title", "score", F.col("top_scenes").alias("scene_ids")).orderBy("rank")

    def query(self, query: str, mode: str = "hybrid", top_k: int = 5, intents: str | None = None) -> DataFrame:
        return self.search(query, QueryPlan.manual(intents) if intents else self.classify(query), mode, top_k)

    def movies(self) -> DataFrame:
        return self.registry.orderBy("title")

    def movie(self, movie_id: str) -> dict:
        row = self.registry.where(F.col("movie_id") == movie_id).first()
        if row is None:
            raise NotFound(movie_id)
        return row.asDict(recursive=True)

    def video_query(self, clips: DataFrame, query: str, top_k: int = 3, fields: tuple[str, ...] = ()) -> DataFrame:
        return video.query(video.unpivot(clips), video.transcripts(clips), query, fields=fields, top_k=top_k)


def build(spark: SparkSession, source: str, store: str, steps: tuple[str, ...] = STEPS, incremental: bool = False, dry_run: bool = False, pdf: Callable | None = None, embed_width: int = 384) -> dict[str, int]:
    """Run the steps of a build in order and give the rows each wrote; metadata is read from {store}/metadata.

    An incremental build parses and indexes only what the tables lack; the sparse
    index takes in the new documents and counts its statistics anew.
    """
    for s in steps:
        if s not in STEPS:
            raise NotFound(s)
    table = lambda n: spark.read.parquet(f"{store}/{n}")
    wrote: dict[str, int] = {}

    def there(name: str) -> bool:
        try:
            table(name).limit(1).count()
            return True
        except Exception:  # not written yet
            return False

    def put(df: DataFrame, name: str, mode: str = "overwrite", by: str | None = None) -> None:
        if dry_run:
            wrote[name] = df.count()
            return
        ready = runtime.cut(df)  # the table may be read and written at once
        writer = ready.write.mode(mode)
        (writer.partitionBy(by) if by else writer).parquet(f"{store}/{name}")
        wrote[name] = ready.count()

    if "sync" in steps:
        found = files.scan(spark, source)
        old = table("manifest") if there("manifest") else spark.createDataFrame([], "filename string, tmdb_id string, title string, slug string")
        put(files.merged_manifest(old, found), "manifest")
    if "convert" in steps:
        texts = files.extract(files.scan(spark, source), pdf).join(table("manifest").select("filename", "slug"), "filename")
        if incremental and there("texts"):
            texts = texts.join(table("texts").select("filename"), "filename", "left_anti")
        texts = runtime.cut(texts)
        mode = "append" if incremental else "overwrite"
        put(texts.where("error is null").select("filename", "slug", "text"), "texts", mode)
        put(texts.where("error is not null").select("filename", "slug", "error"), "rejects", mode)
    if "parse" in steps:
        texts = table("texts")
        if incremental and there("scenes"):
            texts = texts.join(table("scenes").select("slug").distinct(), "slug", "left_anti")
        ids = table("manifest").select("slug", F.col("tmdb_id").alias("movie_id"))
        scenes = screenplay.scenes(screenplay.cleaned(screenplay.lines(texts)), ids).withColumn("ingested_at", F.current_timestamp())
        put(scenes, "scenes", "append" if incremental else "overwrite")
    if "reconcile" in steps:
        put(entities.reconcile(table("scenes"), table("metadata")), "characters")
    if "index" in steps:
        docs = index.index_documents(table("scenes"), table("metadata"))
        if incremental and there("documents"):
            docs = docs.join(table("documents").select("index", "doc_key"), ["index", "doc_key"], "left_anti")
        docs = runtime.cut(docs)
        mode = "append" if incremental else "overwrite"
        put(docs, "documents", mode, "index")
        if not dry_run:
            index.write_sparse(docs, f"{store}/sparse", mode)
        put(index.hashed_vectors(docs, ["index", "doc_key"], width=embed_width), "vectors", mode, "index")
        put(registry.registry(table("manifest"), table("metadata"), table("scenes")), "registry")
        put(entities.people(table("metadata")), "people")
        put(registry.people_index(table("metadata")), "people_index")
        put(registry.character_index(table("characters"), table("metadata")), "character_index")
        put(registry.location_index(table("scenes"), table("metadata")), "location_index")
    return wrote


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description="Build and query a store of screenplays")
    ap.add_argument("--store", required=True)
    ap.add_argument("--source")
    ap.add_argument("--query")
    ap.add_argument("--intent")
    ap.add_argument("--mode", default="bm25", choices=MODES)
    ap.add_argument("--top-k", type=int, default=5)
    ap.add_argument("--from", dest="start", choices=STEPS)
    ap.add_argument("--only", choices=STEPS)
    ap.add_argument("--incremental", action="store_true")
    ap.add_argument("--dry-run", action="store_true")
    a = ap.parse_args(argv)
    spark = runtime.session("scenelake")
    if a.query:
        for r in Service(spark, a.store).query(a.query, a.mode, a.top_k, a.intent).collect():
            print(f"{r['rank']:>2}. {r['title']}  {r['score']:.4f}  {', '.join(r['scene_ids'])}")
        return
    steps = (a.only,) if a.only else STEPS[STEPS.index(a.start) :] if a.start else STEPS
    print(json.dumps(build(spark, a.source, a.store, steps, a.incremental, a.dry_run)))


if __name__ == "__main__":
    main()
