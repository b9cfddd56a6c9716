"""Clips: fields as rows, routing, search by field, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenelake.functions import text as X
from scenelake.operators import index as I
from scenelake.operators import search as S

CLIP_FIELDS = ("visual_description", "action", "emotional_tone", "thematic_connection", "subjects", "description")
MOVIE_FIELDS = ("plot_summary", "themes", "tone")
CLIP = "struct<visual_description:string,action:string,emotional_tone:string,thematic_connection:string,subjects:string,description:string,concatenated_transcript:string,youtube_link:string,timestamp:string>"
SCHEMA = f"map<string,struct<plot_summary:string,themes:array<string>,tone:string,clips:map<string,{CLIP}>>>"


def parse_clips(json: DataFrame, column: str = "value") -> DataFrame:
    """(movie, plot_summary, themes, tone, clips) from JSON documents of movies."""
    return json.select(F.explode(F.from_json(column, SCHEMA)).alias("movie", "m")).select("movie", "m.*")


def unpivot(movies: DataFrame) -> DataFrame:
    """(id, movie, clip_id, field_type, content, youtube_link, timestamp, description): a row for each clip and field and each movie-level field that is not blank."""
    clips = movies.select("movie", F.explode("clips").alias("clip_id", "c"))
    fields = F.array(*(F.struct(F.lit(f).alias("field_type"), F.col(f"c.{f}").alias("content")) for f in CLIP_FIELDS))
    text = lambda c: F.coalesce(c, F.lit(""))
    by_clip = clips.select("movie", "clip_id", F.explode(fields).alias("f"), *(text(F.col(f"c.{x}")).alias(x) for x in ("youtube_link", "timestamp", "description")))
    level = F.array(*(F.struct(F.lit(f).alias("field_type"), (F.array_join("themes", ", ") if f == "themes" else F.col(f)).alias("content")) for f in MOVIE_FIELDS))
    by_movie = movies.select("movie", F.lit("").alias("clip_id"), F.explode(level).alias("f"), *(F.lit("").alias(x) for x in ("youtube_link", "timestamp", "description")))
    rows = by_clip.unionByName(by_movie).select("movie", "clip_id", "f.field_type", "f.content", "youtube_link", "timestamp", "description").where("trim(content) <> ''")
    return rows.withColumn("id", F.concat_ws("__", "movie", F.when(F.col("clip_id") == "", "movie").otherwise(F.col("clip_id")), "field_type"))


def transcripts(movies: DataFrame) -> DataFrame:
    """(movie, clip_id, content, youtube_link, timestamp, description) of the clips with a transcript."""
    rows = movies.select("movie", F.explode("clips").alias("clip_id", "c"))
    return rows.select("movie", "clip_id", F.col("c.concatenated_transcript").alias("content"), "c.youtube_link", "c.timestamp", "c.description").where("trim(content) <> ''")


def save_transcripts(spoken: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store the sparse index of transcripts() under index 'dialogue', by movie and clip."""
    rows = spoken.select(F.lit("dialogue").alias("index"), F.concat_ws("__", "movie", "clip_id").alias("doc_key"), F.col("content").alias("text"))
    I.write_sparse(rows, path, mode, unicode=True)


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Old rows and new ones, a new row in the place of the old one with its key; of repeated new rows one."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.dropDuplicates([key]))


def fuse(ranked: DataFrame, within: list[str]) -> DataFrame:
    """(within..., movie, clip_id, rrf_score, matched_fields, retrieval_rank): lists fused by clip, payload and order of the fields as first seen."""
    hits = ranked.withColumn("clip", F.struct("movie", "clip_id"))
    place = F.struct("list_no", "rank")
    out = hits.groupBy(*within, "movie", "clip_id").agg(
        F.round(F.sum(1.0 / (S.RRF_K + F.col("rank"))), 6).alias("rrf_score"), F.min(place).alias("seen"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("list_no", "rank", "field_type"))), lambda x: x["field_type"])).alias("matched_fields"),
    )
    w = Window.partitionBy(*within).orderBy(F.desc("rrf_score"), "seen", "movie", "clip_id")
    return out.withColumn("retrieval_rank", F.row_number().over(w)).drop("seen")


def query(docs: DataFrame, spoken: DataFrame, text: str, vectors: DataFrame | None = None, embed=None, fields: tuple[str, ...] = (), top_k: int = 3, distinct_clips: bool = True) -> DataFrame:
    """(movie, clip_id, rrf_score, matched_fields, retrieval_rank) for one query.

    The first field is the routed one where none is given. Dialogue is searched
    sparsely by transcript, other fields densely where vectors and an embedder
    are given, else sparsely by their text. One list is not fused: its score
    stands as rrf_score, and a clip shows once if distinct_clips.
    """
    if not text or not text.strip():
        raise ValueError("the query is blank")
    spark = docs.sparkSession
    asked = spark.createDataFrame([(0, text)], "query_id int, query_text string")
    chosen = list(dict.fromkeys(fields)) or [asked.select(X.route_field("query_text")).first()[0]]
    lists = None
    for no, field in enumerate(chosen):
        name = {"visual": "visual_description", "emotional": "emotional_tone", "thematic": "thematic_connection", "plot": "plot_summary"}.get(field, field)
        if field == "dialogue":
            rows = spoken.withColumn("key", F.concat_ws("__", "movie", "clip_id"))
            scored = S.bm25_scores(rows, asked, key="key", text="content", unicode=True)
        else:
            rows = docs.where(F.col("field_type") == name).withColumn("key", F.col("id"))
            if vectors is not None and embed is not None:
                q = spark.createDataFrame([(0, [float(x) for x in embed(text)])], "query_id int, query_vec array<double>")
                scored = S.dense_scores(vectors.join(rows.select(F.col("key").alias("id")), "id", "left_semi"), q, key="id").withColumnRenamed("id", "key").withColumn("score", S.similarity("score"))
            else:
                scored = S.bm25_scores(rows, asked, key="key", text="content", unicode=True)
        ranked = S.until_zero(S.top(scored, top_k, ["query_id"], key="key", digits=4), ["query_id"])
        one = ranked.join(rows.select("key", "movie", "clip_id"), "key").select("query_id", F.lit(no).alias("list_no"), F.lit(name).alias("field_type"), "movie", "clip_id", "score", "rank")
        lists = one if lists is None else lists.unionByName(one)
    if len(chosen) > 1:
        return fuse(lists, ["query_id"]).where(F.col("retrieval_rank") <= top_k).drop("query_id")
    single = lists
    if distinct_clips:
        w = Window.partitionBy("query_id", "movie", "clip_id").orderBy("rank")
        single = single.withColumn("n", F.row_number().over(w)).where("n = 1")
    w = Window.partitionBy("query_id").orderBy("rank")
    return single.select("movie", "clip_id", F.col("score").alias("rrf_score"), F.array("field_type").alias("matched_fields"), F.row_number().over(w).alias("retrieval_rank"))
