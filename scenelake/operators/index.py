"""Index documents, postings and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.functions import text as X

SCENE_INDICES = ("scene", "dialogue", "character", "full")
INDICES = (*SCENE_INDICES, "plot")
BUCKETS = 16  # folders of terms in a stored index, of which a query reads those of its terms; Parquet statistics and splits narrow it further within a folder


def scene_documents(scenes: DataFrame) -> DataFrame:
    """(index, doc_key, movie_id, heading, text): each scene in its four indices, blank texts left out; repeated scenes count once."""
    latest = scenes.groupBy("scene_id").agg(F.max_by(F.struct("movie_id", "heading", "action_lines", "dialogue"), F.coalesce("ingested_at", F.lit("1970-01-01").cast("timestamp"))).alias("s")).select("scene_id", "s.*")
    built = {"scene": X.scene_text(), "dialogue": X.dialogue_text(), "character": X.character_text(), "full": X.full_text()}
    docs = F.array(*(F.struct(F.lit(k).alias("index"), v.alias("text")) for k, v in built.items()))
    return latest.select(F.col("scene_id").alias("doc_key"), "movie_id", "heading", F.explode(docs).alias("d")).select("d.index", "doc_key", "movie_id", "heading", "d.text").where(F.trim("text") != "")


def latest_metadata(metadata: DataFrame) -> DataFrame:
    """One row for each tmdb_id, the one fetched last; ties go to the greater title."""
    rest = [c for c in metadata.columns if c != "tmdb_id"]
    order = F.struct(F.coalesce("fetched_at", F.lit("1970-01-01").cast("timestamp")), F.coalesce("title", F.lit("")))
    return metadata.where("tmdb_id is not null").groupBy("tmdb_id").agg(F.max_by(F.struct(*rest), order).alias("m")).select("tmdb_id", "m.*")


def plot_documents(metadata: DataFrame) -> DataFrame:
    """(index, doc_key, movie_id, heading, text): the plot of each movie, its overview where there is none; blank ones left out."""
    text = F.trim(F.coalesce(F.nullif("wiki_plot", F.lit("")), "overview"))
    return latest_metadata(metadata).select(F.lit("plot").alias("index"), F.col("tmdb_id").alias("doc_key"), F.col("tmdb_id").alias("movie_id"), F.col("title").alias("heading"), text.alias("text")).where("text <> ''")


def index_documents(scenes: DataFrame, metadata: DataFrame) -> DataFrame:
    """The documents of all five indices in one long table; partition by index when written."""
    return scene_documents(scenes).unionByName(plot_documents(metadata))


def tokenised(docs: DataFrame, key: list[str], text: str = "text", unicode: bool = False) -> DataFrame:
    return docs.select(*key, (X.tokens_unicode(text) if unicode else X.tokens_ascii(text)).alias("tokens"))


def postings(docs: DataFrame, key: list[str], text: str = "text", unicode: bool = False) -> DataFrame:
    """(key..., term, tf, dl): term counts of each document and its length."""
    t = tokenised(docs, key, text, unicode)
    return t.select(*key, F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def document_frequencies(docs: DataFrame, key: list[str], group: list[str], text: str = "text", unicode: bool = False) -> DataFrame:
    """(group..., term, df), counted before the shuffle within each task."""
    t = tokenised(docs, key, text, unicode)
    return t.select(*group, F.explode(F.array_distinct("tokens")).alias("term")).groupBy(*group, "term").agg(F.count("*").alias("df"))


def statistics(tokenised: DataFrame) -> DataFrame:
    """(term, df, dl): document frequency of each term, and in the row with term '' the number of documents and the sum of their lengths.

    One pass over (doc_key, tokens) gives both, counted within each task before the shuffle.
    """
    rows = tokenised.select(F.size("tokens").alias("dl"), F.explode(F.concat(F.array(F.lit("")), F.array_distinct("tokens"))).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term") == "", F.col("dl"))).alias("dl"))


def lengths(docs: DataFrame, key: list[str], group: list[str], text: str = "text", unicode: bool = False) -> DataFrame:
    """(group..., n_docs, avg_dl)."""
    t = tokenised(docs, key, text, unicode).select(*group, F.size("tokens").alias("dl"))
    return t.groupBy(*group).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))


def bucket(term="term"):
    """The folder of a stored index in which a term's postings lie."""
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def write_sparse(docs: DataFrame, path: str, mode: str = "overwrite", unicode: bool = False) -> None:
    """Store the sparse index of (index, doc_key, text): postings and document frequencies by index and bucket of terms, lengths, and the sizes of each index.

    Appending adds the postings and lengths of the new documents; frequencies and
    sizes are then counted anew from what is stored, without the texts. Null texts
    are empty documents. A bucket with a very frequent term is split over files.
    """
    spark = docs.sparkSession
    rows = docs.select("index", "doc_key", F.coalesce("text", F.lit("")).alias("text"))
    words = tokenised(rows, ["index", "doc_key"], "text", unicode)
    words.select("index", "doc_key", F.size("tokens").alias("dl")).write.mode(mode).parquet(f"{path}/lengths")
    # Texts, which are smaller than their postings, meet by document; the counting needs no further shuffle then.
    fresh = postings(rows.repartition("index", "doc_key"), ["index", "doc_key"], "text", unicode).withColumn("bucket", bucket())
    fresh.hint("rebalance", "index", "bucket").write.mode(mode).partitionBy("index", "bucket").parquet(f"{path}/postings")
    held = spark.read.parquet(f"{path}/postings")
    frequencies = held.groupBy("index", "bucket", "term").agg(F.count("*").alias("df"))
    frequencies.hint("rebalance", "index", "bucket").write.mode("overwrite").partitionBy("index", "bucket").parquet(f"{path}/terms")
    sizes = spark.read.parquet(f"{path}/lengths").groupBy("index").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))
    idf = F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    means = spark.read.parquet(f"{path}/terms").join(F.broadcast(sizes), "index").groupBy("index").agg(F.avg(idf).alias("mean_idf"))  # a row for each index
    sizes.join(means, "index", "left").coalesce(1).write.mode("overwrite").parquet(f"{path}/sizes")


class SparseIndex:
    """A stored sparse index: postings (index, bucket, term, doc_key, tf, dl), terms (index, bucket, term, df), sizes (index, n_docs, avg_dl, mean_idf)."""

    def __init__(self, spark: SparkSession, path: str, unicode: bool = False):
        self.unicode = unicode
        self.postings, self.terms, self.sizes = (spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "sizes"))


def hashed_vector(spark: SparkSession, text: str, width: int = 384) -> list[float]:
    """The vector of one text as hashed_vectors() makes it; zeros for a text without words."""
    row = hashed_vectors(spark.createDataFrame([(0, text)], "doc_key int, text string"), ["doc_key"], width=width).first()
    return list(row["vec"]) if row else [0.0] * width


def hashed_vectors(docs: DataFrame, key: list[str], text: str = "text", width: int = 384) -> DataFrame:
    """(key..., vec): tokens hashed to `width` places with sign, length 1. Stands in where no embedding model is given."""
    # Texts meet by key before their words part, so both counts below need no further shuffle.
    words = tokenised(docs.select(*key, text).repartition(*key), key, text).select(*key, F.explode_outer("tokens").alias("term")).where("term is not null")
    place = F.pmod(F.xxhash64("term"), F.lit(width)).cast("int")
    sign = F.when(F.pmod(F.xxhash64("term", F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    cells = words.select(*key, place.alias("place"), sign.alias("x")).groupBy(*key, "place").agg(F.sum("x").alias("x"))
    rows = cells.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("cells"))
    # Each cell with the zeros up to the next one: a pass over the cells instead of a search among them for every place.
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    ends = F.concat(F.expr("slice(cells.place, 2, size(cells))"), F.array(F.lit(width)))
    filled = F.flatten(F.zip_with("cells", ends, lambda c, end: F.concat(F.array(c["x"]), zeros(end - c["place"] - 1))))
    raw = rows.select(*key, F.concat(zeros(F.col("cells")[0]["place"]), filled).alias("raw"))
    return raw.select(*key, unit("raw").alias("vec"))


def unit(vector) -> "F.Column":
    """A vector brought to length 1; the zero vector stays. The length is bound to a name: written within the lambda it would be worked out for every element."""
    v = F.col(vector) if isinstance(vector, str) else vector
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.transform(F.array(length), lambda norm: F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0))))[0]


def dot(a, b):
    """Inner product of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
