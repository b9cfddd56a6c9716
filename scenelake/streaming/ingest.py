"""Incremental builds: what is new, appended once, statistics made afresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def new_rows(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of the source whose key is not among those done."""
    return source.join(done.select(key).distinct(), key, "left_anti")


def append_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """Index documents with the new ones; a document that is there already is not added again."""
    return old.unionByName(new.join(old.select("index", "doc_key"), ["index", "doc_key"], "left_anti"))


def run_available(spark: SparkSession, folder: str, schema: str, checkpoint: str, sink: Callable[[DataFrame, int], None], format: str = "parquet") -> int:
    """Feed all files that no earlier run has seen to the sink, and stop; the number of rows fed.

    Which files were seen is kept under `checkpoint`, in the shared storage, so a
    run that was lost is taken up where it stood. The sink gets each batch with its number and should overwrite by it.
    """
    fed = 0

    def batch(df: DataFrame, number: int) -> None:
        nonlocal fed
        df = df.persist()
        fed += df.count()
        sink(df, number)
        df.unpersist()

    query = spark.readStream.schema(schema).format(format).load(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return fed


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch into its own partition, so a repeated batch replaces itself."""

    def write(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
