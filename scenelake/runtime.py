"""Session, shared storage and bounded transfers between driver and executors."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "scenelake", cores: str = "*", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow transfers; settings given by name win."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if "SPARK_MASTER" not in os.environ and "spark.master" not in conf:
        defaults["spark.master"] = f"local[{cores}]"
    return builder.config(map=defaults | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, one of our own on a local master (tests), an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not at:
        at = sc.getCheckpointDir()
        if not at and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not at:
            folder = tempfile.mkdtemp(prefix="scenelake-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            at = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", at)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Lineage ends here: the rows are written to the shared folder and survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def publish(spark: SparkSession, payload: bytes, stem: str) -> str:
    """Write bytes into the shared folder and hand the file to every executor; SparkFiles.get(name) opens it."""
    name = f"{stem}-{uuid.uuid4().hex}.bin"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/files/{name}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(path)
    try:
        out.write(bytearray(payload))
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString())
    return name


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package where they cannot import it already; once for an application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = __name__.partition(".")[0]

    def importable(_, package=package):
        import importlib.util

        return importlib.util.find_spec(package) is not None

    if not sc.parallelize([0], 1).map(importable).first():
        root = Path(__file__).resolve().parent
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as archive:
            for source in sorted(root.rglob("*.py")):
                archive.write(source, f"{package}/{source.relative_to(root)}")
        jvm = sc._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/files/{package}-{uuid.uuid4().hex}.zip")
        out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
        try:
            out.write(bytearray(held.getvalue()))
        finally:
            out.close()
        sc.addPyFile(path.toString())
    _shipped.add(sc.applicationId)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a scan has fewer partitions than there are cores; anything larger is left as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if 0 < parts < cores // 2 else df


class TooLarge(ValueError):
    """A side that was to be sent to every executor is over its stated bound."""


def bounded_rows(df: DataFrame, most: int) -> list:
    """All rows of a table that must be small; TooLarge beyond the bound, never a part of it."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise TooLarge(f"more than {most} rows")
    return rows


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def env_bool(name: str, default: bool) -> bool:
    """A switch from the environment: 1, true, yes and on in any case are true, anything else that is set is false."""
    value = os.environ.get(name)
    return default if value is None else value.strip().lower() in ("1", "true", "yes", "on")


def env_int(name: str, default: int) -> int:
    """A number from the environment; ValueError if it is none."""
    value = os.environ.get(name)
    return default if value is None else int(value)
