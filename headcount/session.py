"""Session set-up for local runs, and the shared folder a cluster names."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", app: str = "headcount") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("HEADCOUNT_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not named and context.getCheckpointDir():
        named = context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="headcount-")
    return named


# Paths handed out to each application, for `release`.
_HANDED_OUT: dict[str, list[str]] = {}


def shared_path(spark: SparkSession, stem: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"
    _HANDED_OUT.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> None:
    """Remove every intermediate table of this application.

    For the end of a view, when its results are written: frames that read from the
    removed tables can no longer be computed.
    """
    for path in _HANDED_OUT.pop(spark.sparkContext.applicationId, []):
        remove(spark, path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` below the shared folder and read it back from there.

    For tables that later steps read many times: a lost executor costs none of
    the work before, and readers load only the columns they need.
    """
    path = shared_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class Scratch:
    """Tables below one folder of the shared folder, each dropped once superseded."""

    def __init__(self, spark: SparkSession, stem: str):
        self.spark = spark
        self.root = shared_path(spark, stem)
        self._made = 0

    def keep(self, df: DataFrame) -> tuple[DataFrame, str]:
        """Write `df` and read it back; the path is for `drop`."""
        self._made += 1
        path = f"{self.root}/{self._made:04d}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, path: str | None) -> None:
        """Remove a table that nothing reads any more."""
        if path:
            remove(self.spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
