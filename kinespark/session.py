"""Session construction and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "kinespark", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution and UTC time; extra settings by keyword
    (dots written as double underscores)."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


#: Parts that a shuffle begins with, see :func:`small_parts`. Up to 200 (Spark's
#: spark.shuffle.sort.bypassMergeThreshold) rows go to their files without being sorted in memory.
PARTS = 200


def small_parts(spark: SparkSession) -> None:
    """Let shuffles begin with PARTS parts. Adaptive execution joins small ones up to its advisory
    size, so a task's share of a larger input stays at that size until all parts are larger. A
    number that the session names already is left alone."""
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, max(PARTS, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only when the session names none and runs on one machine (tests) is a
    temporary folder made and recorded in the session; a cluster without a shared
    folder is an error, as executors would read each other's files short."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="kinespark-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df, label: str):
    """Write a frame as parquet in the shared folder and read it back: cuts the
    lineage before a result that is used more than once, and survives the loss
    of executors. The shuffle files of the write go with its end: what is read
    afterwards is the table."""
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = scratch_path(spark, label), spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return spark.read.parquet(path)


def discard(*frames) -> None:
    """Remove the folders of materialised frames that nothing reads any more. Folders
    outside the shared folder are left alone."""
    for df in frames:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path
        home = jpath(shared_dir(spark)).toUri().getPath()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jpath(folder)
            if path.toUri().getPath().startswith(home + "/"):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
