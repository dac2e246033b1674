"""Session and shared-storage helpers used by every job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "quakespark", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings that the library relies on: UTC, adaptive execution, no console progress."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only in local mode a temporary folder may take its place; on a cluster executors would not see it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    held = getattr(spark.sparkContext, "_quakespark_shared", None)
    if held is None:
        held = "file://" + tempfile.mkdtemp(prefix="quakespark-")
        spark.sparkContext._quakespark_shared = held
    return held


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held.written_to = path
    return held


def discard(*frames: DataFrame) -> None:
    """Deletes what ``materialise`` wrote for these frames, once nothing reads them any more."""
    for df in frames:
        path = getattr(df, "written_to", None)
        if path:
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def free_name(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores before it until no column of the frames has it, in any case of letters."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
