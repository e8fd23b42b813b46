"""Sessions, and cutting lineage in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", *, partitions: int = 8, **options: str) -> SparkSession:
    """A session with UTC times and adaptive execution, for local work."""
    builder = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", partitions)
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", **options}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one is made only where it is unset and all runs on one machine."""
    given = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_lexforge_folder", None)
    if not given:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        given = spark._lexforge_folder = tempfile.mkdtemp(prefix="lexforge-")
    return given.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder, which is deleted when the session's driver ends."""
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def cut_lineage(rows: DataFrame) -> DataFrame:
    """rows from a reliable checkpoint in the shared folder."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint()


def unused(rows: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with underscores before it until no column of rows has it."""
    taken, out = {c.lower() for c in rows.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
