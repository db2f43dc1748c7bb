"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one of our own only where that is unset and everything runs on this machine."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "/tmp/checkpoints/codexa"


def stage(df: DataFrame, what: str = "stage", by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors, has a known size. The table goes when the session's JVM ends, or by drop().
    by: a column of few values, each of which gets files of its own, so that a condition on it reads only those."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    _staged[id(out)] = (weakref.ref(out), fs, at)
    return out


_staged: dict[int, tuple] = {}


def handed(held: DataFrame, out: DataFrame) -> DataFrame:
    """out, which reads the staged table of held and is now the one to give to drop()."""
    if id(held) in _staged:
        _, fs, at = _staged.pop(id(held))
        _staged[id(out)] = (weakref.ref(out), fs, at)
    return out


def drop(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more; frames that were not staged are left alone."""
    for df in frames:
        ref, fs, at = _staged.pop(id(df), (None, None, None))
        if ref is not None and ref() is df:
            fs.delete(at, True)
            fs.cancelDeleteOnExit(at)
