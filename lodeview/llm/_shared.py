"""Lineage cuts in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a private one only where none is set."""
    found = spark.sparkContext.getConf().get(_SETTING) or spark.conf.get(_SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodeview-")
        spark.conf.set(_SETTING, found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, removed when the driver ends."""
    path = f"{shared_dir(spark)}/lodeview/{uuid.uuid4().hex}-{name}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM is gone at exit: the folder's owner cleans up
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage without depending on any single executor: the committed files
    are read again after a loss, and the plan above sees true sizes, so that
    Spark chooses broadcasts by a measured figure.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def release(stored: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once all that came from it is written itself."""
    _remove(stored.sparkSession, stored._stored_at)


def unused(df: DataFrame, *stems: str) -> list[str]:
    """A column name for each stem that ``df`` doesn't have in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
