"""Versioned Parquet tables: a new version is written beside the old one, then a numbered pointer appears.

A reader takes the pointer with the largest number and holds the version it began
with, so a merge never overwrites what it reads, and there is no moment without a
version: pointers are renamed into place when all files are there, and older ones
stay. Paths go through Hadoop's file system, and so may be of any store.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FILES = T.StructType([T.StructField(n, T.LongType() if n in ("size_bytes", "inode", "device") else T.StringType()) for n in "id path name extension mime_type size_bytes created_at modified_at accessed_at source_root metadata_json inode device".split()])
REPOS = T.StructType([T.StructField(n, T.StringType()) for n in "id root_path repo_name remote_url current_branch last_commit_at metadata_json".split()])
BLOBS = T.StructType([T.StructField(n, T.LongType() if n == "seq" else T.StringType()) for n in "id source_id source_type extractor_type content created_at seq".split()])
POSTINGS = T.StructType(
    [T.StructField("token", T.StringType()), T.StructField("seq", T.LongType())] + [T.StructField(n, T.StringType()) for n in ("source_type", "extractor_type")] + [T.StructField("places", T.ArrayType(T.IntegerType()))]
)
SCHEMAS = {"file_records": FILES, "repo_records": REPOS, "text_blobs": BLOBS, "postings": POSTINGS}
#: Pointers that are kept; what only older ones name is of no reader any more.
HELD = 8


def private_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors reach, removed when the driver ends: in ``spark.checkpoint.dir``, or on one machine a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodeview-")
    path = f"{found.rstrip('/')}/lodeview/{uuid.uuid4().hex}-{name}"

    def remove() -> None:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the JVM is gone at exit: the folder's owner cleans up
            pass

    atexit.register(remove)
    return path


class Tables:
    """The index's tables below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self, name: str) -> list[tuple[int, str]]:
        """(number, version) of each pointer; pointers are empty files with both in their names."""
        at = self._path(f"{self.folder}/{name}/pointers")
        if not self._fs.exists(at):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(at)]
        return sorted((int(n), v) for n, _, v in (x.partition("-") for x in names if x[:1].isdigit()))

    def version(self, name: str) -> str | None:
        """The current version, if there is one."""
        found = self._pointers(name)
        return found[-1][1] if found else None

    def read(self, name: str, version: str | None = None) -> DataFrame:
        """A version, by default the current one, with all columns of its schema; columns that an older version lacks are null."""
        version, schema = version or self.version(name), SCHEMAS[name]
        if version is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/{version}")

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        """A new version, current when all its files are there."""
        return self.write_all({name: rows})[name]

    def write_all(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """New versions of several tables, which become current one right after the other when all of them are written."""
        versions = {}
        for name, rows in tables.items():
            versions[name] = uuid.uuid4().hex
            rows.select(*[rows[f.name].cast(f.dataType) for f in SCHEMAS[name].fields]).write.parquet(f"{self.folder}/{name}/{versions[name]}")
        for name, version in versions.items():
            self._point(name, version)
        return {name: self.read(name, version) for name, version in versions.items()}

    def _point(self, name: str, version: str) -> None:
        held = self._pointers(name)
        number = held[-1][0] + 1 if held else 0
        at = self._path(f"{self.folder}/{name}/pointers/{number:010d}-{version}")
        if not self._fs.createNewFile(at):
            raise OSError(f"another writer has made version {number} of {name}")
        for _, old in held[:-HELD]:
            self._fs.delete(self._path(f"{self.folder}/{name}/{old}"), True)
        for n, old in held[:-HELD]:
            self._fs.delete(self._path(f"{self.folder}/{name}/pointers/{n:010d}-{old}"), False)
