"""File listings as a data source: a row per file below some roots, with its stat and, if asked, its bytes.

Spark's own binary source tells neither inode nor time of birth and leaves out
names with a leading underscore, so listing is done here. The driver plans one
partition for each folder right below a root, and one for the root's own files;
tasks walk them. Unreadable folders and files are passed over.
"""

from __future__ import annotations

import os
import re
import stat
from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodeview.plans.globs import DEFAULT_EXCLUDES, REPO_EXCLUDES, to_regex

SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("path", T.StringType()), ("name", T.StringType()), ("source_root", T.StringType()), ("size_bytes", T.LongType()), ("created_ms", T.LongType()), ("modified_ms", T.LongType()),
        ("accessed_ms", T.LongType()), ("inode", T.LongType()), ("device", T.LongType()), ("content", T.BinaryType()),
    )]
)


class Folder(InputPartition):
    """A folder to walk, or only the files in it."""

    def __init__(self, root: str, path: str, deep: bool):
        self.root, self.path, self.deep = root, path, deep


class FileListing(DataSource):
    """``spark.read.format("files")``: options roots, excludes, match (each split by newlines), dotfiles, read_bytes."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> FileReader:
        return FileReader(schema, self.options)


def _lines(options: dict, name: str) -> list[str]:
    return [x for x in options.get(name, "").split("\n") if x]


class FileReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.columns = [f.name for f in schema.fields]
        self.roots = list(dict.fromkeys(os.path.abspath(r.strip()) for r in _lines(options, "roots") if r.strip()))
        self.out = re.compile("|".join(map(to_regex, _lines(options, "excludes"))) or r"(?!)")
        self.match = re.compile("|".join(map(to_regex, _lines(options, "match"))) or "")
        self.dotfiles = options.get("dotfiles", "false") == "true"
        self.read_bytes = int(options.get("read_bytes", 0))
        self.parts = int(options.get("parts", 64))

    def _left_out(self, path: str, name: str, folder: bool) -> bool:
        return (name.startswith(".") and not self.dotfiles) or bool(self.out.match(path + "/x" if folder else path))

    def _entries(self, path: str) -> list[os.DirEntry]:
        try:
            with os.scandir(path) as found:
                return sorted(found, key=lambda e: e.name)
        except OSError:
            return []

    def partitions(self) -> Sequence[InputPartition]:
        """Folders to walk: a large tree is opened level by level until there are ``parts`` of them or no deeper ones."""
        flat: list[InputPartition] = []
        deep = deque((root, root) for root in self.roots if os.path.isdir(root))
        while deep and len(flat) + len(deep) < self.parts:
            root, path = deep.popleft()
            flat.append(Folder(root, path, False))
            deep += [(root, e.path) for e in self._entries(path) if e.is_dir(follow_symlinks=False) and not self._left_out(e.path, e.name, True)]
        return [*flat, *(Folder(root, path, True) for root, path in deep)] or [Folder("", "", False)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        stack = [partition.path] if partition.path else []
        while stack:
            for e in self._entries(stack.pop()):
                try:
                    if e.is_dir(follow_symlinks=False):
                        if partition.deep and not self._left_out(e.path, e.name, True):
                            stack.append(e.path)
                    elif e.is_file(follow_symlinks=False) and not self._left_out(e.path, e.name, False) and self.match.match(e.path):
                        yield self._row(partition.root, e)
                except OSError:
                    continue

    def _row(self, root: str, e: os.DirEntry) -> tuple:
        s = e.stat(follow_symlinks=False)
        ms = lambda ns: ns // 1_000_000
        content = None
        if self.read_bytes and "content" in self.columns:
            with open(e.path, "rb") as f:
                content = f.read(self.read_bytes)
        row = {
            "path": e.path, "name": e.name, "source_root": root, "size_bytes": s.st_size, "created_ms": ms(getattr(s, "st_birthtime_ns", s.st_ctime_ns)), "modified_ms": ms(s.st_mtime_ns),
            "accessed_ms": ms(s.st_atime_ns), "inode": s.st_ino, "device": s.st_dev, "content": content,
        }
        return tuple(row[c] for c in self.columns)


def listing(spark: SparkSession, roots: Sequence[str], *, excludes: Sequence[str] = tuple(DEFAULT_EXCLUDES), match: Sequence[str] = (), dotfiles: bool = False, read_bytes: int = 0, parts: int = 64) -> DataFrame:
    """Files below ``roots``; with ``read_bytes`` their first bytes as well."""
    spark.dataSource.register(FileListing)
    options = {"roots": "\n".join(roots), "excludes": "\n".join(excludes), "match": "\n".join(match), "dotfiles": str(dotfiles).lower(), "read_bytes": str(read_bytes), "parts": str(parts)}
    return spark.read.format("files").options(**options).load()


def git_configs(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """The .git/config files of repositories below ``roots``."""
    return listing(spark, roots, excludes=REPO_EXCLUDES, match=["**/.git/config"], dotfiles=True)


def stats(paths: DataFrame) -> DataFrame:
    """(path, source_root) of those that are files now, with the other columns of a listing."""
    columns = ["path", "name", "source_root", "size_bytes", "created_ms", "modified_ms", "accessed_ms", "inode", "device"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, root in zip(b["path"], b["source_root"], strict=True):
                try:
                    s = os.stat(path, follow_symlinks=False)
                except OSError:
                    continue
                if stat.S_ISREG(s.st_mode):
                    ms = [ns // 1_000_000 for ns in (getattr(s, "st_birthtime_ns", s.st_ctime_ns), s.st_mtime_ns, s.st_atime_ns)]
                    out.append((path, os.path.basename(path), root, s.st_size, *ms, s.st_ino, s.st_dev))
            yield pd.DataFrame(out, columns=columns)

    kinds = ["string"] * 3 + ["long"] * 6
    return paths.select("path", "source_root").mapInPandas(run, ", ".join(f"{c} {k}" for c, k in zip(columns, kinds, strict=True)))
