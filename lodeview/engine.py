"""The engine's Python surface: scan, find, get, recent, and live updates."""

from __future__ import annotations

import json
import os
import re
import shutil
from collections.abc import Sequence
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeview.functions import text as X
from lodeview.operators import external, extract, index, search
from lodeview.plans import globs
from lodeview.sources.files import listing, stats
from lodeview.sources.repos import repositories
from lodeview.sources.tables import Tables, private_folder
from lodeview.streaming import live

HOME_ROOTS = ["projects", "code", "src", "workspace", "work", "Downloads", "Desktop", "Pictures"]


def load_config(path: str) -> dict:
    """{roots, ocrMode, excludeGlobs} from JSON; empty where it's missing or isn't valid."""
    try:
        held = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return {}
    return held if isinstance(held, dict) else {}


def resolve_roots(flag: Sequence[str] = (), config: Sequence[str] = ()) -> list[str]:
    """Roots given, else configured, else the usual folders that exist."""
    found = list(flag) or list(config) or [str(p) for d in HOME_ROOTS if (p := Path.home() / d).exists()]
    return list(dict.fromkeys(r.strip() for r in found if r.strip()))


def doctor(index: str | None = None, roots: Sequence[str] = ()) -> dict:
    """Which programs that extraction can use are there, where the index is, and which roots can be read."""
    return {
        "programs": {p: shutil.which(p) is not None for p in ("git", "pdftotext", "mutool", "exiftool", "tesseract")},
        "index": index, "roots": {r: os.access(r, os.R_OK) for r in resolve_roots(roots)},
    }


class Engine:
    """An index in a folder, and what can be asked of it. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.tables = spark, Tables(spark, folder)

    def _held(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows stored as they are now, so that all that follows sees one state."""
        path = private_folder(self.spark, name)
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def scan(self, roots: Sequence[str], *, excludes: Sequence[str] = (), ocr: str = "off") -> dict[str, int]:
        """Index what is new or changed below ``roots``; returns the counts. Nothing is deleted by a scan."""
        t = self.tables
        files, repos, blobs, words = (t.read(name) for name in ("file_records", "repo_records", "text_blobs", "postings"))
        p = F.col("path")
        found = listing(self.spark, roots, excludes=globs.union(globs.DEFAULT_EXCLUDES, excludes)).drop("content")
        found = self._held(self._stamped(found), "listing")
        rows = index.split_by_reuse(found, files).withColumn("kind", extract.kind(p)).withColumn("extractor_type", extract.extractor_type(F.col("kind")))
        due = rows.filter("extractor_type IS NOT NULL").select(F.col("id").alias("source_id"), F.lit("file").alias("source_type"), "extractor_type", "path", "reused")
        lacking = index.missing_blobs(due, blobs).select("path")
        texts = self._held(extract.extract_files(due.filter("NOT reused").select("path").union(lacking).distinct()), "texts")
        images = rows.filter(extract.is_image(p) & ~F.col("reused")).withColumn("wants_ocr", extract.wants_ocr(p, F.col("size_bytes"), ocr))
        seen = self._held(external.read_images(images), "images")
        merged = index.upsert_blobs(blobs, self._numbered(self._file_texts(texts).unionByName(self._image_texts(seen))))
        below = repositories(self.spark, roots)
        below = self._held(below, "repositories")
        merged = index.upsert_blobs(merged, self._numbered(below.select(F.col("id").alias("source_id"), F.lit("repo").alias("source_type"), F.lit("repo_summary").alias("extractor_type"), F.col("summary").alias("content"))))
        counts = index.scan_summary(rows.select("reused", F.lit(False).alias("text"), extract.is_image(p).alias("image"), F.lit(False).alias("ocr"))).first().asDict()
        counts |= {"text_extractions": texts.count(), "ocr_extractions": seen.filter("ocr IS NOT NULL").count()}
        self._write(blobs, merged, words, repo_records=index.upsert_repos(repos, below.drop("summary")), file_records=index.upsert_files(files, self._records(rows.filter("NOT reused"))))
        return counts

    def _write(self, before: DataFrame, after: DataFrame, words: DataFrame, **tables: DataFrame) -> None:
        """New versions of the tables; texts in order of insertion, and the words of those that changed."""
        held = self._held(after, "blobs")
        self.tables.write_all({"text_blobs": held.repartitionByRange("seq").sortWithinPartitions("seq"), "postings": index.updated_postings(words, before, held)} | tables)

    @staticmethod
    def _stamped(found: DataFrame) -> DataFrame:
        p = F.col("path")
        return found.withColumn("fingerprint", X.fingerprint(p, F.col("size_bytes"), F.col("modified_ms"))).withColumn("id", X.stable_id(p))

    @staticmethod
    def _records(rows: DataFrame) -> DataFrame:
        """Rows of a listing as records."""
        p = F.col("path")
        is_image, shot = extract.is_image(p), extract.is_screenshot(p)
        meta = F.to_json(
            F.struct(
                F.col("fingerprint").alias("scanFingerprint"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("lastIndexedAt"), is_image.alias("isImage"),
                F.when(is_image, "image").alias("fileCategory"), F.when(is_image, shot).alias("isScreenshot"),
            )
        )
        mime = F.lit(None).cast("string")
        for ext, m in extract.MIMES.items():
            mime = F.when(X.extension(p) == ext, m).otherwise(mime)
        return rows.select(
            "id", "path", "name", F.nullif(F.regexp_extract("name", r"^.+\.([^.]*)$", 1), F.lit("")).alias("extension"), mime.alias("mime_type"), "size_bytes", X.iso_millis(F.col("created_ms")).alias("created_at"),
            X.iso_millis(F.col("modified_ms")).alias("modified_at"), X.iso_millis(F.col("accessed_ms")).alias("accessed_at"), "source_root", meta.alias("metadata_json"), "inode", "device",
        )

    @staticmethod
    def _file_texts(texts: DataFrame) -> DataFrame:
        return texts.filter("success").select(X.stable_id(F.col("path")).alias("source_id"), F.lit("file").alias("source_type"), "extractor_type", "content")

    @staticmethod
    def _image_texts(seen: DataFrame) -> DataFrame:
        """What is known of an image, and the text in it, each as a text of its own."""
        p, shot = F.col("path"), extract.is_screenshot(F.col("path"))
        summary = extract.image_summary(X.basename(p), F.when(shot, "screenshot").otherwise("image"), F.col("captured"), F.col("created"), F.col("camera"), F.col("dimensions"), F.col("location"), F.col("gps"))
        kind = lambda of: F.concat(F.when(shot, "screenshot_").otherwise("image_"), F.lit(of))
        each = F.explode(F.array(F.struct(kind("metadata").alias("extractor_type"), summary.alias("content")), F.struct(kind("ocr").alias("extractor_type"), F.col("ocr").alias("content"))))
        return seen.select(X.stable_id(p).alias("source_id"), F.lit("file").alias("source_type"), each.alias("x")).select("source_id", "source_type", "x.*").filter("content IS NOT NULL")

    @staticmethod
    def _numbered(rows: DataFrame) -> DataFrame:
        """With a time and an increasing place of insertion."""
        return rows.withColumn("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).withColumn("seq", F.monotonically_increasing_id())

    def apply(self, jobs: DataFrame, roots: Sequence[str]) -> None:
        """Bring the index up to date with a batch of jobs (path, job, last_ms).

        What a path holds now counts: upserts of paths that are gone are left out, as are deletes of paths that are
        back. A new path with the inode and device of a record whose own path is gone is that file, renamed: its record
        and texts move without being read again. Other files are read.
        """
        t = self.tables
        files, blobs, words = (t.read(name) for name in ("file_records", "text_blobs", "postings"))
        jobs = self._held(index.latest_by(jobs.select("path", "job", "last_ms"), "path", "last_ms"), "jobs")
        if jobs.isEmpty():
            return
        root = reduce(lambda w, r: F.when(F.startswith("path", F.lit(r.rstrip("/") + "/")), r).otherwise(w), sorted(map(os.path.abspath, roots), key=len), F.lit(roots[0] if roots else None))
        known = files.select(F.col("path").alias("old_path"), F.col("inode").alias("i"), F.col("device").alias("d"))
        now = self._held(self._stamped(stats(jobs.withColumn("source_root", root))), "present")
        match = now.filter("inode IS NOT NULL").join(known, (F.col("inode") == F.col("i")) & (F.col("device") == F.col("d")) & (F.col("path") != F.col("old_path")))
        match = match.join(files.select(F.col("path").alias("k")), F.col("path") == F.col("k"), "left_anti").select("old_path", F.col("path").alias("new_path"))
        there = stats(match.select(F.col("old_path").alias("path"), F.lit(None).cast("string").alias("source_root"))).select("path")
        moves = self._held(match.join(there, F.col("old_path") == F.col("path"), "left_anti").groupBy("old_path").agg(F.min("new_path").alias("new_path")), "moves")
        files, moved = index.apply_renames(files, blobs, moves)
        due = now.join(jobs.filter("job = 'upsert'").select("path"), "path", "left_semi").join(moves.select(F.col("new_path").alias("path")), "path", "left_anti")
        texts = self._held(extract.extract_files(due.select("path")), "texts")
        seen = self._held(external.read_images(due.filter(extract.is_image(F.col("path"))).withColumn("wants_ocr", F.lit(False))), "images")
        said = self._numbered(self._file_texts(texts).unionByName(self._image_texts(seen)))
        gone = jobs.filter("job = 'delete'").join(now.select("path"), "path", "left_anti")
        jobs = gone.unionByName(jobs.filter("job = 'upsert'").join(due.select("path"), "path", "left_semi"))
        files, after = live.apply_jobs(jobs, files, moved, self._records(due), said)
        self._write(blobs, after, words, file_records=files)

    def watch(self, events: DataFrame, roots: Sequence[str], checkpoint: str, every: str = "1 second") -> StreamingQuery:
        """Keep the index fresh from a stream of events (``live.event_files`` reads what ``sources.watcher`` writes)."""
        return live.run(events, lambda jobs, _: self.apply(jobs, roots), checkpoint, every)

    def find(self, question: str, *, kinds: Sequence[str] = (), path_prefix: str | None = None, since: str | None = None, limit: int = search.RESULTS) -> DataFrame:
        files, repos, blobs, words = (self.tables.read(name) for name in ("file_records", "repo_records", "text_blobs", "postings"))
        return search.find(files, repos, blobs, question, postings=words, kinds=kinds, path_prefix=path_prefix, since=since, limit=limit)

    def get(self, id_: str) -> DataFrame:
        t = self.tables
        return search.get_record(t.read("file_records"), t.read("repo_records"), t.read("text_blobs"), id_)

    def recent(self, since: str | None = None, limit: int = 20) -> DataFrame:
        if since is not None and not re.match(r"\d{4}-\d\d-\d\d", since):
            raise ValueError("since must be an ISO time")
        if not 1 <= limit <= 100:
            raise ValueError("limit must be from 1 to 100")
        return search.recent(self.tables.read("file_records"), since, limit)


def cards(results: DataFrame) -> str:
    """At most ten results as numbered cards."""
    rows = results.collect()  # ten rows at most
    if not rows:
        return "No matches found."
    out = []
    for i, r in enumerate(rows, 1):
        lines = [f"{i}. {r['title']}", f"   type: {r['result_type']}", f"   path: {r['path']}", f"   why: {r['why_matched']}"]
        if r["last_modified"]:
            lines.append(f"   modified: {r['last_modified']}")
        out.append("\n".join(lines))
    return "\n\n".join(out)


def file_link(path: str) -> str:
    return "file://" + os.path.abspath(path)
