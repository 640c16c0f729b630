"""WARC archives as a PySpark data source, written and read.

Reading: the driver plans a partition for each range of records that the
manifest lists, or for each ``.warc`` or ``.warc.gz`` file where there is none,
as in archives of other writers. A task seeks to its range, reads record headers
first (names in any case), and decides on the headers alone, so a record that
pushed-down predicates exclude costs a seek past its payload (or, in a compressed
archive, inflating without decoding). Ranges begin at records, so no payload is
searched for marks and compressed files split as well. Pushed down are predicates
on the record type and on header columns that ``read(..., where=)`` names, not
those of ``filter``: Spark 4.1 keeps the filters that one use of a DataFrame pushed
to a Python source for its later uses. The payload is decoded only if the
``payload`` option asks for it. The payload of an HTTP record is what follows the
HTTP headers.

Archives are compressed record by record unless ``compression`` is ``none``.

Writing: each task writes one file under a name of its own attempt; the driver
lists the files of committed tasks in the manifest, and readers use only these.
A lost executor's half-written file is never read. Records are WARC/1.1: with a
date, an id of their own, a profile on revisits, and HTTP headers in responses.

Payloads repeat: ``plan_revisits`` finds equal payloads by SHA-256, keeps the one
with the smallest id as the response, and makes the others revisits of it.

Paths are opened through ``pyarrow.fs`` by their URI, so any store it knows will
do as long as all executors reach it.

Defined cases: a null payload is empty; payloads under ``least`` bytes are always
responses; a null id is larger than any; of repeated rows with one id and one
payload one is the response and the rest revisit that id, and their record ids
differ; a null address is left out; an empty table gives an archive without
records; further columns are not read.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ._shared import fresh_path, materialize

#: The headers of a record and the columns that hold them.
HEADERS = {
    "WARC-Type": "record_type", "WARC-Record-ID": "record_id", "WARC-Date": "date", "WARC-Target-URI": "uri", "WARC-Payload-Digest": "payload_digest",
    "WARC-Refers-To": "refers_to", "WARC-Profile": "profile", "X-Payload-Bytes": "payload_bytes", "Content-Type": "content_type",
}
#: What marks a revisit of an equal payload, and a block that begins with HTTP headers.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http;msgtype=response"
#: The date of records whose time of capture isn't known.
UNDATED = "1970-01-01T00:00:00Z"
SCHEMA = T.StructType([T.StructField(c, T.LongType() if c == "payload_bytes" else T.StringType()) for c in HEADERS.values()] + [T.StructField("payload", T.BinaryType())])
MANIFEST = "_manifest.json"
RANGE_BYTES = 64 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+.-]+:/", path) else (pafs.LocalFileSystem(), path)


def _clean(value: str) -> str:
    """A header value in one line."""
    return re.sub(r"[\r\n]+", " ", value)


def record(headers: dict[str, str | None], payload: bytes) -> bytes:
    """The bytes of one record."""
    lines = [b"WARC/1.1"] + [f"{k}: {_clean(v)}".encode() for k, v in headers.items() if v is not None]
    if (headers.get("Content-Type") or "").startswith("application/http") and headers.get("WARC-Type") == "response":
        payload = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(payload), b"", payload, b"", b""])


class Range(InputPartition):
    """Some consecutive records of a file, from an offset where one begins; all that follow if ``records`` is None."""

    def __init__(self, path: str, start: int, records: int | None):
        self.path, self.start, self.records = path, start, records


@dataclass
class Written(WriterCommitMessage):
    """A file that a task has finished, and where its ranges begin: (offset, records)."""

    name: str
    ranges: list[tuple[int, int]]


class WarcSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(schema, self.options)


class WarcReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.columns = [f.name for f in schema.fields]
        self.path = options["path"]
        self.decode = options.get("payload", "true").lower() != "false"
        self.where = {c: set(v) for c, v in json.loads(options.get("where", "{}")).items()}
        if unknown := self.where.keys() - set(HEADERS.values()):
            raise ValueError(f"not header columns: {sorted(unknown)}")

    def partitions(self) -> Sequence[InputPartition]:
        fs, root = _open(self.path)
        if fs.get_file_info(root).type == pafs.FileType.File:
            return [Range(self.path, 0, None)]
        if fs.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.File:
            with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
                files = json.loads(f.read())
            found = [Range(f"{self.path}/{x['name']}", at, n) for x in files for at, n in x["ranges"]]
        else:
            listed = fs.get_file_info(pafs.FileSelector(root, recursive=True))
            found = [Range(self.path + x.path[len(root) :], 0, None) for x in listed if x.type == pafs.FileType.File and x.path.endswith((".warc", ".warc.gz"))]
        return found or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64() if c == "payload_bytes" else pa.binary() if c == "payload" else pa.string() for c in self.columns]
        rows: list[list] = []
        size = 0
        for row in self._records(partition):
            rows.append([row.get(c) for c in self.columns])
            size += 200 + len(row.get("payload") or b"")
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], self.columns)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], self.columns)

    def _records(self, part: Range) -> Iterator[dict]:
        if part.records == 0:
            return
        fs, path = _open(part.path)
        with fs.open_input_file(path) as raw:
            raw.seek(part.start)
            file = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(_Raw(raw), 1 << 18)
            left = part.records
            while left is None or left:
                head = self._head(file)
                if head is None:
                    if left is not None:
                        raise ValueError(f"{part.path} ends before its last record")
                    return
                left = left and left - 1
                length = int(head["content-length"])
                row = {c: head.get(h.lower()) for h, c in HEADERS.items()}
                row["payload_bytes"] = int(row["payload_bytes"] or length)
                wanted = all(row[c] in values for c, values in self.where.items())
                if wanted and self.decode and "payload" in self.columns:
                    block = file.read(length)
                    if (row["content_type"] or "").replace(" ", "").startswith("application/http"):
                        block = block.partition(b"\r\n\r\n")[2]
                    row["payload"] = block
                else:
                    file.seek(length, io.SEEK_CUR)
                if wanted:
                    yield row

    @staticmethod
    def _head(file) -> dict[str, str] | None:
        """The next record's headers by name in small letters; None at the end."""
        first = file.readline()
        while first in (b"\r\n", b"\n"):
            first = file.readline()
        if not first:
            return None
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record begins here: {first[:40]!r}")
        head: dict[str, str] = {}
        key = ""
        while line := file.readline().rstrip(b"\r\n"):
            text = line.decode("utf-8", "replace")
            if text[0] in " \t" and key:  # a folded line
                head[key] += " " + text.strip()
                continue
            key, _, value = text.partition(":")
            key = key.strip().lower()
            head[key] = value.strip()
        return head


class _Raw(io.RawIOBase):
    def __init__(self, raw):
        self.raw = raw

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        got = self.raw.read(len(b))
        b[: len(got)] = got
        return len(got)

    def seek(self, n: int, whence: int = 0) -> int:
        self.raw.seek(n, whence)
        return self.raw.tell()

    def tell(self) -> int:
        return self.raw.tell()


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, options: dict):
        self.columns = [f.name for f in schema.fields]
        self.path = options["path"]
        self.packed = options.get("compression", "gzip") == "gzip"
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        name = f"records-{uuid.uuid4().hex}.warc" + ".gz" * self.packed
        headers = {c: h for h, c in HEADERS.items() if c in self.columns}
        ranges: list[tuple[int, int]] = []
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in iterator:
                for begin in range(0, batch.num_rows, 256):
                    for row in batch.slice(begin, 256).to_pylist():
                        at = out.tell()
                        if not ranges or at - ranges[-1][0] >= self.range_bytes:
                            ranges.append((at, 0))
                        ranges[-1] = ranges[-1][0], ranges[-1][1] + 1
                        data = record({h: None if row[c] is None else str(row[c]) for c, h in headers.items()}, row.get("payload") or b"")
                        out.write(gzip.compress(data, 6) if self.packed else data)
        return Written(name, ranges)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        files = [{"name": m.name, "ranges": m.ranges} for m in messages if m is not None and m.ranges]
        with fs.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _open(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{root}/{m.name}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)


def _record_id(ord_: F.Column, digest: F.Column, row: F.Column) -> F.Column:
    """An id of the page's id, its payload, and the row's number where rows are repeated."""
    return F.concat(F.lit("<urn:lodeview:"), F.when(ord_ < _BIG, ord_.cast("string")).otherwise(""), F.lit(":"), F.substring(digest, 1, 16), F.coalesce(F.concat(F.lit(":"), row.cast("string")), F.lit("")), F.lit(">"))


_BIG = (1 << 63) - 1


def plan_revisits(pages: DataFrame, *, id_col: str = "page_id", payload_col: str = "html", uri_col: str = "url", least: int = 100, date: str = UNDATED) -> DataFrame:
    """One record per row: its headers, and its payload unless it revisits another's.

    The smallest id of each payload comes from a partial aggregation over digests; the join back is on digests,
    between plain exchanges, where Spark can split a frequent one. Small payloads have join keys of their own.
    Repeated rows are told apart by numbers in a stored table; without any, nothing is stored.
    """
    sized = pages.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_BIG)).alias("ord"), F.col(uri_col).cast("string").alias("uri"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.length("payload").cast("long"))
    counts = materialize(sized.groupBy("digest", "payload_bytes", "ord").agg(F.count(F.lit(1)).alias("n")), "payload-digests")
    if counts.filter("n > 1").isEmpty():
        rows = sized.withColumn("row", F.lit(None).cast("long"))
        lead = counts.select(F.col("digest").alias("k"), "payload_bytes", "ord", F.col("n").alias("of"), F.lit(None).cast("long").alias("row"))
    else:
        rows = materialize(sized.withColumn("row", F.monotonically_increasing_id()), "numbered-pages")
        lead = rows.select(F.col("digest").alias("k"), "payload_bytes", "ord", F.lit(1).cast("long").alias("of"), "row")
    lead = lead.filter(F.col("payload_bytes") >= least).groupBy("k").agg(F.min(F.struct("ord", "row")).alias("lead"), F.sum("of").alias("of"))
    lead = materialize(lead.filter("of > 1").select("k", "lead"), "payload-leads")
    own = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    joined = rows.withColumn("key", F.when(F.col("payload_bytes") >= least, F.col("digest")).otherwise(own)).join(lead, F.col("key") == F.col("k"), "left")
    revisit = F.col("lead").isNotNull() & (F.struct("ord", "row") != F.col("lead"))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), _record_id(F.col("ord"), F.col("digest"), F.col("row")).alias("record_id"), F.lit(date).alias("date"), F.col("uri"),
        F.concat(F.lit("sha256:"), F.col("digest")).alias("payload_digest"), F.when(revisit, _record_id(F.col("lead.ord"), F.col("digest"), F.col("lead.row"))).alias("refers_to"),
        F.when(revisit, F.lit(PROFILE)).alias("profile"), "payload_bytes", F.lit(HTTP).alias("content_type"), F.when(~revisit, F.col("payload")).alias("payload"),
    )


def read(spark: SparkSession, path: str, where: Mapping[str, str | Sequence[str]] | None = None, **options: str) -> DataFrame:
    """Records of an archive, with ``where`` only those whose header columns have one of the values given."""
    register(spark)
    wanted = {c: [v] if isinstance(v, str) else list(v) for c, v in (where or {}).items()}
    return spark.read.format("warc").options(where=json.dumps(wanted), **options).load(path)


def write(records: DataFrame, path: str, **options: str) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode("append").options(**options).save(path)


def report(pages: DataFrame, **options: str) -> DataFrame:
    """Write the pages' archive into the shared folder, read it back, and give one row per record.

    Sizes and digests of responses are those of the payloads as read back, which must agree with their headers;
    revisits have no payload, so of them only headers are read.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write(plan_revisits(pages), path, **options)
    number = lambda c: F.regexp_extract(c, r"<urn:lodeview:(-?\d*):", 1)
    as_id = lambda c: F.when(F.length(number(c)) > 0, number(c).cast("long"))
    told = F.substring_index("payload_digest", ":", -1)
    digest, size = F.sha2("payload", 256), F.length("payload").cast("long")
    wrong = F.raise_error(F.concat(F.lit("payload and headers differ: "), F.col("record_id")))
    responses = read(spark, path, {"record_type": "response"}).select(
        "record_id", F.when((size == F.col("payload_bytes")) & (digest == told), size).otherwise(wrong.cast("long")).alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to"
    )
    revisits = read(spark, path, {"record_type": "revisit"}, payload="false").select("record_id", "payload_bytes", told.alias("payload_digest"), "record_type", "refers_to")
    return responses.unionByName(revisits).select(as_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", as_id("refers_to").alias("refers_to"))
