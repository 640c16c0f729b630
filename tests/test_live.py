import hashlib
import json
import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lodeview.operators import index
from lodeview.sources.tables import BLOBS, FILES
from lodeview.streaming import live

START = datetime(2026, 1, 1, tzinfo=timezone.utc)


def _events(rows):
    return [{"event_id": i, "path": p, "inode": n, "kind": k, "ts": (START + timedelta(milliseconds=ms)).isoformat()} for i, (ms, p, k, n) in enumerate(rows)]


def _table(spark, rows):
    return spark.createDataFrame([(e["event_id"], e["path"], e["inode"], e["kind"], datetime.fromisoformat(e["ts"])) for e in _events(rows)], "event_id long, path string, inode long, kind string, ts timestamp")


ROWS = [(0, "/a", "change", 1), (100, "/a", "change", 1), (200, "/a", "unlink", 1), (5000, "/a", "add", 1), *((i * 50, "/b", "change", 2) for i in range(60)), (10, "/c", "error", 3)]


def test_debounce_rule(spark):
    got = sorted(tuple(r) for r in live.debounce_batch(_table(spark, ROWS)).collect())
    base = int(START.timestamp() * 1000)
    assert [(p, j, a - base, b - base, n) for p, j, a, b, n in got] == [("/a", "delete", 0, 200, 3), ("/a", "upsert", 5000, 5000, 1), ("/b", "upsert", 0, 2000, 41), ("/b", "upsert", 2050, 2950, 19)]


def test_debounce_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    closing = [(60_000, "/z", "change", 9)]
    for i, part in enumerate((ROWS, closing, [(120_000, "/z", "change", 9)])):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps(e) for e in _events(part)))
        os.utime(tmp_path / "in" / f"{i}.json", (1_000 + i, 1_000 + i))  # files are taken in order of time, which may else be the same
    stream = live.event_files(spark, str(tmp_path / "in"), 1)
    q = live.debounced(stream).writeStream.format("memory").queryName("jobs").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.table("jobs").filter("path <> '/z'").collect())
    assert got == sorted(tuple(r) for r in live.debounce_batch(_table(spark, ROWS)).collect())


def test_rename_pairs_and_apply(spark):
    e = _table(spark, [(0, "/old.md", "unlink", 7), (500, "/new.txt", "add", 7), (0, "/gone", "unlink", None), (100, "/other", "add", None), (9000, "/late", "add", 7)])
    pairs = index.rename_pairs(e)
    assert [(r["old_path"], r["new_path"]) for r in pairs.collect()] == [("/old.md", "/new.txt")]
    row = lambda p, i: (i, p, p[1:], "md", None, 1, "c", "m", "a", "/", "{}", 7, 1)
    sha = spark.range(1).select(F.sha1(F.lit("/old.md")), F.sha1(F.lit("/new.txt"))).first()
    files = spark.createDataFrame([row("/old.md", sha[0]), row("/new.txt", "stale"), row("/k", "k")], FILES)
    blobs = spark.createDataFrame([("b", sha[0], "file", "text/plain", "t", "c", 0), ("k", "k", "file", "text/plain", "t", "c", 1)], BLOBS)
    f, b = index.apply_renames(files, blobs, pairs)
    assert sorted((r["id"], r["path"], r["extension"]) for r in f.collect()) == sorted([(sha[1], "/new.txt", "txt"), ("k", "/k", "md")])
    assert [r["source_id"] for r in b.orderBy("seq").collect()] == ["k", sha[1]]


def test_apply_jobs(spark):
    row = lambda p: (p, p, p, "md", None, 1, "c", "m", "a", "/", "{}", 7, 1)
    files, listing = spark.createDataFrame([row("/a"), row("/b")], FILES), spark.createDataFrame([row("/b"), row("/n"), row("/x")], FILES)
    blobs = spark.createDataFrame([("1", "/a", "file", "t", "x", "c", 0)], BLOBS)
    jobs = spark.createDataFrame([("/a", "upsert", 1), ("/a", "delete", 2), ("/n", "upsert", 1), ("/ghost", "upsert", 1)], "path string, job string, last_ms long")
    f, b = live.apply_jobs(jobs, files, blobs, listing)
    assert sorted(r["path"] for r in f.collect()) == ["/b", "/n"] and b.count() == 0


def test_blob_upsert_keeps_blank(spark):
    old = spark.createDataFrame([("1", "s", "file", "t", "old", "c", 0)], BLOBS)
    blank = spark.createDataFrame([("2", "s", "file", "t", "   ", "c", 0)], BLOBS)
    new = spark.createDataFrame([("2", "s", "file", "t", " new ", "c", 0)], BLOBS)
    assert index.upsert_blobs(old, blank).first()["content"] == "old"
    row = index.upsert_blobs(old, new).first()
    assert row["content"] == "new" and row["seq"] == 1


def _one_by_one(events, grace=1000):
    """The pairing rules as a machine that sees one event after another: (what, old, new, unlink, add)."""
    pending, out = {}, []  # path: (ms, key, event)
    last_of = {}  # (inode): path of the last unlink
    for i, (ms, path, kind, inode) in sorted(enumerate(events), key=lambda x: (x[1][0], x[0])):
        for p in [p for p, (t, _, _) in pending.items() if ms - t > grace]:
            del pending[p]
        if kind == "unlink":
            pending[path] = ms, inode, i
            if inode is not None:
                last_of[inode] = i
        elif kind == "add":
            if path in pending:
                out.append(("change", path, path, pending.pop(path)[2], i))
            elif inode is not None:
                for p, (_, key, u) in list(pending.items()):
                    if key == inode and last_of.get(inode) == u:
                        out.append(("rename", p, path, u, i))
                        del pending[p]
    return sorted(out)


def test_pairs_as_one_event_after_another(spark):
    rng = random.Random(5)
    for trial in range(6):
        at, events = 0, []
        for _ in range(120):
            at += rng.choice([50, 300, 700, 2500])
            events.append((at, f"/p{rng.randrange(12)}", rng.choice(["unlink", "add", "add", "change"]), rng.choice([None, *range(6)])))
        got = sorted(tuple(r) for r in index.paired_events(_table(spark, events)).select("what", "old_path", "new_path", "ue", "ae").collect())
        assert got == _one_by_one(events), trial


def test_devices_are_told_apart(spark):
    rows = [(0, "/a", "unlink", 1, 1), (10, "/b", "add", 1, 2), (20, "/c", "add", 1, 1)]
    e = spark.createDataFrame([(i, p, n, d, k, START + timedelta(milliseconds=ms)) for i, (ms, p, k, n, d) in enumerate(rows)], "event_id long, path string, inode long, device long, kind string, ts timestamp")
    assert [(r["old_path"], r["new_path"]) for r in index.rename_pairs(e).collect()] == [("/a", "/c")]


def _held(spark, paths):
    sha = lambda p: hashlib.sha1(p.encode()).hexdigest()
    files = spark.createDataFrame([(sha(p), p, p[1:], None, None, 1, "c", "m", "a", "/", "{}", 7, 1) for p in paths], FILES)
    return files, spark.createDataFrame([("b", sha(p), "file", "text/plain", f"text of {p}", "c", i) for i, p in enumerate(paths)], BLOBS)


@pytest.mark.parametrize("moves, want", [
    ([("/a", "/b"), ("/b", "/a")], {"/a": "text of /b", "/b": "text of /a", "/c": "text of /c"}),
    ([("/a", "/a")], {"/a": "text of /a", "/b": "text of /b", "/c": "text of /c"}),
    ([("/a", "/b"), ("/b", "/c")], {"/b": "text of /a", "/c": "text of /b"}),
    ([("/a", "/c")], {"/c": "text of /a", "/b": "text of /b"}),
    ([("/nowhere", "/c")], {"/a": "text of /a", "/b": "text of /b", "/c": "text of /c"}),
])
def test_renames_lose_nothing(spark, moves, want):
    files, blobs = _held(spark, ["/a", "/b", "/c"])
    f, b = index.apply_renames(files, blobs, spark.createDataFrame(moves, "old_path string, new_path string"))
    assert {r["path"]: r["content"] for r in f.join(b, f["id"] == b["source_id"]).collect()} == want


def test_chains_of_renames(spark):
    moves = [("/a", "/tmp", 1, 2), ("/b", "/a", 3, 4), ("/tmp", "/b", 5, 6), ("/x", "/y", 7, 8), ("/y", "/x", 9, 10)]
    got = index.net_renames(spark.createDataFrame(moves, "old_path string, new_path string, ue long, ae long")).collect()
    assert sorted(tuple(r) for r in got) == [("/a", "/b"), ("/b", "/a")]
