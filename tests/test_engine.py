import io
import json
import os
import subprocess
import threading
import time

from lodeview import surface
from lodeview.engine import Engine, load_config, resolve_roots
from lodeview.sources.files import listing
from lodeview.sources.tables import Tables
from lodeview.sources.watcher import Watcher
from lodeview.streaming import live


def test_scan_find_and_rescan(spark, tmp_path):
    root = tmp_path / "work"
    (root / "app" / "node_modules").mkdir(parents=True)
    (root / "app" / "notes.md").write_text("quarterly budget for the portal")
    (root / "app" / "_under.txt").write_text("kept")
    (root / "app" / ".hidden.txt").write_text("left out")
    (root / "app" / "node_modules" / "x.md").write_text("left out")
    (root / "screenshots").mkdir()
    (root / "screenshots" / "login.png").write_bytes(b"png")
    subprocess.run(["git", "init", "-q", "-b", "main", str(root / "app")], check=True)
    (root / "app" / "README.md").write_text("the app")
    engine = Engine(spark, str(tmp_path / "index"))
    first = engine.scan([str(root)])
    assert first["indexed"] == 4 and first["text_extractions"] == 3 and first["image_summaries"] == 1
    assert {r["name"] for r in listing(spark, [str(root)]).collect()} == {"notes.md", "_under.txt", "README.md", "login.png"}
    hit = engine.find("quarterly budget").first()
    assert hit["title"] == "notes.md" and "[quarterly] [budget]" in hit["why_matched"]
    assert engine.find("login screenshot").first()["title"] == "login.png"
    assert engine.get(hit["result_id"]).first()["blobs"][0]["snippet"] == "quarterly budget for the portal"
    assert engine.tables.read("repo_records").first()["current_branch"] == "main"
    again = engine.scan([str(root)])
    assert again["indexed"] == 0 and again["reused"] == 4 and again["text_extractions"] == 0
    assert engine.recent(limit=2).count() == 2


def test_config_and_roots(tmp_path):
    (tmp_path / "bad.json").write_text("{")
    assert load_config(str(tmp_path / "bad.json")) == {}
    assert resolve_roots([" /a ", "/a", ""], ["/b"]) == ["/a"]


def _paths(engine):
    return {r["path"].rsplit("/", 1)[-1] for r in engine.tables.read("file_records").collect()}


def test_apply_changes_moves_and_deletes(spark, tmp_path):
    root = tmp_path / "notes"
    root.mkdir()
    for name in ("one.md", "two.md", "three.md"):
        (root / name).write_text(f"the text of {name[:-3]}")
    engine = Engine(spark, str(tmp_path / "index"))
    engine.scan([str(root)])
    (root / "one.md").write_text("rewritten altogether")
    os.rename(root / "two.md", root / "moved.md")
    os.remove(root / "three.md")
    jobs = [("one.md", "upsert"), ("moved.md", "upsert"), ("two.md", "delete"), ("three.md", "delete"), ("ghost.md", "upsert")]
    engine.apply(spark.createDataFrame([(str(root / n), j, i) for i, (n, j) in enumerate(jobs)], "path string, job string, last_ms long"), [str(root)])
    assert _paths(engine) == {"one.md", "moved.md"}
    assert engine.find("rewritten altogether").first()["title"] == "one.md"
    assert engine.find("text of two").first()["title"] == "moved.md"
    assert engine.find("three").count() == 0


def test_watch_from_folder_to_answer(spark, tmp_path):
    root = tmp_path / "live"
    root.mkdir()
    (root / "old.md").write_text("an early remark on herons")
    engine = Engine(spark, str(tmp_path / "index"))
    engine.scan([str(root)])
    watcher, done = Watcher([str(root)], str(tmp_path / "events")), threading.Event()
    thread = threading.Thread(target=watcher.run, args=(done.is_set,))
    thread.start()
    query = engine.watch(live.event_files(spark, str(tmp_path / "events")), [str(root)], str(tmp_path / "checkpoint"))
    try:
        (root / "new.md").write_text("a fresh remark on kingfishers")
        os.rename(root / "old.md", root / "kept.md")
        end = time.time() + 120
        while time.time() < end and _paths(engine) != {"new.md", "kept.md"}:
            time.sleep(1)
        assert _paths(engine) == {"new.md", "kept.md"}
        assert engine.find("kingfishers").first()["title"] == "new.md" and engine.find("early herons").first()["title"] == "kept.md"
    finally:
        done.set()
        thread.join()
        query.stop()


def test_watcher_waits_until_a_file_has_settled(tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    w = Watcher([str(root)], str(tmp_path / "e"))
    (root / "a").write_text("x")
    assert w.step() == []
    (root / "a").write_text("longer")
    assert w.step() == [] and [e["kind"] for e in w.step()] == ["add"]
    (root / "a").write_text("longer still")
    assert w.step() == [] and [e["kind"] for e in w.step()] == ["change"]
    (root / "a").unlink()
    assert [e["kind"] for e in w.step()] == ["unlink"] and w.step() == []


def test_tables_always_have_a_version(spark, tmp_path):
    t = Tables(spark, str(tmp_path))
    row = lambda i: spark.createDataFrame([(str(i), "/r", "r", None, None, None, "{}")], t.read("repo_records").schema)
    assert t.read("repo_records").count() == 0
    t.write("repo_records", row(0))
    held = t.read("repo_records")
    for i in range(1, 12):
        t.write("repo_records", row(i))
        assert t.read("repo_records").first()["id"] == str(i)
    assert t.version("repo_records") and held.schema == t.read("repo_records").schema
    t.write("repo_records", t.read("repo_records"))
    assert t.read("repo_records").first()["id"] == "11"


def test_large_folders_are_split(spark, tmp_path):
    for i in range(3):
        for j in range(4):
            (tmp_path / f"d{i}" / f"e{j}").mkdir(parents=True)
            (tmp_path / f"d{i}" / f"e{j}" / "f.txt").write_text("x")
    (tmp_path / "top.txt").write_text("x")
    for parts in (1, 3, 10, 100):
        found = listing(spark, [str(tmp_path)], parts=parts)
        assert found.count() == 13 and found.select("path").distinct().count() == 13


def test_requests(spark, tmp_path):
    root = tmp_path / "w"
    root.mkdir()
    (root / "plan.md").write_text("harvest in autumn")
    engine = Engine(spark, str(tmp_path / "i"))
    engine.scan([str(root)])
    ask = lambda **x: surface.answer(engine, json.dumps({"jsonrpc": "2.0", "id": 1} | x))
    hit = ask(method="find", params={"query": "harvest"})["result"][0]
    assert hit["title"] == "plan.md" and hit["link"] == f"file://{root}/plan.md"
    assert ask(method="get", params={"id": hit["result_id"]})["result"]["blobs"][0]["snippet"] == "harvest in autumn"
    assert ask(method="get", params={"id": "none"})["result"] is None and len(ask(method="recent")["result"]) == 1 and ask(method="ping")["result"] == "pong"
    codes = [ask(method="x"), ask(method="find"), ask(method="find", params={"query": ""}), ask(method="recent", params={"limit": 101}), ask(params={}), surface.answer(engine, "{"), surface.answer(engine, "[]")]
    assert [c["error"]["code"] for c in codes] == [-32601, -32000, -32000, -32000, -32600, -32700, -32600]
    out = io.StringIO()
    surface.serve(engine, ['{"id": 7, "method": "ping"}', "", "nonsense"], out)
    assert [json.loads(x).get("id") for x in out.getvalue().splitlines()] == [7, None]
    listed = ask(method="tools/list")["result"]["tools"]
    assert [t["name"] for t in listed] == ["find", "get", "recent"] and ask(method="initialize", params={"protocolVersion": "x"})["result"]["protocolVersion"] == "x"
    called = ask(method="tools/call", params={"name": "find", "arguments": {"query": "harvest", "kinds": ["file"]}})["result"]
    assert json.loads(called["content"][0]["text"])[0]["title"] == "plan.md" and not called["isError"]
    assert ask(method="tools/call", params={"name": "find", "arguments": {"query": ""}})["result"]["isError"] and "error" in ask(method="tools/call", params={"name": "none"})
    out = io.StringIO()
    surface.serve(engine, ['{"method": "notifications/initialized"}', '{"id": 1, "method": "ping"}'], out)
    assert len(out.getvalue().splitlines()) == 1
    shown = surface.record_card(surface._get(engine, hit["result_id"]))
    assert "name: plan.md" in shown and "[text/markdown] harvest in autumn" in shown and surface.record_card(None) == "No such record."
    out = io.StringIO()
    assert surface.main(["--index", str(tmp_path / "i"), "doctor", str(root)], out) == 0 and json.loads(out.getvalue())["roots"] == {str(root): True}
    out = io.StringIO()
    assert surface.main(["--index", str(tmp_path / "i"), "find", "harvest"], out) == 0 and out.getvalue().startswith("1. plan.md")


def test_external_programs(tmp_path, monkeypatch):
    """Stand-ins for the programs, as they print."""
    from lodeview.operators import external, extract

    def program(name, body):
        (tmp_path / name).write_text(f"#!/bin/sh\n{body}\n")
        (tmp_path / name).chmod(0o755)

    pdf = tmp_path / "a.pdf"
    pdf.write_bytes(b"%PDF /Title (About) /Count 3 stream\nBT (inside) Tj ET\nendstream")
    monkeypatch.setenv("PATH", f"{tmp_path}:/usr/bin:/bin")
    assert extract.extract_file(str(pdf), "pdf").strategy == "raw_strings" and external.read_image("/x.png", True) == (None,) * 7
    program("pdftotext", "exit 3")
    program("mutool", "echo printed text")
    x = extract.extract_file(str(pdf), "pdf")
    assert (x.content, x.strategy, x.title, x.pages) == ("printed text", "mutool", "About", 3)
    program("exiftool", """echo '[{"Make": "Nobel", "Model": " K1 ", "ImageWidth": 640, "ImageHeight": "480", "City": "Oslo", "Country": "", "DateTimeOriginal": "2024"}]'""")
    program("tesseract", "printf 'two\\n  words'")
    assert external.read_image("/x.png", True) == ("2024", None, "Nobel K1", "640x480", "Oslo", None, "two words")
    assert external.read_image("/x.png", False)[-1] is None
