"""Ranking cases with hand-derived scores."""

import os
import sqlite3

import pytest

from lodeview.engine import cards
from lodeview.functions.snippet import snippet
from lodeview.operators import index, search
from lodeview.plans.query import analyse
from lodeview.sources.tables import BLOBS, FILES, REPOS


def _file(path, meta="{}", modified="2026-04-18T10:00:00.000Z"):
    name = path.rsplit("/", 1)[-1]
    return (f"id:{path}", path, name, name.rsplit(".", 1)[-1], "x/y", 1, modified, modified, modified, "/", meta, 1, 1)


SHOT, IMAGE = '{"fileCategory":"image","isScreenshot":true}', '{"fileCategory":"image","isScreenshot":false}'


def _find(spark, question, files=(), repos=(), blobs=()):
    f, r, b = (spark.createDataFrame(list(rows), schema) for rows, schema in ((files, FILES), (repos, REPOS), (blobs, BLOBS)))
    return search.find(f, r, b, question)


def _scores(df):
    return [(r["path"], r["score"]) for r in df.collect()]


def test_screenshot_first(spark):
    files = [_file("/shots/screenshots/login-page.png", SHOT), _file("/shots/photos/login-form.png", IMAGE)]
    found = _find(spark, "login screenshot", files)
    # 100, 5 for each word met, 40 for a name with one, 30 for a screenshot
    assert _scores(found) == [("/shots/screenshots/login-page.png", 100 + 10 + 40 + 30), ("/shots/photos/login-form.png", 100 + 5 + 40)]
    assert found.first()["why_matched"] == "Matched screenshot file name or path"


def test_screenshot_text(spark):
    f = _file("/shots/screenshots/ticket-refund.png", SHOT)
    b = ("b", f[0], "file", "screenshot_ocr", "Refund queue for late ticket orders", "t", 0)
    row = _find(spark, "refund queue screenshot", [f], (), [b]).first()
    assert row["score"] == (100 + 10 + 40 + 30) + 35 + 28 and "screenshot OCR text: [Refund] [queue]" in row["why_matched"]


def test_noisy_path(spark):
    files = [_file("/home/u/projects/kit/src/parser.rs"), _file("/home/u/projects/kit/node_modules/x/y/parser.rs")]
    got = dict(_scores(_find(spark, "parser", files)))
    assert got["/home/u/projects/kit/src/parser.rs"] == 140 + 40 + 12
    assert got["/home/u/projects/kit/node_modules/x/y/parser.rs"] == 140 + 40 + 12 - 45 - 2 * 2


def test_mistyped_repository(spark):
    repo = ("r", "/home/u/treegraft", "treegraft", None, "main", None, "{}")
    row = _find(spark, "treegrapht", (), [repo]).first()
    # two edits in ten letters
    assert row["score"] == 72 + 44 and row["why_matched"] == "Matched similar repo name (80% similarity)"


@pytest.mark.parametrize("question, name, score", [("the maps of towns", "TOWN MAP final.pdf", 100 + 10 + 40 + 5), ("maps", "map-of-the-town.md", 100 + 5 + 40 + 5)])
def test_stems(spark, question, name, score):
    assert _scores(_find(spark, question, [_file(f"/home/u/Downloads/{name}")])) == [(f"/home/u/Downloads/{name}", score)]


def test_image_metadata(spark):
    a, b = _file("/tmp/norway-map.png", IMAGE), _file("/home/u/Pictures/IMG_7.jpeg", IMAGE)
    text = ("b", b[0], "file", "image_metadata", "image: IMG_7.jpeg\nlocation: Oslo, Norway", "t", 0)
    # by text alone: 125, a folder of pictures 5, both words 24, an image's text 24; by name: 105 + 40 + 20 in a folder for 45 less
    assert _scores(_find(spark, "image from Norway", [a, b], (), [text])) == [(b[1], 125 + 5 + 24 + 24), (a[1], 105 + 40 + 20 - 45)]


def test_nothing_and_cards(spark):
    assert cards(_find(spark, "   ", [_file("/a/x.md")])) == "No matches found."
    text = cards(_find(spark, "minutes", [_file("/home/u/minutes.md")]))
    assert text == "1. minutes.md\n   type: file\n   path: /home/u/minutes.md\n   why: Matched file name or path text\n   modified: 2026-04-18T10:00:00.000Z"


def test_phrases_accents_and_marks(spark):
    texts = ["the night-train leaves", "a train by night", "the Nighttrain", "caf\u00e9 and CAFE\u0301 and Cafe", "ni\u00f1o"]
    blobs = spark.createDataFrame([(str(i), f"s{i}", "file", "text/plain", t, "c", i) for i, t in enumerate(texts)], BLOBS)
    words = index.postings(blobs)
    hits = lambda question: sorted(r["seq"] for r in search.text_matches(words, analyse(question)).collect())
    assert hits("night-tr") == [0] and hits("night") == [0, 1, 2] and hits("cafe") == [3] and hits("nino") == [4] and hits("###") == []
    assert [r["places"] for r in words.filter("token = 'cafe'").collect()] == [[0, 2, 4]]
    many = search.text_candidates_of_many(words, ["night-tr", "train night", "zzz", "cafe"]).collect()
    assert sorted((r["question"], r["seq"], r["strict"]) for r in many) == [(0, 0, False), (1, 0, True), (1, 1, True), (1, 2, False), (3, 3, False)]


def test_index_rows_are_exchanged_once(spark):
    """One row for each token of a text is exchanged, and none of the stored index where many prefixes or questions meet it."""
    content = ["aa b " * 2000, "", "b aa c", None, "\u00e9 e"]
    words = index.postings(spark.createDataFrame([(str(i), f"s{i}", "file", "text/plain", t, "c", i) for i, t in enumerate(content)], BLOBS))
    got = {(r["token"], r["seq"]): r["places"] for r in words.collect()}
    assert got == {("aa", 0): [*range(0, 4000, 2)], ("b", 0): [*range(1, 4000, 2)], ("b", 2): [0], ("aa", 2): [1], ("c", 2): [2], ("e", 4): [0, 1]}
    plan = words._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "explode" not in plan  # before: each occurrence was exchanged, with its source
    hit = index.prefix_lookup(words, spark.createDataFrame([("a",), ("aa",), ("zz",)], "prefix string"))
    assert sorted((r["prefix"], r["token"], r["seq"]) for r in hit.collect()) == [("a", "aa", 0), ("a", "aa", 2), ("aa", "aa", 0), ("aa", "aa", 2)]
    assert "hashpartitioning(token" not in hit._jdf.queryExecution().executedPlan().toString()


def test_many_questions_of_many_terms(spark):
    """More terms than a number has bits, more prefixes than are pushed down, repeated words and phrases."""
    names = [f"w{i:03d}" for i in range(100)]
    texts = [" ".join(names), " ".join(names[:-1]), "w000 w001", "w001 w000"]
    words = index.postings(spark.createDataFrame([(str(i), f"s{i}", "file", "text/plain", t, "c", i) for i, t in enumerate(texts)], BLOBS))
    got = search.text_candidates_of_many(words, [" ".join(names), "w000-w001 w001", "w001-w000", "w000 w000"]).collect()
    want = [(0, 0, True), (0, 1, False), (0, 2, False), (0, 3, False), (1, 0, True), (1, 1, True), (1, 2, True), (1, 3, False), (2, 3, False), *[(3, i, False) for i in range(4)]]
    assert sorted((r["question"], r["seq"], r["strict"]) for r in got) == want


def test_recent_order_and_since(spark):
    f = spark.createDataFrame([_file("/a.md", modified="2026-04-18T10:00:00Z"), _file("/b.md", modified="2026-04-19T10:00:00Z")], FILES)
    assert [r["path"] for r in search.recent(f, None, 5).collect()] == ["/b.md", "/a.md"]
    assert [r["path"] for r in search.recent(f, "2026-04-19T00:00:00Z").collect()] == ["/b.md"]


def test_question_analysis():
    assert analyse("Show the PDF on Lattices").text == "show the pdf on lattices"
    assert analyse("which picture was downloaded last week").hints == ("image", "download")
    assert analyse(" Repo IMAGE PDF screenshot download ").hints == ("repo", "image", "pdf", "screenshot", "download")
    assert analyse("the of").words == ("the", "of")
    assert analyse("night-train ### boss").index_terms == [["night", "train"], ["boss"]]


@pytest.mark.parametrize("text", ["one two three", "a long text. " * 9 + "here harvest begins: barns of harvest, and more words follow after it until it ends now"])
def test_snippet_like_sqlite(text):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(c)")
    con.execute("INSERT INTO t VALUES (?)", (text,))
    got = con.execute("SELECT snippet(t, 0, '[', ']', ' … ', 12) FROM t WHERE t MATCH 'harvest* OR two*'").fetchone()[0]
    assert snippet(text, [["harvest"], ["two"]]) == got


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("terms", [["er"], ["than", "ering"], ["que", "ther", "und"], ["thor"]])
def test_matches_and_snippets_like_sqlite_on_all_texts(spark, terms):
    """Every text of the smallest tables: which match, in what order, and each one's snippet."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("text IS NOT NULL").orderBy("doc_id").collect()
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(c)")
    con.executemany("INSERT INTO t (rowid, c) VALUES (?, ?)", [(r["doc_id"], r["text"]) for r in docs])
    query = " OR ".join(f"{t}*" for t in terms)
    want = con.execute("SELECT rowid, snippet(t, 0, '[', ']', ' … ', 12) FROM t WHERE t MATCH ? ORDER BY rowid", (query,)).fetchall()
    blobs = spark.createDataFrame([(str(r["doc_id"]), str(r["doc_id"]), "file", "text/plain", r["text"], "c", r["doc_id"]) for r in docs], BLOBS)
    hit = search.text_matches(index.postings(blobs), analyse(" ".join(terms)) if len(terms) > 1 else analyse(terms[0])).orderBy("seq").collect()
    assert [r["seq"] for r in hit] == [i for i, _ in want]
    text = {r["doc_id"]: r["text"] for r in docs}
    off = [i for i, s in want if snippet(text[i], [[t] for t in terms]) != s]
    assert not off, (len(off), len(want))
