"""Operators against brute force, and their defined cases: nulls, empties, ties, repeats, long texts, clashing names."""

import gzip
import hashlib
import os
import random
import re
import time
import zlib
from html import unescape

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from lodeview.llm import chat, exact, html_text, mixing, near, packing, quality, substring, toxicity, warc
from lodeview.llm._vec import words
from lodeview.llm.queries import tokenizer_path

WORDS = [f"w{i}" for i in range(400)]


def _text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, source, size): odd rows, copies, near copies, shared passages and one long text."""
    rng = random.Random(3)
    base = [_text(rng, rng.randint(60, 150)) for _ in range(25)]
    passage = _text(rng, 70)
    texts = [None, "", "  ", "a", "a b\nc", *base, *(t.replace(" ", "\n ", 3) for t in base[:5]), *(f"{_text(rng, 30)} {passage} {_text(rng, 30)}" for _ in range(12))]
    for t in base[:8]:
        w = t.split(" ")
        w[10] = "changed"
        texts.append(" ".join(w[:40] + ["inserted"] + w[40:]))
    texts.append(_text(rng, 9000))
    out = [(i, t, ("s1", "s2", None, "s3")[i % 4] if i % 3 else "s1", -1) for i, t in enumerate(texts)]
    return [*out, out[7], out[7], (None, "no id " + base[1], "s2", -1)]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def _w(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_exact(docs, rows, empty):
    got = exact.report(docs).collect()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(groups)
    for r in got:
        text = next(t for t, ids in groups.items() if r["doc_id"] in ids and hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        ids = groups[text]
        assert r["group_size"] == len(ids) and r["keep_id"] == min((i for i in ids if i is not None), default=None)
    kept = exact.dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact.report(empty).count() == 0


def test_mixing(docs, rows, empty):
    got = mixing.report(docs).collect()
    assert len(got) == len(rows)
    by, most = {}, {}
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and r["target"] <= 2 * r["source_size"] + 1e-9
        by.setdefault(r["source"], [0, r["target"]])[0] += r["taken"]
        most[r["source"]] = max(most.get(r["source"], 0), r["size"])
    for s, (taken, target) in by.items():
        assert abs(taken - target) <= most[s]
    assert abs(sum(t for _, t in by.values()) - 1.5 * sum(r["size"] for r in got)) < 1e-6
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns and sum(len(_w(r["text"])) for r in mixed.collect()) == sum(r["taken"] for r in got)
    assert mixing.report(empty).count() == 0


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    want = {}
    for i, x, *_ in rows:
        want.setdefault(i, []).append(t.encode(x or "", add_special_tokens=False).ids + [0])
    pieces = packing.pack(docs.withColumn("ids", near.F.lit(1)), tokenizer_path(), with_ids=True).collect()
    seen = {i: [[] for _ in ids[0]] for i, ids in want.items() if len(ids) < 2 or ids[0] == ids[1]}
    for p in pieces:
        assert zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"] and len(p["ids"]) == p["length"]
        if p["doc_id"] in seen:
            assert p["doc_tokens"] == len(want[p["doc_id"]][0])
            for k, x in enumerate(p["ids"]):
                seen[p["doc_id"]][p["start"] + k].append(x)
    # each token as often as its row is repeated
    assert all(got == [x] * len(want[i]) for i, all_ in seen.items() for got, x in zip(all_, want[i][0], strict=True))
    spans = sorted((p["sequence_id"] * 1024 + p["offset"], p["length"]) for p in pieces)
    assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    assert packing.pack(empty, tokenizer_path()).count() == 0


def _served(totals, weights, window):
    """Tokens of each queue in each window, by serving one token at a time to the queue that is owed most."""
    paid, out = np.zeros(len(totals)), []
    owed = np.zeros(len(totals))
    for n in range(sum(totals)):
        if n % window == 0:
            out.append(np.zeros(len(totals), int))
        left = paid < totals
        owed += np.where(left, weights, 0) / np.sum(np.where(left, weights, 0))
        q = int(np.argmax(np.where(left, owed, -np.inf)))
        owed[q] -= 1
        paid[q] += 1
        out[-1][q] += 1
    return out


@pytest.mark.parametrize("totals, weights", [([900, 300, 30, 1], None), ([900, 300, 30, 1], [1.0, 1.0, 2.0, 5.0]), ([5, 5], [3.0, 1.0]), ([640], None), ([100, 1000, 100], [8.0, 1.0, 1.0])])
def test_windows_have_the_target_proportions(totals, weights):
    """The closed form against a queue-by-queue simulation: windows differ by the fractions of a token that queues carry."""
    rounds = packing.Rounds(totals, 64, weights)
    plain = _served(totals, np.array(weights or totals, float), 64)
    got = [rounds.paid(w + 1) - rounds.paid(w) for w in range(rounds.windows)]
    assert (sum(got) == totals).all() and all((x >= 0).all() for x in got)
    upto = np.cumsum(got, 0) - np.cumsum(plain, 0)
    assert np.abs(upto).max() <= 2 * len(totals)
    places = sorted((at, n) for q, t in enumerate(totals) for x in range(0, t, 7) for at, n in rounds.places(q, x, min(7, t - x)))
    assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(places[-1]) == sum(totals)


def test_packing_to_weights(spark):
    docs = spark.createDataFrame([(i, "w " * 40, "ab"[i % 5 > 0]) for i in range(200)], "doc_id long, text string, source string")
    rows = packing.pack(docs, tokenizer_path(), sequence=64, window=4, weights={"a": 3.0, None: 1.0}).join(docs.withColumnRenamed("doc_id", "i"), near.F.col("doc_id") == near.F.col("i")).collect()
    by = {}
    for r in rows:
        window = by.setdefault(r["sequence_id"] // 4, {"a": 0, "b": 0})
        window[r["source"]] += r["length"]
    a_tokens = sum(w["a"] for w in by.values())
    full = [w for _, w in sorted(by.items())][: int(a_tokens // (256 * 0.75))]
    assert len(full) > 5 and all(abs(w["a"] - 192) <= 2 and abs(w["b"] - 64) <= 2 for w in full)
    few = packing.pack(docs, tokenizer_path(), queues=1).collect()
    assert sum(r["length"] for r in few) == sum(r["length"] for r in rows)


@pytest.mark.parametrize("text", ["  a b", " a  b\n c   d ", "a\n  b", "", " ", "   ", " x   y<|endoftext|> z", "it's  don't\t\tx", "a  b 　c"])
def test_chunks_are_independent(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    e = packing.Encoder(tokenizer_path())
    e.unchecked = 0
    assert np.frombuffer(e.encode([text])[0], "<u2").tolist() == t.encode(text, add_special_tokens=False).ids


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance_and_bounds():
    rng = random.Random(1)
    for _ in range(400):
        a = [rng.randrange(6) for _ in range(rng.randint(0, 30))]
        b = [x for x in a if rng.random() > 0.1] + [rng.randrange(6) for _ in range(rng.randint(0, 3))]
        d, x, y = _distance(a, b), np.array(a, np.uint64), np.array(b, np.uint64)
        for most in (0, 2, 5, 40):
            assert near.edit_distance(x, y, most) == min(d, most + 1)
        longest = max(len(a), len(b), 1)
        assert near.similar(x, y, 0.8) == (d <= int(np.floor(0.2 * longest + 1e-9)))


def test_near(docs, rows, empty):
    got = {r["doc_id"]: r for r in near.groups(docs).collect()}
    known = {i: _w(t) for i, t, *_ in rows if i is not None and len(_w(t)) < 1000}
    root = {i: i for i in known}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(known)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            longest = max(len(known[i]), len(known[j]))
            if known[i] == known[j] or (min(len(known[i]), len(known[j])) >= 0.8 * longest and len(set(known[i]) & set(known[j])) > 20 and _distance(known[i], known[j]) <= int(0.2 * longest)):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {i: got[i]["group_id"] for i in ids} == {i: find(i) for i in ids}
    kept = near.dedup(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id IS NOT NULL").count() == len({got[i]["group_id"] for i in got if i is not None})
    assert near.groups(empty).count() == 0


def test_large_buckets_lose_no_link(spark):
    """Many near copies and many unlike texts with one frequent passage, more than a small bucket holds."""
    rng = random.Random(8)
    one, passage = _text(rng, 80).split(" "), _text(rng, 60)
    copies = []
    for i in range(60):
        w = list(one)
        w[i] = f"only{i}"
        copies.append(" ".join(w))
    unlike = [f"{passage} {_text(rng, 60)}" for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(copies + unlike)), "doc_id long, text string")
    got = {r["doc_id"]: r["group_id"] for r in near.groups(docs, small=4).collect()}
    assert all(got[i] == 0 for i in range(60)) and all(got[i] == i for i in range(60, 120))


def _family(rng, n, words, changed):
    """Copies of one text, each with a share of its words changed, and the components of links by changed places alone."""
    one = np.array(_text(rng, words).split(" "), object)
    at = np.zeros((n, words), np.int64)
    for i in range(n):
        at[i, rng.sample(range(words), int(changed * words))] = i + 1
    root = np.arange(n)
    reach = [np.flatnonzero((at[i] != at).sum(1) <= int(0.2 * words + 1e-9)) for i in range(n)]
    while True:
        least = np.array([root[r].min() for r in reach])
        if (least == root).all():
            break
        root = least
    return [" ".join(f"{w}x{c}" if c else w for w, c in zip(one, row)) for row in at], root


@pytest.mark.parametrize("n, words, changed", [(1000, 100, 0.1), (1000, 200, 0.08), (500, 100, 0.12)])
def test_large_families_at_the_threshold_stay_whole(spark, n, words, changed):
    """Copies about 0.8 alike: leaders and further buckets join what an exhaustive search does."""
    texts, root = _family(random.Random(6), n, words, changed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["group_id"] for r in near.groups(docs).collect()}
    assert [got[i] for i in range(len(texts))] == root.tolist()


def test_scattered_edits_by_band(spark):
    """Of planted pairs with edits scattered over 20%, 18% and 15% of the words, few are missed."""
    rng, texts = random.Random(4), []
    for changed in (20, 18, 15):
        for _ in range(150):
            w = [f"v{rng.randrange(5000)}" for _ in range(100)]
            texts.append(" ".join(w))
            for i in rng.sample(range(100), changed):
                w[i] = f"x{rng.randrange(10**9)}"
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["group_id"] for r in near.groups(docs).collect()}
    for band in range(3):
        pairs = range(300 * band, 300 * (band + 1), 2)
        assert sum(got[i] == got[i + 1] for i in pairs) >= 0.96 * 150
    assert all(got[i] == i for i in range(0, 900, 2))


@pytest.mark.parametrize("changed, least", [(0.1, 0.97), (0.15, 0.95), (0.18, 0.92), (0.2, 0.9)])
def test_links_under_a_shared_passage(spark, changed, least):
    """Pairs of texts of 200 words, 120 of them the same passage in all, with a share of all words changed."""
    rng, texts = random.Random(9), []
    passage = [f"p{i}" for i in range(120)]
    for _ in range(150):
        w = [*(f"v{rng.randrange(5000)}" for _ in range(80)), *passage]
        texts.append(" ".join(w))
        for i in rng.sample(range(200), int(changed * 200)):
            w[i] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["group_id"] for r in near.groups(docs).collect()}
    assert sum(got[i] == got[i + 1] for i in range(0, 300, 2)) >= least * 150
    assert all(got[i] == i for i in range(0, 300, 2))


def _by_buckets(spark, texts, similarity=0.8):
    """Groups by the links among all pairs that share the smallest k-mer of a table, compared one by one."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = {r["id"]: r["keys"] for r in near.sketched(near._keyed(docs, "doc_id", "text"), tables=32, sample=2).select("id", "keys").collect()}
    raw = [t.encode() for t in texts]
    w = words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    h = w.hashes()
    seq = [h[w.first[i] : w.first[i + 1]] for i in range(len(texts))]
    held = np.array([keys[i] for i in range(len(texts))])
    root = np.arange(len(texts))
    for i in range(len(texts)):
        for j in np.flatnonzero((held[:i] == held[i]).any(1)).tolist():
            if root[i] != root[j] and near.similar(seq[i], seq[j], similarity):
                a, b = sorted((root[i], root[j]))
                root[root == b] = a
    return docs, root.tolist()


def _under_one_passage():
    """Texts of many lengths that share a passage of four fifths: leaders meet few of the pairs that link."""
    rng, texts = random.Random(15), []
    for i in range(300):
        own = [f"v{i}x{k}" for k in range(rng.randint(42, 60))]
        passage = [f"p{k}" for k in range(rng.randint(150, 190))]
        at = rng.randrange(len(own))
        texts.append(" ".join(own[:at] + passage + own[at:]))
        if i % 2:
            w = texts[-1].split(" ")
            for k in rng.sample(range(len(w)), int(0.2 * len(w))):
                w[k] = f"x{rng.randrange(10**9)}"
            texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("side", [2048, 40])
def test_no_pair_of_a_large_bucket_is_passed_over(spark, monkeypatch, side):
    monkeypatch.setattr(near, "SIDE", side)
    texts = _under_one_passage()
    docs, root = _by_buckets(spark, texts)
    got = {r["doc_id"]: r["group_id"] for r in near.groups(docs).collect()}
    assert [got[i] for i in range(len(texts))] == root and 100 < len(set(root)) < 450


def _exhaustive(docs):
    """Group of each (id, word sequence) by comparing all pairs that histograms leave."""
    ids = [i for i, _ in docs]
    raw = [(t or "").encode() for _, t in docs]
    w = words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    h = w.hashes()
    seq = [h[w.first[i] : w.first[i + 1]] for i in range(len(ids))]
    bins = np.stack([np.bincount((s % np.uint64(64)).astype(int), minlength=64) for s in seq])
    n, root = np.array([len(s) for s in seq]), list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        longer = np.maximum(n[:i], n[i])
        off = bins[:i] - bins[i]
        bound = np.maximum(np.maximum(off, 0).sum(1), np.maximum(-off, 0).sum(1))
        for j in np.flatnonzero(bound <= np.floor(0.2 * longer + 1e-9)).tolist():
            if near.similar(seq[i], seq[j], 0.8):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(ids))]


def test_near_groups_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    root = _exhaustive(rows)
    got = {r["doc_id"]: r["group_id"] for r in near.groups(docs).collect()}
    assert [got[i] for i, _ in rows] == [rows[k][0] for k in root]


def test_near_copies_without_ids(spark):
    rng = random.Random(3)
    one, two = _text(rng, 90), _text(rng, 90)
    change = lambda t, i: " ".join(f"c{i}" if k == 40 + i else x for k, x in enumerate(t.split(" ")))
    rows = [(None, change(one, 1)), (None, change(one, 2)), (5, one), (7, two), (7, change(one, 3)), (9, change(two, 1)), (None, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near.groups(docs).collect()
    assert sorted((str(r["doc_id"]), str(r["group_id"])) for r in got) == sorted([("None", "5"), ("None", "5"), ("5", "5"), ("7", "5"), ("7", "7"), ("9", "7"), ("None", "None"), ("None", "None")])
    assert sorted(str(r["doc_id"]) for r in got if r["kept"]) == ["5", "7", "None"]
    kept = near.dedup(docs).collect()
    assert sorted((str(r["doc_id"]), len(r["text"] or "")) for r in kept) == sorted([("5", len(one)), ("7", len(two)), ("None", 0)])


def test_histograms_are_a_bound(spark):
    rng = random.Random(12)
    texts = [_text(rng, 60) for _ in range(12)]
    for t in texts[:12]:
        w = t.split(" ")
        for i in rng.sample(range(60), 11):
            w[i] = rng.choice(WORDS)
        texts.append(" ".join(w[:30] + ["more"] + w[30:]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    reps = near.sketched(near._keyed(docs, "doc_id", "text"), tables=4, sample=2).withColumn("rid", near.F.col("id"))
    pairs = spark.createDataFrame([(i, j, True) for i in range(24) for j in range(i + 1, 24)], "a long, b long, star boolean")
    left = {(r["a"], r["b"]) for r in near.possible(pairs, reps, similarity=0.8).collect()}
    assert {(i, j) for i in range(24) for j in range(i + 1, 24) if _distance(texts[i].split(" "), texts[j].split(" ")) <= 0.2 * max(len(texts[i].split(" ")), len(texts[j].split(" ")))} <= left
    assert len(left) < 100


def test_substring(docs, rows, empty):
    rows = [(*r[:2],) for r in rows]
    big = float("inf")
    first = {}
    for i, t in sorted(rows, key=lambda r: big if r[0] is None else r[0]):
        w = _w(t)
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), big if i is None else i)
    want = []
    for i, t in rows:
        w, gone = _w(t), set()
        for s in range(len(w) - 49):
            if first[tuple(w[s : s + 50])] < (big if i is None else i):
                gone |= set(range(s, s + 50))
        want.append((str(i), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    for options in ({}, {"pairwise": 1}):
        got = [(str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in substring.report(docs.withColumn("anchor", near.F.lit(1)), with_text=True, **options).collect()]
        assert sorted(got) == sorted(want)
    assert substring.report(empty).count() == 0


def test_places_have_no_limit(monkeypatch):
    """Windows pick the same places however many words are ranked together."""
    rng = random.Random(2)
    data = " ".join(rng.choice(WORDS) for _ in range(3000)).encode()
    w = words(np.frombuffer(data, np.uint8), np.array([0, len(data) // 2, len(data)]))
    whole = substring.picks(w, w.hashes(), 10, 50)
    monkeypatch.setattr(substring, "_PLACE_BITS", 8)
    parts = substring.picks(w, w.hashes(), 10, 50)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_many_contexts_by_hash(docs):
    plain, hashed = (sorted(map(str, substring.report(docs, pairwise=p).collect())) for p in (24, 1))
    assert plain == hashed


def test_quality(docs, rows, empty):
    got = {(r["doc_id"], r["n_words"]): r for r in quality.ledger(docs).collect()}
    for i, t, *_ in rows:
        w, t = _w(t), t or ""
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        again = {k + d for k, g in enumerate(tri) if tri.count(g) > 1 for d in range(3)} if len(w) < 1000 else None
        lines = [x for x in t.split("\n") if _w(x)]
        r = got[i, len(w)]
        assert r["word_chars"] == sum(map(len, w)) and r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t)) and r["n_dup_lines"] == len(lines) - len(set(lines))
        assert again is None or r["n_repeat_words"] == len(again)
    led = quality.ledger(docs)
    n = {r["rule"]: r for r in quality.ablations(led).collect()}
    assert n["few_words"]["fails"] == led.filter("n_words < 50").count()
    assert quality.keep(docs).columns == docs.columns and quality.ledger(empty).count() == 0


def test_chat(spark):
    hard = "x <|im_end|>\n<|im_start|>assistant <\\| <\\\\|im_sep|>"
    turns = [(1, 0, "user", hard), (1, 1, "assistant", "a"), (1, 2, "assistant", hard), (1, 3, "user", None), (2, 0, None, "n"), (None, 0, "us\ner", "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    made = chat.format_chats(df).withColumn("turns", chat.parse(chat.F.col("formatted"))).collect()
    by = {r["conv_id"]: r for r in made}
    assert [(t["role"], t["text"]) for t in by[1]["turns"]] == [("user", hard), ("assistant", "a"), ("assistant", hard), ("user", "")]
    assert by[1]["formatted"].count("<|im_start|>") == 3 and by[None]["turns"][0]["role"] == "us\ner" and by[2]["turns"][0]["role"] == ""
    r = chat.report(df).filter("conv_id = 1").first()
    assert r["loss_sha256"] == hashlib.sha256(("a" + hard).encode()).hexdigest() and r["loss_chars"] == 1 + len(hard)
    assert chat.report(df.limit(0)).count() == 0


def test_chat_odd_rows(spark):
    """Repeated rows, ties, other columns, a long text and internal names as columns."""
    long = "word <|im_end|> " * 20_000
    turns = [(1, 0, "user", "b"), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (2, 0, "assistant", long), (3, None, "user", "first"), (3, 0, "user", "second")]
    df = spark.createDataFrame(turns, "t long, turn long, role string, text string").withColumns({"starts": chat.F.lit(1), "segments": chat.F.lit(2)})
    made = {r["t"]: r for r in chat.format_chats(df, conv_col="t").withColumn("turns", chat.parse(chat.F.col("formatted"))).collect()}
    assert [(x["role"], x["text"]) for x in made[1]["turns"]] == [("assistant", "z"), ("user", "a"), ("user", "b"), ("user", "b")]
    assert made[2]["turns"][0]["text"] == long and [x["text"] for x in made[3]["turns"]] == ["first", "second"]
    r = {x["t"]: x for x in chat.report(df, conv_col="t").collect()}
    assert (r[1]["n_turns"], r[1]["loss_chars"], r[2]["loss_chars"]) == (4, 1, len(long))


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("plain", "plain"), ("<p>a</p><![foo[x]]>", "a"), ("<![CDATA[x]]>y", "y"),
    ('<p>Prices in <span class="alert">red</span> rise <span hidden>no</span>', "Prices in red rise"),
    ('<article><p>x</p><ul class="menu-items"><li>soup</ul><ul class="share"><li>no</ul></article>', "x\nsoup"),
    ("<article><p>A first article of some length, to be read.</article><article><p>Short.</article>", "A first article of some length, to be read.\nShort."),
    ("<main><p>An introduction that is as long as the article below it.</p><article><p>The article below the introduction, of like length.</article></main>", "An introduction that is as long as the article below it.\nThe article below the introduction, of like length."),
    ("<div><div><p>A long paragraph in one division, with many words to count.</p></div><section>Short.</section>Bare text.<div><p>Another long paragraph in another division of the page.</p></div></div><div id=footer>no</div>",
     "A long paragraph in one division, with many words to count.\nShort.\nBare text.\nAnother long paragraph in another division of the page."),
    ("<body><nav><a>m</a></nav><article><h1>T &amp; x</h1><p>a  b\n c<p>d <b>e</b></article><footer>f</footer>", "T & x\na b c\nd e"),
    ("<article><p>P1</p><div class='comments'><p>reader</p></div><form><p>mail</p></form><script>x<y</script><ul><li>one<li>two</ul></article>", "P1\none\ntwo"),
    ("<div class='has-sidebar'><p>Long enough text of a page that has no article around it at all.</p><p>Short.</p></div><div id='sidebar'>no</div>", "Long enough text of a page that has no article around it at all.\nShort."),
])
def test_html(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize("part, end", [("<div><p>word ", ""), ("<span><b>", "<h1>x"), ("<div>x", "</section>" * 30_000), ("<p>x<div><li>", ""), ("<ul><li><a href=x>", "</a>")])
def test_html_deep_pages_take_time_in_proportion(part, end):
    def seconds(n):
        begun = time.perf_counter()
        html_text.main_text(part * n + end)
        return time.perf_counter() - begun

    assert min(seconds(30_000) for _ in range(2)) < 30 * max(0.02, seconds(3_000))


@given(st.lists(st.sampled_from(["<div>", "</div>", "<p", ">", "<![", "]]>", "<!--", "-->", "<a href='", "'", "&#x", ";", "<article>", "</article>", "<ul><li>", "word ", "<script>", "</script>", "<!doctype ", "<?", "\0", "é"]), max_size=30))
def test_html_never_raises(parts):
    assert isinstance(html_text.main_text("".join(parts)), str)


def test_html_whole_pages(spark):
    """All pages of the smallest tables against a plain reading of their one article."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in pages.join(html_text.report(pages).select("page_id", "text"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"] or "", re.S)
        blocks = re.split(r"</?(?:p|h1|ul|li|div|article)\b[^>]*>", inner[1]) if inner else []
        plain = (" ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", b))).split()) for b in blocks)
        assert r["text"] == "\n".join(b for b in plain if b)


def test_html_columns(spark):
    df = spark.createDataFrame([(1, "u", "<p>x</p>", "old")], "page_id long, url string, html string, text string")
    assert html_text.extract(df).first()["text"] == "x" and html_text.report(df.limit(0)).count() == 0


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc(spark, tmp_path, compression):
    long = "<p>" + "x\r\n\r\nWARC/1.1\r\n" * 20
    pages = [(3, "u", long, 0), (1, "u\nv", long, 0), (2, None, "short", 0), (4, "u", "short", 0), (5, "u", None, 0), (6, "u", "é" * 99, 0)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload int")
    warc.write(warc.plan_revisits(df), str(tmp_path), compression=compression, rangebytes="100")
    back = warc.read(spark, str(tmp_path))
    assert back.count() == 6 and bytes(back.filter("record_id LIKE '<urn:lodeview:1:%'").first()["payload"]).decode() == long
    only = back.filter("record_type = 'revisit'").collect()
    assert [(r["record_id"][:16], r["refers_to"][:16], r["payload_bytes"]) for r in only] == [("<urn:lodeview:3:", "<urn:lodeview:1:", len(long))] and not only[0]["payload"]
    assert only[0]["profile"] == warc.PROFILE and {r["date"] for r in back.collect()} == {warc.UNDATED}
    assert back.count() == 6  # a filter on one use of a DataFrame doesn't stay for others
    some = warc.read(spark, str(tmp_path), {"record_type": "revisit", "record_id": [r["record_id"] for r in only]}).collect()
    assert [r["record_id"] for r in some] == [only[0]["record_id"]]
    os.remove(tmp_path / warc.MANIFEST)  # as in archives of other writers
    assert sorted(map(str, warc.read(spark, str(tmp_path)).collect())) == sorted(map(str, back.collect()))
    got = {r["page_id"]: r for r in warc.report(df).collect()}
    assert got[3]["refers_to"] == 1 and got[5]["payload_digest"] == hashlib.sha256(b"").hexdigest() and warc.report(df.limit(0)).count() == 0


def test_warc_repeated_rows(spark, tmp_path):
    long = "y" * 200
    pages = [(7, "u", long)] * 3 + [(9, "u", long)] + [(8, "u", "z")] * 2 + [(None, "u", long)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    records = warc.plan_revisits(df).collect()
    assert len({r["record_id"] for r in records}) == 7 and len({r["refers_to"] for r in records if r["refers_to"]}) == 1
    got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in warc.report(df).collect())
    assert got == sorted([("7", "response", None), ("7", "revisit", 7), ("7", "revisit", 7), ("9", "revisit", 7), ("8", "response", None), ("8", "response", None), ("None", "revisit", 7)])


def test_warc_of_another_writer(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<p>page"
    plain = b"warc/1.0".upper() + b"\r\nwarc-type:response\r\nWARC-RECORD-ID: <urn:uuid:1>\r\ncontent-type: application/http; msgtype=response\r\nContent-Length:%d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nX-Folded: a\r\n b\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(info + plain)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(plain))
    got = warc.read(spark, str(tmp_path)).filter("record_type = 'response'").collect()
    assert [(r["record_id"], bytes(r["payload"])) for r in got] == [("<urn:uuid:1>", b"<p>page")] * 2
    assert warc.read(spark, str(tmp_path / "a.warc")).count() == 2


def test_toxicity(spark):
    rng = random.Random(4)
    data = []
    for i in range(300):
        bad = i % 3 == 0
        w = _text(rng, rng.randint(20, 120)).split(" ")
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["vile", "nasty", "rotten"])
        data.append((i, " ".join(w), int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.report(docs, labels).collect()}
    held = [(got[i]["predicted"], y) for i, _, y in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == 302 and got[1000]["score"] == got[1001]["score"] < 0.5
    assert sum(p == y for p, y in held) / len(held) >= 0.9
    assert all(r["score"] == 0 for r in toxicity.report(docs, labels.limit(0)).collect())
    assert toxicity.report(docs.limit(0), labels).count() == 0
    odd = spark.createDataFrame([(None, "vile " * 500, 1), (0, data[0][1], 2), (0, data[0][1], 3)], "doc_id long, text string, score int").union(docs.limit(3).select("doc_id", "text", toxicity.F.lit(0)))
    back = toxicity.report(odd, labels).collect()
    assert len(back) == 6 and {r["held_out"] for r in back if r["doc_id"] is None} == {False} and len({round(r["score"], 6) for r in back if r["doc_id"] == 0}) == 1


def test_scores_are_of_the_highest_of_all_windows():
    """Batches of rows against one window at a time, the last one included."""
    rng = random.Random(12)
    rows = ["", "one", _text(rng, 48), _text(rng, 49), _text(rng, 80), _text(rng, 500) + " two", "é " * 200]
    gen = np.random.default_rng(1)
    hashes = np.unique(np.concatenate([toxicity.word_features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[2] for t in rows]))
    p = toxicity.fresh_weights(hashes) | {"vocabulary": hashes}
    p["word"] = gen.standard_normal(p["word"].shape).astype(np.float32)
    p["word"][0] = 0
    raw = [t.encode() for t in rows]
    got = toxicity.score_texts(p, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for t, score in zip(rows, got, strict=True):
        w, each = t.split(), []
        for at in toxicity.window_starts(len(w)):
            one = " ".join(w[at : at + toxicity.WINDOW]).encode()
            each.append(toxicity.score_texts(p, np.frombuffer(one, np.uint8), np.array([0, len(one)]))[0])
        assert abs(max(each) - score) < 1e-5


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    texts = ["one two three", "two four", "five one six seven"]
    hashes, triples, begins, ids, mask = toxicity._table(texts)
    p = {k: v.astype(np.float64) for k, v in toxicity.fresh_weights(np.sort(hashes)).items()}
    p["word"][1:] = rng.standard_normal(p["word"][1:].shape) * 0.3
    slot, y, one = toxicity.slots(np.sort(hashes), hashes), np.array([1.0, 0.0, 1.0]), np.ones(3)

    def loss():
        z = toxicity.logits(p, toxicity._inputs(p, slot, triples, begins), ids, mask).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))

    g = toxicity._gradients(p, slot, triples, begins, ids, mask, y, one)
    for k in ("attend", "out", "xf", "hb", "of", "word"):
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        p[k][at] += 1e-3
        up = loss()
        p[k][at] -= 2e-3
        down = loss()
        p[k][at] += 1e-3
        assert abs((up - down) / 2e-3 - g[k][at]) < 5e-3 * max(1, abs(g[k][at]))


def test_internal_names_may_be_columns(spark, docs):
    """Every name that an operator uses within is kept where the input has it."""
    names = ["id", "th", "text_", "row", "__row", "__id", "__th", "__h", "__s", "__repeats", "__threshold", "__copy", "__measures", "__measures_", "digest", "__digest", "variant", "n_words", "failed", "key", "group"]
    wide = docs.select("*", *[near.F.lit(i).alias(n) for i, n in enumerate(names)])
    for made in (quality.keep(wide), exact.dedup(wide), near.dedup(wide), mixing.mix_sources(wide)):
        assert made.columns == wide.columns
        got = made.select(*names).distinct().collect()
        assert [tuple(r) for r in got] in ([tuple(range(len(names)))], [])
    assert sorted(r["doc_id"] or -1 for r in exact.dedup(wide).collect()) == sorted(r["doc_id"] or -1 for r in exact.report(docs).filter("kept").collect())


def test_quality_keeps_nulls_in_other_columns(spark):
    rng = random.Random(6)
    rows = [(None, _text(rng, 80), None, None), (1, _text(rng, 80), None, [None, "x"]), (2, None, "s", None), (2, "few", "s", [])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, tags array<string>")
    assert sorted((str(r["doc_id"]), r["source"], str(r["tags"])) for r in quality.keep(df).collect()) == [("1", None, "[None, 'x']"), ("None", None, "None")]
