"""Substring dedup by seed and extend.

A window is ``window`` consecutive words of one document. Each word goes that is
covered by a window whose words also start in a document with a smaller id.

Seeds are anchors: k-mers of words picked by winnowing, so that every window
holds at least one whole anchor and equal windows hold equal ones. Documents are
joined on anchors, and a match is extended to both sides by as much as a window
through the anchor can reach (``window - k`` words each way). Extending every
pair of occurrences would be quadratic in how often a passage comes, so

* occurrences with identical surroundings are one class: in all documents but
  the class's smallest the whole surroundings are covered;
* of each class only its smallest document is extended, against the smallest
  documents of the anchor's other classes;
* an anchor with more than ``pairwise`` classes is extended by hashes instead of
  by pairs: each class emits the windows that pick the anchor, and the smallest
  id of each window is an aggregation. Rows grow with the classes, not
  with their pairs.

Maximal repeats of at least ``window`` words are marked per document and merged,
and their words removed. Texts are read whole; nothing is capped.

Defined cases: a null text has no words; a null id counts as larger than any;
documents under ``window`` words stay whole; rows with one id don't match each
other, as neither id is smaller, nor do rows with null ids; further columns are
not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, release
from ._vec import Runs, U, Words, pieces, same_row, signed, words

_PLACE_BITS = 20  # places that are ranked together, in the low bits of a k-mer's hash


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values, by doubling."""
    width, out = 1, x
    while 2 * width <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    if width < n:
        out = np.minimum(out[: len(out) - (n - width)], out[n - width :])
    return out


def picks(w: Words, hashes: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, places): each window within a row, in order, and the place of its smallest k-mer, the last one of equals."""
    n, span = len(hashes) - window + 1, window - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = Runs(hashes).windows(k)
    low, step = U((1 << _PLACE_BITS) - 1), (1 << _PLACE_BITS) - span
    out = np.empty(n, np.int64)
    for lo in range(0, n, step):  # places are numbered from the part's start, so a text may have any length
        hi = min(n, lo + step)
        part = grams[lo : hi + span - 1]
        least = _sliding_min((part & ~low) | (low - np.arange(len(part), dtype=np.int64).astype(U)), span)
        out[lo:hi] = lo + (low - (least & low)).astype(np.int64)
    starts = np.flatnonzero(same_row(w, window))
    return starts, out[starts]


def anchors(w: Words, hashes: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(word places, hashes) of the k-mers that are smallest in some window."""
    at = np.unique(picks(w, hashes, k, window)[1])
    return at, Runs(hashes).of(at, at + k)


def _document_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(ord, th, text): the id as it is compared, and a hash of the text that tells rows of one id apart."""
    biggest = F.lit((1 << 63) - 1)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), biggest).alias("ord"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))


def occurrences(keyed: DataFrame, *, k: int, window: int) -> DataFrame:
    """Anchors with their surroundings: (anchor, around, ord, th, place, left, right) in words."""
    reach = window - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches, "text"):
            w = words(data, offsets)
            hashes = w.hashes()
            at, gram = anchors(w, hashes, k, window)
            row = w.row[at]
            lo = np.maximum(w.first[row], at - reach)
            hi = np.minimum(w.first[row + 1], at + k + reach)
            around = Runs(hashes, second=True).of(lo, hi) ^ (at - lo).astype(U)
            pick = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(gram)), pa.array(signed(around)), rows.column(0).take(pick), rows.column(1).take(pick),
                    pa.array((at - w.first[row]).astype(np.int32)), pa.array((at - lo).astype(np.int16)), pa.array((hi - at).astype(np.int16)),
                ],
                ["anchor", "around", "ord", "th", "place", "left", "right"],
            )

    return keyed.mapInArrow(run, "anchor long, around long, ord long, th long, place int, left short, right short")


def _cut(data: np.ndarray, w: Words, lo: int, hi: int) -> str:
    return b" ".join(data[w.start[i] : w.end[i]].tobytes() for i in range(lo, hi)).decode("utf-8", "replace")


def surroundings(keyed: DataFrame, wanted: DataFrame, *, k: int, window: int) -> DataFrame:
    """For (anchor, around, ord, th, place, left, right): the words left and right of the anchor as text, and the least and most words before it in a window that picks it."""
    per_text = wanted.groupBy("ord", "th").agg(F.collect_list(F.struct("anchor", "around", "place", "left", "right", "many")).alias("asked"))  # bounded by the text's own anchors
    joined = keyed.join(per_text.withColumnsRenamed({"ord": "o", "th": "h"}), (F.col("ord") == F.col("o")) & (F.col("th") == F.col("h"))).select("ord", "text", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches, "text"):
            w = words(data, offsets)
            starts, places = picks(w, w.hashes(), k, window)
            ords = rows.column(0).to_pylist()
            out: list[tuple] = []
            for i, asked in enumerate(rows.column(2).to_pylist()):
                first = int(w.first[i])
                for x in asked:
                    at = first + x["place"]
                    one, last = starts[np.searchsorted(places, at)], starts[np.searchsorted(places, at, "right") - 1]
                    out.append((x["anchor"], x["around"], ords[i], _cut(data, w, at - x["left"], at), _cut(data, w, at + k, at + x["right"]), x["many"], int(at - last), int(at - one)))
                if len(out) > 20_000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        c = list(zip(*out, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds, strict=True)], ["anchor", "around", "ord", "before", "after", "many", "least", "most"])

    return joined.mapInArrow(run, "anchor long, around long, ord long, before string, after string, many boolean, least int, most int")


def _words(text: str) -> list[str]:
    return text.split(" ") if text else []


def _shared(a: list[str], b: list[str]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def extend_pairs(classes: DataFrame, *, k: int, window: int) -> DataFrame:
    """(class, left, right): matches of each class with classes of smaller ids, from rows with all classes of an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for anchor, group in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                split = [(x["ord"], x["around"], _words(x["before"])[::-1], _words(x["after"])) for x in group]
                for o, around, before, after in split:
                    found = set()
                    for o2, _, before2, after2 in split:
                        if o2 < o:
                            left, right = _shared(before, before2), _shared(after, after2)
                            if left + k + right >= window:
                                found.add((left, right))
                    out += [(anchor, around, left, k + right) for left, right in found]
            c = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, (pa.int64(), pa.int64(), pa.int16(), pa.int16()), strict=True)], ["anchor", "around", "left", "right"])

    return classes.mapInArrow(run, "anchor long, around long, left short, right short").select(F.xxhash64("anchor", "around").alias("class"), "left", "right")


def extend_hashed(classes: DataFrame, *, k: int, window: int) -> DataFrame:
    """The same for anchors with many classes: the windows that pick the anchor, by hash, and each window's smallest id.

    Equal windows pick the same place, so each is emitted once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for anchor, around, ord_, before, after, least, most in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                left, right = _words(before), _words(after)
                for j in range(least, most + 1):
                    text = " ".join(left[len(left) - j :]) + "\n" + " ".join(right[: window - k - j])
                    out.append((around, ord_, j, hashlib.blake2b(b"%d\n" % anchor + text.encode(), digest_size=16).digest()))
            c = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int16(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds, strict=True)], ["class", "ord", "left", "window"])

    keyed = classes.select("anchor", F.xxhash64("anchor", "around").alias("class"), "ord", "before", "after", "least", "most")
    emitted = keyed.mapInArrow(run, "class long, ord long, left short, window binary")
    sizes = emitted.groupBy("window").agg(F.min("ord").alias("least"), F.max("ord").alias("most"))
    # stored: a join between plain exchanges can split a window that comes in very many documents
    least = materialize(sizes.filter("least < most").select(F.col("window").alias("wi"), "least"), "repeated-windows")
    met = emitted.join(least, F.col("window") == F.col("wi")).filter("least < ord")
    return met.select("class", "left", (F.lit(window) - F.col("left")).cast("short").alias("right"))


def repeats(keyed: DataFrame, *, window: int = 50, k: int = 10, pairwise: int = 24) -> DataFrame:
    """(ord, th, spans): for each text with any, the word ranges [start, end) that repeat earlier documents."""
    seen = materialize(occurrences(keyed, k=k, window=window), "anchors")
    # what is joined is stored first, here and below: a join between plain exchanges can split a frequent anchor
    shared = materialize(seen.groupBy("anchor").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).filter("lo < hi").select(F.col("anchor").alias("an")), "shared")
    hits = materialize(seen.join(shared, F.col("anchor") == F.col("an")).drop("an"), "shared-anchors")
    release(seen)
    classes = materialize(hits.groupBy("anchor", "around").agg(F.min("ord").alias("lead")), "classes")
    counted = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("lead").alias("least")).filter("n > 1").select(F.col("anchor").alias("an"), (F.col("n") > pairwise).alias("many"), "least")
    counted = materialize(counted, "anchors-of-several-classes")
    leads = hits.join(classes.withColumnsRenamed({"anchor": "ca", "around": "cr"}), (F.col("anchor") == F.col("ca")) & (F.col("around") == F.col("cr"))).drop("ca", "cr")
    whole = leads.filter("ord > lead AND left + right >= " + str(window))
    mine = leads.filter("ord = lead")
    # one occurrence stands for its class: the others have the same surroundings
    stand = mine.groupBy("anchor", "around", "ord", "th", "left", "right").agg(F.min("place").alias("place"))
    stand = stand.join(counted, F.col("anchor") == F.col("an")).drop("an")
    context = materialize(surroundings(keyed, stand, k=k, window=window), "surroundings")
    few = context.filter("NOT many").groupBy("anchor").agg(F.collect_list(F.struct("ord", "around", "before", "after")).alias("classes"))  # ``pairwise`` at most
    grown = extend_pairs(few, k=k, window=window).union(extend_hashed(context.filter("many"), k=k, window=window))
    grown = grown.withColumnsRenamed({"class": "gc", "left": "gl", "right": "gx"})
    partly = mine.join(grown, F.xxhash64("anchor", "around") == F.col("gc")).select("ord", "th", "place", F.col("gl").alias("left"), F.col("gx").alias("right"))
    marks = whole.select("ord", "th", "place", "left", "right").union(partly)
    spans = F.struct((F.col("place") - F.col("left")).cast("int").alias("start"), (F.col("place") + F.col("right")).cast("int").alias("end"))
    return marks.select("ord", "th", spans.alias("span")).groupBy("ord", "th").agg(F.collect_list("span").alias("spans"))  # bounded by the text's own anchors


def _kept(w: Words, first: int, last: int, spans: list[dict] | None) -> np.ndarray:
    cover = np.zeros(last - first + 1, np.int64)
    for s in spans or ():
        cover[s["start"]] += 1
        cover[s["end"]] -= 1
    return np.cumsum(cover[:-1]) == 0


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50, with_text: bool = False, **options: int) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256 (and the kept words, joined by one space)."""
    keyed = _document_key(docs, id_col, text_col)
    spans = repeats(keyed, window=window, **options).withColumnsRenamed({"ord": "o", "th": "h"})
    joined = keyed.join(spans, (F.col("ord") == F.col("o")) & (F.col("th") == F.col("h")), "left").select("ord", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches, "text"):
            w = words(data, offsets)
            n, removed, digests, texts = [], [], [], []
            for i, found in enumerate(rows.column(2).to_pylist()):
                first, last = int(w.first[i]), int(w.first[i + 1])
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                every = raw.split()
                if found:
                    keep = _kept(w, first, last, found)
                    every = [x for x, k in zip(every, keep.tolist(), strict=True) if k]
                text = b" ".join(every)
                n.append(last - first)
                removed.append(last - first - len(every))
                digests.append(hashlib.sha256(text).hexdigest())
                texts.append(text if with_text else b"")
            columns = [rows.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["ord", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names)

    out = joined.mapInArrow(run, "ord long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else ""))
    ids = F.when(F.col("ord") < (1 << 63) - 1, F.col("ord")).alias(id_col)
    return out.select(ids, *out.columns[1:])
