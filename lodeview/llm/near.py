"""Near dedup by order min-hashing, candidates verified by banded alignment.

A document's k-mers are its runs of five words, labelled with the number of the
occurrence in the document, so repeats count. Each of ``tables`` hash functions
samples the ``sample`` k-mers with the smallest values and keeps them *in text
order*: two texts agree on a sketch of several if they share its k-mers and have
them in the same order, which follows edit similarity where plain min-hash
follows sets only. Two documents are linked when 1 - edit distance in words /
words of the longer is at least ``similarity``; the distance is exact, from an
alignment banded to the largest distance that the threshold allows.

Identical word sequences are one class before the search, so a thousand copies
cost one representative. The search is a series of turns, each of which compares
representatives that are not in one group yet:

* turn 0 pairs each representative with one leader, the one it meets in most
  buckets of its smallest k-mers. This joins families at a pair a member;
* turn 1 takes the buckets that still hold several groups. A bucket of at most
  ``small`` gives all its pairs, a larger one pairs each member with its leaders
  and deals its members on to buckets by the next k-mer of the same sketch, level
  by level, each level in the same way;
* later turns pair the members of large buckets that still hold several groups
  with other leaders, as long as at least one in WORTH of the pairs with leaders
  that were compared in the turn before was a link;
* the last step compares what is left: all pairs of different groups in each large
  bucket, in blocks of about SIDE members. So no pair that meets in a bucket is
  passed over, whatever the bucket's size; leaders only save comparisons.

Members stay in their buckets throughout, also those linked already. A turn makes
rows in proportion to the representatives, never to the pairs of a bucket; the last
step's arithmetic grows with the pairs that are left, its rows with the pairs that
may be links. Word counts and histograms of words, which bound the edit distance
from below, rule out pairs before texts are read.

Like any hashing scheme it can miss texts that meet in no bucket. Edits scattered over a share of 0.2 of the
words leave about a fifth of five-word k-mers in common; the module's tests
measure what is found, also where all texts share a passage. Texts under five
words are one k-mer each and so match as copies only.

Defined cases: a null text is empty, and empty texts are copies of each other;
rows with a null id are searched and grouped like others, but name a group only
if no member has an id; rows that share an id but not the text are different
documents; repeated rows are copies; an empty table gives an empty result;
further columns are not read, whatever their names. The smallest id of a group
names it and stays (of several texts under this id the one with the smallest
hash; of repeated rows one).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exact
from ._shared import materialize, release, unused
from ._vec import Runs, U, mix, pieces, salt, signed, words
from .components import components, joined

WORDS_PER_KMER = 5
#: Bins of a text's histogram of words; counts stop at 255, which keeps them a bound.
BINS = 128
#: Rows of an alignment that are computed at once, as bits.
BLOCK = 4096
#: Leaders of a large bucket in each turn after the first.
LEADERS = 4
#: Turns go on while one in so many pairs with leaders that are compared links.
WORTH = 50
#: Bins of the histograms of members of large buckets; a multiple of BINS.
FINE = 1024
#: Members of a block of a large bucket, about.
SIDE = 2048


def labelled_kmers(row: np.ndarray, hashes: np.ndarray, rows: int, k: int = WORDS_PER_KMER) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled k-mer hashes in text order and rows + 1 bounds; a text under k words is one k-mer."""
    counts = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(counts)])
    runs = Runs(hashes)
    length = np.minimum(counts, k)
    each = np.where(counts > 0, counts - length + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(each)])
    owner = np.repeat(np.arange(rows), each)
    start = np.arange(bounds[-1]) - bounds[:-1][owner] + first[:-1][owner]
    kmers = runs.of(start, start + length[owner])
    own = mix(kmers + owner.astype(U) * salt(11))
    order = np.argsort(own, kind="stable")
    ordered = own[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    at = np.flatnonzero(fresh)
    nth = np.empty(len(own), np.int64)
    nth[order] = np.arange(len(own)) - np.repeat(at, np.diff(np.append(at, len(own))))
    return mix(kmers + nth.astype(U) * salt(12)), bounds


def sketches(kmers: np.ndarray, bounds: np.ndarray, tables: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows with k-mers) x tables keys of the smallest k-mer, and x (sample - 1) x tables hashes of the smallest 2, 3 ... in text order."""
    lengths = np.diff(bounds)
    starts = bounds[:-1]
    owner = np.repeat(np.arange(len(lengths)), lengths)
    keys = np.empty((len(lengths), tables), U)
    deeper = np.empty((len(lengths), sample - 1, tables), np.int32)
    none = U(0xFFFFFFFFFFFFFFFF)
    for t in range(tables):
        value = (kmers ^ salt(100 + t)) * (salt(500 + t) | U(1))
        value ^= value >> U(29)
        picked = []
        for level in range(sample):
            least = np.minimum.reduceat(value, starts)
            hit = np.flatnonzero(value == np.repeat(least, lengths))
            # ties are equal labelled k-mers only up to hash collisions: the first one counts
            whose = owner[hit]
            keep = np.ones(len(hit), bool)
            keep[1:] = whose[1:] != whose[:-1]
            hit = hit[keep]
            picked.append(np.where(least == none, np.int64(-1), hit))
            value[hit] = none
            at = np.sort(np.stack(picked, 1), axis=1)
            key = np.full(len(lengths), salt(900 + t), U)
            for j in range(level + 1):
                key = mix(key * U(0x9E3779B97F4A7C15) + np.where(at[:, j] < 0, U(1), kmers[np.maximum(at[:, j], 0)]))
            if level:
                deeper[:, level - 1, t] = (key >> U(32)).astype(np.uint32).view(np.int32)
            else:
                keys[:, t] = key
    return keys, deeper


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def sketched(docs: DataFrame, *, tables: int, sample: int) -> DataFrame:
    """For rows (id, th, text): id, th, a 128-bit digest (d1, d2) of the word sequence, words n, and if there are any the sketches and a histogram of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches, "text"):
            w = words(data, offsets)
            n, hashes = rows.num_rows, w.hashes()
            one, two = Runs(hashes), Runs(hashes, second=True)
            full = w.count > 0
            kmers, bounds = labelled_kmers(w.row, hashes, n)
            keys, deeper = np.zeros((0, tables), U), np.zeros((0, sample - 1, tables), np.int32)
            if full.any():
                keys, deeper = sketches(kmers, np.append(np.unique(bounds[:-1][full]), bounds[-1]), tables, sample)
            first, last = w.first[:-1], w.first[1:]
            bins = np.minimum(np.bincount(w.row * BINS + (hashes % U(BINS)).astype(np.int64), minlength=n * BINS), 255).astype(np.uint8)
            ends = np.arange(0, n * BINS + 1, BINS, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0), rows.column(1), pa.array(signed(one.of(first, last))), pa.array(signed(two.of(first, last))), pa.array(w.count.astype(np.int32)),
                    _lists(signed(keys.reshape(-1)), np.where(full, tables, 0)), _lists(deeper.reshape(-1), np.where(full, tables * (sample - 1), 0)),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(bins)]),
                ],
                ["id", "th", "d1", "d2", "n", "keys", "deeper", "bins"],
            )

    return docs.mapInArrow(run, "id long, th long, d1 long, d2 long, n int, keys array<long>, deeper array<int>, bins binary")


def _close(n: Column, m: Column, similarity: float) -> Column:
    """Whether word counts alone leave the similarity possible."""
    return F.abs(n - m) <= F.floor((1 - similarity) * F.greatest(n, m) + 1e-9)


def _open(rows: DataFrame, turn: int, name: str, leaders: int) -> DataFrame:
    """The rows (key, rid, n, root, ...) of buckets with several groups, with the bucket's size and leaders."""
    least = [F.min(F.struct(F.xxhash64("rid", F.lit(turn * 64 + i)).alias("h"), F.col("rid").alias("rid"), F.col("n").alias("n"), F.col("root").alias("root"))) for i in range(leaders)]
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.array_distinct(F.array(*(x.dropFields("h") for x in least))).alias("leads"))
    # stored, so that the join has a plain exchange on each side and a hot bucket can be split
    sizes = materialize(sizes.filter("lo < hi").select(F.col("key").alias("k"), "size", "leads"), f"{name}-buckets-{turn}")
    return rows.join(sizes, F.col("key") == F.col("k")).drop("k")


def _stars(met: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of each member and the leaders of its buckets, if of different groups."""
    others = F.filter("leads", lambda x: (x["root"] != F.col("root")) & _close(x["n"], F.col("n"), similarity))
    # gathered by member before they become rows: most buckets of one member have the same leaders
    each = met.select("rid", F.transform(others, lambda x: x["rid"]).alias("met")).filter(F.size("met") > 0).groupBy("rid").agg(F.flatten(F.collect_list("met")).alias("met"))  # tables x leaders at most
    each = each.select("rid", F.explode(F.array_distinct("met")).alias("other"))
    return each.select(F.least("rid", "other").alias("a"), F.greatest("rid", "other").alias("b"))


def _all_pairs(met: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of all members of different groups in buckets of bounded size."""
    held = met.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rid", "root", "n"))).alias("all"))  # ``small`` entries at most

    def after(x: Column, i: Column) -> Column:
        rest = F.filter(F.slice("all", i + 2, F.size("all")), lambda y: (y["root"] != x["root"]) & _close(x["n"], y["n"], similarity))
        return F.transform(rest, lambda y: F.struct(x["rid"].alias("a"), y["rid"].alias("b")))

    return held.select(F.explode(F.flatten(F.transform("all", after))).alias("x")).select("x.a", "x.b")


def first_pairs(reps: DataFrame, *, similarity: float) -> DataFrame:
    """(a, b, star): each representative with the leader that it meets in most buckets."""
    rows = reps.select("rid", "n", F.col("rid").alias("root"), F.explode("keys").alias("key"))
    met = _open(rows, 0, "first", 1).select("rid", "n", F.element_at("leads", 1).alias("lead")).filter((F.col("rid") != F.col("lead.rid")) & _close(F.col("n"), F.col("lead.n"), similarity))
    best = met.groupBy("rid").agg(F.mode(F.col("lead.rid"), True).alias("other"))
    return best.select(F.least("rid", "other").alias("a"), F.greatest("rid", "other").alias("b"), F.lit(True).alias("star"))


def further_pairs(reps: DataFrame, roots: DataFrame, *, tables: int, sample: int, small: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(a, b, star) of turn 1, and the rows (key, rid, n) of large buckets with several groups."""
    rooted = reps.join(roots.withColumnRenamed("id", "r"), F.col("rid") == F.col("r"), "left").select("rid", "n", F.coalesce("root", "rid").alias("root"), "keys", "deeper")
    each = [F.get("deeper", F.col("t") + F.lit(level * tables)).alias(f"s{level}") for level in range(sample - 1)]
    rows = rooted.select("rid", "n", "root", "deeper", F.posexplode("keys").alias("t", "key")).select("key", "rid", "n", "root", *each)
    found, large = [], None
    for level in range(sample):
        met = materialize(_open(rows, 1, f"level-{level}", LEADERS), f"open-{level}")
        many = met.filter(F.col("size") > small)
        found += [_all_pairs(met.filter(F.col("size") <= small), similarity).withColumn("star", F.lit(False)), _stars(many, similarity).withColumn("star", F.lit(True))]
        large = large if level else many.select("key", "rid", "n")
        if level + 1 < sample:
            rows = many.drop("size", "leads").withColumn("key", F.xxhash64("key", f"s{level}"))
    return reduce(DataFrame.union, found).groupBy("a", "b").agg(F.max("star").alias("star")), large


def later_pairs(large: DataFrame, roots: DataFrame, *, turn: int, similarity: float) -> DataFrame:
    """(a, b, star) of members of large buckets and leaders that differ by turn."""
    rows = large.join(roots.withColumnRenamed("id", "r"), F.col("rid") == F.col("r"), "left").select("key", "rid", "n", F.coalesce("root", "rid").alias("root"))
    return _stars(_open(materialize(rows, f"large-{turn}"), turn, "later", LEADERS), similarity).distinct().withColumn("star", F.lit(True))


def _fine(members: DataFrame) -> DataFrame:
    """members (rid, n, root, keys, text) with a histogram of words, ``fine``, in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches, "text"):
            w = words(data, offsets)
            n = rows.num_rows
            bins = np.minimum(np.bincount(w.row * FINE + (w.hashes() % U(FINE)).astype(np.int64), minlength=n * FINE), 255).astype(np.uint8)
            ends = np.arange(0, n * FINE + 1, FINE, dtype=np.int32)
            held = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(bins)])
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(4)), held], ["rid", "n", "root", "keys", "fine"])

    return members.mapInArrow(run, "rid long, n int, root long, keys array<long>, fine binary")


class _Block:
    """Members of a bucket, by word count: rid, n, root, keys below the bucket's with the member of each, histograms and coarse ones."""

    def __init__(self, members: pa.StructArray, key: int):
        field = dict(zip(("rid", "n", "root", "keys", "fine"), members.flatten(), strict=True))
        n = field["n"].to_numpy()
        order = np.argsort(n, kind="stable")
        self.n = n[order].astype(np.int64)
        self.rid, self.root = (field[x].to_numpy()[order] for x in ("rid", "root"))
        self.fine = np.frombuffer(b"".join(field["fine"].to_pylist()), np.uint8).reshape(-1, FINE)[order]
        # bins of the same remainder; a count that stops at 255 stays a bound
        self.coarse = np.minimum(self.fine.reshape(len(n), -1, BINS).sum(1, dtype=np.int64), 255).astype(np.uint8)
        place = np.empty(len(n), np.int64)
        place[order] = np.arange(len(n))
        keys, owner = field["keys"].flatten().to_numpy(), np.repeat(place, field["keys"].value_lengths().to_numpy())
        self.keys, self.owner = keys[keys < key], owner[keys < key]

    def __len__(self) -> int:
        return len(self.n)


def _met_before(x: _Block, y: _Block) -> np.ndarray:
    """For each member of x and of y, whether they share a bucket with a smaller key, which has the pair."""
    out = np.zeros((len(x), len(y)), bool)
    shared = np.intersect1d(x.keys, y.keys)
    for at in range(0, len(shared), 1024):
        some, sides = shared[at : at + 1024], []
        for side in (x, y):
            has = np.isin(side.keys, some)
            holds = np.zeros((len(side), len(some)), np.float32)
            holds[side.owner[has], np.searchsorted(some, side.keys[has])] = 1
            sides.append(holds)
        out |= sides[0] @ sides[1].T > 0
    return out


def _least(x: np.ndarray, y: np.ndarray, common: np.ndarray) -> np.ndarray:
    """What the larger histogram has over the other, from the sums of both and of what they have in common."""
    return np.maximum(x, y) - common


def _block_pairs(x: _Block, y: _Block, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in x and y of the pairs of different groups that meet here first and that histograms don't rule out; x and y may be one block."""
    before, found = _met_before(x, y), [np.zeros((2, 0), np.int64)]
    sums = [(b.coarse.sum(1, dtype=np.int64), b.fine.sum(1, dtype=np.int64)) for b in (x, y)]
    columns = np.ascontiguousarray(y.coarse.T)
    for i in range(0, len(x), 256):
        a = slice(i, min(i + 256, len(x)))
        # a little wider than word counts allow, the exact rule follows
        low, high = np.searchsorted(y.n, [similarity * x.n[a][0] - 1, (x.n[a][-1] + 1) / similarity + 1])
        for j in range(max(low, i) if x is y else low, high, 1024):
            b = slice(j, min(j + 1024, high))
            longer = np.maximum(x.n[a][:, None], y.n[b])
            most = np.floor((1 - similarity) * longer + 1e-9)
            open_ = (x.root[a][:, None] != y.root[b]) & (np.abs(x.n[a][:, None] - y.n[b]) <= most) & ~before[a, b]
            if x is y:
                open_ &= np.arange(a.start, a.stop)[:, None] < np.arange(b.start, b.stop)
            if not open_.any():
                continue
            common = np.zeros(open_.shape, np.uint16)  # BINS x 255 at most
            for k in range(BINS):
                common += np.minimum(x.coarse[a, k][:, None], columns[k, b])
            p, q = np.nonzero(open_ & (_least(sums[0][0][a][:, None], sums[1][0][b], common) <= most))
            for at in range(0, len(p), 4096):
                r, s = p[at : at + 4096], q[at : at + 4096]
                both = np.minimum(x.fine[a][r], y.fine[b][s]).sum(1, dtype=np.int64)
                keep = _least(sums[0][1][a][r], sums[1][1][b][s], both) <= most[r, s]
                found.append(np.stack([r[keep] + a.start, s[keep] + b.start]))
    return tuple(np.concatenate(found, axis=1))


def rest_pairs(large: DataFrame, roots: DataFrame, reps: DataFrame, texts: DataFrame, *, similarity: float) -> DataFrame | None:
    """(a, b, star) of all members of different groups in large buckets that histograms don't rule out; None if each bucket is one group.

    A bucket of more than SIDE members is cut by word count into classes, of which a text and its near copies are in the
    same or in adjacent ones, and a class by hash into parts. Each two parts meet in a row of their own. A pair that
    shares several buckets is given by the one with the smallest key.
    """
    rows = large.join(roots.withColumnRenamed("id", "r"), F.col("rid") == F.col("r"), "left").select("key", "rid", "n", F.coalesce("root", "rid").alias("root"))
    rows = materialize(rows, "rest")
    sizes = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select(F.col("key").alias("k"), "size"), "rest-buckets")
    if sizes.isEmpty():
        return None
    by_length = F.floor(F.log("n") / float(np.log(1.01 / similarity)))
    rows = materialize(rows.join(sizes, F.col("key") == F.col("k")).select("key", "rid", "n", "root", F.when(F.col("size") > SIDE, by_length).otherwise(0).alias("class")), "rest-open")

    members = rows.groupBy("rid").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.collect_list("key").alias("keys"))  # ``tables`` keys at most
    at = members.join(reps.select(F.col("rid").alias("r"), F.col("id").alias("i"), F.col("th").alias("t")), F.col("rid") == F.col("r")).select("rid", "n", "root", "keys", "i", "t")
    at = materialize(at, "rest-members")
    fine = materialize(_fine(at.join(texts, F.col("i").eqNullSafe(F.col("id")) & (F.col("t") == F.col("th"))).select("rid", "n", "root", "keys", "text")), "rest-histograms")

    # numbers of parts of a class, of the one above and of the one below
    parts = materialize(rows.groupBy("key", "class").agg(F.ceil(F.count(F.lit(1)) / SIDE).alias("parts"), F.count(F.lit(1)).alias("held")), "rest-parts")
    near_by = [parts.select("key", (F.col("class") - i).alias("class"), "parts", "held", F.lit(i).alias("of")) for i in (0, 1, -1)]
    counts = [F.coalesce(F.max(F.when(F.col("of") == i, F.col("parts"))), F.lit(0)).alias(name) for i, name in ((0, "parts"), (1, "above"), (-1, "below"))]
    near_by = reduce(DataFrame.union, near_by).groupBy("key", "class").agg(*counts, F.max(F.when(F.col("of") == 0, F.col("held"))).alias("held")).filter("parts > 0")
    near_by = materialize(near_by.select(F.col("key").alias("k"), F.col("class").alias("c"), "parts", "above", "below", "held"), "rest-classes")
    copies = near_by.agg(F.sum(F.col("held") * (F.col("parts") + F.col("above") + F.col("below")))).first()[0]
    tasks = 1 + copies // 8192  # of some 10 MB: what a worker gets at once
    placed = rows.join(near_by, (F.col("key") == F.col("k")) & (F.col("class") == F.col("c"))).select("key", "class", "parts", "above", "below", F.pmod(F.xxhash64("rid", "key"), F.col("parts")).alias("part"), "rid")
    placed = placed.join(fine.withColumnRenamed("rid", "r"), F.col("rid") == F.col("r"))
    blocks = placed.groupBy("key", "class", "parts", "above", "below", "part").agg(F.collect_list(F.struct("rid", "n", "root", "keys", "fine")).alias("members"))  # about SIDE

    def upto(first: Column, end: Column) -> Column:
        return F.when(first < end, F.sequence(first, end - 1)).otherwise(F.array().cast("array<long>"))

    def task(lower: Column | str, up: int, one: Column, two: Column) -> Column:
        return F.struct(F.col("key").alias("key"), lower.cast("long").alias("class"), F.lit(up).alias("up"), one.cast("long").alias("one"), two.cast("long").alias("two"))

    part, class_ = F.col("part"), F.col("class")
    left = F.concat(F.transform(upto(part, F.col("parts")), lambda x: task(class_, 0, part, x)), F.transform(upto(F.lit(0).cast("long"), F.col("above")), lambda x: task(class_, 1, part, x)))
    right = F.concat(F.transform(upto(F.lit(0).cast("long"), part), lambda x: task(class_, 0, x, part)), F.transform(upto(F.lit(0).cast("long"), F.col("below")), lambda x: task(class_ - 1, 1, x, part)))
    lefts = blocks.select(F.explode(left).alias("task"), F.col("members").alias("left")).select("task.key", "task", "left").repartition(tasks, "task")
    rights = blocks.select(F.explode(right).alias("with"), F.col("members").alias("right")).repartition(tasks, "with")
    met = lefts.join(rights, F.col("task") == F.col("with"), "left").select("key", "left", "right")  # a part with itself has no right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column(0)[i].as_py()
                x = _Block(batch.column(1)[i].values, key)
                y = _Block(batch.column(2)[i].values, key) if batch.column(2)[i].is_valid else x
                p, q = _block_pairs(x, y, similarity)
                a, b = x.rid[p], y.rid[q]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.zeros(len(a), bool))], ["a", "b", "star"])

    return met.mapInArrow(run, "a long, b long, star boolean")


def possible(pairs: DataFrame, reps: DataFrame, *, similarity: float) -> DataFrame:
    """The pairs (a, b, star) that histograms of reps don't rule out, with where their texts are: (ia, ta), (ib, tb).

    An edit takes at most one word away and adds at most one, so the distance is at least what one histogram has
    over the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                longer = np.maximum(part.column(7).to_numpy(), part.column(8).to_numpy())
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16) for c in (9, 10))
                off = x - y
                least = np.maximum(np.maximum(off, 0).sum(1), np.maximum(-off, 0).sum(1))
                keep = least <= np.floor((1 - similarity) * longer + 1e-9)
                yield part.select(range(7)).filter(pa.array(keep))

    def side(x: str) -> DataFrame:
        return reps.select(F.col("rid").alias(f"r{x}"), F.col("id").alias(f"i{x}"), F.col("th").alias(f"t{x}"), F.col("n").alias(f"n{x}"), F.col("bins").alias(f"bins_{x}"))

    both = pairs.join(side("a"), F.col("a") == F.col("ra")).join(side("b"), F.col("b") == F.col("rb"))
    both = both.select("a", "b", "star", "ia", "ta", "ib", "tb", "na", "nb", "bins_a", "bins_b")
    return both.mapInArrow(run, "a long, b long, star boolean, ia long, ta long, ib long, tb long")


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two sequences if at most ``most``, else ``most + 1``: only the band within ``most`` of the diagonal is computed.

    Bit-parallel, in blocks of rows: a column of a block is a pair of bit sets (where the distance grows or falls by one
    from row to row), and a block hands the steps along its lower edge to the next. Outside of the band steps count as
    edits, which never understates a distance.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    if not n or not m:
        return max(n, m)
    _, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    rows, columns = codes[:n].tolist(), codes[n:].tolist()
    steps: list[int] = []  # along the edge above, for columns from ``left`` on
    left = top = corner = 0  # corner: the distance at (top, left)
    while True:
        size = min(BLOCK, n - top)
        full, last = (1 << size) - 1, 1 << (size - 1)
        places: dict[int, int] = {}
        for i, x in enumerate(rows[top : top + size]):
            places[x] = places.get(x, 0) | (1 << i)
        right = min(m, top + size + most)
        grows, falls = full, 0
        out = []
        steps += [1] * (right - left - len(steps))
        for x, step in zip(columns[left:right], steps, strict=True):
            same = places.get(x, 0)
            either = same | falls
            if step < 0:
                same |= 1
            keeps = (((same & grows) + grows) ^ grows | same) & full
            up, down = falls | (full ^ (keeps | grows)), grows & keeps
            out.append(1 if up & last else -1 if down & last else 0)
            up, down = (up << 1 | (step > 0)) & full, (down << 1 | (step < 0)) & full
            grows, falls = down | (full ^ (either | up)), up & either
        at = corner + size + np.concatenate([[0], np.cumsum(out)])  # along the lower edge
        top += size
        if top == n:
            return min(int(at[-1]), most + 1)
        if at.min() > most:
            return most + 1
        ahead = max(left, top - most)
        steps, corner, left = out[ahead - left :], int(at[ahead - left]), ahead


def _rising(places: np.ndarray) -> np.ndarray:
    """Positions of a longest increasing subsequence."""
    if len(places) < 2 or (places[1:] > places[:-1]).all():
        return np.arange(len(places))
    tails: list[int] = []
    ends: list[int] = []
    before = []
    for i, x in enumerate(places.tolist()):
        k = bisect_left(tails, x)
        tails[k : k + 1] = [x]
        ends[k : k + 1] = [i]
        before.append(ends[k - 1] if k else -1)
    out, i = [], ends[-1]
    while i >= 0:
        out.append(i)
        i = before[i]
    return np.array(out[::-1])


def _small_distance(a: list[int], b: list[int]) -> int:
    """Edit distance of two short stretches, by the plain recurrence."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner if x == y else 1 + min(corner, row[j], row[j - 1])
    return row[-1]


def at_most(a: np.ndarray, b: np.ndarray, pa: np.ndarray, pb: np.ndarray, enough: int) -> int:
    """An upper bound of the edit distance: the cost of one alignment, through matching places pa, pb in order.

    Between two places, stretches of one length are compared word by word and others are rewritten; while that is
    more than ``enough``, short stretches are aligned.
    """
    n, m = len(a), len(b)
    pa, pb = np.concatenate([[-1], pa, [n]]), np.concatenate([[-1], pb, [m]])
    ga, gb = np.diff(pa) - 1, np.diff(pb) - 1
    gap = np.repeat(np.arange(len(ga)), ga + 1)[1:]
    j = np.arange(n) + (pb - pa)[gap]
    even = (ga == gb)[gap]
    off = even & (a != b[np.where(even, j, 0)]) if m else even
    cost = np.where(ga == gb, np.bincount(gap[off], minlength=len(ga)), np.maximum(ga, gb))
    total = int(cost.sum())
    if total <= enough:
        return total
    for g in np.flatnonzero((cost > 1) & (ga > 0) & (gb > 0) & (ga * gb <= 1024)).tolist():
        total += _small_distance(a[pa[g] + 1 : pa[g + 1]].tolist(), b[pb[g] + 1 : pb[g + 1]].tolist()) - int(cost[g])
        if total <= enough:
            break
    return total


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether 1 - edit distance / longer is at least ``similarity``.

    Bounds decide most pairs: word counts from below (an edit changes one word), an alignment through words that
    both have once from above. The banded alignment decides the rest.
    """
    longer = max(len(a), len(b))
    most = int(np.floor((1 - similarity) * longer + 1e-9))
    if longer - min(len(a), len(b)) > most:
        return False
    if len(a) == len(b) and np.count_nonzero(a != b) <= most:
        return True
    va, ia, ca = np.unique(a, return_index=True, return_counts=True)
    vb, ib, cb = np.unique(b, return_index=True, return_counts=True)
    at = np.searchsorted(vb, va)
    at[at == len(vb)] = 0
    both = np.flatnonzero(vb[at] == va) if len(vb) else np.zeros(0, np.int64)
    at = at[both]
    if np.minimum(ca[both], cb[at]).sum() < longer - most:
        return False
    once = (ca[both] == 1) & (cb[at] == 1)
    pa, pb = ia[both[once]], ib[at[once]]
    order = np.argsort(pa)
    pa, pb = pa[order], pb[order]
    rise = _rising(pb)
    if at_most(a, b, pa[rise], pb[rise], most) <= most:
        return True
    return edit_distance(a, b, most) <= most


def verified(pairs: DataFrame, texts: DataFrame, *, similarity: float) -> DataFrame:
    """The pairs (a, b, star) whose texts (id, th, text) are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in pieces([batch], "text_a"):
                left = words(data, offsets)
                lh, lf = left.hashes(), left.first
                done = 0
                for part, data_b, offsets_b in pieces([rows], "text_b"):
                    right = words(data_b, offsets_b)
                    rh, rf = right.hashes(), right.first
                    keep = [
                        similar(lh[lf[done + i] : lf[done + i + 1]], rh[rf[i] : rf[i + 1]], similarity) for i in range(part.num_rows)
                    ]
                    done += part.num_rows
                    yield part.select(["a", "b", "star"]).filter(pa.array(keep, pa.bool_()))

    def on(x: str) -> Column:
        return F.col(f"i{x}").eqNullSafe(F.col("id")) & (F.col(f"t{x}") == F.col("th"))

    with_b = pairs.join(texts, on("b")).select("a", "b", "star", "ia", "ta", F.col("text").alias("text_b"))
    both = with_b.join(texts, on("a")).select("a", "b", "star", F.col("text").alias("text_a"), "text_b")
    return both.mapInArrow(run, "a long, b long, star boolean")


def _name(id_: str, th: str) -> Column:
    """What orders the rows of a group: by id, null last, then by a hash of the text."""
    return F.struct(F.col(id_).isNull().alias("none"), F.col(id_).alias("id"), F.col(th).alias("th"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))


def _grouped(docs: DataFrame, *, id_col: str, text_col: str, similarity: float, tables: int, sample: int, small: int) -> tuple[DataFrame, bool]:
    """(id, th, group: a name, copy: a name) of each row, stored, and whether any row is repeated."""
    keyed = _keyed(docs, id_col, text_col)
    sketches_ = materialize(sketched(keyed, tables=tables, sample=sample), "sketches")
    every = sketches_.groupBy("d1", "d2").agg(
        F.min(_name("id", "th")).alias("copy"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("deeper").alias("deeper"), F.first("bins").alias("bins")
    )  # words decide all but the first, so any row of the class has them
    # numbers are given when the table is written, once and for all
    every = every.select(F.monotonically_increasing_id().alias("rid"), "d1", "d2", "copy", F.col("copy.id").alias("id"), F.col("copy.th").alias("th"), "n", "keys", "deeper", "bins")
    classes = materialize(every, "classes")
    rows = materialize(sketches_.select("id", "th", "d1", "d2"), "rows")
    release(sketches_)
    reps = classes.filter("n > 0")
    repeated = not rows.groupBy("id", "th").count().filter("count > 1").isEmpty()
    texts = keyed.dropDuplicates(["id", "th"]) if repeated else keyed

    def linked(pairs: DataFrame, turn: int | str) -> tuple[DataFrame, DataFrame]:
        left = materialize(possible(pairs, reps, similarity=similarity), f"candidates-{turn}")
        return materialize(verified(left, texts, similarity=similarity), f"near-links-{turn}"), left

    links, _ = linked(first_pairs(reps, similarity=similarity), 0)
    roots = components(links)
    pairs, large = further_pairs(reps, roots, tables=tables, sample=sample, small=small, similarity=similarity)
    links, compared = linked(pairs, 1)
    turn = 1
    while not links.isEmpty():
        roots = joined(roots, links, turn)
        if links.filter("star").count() * WORTH < compared.filter("star").count():
            break
        turn += 1
        links, compared = linked(later_pairs(large, roots, turn=turn, similarity=similarity), turn)
    rest = rest_pairs(large, roots, reps, texts, similarity=similarity)
    if rest is not None:
        links, _ = linked(rest, "rest")
        roots = joined(roots, links, turn + 1)
    rooted = classes.select("rid", "d1", "d2", "copy").join(roots.withColumnRenamed("id", "r"), F.col("rid") == F.col("r"), "left")
    rooted = materialize(rooted.select("d1", "d2", "copy", F.coalesce("root", "rid").alias("root")), "rooted")
    names = materialize(rooted.groupBy("root").agg(F.min("copy").alias("group")).withColumnRenamed("root", "r"), "names")
    named = materialize(rooted.join(names, F.col("root") == F.col("r")).select(F.col("d1").alias("x1"), F.col("d2").alias("x2"), "copy", "group"), "named")
    found = rows.join(named, (F.col("d1") == F.col("x1")) & (F.col("d2") == F.col("x2"))).select("id", "th", "group", "copy")
    return found, repeated


def groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, tables: int = 32, sample: int = 2, small: int = 16
) -> DataFrame:
    """One row per row of ``docs``: id, group_id, copy_of (the class of identical texts), kept (true for the row that names the group, and its repeats)."""
    found, _ = _grouped(docs, id_col=id_col, text_col=text_col, similarity=similarity, tables=tables, sample=sample, small=small)
    return found.select(F.col("id").alias(id_col), F.col("group.id").alias("group_id"), F.col("copy.id").alias("copy_of"), (_name("id", "th") == F.col("group")).alias("kept"))


def dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, tables: int = 32, sample: int = 2, small: int = 16
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group."""
    found, repeated = _grouped(docs, id_col=id_col, text_col=text_col, similarity=similarity, tables=tables, sample=sample, small=small)
    one, two = unused(docs, "id", "th")
    gone = found.filter(_name("id", "th") != F.col("group")).select(F.col("id").alias(one), F.col("th").alias(two)).distinct()
    left = docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(one)) & (F.xxhash64(text_col) == F.col(two)), "left_anti")
    return exact.dedup(materialize(left, "near-kept"), id_col=id_col, text_col=text_col) if repeated else left
