"""Index maintenance: merges, reuse of unchanged files, and the effects of events.

Tables are plain Parquet: a merge gives a new version of a table, which
``sources.tables`` writes beside the old one before the pointer moves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeview.functions.text import tokens, trim_space

KEY = ["source_id", "source_type", "extractor_type"]
#: What names a text in the inverted index: its place of insertion. Ids of sources, long and in no order there, are looked up for candidates only.
PLACE = ["seq", "source_type", "extractor_type"]


def latest_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; a partial aggregation, so a frequent key costs no more than any."""
    cols = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(order, *[c for c in cols if c != order])).alias("r"))
    return last.select(key, *[F.col(f"r.{c}").alias(c) for c in cols])


def upsert_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace old ones of the same path, which keep their id and time of creation."""
    o, n = old.alias("o"), new.alias("n")
    met = o.join(n, F.col("o.path") == F.col("n.path"), "full_outer")
    fresh = F.col("n.path").isNotNull()
    kept = ("id", "created_at")
    return met.select(
        *[
            (F.when(F.col("o.path").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")) if c in kept else F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))).alias(c)
            for c in old.columns
        ]
    )


def upsert_repos(old: DataFrame, new: DataFrame) -> DataFrame:
    """New names, remotes, branches and times replace those of the same root."""
    changed = ("repo_name", "remote_url", "current_branch", "last_commit_at")
    met = old.alias("o").join(new.alias("n"), F.col("o.root_path") == F.col("n.root_path"), "full_outer")
    fresh, held = F.col("n.root_path").isNotNull(), F.col("o.root_path").isNotNull()
    return met.select(*[(F.when(fresh if c in changed else ~held, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))).alias(c) for c in old.columns])


def upsert_blobs(old: DataFrame, new: DataFrame) -> DataFrame:
    """New texts replace old ones of the same key and get later places in order of insertion; blank ones change nothing."""
    solid = new.withColumn("content", trim_space(F.col("content"))).filter(F.coalesce(F.length("content"), F.lit(0)) > 0)
    top = old.agg(F.coalesce(F.max("seq"), F.lit(-1).cast("long")).alias("top"))
    placed = solid.crossJoin(F.broadcast(top))  # one row: the last place so far
    placed = placed.withColumn("seq", F.col("top") + 1 + F.col("seq")).drop("top")
    identity = F.sha1(F.concat_ws(":", *KEY, "content"))
    placed = placed.withColumn("id", identity) if "id" in old.columns else placed
    return old.join(new.filter(F.length(trim_space(F.col("content"))) > 0).select(*KEY), KEY, "left_anti").unionByName(placed.select(*old.columns))


def split_by_reuse(listing: DataFrame, files: DataFrame) -> DataFrame:
    """The listing with ``reused``: whether the stored fingerprint of the path is the same."""
    stored = files.select(F.col("path").alias("p"), F.get_json_object("metadata_json", "$.scanFingerprint").alias("stored"))
    return listing.join(stored, F.col("path") == F.col("p"), "left").withColumn("reused", F.coalesce(F.col("stored") == F.col("fingerprint"), F.lit(False))).drop("p", "stored")


def missing_blobs(expected: DataFrame, blobs: DataFrame) -> DataFrame:
    """Expected (source_id, source_type, extractor_type) without a text."""
    return expected.join(blobs.select(*KEY), KEY, "left_anti")


def scan_summary(rows: DataFrame) -> DataFrame:
    """Counts of a scan over rows with flags reused, text, image, ocr."""
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    done = ~F.col("reused")
    return rows.agg(
        count(done).alias("indexed"), count(F.col("reused")).alias("reused"), count(F.col("text")).alias("text_extractions"),
        count(done & F.col("image")).alias("image_summaries"), count(done & F.col("ocr")).alias("ocr_extractions"),
    )


def merge_metadata(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """JSON objects (key, metadata_json) merged, new values over old ones, keys in order."""
    pairs = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    met = old.select(key, F.col("metadata_json").alias("a")).join(new.select(F.col(key).alias("k"), F.col("metadata_json").alias("b")), F.col(key) == F.col("k"), "full_outer")
    fresh = pairs(F.col("b"))
    left = F.map_filter(pairs(F.col("a")), lambda k, v: ~F.map_contains_key(fresh, k))
    merged = F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(left, fresh))))
    return met.select(F.coalesce(key, "k").alias(key), F.to_json(merged).alias("metadata_json"))


def delete_paths(files: DataFrame, blobs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the files at the paths in ``gone``."""
    ids = files.join(gone.select("path"), "path", "left_semi").select(F.col("id").alias("source_id"), F.lit("file").alias("source_type"))
    return files.join(gone.select("path"), "path", "left_anti"), blobs.join(ids, ["source_id", "source_type"], "left_anti")


def paired_events(events: DataFrame, grace_ms: int = 1000) -> DataFrame:
    """(what, old_path, new_path, inode, ue, ae) for unlinks that an add answers within the grace time, each used once.

    ``what`` is ``change`` where the next of a path's adds and unlinks is its own add (an atomic save), else ``rename``
    where the add has the same inode and device as the last such unlink before it and is the first to answer it. An
    unlink with both kinds of answer takes the earlier one.
    """
    device = F.col("device") if "device" in events.columns else F.lit(1).cast("long")
    e = events.filter("kind IN ('unlink', 'add')").select("event_id", "path", "inode", device.alias("device"), (F.col("kind") == "unlink").alias("gone"), F.unix_millis("ts").alias("ms"))
    at = F.struct("ms", "event_id")
    order = ("ms", "event_id")
    last = F.struct(F.col("event_id").alias("ue"), F.col("path").alias("old_path"), F.col("ms").alias("gone_ms"))
    before = lambda *keys: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = e.withColumn("u", F.lag(F.when(F.col("gone"), last)).over(Window.partitionBy("path").orderBy(*order)))
    keyed = F.last(F.when(F.col("gone"), last), True).over(before("inode", "device"))
    met = own.withColumn("k", F.when(F.col("inode").isNotNull() & F.col("device").isNotNull(), keyed)).filter("NOT gone")
    soon = lambda u: F.col(f"{u}.ue").isNotNull() & (F.col("ms") - F.col(f"{u}.gone_ms") <= grace_ms)
    met = met.select("event_id", "path", "inode", at.alias("at"), F.when(soon("u"), F.col("u")).alias("u"), F.when(soon("k") & (F.col("k.old_path") != F.col("path")), F.col("k")).alias("k"))

    def first(rows: DataFrame) -> DataFrame:
        """The first add of each unlink by inode."""
        return rows.filter("k IS NOT NULL").groupBy(F.col("k.ue").alias("ue")).agg(F.min(F.struct("at", F.col("path").alias("new_path"), "inode", F.col("k.old_path").alias("old_path"))).alias("r"))

    same = met.filter("u IS NOT NULL").select(F.col("u.ue").alias("ue"), "at", "path", "inode", F.col("event_id").alias("ae"))
    moved = first(met.filter("u IS NULL"))
    saved = same.join(moved.select(F.col("ue").alias("m"), F.col("r.at").alias("mat")), F.col("ue") == F.col("m"), "left").withColumn("wins", F.coalesce(F.col("at") < F.col("mat"), F.lit(True)))
    lost = saved.filter("wins").select(F.col("ue").alias("s"))
    moved = moved.join(lost, F.col("ue") == F.col("s"), "left_anti")
    # adds whose own unlink went to a rename may answer another unlink that is still open
    freed = met.join(saved.filter("NOT wins").select(F.col("ae").alias("f")), F.col("event_id") == F.col("f"), "left_semi")
    taken = moved.select("ue").union(lost)
    moved = moved.unionByName(first(freed).join(taken.withColumnRenamed("ue", "t"), F.col("ue") == F.col("t"), "left_anti"))
    renames = moved.select(F.lit("rename").alias("what"), "r.old_path", "r.new_path", "r.inode", "ue", F.col("r.at.event_id").alias("ae"))
    return renames.unionByName(saved.filter("wins").select(F.lit("change").alias("what"), F.col("path").alias("old_path"), F.col("path").alias("new_path"), "inode", "ue", "ae"))


def rename_pairs(events: DataFrame, grace_ms: int = 1000) -> DataFrame:
    """(old_path, new_path, inode, ue, ae) of renames."""
    return paired_events(events, grace_ms).filter("what = 'rename'").drop("what")


def moved_by_content(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_path, new_path, sha256): files (path, sha256) that left one listing and came in another under a digest that one file each has."""
    side = lambda rows, other, name: rows.join(other.select("path"), "path", "left_anti").filter("sha256 IS NOT NULL").groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias(name)).filter("n = 1").drop("n")
    return side(old, new, "old_path").join(side(new, old, "new_path"), "sha256").select("old_path", "new_path", "sha256")


def net_renames(renames: DataFrame) -> DataFrame:
    """(old_path, new_path): renames (old_path, new_path, ue, ae) of one batch with those in a chain followed to its end."""
    moves = renames.select("old_path", "new_path", "ue", "ae")
    while True:
        later = moves.select(F.col("old_path").alias("o"), F.col("new_path").alias("n"), F.col("ue").alias("u"), F.col("ae").alias("e"))
        met = moves.join(later, (F.col("new_path") == F.col("o")) & (F.col("u") > F.col("ae")))
        if met.isEmpty():
            break
        step = met.groupBy("old_path", "new_path", "ue", "ae").agg(F.min(F.struct("u", "e", "n")).alias("x"))
        follows = moves.join(step.select(F.col("ue").alias("p"), "x"), F.col("ue") == F.col("p"), "left")
        used = step.select(F.col("x.u").alias("q"))
        moves = follows.join(used, F.col("ue") == F.col("q"), "left_anti").select("old_path", F.coalesce("x.n", "new_path").alias("new_path"), "ue", F.coalesce("x.e", "ae").alias("ae"))
    return moves.filter("old_path <> new_path").groupBy("old_path").agg(F.max_by("new_path", "ae").alias("new_path"))


def apply_renames(files: DataFrame, blobs: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files and texts moved to their new paths at once, without being read again.

    What stood at a new path goes first, unless it moves itself (as in a swap). Of several files that move to one path
    the last stays. Moved texts come last in order of insertion.
    """
    moves = renames.filter("old_path <> new_path").select(F.col("old_path").alias("op"), F.col("new_path").alias("np"))
    moves = moves.join(files.select("path"), F.col("op") == F.col("path"), "left_semi")
    moves = moves.groupBy("np").agg(F.max("op").alias("op"))
    stale = moves.select(F.col("np").alias("s")).join(moves.select("op"), F.col("s") == F.col("op"), "left_anti")
    met = files.join(stale, F.col("path") == F.col("s"), "left_anti").join(moves, F.col("path") == F.col("op"), "left")
    moved = F.col("np").isNotNull()
    name = F.substring_index("np", "/", -1)
    suffix = F.nullif(F.regexp_extract(name, r"^.+\.([^.]*)$", 1), F.lit(""))
    new = {"id": F.sha1("np"), "path": F.col("np"), "name": name, "extension": suffix}
    out = met.select(*[F.when(moved, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in files.columns])
    ids = moves.select(F.sha1("op").alias("from"), F.sha1("np").alias("to"), F.lit("file").alias("t"))
    gone = stale.select(F.sha1("s").alias("source_id"), F.lit("file").alias("source_type"))
    stay = blobs.join(gone, ["source_id", "source_type"], "left_anti")
    top = F.broadcast(blobs.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("top")))  # one row
    shifted = stay.join(ids, (F.col("source_id") == F.col("from")) & (F.col("source_type") == F.col("t")), "left").crossJoin(top)
    texts = shifted.select(
        *[F.coalesce("to", "source_id").alias(c) if c == "source_id" else F.when(F.col("to").isNotNull(), F.col("top") + 1 + F.col("seq")).otherwise(F.col("seq")).alias(c) if c == "seq" else F.col(c) for c in blobs.columns]
    )
    return out, texts


def updated_postings(old: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """The index after texts changed from one version of the blobs to another: only those that changed are split into tokens."""
    same = [*KEY, "seq", "content"]
    fresh = after.join(before.select(*same), same, "left_anti")
    left = old.join(before.select(*same).join(after.select(*same), same, "left_anti").select(*PLACE), PLACE, "left_anti")
    every = left.select("token", *PLACE, "places").unionByName(postings(fresh))
    return every.repartitionByRange("token", "seq").sortWithinPartitions("token", "seq")


def debounce_gaps(events: DataFrame, gap_ms: int = 250) -> DataFrame:
    """Jobs per path where only the quiet gap ends a burst: (path, kind of the last event, first and last time, events)."""
    order = Window.partitionBy("path").orderBy("ms", "event_id")
    e = events.withColumn("ms", F.unix_millis("ts"))
    burst = e.withColumn("new", (F.col("ms") - F.lag("ms").over(order) > gap_ms).cast("int")).withColumn("burst", F.sum(F.coalesce("new", F.lit(0))).over(order))
    last = F.max_by("kind", F.struct("ms", "event_id"))
    return burst.groupBy("path", "burst").agg(F.when(last == "unlink", "delete").otherwise("upsert").alias("job"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), F.count(F.lit(1)).alias("n_events"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _by_token(words: Column) -> Column:
    """Structs (token, places) of a text's words: pairs are sorted, and each run of a token becomes one struct."""

    def runs(pairs: Column) -> Column:
        first = F.filter(F.transform(pairs, lambda p, i: F.when((i == 0) | (p["token"] != F.get(pairs, i - 1)["token"]), i)), lambda i: i.isNotNull())
        run = lambda at: lambda s, j: F.slice(pairs, s + 1, F.coalesce(F.get(at, j + 1), F.size(pairs)) - s)
        made = lambda at: F.transform(at, lambda s, j: F.struct(F.get(pairs, s)["token"].alias("token"), F.transform(run(at)(s, j), lambda p: p["place"]).alias("places")))
        return _let(first, made)

    return _let(F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("token"), i.alias("place")))), runs)


def postings(blobs: DataFrame) -> DataFrame:
    """The inverted index (token, place of insertion, places), in order of token and insertion.

    A text's words are brought together by token within its row, so that one row for each token of a text is exchanged.
    Rows are dealt by ranges of token and place of insertion, so that a frequent token is shared by several tasks.
    """
    words = blobs.select(*PLACE, F.inline(_by_token(tokens(F.col("content"))))).select("token", *PLACE, "places")
    return words.repartitionByRange("token", "seq").sortWithinPartitions("token", "seq")


def prefix_lookup(index: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Postings by prefix, for many prefixes at once. Prefixes are what was asked, whatever the index holds: they are broadcast, and no posting is exchanged."""
    asked = prefixes.withColumn("h", F.substring("prefix", 1, 1))
    return index.join(F.broadcast(asked), (F.substring("token", 1, 1) == F.col("h")) & F.startswith("token", "prefix")).drop("h")
