"""Exact dedup by skew-safe combining, in DataFrame functions only.

Copies are texts that are identical once each run of ``[\\x20\\x09-\\x0D]`` is one
space. Three combining steps compare the full normalised text, not its digest
alone: map-side partial aggregation inside each task, then groups salted by the
task they come from, then the salts' winners globally. A group of copies that
holds a third of all rows leaves each map task as one row, so no task sees more
than one row per map task of it. Rows learn of their group by a join on digests;
groups of more than a thousandth of all rows, of which there are under a thousand,
are broadcast for it, so no group brings more than that into one task.

Defined cases: a null text is empty; empty texts are copies of each other; a
null id is larger than any id; of repeated rows with one id one stays; an empty
table gives an empty result; further columns pass through ``dedup`` untouched,
whatever their names, and are not read by ``report``. Rows are numbered in a
stored table, so input that comes in another order when read again does no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, unused

#: Groups of more than this share of all rows are broadcast.
HOT = 0.001


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _digests(norm: Column) -> list[Column]:
    return [F.unhex(F.sha2(norm, 256)).alias("digest"), F.xxhash64(norm).alias("variant")]


def _groups(texts: DataFrame, salts: int) -> DataFrame:
    """(digest, variant, keep_id, group_size) of rows (id, text)."""
    norm = normalised(F.col("text"))
    local = texts.select(F.unhex(F.sha2(norm, 256)).alias("digest"), norm.alias("norm"), (F.spark_partition_id() % salts).alias("salt"), "id")
    salted = local.groupBy("digest", "norm", "salt").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    combined = salted.groupBy("digest", "norm").agg(F.min("id").alias("id"), F.sum("n").alias("n"))
    # two texts under one pair of digests would need content in the joins on digests: refuse rather than merge them
    one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("two texts share SHA-256 and xxHash64")).cast("long"))
    found = combined.groupBy("digest", F.xxhash64("norm").alias("variant")).agg(F.coalesce(one.cast(texts.schema["id"].dataType), F.min("id")).alias("keep_id"), F.sum("n").alias("group_size"))
    return materialize(found, "exact-groups")


def _told(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (digest, variant, ...) with their group's columns."""
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    named = groups.withColumnsRenamed({"digest": "d", "variant": "v"})
    on = (F.col("digest") == F.col("d")) & (F.col("variant") == F.col("v"))
    hot = F.broadcast(named.filter(F.col("group_size") > HOT * total))  # under 1 / HOT rows
    cold = rows.join(hot, on, "left_anti").join(named.filter(F.col("group_size") <= HOT * total), on)
    return rows.join(hot, on).unionByName(cold).drop("d", "v")


def _winners(rows: DataFrame) -> DataFrame:
    """(win): the number of the row that stays, of each group, from rows (row, id, digest, variant, keep_id)."""
    mine = rows.filter(F.col("id").eqNullSafe(F.col("keep_id")))
    return mine.groupBy("digest", "variant").agg(F.min("row").alias("win"))


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = materialize(texts.select(F.monotonically_increasing_id().alias("row"), "id", *_digests(normalised(F.col("text")))), "exact-rows")
    told = _told(rows, _groups(texts, salts))
    # rows of the id that stays are few unless rows are repeated
    win = materialize(_winners(told).select("win"), "exact-winners")
    out = told.join(win, F.col("row") == F.col("win"), "left")
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("win").isNotNull().alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    (number,) = unused(docs, "row")
    stored = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "exact-input")
    texts = stored.select(F.col(number).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = materialize(texts.select("row", "id", *_digests(normalised(F.col("text")))), "exact-rows")
    win = materialize(_winners(_told(rows, _groups(texts.select("id", "text"), salts))).select("win"), "exact-winners")
    return stored.join(win, F.col(number) == F.col("win"), "left_semi").drop(number)
