"""Mixing sources to target weights with hash-threshold histograms, natively.

A document's 60-bit hash orders its source's documents once and for all, so the
documents below a threshold form nested samples: a larger budget holds all of a
smaller one. To find the threshold that meets a budget, sizes are summed by
source and leading hash bits; only the bucket in which the budget falls is split
by further bits. No sort of documents, no collect: each level is one partial
aggregation, and what a task holds is bounded by sources times buckets.

Targets: a source's share of ``share`` times all words goes by weight; a target
stops at ``most`` times its source's words and the excess goes to the others by
weight. With ``cap = most * words`` and sources in order of ``cap / weight`` the
common level is the maximum, over the sources, of what the earlier caps leave
divided by the remaining weights.

A document is taken whole: ``floor(target / source)`` times, and once more below
the threshold; the document at the threshold goes in or not, whichever leaves
the source nearer to its target. Words that no whole document can hit stay off
by at most half of that document.

Defined cases: a null text has no words; a null source is a source, last in
order; rows that share an id share a hash and go in together; a source without
words has target 0; an empty table gives an empty result; further columns pass
through ``mix_sources`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize, unused

HASH_BITS, LEVEL_BITS = 60, 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_hash(id_: Column, seed: str) -> Column:
    """60 bits of MD5, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_.cast("string"), F.lit("")))), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, *, share: float, weights: Sequence[float], most: int) -> DataFrame:
    """Source targets from (source, source_size). One row per source: its windows run over sources, never over documents."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)) + 1)
    caps = sizes.withColumn("w", weight).withColumn("cap", (F.col("source_size") * most).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    every = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    leveled = caps.withColumn("level", (F.sum("source_size").over(every) * F.lit(share) - before) / rest)
    return leveled.withColumn("target", F.least("cap", F.max("level").over(every) * F.col("w"))).select("source", "source_size", "target")


def plan(base: DataFrame, *, share: float = 1.5, weights: Sequence[float] = (5, 2, 1), most: int = 2) -> DataFrame:
    """(source, source_size, target, repeats, threshold) from stored (source, size, h) rows."""
    per_source = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(per_source, share=share, weights=weights, most=most)
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = materialize(
        goal.withColumn("repeats", repeats)
        .withColumn("budget", F.col("target") - F.col("repeats") * F.col("source_size"))
        .withColumn("prefix", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long"))
        .withColumn("threshold", F.when((F.col("budget") <= 0) | (F.col("source_size") == 0), F.lit(0).cast("long"))),
        "mix-0",
    )
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        open_ = state.filter("threshold IS NULL")
        if open_.isEmpty():
            break
        shift, above = HASH_BITS - LEVEL_BITS * level, HASH_BITS - LEVEL_BITS * (level - 1)
        ask = open_.select(F.col("source").alias("s"), "budget", "prefix", "below")
        histogram = (
            base.join(ask, base["source"].eqNullSafe(ask["s"]) & (F.shiftright("h", above) == ask["prefix"]))
            .groupBy("source", "budget", "below", F.shiftright("h", shift).alias("bucket"))
            .agg(F.sum("size").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        )
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        reached = histogram.withColumn("upto", F.col("below") + F.sum("n").over(run)).filter("upto > budget")
        edge = reached.groupBy(F.col("source").alias("s")).agg(F.min(F.struct("bucket", "upto", "n", "lo", "hi")).alias("e"))
        start, end = F.col("e.upto") - F.col("e.n"), F.col("e.upto")
        inside = (end - F.col("budget") < F.col("budget") - start).cast("long")
        joined = state.join(edge, state["source"].eqNullSafe(edge["s"]), "left")
        found = F.when(F.col("threshold").isNotNull(), F.col("threshold")).when(F.col("e.lo") == F.col("e.hi"), F.col("e.lo") + inside)
        state = materialize(
            joined.select(
                "source", "source_size", "target", "repeats", "budget", F.coalesce("e.bucket", "prefix").alias("prefix"),
                F.coalesce(start, F.col("below")).alias("below"), found.alias("threshold"),
            ),
            f"mix-{level}",
        )
    return state.select("source", "source_size", "target", "repeats", F.coalesce("threshold", F.lit(0).cast("long")).alias("threshold"))


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, keep: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    base = materialize(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), order_hash(F.col(id_col), seed).alias("h")), "mix-sizes"
    )
    return base, plan(base, **options)


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **options) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, source, copies."""
    base, goal = _planned(docs, id_col, text_col, source_col, seed, **options)
    goal = goal.withColumnRenamed("source", "s")
    copies = F.col("repeats") + (F.col("h") < F.col("threshold")).cast("long")
    return base.join(goal, base["source"].eqNullSafe(goal["s"])).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), "source", copies.alias("copies")
    )


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (possibly never)."""
    _, goal = _planned(docs, id_col, text_col, source_col, seed, **options)
    h, s, repeats, threshold, copy = unused(docs, "h", "s", "repeats", "threshold", "copy")
    goal = goal.select(F.col("source").alias(s), F.col("repeats").alias(repeats), F.col("threshold").alias(threshold))
    hashed = docs.withColumn(h, order_hash(F.col(id_col), seed))
    copies = F.col(repeats) + (F.col(h) < F.col(threshold)).cast("long")
    return (
        hashed.join(goal, F.col(source_col).eqNullSafe(F.col(s))).filter(copies > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), copies)))
        .drop(h, s, repeats, threshold, copy)
    )
