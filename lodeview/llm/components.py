"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every id in ``links`` (a, b): root is the component's smallest id.

    Each round points every node at its smallest neighbour, follows that pointer
    once more, and replaces the links by links between the targets. What is left
    shrinks by a constant factor at least; stars on their smallest member, which
    the near-duplicate search emits, are gone after one round. Rounds exchange
    (node, pointer) pairs only: no neighbour list is ever gathered.
    """
    left = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links")
    roots, turn = None, 0
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        point = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("to"))
        # stored first: a pointer's target may be the target of a third of all rows, and two plain exchanges can be split
        point = materialize(point, f"nearest-{turn}")
        hop = point.select(F.col("a").alias("mid"), F.col("to").alias("far"))
        point = materialize(point.join(hop, F.col("to") == F.col("mid")).select("a", F.col("far").alias("to")), f"pointers-{turn}")
        if roots is None:
            roots = point.select(F.col("a").alias("id"), F.col("to").alias("root"))
        else:
            step = point.select(F.col("a").alias("was"), "to")
            roots = materialize(roots.join(step, F.col("root") == F.col("was"), "left").select("id", F.coalesce("to", "root").alias("root")), f"roots-{turn}")
        ends = left.join(point.select(F.col("a").alias("x"), F.col("to").alias("ta")), F.col("a") == F.col("x"))
        ends = ends.join(point.select(F.col("a").alias("y"), F.col("to").alias("tb")), F.col("b") == F.col("y"))
        left = materialize(ends.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).filter("a < b").distinct(), f"left-{turn}")
        turn += 1
    if roots is None:
        return left.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots


def joined(roots: DataFrame, links: DataFrame, turn: int) -> DataFrame:
    """``roots`` (id, root) after further ``links`` (a, b)."""
    known = roots.select(F.col("id").alias("i"), F.col("root").alias("r"))
    ends = links.join(known, F.col("a") == F.col("i"), "left").select(F.coalesce("r", "a").alias("a"), "b")
    ends = ends.join(known, F.col("b") == F.col("i"), "left").select("a", F.coalesce("r", "b").alias("b"))
    new = materialize(components(ends), f"joined-{turn}")
    moved = new.select(F.col("id").alias("i"), F.col("root").alias("to"))
    old = roots.join(moved, F.col("root") == F.col("i"), "left").select("id", F.coalesce("to", "root").alias("root"))
    return materialize(old.union(new.join(known, F.col("id") == F.col("i"), "left_anti")), f"all-roots-{turn}")
