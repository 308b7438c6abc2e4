"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over (a, b) with a > b: neighbours are linked to the least id around each node.

    The least neighbour is a partial aggregate and is joined back, so no list of neighbours is built.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
    j = both.join(least, both["a"] == least["node"])
    if large:
        out = j.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = j.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component (the least id of its component) for every node of the edges (a, b).

    Null ends, loops and repeated edges are ignored; no edges give no rows.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    e = cut(e, name)
    before = None
    while True:
        last, e = e, cut(_star(_star(e, True), False), name)
        discard(last)
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or not state[0]:
            break
        before = state
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
