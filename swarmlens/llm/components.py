"""Connected components of an edge table of binary keys, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarmlens.operators.graphs import written


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def _least(edges: DataFrame, itself: bool) -> DataFrame:
    """(a, m): each node's least neighbour, or itself if that is less and ``itself`` is asked for.

    The key is joined to nothing, which hides from the planner that the rows are dealt
    by it already: the join with the edges then stands between two exchanges of its
    own, and adaptive execution may cut the edges of a group's centre, which can be
    most of the table, into several tasks.
    """
    least = F.min("b")
    return edges.groupBy("a").agg((F.least("a", least) if itself else least).alias("m")).select(F.concat("a", F.lit(b"")).alias("a"), "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b) but the roots themselves; a root is its component's least node.

    Each round writes its edges to the checkpoint folder twice, as tables: a lost executor
    costs half a round, and plans and their size estimates stay small.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = written(both.join(_least(both, True), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())  # read twice
        small = large.join(_least(large, False), "a")
        edges = written(small.select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
