"""Graphs as edge tables (graph, u, v): degrees, neighbourhoods, line graphs, pairs of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def both_ways(edges: DataFrame, graph: str) -> DataFrame:
    """(graph, u, v) in both directions, without loops and repeats."""
    e = edges.select(graph, "u", "v").filter("u <> v")
    return e.union(e.select(graph, "v", "u")).distinct()


def degrees(edges: DataFrame, graph: str) -> DataFrame:
    """(graph, u, degree)."""
    return both_ways(edges, graph).groupBy(graph, "u").agg(F.count(F.lit(1)).alias("degree"))


def exactly_two_away(edges: DataFrame, graph: str) -> DataFrame:
    """(graph, u, n2): nodes at a distance of exactly two; nodes with none are left out."""
    e = both_ways(edges, graph)
    second = e.withColumnRenamed("v", "w").join(e.withColumnRenamed("u", "w").withColumnRenamed("v", "x"), [graph, "w"]).filter("u <> x").select(graph, "u", F.col("x").alias("v")).distinct()
    return second.join(e, [graph, "u", "v"], "left_anti").groupBy(graph, "u").agg(F.count(F.lit(1)).alias("n2"))


def line_graph(edges: DataFrame, graph: str, edge: str) -> DataFrame:
    """(graph, a, b): edges a < b that share a node. Nodes of molecules have few edges, so this stays in proportion."""
    ends = edges.select(graph, F.col(edge).alias("e"), F.explode(F.array("u", "v")).alias("node"))
    met = ends.withColumnRenamed("e", "a").join(ends.withColumnRenamed("e", "b"), [graph, "node"]).filter("a < b")
    return met.select(graph, "a", "b").distinct()


def khop(edges: DataFrame, graph: str, k: int) -> DataFrame:
    """(graph, u, hop, n): how many nodes are exactly 1, ..., k bonds from each node. Each step extends only the last shell
    and leaves out what is nearer; for graphs of many small parts, as molecules are."""
    e = both_ways(edges, graph)
    seen = e.select(graph, "u", "v", F.lit(1).alias("hop"))
    last = seen
    for hop in range(2, k + 1):
        step = last.select(graph, "u", F.col("v").alias("w")).join(e.withColumnRenamed("u", "w"), [graph, "w"]).filter("u <> v").select(graph, "u", "v").distinct()
        last = step.join(seen.select(graph, "u", "v"), [graph, "u", "v"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.union(last)
    return seen.groupBy(graph, "u", "hop").agg(F.count(F.lit(1)).alias("n"))


def pairs_by_balance(df: DataFrame, group: str, item: str, size: str) -> DataFrame:
    """(group, a, b, spread): the pair of a group's items a < b whose sizes and the rest of the group's size are the most
    even, by population deviation; the smaller items on ties. Groups are small, as the bonds of a molecule are."""
    total = df.groupBy(group).agg(F.sum(size).alias("all"))
    one, two = df.select(group, F.col(item).alias("a"), F.col(size).alias("x")), df.select(group, F.col(item).alias("b"), F.col(size).alias("y"))
    rest = F.col("all") - F.col("x") - F.col("y")
    mean = F.col("all") / 3
    sq = lambda c: (c - mean) * (c - mean)
    both = one.join(two, group).filter("a < b").join(total, group).withColumn("spread", F.round(F.sqrt((sq(F.col("x")) + sq(F.col("y")) + sq(rest)) / 3), 6))
    return both.groupBy(group).agg(F.min(F.struct("spread", "a", "b")).alias("m")).select(group, "m.a", "m.b", "m.spread")
