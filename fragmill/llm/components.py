"""Connected components by Hash-to-Min.

Each node holds a cluster, at first itself and its neighbours. In each round it sends the cluster to the cluster's
smallest node and that node to all others, until nothing changes. Clusters are kept as (node, member) rows, so a hot
node's cluster is never in one task's memory: minima are pre-aggregated before the shuffle and skewed joins are split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.plans.lineage import Scratch


def _state(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u"))).first())


def hash_to_min(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes of edges (a, b); component is the smallest node. Rows with a null are ignored."""
    edges = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).dropna()
    both = edges.union(edges.select("u", "v"))
    held = scratch.keep(both.union(both.select("v", F.col("v").alias("u"))).distinct())
    state = _state(held)
    for _ in range(most_rounds):
        least = held.groupBy("v").agg(F.min("u").alias("m"))
        sent = held.join(least, "v")
        # The members to the minimum and the minimum to the members, both from one pass over the join.
        both = sent.select(F.inline(F.array(F.struct(F.col("m").alias("v"), F.col("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))))
        new = scratch.keep(both.distinct())
        scratch.drop(held)
        held, before = new, state
        state = _state(held)
        if state == before:
            return held.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))
    raise RuntimeError(f"components were not stable after {most_rounds} rounds")
