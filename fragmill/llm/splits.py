"""Splits that keep related records together: Hash-to-Min components, then weighted rendezvous hashing.

The few components that hold a noticeable share of all rows are placed by what is due to each split first.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragmill.functions.text import fingerprint128, fold
from fragmill.llm.components import hash_to_min
from fragmill.plans.lineage import Scratch
from fragmill.sources.tables import require


def column_entities(columns: Mapping[str, str]) -> Column:
    """The entities of a row, as an array of keys: role and folded value of each given column; null and blank are none."""
    made = [F.when(fold(F.col(f"`{c}`")) != "", fingerprint128(F.concat(F.lit(role + ":"), fold(F.col(f"`{c}`"))))) for c, role in columns.items()]
    return F.array_compact(F.array(*made))


def part_entities(column: str, e3: str = "e3", poi: str = "poi") -> Column:
    """The entities in a dotted column: parts with [*:2] only (role e3) and with [*:1] only (role poi)."""
    parts = F.split(fold(F.col(f"`{column}`")), r"\.")
    one, two = (lambda x: F.contains(x, F.lit("[*:1]"))), (lambda x: F.contains(x, F.lit("[*:2]")))
    ends = F.filter(parts, lambda x: one(x) != two(x))
    return F.transform(ends, lambda x: fingerprint128(F.concat(F.when(two(x), F.lit(e3 + ":")).otherwise(F.lit(poi + ":")), x)))


def groups(rows: DataFrame, id_col: str = "rec_id", entities: str = "entities") -> DataFrame:
    """(rec_id, group_id, group_rows): rows joined by a chain of shared entities; group_id is the smallest rec_id.

    ``entities`` is an array of keys. A null or empty array, or one of nulls, leaves the row on its own. Rows with a
    null id are left out; repeated ids are rows of the same record. Other columns are ignored.

    Entities, not rows, are the nodes: all rows of the same entities are pre-aggregated to one pair before any
    shuffle, and each entity is then known by the smallest rec_id that holds it (two entities with the same one share
    that row), so that components run on integers.
    """
    require(rows, [id_col, entities])
    scratch = Scratch(rows.sparkSession)
    keyed = rows.select(F.col(f"`{id_col}`").alias("rec_id"), F.array_distinct(F.array_compact(entities)).alias("k")).filter("rec_id is not null")
    keyed = keyed.withColumn("key", F.get("k", F.lit(0)))
    # (first entity, other entity) of each row; a row with one entity pairs it with itself.
    others = F.when(F.size("k") > 1, F.slice("k", 2, 1 << 30)).otherwise(F.array("key"))
    pairs = keyed.filter("key is not null").select("rec_id", "key", F.posexplode(others).alias("at", "other"))
    pairs = scratch.keep(pairs.groupBy("key", "other").agg(F.min("rec_id").alias("least"), F.sum(F.when(F.col("at") == 0, 1).otherwise(0)).alias("n")))
    ends = pairs.select("least", F.inline(F.array(F.struct(F.col("key"), F.col("n")), F.struct(F.col("other").alias("key"), F.lit(0).cast("long").alias("n")))))
    known = scratch.keep(ends.groupBy("key").agg(F.min("least").alias("node"), F.sum("n").alias("n")))
    node = known.select("key", "node")
    edges = pairs.filter("key <> other").join(node.withColumnRenamed("node", "a"), "key").join(node.select(F.col("key").alias("other"), F.col("node").alias("b")), "other")
    alone = known.select(F.col("node").alias("a"), F.col("node").alias("b"))
    found = hash_to_min(edges.select("a", "b").filter("a <> b").union(alone).distinct(), scratch)
    labelled = known.join(found, "node").select("key", "n", "component")
    sizes = labelled.groupBy("component").agg(F.sum("n").alias("group_rows"))
    of_key = scratch.keep(labelled.join(sizes, "component").select("key", "component", "group_rows"))
    out = keyed.select("rec_id", "key").join(of_key, "key", "left")
    return out.select("rec_id", F.coalesce("component", "rec_id").alias("group_id"), F.coalesce("group_rows", F.lit(1)).alias("group_rows"))


def rendezvous(group: Column, weights: Mapping[str, float], seed: int = 42) -> Column:
    """The split with the highest score -weight / ln(u), u from a hash of group and split: proportions without state.

    Adding or dropping a split moves only the groups that go to or come from it. Weights below or equal to nought are
    refused.
    """
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    score = lambda name, w: F.lit(-float(w)) / F.log((F.shiftrightunsigned(F.xxhash64(F.lit(seed), group, F.lit(name)), 11) + F.lit(0.5)) / F.lit(float(1 << 53)))
    ranked = [F.struct(score(name, w).alias("s"), F.lit(name).alias("split")) for name, w in sorted(weights.items())]
    return F.array_max(F.array(*ranked))["split"]


def placed_first(sizes: list[tuple[int, object]], weights: Mapping[str, float], total: int) -> tuple[dict, dict[str, float]]:
    """({group: split}, {split: rows still due}): groups (rows, group), the greatest first, each to the split that lacks
    most rows (the first by name on ties)."""
    whole = sum(weights.values())
    due = {name: total * w / whole for name, w in sorted(weights.items())}
    where = {}
    for n, group in sorted(sizes, key=lambda x: (-x[0], x[1])):
        split = max(due, key=lambda x: due[x])
        where[group] = split
        due[split] -= n
    return where, due


def assign(rows: DataFrame, weights: Mapping[str, float], id_col: str = "rec_id", entities: str = "entities", seed: int = 42, large: float = 1e-4) -> DataFrame:
    """(rec_id, group_id, group_rows, split). A group goes to one split as a whole.

    Groups of more than the share ``large`` of all rows, of which there are fewer than 1 / ``large``, are placed one by
    one where most rows are due; hashing would miss the shares by their size. All others go by weighted rendezvous, with
    what is then still due as weights, so shares miss by about 0.3 ``large`` ^ 1/2 at most unless a group is greater than
    what is due to any split. Null entities are none; repeated rows count as often as they stand.
    """
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    spark = rows.sparkSession
    found = Scratch(spark).keep(groups(rows, id_col, entities))
    total = found.count()
    kind = found.schema["group_id"].dataType.simpleString()
    big = found.filter(F.col("group_rows") > total * large).groupBy("group_id").agg(F.max("group_rows").alias("n"))
    where, due = placed_first([(r.n, r.group_id) for r in big.collect()], weights, total)  # fewer than 1 / large rows
    held = spark.createDataFrame(list(where.items()), f"group_id {kind}, placed string")
    left = {name: n for name, n in due.items() if n > 0} or dict(weights)
    out = found.join(F.broadcast(held), "group_id", "left")
    return out.select("rec_id", "group_id", "group_rows", F.coalesce("placed", rendezvous(F.col("group_id"), left, seed)).alias("split"))


def shares(assigned: DataFrame) -> DataFrame:
    """(split, rows, groups, share) of an assignment."""
    counts = assigned.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("group_id").alias("groups"))
    total = F.sum("rows").over(Window.partitionBy(F.lit(0)))  # one row a split
    return counts.select("split", "rows", "groups", (F.col("rows") / total).alias("share"))
