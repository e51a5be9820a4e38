"""New whole molecules from known parts: drawn by hash, joined, checked, and cleared of known ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragmill.chem import molecule as m
from fragmill.operators.molecules import _map


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """(NAME_no, NAME): the distinct non-null values with numbers from 0, in the order of their hashes.

    Numbers come from counts of hash ranges, so no single task sorts all values.
    """
    values = df.select(F.col(column).alias(name)).dropna().distinct().withColumn("h", F.xxhash64(name))
    values = values.withColumn("b", F.shiftrightunsigned("h", 54))
    before = values.groupBy("b").count().withColumn("base", F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("b")) - F.col("count"))
    inner = F.row_number().over(Window.partitionBy("b").orderBy("h", name)) - 1
    return values.withColumn("i", inner).join(before, "b").select((F.col("base") + F.col("i")).alias(f"{name}_no"), name)


def _joined(e3: str | None, linker: str | None, poi: str | None) -> dict:
    parts = [m.parse(x) for x in (e3, linker, poi)]
    whole = m.join(parts, [1, 2]) if all(parts) else None
    return {"whole": m.write(whole, list(range(len(whole.atoms)))) if whole else None}


def generate(known: DataFrame, e3: str, linker: str, poi: str, n: int, seed: int = 42) -> DataFrame:
    """(draw, e3, linker, poi, whole): n draws of an E3 ligand, linker and target ligand, each uniform over the distinct
    values, less those that do not join or whose parts stand together in ``known`` already, each combination once."""
    out = known.sparkSession.range(n).withColumnRenamed("id", "draw")
    for k, (column, name) in enumerate(((e3, "e3"), (linker, "linker"), (poi, "poi"))):
        values = numbered(known, column, name)
        many = values.count()
        out = out.withColumn(f"{name}_no", F.pmod(F.xxhash64("draw", F.lit(seed + k)), F.lit(max(many, 1)))).join(values, f"{name}_no").drop(f"{name}_no")
    there = known.select(F.col(e3).alias("e3"), F.col(linker).alias("linker"), F.col(poi).alias("poi"))
    fresh = out.groupBy("e3", "linker", "poi").agg(F.min("draw").alias("draw")).join(there, ["e3", "linker", "poi"], "left_anti")
    made = _map(fresh, "draw", ["e3", "linker", "poi"], "whole string", _joined).filter("whole is not null")
    return fresh.join(made, "draw").select("draw", "e3", "linker", "poi", "whole")


def cover(known: DataFrame, e3: str, linker: str, poi: str) -> DataFrame:
    """(draw, e3, linker, poi, whole): as few draws as hold every distinct part at least once, parts taken in turn by their
    numbers; draws that do not join are left out."""
    parts = [(name, numbered(known, column, name)) for column, name in ((e3, "e3"), (linker, "linker"), (poi, "poi"))]
    many = {name: values.count() for name, values in parts}
    out = known.sparkSession.range(max(many.values()) if all(many.values()) else 0).withColumnRenamed("id", "draw")
    for name, values in parts:
        out = out.withColumn(f"{name}_no", F.pmod("draw", F.lit(max(many[name], 1)))).join(values, f"{name}_no").drop(f"{name}_no")
    made = _map(out, "draw", ["e3", "linker", "poi"], "whole string", _joined).filter("whole is not null")
    return out.join(made, "draw").select("draw", "e3", "linker", "poi", "whole")


def by_groups(known: DataFrame, e3: str, linker: str, poi: str, n: int, seed: int = 42, hops: int = 1) -> DataFrame:
    """(draw, e3, linker, poi, whole): n draws of what stands at the E3 cut and at the target cut, each by its share among
    the known, then of a ligand with each, and of a linker known beside both; less draws without a linker, those that do
    not join and known combinations. Each combination comes once."""
    from fragmill.operators import sampling, scoring, summaries

    rows = known.select(F.col(e3).alias("e3"), F.col(linker).alias("linker"), F.col(poi).alias("poi")).dropna()
    group = lambda name, label: scoring.attachment_groups(rows.select(name).distinct(), name, name, label, hops).filter("grp is not null").withColumnRenamed("grp", f"{name}_group")
    held = rows.join(group("e3", 2), "e3").join(group("poi", 1), "poi")
    out = known.sparkSession.range(n).withColumnRenamed("id", "draw")
    for k, name in enumerate(("e3", "poi")):
        drawn = sampling.weighted(out.select("draw"), "draw", summaries.distribution(held, f"{name}_group"), f"{name}_group", "share", number=F.pmod(F.xxhash64("draw", F.lit(seed + k)), F.lit(sampling.MODULUS)))
        out = out.join(drawn, "draw")

    def pick(out: DataFrame, keys: list[str], name: str, salt: int) -> DataFrame:
        values = held.select(*keys, name).distinct().withColumn("no", F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(name), name)) - 1)
        counts = held.groupBy(*keys).agg(F.count_distinct(name).alias("many"))
        asked = out.join(counts, keys).withColumn("no", F.pmod(F.xxhash64("draw", F.lit(seed + salt)), F.col("many")).cast("int")).drop("many")
        return asked.join(values, [*keys, "no"]).drop("no")

    out = pick(pick(out, ["e3_group"], "e3", 2), ["poi_group"], "poi", 3)
    both = held.select("e3_group", "linker").distinct().join(held.select("poi_group", "linker").distinct(), "linker")
    ranked = both.withColumn("no", F.row_number().over(Window.partitionBy("e3_group", "poi_group").orderBy(F.xxhash64("linker"), "linker")) - 1)
    counts = both.groupBy("e3_group", "poi_group").agg(F.count(F.lit(1)).alias("many"))
    out = out.join(counts, ["e3_group", "poi_group"]).withColumn("no", F.pmod(F.xxhash64("draw", F.lit(seed + 4)), F.col("many")).cast("int"))
    out = out.join(ranked, ["e3_group", "poi_group", "no"]).select("draw", "e3", "linker", "poi")
    fresh = out.groupBy("e3", "linker", "poi").agg(F.min("draw").alias("draw")).join(rows, ["e3", "linker", "poi"], "left_anti")
    made = _map(fresh, "draw", ["e3", "linker", "poi"], "whole string", _joined).filter("whole is not null")
    return fresh.join(made, "draw").select("draw", "e3", "linker", "poi", "whole")
