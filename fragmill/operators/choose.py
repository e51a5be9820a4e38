"""Choosing among candidates: fallback, escalation, ranking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fallback(df: DataFrame, methods: Sequence[tuple[str, Column]], value: str = "chosen", name: str = "method") -> DataFrame:
    """df with the first method's value that is not null, and its name; the last method's name if all are null."""
    chosen = F.coalesce(*[c for _, c in methods])
    who = reduce(lambda acc, m: F.when(m[1].isNotNull(), F.lit(m[0])).otherwise(acc), reversed(methods[:-1]), F.lit(methods[-1][0]))
    return df.withColumns({value: chosen, name: who})


def patch(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of first; where its value is null, the second's value and name take its place even if null.

    ``second`` need only hold the failed keys; it has (key, value, method). Each key stands at most once in it.
    """
    later = second.select(F.col(key), F.col(value).alias("_later"), F.col("method").alias("_who"))
    out = first.join(later, key, "left")
    failed = F.col(value).isNull() & F.col("_who").isNotNull()
    return out.withColumns({value: F.when(failed, F.col("_later")).otherwise(F.col(value)), "method": F.when(failed, F.col("_who")).otherwise(F.col("method"))}).drop("_later", "_who")


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """For each key the columns of the row that comes first; pre-aggregated, so a hot key costs no more than any other.

    Nulls in the order come first, as in a struct comparison: fill them before.
    """
    best = F.min_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(*key).agg(best.alias("_b")).select(*key, *[F.col("_b")[c].alias(c) for c in columns])


def escalate(stages: Sequence[tuple[Column, Column]], start: Column, rank: Column, flagged: Column) -> tuple[Column, Column]:
    """(value, rank) after stages of (candidate, candidate's rank): a row still flagged takes a stage's candidate only if
    its rank is strictly smaller. ``flagged`` is computed on the rank struct's field ``n_flags``."""
    state = F.struct(start.alias("value"), rank.alias("rank"), flagged.alias("flagged"))
    for value, r in stages:
        better = state["flagged"] & value.isNotNull() & (r < state["rank"])
        state = F.when(better, F.struct(value.alias("value"), r.alias("rank"), (r["n_flags"] > 0).alias("flagged"))).otherwise(state)
    return state["value"], state["rank"]


def top_n(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key with their place ``rank``; the limit is applied before the shuffle as well."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("rank") <= n)


def top_n_padded(df: DataFrame, key: str, order: Sequence[Column], value: str, n: int, pad: int = -1) -> DataFrame:
    """(key, top): an array of exactly n values, filled up with ``pad``."""
    rows = top_n(df, [key], order, n).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", value))).alias("r"))
    got = F.transform("r", lambda x: x[value])
    return rows.select(key, F.concat(got, F.array_repeat(F.lit(pad).cast("long"), n - F.size("r"))).alias("top"))


def margin(df: DataFrame, key: str, score: str) -> DataFrame:
    """(key, best, margin): the highest score and its lead over the second (null if there is none)."""
    rows = top_n(df.filter(F.col(score).isNotNull()), [key], [F.col(score).desc()], 2)
    one, two = (F.max(F.when(F.col("rank") == k, F.col(score))) for k in (1, 2))
    return rows.groupBy(key).agg(one.alias("best"), (one - two).alias("margin"))


def argmax_per_class(df: DataFrame, key: str, classes: Mapping[str, Column], value: str, score: str, none: int = -1) -> DataFrame:
    """For each key and class the value with the highest score (the smallest value on ties), ``none`` if the class is empty."""
    best = [F.coalesce(F.min_by(F.when(c, F.col(value)), F.when(c, F.struct((-F.col(score)).alias("s"), F.col(value).alias("v")))), F.lit(none).cast("long")).alias(n) for n, c in classes.items()]
    return df.groupBy(key).agg(*best)


def best_index(scores: Sequence[Column]) -> Column:
    """The place of the highest score, the lowest place on ties; nulls are skipped, null if all are."""
    whole = F.array(*scores)
    top = F.array_max(whole)
    return F.when(top.isNotNull(), F.array_position(whole, top).cast("int") - 1)
