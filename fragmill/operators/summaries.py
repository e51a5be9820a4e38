"""Group summaries: distributions, long reports, normalisation, cluster sizes, classification quality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distribution(df: DataFrame, value: str) -> DataFrame:
    """(value, n, share) of non-null values; the total comes from the counted rows, not from df again."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / counts.select(F.sum("n")).scalar())


def conditional(df: DataFrame, given: str, value: str) -> DataFrame:
    """(given, value, n, share): the distribution of value within each given one; nulls in either are skipped."""
    counts = df.filter(F.col(given).isNotNull() & F.col(value).isNotNull()).groupBy(given, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(given)))


def multimap(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, members): the distinct values of each key, sorted. Distinct pairs are made first, so repeats cost no memory."""
    pairs = df.select(key, value).dropna().distinct()
    return pairs.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("members"))


def long_report(df: DataFrame, keys: Sequence[str], metrics: Mapping[str, Column]) -> DataFrame:
    """(keys, metric, reduce, value) for mean, max, min and sample standard deviation over non-null values, one pass."""
    ready = df.select(*keys, *[c.cast("double").alias(n) for n, c in metrics.items()])
    # The deviation of up to one value is null, not NaN.
    reduces = {"mean": F.avg, "max": F.max, "min": F.min, "std": lambda c: F.when(F.count(c) > 1, F.stddev_samp(c))}
    wide = ready.groupBy(*keys).agg(*[f(F.col(n)).alias(f"{n}|{r}") for n in metrics for r, f in reduces.items()])
    entries = F.array(*[F.struct(F.lit(n).alias("metric"), F.lit(r).alias("reduce"), F.col(f"`{n}|{r}`").alias("value")) for n in metrics for r in reduces])
    return wide.select(*keys, F.inline(entries))


def min_max(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """df with ``norm_COLUMN`` in 0..1 within the group; null where a group has no range. The extremes are aggregated
    first and joined, so a hot group is not sorted or held in one task."""
    ends = df.groupBy(group).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.join(ends, group)
    made = {f"norm_{c}": F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) for c in columns}
    return out.withColumns(made).drop(*[f"_{n}_{c}" for c in columns for n in ("lo", "hi")])


def row_std(columns: Sequence[Column]) -> Column:
    """Sample standard deviation across columns; null if any is."""
    mean = sum(columns[1:], columns[0]) / len(columns)
    return F.sqrt(sum(((c - mean) * (c - mean) for c in columns[1:]), (columns[0] - mean) * (columns[0] - mean)) / (len(columns) - 1))


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    """One row: number of groups, and mean, population deviation, least, median, greatest and biased skew of their sizes."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("k"))
    return sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("k").alias("mean"), F.stddev_pop("k").alias("std"), F.min("k").alias("least"), F.median("k").alias("median"), F.max("k").alias("most"), F.skewness("k").alias("skew"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n)."""
    return df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def precision_recall(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(class, support, precision, recall, f1) from the confusion table; undefined ratios are null."""
    counts = confusion(df, truth, predicted)
    entries = F.array(F.struct(F.col(truth).alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("given")), F.struct(F.col(predicted).alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("given")))
    margins = counts.select(F.inline(entries)).groupBy("class").agg(F.sum("support").alias("support"), F.sum("given").alias("given"))
    hits = counts.filter(F.col(truth) == F.col(predicted)).select(F.col(truth).alias("class"), F.col("n").alias("hit"))
    out = margins.join(hits, "class", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    p, r = F.try_divide("hit", "given"), F.try_divide("hit", "support")
    return out.select("class", "support", p.alias("precision"), r.alias("recall"), F.try_divide(2 * F.col("hit"), F.col("given") + F.col("support")).alias("f1"))


def vector_centroids(df: DataFrame, vector: str, group: str) -> DataFrame:
    """(group, centroid): the mean vector of each group, place by place."""
    flat = df.select(group, F.posexplode(vector).alias("at", "x")).groupBy(group, "at").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return flat.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "m"))), lambda s: s["m"]).alias("centroid"))


def medoids(df: DataFrame, key: str, vector: str, group: str) -> DataFrame:
    """(group, medoid, size): the member nearest to the centroid, the smallest key on ties."""
    far = F.aggregate(F.zip_with(vector, "centroid", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x)
    near = df.join(vector_centroids(df, vector, group), group).withColumn("d", F.round(far, 9))
    return near.groupBy(group).agg(F.min_by(key, F.struct("d", key)).alias("medoid"), F.count(F.lit(1)).alias("size"))


def pivot_counts(df: DataFrame, row: str, column: str, names: Sequence[str], value: str) -> DataFrame:
    """(row, names): how many distinct values each row has in each named column value. The names are given, so nothing is
    collected to find them; values of other names are not counted."""
    wide = df.filter(F.col(column).isin(*names)).select(row, column, value).distinct().groupBy(row).pivot(column, list(names)).agg(F.count(value))
    return wide.na.fill(0, list(names))


def perplexity(df: DataFrame, key: str, loss: Column) -> DataFrame:
    """(key, tokens, perplexity): exp of the mean loss of a sequence's tokens; null losses (padding) do not count."""
    return df.groupBy(key).agg(F.count(loss).alias("tokens"), F.exp(F.avg(loss)).alias("perplexity"))


def finite(value: Column) -> Column:
    """Null for what JSON cannot say: NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def display_name(value: Column) -> Column:
    """``has_three_parts`` as ``Has Three Parts``."""
    return F.initcap(F.translate(value, "_", " "))


def note(**values: Column) -> Column:
    """``(key=value)`` for each given value, in their order; null values as None."""
    return F.concat(*[F.concat(F.lit(f"({k}="), F.coalesce(v.cast("string"), F.lit("None")), F.lit(")")) for k, v in values.items()])


def prefixed(df: DataFrame, *prefixes: str) -> DataFrame:
    """The columns whose names start with any prefix, in the order of their names."""
    return df.select(*[F.col(f"`{c}`") for c in sorted(df.columns) if c.startswith(prefixes)])
