"""Sampling and generation by hash: the same rows on every run and any number of executors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime, and the factor nearest to its golden section: multiples of it spread evenly over the prime's remainders.
MODULUS, FACTOR = 2147483647, 1327217885


def drawn(key: Column, seed: int) -> Column:
    """A number in 0..MODULUS-1 from an integer key, by arithmetic any SQL engine has; no key overflows."""
    return F.pmod(F.pmod(key, F.lit(MODULUS)) * FACTOR + F.lit(seed), F.lit(MODULUS))


def weighted(rows: DataFrame, key: str, shares: DataFrame, value: str, share: str, seed: int = 42, most: int = 100_000, number: Column | None = None) -> DataFrame:
    """(key, value): for each row a value drawn with the given shares, by inverse distribution; null if there is none.
    ``number`` is what is drawn by, 0..MODULUS-1, instead of one from an integer key.

    shares is a small table of (value, share), shares relative to their sum; more than ``most`` rows are refused. Every
    value whose share exceeds one in MODULUS can be drawn. Nulls and shares of nought or less are left out.
    """
    import numpy as np

    held = shares.select(F.col(value).alias("v"), F.col(share).cast("double").alias("s")).dropna().filter("s > 0").limit(most + 1).collect()
    if len(held) > most:
        raise ValueError(f"more than {most} values to draw from")
    steps = sorted((r.v, r.s) for r in held)
    upto = np.cumsum([s for _, s in steps])
    upto = upto / upto[-1] if steps else upto
    kind = shares.schema[value].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = batch.column(1).to_numpy(zero_copy_only=False) / MODULUS
            at = np.minimum(np.searchsorted(upto, u, side="right"), len(steps) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int32))], names=["key", "at"])

    table = rows.sparkSession.createDataFrame([(i, v) for i, (v, _) in enumerate(steps)], f"at int, `{value}` {kind}")
    numbers = rows.select(F.col(key).alias("key"), F.coalesce(drawn(F.col(key).cast("long"), seed) if number is None else number, F.lit(0)).alias("u"))
    out = numbers.mapInArrow(place, f"key {rows.schema[key].dataType.simpleString()}, at int")
    return out.join(F.broadcast(table), "at", "left").select(F.col("key").alias(key), value)


def repeat_some(df: DataFrame, key: str, repeats: int, percent: int, seed: int = 7) -> DataFrame:
    """Each row once, or ``repeats`` times for about ``percent`` of the keys; ``copy`` counts from 0."""
    n = F.when(drawn(F.col(key), seed) % 100 < percent, repeats).otherwise(1)
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), n - 1)))


def kth(df: DataFrame, key: str, k: int, buckets: int = 4096, few: int = 100_000):
    """The k-th smallest value (from 1) of a numeric column: counts of value ranges narrow down where it is, so no task
    ever holds more than ``few`` rows. Nulls are left out."""
    rows, x = df.select(F.col(key).alias("k")).dropna(), F.col("k").cast("double")
    while True:
        low, high, n = rows.agg(F.min("k"), F.max("k"), F.count(F.lit(1))).first()
        if n <= few or float(low) == float(high):
            return low if low == high else rows.orderBy("k").limit(k).agg(F.max("k")).first()[0]
        at = F.least(F.floor((x - F.lit(float(low))) / F.lit((float(high) - float(low)) / buckets)), F.lit(buckets - 1))
        for bucket, held in sorted(tuple(r) for r in rows.groupBy(at.alias("at")).count().collect()):  # at most ``buckets`` rows
            if k <= held:
                break
            k -= held
        rows = rows.filter(at == bucket)


def first_share(df: DataFrame, key: str, ratio: float) -> DataFrame:
    """The first int(ratio * n) rows by a numeric key, of equal keys any; all for 0 or 1. The cut is found by counting
    ranges, and taken by a filter. Null keys come last."""
    if not 0 <= ratio <= 1:
        raise ValueError("ratio must be in 0..1")
    if ratio in (0, 1):
        return df
    known = df.filter(F.col(key).isNotNull()).count()
    want = int(ratio * df.count())
    if want == 0:
        return df.limit(0)
    if want > known:
        return df.filter(F.col(key).isNotNull()).union(df.filter(F.col(key).isNull()).limit(want - known))
    cut = F.lit(kth(df, key, want))
    below = df.filter(F.col(key) < cut)
    return below.union(df.filter(F.col(key) == cut).limit(want - below.count()))
