"""Quality flags of rows: counting, naming, ordering and reporting them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_flags(df: DataFrame, flags: Mapping[str, Column] | Sequence[str]) -> DataFrame:
    """df with boolean ``flag_NAME`` columns, ``n_flags`` and ``review_reasons`` (names of the true ones in the given
    order, joined by semicolons; null if none). A null flag counts as false."""
    if isinstance(flags, Mapping):
        df = df.withColumns({f"flag_{n}": F.coalesce(c, F.lit(False)) for n, c in flags.items()})
        names = list(flags)
    else:
        names = [f.removeprefix("flag_") for f in flags]
    at = lambda n: F.coalesce(F.col(f"flag_{n}"), F.lit(False))
    total = sum((at(n).cast("int") for n in names), F.lit(0))
    reasons = F.concat_ws(";", *[F.when(at(n), F.lit(n)) for n in names])
    return df.withColumns({"n_flags": total, "review_reasons": F.when(reasons != "", reasons)})


def flag_frequency(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(flag, n, share), one row a flag; one pass over df. The share of no rows is null."""
    sums = df.agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(F.coalesce(F.col(f"flag_{n}"), F.lit(False)).cast("long")), F.lit(0)).alias(n) for n in names])
    entries = F.array(*[F.struct(F.lit(n).alias("flag"), F.col(n).alias("n")) for n in names])
    return sums.select("rows", F.inline(entries)).select("flag", "n", F.try_divide("n", "rows").alias("share"))
