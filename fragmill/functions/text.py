"""Text expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character outside this class is dropped by folding (after lower-casing). Single characters are looked up in one
#: table; a range in a class, as a-z, makes each character cost three times as much.
FOLD_DROP = r"[^abcdefghijklmnopqrstuvwxyz0123456789()\[\]=#@+\-/\\%*:.]"


def fold(value: Column) -> Column:
    """Lower-cased, without any character that has no meaning in a molecule string; null becomes the empty string."""
    return F.regexp_replace(F.lower(F.coalesce(value.cast("string"), F.lit(""))), FOLD_DROP, "")


def fingerprint128(value: Column) -> Column:
    """16 bytes that stand for a string as a key: equal strings have equal bytes, and a clash is negligible at any size."""
    return F.unhex(F.md5(value))
