import re
from collections import defaultdict

import pytest

from fragmill.llm import duplicates as D

SF = "/root/testdata/sf0.01"
DROP = re.compile(r"[^a-z0-9()\[\]=#@+\-/\\%*:.]")
COLS = ["protac_smiles", "e3_binder_smiles", "poi_ligand_smiles"]


def fold(s):
    return DROP.sub("", s.lower()) if s else ""


def brute(rows, ident, cols):
    sets = defaultdict(list)
    for r in rows:
        sets[tuple(sorted(fold(r[c]) for c in cols))].append(r[ident])
    return sorted((i, min((x for x in ids if x is not None), default=None)) for ids in sets.values() for i in ids)


@pytest.mark.parametrize("partitions", [1, 4, 37])
def test_whole_table(spark, partitions):
    df = spark.read.parquet(f"{SF}/curated.parquet")
    got = sorted(map(tuple, D.copies(df, "row_id", COLS, partitions).collect()))
    assert got == brute(df.collect(), "row_id", COLS)
    counts = dict(map(tuple, D.collapse(df, "row_id", COLS, partitions).collect()))
    assert sum(counts.values()) == df.count()


def test_hot_record_is_spread_over_partitions(spark):
    rows = [(i, "C c1" if i % 3 == 0 else f"x{i}", "N", None) for i in range(3000)]
    df = spark.createDataFrame(rows, "row_id long, a string, b string, c string")
    got = sorted(map(tuple, D.copies(df, "row_id", ["a", "b", "c"], 16).collect()))
    assert got == brute([dict(zip(["row_id", "a", "b", "c"], r, strict=True)) for r in rows], "row_id", ["a", "b", "c"])


def test_nulls_blanks_ties_long_and_clashing_names(spark):
    rows = [(1, None, None, "k"), (2, "", " ", "k"), (3, "CC", "N", "k"), (4, "n", "c C", "k"), (4, "N", "CC", "k"), (5, "C" * 200000, None, "k"), (6, None, "c" * 200000 + " ", "k"), (7, "CN", "C", "k")]
    df = spark.createDataFrame(rows, "id long, head string, part string, key string")
    assert sorted(map(tuple, D.copies(df, "id", ["head", "part"], 5).collect())) == [(1, 1), (2, 1), (3, 3), (4, 3), (4, 3), (5, 5), (6, 5), (7, 7)]
    assert D.copies(df.limit(0), "id", ["head", "part"], 5).count() == 0
    orphan = spark.createDataFrame([(None, "C"), (9, "c"), (None, "N")], "id long, a string")
    assert sorted(map(tuple, D.copies(orphan, "id", ["a"], 3).collect()), key=str) == [(9, 9), (None, 9), (None, None)]
    with pytest.raises(ValueError, match="lacks nosuch"):
        D.copies(df, "id", ["nosuch"])
