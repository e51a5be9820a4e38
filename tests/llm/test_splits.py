import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fragmill.llm import queries as Q
from fragmill.llm import splits as S

SF = "/root/testdata/sf0.01"
DROP = re.compile(r"[^a-z0-9()\[\]=#@+\-/\\%*:.]")


def fold(s):
    return DROP.sub("", s.lower()) if s else ""


def union(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for ident, keys in rows:
        find(("r", ident))
        for k in keys:
            if k is not None:
                parent[find(("k", k))] = find(("r", ident))
    least = {}
    for ident, _ in rows:
        root = find(("r", ident))
        least[root] = min(least.get(root, ident), ident)
    return {ident: least[find(("r", ident))] for ident, _ in rows}


def brute(spark):
    rows = []
    for r in spark.read.parquet(f"{SF}/curated.parquet").collect():
        e, p = fold(r.e3_binder_smiles_with_direction), fold(r.poi_ligand_smiles_with_direction)
        rows.append((r.row_id, [x for x in (e and "e" + e, p and "p" + p) if x]))
    for r in spark.read.parquet(f"{SF}/finetuning.parquet").collect():
        keys = []
        for x in fold(r.labels).split("."):
            if "[*:2]" in x and "[*:1]" not in x:
                keys.append("e" + x)
            if "[*:1]" in x and "[*:2]" not in x:
                keys.append("p" + x)
        rows.append((r.sample_id, keys))
    return union(rows)


def test_whole_tables(spark):
    want = brute(spark)
    sizes = Counter(want.values())
    got = sorted(map(tuple, Q.p5_found(spark, SF).collect()))
    assert got == sorted((k, v) for k, v in want.items() if sizes[v] > 1)
    assigned = Q.p5_splits(spark, SF).collect()
    assert len(assigned) == len(want)
    sides = defaultdict(set)
    for r in assigned:
        sides[want[r.rec_id]].add(r.split)
    assert all(len(x) == 1 for x in sides.values())


def test_hot_entity_chain_nulls_and_repeats(spark):
    rows = [(i, ["hot", f"e{i}"]) for i in range(300)] + [(1000 + i, [f"c{i}", f"c{i + 1}"]) for i in range(200)]
    rows += [(2000, None), (2001, []), (2002, [None]), (2003, ["z", "z", None]), (2003, ["y"]), (2004, ["y", "e7"])]
    df = spark.createDataFrame([(i, k, "n") for i, k in rows], "rec_id long, entities array<string>, component string")
    got = {(r.rec_id, r.group_id) for r in S.groups(df).collect()}
    want = union([(i, k or []) for i, k in rows])
    # The two rows of id 2003 share no key: the operator groups rows, so each follows its own keys.
    assert {g for g in got if g[0] != 2003} == {(k, 0 if k == 2004 else v) for k, v in want.items() if k != 2003}
    assert S.groups(df.limit(0)).count() == 0


def test_rendezvous_meets_shares_and_moves_little(spark):
    df = spark.range(40000).select(F.col("id").alias("g"))
    three = {"train": 0.8, "validation": 0.1, "test": 0.1}
    a = df.select("g", S.rendezvous(F.col("g"), three).alias("a"), S.rendezvous(F.col("g"), three | {"extra": 0.1}).alias("b")).collect()
    share = Counter(r.a for r in a)
    assert abs(share["train"] / 40000 - 0.8) < 0.01 and abs(share["test"] / 40000 - 0.1) < 0.01
    assert all(r.a == r.b or r.b == "extra" for r in a)
    with pytest.raises(ValueError, match="positive"):
        S.rendezvous(F.col("g"), {"train": 0})


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_shares_are_met_on_the_tables(spark, sf):
    share = {r.split: r.share for r in Q.p5_shares(spark, f"/root/testdata/{sf}").collect()}
    assert abs(share["train"] - 0.8) < 0.01 and abs(share["validation"] - 0.1) < 0.01 and abs(share["test"] - 0.1) < 0.01


def test_large_groups_go_where_most_is_due(spark):
    where, due = S.placed_first([(30, 1), (30, 2), (5, 3), (5, 4)], {"a": 0.6, "b": 0.4}, 100)
    assert where == {1: "a", 2: "b", 3: "a", 4: "a"} and due == {"a": 20.0, "b": 10.0}
    rows = [(i, ["hot"]) for i in range(3000)] + [(3000 + i, [f"g{i // 3}"]) for i in range(6000)] + [(9000 + i, None) for i in range(1000)]
    df = spark.createDataFrame(rows, "rec_id long, entities array<string>")
    for large in (1e-4, 1e-2):  # with the second only the hot group is placed first, all others by rendezvous
        got = S.assign(df, {"train": 8, "validation": 1, "test": 1}, large=large).collect()
        n = Counter(r.split for r in got)
        assert len(got) == 10000 and abs(n["train"] / 10000 - 0.8) < 0.02 and abs(n["test"] / 10000 - 0.1) < 0.02
        assert len({r.split for r in got if r.rec_id < 3000}) == 1
    assert S.assign(df.limit(0), {"train": 1}).count() == 0 and S.shares(S.assign(df.limit(0), {"train": 1})).count() == 0
    with pytest.raises(ValueError, match="positive"):
        S.assign(df, {})
