import random

import numpy as np

from fragmill.llm import clusters as C
from fragmill.llm import grams
from fragmill.llm import queries as Q

SF = "/root/testdata/sf0.001"


def brute(rows, threshold=0.7):
    from tests.llm.test_splits import fold

    held = [(i, s, grams.gram_set([fold(v)])) for i, s, v in rows]
    parent = {i: i for i, _, _ in held}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, s, g) in enumerate(held):
        for j, t, h in held[n + 1 :]:
            if s == t and grams.similarity(g, h) >= threshold:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    sizes = {}
    for i, _, _ in held:
        sizes[find(i)] = sizes.get(find(i), 0) + 1
    return sorted((i, find(i)) for i, _, _ in held if sizes[find(i)] > 1)


def test_whole_tables(spark):
    rows = [tuple(r) for r in Q._molecules(spark, SF).collect()]
    assert sorted(map(tuple, Q.p3_found(spark, SF).collect())) == brute(rows)


def test_chain_hot_group_nulls_short_and_long(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("cnospf()=#[]123456789") for _ in range(n))
    chain = [word(400)]
    for _ in range(12):  # each step changes a stretch; the ends of the chain share little
        s = list(chain[-1])
        at = rng.randrange(0, 350)
        s[at : at + 30] = word(30)
        chain.append("".join(s))
    hot = word(200)
    rows = [(i, 0, c) for i, c in enumerate(chain)] + [(100 + i, 0, hot[: 190 + i % 10].upper() + " ") for i in range(150)] + [(400 + i, 0, hot) for i in range(150)]
    rows += [(900, 0, None), (901, 0, ""), (902, 0, "c c"), (903, 0, "ccc"), (904, 1, hot), (905, 0, "c" * 100000), (906, 0, "C" * 50000), (907, 0, word(90000))]
    df = spark.createDataFrame([(i, s, v, 1) for i, s, v in rows], "id long, space int, value string, grp int")
    got = sorted((r.id, r.cluster) for r in C.linked(df, "id", "value", "space").collect())
    assert got == brute([(i, s, v or "") for i, s, v in rows])
    assert C.linked(df.limit(0), "id", "value").count() == 0


def test_links_that_bands_miss(spark):
    """One band of many hashes joins next to nothing; the groups must still be those of brute force."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("cnospf()=#[]123456789") for _ in range(n))
    rows = []
    for k in range(40):
        base = word(200)
        rows += [(10 * k, 0, base), (10 * k + 1, 0, base[:165] + word(35)), (10 * k + 2, 0, base[:170] + word(30)), (10 * k + 3, k % 2, word(30) + base[35:])]
    df = spark.createDataFrame(rows, "id long, space int, value string")
    want = brute(rows)
    assert want
    for bands in ({"rows": 8, "first_bands": 1, "all_bands": 1}, {"rows": 64, "first_bands": 1, "all_bands": 2}, {}):
        assert sorted((r.id, r.cluster) for r in C.linked(df, "id", "value", "space", **bands).collect()) == want


def test_values_are_folded_once_and_stand_for_all_equal_ones(spark, monkeypatch):
    """p3_found: a text is folded once, and equal values go through all steps as one."""
    plans, kept, keep = [], [], C.Scratch.keep

    def seen(self, df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        kept.append(keep(self, df))
        return kept[-1]

    monkeypatch.setattr(C.Scratch, "keep", seen)
    rows = [(i, "CCOc1ccccc1" + " " * (i % 3)) for i in range(50, 0, -1)] + [(100, "NCCCCN"), (101, None), (None, "NCCCCN")]
    df = spark.createDataFrame(rows, "id long, value string")
    assert sorted(map(tuple, C.linked(df, "id", "value").collect())) == [(i, 1, 50) for i in range(1, 51)]
    assert plans[0].count("regexp_replace") == 1
    assert sorted(r.id for r in kept[1].collect()) == [1, 100]


def test_folding_keeps_the_characters_of_molecules(spark):
    import re

    from pyspark.sql import functions as F

    from fragmill.functions.text import fold

    text = "".join(map(chr, range(1, 0x180))) + "\u2028\uff21\U0001f600"
    got = spark.createDataFrame([(text,)], "v string").select(fold(F.col("v"))).first()[0]
    assert got == re.sub(r"[^a-z0-9()\[\]=#@+\-/\\%*:.]", "", text.lower())


def test_minhash_estimates_similarity():
    rng = random.Random(3)
    base = "".join(rng.choice("cnosp()=123") for _ in range(300))
    other = base[:250] + "".join(rng.choice("cnosp()=123") for _ in range(50))
    signed = grams.Signer(2000).sign(*grams.flatten([[base], [other]]))
    true = grams.similarity(grams.gram_set([base]), grams.gram_set([other]))
    assert abs(float(np.mean(signed[0] == signed[1])) - true) < 0.04
