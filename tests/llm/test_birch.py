import random

import numpy as np

from fragmill.llm import birch as B
from fragmill.llm import queries as Q

SF = "/root/testdata/sf0.001"


def test_planted_groups_come_back(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("cnospf()=#[]123456789") for _ in range(n))
    base = [word(150) for _ in range(6)]
    rows = []
    for i in range(900):
        s = list(base[i % 6 if i % 3 else 0])  # one group holds more than a third
        s[rng.randrange(150)] = "c"
        rows.append((i, "".join(s)))
    rows += [(5000, None), (5001, ""), (5002, "cc")]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "id long, value string, cluster int").repartition(9)
    c = B.Clustering(df, "id", "value", k=6, leaves=40)
    got = {r.id: r.cluster for r in c.assigned().collect()}
    assert set(got) == set(range(900))
    planted = {i: (i % 6 if i % 3 else 0) for i in range(900)}
    assert len({(planted[i], got[i]) for i in got}) == 6
    d = c.described().collect()
    assert len(d) == 18 and all(x.size == sum(v == x.cluster for v in got.values()) for x in d)
    assert B.Clustering(df.limit(0), "id", "value").assigned().count() == 0


def test_features_are_additive_and_bounded():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 16))
    t = B.Tree(16, width=6, most=60)
    for row in x:
        t.insert(1.0, row, float(row @ row))
    leaves = list(t.leaves())
    assert len(leaves) <= 60 and sum(e[0] for e in leaves) == 2000
    assert np.allclose(sum(e[1] for e in leaves), x.sum(0)) and np.isclose(sum(e[2] for e in leaves), (x**2).sum())


def test_batches_are_single_insertions_together():
    """Sums stay exact and bounded when vectors are absorbed by batches, and inner nodes hold the sums of what is below."""
    rng = np.random.default_rng(2)
    x = np.abs(rng.normal(size=(3000, 16))) + np.repeat(np.eye(16)[:3] * 9, 1000, axis=0)
    x = x[rng.permutation(3000)] / np.linalg.norm(x, axis=1, keepdims=True)
    t = B.Tree(16, width=6, most=60)
    for k in range(0, 3000, 250):
        t.insert_many(x[k : k + 250])
    leaves = list(t.leaves())
    assert len(leaves) <= 60 and sum(e[0] for e in leaves) == 3000 and np.allclose(sum(e[1] for e in leaves), x.sum(0))
    assert np.isclose(t.root.total()[0], 3000) and np.allclose(t.root.total()[1], x.sum(0))
    t.insert_many(np.zeros((0, 16)))


def test_quality_is_a_share(spark):
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)], "id long, grp long")
    clusters = spark.createDataFrame([(1, 0), (2, 0), (3, 7), (4, 2), (5, 2), (6, 2)], "id long, cluster int")
    assert tuple(B.kept_together(groups, clusters).first()) == (5, 2, 0.8)
    assert tuple(B.kept_together(groups.limit(0), clusters).first()) == (0, 0, None)


def test_ward_joins_the_nearest():
    pts = np.array([[0.0], [0.1], [5.0], [5.1], [9.0]])
    label = B.ward(np.ones(5), pts, 3)
    assert label[0] == label[1] and label[2] == label[3] and len(set(label)) == 3
    assert B.ward(np.zeros(0), np.zeros((0, 1)), 3).size == 0


def test_whole_tables(spark):
    rows = Q.p3_clusters(spark, SF).collect()
    assert {r.field for r in rows} == {"protac_smiles", "poi_ligand_smiles_with_direction"} and all(r.rank <= 3 for r in rows)
