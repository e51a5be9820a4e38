import random

import numpy as np

from fragmill.llm import grams
from fragmill.llm import overlap as O
from fragmill.llm import queries as Q

SF = "/root/testdata/sf0.01"


def brute(rows, fields=("text", "labels")):
    from tests.llm.test_splits import fold

    found = set()
    for f in fields:
        held = [(r["sample_id"], r["split_name"] == "train", grams.gram_set(fold(r[f]).split("."))) for r in rows]
        train, other = [x for x in held if x[1]], [x for x in held if not x[1]]
        for a in train:
            for b in other:
                if a[2] and b[2] and min(len(a[2]), len(b[2])) >= 0.9 * max(len(a[2]), len(b[2])) and grams.similarity(a[2], b[2]) >= 0.9:
                    found.add((min(a[0], b[0]), max(a[0], b[0])))
    return found


def test_whole_table(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/finetuning.parquet").collect()]
    want = brute(rows)
    got = list(map(tuple, Q.p4_found(spark, SF).collect()))
    assert len(got) == len(set(got)) and set(got) == want
    report = Q.p4_report(spark, SF).collect()
    outside = {b if next(r for r in rows if r["sample_id"] == a)["split_name"] == "train" else a for a, b in want}
    assert sum(r.overlapping for r in report) == len(outside)
    assert sum(r.rows for r in report) == sum(r["split_name"] != "train" for r in rows)


def test_orders_copies_nulls_short_and_long(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("cnospf()=#123456789") for _ in range(n))
    a, b, c = word(90), word(40), word(80)
    rows = [(i, "train", f"{a}.{b}.{c}", None) for i in range(40)] + [(100 + i, "test", f"{c}.{a.upper()} .{b}", "") for i in range(40)]
    rows += [(200, "test", f"{a}.{b}.{c[:-3]}", "x"), (201, None, f"{a}.{b}.{word(80)}", "x"), (202, "held_out", a + b + c, None), (203, "train", "ccc", "nnn"), (204, "test", "ccc", "nnn"), (205, "train", "cccc", None), (206, "test", "C c c c", None), (207, "train", word(20000), None), (208, "test", None, None)]
    rows += [(209, "test", rows[-2][2][:19500], None)]
    df = spark.createDataFrame([(*r, "s", "s") for r in rows], "sample_id long, split_name string, text string, labels string, record string, field string")
    got = O.pairs(df, "sample_id", ["text", "labels"], "split_name").collect()
    want = brute([dict(zip(("sample_id", "split_name", "text", "labels"), (r[0], r[1], r[2] or "", r[3] or ""), strict=True)) for r in rows])
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert O.pairs(df.limit(0), "sample_id", ["text"], "split_name").count() == 0


def test_similar_records_share_a_key():
    """No pair at or above the threshold is without a common key, whichever side is wide and whatever the sizes."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("cnospf()=#123456789") for _ in range(n))
    seen = 0
    for threshold in (0.7, 0.9, 0.95):
        for _ in range(400):
            x = word(rng.choice([4, 5, 6, 9, 15, 40, 120, 300]))
            y = list(x)
            for _ in range(rng.randrange(1 + len(x) // 25)):
                at = rng.randrange(len(y))
                y[at : at + rng.randrange(2)] = word(rng.randrange(2))
            y = "".join(y) + word(rng.choice([0, 0, 1, 2, len(x) // 9]))
            a, b = grams.gram_set([x]), grams.gram_set([y])
            if a and b and grams.similarity(a, b) >= threshold:
                seen += 1
                for one, two in ((x, y), (y, x)):
                    assert set(O.shared_keys([[one]], threshold, False)[1]) & set(O.shared_keys([[two]], threshold, True)[1])
    assert seen > 300


def test_candidates_grow_with_the_records():
    """Pairs that reach the comparison of texts stay in proportion to true pairs from one scale to the next."""
    import pyarrow.parquet as pq

    from tests.llm.test_splits import fold

    ratio = []
    for sf in ("sf0.01", "sf0.1"):
        rows = pq.read_table(f"/root/testdata/{sf}/finetuning.parquet", columns=["text", "split_name"]).to_pylist()
        one, two = (sorted({fold(r["text"]) for r in rows if (r["split_name"] == "train") == train} - {""}) for train in (True, False))
        by: dict = {}
        for n, key in zip(*O.shared_keys([v.split(".") for v in one], 0.9, False), strict=True):
            by.setdefault(key, []).append(n)
        met = {(a, b) for b, key in zip(*O.shared_keys([v.split(".") for v in two], 0.9, True), strict=True) for a in by.get(key, ())}
        sims = grams.pair_similarities([one[a] for a, _ in met], [two[b] for _, b in met], True)
        ratio.append((sims >= 0.7).sum() / (sims >= 0.9).sum())
    assert ratio[1] <= 2 * ratio[0]


def test_winnowing_shares_any_long_stretch():
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("cnosp()=123456789") for _ in range(n))
    for _ in range(200):
        shared = word(27)
        x, y = word(rng.randrange(40)) + shared + word(rng.randrange(40)), word(rng.randrange(40)) + shared + word(rng.randrange(40))
        row, value = O.fingerprints([[x], [y]], 16, 12)
        assert set(value[row == 0]) & set(value[row == 1])


def test_alignment():
    x = "abcdefghijklmnopqrstuvwxyz0123456789" * 2
    anchors, cx, cy = O.align([x], [x[:30] + "__" + x[30:]], 16, 12)
    assert anchors >= 2 and cx == len(x) and cy == len(x)
    assert O.align([], ["a"], 16, 12) == (0, 0, 0)
    row, value = O.fingerprints([["abc"], [], [""], ["abc"]], 16, 12)
    assert row.tolist() == [0, 3] and value[0] == value[1] and isinstance(value, np.ndarray)
