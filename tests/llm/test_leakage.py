from collections import defaultdict

import pytest

from fragmill.llm import leakage as L
from fragmill.llm import queries as Q

SF = "/root/testdata/sf0.01"


def words(s):
    out = []
    for p in (s or "").split():
        p = p.lower()
        while p and not p[0].isalnum():
            p = p[1:]
        while p and not p[-1].isalnum():
            p = p[:-1]
        out += [p] if p else []
    return out


def brute(docs, items, n=12):
    at = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(len(w) - n + 1):
            at[tuple(w[k : k + n])].add(i)
    found = set()
    for d, t in docs:
        w = words(t)
        for k in range(len(w) - n + 1):
            found |= {(d, i) for i in at.get(tuple(w[k : k + n]), ())}
    return found


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.item_text) for r in spark.read.parquet(f"{SF}/heldout_items.parquet").collect()]
    assert set(map(tuple, Q.p6_found(spark, SF).collect())) == brute(docs, items)


ITEM = " ".join(f"w{i}" for i in range(30))


@pytest.mark.parametrize("block_words", [10, 1_000_000])
def test_exact_runs_at_any_place_and_block_size(spark, block_words):
    w = ITEM.split()
    docs = [(k, "x\u00a0y " + "  ".join(w[k : k + 12]).upper() + "\tz") for k in range(19)] + [(100 + k, " ".join(["q"] * 50 + w[k : k + 11])) for k in range(5)]
    docs += [(200, ""), (201, None), (202, "(" + ITEM.replace(" ", ", ") + ")"), (203, " ".join([ITEM] * 3)), (203, " ".join([ITEM] * 3)), (204, "w " * 100000 + ITEM), (205, "... --- ???")]
    items = [(1, ITEM), (2, "a short one"), (3, None), (4, ""), (5, ITEM + " tail"), (6, " ".join(f"w{i}" for i in range(40, 60)))]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, item_text string")
    rows = L.leaks(d, i, block_words=block_words).filter("exact_run >= 12").select("doc_id", "item_id").collect()
    assert set(map(tuple, rows)) == brute(docs, items)
    assert sum(r.doc_id == 203 and r.item_id == 1 for r in rows) == 2
    assert L.leaks(d.limit(0), i).count() == 0 and L.leaks(d, i.limit(0)).count() == 0


def test_substituted_words_are_tolerated(spark):
    w = ITEM.split()
    w[10] = w[20] = "other"
    d = spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")
    i = spark.createDataFrame([(1, ITEM)], "item_id long, item_text string")
    r = L.leaks(d, i).first()
    assert (r.matched_words, r.stretch_words, r.exact_run, r.item_words) == (28, 30, 10, 30)


def test_masks_fit_the_run():
    with pytest.raises(ValueError, match="spans more"):
        L.Index([(1, "a b")], masks=((0, 12),))
