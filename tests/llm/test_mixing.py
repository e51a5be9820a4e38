import pytest
from pyspark.sql import functions as F

from fragmill.llm import mixing as M
from fragmill.llm import queries as Q

SF = "/root/testdata/sf0.01"


def test_shortfalls_of_the_table_do_not_depend_on_the_tokenizer(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    targets = spark.read.parquet(f"{SF}/mix_targets.parquet").collect()
    for measure in (len, lambda t: len(M.encoder(M.VOCABULARY).encode_ordinary(t))):
        size = {t.source: sum(measure(d.text or "") for d in docs if d.source == t.source) for t in targets}
        want = {t.source for t in targets if size[t.source] * t.max_repeats < t.target_share * sum(size.values())}
        assert {r.source for r in Q.p7_found(spark, SF).collect()} == want
    shares = Q.p7_shares(spark, SF).collect()
    assert len(shares) == len(targets) and abs(sum(r.reached_share for r in shares) - 1) < 1e-9


@pytest.mark.parametrize("bucket_rows", [3, 50_000])
def test_shares_repeats_and_budget(spark, bucket_rows):
    docs = spark.createDataFrame([(i, "word " * (1 + i % 7), "a" if i % 3 else "b") for i in range(600)] + [(1000, None, "a"), (1001, "", "b"), (1002, "x", None), (1003, "x", "unlisted")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.25, 1), ("b", 0.75, 2), ("none", 0.0, 5)], "source string, target_share double, max_repeats int")
    m = M.Mixture(docs, targets, budget=1500, bucket_rows=bucket_rows)
    rows = m.documents().collect()
    size = {s: sum(r.n_tokens for r in rows if r.source == s) for s in "ab"}
    assert sum(size.values()) <= 1500 and sum(size.values()) > 1480
    assert abs(size["b"] / sum(size.values()) - 0.75) < 0.02
    assert max(r.copy for r in rows) <= 2 and len({(r.doc_id, r.copy) for r in rows}) == len(rows)
    assert [r.finish for r in rows] == sorted(r.finish for r in rows)
    assert {r.doc_id for r in rows if r.copy == 2} <= {r.doc_id for r in rows if r.copy == 1}
    assert not any(r.doc_id in (1002, 1003) for r in rows)


def test_queues_that_run_dry_leave_their_share_to_others(spark):
    docs = spark.createDataFrame([(i, "word " * 5, "a") for i in range(100)] + [(500, "word", "b")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 2), ("gone", 0.1, 1)], "source string, target_share double, max_repeats int")
    m = M.Mixture(docs, targets, budget=800)
    assert {r.source: r.short for r in m.reached().collect()} == {"a": False, "b": True, "gone": True}
    rows = m.documents().collect()
    assert sum(r.source == "b" for r in rows) == 2 and sum(r.n_tokens for r in rows) > 780


def test_empty_tables_and_refusals(spark):
    docs = spark.createDataFrame([(1, "x", "a")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert M.Mixture(docs.limit(0), targets).documents().count() == 0
    assert M.Mixture(docs, targets.limit(0)).documents().count() == 0
    with pytest.raises(ValueError, match="twice"):
        M.Mixture(docs, targets.union(targets))
    with pytest.raises(ValueError, match="lacks"):
        M.Mixture(docs.drop("text"), targets)
    assert M.token_counts(docs.select("text", F.lit(None).cast("string").alias("n")), "n").first().n_tokens == 0
