import numpy as np
import pytest
from pyspark.sql import functions as F

from fragmill import cli
from fragmill.chem import molecule as m
from fragmill.operators import dictionary, generate, graph, learning, sampling, summaries
from fragmill.sources import sinks, tables

SF = "/root/testdata/sf0.001"


def molecules_csv(spark, folder, n=6):
    rows = spark.read.parquet(f"{SF}/controls.parquet").limit(n).collect()
    label = lambda r: ".".join((r.e3_binder_smiles_with_direction, r.linker_smiles_with_direction, r.poi_ligand_smiles_with_direction))
    df = spark.createDataFrame([(r.protac_smiles, label(r), label(r)) for r in rows], "smiles string, labels string, default_pred_n0 string")
    sinks.write_table(df, f"{folder}/in", kind="csv")
    return f"{folder}/in", rows


def test_jobs_of_the_command_line(spark, tmp_path, capsys):
    path, rows = molecules_csv(spark, tmp_path)
    assert cli.run(spark, ["split", "--smiles", rows[0].protac_smiles, "--strategy", "heuristic"]) == 0
    line = capsys.readouterr().out.strip().split(",")
    assert line[0] == rows[0].protac_smiles and m.reassembles(".".join(line[1:4]), line[0])
    assert cli.run(spark, ["split", "--input", path, "--output", f"{tmp_path}/out"]) == 0
    got = tables.load(spark, f"{tmp_path}/out").collect()
    assert len(got) == len(rows) and all(m.reassembles(r.default_pred_n0, r.smiles) for r in got)
    assert cli.run(spark, ["score", "--input", path, "--output", f"{tmp_path}/scores"]) == 0
    assert all(r.all_ligands_equal == "true" for r in tables.load(spark, f"{tmp_path}/scores").collect())
    known = spark.createDataFrame([x for r in rows for x in (("e3", r.e3_binder_smiles_with_direction), ("poi", r.poi_ligand_smiles_with_direction))], "role string, ligand string")
    sinks.write_table(known, f"{tmp_path}/known", kind="csv")
    assert cli.run(spark, ["curate", "--input", path, "--dictionary", f"{tmp_path}/known", "--output", f"{tmp_path}/cut", "--grown", f"{tmp_path}/grown"]) == 0
    assert tables.load(spark, f"{tmp_path}/cut").count() > 3 and tables.load(spark, f"{tmp_path}/grown").count() > known.distinct().count()
    assert cli.run(spark, ["fit", "--input", path, "--model", f"{tmp_path}/model"]) == 0
    assert cli.run(spark, ["split", "--input", path, "--strategy", "classifier", "--model", f"{tmp_path}/model", "--output", f"{tmp_path}/out2"]) == 0
    assert tables.load(spark, f"{tmp_path}/out2").filter("default_pred_n0 is not null").count() == len(rows)
    assert cli.run(spark, ["split"]) == 2 and cli.run(spark, ["nonsense"]) == 2


def test_json_arrays_and_manifests(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, None)], "k long, t string").write.json(f"{tmp_path}/j")
    assert sorted(map(tuple, tables.read_json(spark, f"{tmp_path}/j", "k long, t string").collect())) == [(1, "a"), (2, None)]
    np.save(tmp_path / "a.npy", np.arange(6).reshape(3, 2))
    got = sorted((r.row, r["values"]) for r in tables.read_npy(spark, f"{tmp_path}/a.npy").collect())
    assert got == [(0, [0.0, 1.0]), (1, [2.0, 3.0]), (2, [4.0, 5.0])]
    packed = sinks.npy_files(spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],), (None,)], "v array<double>").coalesce(1), "v", rows=1).collect()
    import io

    assert [np.load(io.BytesIO(r.content)).tolist() for r in packed] == [[[1.0, 2.0]], [[3.0, 4.0]]]
    import hashlib

    files = {r.file: r.sha256 for r in tables.manifest(spark, str(tmp_path)).collect()}
    assert files["a.npy"] == hashlib.sha256((tmp_path / "a.npy").read_bytes()).hexdigest()
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    assert tables.cached(spark, f"{tmp_path}/c", make).count() == tables.cached(spark, f"{tmp_path}/c", make).count() == 3 and len(calls) == 1
    with pytest.raises(ValueError):
        tables.load(spark)


def test_draws_beyond_the_old_slots(spark):
    """A value whose share is far below one in 10,007 is drawn, and shares are met; 10,001 references are taken."""
    shares = spark.createDataFrame([(f"v{i:05d}", 1.0) for i in range(30_000)] + [("null share", None), ("none", 0.0)], "v string, s double")
    got = sampling.weighted(spark.range(60_000), "id", shares, "v", "s")
    assert got.select("v").distinct().count() > 20_000 and got.filter("v is null or v = 'none'").count() == 0
    two = sampling.weighted(spark.range(20_000), "id", spark.createDataFrame([("a", 3.0), ("b", 1.0)], "v string, s double"), "v", "s")
    assert abs(two.filter("v = 'a'").count() / 20_000 - 0.75) < 0.02
    assert sampling.weighted(spark.range(3), "id", shares.limit(0), "v", "s").filter("v is not null").count() == 0
    huge = spark.createDataFrame([(2**62,), (-(2**62),)], "k long")
    assert all(0 <= r.d < sampling.MODULUS for r in huge.select(sampling.drawn(F.col("k"), 7).alias("d")).collect())
    refs = spark.createDataFrame([(f"r{i:05d}", "c", f"abc{i}" if i < 10_000 else "zyxwvu") for i in range(10_001)], "i string, c string, s string")
    near = dictionary.nearest_reference(spark.createDataFrame([(1, "zyxwvt"), (2, None)], "k long, t string"), "k", "t", refs, "i", "c", "s").collect()
    assert {(r.key, r.ref) for r in near if r.similarity > 0} == {(1, "r10000")} and len(near) == 2


def test_first_share_counts_ranges(spark):
    df = spark.range(5000).select((F.col("id") * 37 % 5003).alias("k"))
    want = sorted(r.k for r in df.collect())
    assert sampling.kth(df, "k", 1234, buckets=7, few=10) == want[1233]
    assert sorted(r.k for r in sampling.first_share(df, "k", 0.3).collect()) == want[:1500]
    ties = spark.createDataFrame([(1,)] * 10 + [(2,)] * 10 + [(None,)] * 5, "k int")
    assert [sampling.first_share(ties, "k", x).count() for x in (0.0, 0.2, 0.5, 0.9, 1.0)] == [25, 5, 12, 22, 25]
    assert sampling.kth(ties.filter("k = 1"), "k", 3, few=1) == 1
    with pytest.raises(ValueError):
        sampling.first_share(df, "k", 1.5)


def test_patterns_beyond_one_block(spark):
    texts = spark.createDataFrame([(1, "abcabc"), (2, "xbcx"), (3, None), (4, "")], "k long, t string")
    patterns = spark.createDataFrame([("p1", "abc"), ("p2", "bc"), ("p3", "x"), ("p4", ""), (None, "b"), ("p5", None)], "i string, p string")
    want = {(1, "p1"), (1, "p2"), (2, "p2"), (2, "p3")}
    for most in (1, 2, 100):
        assert {tuple(r) for r in dictionary.contained(texts, "k", "t", patterns, "i", "p", most).collect()} == want


def test_growth_reads_each_step_once(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("d", None)], "a string, b string")
    got = {r.item: r.step for r in dictionary.grow(pairs, spark.createDataFrame([("a",), ("q",)], "item string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_clusters_planes_and_odds(spark):
    rows = [(i, t) for i, t in enumerate(["CCOCCOCC", "CCOCCOC", "CCOCCOCCC", "c1ccncc1", "c1ccncc1C", "c1ccncc1N", "CCOCCOCC", None, "x"])]
    df = spark.createDataFrame(rows, "k long, t string")
    got = learning.representatives(df, "k", "t", [2, 100]).collect()
    assert len(got) == 2 and sum(r.size for r in got) == 6
    xy = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(10)], "k long, v array<double>")
    flat = sorted((r.k, abs(r.x), abs(r.y)) for r in learning.plane(xy, "k", "v").collect())
    assert all(abs(x - abs(k - 4.5) * 5**0.5) < 1e-9 and y < 1e-9 for k, x, y in flat)
    curve = spark.createDataFrame([(i / 10, int(i + (i % 3 == 0) * 5 > 50)) for i in range(100)], "s double, y int")
    assert 4.0 < learning.even_odds(curve, "s", "y") < 6.0


def test_generation_covers_and_keeps_groups(spark):
    rows = spark.read.parquet(f"{SF}/controls.parquet")
    cols = ["e3_binder_smiles_with_direction", "linker_smiles_with_direction", "poi_ligand_smiles_with_direction"]
    all_of = generate.cover(rows, *cols).collect()
    for name, c in zip(("e3", "linker", "poi"), cols, strict=True):
        assert {getattr(r, name) for r in all_of} == {r[c] for r in rows.collect()}
    drawn = generate.by_groups(rows, *cols, 200).collect()
    known = {tuple(r[c] for c in cols) for r in rows.collect()}
    assert len(drawn) > 20 and all((r.e3, r.linker, r.poi) not in known and m.reassembles(f"{r.e3}.{r.linker}.{r.poi}", r.whole) for r in drawn)
    assert generate.cover(rows.limit(0), *cols).count() == 0


def test_small_expressions_and_walks(spark):
    df = spark.createDataFrame([(1, float("nan"), "has_parts"), (2, float("inf"), None), (3, 1.5, "a")], "k long, x double, t string")
    assert [r[0] for r in df.select(summaries.finite(F.col("x"))).collect()] == [None, None, 1.5]
    assert [r[0] for r in df.select(summaries.display_name(F.col("t"))).collect()] == ["Has Parts", None, "A"]
    assert df.select(summaries.note(k=F.col("k"), t=F.col("t"))).collect()[1][0] == "(k=2)(t=None)"
    ring = spark.createDataFrame([("g", i, (i + 1) % 7) for i in range(7)], "g string, u long, v long")
    assert {(r.u, r.hop, r.n) for r in graph.khop(ring, "g", 4).collect()} == {(u, h, 2) for u in range(7) for h in (1, 2, 3)}
