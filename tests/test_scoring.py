import pytest
from pyspark.sql import functions as F

from fragmill.chem import molecule as m
from fragmill.chem.repair import repair
from fragmill.operators import dictionary, generate, learning, scoring
from fragmill.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def known(spark):
    rows = spark.read.parquet(f"{SF}/controls.parquet").orderBy("protac_id").limit(6).collect()
    return [(r.protac_smiles, r.e3_binder_smiles_with_direction, r.linker_smiles_with_direction, r.poi_ligand_smiles_with_direction) for r in rows]


def swapped(t):
    return t.replace("[*:1]", "[*:x]").replace("[*:2]", "[*:1]").replace("[*:x]", "[*:2]")


def test_damaged_labels_are_repaired(known):
    for whole, e3, linker, poi in known:
        label = f"{e3}.{linker}.{poi}"
        assert repair(label, whole) == (label, "as given")
        cases = {
            "linker turned": f"{e3}.{swapped(linker)}.{poi}",
            "linker cut anew": f"{e3}.[*:2]C[*:1].{poi}",
            "poi cut anew": f"{e3}.{linker}.[*:1]C",
            "e3 cut anew": f"C[*:2].{linker}.{poi}",
        }
        for how, bad in cases.items():
            got, said = repair(bad, whole)
            assert got and m.reassembles(got, whole), how
            if said != how:  # a symmetric part may be repaired in another way
                assert said in cases
        # Exchanging all labels names other roles but joins the same way, so there is nothing to repair.
        assert repair(swapped(label), whole)[1] == "as given"
    assert repair("not_a_smiles", known[0][0]) == (None, "failed")
    assert repair(None, "CC") == (None, "failed") and repair("C.C.C", None) == (None, "failed")


def test_scores_of_the_label_and_of_damaged_ones(spark, known):
    rows = []
    for i, (whole, e3, linker, poi) in enumerate(known):
        label = f"{e3}.{linker}.{poi}"
        rows += [(10 * i, whole, label, label), (10 * i + 1, whole, label, f"{e3}.{linker}.[*:1]C"), (10 * i + 2, whole, label, "not_a_smiles"), (10 * i + 3, whole, label, None)]
    df = spark.createDataFrame(rows, "k long, whole string, label string, pred string")
    got = {r.k: r for r in scoring.score_predictions(df, "k", "whole", "label", "pred").collect()}
    for i in range(len(known)):
        best, hurt, bad, none = (got[10 * i + j] for j in range(4))
        assert best.valid and best.reassembly and best.reassembly_nostereo and best.all_ligands_equal and best.tanimoto_similarity == 1.0
        assert best.heavy_atoms_difference == 0 and best.linker_graph_edit_distance == 0
        assert hurt.valid and not hurt.reassembly and hurt.e3_equal and not hurt.poi_equal and hurt.heavy_atoms_difference > 0
        assert not bad.valid and bad.num_fragments == 1 and bad.e3_graph_edit_distance == 1e64 and bad.heavy_atoms_difference_norm == 1.0
        assert none.num_fragments == 0 and not none.has_three_substructures


def test_flags_name_their_reasons(spark, known):
    whole, e3, linker, poi = known[0]
    rows = [(1, f"{e3}.{linker}.{poi}", whole), (2, f"C[*:2].{linker}.{poi}", whole), (3, None, whole), (4, f"{e3}.[*:2]C[*:1].{poi}", whole)]
    df = spark.createDataFrame(rows, "k long, p string, w string")
    got = {r.k: r for r in scoring.score_splits(df, "k", "p", "w", [e3], [poi]).collect()}
    assert not got[1].flag_structural and got[1].e3_sim_to_known_e3 == 1.0
    assert got[2].flag_structural and got[2].flag_e3_out_of_range and "e3_out_of_range" in got[2].review_reasons
    assert got[3].n_flags == 1 and got[3].review_reasons == "structural"
    assert got[4].flag_linker_too_short


def test_generated_molecules_are_new_and_reassemble(spark):
    rows = QUERIES["generated_molecules"](spark, SF).collect()
    assert 1000 < len(rows) <= 2000 and len({(r.e3, r.linker, r.poi) for r in rows}) == len(rows)
    assert all(m.reassembles(f"{r.e3}.{r.linker}.{r.poi}", r.whole) for r in rows[:30])
    n = generate.numbered(spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "x string"), "x", "x").collect()
    assert sorted(r.x_no for r in n) == [0, 1] and {r.x for r in n} == {"a", "b"}


def test_classifier_finds_cuts(spark):
    rows = QUERIES["edge_classifier"](spark, SF).collect()
    other = [r.side > 0 for r in rows if r.held_out]
    found = sum(other) / len(other)
    assert len(other) > 1000 and found > 0.4, found  # held-out molecules of about 60 bonds each; chance would give 0.03
    sweep = QUERIES["cluster_sweep"](spark, SF).collect()
    assert [r.k for r in sweep] == [5, 10, 20]
    tiny = spark.createDataFrame([([1.0, 2.0],), ([2.0, 1.0],)], "v array<double>")
    assert learning.cluster_sweep(tiny, "v", [2, 5]).count() == 0


def test_attachment_groups(spark):
    df = spark.createDataFrame([(1, "[*:2]NC(=O)C"), (2, "CC"), (3, None)], "k long, t string")
    got = {r.k: r.grp for r in scoring.attachment_groups(df, "k", "t", 2, 1).collect()}
    assert got == {1: "N(1C)", 2: None, 3: None}
    assert scoring.attachment_groups(df.limit(0).withColumn("t", F.col("t")), "k", "t", 2).count() == 0


def test_every_row_is_scored(spark):
    """Repeated and null predictions, and curated molecules beside controls."""
    small = SF.replace("0.01", "0.001")
    read = lambda n: spark.read.parquet(f"{small}/{n}.parquet")
    want = sorted(r.pred_id for r in read("predictions").collect())
    for name in ("score_predictions", "fix_predictions"):
        assert sorted(r.pred_id for r in QUERIES[name](spark, small).select("pred_id").collect()) == want, name
    molecules = {r.protac_id for n in ("curated", "controls") for r in read(n).collect() if r.protac_smiles and r.protac_id}
    assert len(molecules) > 24
    assert sorted(r.protac_id for r in QUERIES["heuristic_split"](spark, small).collect()) == sorted(molecules)
    assert len({r.protac_id for r in QUERIES["edge_features"](spark, small).collect()}) > 0.9 * len(molecules)
    assert QUERIES["score_splits"](spark, small).count() == read("curated").count() + read("controls").count()
    assert {r.protac_id for r in QUERIES["edge_classifier"](spark, small).select("protac_id").collect()} > {r.protac_id for r in read("controls").collect()}


def test_no_token_is_lost(spark):
    rows = QUERIES["tokenise"](spark, SF).collect()
    assert max(r.n for r in rows) > 32 and len({len(r.tokens) for r in rows}) == 1
    assert all(sum(t != "<pad>" for t in r.tokens) == r.n for r in rows)


def test_growth_is_not_cut_silently(spark):
    pairs = spark.createDataFrame([(f"i{k}", f"i{k + 1}") for k in range(4)], "a string, b string")
    seeds = spark.createDataFrame([("i0",)], "item string")
    assert dictionary.grow(pairs, seeds, 4).count() == 5
    with pytest.raises(RuntimeError):
        dictionary.grow(pairs, seeds, 3)


def test_bonds_are_judged_as_by_the_fitted_model(spark, known):
    """What is judged where a molecule is read has the fitted model's probabilities, and no bond is sent through Spark."""
    from fragmill.operators import molecules

    df = spark.createDataFrame([(i, w, f"{e}.{k}.{p}") for i, (w, e, k, p) in enumerate(known)] + [(90, None, None), (91, "x", None), (92, "C", None), (93, "CC", None)], "k long, t string, label string")
    edges = learning.labelled_edges(df, "k", "t", "label").cache()
    model = learning.fit_edges(edges.filter("k < 4"), 10, 4)
    want = {(r.k, r.rank): (r.bond, r.proba) for r in learning.top_bonds(model, edges, "k", 3).collect()}
    got = {r.k: [(x.bond, x.proba) for x in r.top] for r in learning.judged(model, df, "k", "t", 3).collect()}
    assert {(k, i + 1): x for k, top in got.items() for i, x in enumerate(top)} == want and got[90] == got[91] == got[92] == []
    plan = learning.judged(model, df, "k", "t")._jdf.queryExecution().toString()
    assert "Window" not in plan and "fp" not in plan


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A folder with 3,000 labelled molecules, some bonds of each alike."""
    folder = tmp_path_factory.mktemp("many")
    e3s, pois = [f"c1cc({'C' * i}N)ccc1{'O' * k}" for i in range(1, 11) for k in range(5)], [f"C1CC({'C' * i}F)CN1{'S' * k}" for i in range(1, 11) for k in range(6)]
    rows = [(i, f"{e}OCCO{p}", f"{e}[*:2]", "[*:2]OCCO[*:1]", f"[*:1]{p}", f"id{i}") for i, (e, p) in enumerate((e, p) for e in e3s for p in pois)]
    names = "row_id long, protac_smiles string, e3_binder_smiles_with_direction string, linker_smiles_with_direction string, poi_ligand_smiles_with_direction string, protac_id string"
    made = spark.createDataFrame(rows, names)
    made.write.parquet(str(folder / "curated.parquet"))
    made.limit(0).write.parquet(str(folder / "controls.parquet"))
    for name in ("representatives", "predictions"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(20).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


@pytest.fixture
def fitted_on(monkeypatch):
    """How many bonds of each side forests were fitted on."""
    asked, fit = [], learning.fit_edges
    monkeypatch.setattr(learning, "fit_edges", lambda edges, *a, **kw: asked.append({r.side: r["count"] for r in edges.groupBy("side").count().collect()}) or fit(edges, *a, **kw))
    return asked


def test_classifier_counts_every_labelled_molecule(spark, many, fitted_on):
    """F1 edge_classifier: the forest is fitted on all labelled molecules of its half, not on the first 1000."""
    out = QUERIES["edge_classifier"](spark, many).collect()
    own = len({r.protac_id for r in out if not r.held_out})
    assert len(out) == 6000 and 1300 < own < 1700
    assert [(x[1], x[2]) for x in fitted_on] == [(own, own)]


def test_adaptive_model_counts_every_labelled_molecule(spark, many, fitted_on):
    """F2 split_adaptive: the forest is fitted on all labelled molecules, as none are held out."""
    out = QUERIES["split_adaptive"](spark, many).collect()
    assert len(out) == 3000 and all(r.default_pred_n0 for r in out)
    assert [(x[1], x[2]) for x in fitted_on] == [(3000, 3000)]


def test_bonds_alike_weigh_as_many(spark, known):
    """F1 edge_classifier: bonds in few bytes are those of ``labelled_edges``; all of them count, and borders come from all."""
    texts = [(w, f"{e}.{k}.{p}") for w, e, k, p in known[:12]] + [("CCO.CC", "C[*:2].[*:2]C[*:1].[*:1]CN"), ("CC(=O)N[*:1]", "C[*:2].[*:2]C[*:1].[*:1]CN"), (None, None), ("x", "x")]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "k long, t string, label string")
    edges = learning.labelled_edges(df, "k", "t", "label")
    bonds = learning.labelled_bonds(learning.with_cuts(df, "k", "t", "label"), "t").cache()
    names = [*learning.NUMBERS, "atom_u", "atom_v"]
    want = sorted((*(r[c] for c in names), sum(1 << i for i, x in enumerate(r.fp) if x), r.side) for r in edges.collect())
    assert sorted((*(r[c] for c in names), r.bits % (1 << 64), r.side) for r in bonds.collect()) == want and len(want) > 300
    assert sum(r[-1] > 0 for r in want) > 10

    one, two, three = (learning.fit_edges(x, 5, 4) for x in (bonds, edges, bonds.union(bonds)))
    judge = lambda model: [[(b.bond, round(b.proba, 9)) for b in r.top] for r in learning.judged(model, df, "k", "t", 5).orderBy("k").collect()]
    assert judge(one) == judge(two) == judge(three)
    assert learning._borders([(1.0, 5), (2.0, 1)], 32)[1:-1] == [1.5] and learning._borders([(3.0, 1)], 32)[1:-1] == [3.0]
    assert learning._borders([(float(i), 1) for i in range(1000)], 4)[1:-1] == [249.5, 499.5, 749.5]
    with pytest.raises(ValueError, match="no bonds"):
        learning.fit_edges(bonds.limit(0))
