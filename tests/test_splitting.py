import itertools
import random

import pytest

from fragmill.chem import describe as D
from fragmill.chem import molecule as m
from fragmill.chem import patterns as P
from fragmill.chem import splitting as C
from fragmill.operators import learning, molecules, qc, scoring
from fragmill.operators import splitting as S
from fragmill.queries import _known_splits, _whole_molecules

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def refs(spark):
    return S.References.of_table(spark.read.parquet(f"{SF}/representatives.parquet"))


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    rows = learning.sample_molecules(_known_splits(spark, SF).dropna(), "protac_id", 60)
    fitted = learning.fit_edges(learning.labelled_edges(rows, "protac_id", "protac_smiles", "label"), trees=10)
    path = str(tmp_path_factory.mktemp("model"))
    learning.save_model(fitted, path)
    return learning.load_model(path)


def test_strategies_names():
    assert S.strategy_of() == "adaptive" and S.strategy_of("xgboost->heuristic") == "classifier->heuristic"
    assert S.strategy_of(use_transformer=True, use_classifier=True) == "transformer->classifier" and S.strategy_of(use_transformer=False) == "heuristic"
    with pytest.raises(ValueError, match="no strategy"):
        S.strategy_of("guess")


def test_every_strategy_keeps_rows_and_reassembles(spark, refs, model):
    whole = [r.protac_smiles for r in spark.read.parquet(f"{SF}/controls.parquet").collect()]
    texts = [*whole[:8], None, "", "not_a_smiles", "C", whole[0], "CCO.CCN"]
    df = spark.createDataFrame([(i, t, "mine", 7) for i, t in enumerate(texts)], "n long, smiles string, model_name string, n_flags int")
    beams = spark.createDataFrame([(whole[0], [None, "C.C.C"]), (whole[1], ["CC"]), ("not_a_smiles", ["x"])], "smiles string, beams array<string>")
    for name in ("heuristic", "grid", "classifier", "classifier->heuristic", "heuristic->classifier", "classifier+heuristic", "transformer", "transformer->classifier", "adaptive"):
        got = sorted(S.split(df, "smiles", name, refs, model, beams).collect(), key=lambda r: r.n)
        assert [r.smiles for r in got] == texts and got[0].default_pred_n0 == got[12].default_pred_n0
        assert all(got[i].default_pred_n0 is None for i in (8, 9, 10, 11, 13))
        for r in got:
            assert r.default_pred_n0 is None or m.reassembles(r.default_pred_n0, r.smiles)
        if name != "transformer":
            assert all(r.default_pred_n0 for r in got[:8])
        if name in ("grid", "adaptive"):
            assert all((r.heuristic_params is not None) == (r.model_name == "Heuristic") for r in got) and all(r.n_flags is not None for r in got)
    assert S.split(df.limit(0), "smiles", "grid", refs).count() == 0
    with pytest.raises(ValueError, match="model"):
        S.split(df, "smiles", "classifier", refs)


def test_what_goes_in_comes_out(spark, refs):
    text = spark.read.parquet(f"{SF}/controls.parquet").first().protac_smiles
    one = S.split_molecules(spark, text, strategy="heuristic", refs=refs)
    many = S.split_molecules(spark, [text, "x", text], strategy="heuristic", refs=refs)
    assert isinstance(one, dict) and m.reassembles(one["default_pred_n0"], text) and [r["smiles"] for r in many] == [text, "x", text]
    assert many[0] == many[2] == one and many[1]["default_pred_n0"] is None


def test_adaptive_never_raises_the_key(spark, refs, model):
    rows = _whole_molecules(spark, SF)
    grid = {r.protac_id: r for r in S.split(rows, "protac_smiles", "grid", refs).collect()}
    both = S.split(rows, "protac_smiles", "adaptive", refs, model).collect()
    assert len(both) == len(grid)
    for r in both:
        assert r.n_flags <= grid[r.protac_id].n_flags or "structural" in (grid[r.protac_id].review_reasons or "")


def test_flags_in_python_are_the_flags_in_sql(spark, refs):
    df = _known_splits(spark, SF)
    table = spark.read.parquet(f"{SF}/representatives.parquet").collect()
    got = scoring.score_splits(df, "protac_id", "label", "protac_smiles", [r.smiles for r in table if not r.is_warhead], [r.smiles for r in table if r.is_warhead])
    reasons = {r.protac_id: r.review_reasons for r in got.collect()}
    for r in df.collect():
        assert (";".join(scoring.flags_of(scoring.facts(r.label, r.protac_smiles, refs.e3s, refs.warheads))) or None) == reasons[r.protac_id]


def test_quality_checks_of_rows(spark, refs, model):
    df = _known_splits(spark, SF).limit(40).unionByName(spark.createDataFrame([("null", None, None), ("bad", "x", "C.C.C")], "protac_id string, protac_smiles string, label string"))
    table = spark.read.parquet(f"{SF}/representatives.parquet").collect()
    e3s, warheads = [r.smiles for r in table if not r.is_warhead], [r.smiles for r in table if r.is_warhead]
    got = {r.protac_id: r for r in qc.check(df, "protac_id", "protac_smiles", "label", e3s, warheads, model).collect()}
    assert len(got) == 42 and got["null"].flag_structural and got["bad"].flag_structural and got["bad"].margin is None
    for r in df.collect():
        g = got[r.protac_id]
        assert g.n_flags == len((g.review_reasons or "").split(";")) * (g.review_reasons is not None)
        assert g.flag_low_confidence == (g.margin is not None and g.margin < qc.UNSURE)
        own = C.split(r.protac_smiles, refs.e3s)
        assert g.heuristic_e3 == own["e3"] and g.flag_method_disagreement == (g.heuristic_min_similarity is not None and g.heuristic_min_similarity < qc.DISAGREE)
    plain = qc.check(df, "protac_id", "protac_smiles", "label", e3s, warheads)
    assert "flag_low_confidence" not in plain.columns and plain.count() == 42


def test_cuts_leave_amides_and_esters_whole():
    for text, partner in (("c1ccccc1CCC(=O)NCCCOCCNC(=O)c1ccccc1", "N"), ("c1ccccc1CCC(=O)OCCCOCCOC(=O)c1ccccc1", "O")):
        mol = m.parse(text)
        bond = {frozenset(b[:2]): i for i, b in enumerate(mol.bonds)}
        carbonyl = next(u for u, v, o in mol.bonds if o == 2.0)
        near = mol.neighbours()
        other = next(v for v, _ in near[carbonyl] if mol.atoms[v][1] == partner and len(near[v]) > 1)
        before = next(b for v, b in near[carbonyl] if mol.atoms[v][1] == "C")
        far = next(i for i, b in reversed(list(enumerate(mol.bonds))) if i in m.bridges(mol) and mol.atoms[b[1]][1] == "c")
        moved = C.off_carbonyls(mol, (before, far))
        assert moved[0] == bond[frozenset((carbonyl, other))]
        assert m.reassembles(S.joined(C.strings(mol, moved)), text)


def brute_matches(mol, p):
    w = P.view(mol)
    bond = {frozenset(b[:2]): i for i, b in enumerate(mol.bonds)}
    return {x for x in itertools.permutations(range(len(mol.atoms)), len(p.atoms)) if all(f(w, u) for f, u in zip(p.atoms, x, strict=True)) and all(frozenset((x[u], x[v])) in bond and f(w, bond[frozenset((x[u], x[v]))]) for u, v, f in p.bonds)}


def test_pattern_search_against_all_assignments():
    for text in ("CC(=O)NCc1ccco1", "C1CC1C(=O)OC", "[N-]=[N+]=NCC#N", "ClCC(Cl)=C"):
        mol = m.parse(text)
        for p in ("C=O", "[NX3]C(=O)", "[CX4][Cl,Br]", "c1ccco1", "C~C", "[!C]-!@[CH2]", "C1CC1", "N=[N+]=[N-]", "[#6]#[#7]"):
            assert set(P.matches(P.view(mol), P.pattern(p))) == brute_matches(mol, P.pattern(p)), (text, p)
    part = m.parse("C(=O)N[*:1]")
    assert P.occurs(P.view(m.parse("CC(=O)NC")), P.of_molecule(part)) and not P.occurs(P.view(m.parse("CC(=O)N")), P.of_molecule(part))
    with pytest.raises(P.TooLong):
        list(P.matches(P.view(m.parse("C" * 60)), P.of_molecule(m.parse("C" * 30 + "N")), 50)) or list(P.matches(P.view(m.parse("C" * 60)), P.of_molecule(m.parse("C" * 30)), 20))
    assert all(P.pattern(p) for p in [*P.ALERTS.values(), *P.LEAVING_GROUPS.values()])


def test_descriptors_of_known_molecules():
    d = D.describe("CC(=O)Nc1ccc(O)cc1")
    assert (d["heavy_atoms"], d["mw"], d["tpsa"], d["num_aromatic_rings"], d["ring_sizes"]) == (11, 151.2, 49.3, 1, "6")
    spiro, cage = D.describe("C1CC2(CC1)CCC2"), D.describe("C1CC2CCC1CC2")
    assert spiro["num_spiro_atoms"] == 1 and spiro["num_saturated_rings"] == 2 and cage["num_bridgehead_atoms"] == 2 and cage["num_rings"] == 2
    assert D.describe("C1" + "C" * 13 + "1")["macrocycle_sizes"] == "14" and D.describe("[Pt]")["rare_elements"] == "Pt"
    assert D.describe(None)["mw"] is None and D.describe("x")["ring_sizes"] == "" and D.describe("[*:1]", True)["mw"] is None
    b = D.backbone("[*:1]CCOCC(CCCCCC)N[*:2]")
    assert (b["backbone_length"], b["effective_length"], b["max_graph_length"]) == (6, 7, 11) and D.backbone("CC")["backbone_length"] is None
    s = D.scan("CC(C)(C)OC(=O)NCCCl")
    assert s["leaving_group_hits"] == ["boc_carbamate", "free_halide_sp3"] and s["unstable"] and not D.scan("c1ccccc1N")["unstable"]


def test_rewritings_and_canonical_strings(spark):
    rng = random.Random(3)
    for text in ("CC(C)Cc1ccc(cc1)C(C)C(=O)O", "C1CC2CCC1CC2", "OCCOCCN1CCN(CC1)c1ncccn1", "C1CC1C1CC1", "[*:1]CC[*:2]"):
        mol = m.parse(text)
        strings = {m.randomised(mol, rng.randrange(10**9)) for _ in range(20)}
        assert len(strings) > 1 and {m.canonical(m.parse(t)) for t in strings} == {m.canonical(mol)}
        assert all(m.same(m.parse(t), mol) for t in strings)
    df = spark.createDataFrame([(i, "CCOC(N)C", "C[*:2].[*:2]CC[*:1].O[*:1]") for i in range(3)] + [(9, "x", None)], "k long, text string, labels string")
    got = molecules.rewritten(df, "k", ["text", "labels"], 4, 100).collect()
    assert len(got) == 16 and all((r.text is None) == (r.k == 9) for r in got)
    assert all(m.same(m.parse(r.text), m.parse("CCOC(N)C")) and r.labels.count(".") == 2 for r in got if r.k != 9)
    once = molecules.rewritten(df, "k", ["text", "labels"], 4, 0).collect()
    assert len(once) == 4 and {r.text for r in once} == {"CCOC(N)C", "x"}


def test_metrics_ask_a_kind_of_atom_once_and_measure_along_bridges(monkeypatch):
    """split_metrics: atoms of a kind share one test, and the diameter takes no table of all distances."""
    from fragmill.chem import describe, patterns

    asked = []
    p = patterns.Pattern([lambda w, u: asked.append(u) or w.mol.atoms[u][1] == "O"], [], [False])
    assert list(patterns.matches(patterns.view(m.parse("C" * 50 + "OCO")), p)) == [(50,), (52,)] and len(asked) < 6
    texts = ["C.CCCC.C1CC1", "C1CC2CCC1CC2CC3CC3", "C", "CC", "C1CCCCCCCC1CCC", "c1ccccc1-c1ccccc1", "C1CC1C(C2CC2)CCC3CCCC3CC"]
    want = [max(map(max, m.distances(m.parse(t)))) for t in texts]
    monkeypatch.setattr(m, "distances", None)
    assert [describe._diameter(m.parse(t)) for t in texts] == want


ODD = ["C", "CC", "C1CC1", "C1.C1", "CC.CC", "C12CC12", "C(C)1CC1", "C[*:1]", "c1ccccc1:C", "=CC", "[13CH3]OCC=CCO", "C1CC2CCC1CC2CCOCC", "C" * 150, "CC(CC(C(C)N)O)(CCl)CC(=O)NCC(=O)OC(C)O", "x", "", None]


def test_molecules_read_once_are_cut_as_before(spark, refs, model, monkeypatch):
    """F7, F9 split_longest, split_classifier: same cuts and the same bonds by the forest, without a search for each piece."""
    from fragmill.chem import quick

    texts = [r.protac_smiles for r in _whole_molecules(spark, SF).collect()] + ODD
    forest = learning.Forest(model)

    def classified(t):
        edges = C.edge_features(t)
        likely = sorted((-p, e["bond"]) for e, p in zip(edges, forest(edges).tolist(), strict=True)) if len(edges) > 1 else []
        return S.joined(C.split_at(m.parse(t), (likely[0][1], likely[1][1]), refs.e3s)) if likely else None

    for threshold in (0.4, 0.3):
        want = [(classified(t), S.joined(C.split(t, refs.e3s, threshold))) for t in texts]
        by = S.Methods(refs, forest, threshold)
        read = by.read(texts)
        assert list(zip(by.classifier(read), [by.heuristic(*x) for x in read], strict=True)) == want
    for t, w, score in read:
        if w:
            mol = m.parse(t)
            assert (w.mol.atoms, w.bonds, [w.up[v] for v in w.low], score) == (mol.atoms, mol.bonds, m.bridges(mol), m.betweenness(mol))
    rng = random.Random(4)
    for _, w, _ in read:
        if w and len(w.low) > 1:
            a, b = rng.sample(w.low, 2)
            assert by.cutter(w, (a, b))[0] == C.split_at(w.mol, (w.up[a], w.up[b]), refs.e3s)
    plain = [t for t, w, _ in read if w]
    assert len(plain) > 150
    monkeypatch.setattr(m, "parse", None)
    monkeypatch.setattr(m, "pieces", None)
    again = by.read(plain)
    assert all(by.classifier(again)[:1]) and by.heuristic(*again[0])


def test_adaptive_scores_molecules_read_once_as_before(refs, monkeypatch, spark):
    """F6 split_adaptive: the grid and given predictions are scored as before, without reading the whole molecule again."""
    known = _known_splits(spark, SF).collect()
    texts = [r.protac_smiles for r in known] + ODD
    want = [S.grid_search(t, refs) for t in texts]
    by = S.Methods(refs)
    read = by.read(texts)
    drop = lambda r: {k: v for k, v in r.items() if k != "swap"}
    assert [drop(by.grid(*x, S.GRID)) for x in read] == [drop(x) for x in want]
    beams = [(b, r.protac_smiles) for r in known for b in (r.label, want[0]["prediction"], swapped(r.label or ""), (r.label or "")[:-3], None)] + [("C[*:2].[*:2]C[*:1].[*:1]C", "CCC"), ("C[*:2].[*:2]C[*:1].[*:1]C", "CCN"), ("C[*:2].[*:2]C[*:1].C[*:1]", "CCC"), ("C[*:2].[*:2]C=[*:1].[*:1]C", "CC=C"), ("x", "CCC"), ("C[*:2].[*:2]C[*:1].[*:1]C", None)]
    assert [by.beam(*x) for x in beams] == [S._score(p, t, refs, "Transformer") for p, t in beams]
    asked = []
    parse = m.parse
    monkeypatch.setattr(m, "parse", lambda t: asked.append(t) or parse(t))
    monkeypatch.setattr(S, "best_orientation", lambda p, *x: {"prediction": p, "key": (True, 99, 0, 0.0), "structural": True, "n_flags": 99})
    plain = [x for x in read if x[1]]
    assert len(plain) > 150
    for x in plain:
        by.grid(*x, S.GRID)
    assert not set(asked) & {x[0] for x in plain}


def swapped(t):
    return t.replace("[*:1]", "[*:x]").replace("[*:2]", "[*:1]").replace("[*:x]", "[*:2]")


def test_what_is_kept_of_pieces_is_bounded(refs, spark, monkeypatch):
    """F9 split_classifier: a worker keeps few pieces whatever it reads, with the same results."""
    from fragmill.chem import quick

    texts = [r.protac_smiles for r in _known_splits(spark, SF).limit(40).collect()]
    by = S.Methods(refs)
    want = [(by.heuristic(*x), by.grid(*x, S.GRID)["reasons"]) for x in by.read(texts)]
    monkeypatch.setattr(quick, "KEPT", 4)
    by = S.Methods(refs)
    for x, w in zip(by.read(texts), want, strict=True):
        assert (by.heuristic(*x), by.grid(*x, S.GRID)["reasons"]) == w
        assert max(map(len, (by.cutter.likeness, by.cutter.written, by.parts))) <= 5


def test_memory_does_not_follow_the_length_of_molecules(refs, model, monkeypatch):
    """F9 split_classifier: long molecules are taken a bounded text at a time, the largest without sets of atoms as bits, and
    pairs of cuts and bonds a bounded number at once; same results."""
    import tracemalloc

    import pyarrow as pa

    from fragmill.chem import quick

    texts = ["C" * 3000] * 100 + [None, "C" * 500_000, "", "CCO"] + ["C" * 10] * 600
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    parts = [s.column(1).to_pylist() for s in molecules.slices(batch, 256)]
    assert sum(parts, []) == texts
    assert max(map(len, parts)) <= 256 and all(len(x) == 1 or sum(len(t or "") for t in x) <= 1 << 17 for x in parts)
    assert len(parts) < 10 and not list(molecules.slices(batch.slice(0, 0), 256))

    long = "CC(=O)Nc1ccccc1" * 2 + "CC=CN" * 700 + "OC(=O)c1ccccc1"
    tracemalloc.start()
    w = quick.read(long)
    by_text, low = quick.best_cut(w, [v for v in w.low if w.bonds[w.up[v]][2] == 1.0]), [w.up[v] for v in w.low if w.bonds[w.up[v]][2] == 1.0]
    assert tuple(w.up[v] for v in by_text) == C.best_cut(m.parse(long), low)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    for n in (2, 3, 5, 700):
        assert [(i, j) for a in C.pair_blocks(n, 1000) for i, j in zip(*(x.tolist() for x in a), strict=True)] == list(itertools.combinations(range(n), 2))

    some = [long[:k] for k in (90, 190, 95)] + ["CCNC(=O)CCc1ccccc1"]
    forest = learning.Forest(model)
    by = S.Methods(refs, forest)
    want = [(x, by.heuristic(*r)) for x, r in zip(by.classifier(by.read(some)), by.read(some), strict=True)]
    monkeypatch.setattr(quick, "LONGEST", 60)
    monkeypatch.setattr(quick, "JUDGED", 7)
    by = S.Methods(refs, forest)
    read = by.read(some)
    assert [w is None for _, w, _ in read] == [True, True, True, False]
    assert [(x, by.heuristic(*r)) for x, r in zip(by.classifier(read), read, strict=True)] == want
