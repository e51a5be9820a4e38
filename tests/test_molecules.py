import random

from fragmill.chem import molecule as m
from fragmill.chem import splitting
from fragmill import queries as Q
from fragmill.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_reading_and_refusing():
    assert [len(m.parse(x).atoms) for x in ("C", "CCO", "c1ccccc1", "C[C@@H](N)C", "C%12CC%12", "[*:1]CC.[Na+]")] == [1, 3, 6, 4, 3, 4]
    assert all(m.parse(x) is None for x in (None, "", "C(", "C)", "C1CC", "C=", "Xx", "(C)", "C11", "not_a_smiles"))


def brute_bridges(mol):
    base = len(m.pieces(mol, set()))
    return [b for b in range(len(mol.bonds)) if len(m.pieces(mol, {b})) > base]


def brute_betweenness(mol):
    """By enumerating all shortest paths from breadth-first layers."""
    n, near = len(mol.atoms), mol.neighbours()
    score = [0.0] * n
    for s in range(n):
        far, order = {s: 0}, [s]
        for u in order:
            for v, _ in near[u]:
                if v not in far:
                    far[v] = far[u] + 1
                    order.append(v)
        for t in far:
            if t == s:
                continue
            paths, todo = [], [[t]]
            while todo:
                p = todo.pop()
                if p[-1] == s:
                    paths.append(p)
                    continue
                todo += [p + [v] for v, _ in near[p[-1]] if far.get(v, -1) == far[p[-1]] - 1]
            for p in paths:
                for x in p:
                    score[x] += 1 / len(paths)
    return [x / (n * (n - 1)) for x in score]


def test_graph_algorithms_against_brute_force():
    for text in ("CC(C)Cc1ccc(cc1)C(C)C(=O)O", "C1CC2CCC1CC2CC3CC3", "OCCOCCN1CCN(CC1)c1ncccn1"):
        mol = m.parse(text)
        assert m.bridges(mol) == brute_bridges(mol)
        assert all(abs(a - b) < 1e-12 for a, b in zip(m.betweenness(mol), brute_betweenness(mol), strict=True))


def test_best_cut_against_all_pairs():
    mol = m.parse("CC(C)Cc1ccc(cc1)C(C)C(=O)OCCCN(C)CCOCc1ccncc1")
    bonds = [b for b in m.bridges(mol) if mol.bonds[b][2] == 1.0]
    best = None
    for i, a in enumerate(bonds):
        for b in bonds[i + 1 :]:
            parts = m.pieces(mol, {a, b})
            sizes = sorted(len(p) + sum(mol.bonds[x][k] in p for x in (a, b) for k in (0, 1)) for p in parts)
            mean = sum(sizes) / 3
            key = (round(sum((s - mean) ** 2 for s in sizes) / 3, 9), a, b)
            best = min(best or key, key)
    assert splitting.best_cut(mol, bonds) == best[1:]


def test_write_and_read_again():
    rng = random.Random(1)
    for text in ("CC(C)Cc1ccc(cc1)C(C)C(=O)O", "C1CC2CCC1CC2", "c1ccc(-c2ccccc2)cc1", "N#CC(=O)[O-]"):
        mol = m.parse(text)
        order = list(range(len(mol.atoms)))
        for _ in range(5):
            rng.shuffle(order)
            assert m.same(m.parse(m.write(mol, order)), mol)
    assert not m.same(m.parse("CCO"), m.parse("CCN")) and not m.same(m.parse("CCO"), m.parse("COC"))


def test_splits_reassemble(spark):
    whole = {r.protac_id: r.protac_smiles for r in spark.read.parquet(f"{SF}/controls.parquet").collect()}
    every = QUERIES["heuristic_split"](spark, SF).collect()
    rows = [r for r in every if r.protac_id in whole]
    assert len(every) == Q._whole_molecules(spark, SF).count() > 1000
    assert len(rows) == len(whole) and all(m.reassembles(f"{r.e3}.{r.linker}.{r.poi}", whole[r.protac_id]) for r in rows)
    for r in rows:
        assert "[*:2]" in r.e3 and "[*:1]" in r.poi and "[*:1]" in r.linker and "[*:2]" in r.linker


def test_labels_of_the_tables_reassemble(spark):
    rows = spark.read.parquet(f"{SF}/controls.parquet").collect()
    assert all(m.reassembles(f"{r.e3_binder_smiles_with_direction}.{r.linker_smiles_with_direction}.{r.poi_ligand_smiles_with_direction}", r.protac_smiles) for r in rows)
    assert not m.reassembles(None, "CC") and not m.reassembles("C.C.C", "CC") and not m.reassembles("a.b.c", None)
    got = QUERIES["reassembly"](spark, SF).collect()
    assert len(got) == 1000 and sum(r.reassembles for r in got) > 500


def test_edge_rows_descriptors_and_distance(spark):
    assert QUERIES["edge_features"](spark, SF).count() > 24 * 20
    rows = QUERIES["molecule_descriptors"](spark, SF).collect()
    assert len(rows) == 2000 and all(r.rings >= 0 for r in rows if r.rings is not None)
    assert m.edit_distance(m.parse("CCO"), m.parse("CCO")) == 0 and m.edit_distance(m.parse("CCO"), m.parse("CCN")) == 1
    assert abs(m.weight(m.parse("CCO")) - 46.07) < 0.01 and m.chain_length(m.parse("[*:2]CCCc1ccccc1")) == 3


def test_large_results_leave_in_small_batches(spark):
    """Bonds of thousands of molecules must not be in memory at once (executor memory at 1 GB)."""
    from fragmill.operators import molecules

    df = spark.createDataFrame([(i, "CCOCCN" + "C" * (i % 50)) for i in range(300)] + [(300, None), (301, "x")], "k long, t string").coalesce(1)
    one = "bonds array<int>"
    made = molecules._map(df, "k", ["t"], one, lambda t: {"bonds": [len(t or "")]}, rows=64)
    assert sorted(r.k for r in made.collect()) == list(range(302))
    assert {r.k for r in molecules.edge_features(df, "k", "t").collect()} == set(range(300))
