import random

import pytest

from fragmill.chem import molecule as m
from fragmill.chem import patterns as P
from fragmill.chem import sides as S
from fragmill.operators import curation as C
from fragmill.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ("e3_binder_smiles_with_direction", "linker_smiles_with_direction", "poi_ligand_smiles_with_direction")


def controls(spark):
    return [(r.protac_id, r.protac_smiles, *(r[c] for c in COLUMNS)) for r in spark.read.parquet(f"{SF}/controls.parquet").collect()]


def test_sums_of_sides_and_middles_are_those_of_the_pieces(spark):
    rng, seen = random.Random(1), 0
    for _, text, *_ in controls(spark)[:8]:
        mol = m.parse(text)
        every = S.sides(mol)
        assert len(every) == 2 * sum(mol.bonds[b][2] == 1.0 for b in m.bridges(mol))
        for b, s, value, n in every:
            atoms = S.atoms_of(mol, b, s)
            assert len(atoms) == n and S.whole_sum(m.labelled(mol, atoms, {})) == value
        b, s, _, _ = rng.choice(every)
        for c, d, value, n in S.middles(mol, b, s):
            ends = set(S.atoms_of(mol, b, s)) | set(S.atoms_of(mol, c, d))
            rest = [u for u in range(len(mol.atoms)) if u not in ends]
            assert len(rest) == n and S.whole_sum(m.labelled(mol, rest, {})) & S._MASK == value
            seen += 1
    assert seen > 50 and S.sides(m.parse("CCC.CC")) == [] and S.key_of("x") is None


def test_known_parts_are_found(spark):
    rows = controls(spark)
    df = spark.createDataFrame([r[:2] for r in rows] + [("null", None), ("bad", "x"), ("none", "CCCCO")], "protac_id string, protac_smiles string")
    parts = spark.createDataFrame([x for r in rows for x in (("e3", r[2]), ("poi", r[4]))] + [("e3", None), ("poi", "x")], "role string, ligand string")
    got = {r.protac_id: r for r in C.split_known(df, "protac_id", "protac_smiles", parts, False).collect()}
    assert set(got) <= {r[0] for r in rows} and len(got) > 20
    assert all(m.reassembles(f"{g.e3}.{g.linker}.{g.poi}", {r[0]: r[1] for r in rows}[k]) for k, g in got.items())
    links = spark.createDataFrame([x for r in rows for x in (("e3", r[2]), ("linker", r[3]))], "role string, ligand string")
    found = C.split_known(df, "protac_id", "protac_smiles", links).collect()
    assert {r.matched for r in found} == {"e3, linker"} and len(found) > 20
    assert C.split_known(df.limit(0), "protac_id", "protac_smiles", parts).count() == 0
    assert C.split_known(df, "protac_id", "protac_smiles", parts.limit(0)).count() == 0


def test_dictionaries_grow_to_a_fixpoint(spark):
    """e0-l0-p0 is known by its ends; each next molecule shares two parts with what is known by then."""
    rows = controls(spark)
    e3, link, poi = ({m.canonical(m.parse(r[k])): r[k] for r in rows} for k in (2, 3, 4))
    e3, link, poi = (list(x.values())[:3] for x in (e3, link, poi))
    whole = lambda e, l, p: m.spelled(w := m.join([m.parse(x) for x in (e, l, p)], [1, 2]), list(range(len(w.atoms))))
    df = spark.createDataFrame([("a", whole(e3[0], link[0], poi[0])), ("b", whole(e3[0], link[0], poi[1])), ("c", whole(e3[1], link[0], poi[1])), ("d", whole(e3[2], link[2], poi[2]))], "k string, t string")
    seeds = spark.createDataFrame([("e3", e3[0]), ("poi", poi[0])], "role string, ligand string")
    done, known = C.curate(df, "k", "t", seeds)
    got = {r.k: r for r in done.collect()}
    assert set(got) == {"a", "b", "c"} and [got[k].step for k in "abc"] == [0, 1, 2]
    assert known.count() > 4
    with pytest.raises(RuntimeError):
        C.curate(df, "k", "t", seeds, 1)


def test_checks():
    g = m.parse
    assert C.check_sizes(g("CCCCCCCCCC"), {"e3": g("CCC")}) and not C.check_sizes(g("CCCCCCCCCC"), {"e3": g("CCCCCCCC")})
    assert not C.check_linker(g("CCOCCOCC"), [g("CCOCCOCC")]) and C.check_linker(g("CCOCCOCC"), [g("c1ccncc1")])
    assert not C.check_whole(g("CCOCC"), {"poi": g("CCOCC")}) and C.check_whole(g("CCOCCc1ccncc1"), {"poi": g("CCO")})


def test_substructures_against_the_unscreened_search(spark):
    texts = ["CC(=O)NCc1ccccc1", "c1ccccc1CCN", "OCCOCCO", None, "x", "C"]
    parts = [("a", "c1ccccc1"), ("b", "[*:1]CCO"), ("c", "NC=O"), ("d", "CCCCCCCC"), ("e", None)]
    df, dic = spark.createDataFrame(list(enumerate(texts)), "k long, t string"), spark.createDataFrame(parts, "part string, smiles string")
    got = {tuple(r) for r in C.containing(df, "k", "t", dic, "part", "smiles").collect()}
    want = {(k, i) for k, t in enumerate(texts) for i, p in parts if p and m.parse(t) and P.occurs(P.view(m.parse(t)), P.of_molecule(m.parse(p)))}
    assert got == want and {(0, "a"), (2, "b"), (0, "c")} <= got
    with pytest.raises(ValueError, match="more than"):
        C.containing(df, "k", "t", dic, "part", "smiles", most=2)
    new, known = spark.createDataFrame([("CCOCCOCC",), ("c1ccncc1",), ("x",), (None,)], "ligand string"), spark.createDataFrame([("CCOCCOCC",), (None,)], "ligand string")
    assert [r.ligand for r in C.foreign(new, known).collect()] == ["c1ccncc1"]


def test_queries(spark):
    whole = {r.protac_id: r.protac_smiles for n in ("curated", "controls") for r in spark.read.parquet(f"{SF}/{n}.parquet").collect()}
    for name in ("dictionary_split", "dictionary_growth"):
        rows = QUERIES[name](spark, SF).collect()
        assert len(rows) > 50 and len({r.protac_id for r in rows}) == len(rows)
        assert all(m.reassembles(f"{r.e3}.{r.linker}.{r.poi}", whole[r.protac_id]) for r in rows)


def test_ways_beyond_the_first_that_passes_are_not_tried():
    """dictionary_split, dictionary_growth: a molecule is read once and its ways are tried in turn, not all of them."""
    text = "c1ccncc1CCOCCOCCOCCNC(=O)Cc1ccccc1"
    mol = m.parse(text)
    every = [(b, s) for b, s, _, _ in C.sides.sides(mol)]
    ways = [(e, p) for e in every for p in every]
    alone = [C.cut_out(text, *w) for w in ways]
    first = next(i for i, x in enumerate(alone) if x.get("passed"))
    rest = iter(ways)
    assert C.first_cut(mol, rest) == alone[first] and next(rest) == ways[first + 1]
    bad = "CCOCCOCCOCC"  # its parts are too much like each other
    tried = [((b, s), (c, r)) for b, s, _, _ in C.sides.sides(m.parse(bad)) for c, r, _, _ in C.sides.sides(m.parse(bad))]
    got = [x for w in tried if (x := C.cut_out(bad, *w))]
    none = [w for w in tried if not C.cut_out(bad, *w).get("passed")]
    assert any(not x["passed"] for x in got) and C.first_cut(m.parse(bad), none) == [x for x in got if not x["passed"]][-1]
    assert C.first_cut(mol, []) == {}
