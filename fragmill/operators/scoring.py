"""Scoring splits: without a reference, against a label, and repairing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragmill.chem import molecule as m
from fragmill.chem.repair import repair as _repair
from fragmill.operators.molecules import _map
from fragmill.operators.quality import count_flags

#: Bounds of weight and heavy atoms of each ligand, the chain that counts as a piece of linker, the linker
#: atoms that are too few and the branch points that are too many, and the similarity below which a ligand is unknown.
WEIGHT = {"e3": (150, 700), "poi": (120, 900)}
ATOMS = {"e3": (10, 55), "poi": (8, 70)}
CHAIN, TOO_SHORT, TOO_BRANCHED, UNKNOWN = 6, 1, 2, 0.2
#: Fixed value: the edit distance of what cannot be compared.
NO_DISTANCE = 1e64

_FACTS = (
    "pred_valid boolean, has_three_substructures boolean, has_all_attachment_points boolean, reassembly_ok boolean, e3_mw double, e3_heavy_atoms int, e3_disconnected boolean, e3_attachment_chain_length int, "
    "poi_mw double, poi_heavy_atoms int, poi_disconnected boolean, poi_attachment_chain_length int, linker_heavy_atoms_between int, linker_branch_points int, linker_ring_count int, "
    "e3_sim_to_known_e3 double, e3_sim_to_known_wh double, poi_sim_to_known_wh double, poi_sim_to_known_e3 double"
)


def facts(prediction: str | None, whole: str | None, e3s: list[set[int]], warheads: list[set[int]]) -> dict:
    p = prediction or ""
    parts = m.roles(prediction)
    graphs = {k: m.parse(v) for k, v in parts.items()}
    out: dict = {"pred_valid": bool(p) and all(m.parse(x) is not None for x in p.split(".")), "has_three_substructures": p.count(".") == 2, "has_all_attachment_points": p.count("[*:1]") == 2 and p.count("[*:2]") == 2, "reassembly_ok": m.reassembles(prediction, whole)}
    for role in ("e3", "poi"):
        g = graphs[role]
        if g is None:
            continue
        bits = m.bits(g)
        near = lambda refs, bits=bits: round(max((m.tanimoto(bits, r) for r in refs), default=0.0), 9)
        out |= {f"{role}_mw": round(m.weight(g), 3), f"{role}_heavy_atoms": m.real_atoms(g), f"{role}_disconnected": len(m.pieces(g, set())) > 1, f"{role}_attachment_chain_length": m.chain_length(g), f"{role}_sim_to_known_e3": near(e3s), f"{role}_sim_to_known_wh": near(warheads)}
    if graphs["linker"] is not None:
        out["linker_heavy_atoms_between"], out["linker_branch_points"], out["linker_ring_count"] = m.linker_shape(graphs["linker"])
    return out


def split_flags() -> dict[str, Column]:
    """The flags of a scored split, in the order in which they are named."""
    c, flags = F.col, {}
    outside = lambda x, lo_hi: (c(x) < lo_hi[0]) | (c(x) > lo_hi[1])
    for r in ("e3", "poi"):
        flags[f"{r}_out_of_range"] = outside(f"{r}_mw", WEIGHT[r]) | outside(f"{r}_heavy_atoms", ATOMS[r])
        flags[f"{r}_linker_leak"] = c(f"{r}_disconnected") | (c(f"{r}_attachment_chain_length") >= CHAIN)
    flags["linker_too_short"] = c("linker_heavy_atoms_between") <= TOO_SHORT
    flags["linker_branchy"] = c("linker_branch_points") >= TOO_BRANCHED
    flags["e3_low_similarity"] = c("e3_sim_to_known_e3") < UNKNOWN
    flags["poi_low_similarity"] = c("poi_sim_to_known_wh") < UNKNOWN
    e, p = (c("e3_sim_to_known_wh") > c("e3_sim_to_known_e3")) & (c("e3_sim_to_known_wh") >= UNKNOWN), (c("poi_sim_to_known_e3") > c("poi_sim_to_known_wh")) & (c("poi_sim_to_known_e3") >= UNKNOWN)
    flags["role_swap_suspected"] = e & p
    flags["structural"] = ~(c("pred_valid") & c("has_three_substructures") & c("has_all_attachment_points") & c("reassembly_ok"))
    return flags


def flags_of(f: dict) -> list[str]:
    """The names of the flags that ``split_flags`` raises, for the facts of one split."""
    outside = lambda x, lo_hi: x is not None and not lo_hi[0] <= x <= lo_hi[1]
    least = lambda x, n: x is not None and x >= n
    below = lambda x: x is not None and x < UNKNOWN
    crossed = lambda a, b: a is not None and b is not None and a > b and a >= UNKNOWN
    out = {}
    for r in ("e3", "poi"):
        out[f"{r}_out_of_range"] = outside(f.get(f"{r}_mw"), WEIGHT[r]) or outside(f.get(f"{r}_heavy_atoms"), ATOMS[r])
        out[f"{r}_linker_leak"] = bool(f.get(f"{r}_disconnected")) or least(f.get(f"{r}_attachment_chain_length"), CHAIN)
    out["linker_too_short"] = f.get("linker_heavy_atoms_between") is not None and f["linker_heavy_atoms_between"] <= TOO_SHORT
    out["linker_branchy"] = least(f.get("linker_branch_points"), TOO_BRANCHED)
    out["e3_low_similarity"], out["poi_low_similarity"] = below(f.get("e3_sim_to_known_e3")), below(f.get("poi_sim_to_known_wh"))
    out["role_swap_suspected"] = crossed(f.get("e3_sim_to_known_wh"), f.get("e3_sim_to_known_e3")) and crossed(f.get("poi_sim_to_known_e3"), f.get("poi_sim_to_known_wh"))
    out["structural"] = not all(f.get(x) for x in ("pred_valid", "has_three_substructures", "has_all_attachment_points", "reassembly_ok"))
    return [name for name, raised in out.items() if raised]


def score_splits(df: DataFrame, key: str, prediction: str, whole: str, e3_refs: list[str], warhead_refs: list[str]) -> DataFrame:
    """(key, facts, flag_*, n_flags, review_reasons) of each candidate, without a reference split. What a missing part
    leaves unknown is null and raises no flag; the references are short fixed lists."""
    held = df.sparkSession.sparkContext.broadcast(tuple([m.bits(g) for g in map(m.parse, refs) if g] for refs in (e3_refs, warhead_refs)))
    rows = _map(df, key, [prediction, whole], _FACTS, lambda p, w: facts(p, w, *held.value))
    return count_flags(rows, split_flags())


_SCORES = "has_three_substructures boolean, has_all_attachment_points boolean, num_fragments int, tanimoto_similarity double, valid boolean, reassembly boolean, reassembly_nostereo boolean, heavy_atoms_difference int, heavy_atoms_difference_norm double, all_ligands_equal boolean, " + ", ".join(
    f"{r}_valid boolean, {r}_equal boolean, {r}_has_attachment_points boolean, {r}_tanimoto_similarity double, {r}_graph_edit_distance double, {r}_graph_edit_distance_norm double, {r}_heavy_atoms_difference int, {r}_heavy_atoms_difference_norm double"
    for r in ("e3", "poi", "linker")
)


def _scores(whole: str | None, label: str | None, prediction: str | None) -> dict:
    target, p = m.parse(whole), prediction or ""
    atoms = m.real_atoms(target) if target else 0
    given, true = m.roles(prediction), m.roles(label)
    out: dict = {"has_three_substructures": p.count(".") == 2, "has_all_attachment_points": p.count("[*:1]") == 2 and p.count("[*:2]") == 2, "num_fragments": p.count(".") + 1 if prediction is not None else 0, "tanimoto_similarity": 0.0, "valid": False, "reassembly": False, "reassembly_nostereo": False, "heavy_atoms_difference": atoms, "heavy_atoms_difference_norm": 1.0}
    graphs, truths = {k: m.parse(v) for k, v in given.items()}, {k: m.parse(v) for k, v in true.items()}
    if all(given.values()):
        out["valid"] = all(graphs.values())
        out["reassembly"] = m.reassembles(prediction, whole)
        out["reassembly_nostereo"] = m.reassembles(m.without_stereo(p), m.without_stereo(whole)) if whole else False
        joined = m.join(list(graphs.values()), [1, 2]) if out["valid"] else None
        if joined and atoms:
            out["heavy_atoms_difference"] = atoms - m.real_atoms(joined)
            out["heavy_atoms_difference_norm"] = out["heavy_atoms_difference"] / atoms
        if out["valid"] and all(truths.values()):
            merged = [set().union(*[m.bits(g) for g in x.values()]) for x in (graphs, truths)]
            out["tanimoto_similarity"] = m.tanimoto(*merged)
    for r in ("e3", "poi", "linker"):
        g, t = graphs[r], truths[r]
        n = m.real_atoms(t) if t else 0
        own: dict = {"valid": g is not None, "equal": False, "has_attachment_points": given[r] is not None, "tanimoto_similarity": 0.0, "graph_edit_distance": NO_DISTANCE, "graph_edit_distance_norm": 1.0, "heavy_atoms_difference": n, "heavy_atoms_difference_norm": 1.0}
        if g and t:
            d = float(m.edit_distance(g, t))
            own |= {"equal": m.same(g, t), "tanimoto_similarity": m.tanimoto(m.bits(g), m.bits(t)), "graph_edit_distance": d, "graph_edit_distance_norm": d / (len(g.atoms) + len(t.atoms)), "heavy_atoms_difference": n - m.real_atoms(g), "heavy_atoms_difference_norm": (n - m.real_atoms(g)) / n if n else 1.0}
        out |= {f"{r}_{k}": v for k, v in own.items()}
    out["all_ligands_equal"] = all(out[f"{r}_equal"] for r in ("e3", "poi", "linker"))
    return out


def score_predictions(df: DataFrame, key: str, whole: str, label: str, prediction: str) -> DataFrame:
    """(key, 10 measures of the whole, 8 of each part) of a prediction against its label. What cannot be computed has the
    worst value: similarity 0, edit distance 1e64, shares 1."""
    return _map(df, key, [whole, label, prediction], _SCORES, _scores)


def repair(df: DataFrame, key: str, prediction: str, whole: str) -> DataFrame:
    """(key, repaired, how) of each prediction; null where no repair reassembles."""
    return _map(df, key, [prediction, whole], "repaired string, how string", lambda p, w: dict(zip(("repaired", "how"), _repair(p, w), strict=True)))


def attachment_groups(df: DataFrame, key: str, text: str, label: int, hops: int = 1) -> DataFrame:
    """(key, grp): what stands around the attachment point of a labelled part; null where there is none."""
    return _map(df, key, [text], "grp string", lambda t: {"grp": m.neighbourhood(g, label, hops) if (g := m.parse(t)) else None})
