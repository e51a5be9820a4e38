"""Cutting a whole molecule into E3 ligand, linker and target ligand by betweenness."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np

from fragmill.chem import molecule as m


def central_atoms(mol: m.Molecule, threshold: float, score: list[float]) -> set[int]:
    """Atoms of the middle: those outside rings of a score above the threshold or beside one, closed over the paths
    between them."""
    free = set(m.bridges(mol))
    near = mol.neighbours()
    ringed = {x for i, (u, v, _) in enumerate(mol.bonds) if i not in free for x in (u, v)}
    held: set[int] = set()
    for u in sorted(range(len(score)), key=lambda i: -score[i]):
        if u not in ringed and (score[u] > threshold or any(v in held for v, _ in near[u])):
            held.add(u)
    for u in range(len(score)):
        if near[u] and all(v in held for v, _ in near[u]):
            held.add(u)
    # All atoms between two held ones: leaves that are not held are pruned until none is left, ring by ring.
    keep, degree = set(range(len(score))), [len(x) for x in near]
    leaves = [u for u in keep if degree[u] <= 1 and u not in held]
    while leaves:
        u = leaves.pop()
        keep.discard(u)
        for v, _ in near[u]:
            if v in keep:
                degree[v] -= 1
                if degree[v] <= 1 and v not in held:
                    leaves.append(v)
    return keep if held else held


def candidate_bonds(mol: m.Molecule, threshold: float, score: list[float]) -> list[int]:
    """Bonds worth cutting: outside rings and at the border of the middle, each atom's first; all single ones if fewer than two."""
    middle, free, near = central_atoms(mol, threshold, score), set(m.bridges(mol)), mol.neighbours()
    border = {next((b for v, b in near[u] if v not in middle), None) for u in middle} - {None}
    inner = {b for b in free if mol.bonds[b][2] == 1.0 and mol.bonds[b][0] in middle and mol.bonds[b][1] in middle}
    got = sorted((border & free) | inner)
    return got if len(got) >= 2 else sorted(b for b in free if mol.bonds[b][2] == 1.0)


def pair_blocks(n: int, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs i < j of n numbers in their order, about ``most`` at a time."""
    step = max(1, most // max(1, n))
    for lo in range(0, n - 1, step):
        first = np.arange(lo, min(lo + step, n - 1))
        many = n - 1 - first
        i = np.repeat(first, many)
        yield i, np.arange(i.size) - np.repeat(np.cumsum(many) - many, many) + i + 1


def best_cut(mol: m.Molecule, bonds: list[int]) -> tuple[int, int] | None:
    """The pair of bonds that leaves three parts of the most even sizes, attachment points counted; the smaller bonds on
    ties. Sizes come from one walk of the tree of bridges, so a pair costs no search. None for several molecules."""
    t, n = m.tree(mol), len(mol.atoms)
    if min(t.place) < 0:
        return None
    bonds = [b for b in bonds if b in t.low]
    low, high = (np.array([x[b] for b in bonds], np.int64) for x in (t.low, t.high))
    best = None
    for i, j in pair_blocks(len(bonds)):
        a, b = high[i] - low[i], high[j] - low[j]
        b_in_a = (low[i] <= low[j]) & (high[j] <= high[i])
        a_in_b = (low[j] <= low[i]) & (high[i] <= high[j])
        nested = a_in_b | b_in_a
        inner, outer = np.minimum(a, b), np.maximum(a, b)
        ends = np.where(nested, inner, a), np.where(nested, n - outer, b)
        sizes = np.stack([ends[0] + 1, n - ends[0] - ends[1] + 2, ends[1] + 1]).astype(float)
        uneven = np.round(sizes.var(axis=0), 9)
        k = int(uneven.argmin())
        if best is None or uneven[k] < best[0]:
            best = uneven[k], int(bonds[i[k]]), int(bonds[j[k]])
    return best[1:] if best else None


#: A cut: the bonds that part off the E3 ligand and the target ligand.
Cut = tuple[int, int]


def _parted(mol: m.Molecule, cut: Cut) -> dict[str, list[int]] | None:
    """The atoms of each role after a cut, None if the cut does not leave a middle between two ends."""
    parts = m.pieces(mol, set(cut))
    out: dict[str, list[int]] = {}
    for p in parts:
        held = set(p)
        touch = [b for b in cut if mol.bonds[b][0] in held or mol.bonds[b][1] in held]
        out["linker" if len(touch) == 2 else "e3" if touch == [cut[0]] else "poi"] = p
    return out if len(parts) == 3 and len(out) == 3 else None


def _moved(mol: m.Molecule, ours: set[int], cut: int, partner: str, hydrogens: list[int], near: list, free: set[int]) -> int:
    """The bond between a carbonyl and its N or O (``partner``) if the cut's atom on our side is one of both and the other
    is ours too; else the cut itself."""
    at = mol.bonds[cut][0] if mol.bonds[cut][0] in ours else mol.bonds[cut][1]
    element = lambda u: mol.atoms[u][1]

    def carbonyl(u: int) -> bool:
        double = [v for v, b in near[u] if mol.bonds[b][2] == 2.0 and element(v) == "O" and len(near[v]) == 1]
        return element(u) == "C" and len(near[u]) + hydrogens[u] == 3 and bool(double)

    def hetero(u: int) -> bool:
        return element(u) == partner and len(near[u]) + hydrogens[u] == (3 if partner == "N" else 2)

    for v, b in sorted(near[at]):
        if v in ours and b in free and mol.bonds[b][2] == 1.0 and (hetero(at) and carbonyl(v) or carbonyl(at) and hetero(v)):
            return b
    return cut


def off_carbonyls(mol: m.Molecule, cut: Cut) -> Cut:
    """A cut next to an amide, then one next to an ester, moved onto the bond between carbonyl and N or O, so that it is
    not torn: the target ligand first, then the E3 ligand, then the linker on either side. All moves of a kind are made
    or none, if they leave no middle between two ends."""
    hydrogens, near, free = m.hydrogens(mol), mol.neighbours(), set(m.bridges(mol))
    for partner in ("N", "O"):
        new = list(cut)
        for role, at in (("poi", 1), ("e3", 0), ("linker", 0), ("linker", 1)):
            parts = _parted(mol, (new[0], new[1]))
            if parts is None:
                break
            new[at] = _moved(mol, set(parts[role]), new[at], partner, hydrogens, near, free)
        if new[0] != new[1] and _parted(mol, (new[0], new[1])):
            cut = (new[0], new[1])
    return cut


def strings(mol: m.Molecule, cut: Cut) -> dict[str, str] | None:
    """{e3, linker, poi} of a cut."""
    parts, label = _parted(mol, cut), {cut[0]: "[*:2]", cut[1]: "[*:1]"}
    if parts is None:
        return None
    return {role: m.write(mol, p, {u: [label[b] for b in cut if u in mol.bonds[b][:2]] for u in p}, set(cut)) for role, p in parts.items()}


def oriented(mol: m.Molecule, cut: Cut, e3_refs: list[set[int]]) -> Cut:
    """The cut with the end that is more similar to any known E3 ligand as the E3 ligand (the first on ties)."""
    parts = _parted(mol, cut)
    if parts is None or not e3_refs:
        return cut

    def known(part: list[int], bond: int) -> float:
        own = m.bits(m.labelled(mol, part, {bond: 9}))
        return max(m.tanimoto(own, r) for r in e3_refs)

    return cut if known(parts["e3"], cut[0]) >= known(parts["poi"], cut[1]) else (cut[1], cut[0])


def split_at(mol: m.Molecule, bonds: tuple[int, int], e3_refs: list[set[int]]) -> dict[str, str] | None:
    """{e3, linker, poi} for two bonds to cut: roles by known E3 ligands, cuts moved off amides and esters."""
    cut = oriented(mol, bonds, e3_refs)
    return strings(mol, off_carbonyls(mol, cut)) if _parted(mol, cut) else None


def split(text: str | None, e3_refs: list[set[int]], threshold: float = 0.4, use_capacity: bool = False) -> dict[str, str | None]:
    """{e3, linker, poi}, all None where no cut leaves three parts."""
    mol = m.parse(text)
    if mol is None:
        return {"e3": None, "linker": None, "poi": None}
    return split_scored(mol, m.betweenness(mol, m.capacities(mol) if use_capacity else None), e3_refs, threshold)


def split_scored(mol: m.Molecule, score: list[float], e3_refs: list[set[int]], threshold: float) -> dict[str, str | None]:
    """As split, for a molecule whose betweenness is known."""
    bonds = best_cut(mol, candidate_bonds(mol, threshold, score))
    return (split_at(mol, bonds, e3_refs) if bonds else None) or {"e3": None, "linker": None, "poi": None}


PLACES = 64


@lru_cache(50_000)
def _place(kind: tuple) -> int:
    return zlib.crc32(repr(kind).encode()) % PLACES


def surroundings(mol: m.Molecule, near: list, u: int, v: int) -> list[float]:
    """A small fingerprint of what stands up to two bonds from either end of a bond."""
    out = [0.0] * PLACES
    for end, other in ((u, v), (v, u)):
        first = sorted((mol.bonds[b][2], mol.atoms[x][1], x) for x, b in near[end] if x != other)
        kinds = [(0, mol.atoms[end][1]), (1, mol.atoms[end][1], *((o, e) for o, e, _ in first))]
        kinds += [(2, mol.atoms[end][1], o, e, *sorted((mol.bonds[b][2], mol.atoms[y][1]) for y, b in near[x] if y != end)) for o, e, x in first]
        for k in kinds:
            out[_place(k)] = 1.0
    return out


def edge_features(text: str | None) -> list[dict]:
    """One record a bridge: its place, its ends' centralities and degrees, and how many atoms are two and three bonds away."""
    mol = m.parse(text)
    if mol is None:
        return []
    near, score, out = mol.neighbours(), m.betweenness(mol), []
    free = m.bridges(mol)
    rings, walk = len(mol.bonds) - len(free), m.tree(mol)

    @cache
    def shells(u: int) -> list[int]:
        seen, edge, sizes = {u}, {u}, []
        for _ in range(3):
            edge = {v for x in edge for v, _ in near[x]} - seen
            seen |= edge
            sizes.append(len(edge))
        return sizes

    for b in free:
        u, v, order = mol.bonds[b]
        su, sv = shells(u), shells(v)
        part = walk.below(b) if b in walk.low else len(next(p for p in m.pieces(mol, {b}) if u in p))
        out.append({"bond": b, "atom_u": mol.atoms[u][1], "atom_v": mol.atoms[v][1], "order": order, "degree_u": su[0], "degree_v": sv[0], "degree2_u": su[1], "degree2_v": sv[1], "degree3_u": su[2], "degree3_v": sv[2], "betweenness_u": score[u], "betweenness_v": score[v], "smaller_side": min(part, len(mol.atoms) - part), "num_nodes": len(mol.atoms), "num_edges": len(mol.bonds), "ring_bonds": rings, "fp": surroundings(mol, near, u, v)})
    return out
