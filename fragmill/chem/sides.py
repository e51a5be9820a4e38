"""The pieces a molecule falls into at one or two bonds, with keys by which equal pieces meet in a join.

A key sums hashes of a piece's atoms and bonds, so that of a side follows from running sums along one walk of the
molecule, and that of a middle from the whole less two sides. Equal pieces have equal keys; whether pieces of equal keys
are equal is then checked on their graphs.
"""

from __future__ import annotations

from functools import cache, lru_cache
from hashlib import blake2b

from fragmill.chem import molecule as m
from fragmill.chem.describe import bare

_MASK = (1 << 63) - 1


@cache
def _hash(*x) -> int:
    return int.from_bytes(blake2b(repr(x).encode(), digest_size=8).digest(), "little")


def _bond(mol: m.Molecule, b: int) -> int:
    u, v, o = mol.bonds[b]
    return _hash(o, *sorted((mol.atoms[u][1], mol.atoms[v][1])))


@m._once
def whole_sum(mol: m.Molecule) -> int:
    return sum(_hash(e) for _, e, _ in mol.atoms) + sum(_bond(mol, b) for b in range(len(mol.bonds)))


def key_of(text: str | None) -> tuple[int, int] | None:
    """(key, atoms) of a piece written with or without attachment points; None for what cannot be read."""
    mol = m.parse(text)
    mol = bare(mol) if mol is not None else None
    return (whole_sum(mol) & _MASK, len(mol.atoms)) if mol is not None and mol.atoms else None


@m._once
def sides(mol: m.Molecule) -> list[tuple[int, int, int, int]]:
    """(bond, side, sum, atoms) of both sides of each single bond in no ring; side 0 is that of the bond's first atom.
    Molecules of several parts have none."""
    t = m.tree(mol)
    if min(t.place) < 0:
        return []
    n = len(mol.atoms)
    add = [0] * (n + 1)
    for u, (_, e, _) in enumerate(mol.atoms):
        add[t.place[u] + 1] += _hash(e)
    for b, (u, v, _) in enumerate(mol.bonds):  # a bond counts with its later atom: inside a side, both of its atoms are
        add[max(t.place[u], t.place[v]) + 1] += _bond(mol, b)
    for i in range(n):
        add[i + 1] += add[i]
    out = []
    for b in t.low:
        u, v, o = mol.bonds[b]
        if o == 1.0:
            below, count = add[t.high[b]] - add[t.low[b]] - _bond(mol, b), t.below(b)
            above = add[n] - below - _bond(mol, b)
            deep = 0 if t.holds(b, u) else 1
            out += [(b, deep, below, count), (b, 1 - deep, above, n - count)]
    return out


def atoms_of(mol: m.Molecule, bond: int, side: int) -> list[int]:
    """The atoms on one side of a bond."""
    at = mol.bonds[bond][side]
    return next(p for p in m.pieces(mol, {bond}) if at in p)


def middles(mol: m.Molecule, bond: int, side: int) -> list[tuple[int, int, int, int]]:
    """(bond, side, sum, atoms of the middle) for each other bond whose one side lies beyond the given side."""
    every = sides(mol)
    own = next(x for x in every if x[:2] == (bond, side))
    inside = set(atoms_of(mol, bond, side))
    total, t = whole_sum(mol), m.tree(mol)
    out = []
    for b, s, value, n in every:
        if b == bond or mol.bonds[b][0] in inside:
            continue
        # The far side of b is the one without the given side.
        if (t.holds(b, mol.bonds[bond][side]) == t.holds(b, mol.bonds[b][s])):
            continue
        out.append((b, s, (total - own[2] - value - _bond(mol, bond) - _bond(mol, b)) & _MASK, len(mol.atoms) - own[3] - n))
    return out


def same_piece(mol: m.Molecule, atoms: list[int], text: str) -> bool:
    """Whether some atoms of a molecule are the graph of a piece, attachment points aside."""
    other = _bare(text)
    if other is None:
        return False
    own = bare(m.labelled(mol, atoms, {}))
    return len(own.atoms) == len(other.atoms) and len(own.bonds) == len(other.bonds) and m.refined(own) == m.refined(other)


@lru_cache(2_000)
def _bare(text: str) -> m.Molecule | None:
    mol = m.parse(text)
    return bare(mol) if mol is not None else None
