"""Descriptors of molecules and of the linkers of splits. Counts are of the graph as written; see ``patterns`` on aromaticity."""

from __future__ import annotations

from fragmill.chem import molecule as m
from fragmill.chem import patterns as p

#: Elements that are no rarity, and the ring size from which a ring counts as a macrocycle.
COMMON = {"H", "C", "N", "O", "F", "Cl", "Br", "S", "I"}
MACROCYCLE = 12
#: Atom contributions to the polar surface (Ertl et al. 2000), by element, connections without hydrogens,
#: hydrogens, and the sum of bond orders; aromatic atoms by lower case.
POLAR = {
    ("N", 1, 0, 3): 23.79, ("N", 1, 1, 2): 23.85, ("N", 1, 2, 1): 26.02, ("N", 2, 0, 3): 12.36, ("N", 2, 1, 2): 12.03, ("N", 3, 0, 3): 3.24,
    ("O", 1, 0, 2): 17.07, ("O", 1, 1, 1): 20.23, ("O", 2, 0, 2): 9.23, ("n", 2, 0, 3): 12.89, ("n", 2, 1, 3): 15.79, ("n", 3, 0, 4): 4.93, ("o", 2, 0, 3): 13.14,
}

FIELDS = (
    "heavy_atoms int, mw double, graph_diameter int, num_bonds int, num_rotatable_bonds int, frac_rotatable_bonds double, rotatable_bond_ratio double, frac_csp3 double, tpsa double, num_stereocenters int, "
    "num_rings int, num_aromatic_rings int, num_aliphatic_rings int, num_saturated_rings int, max_ring_size int, ring_sizes string, num_macrocycles int, macrocycle_sizes string, num_spiro_atoms int, num_bridgehead_atoms int, "
    "rare_elements string, flag_rare_element boolean, alert_hits string, num_alert_hits int"
)
BACKBONE = "backbone_length int, backbone_rotatable_bonds int, backbone_frac_rotatable double, effective_length int, max_graph_length int, graph_length_ratio double"
_TEXTS = ("ring_sizes", "macrocycle_sizes", "rare_elements", "alert_hits")


def rings(mol: m.Molecule) -> list[list[int]]:
    """A smallest set of rings: shortest cycles through each ring bond, the short ones first, as long as they are
    independent of those taken."""
    near, free = mol.neighbours(), set(m.bridges(mol))
    wanted = len(mol.bonds) - len(mol.atoms) + len(m.pieces(mol, set()))
    found: dict[frozenset[int], list[int]] = {}
    for b, (s, t, _) in enumerate(mol.bonds):
        if b in free:
            continue
        # All shortest ways from one end to the other without the bond, one a neighbour of the end.
        before: dict[int, list[tuple[int, int]]] = {s: []}
        far, order = {s: 0}, [s]
        for u in order:
            for v, c in near[u]:
                if c == b or c in free:
                    continue
                if v not in far:
                    far[v] = far[u] + 1
                    before[v] = [(u, c)]
                    order.append(v)
                elif far[v] == far[u] + 1:
                    before[v].append((u, c))
        for first in before.get(t, []):
            atoms, bonds, (u, c) = [t], [b, first[1]], first
            while True:
                atoms.append(u)
                if u == s:
                    break
                u, c = before[u][0]
                bonds.append(c)
            found.setdefault(frozenset(bonds), atoms)
    taken, rows = [], []
    for bonds, atoms in sorted(found.items(), key=lambda x: (len(x[0]), sorted(x[0]))):
        if len(taken) == wanted:
            break
        rest = sum(1 << b for b in bonds)
        for row in rows:
            rest = min(rest, rest ^ row)
        if rest:
            rows = sorted([*rows, rest], reverse=True)
            taken.append(atoms)
    return taken


def rotatable(w: p.View) -> set[int]:
    """Single bonds in no ring between atoms that have another neighbour and no triple bond."""
    def turns(u: int) -> bool:
        return len(w.near[u]) > 1 and not any(w.mol.bonds[b][2] == 3.0 for _, b in w.near[u])

    return {b for b in w.free if w.mol.bonds[b][2] == 1.0 and turns(w.mol.bonds[b][0]) and turns(w.mol.bonds[b][1])}


def bare(mol: m.Molecule) -> m.Molecule:
    """Without attachment points; what they leave free is hydrogen."""
    keep = {a: i for i, a in enumerate(u for u, x in enumerate(mol.atoms) if x[1] != "*")}
    return m.Molecule([mol.atoms[a] for a in keep], [(keep[u], keep[v], o) for u, v, o in mol.bonds if u in keep and v in keep])


def _diameter(mol: m.Molecule) -> int:
    """The longest shortest way of any part: ring systems hang together by bridges, so searches run only inside them, and
    of what hangs off an atom only its depth counts."""
    near, free = mol.neighbours(), set(m.bridges(mol))
    system, systems = [-1] * len(near), m.pieces(mol, free)
    for i, s in enumerate(systems):
        for u in s:
            system[u] = i
    best, order, entered, above = 0, [], [-1] * len(systems), [-1] * len(systems)
    for i, s in enumerate(systems):
        if entered[i] < 0:
            entered[i], walk = s[0], [i]
            for k in walk:
                for u in systems[k]:
                    for v, b in near[u]:
                        if b in free and b != above[k]:  # bridges make a tree of ring systems
                            entered[system[v]], above[system[v]] = v, b
                            walk.append(system[v])
            order += walk
    depth = [0] * len(near)  # at first the longest way down by an atom's own bridges; of an entry, by its whole ring system
    for k in reversed(order):
        s = systems[k]
        for u in s:
            down = sorted((1 + depth[v] for v, b in near[u] if b in free and b != above[k]), reverse=True)
            depth[u] = down[0] if down else 0
            best = max(best, sum(down[:2]))
        if len(s) > 1:
            own = {u: depth[u] for u in s}
            for u in s:
                far, shell = {u: 0}, [u]
                for x in shell:
                    for v, b in near[x]:
                        if b not in free and v not in far:
                            far[v] = far[x] + 1
                            shell.append(v)
                reach = max(far[v] + own[v] for v in s if v != u)
                best = max(best, own[u] + reach)
                if u == entered[k]:
                    depth[u] = max(own[u], reach)
    return best


def describe(text: str | None, fragment: bool = False) -> dict:
    """The FIELDS of one molecule; of a fragment without its attachment points. Numbers are None and texts empty for what
    cannot be read or has no atom."""
    out: dict = {f.split()[0]: None for f in FIELDS.split(", ")} | dict.fromkeys(_TEXTS, "") | {"flag_rare_element": False}
    mol = m.parse(text)
    if mol is not None and fragment:
        mol = bare(mol)
    if mol is None or not mol.atoms:
        return out
    w = p.view(mol)
    elements = [e.capitalize() for _, e, _ in mol.atoms]
    heavy, turning = sum(e not in ("H", "*") for e in elements), rotatable(w)
    carbons = [u for u, e in enumerate(elements) if e == "C"]
    sp3 = [u for u in carbons if mol.atoms[u][1] == "C" and all(mol.bonds[b][2] == 1.0 for _, b in w.near[u])]
    polar = 0.0
    for u, (_, e, _) in enumerate(mol.atoms):
        orders = [mol.bonds[b][2] for _, b in w.near[u]]
        total = len(orders) + 1 if e.islower() else int(sum(orders))
        polar += POLAR.get((e, len(orders), w.hydrogens[u], total), 0.0)
    cycles = rings(mol)
    sizes = sorted(map(len, cycles))
    aromatic = [c for c in cycles if all(mol.atoms[u][1].islower() for u in c)]
    inner = lambda c: (o for u, v, o in mol.bonds if u in c and v in c)
    saturated = [c for c in cycles if all(o == 1.0 for o in inner(set(c)))]
    large = [s for s in sizes if s >= MACROCYCLE]
    held = [set(x) for x in cycles]
    shared = [x & y for i, x in enumerate(held) for y in held[i + 1 :]]
    bridged = {u for s in shared if len(s) > 2 for u in s if sum(v in s for v, _ in w.near[u]) == 1}
    rare, alerts = sorted(set(elements) - COMMON - {"*"}), p.hits(w, p.ALERTS)
    share = lambda x, n: round(x / n, 3) if n else None
    return out | {
        "heavy_atoms": heavy, "mw": round(m.weight(mol), 1), "graph_diameter": _diameter(mol) if heavy > 1 else 0, "num_bonds": len(mol.bonds),
        "num_rotatable_bonds": len(turning), "frac_rotatable_bonds": share(len(turning), heavy), "rotatable_bond_ratio": share(len(turning), len(mol.bonds)),
        "frac_csp3": round(len(sp3) / len(carbons), 3) if carbons else 0.0, "tpsa": round(polar, 1), "num_stereocenters": sum("@" in t for t, _, _ in mol.atoms),
        "num_rings": len(cycles), "num_aromatic_rings": len(aromatic), "num_aliphatic_rings": len(cycles) - len(aromatic), "num_saturated_rings": len(saturated),
        "max_ring_size": sizes[-1] if sizes else 0, "ring_sizes": ";".join(map(str, sizes)), "num_macrocycles": len(large), "macrocycle_sizes": ";".join(map(str, large)),
        "num_spiro_atoms": len({u for s in shared if len(s) == 1 for u in s}), "num_bridgehead_atoms": len(bridged),
        "rare_elements": ";".join(rare), "flag_rare_element": bool(rare), "alert_hits": ";".join(alerts), "num_alert_hits": len(alerts),
    }


def backbone(text: str | None) -> dict:
    """The BACKBONE fields of a linker: its shortest way between two attachment points, and the longest of all."""
    out: dict = {f.split()[0]: None for f in BACKBONE.split(", ")}
    mol = m.parse(text)
    ends = [i for i, a in enumerate(mol.atoms) if a[1] == "*"] if mol else []
    if len(ends) != 2:
        return out
    w, far = p.view(mol), m.distances(mol)
    if far[ends[0]][ends[1]] < 1:
        return out
    way, bonds = [ends[0]], []
    while way[-1] != ends[1]:
        v, b = next((v, b) for v, b in w.near[way[-1]] if far[v][ends[1]] == far[way[-1]][ends[1]] - 1)
        way.append(v)
        bonds.append(b)
    turning, longest = len(set(bonds) & rotatable(w)), _diameter(mol)
    return {"backbone_length": len(way) - 2, "backbone_rotatable_bonds": turning, "backbone_frac_rotatable": round(turning / len(bonds), 3), "effective_length": len(bonds), "max_graph_length": longest, "graph_length_ratio": round(longest / len(bonds), 3)}


def scan(text: str | None) -> dict:
    """{alert_hits, leaving_group_hits, unstable, leaving_group}; usual alerts raise no flag."""
    mol = m.parse(text)
    if mol is None:
        return {"alert_hits": [], "leaving_group_hits": [], "unstable": False, "leaving_group": False}
    w = p.view(mol)
    alerts, leaving = p.hits(w, p.ALERTS), p.hits(w, p.LEAVING_GROUPS)
    return {"alert_hits": alerts, "leaving_group_hits": leaving, "unstable": bool(set(alerts) - set(p.ALLOWED_ALERTS)), "leaving_group": bool(leaving)}
