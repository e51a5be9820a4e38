"""Repairing a predicted split against the whole molecule."""

from __future__ import annotations

from fragmill.chem import molecule as m


def _cuts(whole: m.Molecule, part: m.Molecule, label: int) -> list[tuple[int, list[int]]]:
    """(bond, other side's atoms) of each single bond in no ring that leaves this part on one side."""
    out, walk = [], m.tree(whole)
    parted = walk.total < len(whole.atoms)
    for b in m.bridges(whole):
        if whole.bonds[b][2] != 1.0:
            continue
        if not parted and len(part.atoms) - 1 not in (walk.below(b), walk.total - walk.below(b)):
            continue
        one = next(p for p in m.pieces(whole, {b}) if whole.bonds[b][0] in p)
        two = [a for a in range(len(whole.atoms)) if a not in set(one)]
        for side, other in ((one, two), (two, one)):
            if len(side) + 1 == len(part.atoms) and m.same(m.labelled(whole, side, {b: label}), part):
                out.append((b, other))
    return out


def _strings(whole: m.Molecule, e3_cut: int, poi_cut: int) -> str | None:
    """The three parts that two cuts leave, or None if the middle isn't between them."""
    parts = m.pieces(whole, {e3_cut, poi_cut})
    label = {e3_cut: "[*:2]", poi_cut: "[*:1]"}
    named: dict[str, str] = {}
    for p in parts:
        touch = [b for b in (e3_cut, poi_cut) if set(whole.bonds[b][:2]) & set(p)]
        role = "linker" if len(touch) == 2 else "e3" if touch == [e3_cut] else "poi"
        extra = {a: [label[b] for b in (e3_cut, poi_cut) if a in whole.bonds[b][:2]] for a in p}
        named[role] = m.write(whole, p, extra, {e3_cut, poi_cut})
    return f"{named['e3']}.{named['linker']}.{named['poi']}" if len(named) == 3 and len(parts) == 3 else None


def repair(prediction: str | None, whole: str | None) -> tuple[str | None, str]:
    """(prediction, how): as given if it reassembles; else the first of these that does: labels of the linker exchanged,
    or the one wrong part cut anew from the whole with the two right ones; (None, 'failed') else."""
    target = m.parse(whole)
    if target is None or not prediction:
        return None, "failed"
    if m.reassembles(prediction, whole):
        return prediction, "as given"
    swap = lambda t: t.replace("[*:1]", "[*:x]").replace("[*:2]", "[*:1]").replace("[*:x]", "[*:2]")
    parts = prediction.split(".")
    if len(parts) == 3:
        for i, p in enumerate(parts):
            if "[*:1]" in p and "[*:2]" in p:
                tried = ".".join([*parts[:i], swap(p), *parts[i + 1 :]])
                if m.reassembles(tried, whole):
                    return tried, "linker turned"
    ligand = {}
    graphs = [m.parse(p) for p in parts]
    for label, role in ((2, "e3"), (1, "poi")):
        for g in graphs:
            if g and sum(a[1] == "*" for a in g.atoms) == 1:
                mine = m.Molecule([(f"[*:{label}]", "*", label) if a[1] == "*" else a for a in g.atoms], g.bonds)
                if any(a[1] == "*" and a[2] in (label, 0) for a in g.atoms):
                    ligand.setdefault(role, []).extend(_cuts(target, mine, label))
    linkers = [g for g in graphs if g and sum(a[1] == "*" for a in g.atoms) == 2]
    for e, _ in ligand.get("e3", []):
        for p, _ in ligand.get("poi", []):
            got = _strings(target, e, p) if e != p else None
            if got and m.reassembles(got, whole):
                return got, "linker cut anew"
    for role, other in (("e3", "poi"), ("poi", "e3")):
        for b, _ in ligand.get(role, []):
            for c in m.bridges(target):
                if c == b or target.bonds[c][2] != 1.0:
                    continue
                cuts = {b: 2 if role == "e3" else 1, c: 1 if role == "e3" else 2}
                middle = next((p for p in m.pieces(target, set(cuts)) if all(set(target.bonds[x][:2]) & set(p) for x in cuts)), None)
                if middle and any(len(middle) + 2 == len(g.atoms) and m.same(m.labelled(target, middle, cuts), g) for g in linkers):
                    got = _strings(target, *((b, c) if role == "e3" else (c, b)))
                    if got and m.reassembles(got, whole):
                        return got, f"{other} cut anew"
    return None, "failed"
