"""Molecules as labelled graphs: reading, writing, cutting, joining, comparing."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache, wraps
from hashlib import blake2b
from itertools import zip_longest

_TOKEN = re.compile(r"(\[[^\[\]]+\])|(Cl|Br|[BCNOPSFIbcnops*])|(%\d\d|\d)|([-=#:/\\])|(\()|(\))|(\.)")
_BRACKET = re.compile(r"\[(\d*)(\*|[A-Z][a-z]?|[a-z]{1,2})(@{0,2})(H\d*)?([+-]\d+|\++|-+)?(?::(\d+))?\]")
#: Standard atomic weights of common elements.
WEIGHTS = {"H": 1.008, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "P": 30.974, "S": 32.06, "Cl": 35.45, "Br": 79.904, "I": 126.904}
#: Usual valences, for implied hydrogens.
VALENCES = {"B": (3,), "C": (4,), "N": (3, 5), "O": (2,), "F": (1,), "P": (3, 5), "S": (2, 4, 6), "Cl": (1,), "Br": (1,), "I": (1,)}
#: How hard bonds of an order are to cut; ring and aromatic bonds, and any other order.
CAPACITIES, RINGED, OTHER = {1.0: 1.0, 2.0: 10.0, 3.0: 20.0}, 1000.0, 50.0
ORDERS = {"-": 1.0, "=": 2.0, "#": 3.0, ":": 1.5, "/": 1.0, "\\": 1.0}


def _once(f):
    """f(molecule), computed once for as long as no atom or bond is added. What comes out must not be changed."""

    @wraps(f)
    def get(mol: Molecule, *args):
        size = (len(mol.atoms), len(mol.bonds))
        if mol.held.get("size") != size:
            mol.held = {"size": size}
        k = (f.__name__, *args)
        if k not in mol.held:
            mol.held[k] = f(mol, *args)
        return mol.held[k]

    return get


@dataclass
class Molecule:
    """atoms: (token, element, label); label is the number of an attachment point, else 0. bonds: (u, v, order)."""

    atoms: list[tuple[str, str, int]] = field(default_factory=list)
    bonds: list[tuple[int, int, float]] = field(default_factory=list)
    held: dict = field(default_factory=dict, repr=False, compare=False)

    @_once
    def neighbours(self) -> list[list[tuple[int, int]]]:
        """For each atom, (atom, bond) pairs in the order of the bonds."""
        out: list[list[tuple[int, int]]] = [[] for _ in self.atoms]
        for i, (u, v, _) in enumerate(self.bonds):
            out[u].append((v, i))
            out[v].append((u, i))
        return out


def parse(text: str | None) -> Molecule | None:
    """The graph of a molecule string; None for what is not well-formed."""
    if not text:
        return None
    mol, at, open_rings, branches, last, order = Molecule(), 0, {}, [], None, None
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            return None
        at = m.end()
        bracket, atom, ring, bond, opening, closing, dot = m.groups()
        if bracket or atom:
            if bracket:
                b = _BRACKET.fullmatch(bracket)
                if not b:
                    return None
                element = b[2]
                label = int(b[6] or 0) or (int(b[1]) if element == "*" and b[1] else 0)
            else:
                element, label = atom, 0
            mol.atoms.append((bracket or atom, element, label))
            new = len(mol.atoms) - 1
            if last is not None:
                both = element.islower() and mol.atoms[last][1].islower()
                mol.bonds.append((last, new, ORDERS[order] if order else 1.5 if both else 1.0))
            last, order = new, None
        elif ring:
            if last is None:
                return None
            n = int(ring.lstrip("%"))
            if n in open_rings:
                other, held = open_rings.pop(n)
                given = order or held
                both = mol.atoms[last][1].islower() and mol.atoms[other][1].islower()
                if other == last:
                    return None
                mol.bonds.append((other, last, ORDERS[given] if given else 1.5 if both else 1.0))
            else:
                open_rings[n] = (last, order)
            order = None
        elif bond:
            order = bond
        elif opening:
            if last is None:
                return None
            branches.append(last)
        elif closing:
            if not branches:
                return None
            last = branches.pop()
        else:
            last = None
    if not mol.atoms or open_rings or branches or order is not None:
        return None
    free = set(bridges(mol))  # an unwritten bond between aromatic atoms is aromatic only in a ring
    mol.bonds = [(u, v, 1.0 if o == 1.5 and i in free else o) for i, (u, v, o) in enumerate(mol.bonds)]
    return mol


@_once
def bridges(mol: Molecule) -> list[int]:
    """Bonds in no ring, by one depth-first search without recursion."""
    near, n = mol.neighbours(), len(mol.atoms)
    seen, low, out, clock = [0] * n, [0] * n, [], 0
    for root in range(n):
        if seen[root]:
            continue
        clock += 1
        seen[root] = low[root] = clock
        stack = [(root, -1, iter(near[root]))]
        while stack:
            u, via, rest = stack[-1]
            for v, b in rest:
                if b == via:
                    continue
                if seen[v]:
                    low[u] = min(low[u], seen[v])
                else:
                    clock += 1
                    seen[v] = low[v] = clock
                    stack.append((v, b, iter(near[v])))
                    break
            else:
                stack.pop()
                if stack:
                    p = stack[-1][0]
                    low[p] = min(low[p], low[u])
                    if low[u] > seen[p]:
                        out.append(via)
    return sorted(out)


@dataclass
class Tree:
    """A molecule hung up at one atom: for each bond in no ring, the atoms below it are those with places in
    ``low[b]..high[b]``; ``place`` gives each atom's, -1 those of other parts. ``total`` atoms hang there."""

    place: list[int]
    low: dict[int, int]
    high: dict[int, int]
    total: int

    def below(self, bond: int) -> int:
        return self.high[bond] - self.low[bond]

    def holds(self, bond: int, atom: int) -> bool:
        return self.low[bond] <= self.place[atom] < self.high[bond]

    def beyond(self, bond: int, atom: int) -> int:
        """How many atoms are on this atom's side of a bond."""
        return self.below(bond) if self.holds(bond, atom) else self.total - self.below(bond)


@_once
def tree(mol: Molecule, root: int = 0) -> Tree:
    """One depth-first walk of the part of an atom; bonds of other parts are left out."""
    near, free = mol.neighbours(), set(bridges(mol))
    place, low, high = [-1] * len(mol.atoms), {}, {}
    stack, clock = [(root, -1, iter(near[root]))], 1
    place[root] = 0
    while stack:
        u, via, rest = stack[-1]
        for v, b in rest:
            if place[v] < 0:
                place[v] = clock
                if b in free:
                    low[b] = clock
                clock += 1
                stack.append((v, b, iter(near[v])))
                break
        else:
            stack.pop()
            if via in low:
                high[via] = clock
    return Tree(place, low, high, clock)


def betweenness(mol: Molecule, capacity: list[float] | None = None) -> list[float]:
    """Normalised betweenness of each atom, ends of paths included; with capacities these are the bonds' lengths.

    Bridges part the molecule into ring systems and single atoms. Which way a path takes is open only within a ring
    system, so the searches run there, with each atom standing for all that hang off it; pairs that an atom parts are
    counted by their numbers. Scores are rounded to twelve places, so that atoms of equal standing tie.
    """
    import heapq

    n, near, free = len(mol.atoms), mol.neighbours(), set(bridges(mol))
    score, weight = [0.0] * n, [1] * n
    for part in pieces(mol, set()):
        walk = tree(mol, part[0])
        for u in part:
            hung = [walk.beyond(b, v) for v, b in near[u] if b in free]
            w = weight[u] = 1 + sum(hung)  # the atom and all that reach the rest of its ring system through it
            score[u] += 2 * w * (walk.total - w) + (w - 1) ** 2 - sum(x * x for x in hung) + 2 * (w - 1)
    for part in pieces(mol, free):
        if len(part) < 3:
            continue
        inner = {u: [v for v, b in near[u] if b not in free] for u in part}
        for s in part:
            far, paths, before, order, done = {s: 0.0}, {s: 1.0}, {s: []}, [], set()
            level = [] if capacity else [s]
            while level:  # bonds of length one: whole shells, in the order in which a heap would give them
                order += level
                after = []
                for u in level:
                    step = far[u] + 1.0
                    for v in inner[u]:
                        if v not in far:
                            far[v], paths[v], before[v] = step, paths[u], [u]
                            after.append(v)
                        elif step == far[v]:
                            paths[v] += paths[u]
                            before[v].append(u)
                level = sorted(after)
            heap = [(0.0, s)] if capacity else []
            while heap:
                d, u = heapq.heappop(heap)
                if u in done:
                    continue
                done.add(u)
                order.append(u)
                for v, b in near[u]:
                    if b in free:
                        continue
                    step = d + (capacity[b] if capacity else 1.0)
                    if v not in far or step < far[v]:
                        far[v], paths[v], before[v] = step, paths[u], [u]
                        heapq.heappush(heap, (step, v))
                    elif step == far[v] and v not in done:
                        paths[v] += paths[u]
                        before[v].append(u)
            share = dict.fromkeys(part, 0.0)
            for x in reversed(order[1:]):
                for u in before[x]:
                    share[u] += paths[u] / paths[x] * (weight[x] + share[x])
                score[x] += weight[s] * share[x]
    scale = 1 / (n * (n - 1)) if n > 1 else 1.0
    return [round(x * scale, 12) for x in score]


def distances(mol: Molecule) -> list[list[int]]:
    """How many bonds apart all atoms are; -1 between parts."""
    near, out = mol.neighbours(), []
    for s in range(len(near)):
        far, order = [-1] * len(near), [s]
        far[s] = 0
        for u in order:
            for v, _ in near[u]:
                if far[v] < 0:
                    far[v] = far[u] + 1
                    order.append(v)
        out.append(far)
    return out


def capacities(mol: Molecule) -> list[float]:
    """How hard a bond is to cut: ring or aromatic 1000, single 1, double 10, triple 20."""
    free = set(bridges(mol))
    return [RINGED if i not in free or o == 1.5 else CAPACITIES.get(o, OTHER) for i, (_, _, o) in enumerate(mol.bonds)]


def pieces(mol: Molecule, cut: set[int]) -> list[list[int]]:
    """Connected atoms after some bonds are cut."""
    near, seen, out = mol.neighbours(), set(), []
    for root in range(len(mol.atoms)):
        if root in seen:
            continue
        seen.add(root)
        part, stack = [], [root]
        while stack:
            u = stack.pop()
            part.append(u)
            for v, b in near[u]:
                if b not in cut and v not in seen:
                    seen.add(v)
                    stack.append(v)
        out.append(sorted(part))
    return out


def write(mol: Molecule, atoms: list[int], extra: dict[int, list[str]] | None = None, cut: set[int] | None = None) -> str:
    """A string of some connected atoms; extra gives each atom further branches, such as attachment points."""
    near, cut, inside = mol.neighbours(), cut or set(), set(atoms)
    mark = {1.0: "", 1.5: "", 2.0: "=", 3.0: "#"}
    parent, order, children, closures = {atoms[0]: -1}, [], {a: [] for a in atoms}, {a: [] for a in atoms}
    used, stack = set(), [(atoms[0], iter(near[atoms[0]]))]
    order.append(atoms[0])
    ring = 0
    while stack:
        u, rest = stack[-1]
        for v, b in rest:
            if b in used or b in cut or v not in inside:
                continue
            used.add(b)
            if v in parent:
                ring += 1
                name = str(ring) if ring < 10 else f"%{ring}"
                o = mol.bonds[b][2]
                single = "-" if o == 1.0 and mol.atoms[u][1].islower() and mol.atoms[v][1].islower() else mark[o]
                closures[u].append(single + name)
                closures[v].append(name)
            else:
                parent[v] = u
                children[u].append((v, b))
                stack.append((v, iter(near[v])))
                break
        else:
            stack.pop()
    # Depth-first without recursion: a list of text pieces, branches before the last child.
    out: list[str] = []
    todo: list = [(atoms[0], None)]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        u, b = item
        if b is not None:
            o = mol.bonds[b][2]
            x, y = mol.bonds[b][0], mol.bonds[b][1]
            out.append("-" if o == 1.0 and mol.atoms[x][1].islower() and mol.atoms[y][1].islower() else mark[o])
        out.append(mol.atoms[u][0] + "".join(closures[u]))
        tails: list = [("s", t) for t in (extra or {}).get(u, [])] + [("c", c) for c in children[u]]
        later: list = []
        for i, (kind, t) in enumerate(tails):
            final = i == len(tails) - 1
            part = [t] if kind == "s" else [(t[0], t[1])]
            later += part if final else ["(", *part, ")"]
        todo += reversed(later)
    return "".join(out)


def reordered(mol: Molecule, order: list[int]) -> Molecule:
    """The same molecule with its atoms, and the bonds of each, in another order."""
    place = {a: i for i, a in enumerate(order)}
    return Molecule([mol.atoms[a] for a in order], sorted(tuple(sorted((place[u], place[v]))) + (o,) for u, v, o in mol.bonds))


def spelled(mol: Molecule, order: list[int]) -> str:
    """All parts of a molecule written with the atoms of lower place first."""
    new = reordered(mol, order)
    return ".".join(sorted((write(new, p) for p in pieces(new, set())), key=lambda t: (-len(t), t)))


def canonical(mol: Molecule) -> str:
    """One string for all ways in which a molecule is written: atoms by refined colours, ties broken one at a time.

    Stereo marks stay with their atoms. Another toolkit's canonical strings differ from these.
    """
    near = [[(round(2 * mol.bonds[b][2]), v) for v, b in x] for x in mol.neighbours()]
    keys: list = [(a[1], a[2], a[0], len(x)) for a, x in zip(mol.atoms, near, strict=True)]

    def ranked(values: list) -> list[int]:
        place = {k: i for i, k in enumerate(sorted(set(values)))}
        return [place[v] for v in values]

    rank = ranked(keys)
    while True:
        new = ranked([(rank[u], *sorted((o, rank[v]) for o, v in near[u])) for u in range(len(rank))])
        if len(set(new)) > len(set(rank)):
            rank = new
            continue
        tied = sorted((r for r in set(rank) if rank.count(r) > 1))
        if not tied:
            return spelled(mol, sorted(range(len(rank)), key=lambda u: rank[u]))
        first = rank.index(tied[0])
        rank = ranked([(r, u != first) if r == tied[0] else (r, False) for u, r in enumerate(rank)])


def randomised(mol: Molecule, seed: int) -> str:
    """Another way to write a molecule, the same for the same seed."""
    order = list(range(len(mol.atoms)))
    random.Random(seed).shuffle(order)
    return spelled(mol, order)


@cache
def _atom_colour(element: str, label: int) -> int:
    return int.from_bytes(blake2b(f"{element}|{label}".encode(), digest_size=7).digest(), "little")


def colours(mol: Molecule, rounds: int = 12) -> Iterator[list[int]]:
    """The atoms' colours after 0, 1, ... rounds of refinement by their bonds and neighbours, until no colour splits.

    Colours are hashes of numbers only, so they are the same in every process.
    """
    near = [[(round(2 * mol.bonds[b][2]), v) for v, b in x] for x in mol.neighbours()]
    colour = [_atom_colour(a[0], a[2]) for a in mol.atoms]
    kinds = len(set(colour))
    yield colour
    for _ in range(rounds):
        colour = [hash((colour[u], *sorted((o, colour[v]) for o, v in near[u]))) for u in range(len(colour))]
        before, kinds = kinds, len(set(colour))
        yield colour
        if kinds == before:
            return


@_once
def refined(mol: Molecule) -> list[list[int]]:
    """The colours after each round, in order: what ``same`` compares, for graphs that are compared many times."""
    return [sorted(c) for c in colours(mol)]


def same(a: Molecule, b: Molecule) -> bool:
    """Whether two graphs have the same refined colours, as molecules that differ have not in practice.

    Stereo marks are part of the atoms' tokens. Ends at the first round that tells the graphs apart.
    """
    if len(a.atoms) != len(b.atoms) or len(a.bonds) != len(b.bonds):
        return False
    return all(x is not None and y is not None and sorted(x) == sorted(y) for x, y in zip_longest(colours(a), colours(b)))


@lru_cache(50_000)
def _place(text: str) -> int:
    return int.from_bytes(blake2b(text.encode(), digest_size=8).digest(), "little")


def bits(mol: Molecule, radius: int = 2, size: int = 2048) -> set[int]:
    """Circular fingerprint: places of the neighbourhoods up to a radius; attachment points are left out."""
    near, out = mol.neighbours(), set()
    real = [e != "*" for _, e, _ in mol.atoms]
    beside = [[(str(mol.bonds[b][2]), v) for v, b in x if real[v]] for x in near]
    level = [f"{a[1]}{len(x)}" for a, x in zip(mol.atoms, beside, strict=True)]
    for r in range(radius + 1):
        out |= {_place(f"{r}{t}") % size for t, x in zip(level, real, strict=True) if x}
        if r < radius:
            level = [t + "(" + ",".join(sorted([o + level[v] for o, v in x])) + ")" if len(t) < 4000 else t for t, x in zip(level, beside, strict=True)]
    return out


def tanimoto(a: set[int], b: set[int]) -> float:
    n = len(a & b)
    return n / (len(a) + len(b) - n) if a or b else 0.0


def hydrogens(mol: Molecule) -> list[int]:
    """Hydrogens of each atom that are no atoms of their own: given in brackets, else what usual valences leave."""
    near, out = mol.neighbours(), []
    for u, (token, element, _) in enumerate(mol.atoms):
        if token.startswith("["):
            h = _BRACKET.fullmatch(token)[4]
            out.append(int(h[1:] or 1) if h else 0)
        elif element == "*":
            out.append(0)
        else:
            used = sum(mol.bonds[b][2] for _, b in near[u])
            out.append(max(0, int(next((v for v in VALENCES.get(element.capitalize(), (0,)) if v >= int(used)), 0) - used)))
    return out


def charges(mol: Molecule) -> list[int]:
    """The formal charge of each atom."""
    out = []
    for token, _, _ in mol.atoms:
        c = (_BRACKET.fullmatch(token)[5] or "") if token.startswith("[") else ""
        out.append(int(c) if c[1:].isdigit() else c.count("+") - c.count("-"))
    return out


def weight(mol: Molecule) -> float:
    """Molecular weight with implied hydrogens; attachment points weigh nothing."""
    return sum(WEIGHTS.get(e.capitalize(), 0.0) + WEIGHTS["H"] * h for (_, e, _), h in zip(mol.atoms, hydrogens(mol), strict=True) if e != "*")


def chain_length(mol: Molecule) -> int:
    """The longest unbranched acyclic run of atoms that starts at an attachment point."""
    near, free, best = mol.neighbours(), set(bridges(mol)), 0
    ringed = {x for i, (u, v, _) in enumerate(mol.bonds) if i not in free for x in (u, v)}
    for s, (_, e, _) in enumerate(mol.atoms):
        if e != "*":
            continue
        n, before, u = 0, s, near[s][0][0] if near[s] else None
        while u is not None and u not in ringed and len(near[u]) <= 2:
            n += 1
            before, u = u, next((v for v, _ in near[u] if v != before), None)
        best = max(best, n)
    return best


def join(parts: list[Molecule], label_pairs: list[int]) -> Molecule | None:
    """The parts joined at equal labels; each label must stand exactly twice. None if it doesn't."""
    whole = Molecule()
    for p in parts:
        k = len(whole.atoms)
        whole.atoms += p.atoms
        whole.bonds += [(u + k, v + k, o) for u, v, o in p.bonds]
    drop, new = set(), []
    near = whole.neighbours()
    for label in label_pairs:
        ends = [i for i, a in enumerate(whole.atoms) if a[2] == label and a[1] == "*"]
        if len(ends) != 2 or any(len(near[e]) != 1 for e in ends):
            return None
        (u, b), (v, c) = near[ends[0]][0], near[ends[1]][0]
        drop |= set(ends)
        new.append((u, v, max(whole.bonds[b][2], whole.bonds[c][2])))
    keep = {a: i for i, a in enumerate(x for x in range(len(whole.atoms)) if x not in drop)}
    if any(u in drop or v in drop for u, v, _ in new):
        return None
    out = Molecule([whole.atoms[a] for a in keep], [(keep[u], keep[v], o) for u, v, o in whole.bonds if u in keep and v in keep])
    out.bonds += [(keep[u], keep[v], o) for u, v, o in new]
    return out


def reassembles(prediction: str | None, whole: str | None) -> bool:
    """Whether the three labelled parts of a prediction join to the whole molecule."""
    target = parse(whole)
    parts = [parse(p) for p in (prediction or "").split(".")]
    if target is None or len(parts) != 3 or any(p is None for p in parts):
        return False
    joined = join(parts, [1, 2])
    return joined is not None and same(joined, target)


def edit_distance(a: Molecule, b: Molecule) -> int:
    """Greedy approximate graph edit distance: each atom of a takes the cheapest free atom of b in turn (label
    difference plus difference of degrees); atoms left over cost 1."""
    na, nb = a.neighbours(), b.neighbours()
    free, cost = list(range(len(b.atoms))), 0
    for u, (_, e, _) in enumerate(a.atoms):
        if not free:
            cost += 1
            continue
        price = [(b.atoms[v][1] != e) + abs(len(na[u]) - len(nb[v])) for v in free]
        k = price.index(min(price))
        cost += price[k]
        free.pop(k)
    return cost + len(free)


def without_stereo(text: str) -> str:
    """A molecule string without stereo marks."""
    text = re.sub(r"\[([A-Za-z]{1,2})@{1,2}H?\]", lambda t: t[1], text)
    return text.replace("@", "").replace("/", "").replace("\\", "")


def real_atoms(mol: Molecule) -> int:
    """Heavy atoms, attachment points not counted."""
    return sum(a[1] not in ("*", "H") for a in mol.atoms)


def linker_shape(mol: Molecule) -> tuple[int, int, int]:
    """(heavy atoms on the shortest path between the attachment points, branch points outside rings, rings)."""
    near, ends = mol.neighbours(), [i for i, a in enumerate(mol.atoms) if a[1] == "*"]
    between = -1
    if len(ends) >= 2:
        far, order = {ends[0]: 0}, [ends[0]]
        for u in order:
            for v, _ in near[u]:
                if v not in far:
                    far[v] = far[u] + 1
                    order.append(v)
        between = far.get(ends[1], 0) - 1
    free = set(bridges(mol))
    ringed = {x for i, (u, v, _) in enumerate(mol.bonds) if i not in free for x in (u, v)}
    branches = sum(len(x) >= 3 and u not in ringed for u, x in enumerate(near))
    return between, branches, len(mol.bonds) - len(mol.atoms) + len(pieces(mol, set()))


def roles(prediction: str | None) -> dict[str, str | None]:
    """{e3, linker, poi} by label content; all None unless there are three parts."""
    out: dict[str, str | None] = {"e3": None, "linker": None, "poi": None}
    parts = (prediction or "").split(".")
    if len(parts) == 3:
        for p in parts:
            one, two = "[*:1]" in p, "[*:2]" in p
            if one or two:
                out["linker" if one and two else "poi" if one else "e3"] = p
    return out


def labelled(mol: Molecule, atoms: list[int], cuts: dict[int, int]) -> Molecule:
    """Some atoms of a molecule, with an attachment point of the given label at each cut bond they touch."""
    place = {a: i for i, a in enumerate(atoms)}
    out = Molecule([mol.atoms[a] for a in atoms], [(place[u], place[v], o) for i, (u, v, o) in enumerate(mol.bonds) if i not in cuts and u in place and v in place])
    for b, label in cuts.items():
        for a in mol.bonds[b][:2]:
            if a in place:
                out.atoms.append((f"[*:{label}]", "*", label))
                out.bonds.append((place[a], len(out.atoms) - 1, 1.0))
    return out


def neighbourhood(mol: Molecule, label: int, hops: int = 1) -> str | None:
    """What stands around an attachment point: element, bonds and neighbours up to some hops, in sorted order."""
    near = mol.neighbours()
    at = next((i for i, a in enumerate(mol.atoms) if a[2] == label and a[1] == "*"), None)
    if at is None or not near[at]:
        return None

    def around(u: int, before: int, left: int) -> str:
        inner = sorted(f"{mol.bonds[b][2]:g}{around(v, u, left - 1)}" for v, b in near[u] if v != before) if left else []
        return mol.atoms[u][1] + ("(" + ",".join(inner) + ")" if inner else "")

    return around(near[at][0][0], at, hops)
