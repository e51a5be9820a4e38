"""The cuts and features of ``splitting`` for many whole molecules, with the same results, from one pass over each string.

Atoms of a string stand in the order of a depth-first walk: what hangs below a bond in no ring is one run of atoms and one
run of text. So pieces are runs and need no search, and what is known of a piece (its string, its likeness to known
ligands) is kept under its text, since ligands repeat. Molecules of several parts, with attachment points or with bonds
that a string does not give back are left to ``splitting``: ``read`` returns None for them.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from fragmill.chem import molecule as m
from fragmill.chem import splitting as cut

_TOKENS = re.compile(r"\[[^\[\]]+\]|Cl|Br|[BCNOPSFIbcnops*]|%\d\d|\d|[-=#:/\\]|[().]")
_ATOMS = {t: (t, t, 0) for t in ("Cl", "Br", *"BCNOPSFIbcnops")}
_RINGS = {f"%{i:02d}": i for i in range(100)} | {str(i): i for i in range(10)}
_SIGNS = {1.0: "", 1.5: "", 2.0: "=", 3.0: "#"}
#: Ring systems of more atoms take the searches of ``molecule.betweenness``; so many pieces are kept at once.
LARGEST, KEPT = 16, 20_000
#: Molecules of more atoms are left to ``splitting``, as the atoms near each one, held as bits, grow with the square; so
#: many bonds are judged at once.
LONGEST, JUDGED = 4_000, 1 << 14


@lru_cache(2_000)
def _bracket(token: str) -> tuple[str, str, int] | None:
    b = m._BRACKET.fullmatch(token)
    return (token, b[2], 0) if b and b[2] != "*" and not int(b[6] or 0) else None


class Whole:
    """A molecule as read: ``low`` are the atoms below a bridge, in order, each standing for its bridge; ``size`` tells how
    many atoms hang from an atom, itself included, ``near`` its (atom, bond) pairs."""

    __slots__ = ("bonds", "before", "free", "low", "masks", "mol", "n", "near", "parent", "rings", "size", "start", "stop", "system", "text", "up")


def read(text: str | None) -> Whole | None:
    """One walk of a well-formed string; None for what cannot be read or is left to ``splitting``."""
    if not text:
        return None
    tokens = _TOKENS.findall(text)
    if sum(map(len, tokens)) != len(text):
        return None
    atoms, bonds, parent, up, start, stop, rings, lower, near, masks = [], [], [], [], [], [], [], [], [], []
    open_rings, branches, last, order, at = {}, [], -1, None, 0
    v = b = -1  # the last atom and bond
    for t in tokens:
        end = at + len(t)
        a = _ATOMS.get(t) or (_bracket(t) if t[0] == "[" else None)
        if a:
            v += 1
            if v >= LONGEST:
                return None
            low = a[1].islower()
            if last >= 0:
                b += 1
                bonds.append((last, v, m.ORDERS[order] if order else 1.5 if low and lower[last] else 1.0))
                up.append(b)
                near[last].append((v, b))
                near.append([(last, b)])
                masks[last] |= 1 << v
                masks.append(1 << last)
            elif v:
                return None
            else:
                up.append(-1)
                near.append([])
                masks.append(0)
            atoms.append(a)
            lower.append(low)
            parent.append(last)
            start.append(at)
            stop.append(end)
            last, order = v, None
        elif t == "(":
            if last < 0:
                return None
            branches.append(last)
        elif t == ")":
            if not branches:
                return None
            last = branches.pop()
        elif t in m.ORDERS:
            order = t
        elif t in _RINGS:
            if last < 0 or last != v:
                return None
            number = _RINGS[t]
            if number in open_rings:
                other, held = open_rings.pop(number)
                if other == last or masks[other] >> last & 1:
                    return None
                given = order or held
                b += 1
                bonds.append((other, last, m.ORDERS[given] if given else 1.5 if lower[last] and lower[other] else 1.0))
                near[other].append((last, b))
                near[last].append((other, b))
                masks[other] |= 1 << last
                masks[last] |= 1 << other
                rings.append((other, last, b))
            else:
                open_rings[number] = (last, order)
            order, stop[last] = None, end
        else:
            return None
        at = end
    n = len(atoms)
    if not n or open_rings or branches or order is not None or len(bonds) - n > 90:
        return None
    size, system, cover = [1] * n, list(range(n)), [0] * n
    for i, (u, x, _) in enumerate(rings):
        cover[u] ^= 1 << i
        cover[x] ^= 1 << i
    for v in range(n - 1, 0, -1):
        p = parent[v]
        size[p] += size[v]
        cover[p] ^= cover[v]  # what is left stands for the ring bonds that lead out of those below
    for v in range(1, n):
        if cover[v]:
            system[v] = system[parent[v]]
        elif bonds[up[v]][2] == 1.5:
            bonds[up[v]] = (parent[v], v, 1.0)
    if any(o == 1.5 and not (lower[u] and lower[v]) for u, v, o in bonds):
        return None
    w = Whole()
    w.text, w.n, w.bonds, w.parent, w.up, w.start, w.stop, w.size, w.system, w.near, w.masks = text, n, bonds, parent, up, start, stop, size, system, near, masks
    upright = all(x < u + size[u] for u, x, _ in rings)  # else a walk by the order of bonds takes other ways
    sign = lambda b: "-" if bonds[b][2] == 1.0 and lower[bonds[b][0]] and lower[bonds[b][1]] else _SIGNS[bonds[b][2]]
    w.rings = [(u, x, sign(b)) for u, x, b in rings] if upright else None
    w.before = [sign(b) if b >= 0 else "" for b in up]
    w.low = [v for v in range(1, n) if not cover[v]]
    w.free = {up[v]: v for v in w.low}
    w.mol = m.Molecule(atoms, bonds, {"size": (n, len(bonds)), ("neighbours",): near})
    return w


@lru_cache(1_000)
def _between(k: int, bonds: tuple) -> np.ndarray:
    """For each atom of a ring system, the share of the shortest ways between two others that pass it."""
    near: list[list[int]] = [[] for _ in range(k)]
    for u, v in bonds:
        near[u].append(v)
        near[v].append(u)
    out = np.zeros((k, k, k))
    for s in range(k):
        far, paths, before, order, level = {s: 0}, {s: 1}, {s: []}, [], [s]
        while level:
            order += level
            after = []
            for u in level:
                for v in near[u]:
                    if v not in far:
                        far[v], paths[v], before[v] = far[u] + 1, paths[u], [u]
                        after.append(v)
                    elif far[v] == far[u] + 1:
                        paths[v] += paths[u]
                        before[v].append(u)
            level = sorted(after)
        for x in reversed(order[1:]):
            own = out[x, s].copy()
            own[x] += 1
            for u in before[x]:
                if u != s:
                    out[u, s] += paths[u] / paths[x] * own
    return out


def betweenness(w: Whole) -> list[float]:
    """As ``molecule.betweenness``; ring bonds weigh the same with capacities, so these change nothing."""
    n, size = w.n, w.size
    hung, squares = [0] * n, [0] * n
    for v in w.low:
        p, below = w.parent[v], size[v]
        above = n - below
        hung[p] += below
        squares[p] += below * below
        hung[v] += above
        squares[v] += above * above
    score = [2 * (h + 1) * (n - h - 1) + h * h - q + 2 * h for h, q in zip(hung, squares, strict=True)]
    rings: dict[int, list[int]] = {}
    place = [0] * n
    for u, s in enumerate(w.system):
        part = rings.setdefault(s, [])
        place[u] = len(part)
        part.append(u)
    local: dict[int, list[tuple[int, int]]] = {}
    for b, (u, v, _) in enumerate(w.bonds):
        if b not in w.free:
            local.setdefault(w.system[u], []).append((place[u], place[v]))
    for s, bonds in local.items():
        part = rings[s]
        if len(part) > LARGEST:
            return m.betweenness(w.mol)
        weight = np.array([hung[u] + 1.0 for u in part])
        for u, x in zip(part, _between(len(part), tuple(bonds)).dot(weight).dot(weight).tolist(), strict=True):
            score[u] += x
    scale = 1 / (n * (n - 1)) if n > 1 else 1.0
    return [round(x * scale, 12) for x in score]


class _Codes(dict):
    """A number for a bond's order and the element it leads to; sums of them tell how often each occurs."""

    def __missing__(self, k: tuple[float, str]) -> int:
        return self.setdefault(k, 1 << 16 * len(self))


_CODES, _PLACES = _Codes(), {}


def _bit(key: tuple, kind) -> int:
    """The place of a kind of surroundings as a bit; ``kind`` spells out what the key stands for."""
    if len(_PLACES) > KEPT:
        _PLACES.clear()
    return _PLACES.setdefault(key, 1 << cut._place(kind()))


def features(w: Whole, score: list[float]) -> tuple[list[tuple], list[int]]:
    """The numbers of ``splitting.edge_features`` for each bridge with both elements, and the fingerprints as bits."""
    near, bonds, atoms, n = w.near, w.bonds, w.mol.atoms, w.n
    one = [x | 1 << u for u, x in enumerate(w.masks)]
    two, three = [], []
    for x in near:
        got = 0
        for v, _ in x:
            got |= one[v]
        two.append(got)
    for x in near:
        got = 0
        for v, _ in x:
            got |= two[v]
        three.append(got)
    d1 = [x.bit_count() for x in w.masks]
    d2 = [x.bit_count() - 1 - d for x, d in zip(two, d1, strict=True)]
    d3 = [x.bit_count() - y.bit_count() for x, y in zip(three, two, strict=True)]
    total, codes, places = [0] * n, [], _PLACES
    for u, v, o in bonds:
        x, y = _CODES[o, atoms[v][1]], _CODES[o, atoms[u][1]]
        total[u] += x
        total[v] += y
        codes.append((x, y))
    beyond: dict[tuple[int, int], int] = {}

    def far(end: int, x: int, b: int) -> int:
        e, o, f = atoms[end][1], bonds[b][2], atoms[x][1]
        key = (e, o, f, total[x] - _CODES[o, e])
        got = beyond[end, x] = places.get(key) or _bit(key, lambda: (2, e, o, f, *sorted((bonds[c][2], atoms[y][1]) for y, c in near[x] if y != end)))
        return got

    def around(end: int, other: int, code: int) -> int:
        e = atoms[end][1]
        key = (e, total[end] - code)
        out = places.get(key)
        if out is None:
            first = 1 << cut._place((0, e))
            out = first | 1 << cut._place((1, e, *sorted((bonds[b][2], atoms[x][1]) for x, b in near[end] if x != other)))
            if len(places) > KEPT:
                places.clear()
            places[key] = out
        for x, b in near[end]:
            if x != other:
                out |= beyond.get((end, x)) or far(end, x, b)
        return out

    rows, prints, count = [], [], len(bonds)
    ringed = count - len(w.low)
    for v in w.low:
        u, _, order = bonds[w.up[v]]
        part = w.size[v]
        rows.append((order, d1[u], d1[v], d2[u], d2[v], d3[u], d3[v], score[u], score[v], min(part, n - part), n, count, ringed, atoms[u][1], atoms[v][1]))
        x, y = codes[w.up[v]]
        prints.append(around(u, v, x) | around(v, u, y))
    return rows, prints


def candidates(w: Whole, threshold: float, score: list[float]) -> list[int]:
    """As ``splitting.candidate_bonds``: the atoms below the bonds worth cutting."""
    n, near, masks = w.n, w.near, w.masks
    ringed = [False] * n
    for b, (u, v, _) in enumerate(w.bonds):
        if b not in w.free:
            ringed[u] = ringed[v] = True
    held = 0
    for u in sorted(range(n), key=lambda i: -score[i]):
        if not ringed[u] and (score[u] > threshold or masks[u] & held):
            held |= 1 << u
    for u in range(n):
        if masks[u] and not masks[u] & ~held:
            held |= 1 << u
    keep = 0
    if held:
        keep, degree = (1 << n) - 1, [len(x) for x in near]
        leaves = [u for u in range(n) if degree[u] <= 1 and not held >> u & 1]
        while leaves:
            u = leaves.pop()
            keep &= ~(1 << u)
            for v, _ in near[u]:
                if keep >> v & 1:
                    degree[v] -= 1
                    if degree[v] <= 1 and not held >> v & 1:
                        leaves.append(v)
    border = set()
    for u in range(n):
        if keep >> u & 1 and masks[u] & ~keep:
            border.add(next(b for v, b in near[u] if not keep >> v & 1))
    got = [v for v in w.low if w.up[v] in border or w.bonds[w.up[v]][2] == 1.0 and keep >> v & keep >> w.parent[v] & 1]
    return got if len(got) >= 2 else [v for v in w.low if w.bonds[w.up[v]][2] == 1.0]


@lru_cache(200)
def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def best_cut(w: Whole, low: list[int]) -> tuple[int, int] | None:
    """As ``splitting.best_cut``: parts of even sizes have the least sum of squares, as their sum is given."""
    if len(low) < 2:
        return None
    first, size, n, best = np.array(low), np.array([w.size[v] for v in low]), w.n, None
    for i, j in [_pairs(len(low))] if len(low) < 200 else cut.pair_blocks(len(low)):
        a, b = size[i], size[j]
        nested = first[j] < first[i] + a  # bonds come in the order of their atoms
        x, y = np.where(nested, b, a), np.where(nested, n - a, b)
        z = n - x - y
        uneven = (x + 1) ** 2 + (y + 1) ** 2 + (z + 2) ** 2
        k = int(uneven.argmin())
        if best is None or uneven[k] < best[0]:
            best = uneven[k], low[i[k]], low[j[k]]
    return best[1:]


def _runs(w: Whole, e3: int, poi: int) -> dict[str, tuple[int, int, int, int]]:
    """(atom above which the piece hangs, 0 for the first; atoms whose runs are missing, 0 for none) by role."""
    if e3 < poi < e3 + w.size[e3]:
        return {"e3": (0, e3, 0), "poi": (poi, 0, 0), "linker": (e3, poi, 0)}
    if poi < e3 < poi + w.size[poi]:
        return {"e3": (e3, 0, 0), "poi": (0, poi, 0), "linker": (poi, e3, 0)}
    return {"e3": (e3, 0, 0), "poi": (poi, 0, 0), "linker": (0, min(e3, poi), max(e3, poi))}


def _holds(w: Whole, run: tuple[int, int, int], u: int) -> bool:
    return run[0] <= u < run[0] + w.size[run[0]] and not any(x and x <= u < x + w.size[x] for x in run[1:])


def _atoms(w: Whole, run: tuple[int, int, int]) -> list[int]:
    out, at = [], run[0]
    for x in run[1:]:
        if x:
            out += range(at, x)
            at = x + w.size[x]
    return [*out, *range(at, run[0] + w.size[run[0]])]


def _text(w: Whole, run: tuple[int, int, int], mark: dict[int, str]) -> str:
    """The text of a piece with a mark where a bond was cut: it tells the piece from all others."""
    top, out = run[0], []
    at = w.start[top] if top else 0
    if top:
        out.append(mark[top])
    for x in run[1:]:
        if x:
            out += [w.text[at : w.start[x]], mark[x]]
            at = w.stop[x + w.size[x] - 1]
    out.append(w.text[at : w.stop[top + w.size[top] - 1]] if top else w.text[at:])
    return "".join(out)


def write(w: Whole, run: tuple[int, int, int], label: dict[int, str]) -> str:
    """As ``molecule.write`` of a piece; label gives the attachment point for the bond above an atom, in their order."""
    atoms, extra = _atoms(w, run), {}
    held = set(atoms)
    for x, t in label.items():
        for u in (w.parent[x], x):
            if u in held:
                extra.setdefault(u, []).append(t)
    if w.rings is None:
        return m.write(w.mol, atoms, extra, {w.up[x] for x in label})
    closures: dict[int, str] = {}
    number, parent, size, top = 0, w.parent, w.size, run[0]
    for u, v, sign in w.rings:
        if v in held:
            number += 1
            name = str(number) if number < 10 else f"%{number}"
            closures[v] = closures.get(v, "") + sign + name
            closures[u] = closures.get(u, "") + name
    final = {parent[u]: u for u in atoms[1:]}  # the last one that hangs there stands without parentheses
    out, ends, tokens = [], [], w.mol.atoms
    for u in atoms:
        while ends and ends[-1] <= u:
            out.append(")")
            ends.pop()
        if u != top:
            if final[parent[u]] != u:
                out.append("(")
                ends.append(u + size[u])
            out.append(w.before[u])
        out.append(tokens[u][0])
        if u in closures:
            out.append(closures[u])
        if u in extra:
            named = extra[u]
            for i, t in enumerate(named):
                out.append(t if u not in final and i == len(named) - 1 else f"({t})")
    out.append(")" * len(ends))
    return "".join(out)


def places(found: set[int]) -> int:
    """A fingerprint as one number."""
    out = 0
    for x in found:
        out |= 1 << x
    return out


def nearest(own: int, known: list[tuple[int, int]]) -> float:
    """The highest similarity of a fingerprint to any of those known, given with their counts."""
    n, best = own.bit_count(), 0.0
    for x, k in known:
        both = (own & x).bit_count()
        if n or k:
            best = max(best, both / (n + k - both))
    return best


def cut_off(w: Whole, text: str, part: m.Molecule, label: int) -> int | None:
    """The first single bond in no ring that leaves this part on one side, as the first of ``repair._cuts``."""
    n, wanted, mark = w.n, len(part.atoms) - 1, f"[*:{label}]"
    for v in w.low:
        b, below = w.up[v], w.size[v]
        if w.bonds[b][2] != 1.0:
            continue
        for run, size in (((0, v), n - below), ((v, 0), below)):
            if size == wanted and (_text(w, run, {v: mark}) == text or m.same(m.labelled(w.mol, _atoms(w, run), {b: label}), part)):
                return b
    return None


class Cutter:
    """``splitting.split_at`` for molecules as read, with the pieces seen so far."""

    def __init__(self, e3_refs: list[set[int]]):
        self.known = [(places(x), len(x)) for x in e3_refs]
        self.likeness: dict[str, float] = {}
        self.written: dict[str, str] = {}

    def _like(self, w: Whole, run: tuple[int, int, int], bond: int) -> float:
        text = _text(w, run, {bond: "\0"})
        got = self.likeness.get(text)
        if got is None:
            if len(self.likeness) > KEPT:
                self.likeness.clear()
            got = self.likeness[text] = nearest(places(m.bits(m.labelled(w.mol, _atoms(w, run), {}))), self.known)
        return got

    def _write(self, w: Whole, role: str, run: tuple[int, int, int], e3: int, poi: int) -> str:
        label = {e3: "[*:2]", poi: "[*:1]"}
        if role == "linker":  # seldom seen twice
            return write(w, run, label)
        text = _text(w, run, {e3: "\2", poi: "\1"})
        got = self.written.get(text)
        if got is None:
            if len(self.written) > KEPT:
                self.written.clear()
            got = self.written[text] = write(w, run, label)
        return got

    def __call__(self, w: Whole, low: tuple[int, int] | None) -> tuple[dict[str, str], tuple[int, int]] | None:
        """({e3, linker, poi}, atoms below the cuts) for two bonds to cut; None without them."""
        if low is None:
            return None
        e3, poi = low
        if self.known:
            runs = _runs(w, e3, poi)
            if self._like(w, runs["e3"], e3) < self._like(w, runs["poi"], poi):
                e3, poi = poi, e3
        e3, poi = off_carbonyls(w, e3, poi)
        runs = _runs(w, e3, poi)
        return {role: self._write(w, role, runs[role], e3, poi) for role in ("e3", "linker", "poi")}, (e3, poi)


def _hydrogens(w: Whole, u: int) -> int:
    token, element, _ = w.mol.atoms[u]
    if token.startswith("["):
        h = m._BRACKET.fullmatch(token)[4]
        return int(h[1:] or 1) if h else 0
    used = sum(w.bonds[b][2] for _, b in w.near[u])
    return max(0, int(next((v for v in m.VALENCES.get(element.capitalize(), (0,)) if v >= int(used)), 0) - used))


def off_carbonyls(w: Whole, e3: int, poi: int) -> tuple[int, int]:
    """As ``splitting.off_carbonyls``."""
    near, bonds, atoms = w.near, w.bonds, w.mol.atoms

    def carbonyl(u: int) -> bool:
        return atoms[u][1] == "C" and any(bonds[b][2] == 2.0 and atoms[v][1] == "O" and len(near[v]) == 1 for v, b in near[u]) and len(near[u]) + _hydrogens(w, u) == 3

    for partner, full in (("N", 3), ("O", 2)):

        def hetero(u: int, partner=partner, full=full) -> bool:
            return atoms[u][1] == partner and len(near[u]) + _hydrogens(w, u) == full

        new = [e3, poi]
        for role, k in (("poi", 1), ("e3", 0), ("linker", 0), ("linker", 1)):
            if new[0] == new[1]:
                break
            run, v = _runs(w, *new)[role], new[k]
            at = w.parent[v] if _holds(w, run, w.parent[v]) else v
            if atoms[at][1] not in ("C", partner):
                continue
            for x, b in sorted(near[at]):
                if b in w.free and bonds[b][2] == 1.0 and (hetero(at) and carbonyl(x) or carbonyl(at) and hetero(x)) and _holds(w, run, x):
                    new[k] = w.free[b]
                    break
        if new[0] != new[1]:
            e3, poi = new
    return e3, poi


class Trees:
    """A fitted forest (``learning.Forest``) over the bonds of many molecules: every split is asked once a bond, and its
    trees are then walked by the answers. Votes are summed tree by tree, so probabilities are the same."""

    def __init__(self, forest):
        self.labels, self.votes = forest.labels, forest.votes
        self.roots, leaf = forest.roots, forest.left == np.arange(len(forest.left))
        asked: dict[tuple, int] = {}
        self.ask = np.zeros(len(leaf), np.int64)
        for i in range(len(leaf)):
            if not leaf[i]:
                kind = tuple(np.flatnonzero(forest.goes_left[i]).tolist()) if forest.categorical[i] else None
                self.ask[i] = asked.setdefault((int(forest.feature[i]), None if kind is not None else float(forest.threshold[i]), kind), len(asked))
        self.asked, self.most = list(asked), forest.goes_left.shape[1] - 1
        self.next = np.stack([forest.right, forest.left])

    def __call__(self, rows: list[tuple], prints: list[int]) -> np.ndarray:
        return np.concatenate([self._judge(rows[i : i + JUDGED], prints[i : i + JUDGED]) for i in range(0, len(rows), JUDGED)])

    def _judge(self, rows: list[tuple], prints: list[int]) -> np.ndarray:
        n = len(rows)
        columns = list(zip(*rows, strict=True))
        kinds = [[held.get(e, float(len(held))) for e in c] for c, held in zip(columns[13:], self.labels, strict=True)]
        x = np.empty((15 + cut.PLACES, n))
        for i, c in enumerate([*columns[:13], *kinds]):
            x[i] = c
        x[15:] = np.unpackbits(np.array(prints, np.uint64).view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
        said = np.empty((max(1, len(self.asked)), n), np.uint8)
        for i, (f, threshold, kind) in enumerate(self.asked):
            said[i] = x[f] <= threshold if kind is None else np.isin(np.clip(x[f], 0, self.most).astype(int), kind)
        flat, votes, rows_ = said.ravel(), np.zeros((n, 2)), np.arange(n)
        for root in self.roots.tolist():
            at = np.full(n, root)
            while True:
                new = self.next[flat[self.ask[at] * n + rows_], at]
                if (new == at).all():
                    break
                at = new
            votes += self.votes[at]
        return votes[:, 1] / (votes[:, 0] + votes[:, 1])


def likeliest(wholes: list[Whole], scores: list[list[float]], trees: Trees) -> list[tuple[int, int] | None]:
    """For each molecule the atoms below the two bonds most likely to be cut, the smaller bond on ties; None for fewer."""
    rows, prints, counts = [], [], []
    for w, score in zip(wholes, scores, strict=True):
        r, p = features(w, score)
        rows += r
        prints += p
        counts.append(len(r))
    if not rows:
        return [None] * len(wholes)
    proba, at, out = trees(rows, prints), 0, []
    for w, n in zip(wholes, counts, strict=True):
        order = np.argsort(-proba[at : at + n], kind="stable")[:2].tolist()
        out.append((w.low[order[0]], w.low[order[1]]) if n >= 2 else None)
        at += n
    return out
