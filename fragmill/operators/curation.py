"""Splitting molecules by dictionaries of known parts, and growing the dictionaries until nothing new is found.

A known ligand is found where one side of a bond is the ligand: sides and dictionary meet in an equi-join on keys, so
neither all ligands are tried on a molecule nor the dictionary sent to all tasks. What is between two found ligands is the
linker; with one ligand and a known linker what lies beyond is the other ligand.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragmill.chem import molecule as m
from fragmill.chem import patterns, sides, splitting
from fragmill.operators.molecules import _map
from fragmill.plans.lineage import Scratch

#: The share of the whole's atoms above which a part is too large, and the similarity above which a linker
#: is too like a ligand or a part too like the whole; of a new target ligand to a known E3 ligand; steps of growth.
TOO_LARGE, TOO_SIMILAR, FOREIGN, MOST_STEPS = 0.7, 0.65, 0.5, 50


def keyed(dictionary: DataFrame) -> DataFrame:
    """(role, ligand, piece, n): the readable entries of a dictionary (role, ligand) with their keys, each once."""
    rows = dictionary.select("role", "ligand").dropna().distinct()
    keys = _map(rows.select("ligand").distinct(), "ligand", ["ligand"], "piece long, n int", lambda t: dict(zip(("piece", "n"), sides.key_of(t) or (None, None), strict=True)))
    return rows.join(keys.filter("piece is not null"), "ligand").select("role", "ligand", "piece", "n")


def found(df: DataFrame, key: str, text: str, entries: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, role, bond, side, ligand, n): where entries of a keyed dictionary are one side of a bond."""
    def make(t: str | None) -> dict:
        mol = m.parse(t)
        return {"s": [{"bond": b, "side": s, "piece": v & sides._MASK, "n": n} for b, s, v, n in sides.sides(mol)] if mol else []}

    each = _map(df, key, [text], "s array<struct<bond:int,side:int,piece:bigint,n:int>>", make).select(key, F.inline("s"))
    hits = each.join(entries.filter("role <> 'linker'"), ["piece", "n"]).select(key, "role", "bond", "side", "ligand", "n")
    asked = scratch.keep(hits.groupBy(key).agg(F.collect_list(F.struct("role", "bond", "side", "ligand", "n")).alias("_hits")).join(df.select(key, text), key))

    def check(t: str, hits: list[dict]) -> dict:
        mol, known, atoms = m.parse(t), {}, {}
        for h in hits:
            at, ask = (h["bond"], h["side"]), (h["bond"], h["side"], h["ligand"])
            if ask not in known:
                if at not in atoms:
                    atoms[at] = sides.atoms_of(mol, *at)
                known[ask] = sides.same_piece(mol, atoms[at], h["ligand"])
        return {"hits": [h for h in hits if known[h["bond"], h["side"], h["ligand"]]]}

    return _map(asked, key, [text, "_hits"], "hits array<struct<role:string,bond:int,side:int,ligand:string,n:int>>", check, hashable=False, rows=256).select(key, F.inline("hits"))


def _ordered(hits: DataFrame, key: str) -> DataFrame:
    """Hits with their place ``at``: of each molecule and role those nearest to the median size first."""
    middle = hits.groupBy(key, "role").agg(F.median("n").alias("mid"))
    w = Window.partitionBy(key, "role").orderBy(F.abs(F.col("n") - F.col("mid")), "n", "ligand", "bond", "side")
    return hits.join(middle, [key, "role"]).withColumn("at", F.row_number().over(w)).drop("mid")


def check_sizes(whole: m.Molecule, parts: dict[str, m.Molecule], most: float = TOO_LARGE) -> bool:
    """Whether no part has more than this share of the whole's atoms, attachment points counted."""
    return all(len(p.atoms) <= most * len(whole.atoms) for p in parts.values())


def check_linker(linker: m.Molecule, ligands: list[m.Molecule], most: float = TOO_SIMILAR) -> bool:
    """Whether the linker is not too similar to any ligand."""
    own = m.bits(linker)
    return all(m.tanimoto(own, m.bits(x)) <= most for x in ligands)


def check_whole(whole: m.Molecule, parts: dict[str, m.Molecule], most: float = TOO_SIMILAR) -> bool:
    """Whether no part is too similar to the whole."""
    own = m.bits(whole)
    return all(m.tanimoto(own, m.bits(x)) <= most for x in parts.values())


def _cut_out(mol: m.Molecule, e3: tuple[int, int], poi: tuple[int, int]) -> bool | None:
    """Whether what two (bond, side) cut out passes the checks; None if they overlap or leave no middle."""
    one, two = set(sides.atoms_of(mol, *e3)), set(sides.atoms_of(mol, *poi))
    cut = (e3[0], poi[0])
    parts = splitting._parted(mol, cut) if cut[0] != cut[1] and not one & two else None
    if parts is None or set(parts["e3"]) != one or set(parts["poi"]) != two:
        return None
    graphs = {r: m.parse(t) for r, t in splitting.strings(mol, cut).items()}
    return check_linker(graphs["linker"], [graphs["e3"], graphs["poi"]]) and (check_sizes(mol, graphs) or check_whole(mol, graphs))


def first_cut(mol: m.Molecule, ways: Iterable[tuple[tuple[int, int], tuple[int, int]]]) -> dict:
    """{e3, linker, poi, passed} of the first of some ways, each (bond, side) of both ligands, that passes the checks, else
    of the last that leaves three parts; nothing if none does. Ways beyond the first that passes are not tried."""
    last, passed = None, False
    for e3, poi in ways:
        got = _cut_out(mol, e3, poi)
        if got is not None:
            last, passed = (e3[0], poi[0]), got
        if got:
            break
    return {**splitting.strings(mol, splitting.off_carbonyls(mol, last)), "passed": passed} if last else {}


def cut_out(text: str, e3: tuple[int, int], poi: tuple[int, int]) -> dict:
    """{e3, linker, poi, passed} for two (bond, side): nothing if they overlap or leave no middle."""
    return first_cut(m.parse(text), [(e3, poi)])


_PARTS = "e3 string, linker string, poi string, passed boolean"


def by_ligands(df: DataFrame, key: str, text: str, hits: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, e3, linker, poi, passed): molecules in which an E3 ligand and a target ligand are found."""
    each = lambda role: F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("at", "bond", "side"))))
    both = _ordered(hits, key).groupBy(key).agg(each("e3").alias("e"), each("poi").alias("p")).filter((F.size("e") > 0) & (F.size("p") > 0))
    asked = scratch.keep(both.join(df.select(key, text), key))

    def make(t: str, e: list[dict], p: list[dict]) -> dict:
        at = lambda h: (h["bond"], h["side"])
        return first_cut(m.parse(t), ((at(x), at(y)) for y in p for x in e if x["bond"] != y["bond"]))

    return _map(asked, key, [text, "e", "p"], _PARTS, make, hashable=False, rows=256).filter("e3 is not null")


def by_linker(df: DataFrame, key: str, text: str, hits: DataFrame, entries: DataFrame, role: str, scratch: Scratch) -> DataFrame:
    """(key, e3, linker, poi, passed): molecules in which a ligand of one role is found and beyond it a known linker."""
    own = _ordered(hits.filter(F.col("role") == role), key).groupBy(key).agg(F.collect_list(F.struct("at", "bond", "side")).alias("_hits"))
    asked = scratch.keep(own.join(df.select(key, text), key))

    def make(t: str, hits: list[dict]) -> dict:
        mol = m.parse(t)
        return {"s": [{**h, "far": b, "far_side": s, "piece": v, "n": n} for h in hits for b, s, v, n in sides.middles(mol, h["bond"], h["side"])]}

    each = _map(asked, key, [text, "_hits"], "s array<struct<at:int,bond:int,side:int,far:int,far_side:int,piece:bigint,n:int>>", make, hashable=False, rows=256).select(key, F.inline("s"))
    met = each.join(entries.filter("role = 'linker'"), ["piece", "n"])
    # Large linkers first.
    ways = met.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", (-F.col("n")).alias("less"), "bond", "side", "far", "far_side", "ligand"))).alias("_ways"))
    ways = scratch.keep(ways.join(df.select(key, text), key))

    def cut(t: str, ways: list[dict]) -> dict:
        mol, seen = m.parse(t), set()

        def good():
            for w in ways:
                near, far = (w["bond"], w["side"]), (w["far"], w["far_side"])
                if (near, far) in seen:
                    continue
                ends = set(sides.atoms_of(mol, *near)) | set(sides.atoms_of(mol, *far))
                if sides.same_piece(mol, [u for u in range(len(mol.atoms)) if u not in ends], w["ligand"]):
                    seen.add((near, far))
                    yield (near, far) if role == "e3" else (far, near)

        return first_cut(mol, good())

    return _map(ways, key, [text, "_ways"], _PARTS, cut, hashable=False, rows=256).filter("e3 is not null")


def _first_of(parts: list[DataFrame], key: str) -> DataFrame:
    tagged = [p.withColumns({"matched": F.lit(n), "_i": F.lit(i)}) for i, (n, p) in enumerate(parts)]
    whole = tagged[0]
    for p in tagged[1:]:
        whole = whole.unionByName(p)
    best = F.min_by(F.struct("e3", "linker", "poi", "matched", "passed"), F.struct((~F.col("passed")).cast("int").alias("f"), F.col("_i")))
    return whole.groupBy(key).agg(best.alias("b")).select(key, "b.*")


def split_known(df: DataFrame, key: str, text: str, dictionary: DataFrame, with_linkers: bool = True) -> DataFrame:
    """(key, e3, linker, poi, matched, passed) of the molecules that a dictionary (role: e3, poi, linker; ligand) splits:
    by both ligands, else by one ligand and a linker; of several ways the first that passes the checks, else one that
    does not. Molecules nothing is found in, null ones and such as cannot be read are left out; keys are unique."""
    scratch = Scratch(df.sparkSession)
    df = scratch.keep(df.select(key, text).filter(F.col(text).isNotNull()))
    entries = scratch.keep(keyed(dictionary))
    return _split_found(df, key, text, scratch.keep(found(df, key, text, entries, scratch)), entries, with_linkers, scratch)


def _split_found(df: DataFrame, key: str, text: str, hits: DataFrame, entries: DataFrame, with_linkers: bool, scratch: Scratch) -> DataFrame:
    """As split_known, of what is already found. A way that passes stands, so linkers are looked for only where none has."""
    parts = [("e3, poi", scratch.keep(by_ligands(df, key, text, hits, scratch)))]
    for role in ("e3", "poi") if with_linkers else ():
        done = parts[-1][1].filter("passed").select(key)
        df, hits = scratch.keep(df.join(done, key, "left_anti")), scratch.keep(hits.join(done, key, "left_anti"))
        parts.append((f"{role}, linker", scratch.keep(by_linker(df, key, text, hits, entries, role, scratch))))
    return _first_of(parts, key)


def foreign(new: DataFrame, known: DataFrame, text: str = "ligand", most: float = FOREIGN, limit: int = 10_000) -> DataFrame:
    """The rows of ``new`` whose molecule is less similar than ``most`` to every known one: a similarity anti-join. The
    known ones go to all tasks; more than ``limit`` are refused."""
    rows = known.select(text).dropna().distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} known molecules")
    held = new.sparkSession.sparkContext.broadcast([m.bits(g) for r in rows if (g := m.parse(r[0]))])
    near = _map(new.select(text).distinct(), text, [text], "near double", lambda t: {"near": max((m.tanimoto(m.bits(g), r) for r in held.value), default=0.0) if (g := m.parse(t)) else None})
    return new.join(near.filter(F.col("near") < most).select(text), text, "left_semi")


def curate(df: DataFrame, key: str, text: str, dictionary: DataFrame, most_steps: int = MOST_STEPS) -> tuple[DataFrame, DataFrame]:
    """(splits, dictionary) at the fixpoint: each step splits what is left, first by ligands only, then with linkers when
    that finds nothing; the parts found join the dictionary, unless they stand in it for the other ligand's role.

    splits: (key, e3, linker, poi, matched, step) of those that passed the checks. RuntimeError if the last of
    ``most_steps`` still found some.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    left = scratch.keep(df.select(key, text).dropna())
    known = scratch.keep(dictionary.select("role", "ligand").dropna().distinct())
    done, fresh, hits, entries = None, known, None, None
    for step in range(most_steps + 1):
        more = scratch.keep(keyed(fresh))  # what earlier entries are found in does not change: only new ones are looked for
        hit = found(left, key, text, more, scratch)
        hits, entries = scratch.keep(hits.join(left.select(key), key, "left_semi").unionByName(hit) if hits is not None else hit), scratch.keep(entries.unionByName(more) if entries is not None else more)
        for with_linkers in (False, True):
            new = scratch.keep(_split_found(left, key, text, hits, entries, with_linkers, scratch).filter("passed").drop("passed").withColumn("step", F.lit(step)))
            if not new.isEmpty():
                break
        else:
            empty = spark.createDataFrame([], new.schema)
            return (done if done is not None else empty), known
        done = scratch.keep(done.unionByName(new)) if done is not None else new
        left = scratch.keep(left.join(new.select(key), key, "left_anti"))
        bare = lambda c: F.regexp_replace(c, r"\(\[\*:\d\]\)|\[\*:\d\]", "")
        parts = new.select(F.inline(F.array(*[F.struct(F.lit(r).alias("role"), bare(F.col(r)).alias("ligand")) for r in ("e3", "linker", "poi")]))).distinct()
        other = known.filter("role <> 'linker'").select(F.when(F.col("role") == "e3", "poi").otherwise("e3").alias("role"), "ligand")
        fresh = scratch.keep(parts.join(other, ["role", "ligand"], "left_anti").join(known, ["role", "ligand"], "left_anti").select("role", "ligand"))
        known = scratch.keep(known.union(fresh))
    raise RuntimeError(f"molecules were still split after {most_steps} steps")


def containing(df: DataFrame, key: str, text: str, parts: DataFrame, part_id: str, part: str, most: int = 10_000, steps: int = 200_000) -> DataFrame:
    """(key, part_id) for each part that occurs in the molecule as a substructure, attachment points standing for any atom.

    Parts are screened by counts of atoms, bonds and pairs of bonds, which a molecule that holds one must reach, before
    any search; they go to all tasks, and more than ``most`` are refused. A search of more than ``steps`` counts as none.
    """
    rows = parts.select(F.col(part_id).cast("string"), part).dropna().orderBy(part_id).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} parts")
    held = df.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])
    ready: list = []

    def make(t: str | None) -> dict:
        import numpy as np

        if not ready:
            graphs = [(i, g) for i, s in held.value if (g := m.parse(s)) and len(m.pieces(g, set())) == 1]
            ready.append((graphs, np.array([patterns.counts(g) for _, g in graphs]).reshape(len(graphs), -1), [patterns.of_molecule(g) for _, g in graphs]))
        graphs, counts, found = ready[0]
        mol = m.parse(t)
        if mol is None or not graphs:
            return {"hits": []}
        w = patterns.view(mol)
        may = np.flatnonzero((counts <= np.array(patterns.counts(mol))).all(axis=1))
        return {"hits": [graphs[i][0] for i in may if patterns.occurs(w, found[i], steps)]}

    return _map(df, key, [text], "hits array<string>", make).select(key, F.explode("hits").alias(part_id))
