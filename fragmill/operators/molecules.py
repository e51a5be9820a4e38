"""Row operators on molecules: per-molecule graph algorithms in Arrow batches, everything around them in expressions.

Each is one pass over only the columns it needs, spread over all tasks. Strings that cannot be read give nulls.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.chem import describe, splitting
from fragmill.chem import molecule as m


def _map(df: DataFrame, key: str, inputs: list[str], fields: str, make, hashable: bool = True, rows: int | None = None) -> DataFrame:
    """(key, fields): make(*inputs) gives a dict a row. Inputs are strings, numbers or arrays, which repeat; with
    ``hashable`` false also structs. With ``rows`` no result is kept and so many are in memory at once, for large ones."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, {fields}"
    names = [f.split()[0] for f in fields.split(", ")]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[tuple, dict] = {}  # molecules repeat
        for batch in (b.slice(i, rows or b.num_rows) for b in batches for i in range(0, b.num_rows, rows or max(1, b.num_rows))):
            columns = [batch.column(i + 1).to_pylist() for i in range(len(inputs))]
            out = []
            for args in zip(*([tuple(x) if isinstance(x, list) else x for x in c] for c in columns), strict=True):
                if rows or not hashable:
                    out.append(make(*args))
                    continue
                if args not in memory:
                    if len(memory) > 20_000:
                        memory.clear()
                    memory[args] = make(*args)
                out.append(memory[args])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r.get(n) for r in out], arrow.field(i + 1).type) for i, n in enumerate(names)]], schema=arrow)

    return spread(df.select(key, *inputs)).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, rows: int, most: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most so many rows whose texts hold at most ``most`` bytes; a longer row stands alone."""
    size = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns[1:]:
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, ends[at] - size[at] + most, side="right"))
        to = max(at + 1, min(to, at + rows))
        yield batch.slice(at, to - at)
        at = to


def map_many(df: DataFrame, key: str, inputs: list[str], fields: str, begin, rows: int = 256) -> DataFrame:
    """(key, fields): begin(), called once a task, gives a function that takes so many rows at once (fewer where texts are
    long), each a tuple of the inputs, and gives a dict for each."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, {fields}"
    names = [f.split()[0] for f in fields.split(", ")]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = begin()
        for batch in (s for b in batches for s in slices(b, rows)):
            out = make(list(zip(*(batch.column(i + 1).to_pylist() for i in range(len(inputs))), strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r.get(n) for r in out], arrow.field(i + 1).type) for i, n in enumerate(names)]], schema=arrow)

    return spread(df.select(key, *inputs)).mapInArrow(run, schema)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many tasks as there are cores: a molecule costs milliseconds to treat and microseconds to move.
    What is large enough to be read in that many tasks stays where it is."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    task = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df if size >= cores * task else df.repartition(cores)


def heuristic_split(df: DataFrame, key: str, text: str, e3_refs: list[str], threshold: float = 0.4, use_capacity: bool = False) -> DataFrame:
    """(key, e3, linker, poi): a molecule cut in three by betweenness; e3_refs are known E3 ligands."""
    held = df.sparkSession.sparkContext.broadcast([m.bits(x) for x in map(m.parse, e3_refs) if x])
    return _map(df, key, [text], "e3 string, linker string, poi string", lambda t: splitting.split(t, held.value, threshold, use_capacity))


def reassembly(df: DataFrame, key: str, prediction: str, whole: str) -> DataFrame:
    """(key, reassembles): whether the labelled parts join to the whole molecule; false for what cannot be read."""
    return _map(df, key, [prediction, whole], "reassembles boolean", lambda p, w: {"reassembles": m.reassembles(p, w)})


def descriptors(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, mw, atoms, rings, bridges, chain): weight, heavy atoms, independent rings, bonds in no ring, longest chain
    off an attachment point."""

    def make(t):
        mol = m.parse(t)
        if mol is None:
            return {}
        real = [a for a in mol.atoms if a[1] not in ("*", "H")]
        return {"mw": round(m.weight(mol), 3), "atoms": len(real), "rings": len(mol.bonds) - len(mol.atoms) + len(m.pieces(mol, set())), "bridges": len(m.bridges(mol)), "chain": m.chain_length(mol)}

    return _map(df, key, [text], "mw double, atoms int, rings int, bridges int, chain int", make)


EDGE = "bond int, atom_u string, atom_v string, order double, degree_u int, degree_v int, degree2_u int, degree2_v int, degree3_u int, degree3_v int, betweenness_u double, betweenness_v double, smaller_side int, num_nodes int, num_edges int, ring_bonds int, fp array<double>"


def edge_features(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row a bridge of each molecule, with its features."""
    rows = _map(df, key, [text], f"edges array<struct<{EDGE.replace(' ', ':').replace(',:', ',')}>>", lambda t: {"edges": splitting.edge_features(t)}, rows=64)
    return rows.select(key, F.inline("edges"))


def metrics(df: DataFrame, key: str, whole: str, prediction: str) -> DataFrame:
    """(key, whole_*, e3_*, linker_*, poi_*): descriptors of the whole molecule and of each part of a split, and of the
    linker's backbone. Null where a part is missing or cannot be read."""
    of = {"whole": False, "e3": True, "linker": True, "poi": True}
    fields = ", ".join([f"{scope}_{f}" for scope in of for f in describe.FIELDS.split(", ")] + [f"linker_{f}" for f in describe.BACKBONE.split(", ")])

    def make(w: str | None, p: str | None) -> dict:
        text = {"whole": w, **m.roles(p)}
        out = {f"{scope}_{k}": v for scope, part in of.items() for k, v in describe.describe(text[scope], part).items()}
        return out | {f"linker_{k}": v for k, v in describe.backbone(text["linker"]).items()}

    return _map(df, key, [whole, prediction], fields, make)


def scans(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, alert_hits, leaving_group_hits, unstable, leaving_group) of each molecule."""
    return _map(df, key, [text], "alert_hits array<string>, leaving_group_hits array<string>, unstable boolean, leaving_group boolean", describe.scan)


def canonical(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, canonical): one string for all ways to write a molecule; null where it cannot be read."""
    return _map(df, key, [text], "canonical string", lambda t: {"canonical": m.canonical(g) if (g := m.parse(t)) else None})


def rewritten(df: DataFrame, key: str, texts: list[str], repeat: int, percent: int, seed: int = 42) -> DataFrame:
    """(key, copy, texts): for about ``percent`` of the rows ``repeat`` random rewritings of each text, else the row once as
    it is. What cannot be read comes out as null. Parts between dots keep their places."""

    def make(*values):
        h = int.from_bytes(blake2b("|".join(map(str, values)).encode(), digest_size=8).digest(), "little")
        many = h % 100 < percent
        def one(t: str | None, k: int) -> str | None:
            parts = [m.parse(x) for x in t.split(".")] if t else [None]
            return ".".join(m.randomised(g, h + seed + k) for g in parts) if all(parts) else None
        return {"copies": [{c: one(t, k) if many else t for c, t in zip(texts, values, strict=True)} for k in range(repeat if many else 1)]}

    rows = _map(df, key, texts, "copies array<struct<" + ",".join(f"{c}:string" for c in texts) + ">>", make)
    return rows.select(key, F.posexplode("copies").alias("copy", "c")).select(key, "copy", "c.*")


def edit_distance(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, distance, norm): greedy graph edit distance and its share of both sizes; null if either cannot be read."""

    def make(x, y):
        p, q = m.parse(x), m.parse(y)
        if p is None or q is None:
            return {}
        d = m.edit_distance(p, q)
        return {"distance": d, "norm": d / (len(p.atoms) + len(q.atoms))}

    return _map(df, key, [a, b], "distance int, norm double", make)


def bond_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bond, u, v, order): the bonds of each molecule as an edge table."""

    def make(t):
        mol = m.parse(t)
        return {"bonds": [{"bond": i, "u": u, "v": v, "order": o} for i, (u, v, o) in enumerate(mol.bonds)] if mol else []}

    rows = _map(df, key, [text], "bonds array<struct<bond:int,u:int,v:int,order:double>>", make)
    return rows.select(key, F.inline("bonds"))
