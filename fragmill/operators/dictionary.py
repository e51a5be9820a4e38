"""Dictionaries of known fragments: lookups, upserts, similarity to references, growth to a fixpoint."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.plans.lineage import Scratch


def lookup_first(df: DataFrame, table: DataFrame, key: str, order: str) -> DataFrame:
    """Left join with the table's first row of each key by ``order``; nulls where there is none."""
    others = [c for c in table.columns if c != key]
    first = table.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("_f")).select(key, *[F.col("_f")[c].alias(c) for c in others])
    return df.join(first, key, "left")


def keep_first(parts: list[DataFrame], key: str, order: str) -> DataFrame:
    """Union in which the earliest part's row of each key stays (within a part, the first by ``order``)."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    whole = tagged[0]
    for p in tagged[1:]:
        whole = whole.unionByName(p)
    others = [c for c in whole.columns if c not in (key, "_part")]
    return whole.groupBy(key).agg(F.min_by(F.struct(*others), F.struct("_part", order)).alias("_f")).select(key, *[F.col("_f")[c].alias(c) for c in others])


def upsert(known: DataFrame, new: DataFrame, key: str = "smiles") -> DataFrame:
    """known plus the new keys it lacks, each once; existing rows win; null and blank keys are dropped.

    Rows carry (key, id, origin); new ones get the content hash of their key as id and origin 'new'.
    """
    fresh = new.select(key).filter(F.col(key).isNotNull() & (F.trim(key) != "")).distinct().join(known.select(key), key, "left_anti")
    return known.select(key, "id", "origin").union(fresh.select(key, F.sha2(key, 256).alias("id"), F.lit("new").alias("origin")))


def contained(df: DataFrame, key: str, text: str, patterns: DataFrame, pattern_id: str, pattern: str, most: int = 1_000_000) -> DataFrame:
    """(key, pattern_id) for each pattern that occurs in the text: one pass of an automaton of all patterns over each text.

    The patterns go to all tasks, ``most`` of them at a time; more are searched in further passes. Null and empty
    patterns occur nowhere.
    """
    import ahocorasick  # noqa: F401

    usable = patterns.select(F.col(pattern_id).cast("string").alias("i"), F.col(pattern).alias("p")).filter("i is not null and p <> ''")
    blocks = max(1, -(-usable.count() // most))
    schema = df.select(F.col(key), F.lit("").alias(pattern_id)).schema
    result, scratch = None, Scratch(df.sparkSession) if blocks > 1 else None
    for b in range(blocks):
        block = usable.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b) if blocks > 1 else usable
        held = df.sparkSession.sparkContext.broadcast([tuple(r) for r in block.collect()])
        found = df.select(key, text).mapInArrow(lambda it, held=held: _search(it, held.value), schema)
        if scratch:  # one block at a time: its hits are written before the next is collected
            found = scratch.keep(found)
            held.destroy()
        result = found if result is None else result.union(found)
    return result


def _search(batches: Iterator[pa.RecordBatch], patterns: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    import ahocorasick

    automaton = ahocorasick.Automaton()
    by: dict[str, list[str]] = {}
    for i, p in patterns:
        by.setdefault(p, []).append(i)
    for p, ids in by.items():
        automaton.add_word(p, ids)
    if by:
        automaton.make_automaton()
    for batch in batches:
        at, out = [], []
        for n, text in enumerate(batch.column(1).to_pylist() if by else ()):
            hits = {i for _, ids in automaton.iter(text) for i in ids} if text else ()
            at += [n] * len(hits)
            out += sorted(hits)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(out, pa.string())], names=[batch.schema.names[0], "found"])


def _trigrams(s: str) -> set[str]:
    return {s[i : i + 3] for i in range(len(s) - 2)}


def _nearest(batches: Iterator[pa.RecordBatch], refs: list[tuple[str, str, str]]) -> Iterator[pa.RecordBatch]:
    """The best of each class for each text: what it shares with all references from lists of who holds a substring."""
    import numpy as np

    classes = sorted({c for _, c, _ in refs})
    holders: dict[str, list[int]] = {}
    for i, (_, _, s) in enumerate(refs):
        for g in _trigrams(s):
            holders.setdefault(g, []).append(i)
    held = {g: np.array(x, np.int32) for g, x in holders.items()}
    sizes = np.array([len(_trigrams(s)) for _, _, s in refs], np.int64)
    of = {c: np.array([i for i, r in enumerate(refs) if r[1] == c]) for c in classes}
    for batch in batches:
        best: dict[str, list[tuple[int, float]]] = {c: [] for c in classes}
        for t in batch.column(1).to_pylist():
            own = _trigrams(t or "")
            found = [held[g] for g in own if g in held]
            both = np.bincount(np.concatenate(found), minlength=len(refs)) if found else np.zeros(len(refs), np.int64)
            s = both / np.maximum(len(own) + sizes - both, 1)
            for c in classes:
                at = of[c][s[of[c]].argmax()]
                best[c].append((at, float(s[at])))
        for c in classes:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c] * batch.num_rows), pa.array([refs[i][0] for i, _ in best[c]], pa.string()), pa.array([x for _, x in best[c]], pa.float64())], names=["key", "cls", "ref", "similarity"])


def nearest_reference(df: DataFrame, key: str, text: str, refs: DataFrame, ref_id: str, ref_class: str, ref_text: str, most: int = 100_000) -> DataFrame:
    """(key, cls, ref, similarity): of each class the reference most similar to the text, by sets of 3-character
    substrings; the first by id on ties. Null and short texts have similarity 0.

    References are a small fixed table; more than ``most`` are refused.
    """
    held = refs.select(F.col(ref_id).cast("string"), F.col(ref_class).cast("string"), F.coalesce(F.col(ref_text), F.lit(""))).orderBy(ref_id).limit(most + 1).collect()
    if len(held) > most:
        raise ValueError(f"more than {most} references")
    sent = df.sparkSession.sparkContext.broadcast([tuple(r) for r in held])
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(lambda it: _nearest(it, sent.value), f"key {kind}, cls string, ref string, similarity double")


def grow(pairs: DataFrame, seeds: DataFrame, most_steps: int = 50) -> DataFrame:
    """(item, step): items reached from the seeds through pairs (a, b), with the step at which each was; 0 for seeds in a pair.

    Each step joins only the items of the step before and its result is written, so that lineage does not grow. Ends
    when a step finds nothing; RuntimeError if one after ``most_steps`` still finds items.
    """
    scratch = Scratch(pairs.sparkSession)
    both = pairs.select("a", "b").dropna().distinct()
    both = scratch.keep(both.union(both.select("b", "a")).distinct().toDF("a", "b"))
    last = scratch.keep(seeds.toDF("item").join(both.select(F.col("a").alias("item")).distinct(), "item", "left_semi").distinct().withColumn("step", F.lit(0)))
    known = last
    for step in range(1, most_steps + 2):
        met = both.join(last.select(F.col("item").alias("a")), "a", "left_semi").select(F.col("b").alias("item")).distinct()
        last = scratch.keep(met.join(known, "item", "left_anti").withColumn("step", F.lit(step)))
        if last.isEmpty():
            return known
        known = known.union(last)  # each step's items are written once and read together
    raise RuntimeError(f"items were still found after {most_steps} steps")


def cross_dissimilar(df: DataFrame, key: str, text: str, is_second: str, threshold: float) -> DataFrame:
    """(key, is_second): the rows of the first class not more similar than ``threshold`` to any of the second, and those of
    the second not more similar to any that is left of the first, by 3-character substrings. Each class is bounded as
    references are."""
    def apart(rows: DataFrame, others: DataFrame) -> DataFrame:
        near = nearest_reference(rows, key, text, others.withColumn("_all", F.lit("all")), key, "_all", text)
        return rows.join(near.filter(F.col("similarity") > threshold).select(F.col("key").alias(key)), key, "left_anti")

    one, two = df.filter(~F.col(is_second)), df.filter(is_second)
    first = apart(one, two)
    return first.union(apart(two, first)).select(key, is_second)


def first_passing(candidates: DataFrame, key: str, size: str, order: str) -> DataFrame:
    """(key, first, tried): of each key's candidates the one whose size is nearest to their median, the smaller size and
    then ``order`` on ties."""
    middle = candidates.groupBy(key).agg(F.median(size).alias("mid"), F.count(F.lit(1)).alias("tried"))
    place = F.struct(F.abs(F.col(size) - F.col("mid")).alias("far"), F.col(size), F.col(order))
    return candidates.join(middle, key).groupBy(key).agg(F.min_by(order, place).alias("first"), F.first("tried").alias("tried"))
