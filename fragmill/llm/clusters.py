"""Groups of mutually similar records.

``linked`` gives the groups that chains of similar records form, exactly. A cluster feature tree alone cannot give them
(its leaves are balls of a bounded number, not chains), so most links come from minhash bands and the leaves find the rest:

1. few bands; each record is checked against the smallest record it shares a band with, which joins most of a group;
2. more bands, now one entry for each band value and group; groups that meet in a band value are checked against each
   other through a member that holds it, and joined;
3. what bands miss: the values of each group are put into leaves of like ones, each with a mergeable summary (what all
   of them hold, what any holds, sizes). From two summaries follows how far apart any two of their values are at least.
   Only leaves of different groups that this bound does not tell apart have their values compared.

Of equal values only one goes through these steps, and the others take its group. Links are verified on whole records
and joined by Hash-to-Min; no pairs within a group are verified. The first two steps follow the number of records. The
third compares leaves, of which there are about as many as groups, in blocks: its cost is one product of 2,048 places a
pair of leaves, so it grows with the square of the number of groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragmill.functions.text import fold
from fragmill.llm import grams
from fragmill.llm.components import hash_to_min
from fragmill.plans.lineage import Scratch
from fragmill.sources.tables import require


def bands_of(n_hashes: int, rows: int, n_bands: int, seed: int = 3) -> list[list[int]]:
    """n_bands bands of ``rows`` hashes: disjoint cuts of one permutation after another."""
    rng, out = np.random.default_rng(seed), []
    while len(out) < n_bands:
        order = rng.permutation(n_hashes)
        out += [sorted(order[i : i + rows].tolist()) for i in range(0, n_hashes - rows + 1, rows)]
    return out[:n_bands]


def _renumbered(bands: list[list[int]]) -> tuple[int, list[list[int]]]:
    """(number of hashes that the bands use, the bands by these alone)."""
    place = {c: i for i, c in enumerate(sorted({c for b in bands for c in b}))}
    return len(place), [[place[c] for c in b] for b in bands]


def _banded(batches: Iterator[pa.RecordBatch], n_hashes: int, bands: list[list[int]], sketched: bool) -> Iterator[pa.RecordBatch]:
    """Of (space, group, id, value): (key, group, id) of each band, the smallest id of a batch's group only; with sketched,
    also the two words of that record's sketch."""
    signer = grams.Signer(n_hashes)
    for whole in batches:
        for k in range(0, whole.num_rows, 2000):
            batch = whole.slice(k, 2000)
            space, group, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            codes, starts = grams.flatten([[v] for v in batch.column(3).to_pylist()])
            held = np.flatnonzero(np.diff(starts))
            if not held.size:
                continue
            signed = signer.sign(codes, starts)[held]
            keys = grams.band_keys(signed, bands, space[held])
            g, i = np.repeat(group[held], keys.shape[1]), np.repeat(ids[held], keys.shape[1])
            row = np.repeat(np.arange(held.size), keys.shape[1])
            keys = keys.ravel()
            order = np.lexsort((i, g, keys))
            first = np.ones(order.size, bool)
            first[1:] = (keys[order][1:] != keys[order][:-1]) | (g[order][1:] != g[order][:-1])
            at = order[first]
            columns = [pa.array(keys[at]), pa.array(g[at]), pa.array(i[at])]
            names = ["key", "grp", "id"]
            if sketched:
                s = grams.sketch(signed)[row[at]]
                columns += [pa.array(s[:, 0].copy()), pa.array(s[:, 1].copy())]
                names += ["s0", "s1"]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _checked(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Of (a, b, value_a, value_b): (a, b) that are similar enough."""
    for batch in batches:
        same = grams.pair_similarities(batch.column(2).to_pylist(), batch.column(3).to_pylist(), False) >= threshold
        rows = batch.take(pa.array(np.flatnonzero(same), pa.int64()))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1)], names=["a", "b"])


#: Places that substrings are hashed to in the summaries of leaves.
PLACES = 2048


def _hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of 0 and 1 over the places of each text's substrings, numbers of different substrings)."""
    codes, starts = grams.flatten([[v] for v in texts])
    held = np.unique(np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(starts)) << np.uint64(32) | codes.astype(np.uint64))
    row, code = (held >> np.uint64(32)).astype(np.int64), held & np.uint64(0xFFFFFFFF)
    out = np.zeros((len(texts), PLACES), np.float32)
    out[row, (code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 11)).astype(np.int64)] = 1
    return out, np.bincount(row, minlength=len(texts))


def _leaves(batches: Iterator[pa.RecordBatch], radius: float, most: int) -> Iterator[pa.RecordBatch]:
    """Of (space, grp, id, value), a group's rows side by side: (space, grp, id, leaf, lo, hi, held, any) of each row.

    A leaf holds up to ``most`` values of one group that resemble its first one. Its summary stands in the row of that
    one: the least and greatest number of substrings, and as bits the places all its values have and those any has.
    Summaries of the same kind can be merged.
    """
    for whole in batches:
        for k in range(0, whole.num_rows, 1000):
            batch = whole.slice(k, 1000)
            group, ids = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            x, n = _hashed(batch.column(3).to_pylist())
            size, leaf = x.sum(1), ids.copy()
            lo, hi, held, some = (np.full(ids.size, None, object) for _ in range(4))
            edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                free = np.arange(i, j)
                while free.size:
                    both = x[free] @ x[free[0]]
                    near = both >= radius * (size[free] + size[free[0]] - both)
                    near[0] = True
                    mine = free[near][:most]
                    free = np.setdiff1d(free, mine, assume_unique=True)
                    at = mine[0]
                    leaf[mine] = ids[at]
                    lo[at], hi[at] = int(n[mine].min()), int(n[mine].max())
                    held[at], some[at] = (np.packbits(f(x[mine], axis=0).astype(np.uint8)).tobytes() for f in (np.min, np.max))
            columns = [*(batch.column(c) for c in range(3)), pa.array(leaf), *(pa.array(c, pa.int64()) for c in (lo, hi)), *(pa.array(c, pa.binary()) for c in (held, some))]
            yield pa.RecordBatch.from_arrays(columns, names=["space", "grp", "id", "leaf", "lo", "hi", "held", "any"])


def _meeting(table: pa.Table, share: float) -> pa.Table:
    """(a, b) of two blocks' leaves of different groups that may hold a similar pair.

    A value has at least the places that all of its leaf have and none of the other leaf has; no more than ``share`` of
    the sum of their sizes may be in one of a similar pair and not in the other.
    """
    side, leaf, grp, hi = (table.column(c).to_numpy() for c in ("side", "leaf", "grp", "hi"))
    bits = lambda c, at: np.unpackbits(np.frombuffer(b"".join(table.column(c).take(pa.array(at)).to_pylist()), np.uint8).reshape(at.size, -1), axis=1).astype(np.float32)
    x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    own = not y.size
    y = x if own else y
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if x.size and y.size:
        held_y, any_y = bits("held", y), bits("any", y)
        for k in range(0, x.size, 512):
            part = x[k : k + 512]
            held_x, any_x = bits("held", part), bits("any", part)
            apart = held_x.sum(1)[:, None] - held_x @ any_y.T + held_y.sum(1)[None, :] - any_x @ held_y.T
            meet = (apart <= share * (hi[part][:, None] + hi[y][None, :]) + 1e-3) & (grp[part][:, None] != grp[y][None, :])
            if own:
                meet &= np.arange(k, k + part.size)[:, None] < np.arange(y.size)[None, :]
            i, j = np.nonzero(meet)
            a.append(leaf[part[i]])
            b.append(leaf[y[j]])
    return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})


def _unjoined(kept: DataFrame, groups: DataFrame, scratch: Scratch, threshold: float, block: int = 2048, radius: float = 0.75, most: int = 256) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): (a, b) of leaves in different groups that may hold a similar pair, and the (leaf, id) of all
    leaves. No leaves that hold a similar pair in different groups are left out. ``kept`` has each value once.

    Two sets of similarity t or more differ in at most (1 - t) / (1 + t) of the sum of their sizes. Leaves are cut into
    blocks by size; blocks too far apart do not meet.
    """
    spark = kept.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = kept.join(groups, "id").select("space", F.col("cluster").alias("grp"), "id", "value")
    sizes = one.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    # A group's values side by side; large groups are cut up.
    spread = one.join(sizes, "grp").repartition(n, F.col("grp"), F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / 20_000))).sortWithinPartitions("grp", "value").select("space", "grp", "id", "value")
    rows = scratch.keep(spread.mapInArrow(lambda it: _leaves(it, radius, most), "space long, grp long, id long, leaf long, lo long, hi long, held binary, any binary"))
    leaves = rows.filter("held is not null").select("space", "grp", "leaf", "lo", "hi", "held", "any")
    sizes = leaves.groupBy("space", "hi").count()
    before = F.sum("count").over(Window.partitionBy("space").orderBy("hi")) - F.col("count")
    sizes = sizes.withColumn("before", before)
    placed = leaves.join(sizes, ["space", "hi"]).withColumn("block", F.floor((F.col("before") + F.pmod(F.xxhash64("leaf"), "count")) / block)).drop("before", "count")
    found = sorted(tuple(r) for r in placed.groupBy("space", "block").agg(F.min("lo"), F.max("hi")).collect())
    meet, k = [], 0
    for i, (space, x, low, top) in enumerate(found):
        for other, y, low2, top2 in found[i:]:
            if other == space and top >= threshold * low2 and top2 >= threshold * low:
                meet += [(space, x, k, 0)] + ([(space, y, k, 1)] if y != x else [])
                k += 1
    columns = zip(*meet, strict=True) if meet else [()] * 4
    pairs = spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["space", "block", "pair", "side"]))
    spread = placed.join(F.broadcast(pairs), ["space", "block"]).select("pair", "side", "leaf", "grp", "hi", "held", "any")
    share = (1 - threshold) / (1 + threshold)
    return spread.groupBy("pair").applyInArrow(lambda t: _meeting(t, share), "a long, b long"), rows.select("leaf", "id")


def _verified(pairs: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    texts = rows.select("id", "value")
    both = pairs.join(texts.withColumnRenamed("id", "a").withColumnRenamed("value", "x"), "a").join(texts.withColumnRenamed("id", "b").withColumnRenamed("value", "y"), "b")
    return both.select("a", "b", "x", "y").mapInArrow(lambda it: _checked(it, threshold), "a long, b long")


def _merged(groups: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, cluster) with the groups (id, cluster) of linked records (a, b) joined."""
    of = lambda c: groups.select(F.col("id").alias(c), F.col("cluster").alias(f"g{c}"))
    ends = links.join(of("a"), "a").join(of("b"), "b").filter("ga <> gb").select(F.col("ga").alias("a"), F.col("gb").alias("b")).distinct()
    ends = scratch.keep(ends)
    if ends.isEmpty():
        return groups
    joined = hash_to_min(ends, scratch).withColumnRenamed("node", "cluster")
    return scratch.keep(groups.join(joined, "cluster", "left").select("id", F.coalesce("component", "cluster").alias("cluster")))


def linked(df: DataFrame, id_col: str, value: str, space: str | None = None, threshold: float = 0.7, n_hashes: int = 320, rows: int = 8, first_bands: int = 6, all_bands: int = 16, exact: bool = True) -> DataFrame:
    """(id, cluster, size) of each record in a group of two or more; cluster is the group's smallest id.

    Two records are similar when the sets of 4-character substrings of their folded values have a similarity of
    ``threshold`` or more; a group holds all joined by a chain of similar ones. Null values, values that fold to
    fewer than four characters (their sets are empty) and null ids are left out. Ids are integers and stand for one
    record each; records of different ``space`` (an integer column) are never compared. Other columns are ignored.

    Two records of similarity s share one of b bands of r hashes with probability 1 - (1 - s^r)^b. Links that bands miss
    are found through the leaves, so none is left out whatever the bands. Without ``exact`` that step is skipped, and
    links are missed that share no band value with the first group of it, unless other chains join their ends; then 64
    bands of 8 find 0.98 at 0.70, 0.9985 at 0.75 and more than 0.99999 from 0.80.
    """
    require(df, [id_col, value] + ([space] if space else []))
    scratch = Scratch(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), (F.col(f"`{space}`").cast("long") if space else F.lit(0).cast("long")).alias("space"), fold(F.col(f"`{value}`")).alias("value"))
    every = scratch.keep(kept).filter((F.length("value") >= grams.N) & F.col("id").isNotNull())  # before it is written, it would fold twice
    kept = scratch.keep(every.groupBy("space", "value").agg(F.min("id").alias("id")))  # equal values are in one group: one of them stands for all
    bands = bands_of(n_hashes, rows, all_bands)
    few, few_bands = _renumbered(bands[:first_bands])
    used, bands = _renumbered(bands)

    single = kept.select("space", F.col("id").alias("grp"), "id", "value")
    keyed = single.mapInArrow(lambda it: _banded(it, few, few_bands, False), "key long, grp long, id long").select("key", "id")
    keyed = scratch.keep(keyed)
    heads = keyed.groupBy("key").agg(F.min("id").alias("b"), F.max("id").alias("top")).filter("top > b").select("key", "b")
    nearest = keyed.join(heads, "key").filter("id > b").groupBy(F.col("id").alias("a")).agg(F.min("b").alias("b"))
    links = scratch.keep(_verified(nearest, kept, threshold))
    scratch.drop(keyed)
    found = hash_to_min(links, scratch).select(F.col("node").alias("id"), F.col("component").alias("grp"))
    found = scratch.keep(found)
    sizes = found.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    labelled = kept.join(found.join(sizes, "grp"), "id", "left").select("space", F.coalesce("grp", "id").alias("grp"), "id", "value", F.coalesce("n", F.lit(1)).alias("n"))

    # Records of a group side by side, so that a band value is sent on once for each group; large groups are cut up.
    spread = labelled.repartition(n, F.col("grp"), F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / 20_000))).sortWithinPartitions("grp", "id").select("space", "grp", "id", "value")
    entries = spread.mapInArrow(lambda it: _banded(it, max(used, grams.SKETCHED), bands, True), "key long, grp long, id long, s0 long, s1 long")
    entries = entries.groupBy("key", "grp").agg(F.min_by(F.struct("id", "s0", "s1"), "id").alias("m"))
    # Groups that meet in a band value: each with the first. Both steps are pre-aggregated, whatever a value holds.
    entries = scratch.keep(entries)
    first = entries.groupBy("key").agg(F.min(F.struct("grp", "m")).alias("o"), F.max("grp").alias("top")).filter("top > o.grp").select("key", "o")
    pairs = entries.join(first, "key").filter("grp > o.grp").select("m", "o")
    same = lambda k: F.lit(64) - F.bit_count(F.col(f"m.{k}").bitwiseXOR(F.col(f"o.m.{k}")))
    # Bits of the sketches that agree at the threshold, less six standard deviations.
    p = (1 + threshold) / 2
    least = int(128 * p - 6 * (128 * p * (1 - p)) ** 0.5)
    near = pairs.filter(same("s0") + same("s1") >= least).select(F.col("m.id").alias("a"), F.col("o.m.id").alias("b")).distinct()
    bridges = _verified(near, kept, threshold)
    groups = kept.select("id").join(found, "id", "left").select("id", F.coalesce("grp", "id").alias("cluster"))
    groups = _merged(groups, bridges, scratch)
    if exact:
        leaves, members = _unjoined(kept, groups, scratch, threshold)
        leaves = scratch.keep(leaves)
        groups = _merged(groups, _verified(leaves, kept, threshold), scratch)  # a leaf is known by its first value
        of = lambda c: groups.select(F.col("id").alias(c), F.col("cluster").alias(f"g{c}"))
        apart = leaves.join(of("a"), "a").join(of("b"), "b").filter("ga <> gb").select("a", "b")
        of_leaf = lambda c: members.select(F.col("leaf").alias(c), F.col("id").alias(f"i{c}"))
        left = apart.join(of_leaf("a"), "a").join(of_leaf("b"), "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"))
        groups = _merged(groups, _verified(left.repartition(n), kept, threshold), scratch)
    ones = kept.select(F.col("id").alias("one"), F.col("space").alias("one_space"), F.col("value").alias("one_value"))
    own = every.join(ones, F.col("space").eqNullSafe(F.col("one_space")) & (F.col("value") == F.col("one_value"))).select("id", "one")
    groups = scratch.keep(own.join(groups.withColumnRenamed("id", "one"), "one").select("id", "cluster"))
    counts = groups.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return groups.join(counts, "cluster").select("id", "cluster", "size")
