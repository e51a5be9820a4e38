"""The same or nearly the same records across splits, by rolling-hash fingerprints.

Candidates: two records are wanted when their sets of 4-character substrings are similar enough, so few of the rolling
hashes of all 4-character windows may stand in one record only. The hashes are dealt to ``k // 3 + 1`` groups of five
parts by their value; if at most k of them differ, some group has at most two parts with a difference (PartEnum, Arasu
et al. 2006). Each record joins across the splits by the contents of any three parts of each group: every wanted pair
shares such a key, and a pair that is much less similar hardly ever does. What still does falls to a bound from 256
parities before texts are read. Single fingerprints would join all records that share a common piece, whose pairs grow
with the square of the records.

Alignment: of each record's pieces the rolling hashes of all k-character windows are taken, and of every w consecutive
ones the smallest is a fingerprint (winnowing); any shared stretch of w + k - 1 characters thus shares one. On the pairs
found, fingerprints are chained where their order agrees and extended to all characters that align, which gives the
coverage; the similarity is computed exactly.

Copies are one record throughout and come apart only in the result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.functions.text import fingerprint128, fold
from fragmill.llm import grams
from fragmill.plans.lineage import Scratch
from fragmill.sources.tables import require

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def windows(data: np.ndarray, k: int) -> np.ndarray:
    """The rolling hash of the k characters from each place on; k is a power of two."""
    h, step, base = data.astype(np.uint64), 1, np.uint64(0x100000001B3)
    while step < k:
        with np.errstate(over="ignore"):
            h = h[:-step] * base + h[step:]
            base = base * base + np.uint64(2)
        step *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def fingerprints(records: Sequence[Sequence[str]], k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(record number, fingerprint), each once, sorted by both. A piece shorter than k is its own fingerprint."""
    pad = "\0" * (k + w)
    rows, lengths, pieces, short = [], [], [], []
    for n, record in enumerate(records):
        for p in record:
            if len(p) >= k:
                rows.append(n)
                lengths.append(len(p))
                pieces.append(p)
            elif p:
                short.append((n, int.from_bytes(blake2b(p.encode(), digest_size=8).digest(), "little")))
    row, value = np.array([n for n, _ in short], np.int64), np.array([v for _, v in short], np.uint64)
    if pieces:
        data = np.frombuffer((pad.join(pieces) + pad).encode("latin-1", "replace"), np.uint8)
        length = np.array(lengths)
        start = np.concatenate([[0], np.cumsum(length + len(pad))[:-1]])
        h = windows(data, k)
        valid = np.zeros(h.size, np.int8)
        np.add.at(valid, start, 1)
        stop = start + length - k + 1
        np.add.at(valid, stop[stop < h.size], -1)
        valid = np.cumsum(valid) > 0
        h = np.where(valid, h, _NONE)
        h = np.concatenate([h, np.full(w, _NONE)])
        least, step = h, 1
        while step * 2 <= w:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        least = np.minimum(least[: h.size - w], least[w - step : h.size - step])
        # A window of hashes counts where it lies in its piece, or where it begins a piece too short to hold one.
        whole = np.zeros(valid.size, bool)
        n = valid.size - (w - 1)
        whole[:n] = valid[:n] & valid[w - 1 :]
        whole[start] = True
        at = np.flatnonzero(whole)
        row = np.concatenate([row, np.array(rows)[np.searchsorted(start, at, side="right") - 1]])
        value = np.concatenate([value, least[at]])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(row.size, bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def size_classes(n: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(class of each size, greatest size of each class); the sizes of a class differ by a factor of up to 1 / threshold."""
    tops, at = [], 1
    while not tops or tops[-1] < n.max(initial=1) / threshold:
        tops.append(max(at, int(at / threshold)))
        at = tops[-1] + 1
    return np.searchsorted(tops, n), np.array(tops)


def _sets(pieces: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(record number, substring), each once."""
    codes, starts = grams.flatten(pieces)
    held = np.unique(np.repeat(np.arange(len(pieces), dtype=np.uint64), np.diff(starts)) << np.uint64(32) | codes.astype(np.uint64))
    return (held >> np.uint64(32)).astype(np.int64), held & np.uint64(0xFFFFFFFF)


def shared_keys(pieces: Sequence[Sequence[str]], threshold: float, wide: bool, parts: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(record number, key): two records of ``threshold`` or more share a key if one of them, not both, is ``wide``.

    A record has the keys of the class of its size; a wide one has those of all classes that similar records may have.
    In a class whose greatest size is u, similar records differ in at most u (1 - t) / t substrings.
    """
    row, code = _sets(pieces)
    n = np.bincount(row, minlength=len(pieces))
    own, tops = size_classes(n, threshold)
    low, high = (size_classes(f(n), threshold)[0] for f in (lambda x: np.ceil(x * threshold - 1e-9).astype(np.int64), lambda x: np.floor(x / threshold + 1e-9).astype(np.int64))) if wide else (own, own)
    part, value = _mix(code * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)), _mix(code * np.uint64(0xD6E8FEB86659FD93) + np.uint64(2))
    rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for c in range(int(low.min(initial=0)), int(high.max(initial=-1)) + 1):
        mine = np.flatnonzero((n > 0) & (low <= c) & (c <= high))
        if not mine.size:
            continue
        groups = int(tops[c] * (1 - threshold) / threshold + 1e-9) // 3 + 1
        place = np.full(n.size, -1)
        place[mine] = np.arange(mine.size)
        use = place[row] >= 0
        at = place[row[use]] * (parts * groups) + (part[use] % np.uint64(parts * groups)).astype(np.int64)
        contents = np.zeros(mine.size * parts * groups, np.uint64)
        np.add.at(contents, at, value[use])
        contents = _mix(contents.reshape(mine.size, parts * groups) + np.arange(parts * groups, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(mine.size, groups, parts)
        x, y = np.triu_indices(parts, 1)  # the two parts a key leaves out
        salt = _mix(np.arange(x.size * groups, dtype=np.uint64) + np.uint64(c << 32) + np.uint64(7)).reshape(groups, x.size)
        keys.append(_mix((contents.sum(2, keepdims=True, dtype=np.uint64) - contents[:, :, x] - contents[:, :, y]) ^ salt).ravel())
        rows.append(np.repeat(mine, x.size * groups))
    return np.concatenate(rows), np.concatenate(keys)


WORDS = 4


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (field, h, value): (field, h, n, w0 to w3): how many substrings a record has, and for each of 256 classes of
    substrings whether it holds an odd number of them. Two records differ in at least as many as these bits do."""
    for whole in batches:
        for lo in range(0, whole.num_rows, 1000):
            batch = whole.slice(lo, 1000)
            row, code = _sets(_pieces(batch.column(2).to_pylist()))
            at = (_mix(code + np.uint64(3)) >> np.uint64(64 - 8)).astype(np.int64)
            odd = np.bincount(row * 64 * WORDS + at, minlength=batch.num_rows * 64 * WORDS) & 1
            words = np.packbits(odd.astype(np.uint8).reshape(batch.num_rows, -1), axis=1).view(np.int64)
            n = np.bincount(row, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), *[pa.array(words[:, j].copy()) for j in range(WORDS)]], names=["field", "h", "n", *[f"w{j}" for j in range(WORDS)]])


def _pieces(values: list[str]) -> list[list[str]]:
    return [v.split(".") for v in values]


def _keyed(batches: Iterator[pa.RecordBatch], threshold: float, wide: bool, parts: int) -> Iterator[pa.RecordBatch]:
    """Of (field, h, value): (field, h, key)."""
    for whole in batches:
        for lo in range(0, whole.num_rows, 1000):
            batch = whole.slice(lo, 1000)
            row, key = shared_keys(_pieces(batch.column(2).to_pylist()), threshold, wide, parts)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(key.view(np.int64))], names=["field", "h", "key"])


def align(x: list[str], y: list[str], k: int, w: int) -> tuple[int, int, int]:
    """(anchors in the chains, characters of x, characters of y that align), piece by piece.

    Anchors are fingerprints both pieces hold, at their first places; the longest chain in the same order is kept and
    each anchor extended both ways over equal characters.
    """
    anchors, covered_x, covered_y = 0, 0, 0
    free = list(y)
    for p in x:
        best = (0, 0, 0, None)
        for q in free:
            if p == q:
                got = (max(1, len(p) // k), len(p), len(q))
            else:
                got = _chain(p, q, k, w)
            if got[1] > best[1]:
                best = (*got, q)
        if best[3] is not None:
            free.remove(best[3])
            anchors, covered_x, covered_y = anchors + best[0], covered_x + best[1], covered_y + best[2]
    return anchors, covered_x, covered_y


def _places(p: str, k: int, w: int) -> dict[str, int]:
    keep = set(fingerprints([[p]], k, w)[1].tolist())
    if len(p) < k:
        return {p: 0}
    h = windows(np.frombuffer(p.encode("latin-1", "replace"), np.uint8), k).tolist()
    out: dict[str, int] = {}
    for i, v in enumerate(h):
        if v in keep:
            out.setdefault(p[i : i + k], i)
    return out


def _chain(p: str, q: str, k: int, w: int) -> tuple[int, int, int]:
    from bisect import bisect_left

    a, b = _places(p, k, w), _places(q, k, w)
    hits = sorted((i, b[s]) for s, i in a.items() if s in b)
    if not hits:
        return 0, 0, 0
    tails: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(hits):  # the longest chain that rises in both
        m = bisect_left(tails, j)
        tails[m : m + 1] = [j]
        at[m : m + 1] = [n]
        before.append(at[m - 1] if m else -1)
    n, chain = at[-1], []
    while n >= 0:
        chain.append(hits[n])
        n = before[n]
    px, py = bytearray(len(p)), bytearray(len(q))
    for i, j in chain:
        lo = 0
        while i - lo > 0 and j - lo > 0 and p[i - lo - 1] == q[j - lo - 1]:
            lo += 1
        hi = 0
        while i + hi < len(p) and j + hi < len(q) and p[i + hi] == q[j + hi]:
            hi += 1
        px[i - lo : i + hi] = b"\1" * (lo + hi)
        py[j - lo : j + hi] = b"\1" * (lo + hi)
    return len(chain), sum(px), sum(py)


def _aligned(batches: Iterator[pa.RecordBatch], threshold: float, k: int, w: int) -> Iterator[pa.RecordBatch]:
    """Of (field, a, b, value_a, value_b): the similar ones, with their similarity and what aligns."""
    names = ["field", "a", "b", "similarity", "anchors", "covered_a", "covered_b"]
    for batch in batches:
        xs, ys = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        sims = grams.pair_similarities(xs, ys, True)
        keep = np.flatnonzero(sims >= threshold)
        found = []
        for n in keep:
            x, y = xs[n].split("."), ys[n].split(".")
            anchors, cx, cy = align(x, y, k, w)
            found.append((anchors, cx / max(1, sum(map(len, x))), cy / max(1, sum(map(len, y)))))
        sims = sims[keep]
        rows = batch.take(pa.array(keep, pa.int64()))
        columns = [pa.array([f[i] for f in found], pa.int32() if i == 0 else pa.float64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), pa.array(sims, pa.float64()), *columns], names=names)


def overlaps(df: DataFrame, id_col: str, fields: Sequence[str], split: str, train: str = "train", threshold: float = 0.9, k: int = 16, w: int = 12, parts: int = 5) -> tuple[DataFrame, DataFrame]:
    """(links, members). links: (field, a, b, similarity, anchors, covered_a, covered_b) of records of the train split (a)
    and of any other split (b) whose sets of 4-character substrings, over the pieces between the dots of the folded
    field, have a similarity of ``threshold`` or more; covered are the shares of their characters that align. members:
    (field, record, id, is_train) says which rows state a record.

    No link is missed, whatever ``parts``: more make more keys a record and fewer pairs that share one by chance. Null and blank values and those without a piece of four characters match nothing. A null split is another split
    than train. Rows with a null id are left out. Other columns are ignored.
    """
    require(df, [id_col, split, *fields])
    scratch = Scratch(df.sparkSession)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("field"), fold(F.col(f"`{f}`")).alias("value")) for i, f in enumerate(fields)]))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{split}`") == train, F.lit(False)).alias("is_train"), each.alias("e")).select("id", "is_train", "e.field", "e.value")
    rows = rows.filter((F.length("value") >= grams.N) & F.col("id").isNotNull()).withColumn("record", fingerprint128("value"))
    classes = rows.groupBy("field", "record", "value").agg(F.max(F.col("is_train").cast("int")).alias("train"), F.max((~F.col("is_train")).cast("int")).alias("other"))
    # Records are joined by 64 bits; should two have the same, both are compared.
    classes = scratch.keep(classes.select("field", "record", F.xxhash64("value").alias("h"), "train", "other", "value"))
    side = lambda c, wide: classes.filter(f"{c} = 1").select("field", "h", "value").mapInArrow(lambda it: _keyed(it, threshold, wide, parts), "field int, h long, key long")
    left, right = side("train", False).withColumnRenamed("h", "ha"), side("other", True).withColumnRenamed("h", "hb")
    marks = scratch.keep(classes.select("field", "h", "value").mapInArrow(_marked, "field int, h long, n long, " + ", ".join(f"w{j} long" for j in range(WORDS))))
    of = lambda c: marks.select("field", F.col("h").alias(f"h{c}"), *[F.col(x).alias(f"{x}{c}") for x in ("n", *(f"w{j}" for j in range(WORDS)))])
    apart = sum((F.bit_count(F.col(f"w{j}a").bitwiseXOR(F.col(f"w{j}b"))) for j in range(1, WORDS)), F.bit_count(F.col("w0a").bitwiseXOR(F.col("w0b"))))
    most = (F.col("na") + F.col("nb")) * F.lit((1 - threshold) / (1 + threshold)) + F.lit(1e-6)
    pairs = left.join(right, ["field", "key"]).select("field", "ha", "hb").distinct()
    pairs = pairs.join(of("a"), ["field", "ha"]).join(of("b"), ["field", "hb"]).filter(apart <= most).select("field", "ha", "hb").distinct()
    value = lambda c, v, flag: classes.filter(f"{flag} = 1").select("field", F.col("h").alias(f"h{c}"), F.col("record").alias(c), F.col("value").alias(v))
    texts = pairs.join(value("a", "x", "train"), ["field", "ha"]).join(value("b", "y", "other"), ["field", "hb"]).select("field", "a", "b", "x", "y")
    links = scratch.keep(texts.mapInArrow(lambda it: _aligned(it, threshold, k, w), "field int, a binary, b binary, similarity double, anchors int, covered_a double, covered_b double"))
    return links, rows.select("field", "record", "id", "is_train")


def pairs(df: DataFrame, id_col: str, fields: Sequence[str], split: str, **kw) -> DataFrame:
    """(sample_a, sample_b): each pair of a row in train and one in another split that agree in any field, smaller id first."""
    links, members = overlaps(df, id_col, fields, split, **kw)
    ends = links.select("field", "a", "b")
    one = members.filter("is_train").select("field", F.col("record").alias("a"), F.col("id").alias("x"))
    two = members.filter("not is_train").select("field", F.col("record").alias("b"), F.col("id").alias("y"))
    both = ends.join(one, ["field", "a"]).join(two, ["field", "b"])
    return both.select(F.least("x", "y").alias("sample_a"), F.greatest("x", "y").alias("sample_b")).distinct()


def classes(df: DataFrame, id_col: str, fields: Sequence[str], split: str, **kw) -> DataFrame:
    """(id, field, class_id, links): each row's class of copies by each field, known by its smallest id, and the number of
    classes that rows of it are linked with across the splits; rows without a value are left out. As ``overlaps`` else."""
    links, members = overlaps(df, id_col, fields, split, **kw)
    both = links.select("field", F.inline(F.array(F.struct(F.col("a").alias("record"), F.col("b").alias("other")), F.struct(F.col("b").alias("record"), F.col("a").alias("other")))))
    counts = both.filter("record <> other").distinct().groupBy("field", "record").agg(F.count(F.lit(1)).alias("links"))
    least = members.groupBy("field", "record").agg(F.min("id").alias("class_id"))
    name = F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("field") + 1)
    return members.join(least, ["field", "record"]).join(counts, ["field", "record"], "left").select(F.col("id").alias(id_col), name.alias("field"), "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def report(df: DataFrame, id_col: str, fields: Sequence[str], split: str, source: str, **kw) -> DataFrame:
    """(split_name, source, rows, overlapping, exact, mean_coverage): rows outside train that also stand in train."""
    require(df, [source])
    links, members = overlaps(df, id_col, fields, split, **kw)
    best = links.groupBy("field", F.col("b").alias("record")).agg(F.max("similarity").alias("s"), F.max("covered_b").alias("c"))
    found = members.filter("not is_train").join(best, ["field", "record"]).groupBy("id").agg(F.max("s").alias("s"), F.max("c").alias("c"))
    outside = df.filter(~F.coalesce(F.col(f"`{split}`") == kw.get("train", "train"), F.lit(False))).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{split}`").alias("split_name"), F.col(f"`{source}`").alias("source"))
    joined = outside.join(found, "id", "left")
    return joined.groupBy("split_name", "source").agg(F.count(F.lit(1)).alias("rows"), F.count("s").alias("overlapping"), F.coalesce(F.sum((F.col("s") == 1).cast("int")), F.lit(0)).alias("exact"), F.avg("c").alias("mean_coverage"))
