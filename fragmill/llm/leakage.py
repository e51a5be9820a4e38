"""Evaluation texts leaking into training text, found by spaced-seed hashing.

A spaced seed hashes the words at some offsets of a short window and ignores the others, so a substituted word between
them does not break the hit. Hits of a document on an item are joined on their diagonal and extended along it, with
substitutions, and the longest exact run is measured. Every mask spans at most ``run`` words: an exact run of that
length is hit by each mask, whatever the words.

Items are held in blocks of a bounded number of words; each block is sent to all tasks and the documents are streamed
past it. More items mean more blocks, not larger ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fragmill.plans.lineage import Scratch
from fragmill.sources.tables import require

#: Offsets of the words a seed looks at. All span 12 words or fewer.
MASKS = ((0, 1, 3, 4, 7, 8, 11), (0, 2, 3, 6, 7, 9, 11), (0, 1, 2, 5, 8, 10, 11))

_BITS = 22


def word(piece: str) -> str:
    """A piece between white space, lower-cased, with all but letters and digits stripped from both ends."""
    piece = piece.lower()
    if piece.isalnum():
        return piece
    i, j = 0, len(piece)
    while i < j and not piece[i].isalnum():
        i += 1
    while j > i and not piece[j - 1].isalnum():
        j -= 1
    return piece[i:j]


def words(text: str | None) -> list[str]:
    return [w for w in map(word, (text or "").split()) if w]


class Index:
    """Spaced seeds of one block of items."""

    def __init__(self, items: list[tuple[int, str | None]], masks=MASKS, run: int = 12):
        if any(max(m) >= run for m in masks):
            raise ValueError("a mask spans more words than the shortest run to find")
        self.masks, self.run = masks, run
        self.vocabulary: dict[str, int] = {}
        self.ids = [i for i, _ in items]
        flat, owner, place = [], [], []
        for n, (_, text) in enumerate(items):
            w = words(text)
            flat += [self.vocabulary.setdefault(x, len(self.vocabulary) + 2) for x in w] + [1]
            owner += [n] * (len(w) + 1)
            place += range(len(w) + 1)
        self.flat = np.array(flat, np.uint64)
        self.owner, self.place = np.array(owner, np.int64), np.array(place, np.int64)
        self.start = np.flatnonzero(self.place == 0)
        self.length = np.bincount(self.owner, minlength=len(items)) - 1 if len(owner) else np.zeros(len(items), np.int64)
        rng = np.random.default_rng(7)
        self.factors = [rng.integers(1, 1 << 62, len(m), dtype=np.uint64) * np.uint64(2) + np.uint64(1) for m in masks]
        self.seen = np.zeros(1 << _BITS, bool)
        self.seeds = []
        for k in range(len(masks)):
            h = self.hashes(self.flat, k)
            at = np.flatnonzero(self._inside(h.size, masks[k]))
            order = np.argsort(h[at], kind="stable")
            self.seeds.append((h[at][order], at[order]))
            self.seen[(h[at] >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def _inside(self, n: int, mask) -> np.ndarray:
        return self.owner[:n] == self.owner[np.minimum(np.arange(n) + max(mask) + 1, self.owner.size - 1)] if n else np.zeros(0, bool)

    def hashes(self, ids: np.ndarray, k: int) -> np.ndarray:
        """The seed of mask k at each place where it fits."""
        mask, n = self.masks[k], ids.size - max(self.masks[k])
        out = np.zeros(max(n, 0), np.uint64)
        if n > 0:
            for offset, factor in zip(mask, self.factors[k], strict=True):
                out += ids[offset : offset + n] * factor
            out ^= out >> np.uint64(29)
            out *= np.uint64(0xBF58476D1CE4E5B9)
        return out

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ids and in the items whose seeds agree, for any mask."""
        mine, theirs = [], []
        for k in range(len(self.masks)):
            h = self.hashes(ids, k)
            at = np.flatnonzero(self.seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
            values, places = self.seeds[k]
            lo, hi = np.searchsorted(values, h[at]), np.searchsorted(values, h[at], side="right")
            n = hi - lo
            mine.append(np.repeat(at, n))
            theirs.append(places[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())])
        return np.concatenate(mine), np.concatenate(theirs)


def _extend(same: np.ndarray, hit: int, cost: int = 2, drop: int = 5) -> tuple[int, int]:
    """The stretch around a hit with the best score: 1 a match, -cost a substitution, ended where it falls by drop."""
    ends = []
    for side in (same[hit:], same[:hit][::-1]):
        score = np.cumsum(np.where(side, 1, -cost))
        if not score.size:
            ends.append(0)
            continue
        fallen = np.flatnonzero(np.maximum.accumulate(np.maximum(score, 0)) - score >= drop)
        score = score[: fallen[0]] if fallen.size else score
        ends.append(int(np.argmax(score)) + 1 if score.size and score.max() > 0 else 0)
    return hit - ends[1], hit + ends[0]


def _longest(same: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    return int((edges[1::2] - edges[::2]).max()) if edges.size else 0


def overlaps(index: Index, ids: np.ndarray, offset: int = 0) -> dict[int, tuple[int, int, int]]:
    """item number -> (matched words, words of the stretch, longest exact run), the best of all diagonals."""
    mine, theirs = index.hits(ids)
    found: dict[int, tuple[int, int, int]] = {}
    if not mine.size:
        return found
    n = index.owner[theirs]
    diagonal = mine - index.place[theirs]
    order = np.lexsort((mine, diagonal, n))
    done: dict[tuple[int, int], int] = {}
    for i in order:
        item, d, at = int(n[i]), int(diagonal[i]), int(mine[i])
        if done.get((item, d), -1) > at:
            continue
        lo, hi = max(d, 0), min(d + int(index.length[item]), ids.size)
        begin = int(index.start[item])
        same = ids[lo:hi] == index.flat[begin + lo - d : begin + hi - d]
        a, b = _extend(same, at - lo)
        done[item, d] = max(lo + b, at + 1)
        matched, exact = int(same[a:b].sum()), _longest(same[a:b])
        old = found.get(item, (0, 0, 0))
        best = (matched, b - a) if matched > old[0] else old[:2]
        found[item] = (*best, max(exact, old[2]))
    return found


def _search(batches: Iterator[pa.RecordBatch], index: Index, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    cache: dict[str, int] = {}
    vocabulary = index.vocabulary
    gap = [0] * (index.run + 1)
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        flat: list[int] = []
        ends, rows = [], []
        for row, text in enumerate(texts):
            if not text:
                continue
            start = len(flat)
            for piece in text.split():
                k = cache.get(piece)
                if k is None:
                    w = word(piece)
                    k = cache[piece] = vocabulary.get(w, 0) if w else -1
                if k >= 0:
                    flat.append(k)
            if len(flat) - start >= 1:
                rows.append(row)
                ends.append((start, len(flat)))
            flat += gap
            if len(cache) > 500_000:
                cache.clear()
        every = np.array(flat, np.uint64)
        out: list[list] = [[], [], [], [], [], []]
        # One look over the whole batch; only documents with a hit are then taken one by one.
        mine, _ = index.hits(every)
        starts = np.array([a for a, _ in ends], np.int64)
        for k in np.unique(np.searchsorted(starts, mine, side="right") - 1) if mine.size else ():
            a, b = ends[k]
            for item, (matched, stretch, exact) in overlaps(index, every[a:b]).items():
                for col, value in zip(out, (rows[k], index.ids[item], matched, stretch, exact, int(index.length[item])), strict=True):
                    col.append(value)
        if out[0]:
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(out[0], pa.int64())), *[pa.array(c, schema.field(i + 1).type) for i, c in enumerate(out[1:])]], schema=schema)


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", run: int = 12, masks=MASKS, block_words: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, matched_words, stretch_words, exact_run, item_words) of each document that shares a seed with an item.

    matched_words are the agreeing words of the best overlap, stretch_words its length with substituted words,
    exact_run the longest run without one. Null and empty texts, and items of fewer words than a mask spans, share
    nothing. Repeated rows come out as often as they stand in docs; other columns of either table are ignored.
    block_words bounds what is sent to a task at a time (an item is never cut, so one longer item is a block).
    """
    require(docs, [doc_id, text], "documents")
    require(items, [item_id, item_text], "items")
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType
    out = T.StructType([T.StructField(doc_id, kind)] + [T.StructField(n, T.LongType() if n == "item_id" else T.IntegerType()) for n in ("item_id", "matched_words", "stretch_words", "exact_run", "item_words")])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)
    pairs = items.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{item_text}`").alias("t")).filter("i is not null and t is not null")
    size = pairs.agg(F.coalesce(F.sum(F.size(F.split("t", r"\s+"))), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // block_words))
    read = docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    result, scratch = None, Scratch(spark) if n_blocks > 1 else None
    for b in range(n_blocks):
        block = pairs.filter(F.pmod(F.xxhash64("i"), F.lit(n_blocks)) == b) if n_blocks > 1 else pairs
        index = spark.sparkContext.broadcast(Index([(r.i, r.t) for r in block.sort("i").collect()], masks, run))
        found = read.mapInArrow(lambda it, index=index: _search(it, index.value, arrow), out)
        if scratch:  # the driver holds one block at a time: its hits are written before the next is collected
            found = scratch.keep(found)
            index.destroy()
        result = found if result is None else result.union(found)
    return result
