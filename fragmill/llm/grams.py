"""Sets of 4-character substrings: minhash signatures, sketches and exact similarity, over Arrow batches of folded text."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

N = 4
#: Minhash values that a sketch is made from.
SKETCHED = 128


def flatten(pieces: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, starts): the substrings of each record's pieces as integers, one after the other; starts has one more entry."""
    held = ["\0\0\0".join(p) for p in pieces]
    data = np.frombuffer(("\0\0\0".join(held) + "\0\0\0").encode("latin-1", "replace"), np.uint8)
    ends = np.cumsum([len(h) + 3 for h in held]) if held else np.zeros(0, np.int64)
    if data.size < N:
        return np.zeros(0, np.uint32), np.zeros(len(held) + 1, np.int64)
    n = data.size - N + 1
    wide = data.astype(np.uint32)
    codes = wide[:n] | wide[1 : n + 1] << 8 | wide[2 : n + 2] << 16 | wide[3 : n + 3] << 24
    inside = (data[:n] > 0) & (data[1 : n + 1] > 0) & (data[2 : n + 2] > 0) & (data[3 : n + 3] > 0)
    before = np.concatenate([[0], np.cumsum(inside)])
    return codes[inside], np.concatenate([[0], before[np.minimum(ends, n)]]).astype(np.int64)


class Signer:
    """Minhash values of sets of substrings."""

    def __init__(self, n_hashes: int, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 1 << 63, n_hashes, dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 1 << 63, n_hashes, dtype=np.uint64)

    def table(self, codes: np.ndarray) -> np.ndarray:
        x = codes.astype(np.uint64)[:, None] * self.a[None, :] + self.b[None, :]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        return (x >> np.uint64(32)).astype(np.uint32)

    def sign(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row of minhash values a record; a record without substrings has the greatest value throughout."""
        n = starts.size - 1
        out = np.full((n, self.a.size), 0xFFFFFFFF, np.uint32)
        seen, at = np.unique(codes, return_inverse=True)
        for lo in range(0, seen.size, 1 << 16):  # a batch of very long texts may hold many different substrings
            part = self.table(seen[lo : lo + (1 << 16)])
            one = seen.size <= 1 << 16
            for i in range(n):
                mine = at[starts[i] : starts[i + 1]]
                if not one:
                    mine = mine[(mine >= lo) & (mine < lo + (1 << 16))] - lo
                for k in range(0, mine.size, 4096):
                    np.minimum(out[i], part[mine[k : k + 4096]].min(axis=0), out=out[i])
        return out


def band_keys(signatures: np.ndarray, bands: Sequence[Sequence[int]], salt: np.ndarray) -> np.ndarray:
    """One integer for each record and band; salt keeps records of different kinds apart."""
    out = np.empty((signatures.shape[0], len(bands)), np.uint64)
    for j, band in enumerate(bands):
        h = salt.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(j + 1)
        for c in band:
            h = (h ^ signatures[:, c].astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(32)
        out[:, j] = h
    return out.view(np.int64)


def sketch(signatures: np.ndarray) -> np.ndarray:
    """128 bits of the first 128 minhash values as two integers: two sets of similarity s agree in a bit with (1 + s) / 2."""
    x = signatures[:, :SKETCHED].copy()
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x45D9F3B)
    x ^= x >> np.uint32(16)
    bits = np.packbits((x & np.uint32(1)).astype(np.uint8), axis=1)
    return bits.view(np.int64).reshape(-1, 2)


def gram_set(pieces: Sequence[str]) -> set[str]:
    return {p[i : i + N] for p in pieces for i in range(len(p) - N + 1)}


def similarity(a: set, b: set) -> float:
    """Intersection by union; two empty sets have none."""
    both = len(a & b)
    return both / (len(a) + len(b) - both) if both else 0.0


def pair_similarities(xs: Sequence[str], ys: Sequence[str], by_dots: bool) -> np.ndarray:
    """The exact similarity of each pair of texts, over their pieces between dots or over the whole.

    Texts are taken a bounded number of characters at a time. Each different text of such a part becomes one row of
    bits over the part's substrings, so a pair costs one intersection of rows.
    """
    out = np.zeros(len(xs))
    ends = np.cumsum([len(x) + len(y) for x, y in zip(xs, ys, strict=True)])
    lo = 0
    while lo < len(xs):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 1_000_000, side="right")))
        number: dict[str, int] = {}
        a = np.array([number.setdefault(x, len(number)) for x in xs[lo:hi]])
        b = np.array([number.setdefault(y, len(number)) for y in ys[lo:hi]])
        codes, starts = flatten([t.split(".") if by_dots else [t] for t in number])
        seen, at = np.unique(codes, return_inverse=True)
        if len(number) * seen.size <= 1 << 28:
            bits = np.zeros((len(number), max(1, seen.size)), np.uint8)
            bits[np.repeat(np.arange(len(number)), np.diff(starts)), at] = 1
            size = bits.sum(1, dtype=np.int64)
            packed = np.packbits(bits, axis=1)
            both = np.array([np.bitwise_count(packed[i] & packed[j]).sum(dtype=np.int64) for i, j in zip(a, b, strict=True)])
        else:
            sets = [np.unique(at[i:j]) for i, j in zip(starts[:-1], starts[1:], strict=True)]
            size = np.array([s.size for s in sets])
            both = np.array([np.intersect1d(sets[i], sets[j], assume_unique=True).size for i, j in zip(a, b, strict=True)])
        out[lo:hi] = both / np.maximum(size[a] + size[b] - both, 1)
        lo = hi
    return out
