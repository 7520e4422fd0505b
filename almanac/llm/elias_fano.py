"""Elias-Fano lists: sorted 64-bit numbers in about 2 + log2(universe / n) bits each, in a file that is mapped.

The low bits of each number are packed; the high bits are counted in unary. Searches run over whole
arrays of queries: a search finds the bucket of the query's high bits with two selects of zeros,
then its place inside by the low bits."""

from __future__ import annotations

import os

import numpy as np

U = np.uint64
#: The place of every SAMPLE-th zero is kept.
SAMPLE = 8
#: Queries that are searched at once: so many that what is computed for them stays in a core's cache.
BLOCK = 16_384


def write(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays as .npy files of one folder that appears at once: a task that runs again does no harm."""
    part = f"{path}.{os.getpid()}.{np.random.default_rng().integers(1 << 62)}"
    os.makedirs(part)
    for name, a in arrays.items():
        np.save(f"{part}/{name}.npy", a)
    try:
        os.rename(part, path)
    except OSError:  # another attempt of this task was first; the contents are the same
        import shutil

        shutil.rmtree(part, ignore_errors=True)


def build(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """values: sorted, each under universe."""
    n = len(values)
    values = values.astype(U)
    low = max(0, min(56, (max(universe, 1) // max(n, 1)).bit_length() - 1))
    packed = np.zeros(n * low + 64 + 7 >> 3, np.uint8)
    if low and n:
        rest = values & U((1 << low) - 1)
        at = np.arange(n, dtype=np.int64) * low
        for k in range((low + 7) // 8 + 1):  # the k-th byte that a number touches
            shift = at & 7
            byte = ((rest << shift.astype(U)) >> U(8 * k)) & U(255)
            np.bitwise_or.at(packed, (at >> 3) + k, byte.astype(np.uint8))
    high = (values >> U(low)).astype(np.int64)
    size = n + ((universe - 1 >> low) if universe else 0) + 2
    bits = np.zeros(-(-size // 64) * 64, np.uint8)
    bits[high + np.arange(n)] = 1
    words = np.packbits(bits, bitorder="little").view(U)
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
    marks = np.flatnonzero(bits == 0)[::SAMPLE].astype(np.int64 if size >> 32 else np.uint32)
    words = np.append(words, U(0))  # so that eight bytes can be read from any byte
    return {"head": np.array([n, low, universe >> 32, universe & 0xFFFFFFFF], np.int64), "low": packed, "high": words, "ones": ones, "marks": marks}


def select_in(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of the set bit number ``rank`` of each word."""
    at = np.zeros(len(word), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count(word & U((1 << width) - 1)).astype(np.int64)
        go = rank >= below
        rank = rank - below * go
        word = word >> (U(width) * go)
        at += width * go
    return at


def select_early(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """select_in() for ranks under SAMPLE: the set bits before are cleared one by one; 64 where there are fewer."""
    for k in range(SAMPLE - 1):
        word = word & (word - (rank > k))  # word & (word - 1) is word without its lowest set bit
    return np.bitwise_count(~word & (word - U(1))).astype(np.int64)


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.bits = int(arrays["head"][0]), int(arrays["head"][1])
        self.universe = int(arrays["head"][2]) << 32 | int(arrays["head"][3])
        self.high, self.ones, self.marks = arrays["high"], arrays["ones"], arrays["marks"]
        self.bytes = np.ndarray((8 * len(self.high) - 7,), "<u8", self.high, strides=(1,))
        low = arrays["low"]
        self.low = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))

    @classmethod
    def open(cls, path: str, name: str = "") -> EliasFano:
        return cls({k: np.load(f"{path}/{name}{k}.npy", mmap_mode="r").view(np.ndarray) for k in ("head", "low", "high", "ones", "marks")})

    def window(self, at: np.ndarray) -> np.ndarray:
        """57 bits or more from each place."""
        return self.bytes[at >> 3] >> (at & 7).astype(U)

    def select0(self, j: np.ndarray) -> np.ndarray:
        """The place of the zero number j."""
        mark = self.marks[j // SAMPLE].astype(np.int64)
        more = j % SAMPLE
        zeros = ~self.window(mark) & U((1 << 57) - 1)
        at = select_early(zeros, more)
        out = mark + at
        far = np.flatnonzero(at == 64)  # long runs of ones
        if len(far):
            want, after = j[far], j[far] // SAMPLE + 1  # it lies before the next mark
            lo, hi = mark[far] >> 6, np.full(len(far), len(self.ones) - 2)
            some = np.flatnonzero(after < len(self.marks))
            hi[some] = self.marks[after[some]].astype(np.int64) >> 6
            while (lo < hi).any():  # the last word that has at most j zeros before it
                mid = (lo + hi + 1) >> 1
                ok = 64 * mid - self.ones[mid] <= want
                lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
            out[far] = 64 * lo + select_in(~self.high[lo], want - (64 * lo - self.ones[lo]))
        return out

    def select1(self, i: np.ndarray) -> np.ndarray:
        w = np.searchsorted(self.ones, i, side="right") - 1
        return 64 * w + select_in(self.high[w], i - self.ones[w])

    def lows(self, i: np.ndarray) -> np.ndarray:
        at = i * self.bits
        return (self.low[at >> 3] >> (at & 7).astype(U)) & U((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Number i of the list."""
        return ((self.select1(i) - i).astype(U) << U(self.bits)) | self.lows(i)

    def values(self) -> np.ndarray:
        """The whole list."""
        ones = np.flatnonzero(np.unpackbits(np.asarray(self.high).view(np.uint8), bitorder="little"))[: self.n]
        i = np.arange(self.n)
        return ((ones - i).astype(U) << U(self.bits)) | self.lows(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each query in the list, or -1."""
        out = np.full(len(x), -1, np.int64)
        if self.n:
            for a in range(0, len(x), BLOCK):
                self._find(x[a : a + BLOCK], out[a : a + BLOCK])
        return out

    def _find(self, x: np.ndarray, out: np.ndarray) -> None:
        q, ask = x.astype(U), None
        if self.universe < 1 << 64 and (over := q >= U(self.universe)).any():
            ask = np.flatnonzero(~over)
            q = q[ask]
        h = (q >> U(self.bits)).astype(np.int64)
        head = np.where(h > 0, self.select0(np.maximum(h - 1, 0)) + 1, 0)  # where the bucket's ones begin
        run = self.window(head)
        many = np.bitwise_count(run ^ (run + U(1))).astype(np.int64) - 1
        lo, hi = head - h, head - h + many - 1
        if len(far := np.flatnonzero(many >= 56)):
            hi[far] = self.select0(h[far]) - h[far] - 1
        live = np.flatnonzero(lo <= hi)
        lo, hi, want = lo[live], hi[live], (q & U((1 << self.bits) - 1))[live]
        live = live if ask is None else ask[live]
        while len(live):
            mid = (lo + hi) >> 1
            v = self.lows(mid)
            hit = v == want
            out[live[hit]] = mid[hit]
            less = v < want
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid - 1)
            on = np.flatnonzero((lo <= hi) & ~hit)
            lo, hi, want, live = lo[on], hi[on], want[on], live[on]
