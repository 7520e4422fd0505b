"""Words and their 64-bit hashes, computed with numpy over the bytes of a text.

A word is a maximal run of bytes other than 0x09-0x0D and 0x20, with A-Z lower-cased; bytes.lower()
and bytes.split() have exactly these rules. A word's hash is a polynomial over random 64-bit values
of its bytes, then mixed; it depends on the word alone, on any machine."""

from __future__ import annotations

import numpy as np

#: Odd multiplier of the polynomial.
BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(1848).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """At least n powers of BASE."""
    global _powers
    if len(_powers) < n:
        steps = np.full(1 << n.bit_length(), BASE, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on each other."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def spans(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash, first byte and end of each word of raw (lower-cased bytes), in order."""
    data = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(_BLANK[data], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1]).astype(np.int32)
    starts, ends = edges[::2], edges[1::2]
    if not len(edges):
        return np.empty(0, np.uint64), starts, ends
    length = ends - starts
    held = np.flatnonzero(inside[1:-1])
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    within = np.arange(len(held), dtype=np.int32) - np.repeat(first.astype(np.int32), length)
    terms = _VALUES[data[held]] * powers(int(length.max()))[within]
    return mix(np.add.reduceat(terms, first)), starts, ends


def hashes(raw: bytes) -> np.ndarray:
    """The hash of each word of raw, in order."""
    return spans(raw)[0]


def chunks(texts: list, size: int = 1 << 18):
    """Lower-cased texts in runs of about ``size`` bytes, each text ended by a line feed: (first text, their offsets, bytes)."""
    first, parts, total, offsets = 0, [], 0, []
    for i, t in enumerate(texts):
        raw = lowered(t)
        if parts and total + len(raw) > size:
            yield first, np.array(offsets), b"".join(parts)
            first, parts, total, offsets = i, [], 0, []
        offsets.append(total)
        parts += [raw, b"\n"]
        total += len(raw) + 1
    if parts:
        yield first, np.array(offsets), b"".join(parts)
