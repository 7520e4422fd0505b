"""Searches run in blocks of queries, and selects look only as far as the next mark."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from almanac.llm import elias_fano as E


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, E.SAMPLE - 1)), min_size=1, max_size=50))
def test_early_bits(asked):
    word, rank = (np.array(x, t) for x, t in zip(zip(*asked, strict=True), (np.uint64, np.int64), strict=True))
    for w, r, got in zip(word.tolist(), rank.tolist(), E.select_early(word, rank).tolist(), strict=True):
        bits = [i for i in range(64) if w >> i & 1]
        assert got == (bits[r] if r < len(bits) else 64)


def test_queries_are_searched_in_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    dense = [np.arange(a, a + n) for a, n in ((0, 3000), (10**9, 40_000), (10**9 + 41_000, 7), (2**40 - 70, 70))]
    v = np.unique(np.concatenate([*dense, rng.integers(0, 2**40, 30_000)])).astype(np.uint64)
    e = E.EliasFano(E.build(v, 2**40))
    q = np.concatenate([v, rng.integers(0, 2**41, 20_000, dtype=np.uint64), v + np.uint64(1), np.array([2**40, 2**64 - 1], np.uint64)])
    rng.shuffle(q)
    want = np.searchsorted(v, q)
    want = np.where(np.append(v, v[-1])[np.minimum(want, len(v))] == q, np.minimum(want, len(v) - 1), -1)
    sizes, select0 = [], E.EliasFano.select0
    monkeypatch.setattr(E.EliasFano, "select0", lambda self, j: sizes.append(len(j)) or select0(self, j))
    for block in (E.BLOCK, 1000):
        monkeypatch.setattr(E, "BLOCK", block)
        sizes.clear()
        assert (e.find(q) == want).all() and max(sizes) <= block


def test_long_runs_before_the_next_mark():
    v = np.concatenate([np.arange(200_000), 2**30 + 17 * np.arange(1000)]).astype(np.uint64)
    e = E.EliasFano(E.build(v, 2**31))
    bits = np.unpackbits(np.asarray(e.high).view(np.uint8), bitorder="little")
    zeros = np.flatnonzero(bits[: len(bits) - 64] == 0)
    assert (e.select0(np.arange(len(zeros))) == zeros).all()
