import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from almanac.llm import ngrams as N
from almanac.llm.elias_fano import EliasFano, build


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=300), st.lists(st.integers(0, 2**40), max_size=50))
def test_elias_fano(values, asked):
    v = np.array(sorted(set(values)), np.uint64)
    e = EliasFano(build(v, 2**40 + 1))
    place = {int(x): i for i, x in enumerate(v)}
    q = np.array([*asked, *values], np.uint64)
    assert e.find(q).tolist() == [place.get(int(x), -1) for x in q]
    assert e.get(np.arange(len(v))).tolist() == v.tolist()


def test_elias_fano_long_runs():
    v = np.concatenate([np.arange(5000), 10**12 + np.arange(5000)]).astype(np.uint64)
    e = EliasFano(build(v, 2 * 10**12))
    assert (e.find(v) == np.arange(len(v))).all() and (e.find(v + np.uint64(20_000)) == -1).all()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 2**64 - 1), st.integers(1, 2**40), max_size=50))
def test_runs_of_keys(counts):
    k = np.array(sorted(counts), np.uint64)
    n = np.array([counts[int(x)] for x in k], np.int64)
    keys, back = N.unpacked(*N.packed(k, n))
    assert keys.tolist() == k.tolist() and back.tolist() == n.tolist()


END = b"\0end"


class Plain:
    """The same model with dictionaries."""

    def __init__(self, texts):
        self.c1, c2, c3 = Counter(), Counter(), Counter()
        for t in texts:
            w = t.encode().lower().split() + [END]
            x = [END, *w]
            self.c1.update(w)
            c2.update(zip(x, x[1:], strict=False))
            c3.update(zip(x, x[1:], x[2:], strict=False))
        self.n, self.v = sum(self.c1.values()), len(self.c1)
        self.k2 = {k: n for k, n in c2.items() if n >= 2}
        c3 = {k: n for k, n in c3.items() if k[:2] in self.k2 and k[1:] in self.k2}
        self.k3 = {k: n for k, n in c3.items() if n >= 2}
        self.d2, self.d3 = self.discount(c2), self.discount(c3)
        self.b2, self.b3 = defaultdict(float), defaultdict(float)
        for (u, _), n in self.k2.items():
            self.b2[u] += n - self.d2
        for (u, v, _), n in self.k3.items():
            self.b3[u, v] += n - self.d3

    @staticmethod
    def discount(c):
        a, b = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
        return min(0.95, max(0.05, a / (a + 2 * b))) if a + b else 0.5

    def p1(self, w):
        return (self.c1[w] + 0.1) / (self.n + 0.1 * (self.v + 1))

    def p2(self, u, w):
        if not self.c1[u]:
            return self.p1(w)
        return (self.k2.get((u, w), self.d2) - self.d2) / self.c1[u] + (1 - self.b2[u] / self.c1[u]) * self.p1(w)

    def p3(self, u, v, w):
        n = self.k2.get((u, v))
        if not n:
            return self.p2(v, w)
        return (self.k3.get((u, v, w), self.d3) - self.d3) / n + (1 - self.b3[u, v] / n) * self.p2(v, w)

    def score(self, t):
        w = t.encode().lower().split() + [END]
        x = [END, *w]
        base = sum(math.log10(self.p1(a)) for a in w)
        return len(w), sum(self.c1[a] > 0 for a in w), base, math.log10(self.p2(END, w[0])) + sum(math.log10(self.p3(*x[i : i + 3])) for i in range(len(x) - 2))


def corpus(n=300):
    r = random.Random(7)
    words = ["".join(r.choice("abcde") for _ in range(r.randint(1, 4))) for _ in range(120)]
    phrases = [" ".join(r.choice(words) for _ in range(8)) for _ in range(20)]
    rows = [(i, " ".join(r.choice([*words, *phrases, f"rare{i}"]) for _ in range(r.randint(0, 40)))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "X" * 50_000 + " the end"), (n + 3, rows[3][1]), (n + 3, rows[3][1])]


@pytest.mark.parametrize("shard", [N.SHARD_CHARS, 2000])
def test_against_dictionaries(spark, monkeypatch, shard):
    monkeypatch.setattr(N, "SHARD_CHARS", shard)
    monkeypatch.setattr(N, "PART", max(20, shard // 6))
    rows = corpus()
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, score int").repartition(3)
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    plain = Plain([t or "" for i, t in rows if not held(i)])
    out = N.lm_scores(df, least=2).collect()
    assert len(out) == len(rows)
    text = dict(rows)
    for r in out:
        n, known, base, score = plain.score(text[r["doc_id"]] or "")
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, plain.n, held(r["doc_id"]))
        assert r["base_score"] == pytest.approx(base, abs=1e-8)
        assert abs(r["score"] - score) < 3e-4 * n
    assert sum(r["score"] for r in out if r["held_out"]) > sum(r["base_score"] for r in out if r["held_out"])


def test_probabilities_sum_to_one():
    m = Plain([t or "" for _, t in corpus()])
    for u, v in list(m.k2)[:20]:
        assert sum(m.p3(u, v, w) for w in m.c1) + (1 - m.b3[u, v] / m.k2[u, v]) * (1 - m.b2[v] / m.c1[v]) * m.p1(b"unseen") == pytest.approx(1)


def test_no_training_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    assert N.lm_scores(df.limit(0)).count() == 0
    out = N.lm_scores(df.where("doc_id = 12345")).count()
    assert out == 0
    zero = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = N.lm_scores(spark.createDataFrame([(zero, "a b")], "doc_id long, text string")).collect()[0]
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (3, 0, 0, 0.0, 0.0)
