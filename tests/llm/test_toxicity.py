import random
import zlib

import numpy as np
import pytest

from almanac.llm import toxicity as T

BAD = ["gorfin", "skulzat", "brimpox"]


def texts(n, seed=0):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeilmnorstu") for _ in range(r.randint(2, 8)))
    out = []
    for i in range(n):
        w = [word() for _ in range(r.randint(20, 200))]
        y = int(i % 3 == 0)
        if y:
            w[r.randrange(len(w))] = r.choice(BAD) + r.choice(["", "er", "s", ".", "a,"])
        out.append((i, " ".join(w), y))
    return out


@pytest.fixture(scope="module")
def model():
    rows = texts(600)
    return T.Network().train([t for _, t, _ in rows], np.array([y for *_, y in rows]))


def test_held_out_accuracy(model):
    rows = texts(300, seed=9)
    hit = (model.score([t for _, t, _ in rows]) >= 0.5) == np.array([y == 1 for *_, y in rows])
    assert hit.mean() > 0.95


def test_one_word_counts_at_any_place_of_a_long_text(model):
    base = texts(3, seed=4)[1][1]
    long = (base + " ") * 60
    clean, ends = model.score([long])[0], model.score([long + " gorfin", "gorfin " + long, long + " gorfin " + long])
    assert clean < 0.5 and (ends > 0.5).all()


def test_gradient_matches_differences():
    rows = texts(6, seed=2)
    (first, offsets, raw), *_ = list(T.chunks([t for _, t, _ in rows]))
    x, net = T.Inputs(offsets, raw), T.Network(3)
    some = np.array([0, 1, 2])
    keep: dict = {}
    z = net.logits(x, some, keep)
    by = np.array([0.3, -0.7, 0.5], np.float32)
    g = net.gradient(x, keep, by)
    for name in ("Uf", "Wb", "a", "w", "cf"):
        flat, i = net.p[name].reshape(-1), 1
        old = flat[i].copy()
        flat[i] = old + 1e-2
        up = float(net.logits(x, some) @ by)
        flat[i] = old - 1e-2
        down = float(net.logits(x, some) @ by)
        flat[i] = old
        assert abs((up - down) / 2e-2 - g[name].reshape(-1)[i]) < 2e-3, name
    assert z.shape == (3,)


def test_windows_cover_all_words():
    words = [f"w{i}" for i in range(333)]
    (_, offsets, raw), *_ = list(T.chunks([" ".join(words), "", "one"]))
    x = T.Inputs(offsets, raw)
    assert set(x.ids[x.doc == 0].reshape(-1)) - {0} | set() and len(set(x.ids[x.doc == 0].reshape(-1)) - {0}) == 333
    assert (x.doc == 1).sum() == 1 and not x.mask[x.doc == 1].any() and x.mask[x.doc == 2].sum() == 1


def test_query_and_filter(spark):
    rows = texts(400, seed=5)
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows] + [(1000, None, 2), (1001, "", 3), (None, "gorfin", 4), (1002, "a " * 40_000, 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(1, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    out = T.toxicity(docs, labels).collect()
    assert len(out) == 404 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out if r["doc_id"] is not None)
    left = T.drop_toxic(docs, labels)
    assert left.columns == docs.columns
    gone = {r["doc_id"] for r in out if r["predicted"]}
    assert {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in out} - gone and len(gone) > 80
    assert T.toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert T.toxicity(docs.limit(0), labels).count() == 0


def auc(score, y):
    rank = np.empty(len(y))
    rank[np.argsort(score, kind="stable")] = np.arange(1, len(y) + 1)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_training_beats_its_start_on_rows_it_has_not_seen(monkeypatch):
    """Toxic words are many and rare, and share only how they begin: held-out words need the n-grams."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeilmnorstu") for _ in range(r.randint(2, 8)))

    def rows(n):
        out = []
        for i in range(n):
            w, y = [word() for _ in range(r.randint(30, 300))], int(i % 6 == 0)
            for _ in range(2 * y):
                w[r.randrange(len(w))] = r.choice(["zorbi", "quaxel"]) + word()
            out.append((" ".join(w), y))
        return [t for t, _ in out], np.array([y for _, y in out])

    texts_, labels = rows(900)
    others, truth = rows(400)
    trained = T.Network().train(texts_, labels).score(others)
    monkeypatch.setattr(T, "ROUNDS", 0)
    start = T.Network().train(texts_, labels).score(others)
    assert auc(trained, truth) > max(0.97, auc(start, truth))
    assert ((trained >= 0.5) == truth).mean() > 0.95


def test_windows_alone_score_as_within_all(model):
    rows = texts(30, seed=6)
    (_, offsets, raw), *_ = list(T.chunks([t for _, t, _ in rows]))
    x = T.Inputs(offsets, raw)
    top, at = model.texts(x)
    assert np.allclose(model.logits(x.only(at)), top, atol=1e-4)
