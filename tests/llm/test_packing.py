import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from almanac.llm import packing as P


def optimum(lengths, size):
    """Fewest bins by trying all partitions of a few pieces."""
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= size:
                bins[k] += lengths[i]
                go(i + 1, bins)
                bins[k] -= lengths[i]
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_search_on_few_pieces(lengths):
    count = np.bincount(lengths, minlength=21)
    made = P.complete(count, 20)
    back = np.zeros(21, int)
    for filling, n in made.items():
        assert sum(a * k for a, k in filling) <= 20
        for a, k in filling:
            back[a] += k * n
    assert (back == count).all()
    assert P.lower_bound(count, 20) <= optimum(lengths, 20) <= sum(made.values()) <= optimum(lengths, 20) + 1


def test_search_beats_or_meets_best_fit():
    count = np.bincount(np.random.default_rng(5).integers(1, 2049, 20_000), minlength=2049)
    made = sum(P.complete(count).values())
    assert P.lower_bound(count, 2048) <= made <= sum(P.best_fit(count, 2048).values())


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=200))
def test_ids_are_those_of_the_vocabulary_file(text):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    global _tokenizer
    try:
        _tokenizer
    except NameError:
        _tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    assert P.tokens(text).tolist() == [*_tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_special_token_string():
    assert P.tokens("a<|endoftext|>").tolist()[-2] == 50256


def test_pieces():
    assert P.pieces_of(1, 8) == [(0, 1)]
    assert P.pieces_of(8, 8) == [(0, 8)]
    assert P.pieces_of(17, 8) == [(0, 1), (1, 8), (9, 8)]


def test_pack_edges(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, None), (3, "", "y"), (None, "word " * 40, "z"), (5, "long " * 300, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")
    out = P.pack(df, size=64).collect()
    places = defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 64
    five = sorted((r for r in out if r["doc_id"] == 5), key=lambda r: r["piece"])
    ids, at = P.tokens("long " * 300), 0
    for i, r in enumerate(five):
        assert (r["piece"], r["start"], r["ids_crc32"]) == (i, at, zlib.crc32(ids[at : at + r["length"]].tobytes()))
        at += r["length"]
    assert at == len(ids)
    assert sorted(r["length"] for r in out if r["doc_id"] in (2, 3)) == [1, 1]
    assert P.pack(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=8), st.integers(30, 40))
def test_search_is_exact_on_few_pieces(lengths, size):
    count = np.bincount(lengths, minlength=size + 1)
    assert sum(P.complete(count, size).values()) == optimum(lengths, size)


def test_fillings_of_many_small_pieces_are_found():
    count = np.bincount([848, 648] + [300] * 4 + [350] * 4, minlength=2049)
    assert sum(P.complete(count).values()) == 2 < sum(P.best_fit(count, 2048).values())


def test_fillings_are_all_undominated_ones():
    """Against Martello and Toth's criterion, tried on all subsets of the pieces that fit."""
    from itertools import combinations

    def covers(a, b):
        """Whether b's pieces, dealt to a's as to bins, fit."""
        if not b:
            return True
        return any(x >= b[0] and covers([*a[:i], x - b[0], *a[i + 1 :]], b[1:]) for i, x in enumerate(a))

    rng = np.random.default_rng(2)
    for _ in range(40):
        size = int(rng.integers(12, 30))
        pieces = sorted(rng.integers(1, size, 7).tolist(), reverse=True)
        count = np.bincount(pieces, minlength=size + 1)
        large, rest = pieces[0], pieces[1:]
        fit = {c for k in range(7) for c in combinations(rest, k) if sum(c) <= size - large}
        whole = {c for c in fit if not any(d != c and covers(list(d), list(c)) for d in fit)}
        drawn, got = P.Fillings(large, size), set()
        while (f := drawn.next(count, size, 10**6)) is not None:
            own = [n for n, k in f[0] for _ in range(k)]
            own.remove(large)
            got.add(tuple(own))
        assert whole <= got, (size, pieces, whole - got)


def test_far_from_the_bound_only_where_pieces_force_it():
    rng = np.random.default_rng(1)
    gaps = []
    for _ in range(20):
        count = np.bincount(rng.integers(200, 1100, 60), minlength=2049)
        made = sum(P.complete(count, nodes=5_000).values())
        assert made <= sum(P.best_fit(count, 2048).values())
        gaps.append(made - P.lower_bound(count, 2048))
    assert np.mean(gaps) <= 0.5 and max(gaps) <= 1
