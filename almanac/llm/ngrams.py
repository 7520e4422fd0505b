"""LM scoring with an Elias-Fano n-gram trie.

Level 1 holds all words as sorted 64-bit hashes with their exact counts; a word's number is its place.
Level 2 holds the successors of each word: (word, successor) in order, with monotone pointers to each
word's first. Level 3 holds the successors of each pair, each as its place among the successors of
the pair's last word (context-relative), so the numbers are small. All lists are Elias-Fano coded;
log-probabilities and back-off weights are quantised to 16 bits. Levels are files of parts in
the shared folder, mapped by every worker, so a machine holds in memory only what it touches.

Probabilities: interpolated absolute discounting over orders 3, 2 and 1; order 1 adds 0.1 to each
count. Pairs and triples seen at least ``least`` times are held, by default all of them; the others' mass goes to the back-off
weights with their discounts, so each context's probabilities sum to one.

Counting is exact and spread: each task sends sorted runs of keys to the part that will hold them, which adds
them up and lays them out at once: keys travel once, and nothing else is stored. A second pass over the parts fills in the
probabilities when the discount is known. A triple is counted only if both its pairs are held, which holds
for all that can be held itself. Parts are ranges of contexts with about ``PART`` places each, so they grow in
number with the input; a hot word or pair is one entry of each task, and a part of its own at most. Workers open
a part when they first touch it.

Defined cases: null or empty text: one token, the end; no training texts: each token has probability
1; repeated rows count each; an empty table gives no rows; a null id is not held out and is learnt
from; other columns are not read."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import elias_fano
from .common import per_text, release, shared_folder, ship, sliced
from .elias_fano import EliasFano
from .toxicity import fold
from .words import chunks, spans

#: The token that ends a text, and the context of its first word.
END = np.uint64(0x5DEECE66D1234567)
ADD = 0.1
#: Places that a pair or triple needs to be held: all are.
LEAST = 1
#: Characters of input for each part of level 1; places (tokens) for each part of levels 2 and 3.
SHARD_CHARS, PART = 48_000_000, 4_000_000
#: Keys that a task gathers before it sends them.
RUN = 1_000_000
#: Texts that are handled at once: many, as distinct words of a batch are looked up once.
BATCH = 2500
#: Steps of a quantised log10.
STEP = 1 / 4096


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 / STEP), 0, 65535).astype(np.uint16)


def tokens(texts: list, size: int = 8 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes of the tokens of some texts, end of each text in them), for texts of about ``size`` bytes at a time."""
    hashes, ends, total, held = [], [], 0, 0
    for _, offsets, raw in chunks(texts):
        h, starts, _ = spans(raw)
        where = np.searchsorted(starts, np.append(offsets[1:], len(raw)))
        hashes.append(np.insert(h, where, END))
        ends.append(total + where + np.arange(1, len(offsets) + 1))
        total, held = total + len(hashes[-1]), held + len(raw)
        if held >= size:
            yield np.concatenate(hashes), np.concatenate(ends)
            hashes, ends, total, held = [], [], 0, 0
    if hashes:
        yield np.concatenate(hashes), np.concatenate(ends)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their counts summed."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def packed(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Sorted distinct keys as steps of 32 bits, those that are longer apart (or, if many are, all keys whole there), and counts."""
    steps = np.diff(keys, prepend=np.uint64(0))
    wide = np.flatnonzero(steps >> np.uint64(32))
    own = small(counts)
    counted = bytes([own.dtype.itemsize]) + own.tobytes()
    if 4 * len(wide) > len(keys):
        return b"", keys.tobytes(), counted
    far = np.stack([wide.astype(np.uint64), steps[wide]]) if len(wide) else np.empty((2, 0), np.uint64)
    return steps.astype(np.uint32).tobytes(), far.tobytes(), counted


def small(counts: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as the largest needs."""
    top = int(counts.max()) if len(counts) else 0
    return counts.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def unpacked(steps: bytes, far: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = np.frombuffer(counts[1:], f"u{counts[0]}").astype(np.int64)
    if not steps:
        return np.frombuffer(far, np.uint64), n
    s = np.frombuffer(steps, np.uint32).astype(np.uint64)
    wide = np.frombuffer(far, np.uint64).reshape(2, -1)
    s[wide[0].astype(np.int64)] = wide[1]
    return np.cumsum(s, dtype=np.uint64), n


def gathered(docs: DataFrame, keys_of, shards: int, shard_of, text: str) -> DataFrame:
    """Rows (shard, run of keys and counts): keys_of(texts) yields arrays of keys; shard_of(keys) deals them, in
    ranges of keys, so that sorted keys need no sorting by shard."""
    import pyarrow as pa

    ship(docs.sparkSession)
    names = ["shard", "steps", "far", "counts"]

    def rows(keys: np.ndarray, counts: np.ndarray):
        bounds = np.searchsorted(shard_of(keys), np.arange(shards + 1))
        out = [(p, *packed(keys[a:b], counts[a:b])) for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=names)

    def run(batches):
        held, size = [], 0
        for b in sliced(batches, BATCH):
            for keys in keys_of(b.column(0).to_pylist()):
                k, n = np.unique(keys, return_counts=True)
                held.append((k, n))
                size += len(k)
            if size > RUN:
                k, n = added(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [], 0
                yield from rows(k, n)
        if held:
            yield from rows(*added(*(np.concatenate(x) for x in zip(*held, strict=True))))

    return docs.select(F.col(text).alias("t")).mapInArrow(run, "shard int, steps binary, far binary, counts binary")


def summed(group) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a shard's runs."""
    runs = [unpacked(*r) for r in zip(group["steps"], group["far"], group["counts"], strict=True)]
    return added(*(np.concatenate(x) for x in zip(*runs, strict=True)))


def borders(weights: np.ndarray, most: int) -> list[int]:
    """Where ranges of at most about ``most`` of the weights' sum begin, the first at 0."""
    before = np.cumsum(weights) - weights
    return np.flatnonzero(np.append(True, np.diff(before // most) > 0)).tolist() if len(weights) else []


def by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray | slice]]:
    """(part, places) of each part that occurs."""
    order = np.argsort(part, kind="stable") if len(part) and (part[1:] < part[:-1]).any() else None
    part = part if order is None else part[order]
    at = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist() if len(part) else []
    for a, b in zip(at, [*at[1:], len(part)], strict=True):
        yield int(part[a]), slice(a, b) if order is None else order[a:b]


class Lazily:
    """Parts of a level that are opened when they are first asked for; None for empty ones."""

    def __init__(self, sizes: list[int], opener):
        self.sizes, self.opener, self.open = sizes, opener, {}

    def __getitem__(self, p: int):
        if p not in self.open:
            self.open[p] = self.opener(p) if self.sizes[p] else None
        return self.open[p]


def mapped(path: str) -> np.ndarray:
    return np.load(path, mmap_mode="r").view(np.ndarray)


class Level:
    """Parts of an Elias-Fano list with arrays beside it; item numbers run on from part to part."""

    def __init__(self, folder: str, name: str, sizes: list[int], firsts: np.ndarray, arrays: dict[str, str]):
        """arrays: name: the folder that holds it for each part."""
        self.bases = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.firsts = firsts  # the smallest key that each part may hold
        self.parts = Lazily(sizes, lambda p: EliasFano.open(f"{folder}/{name}/{p}"))
        self.arrays = {a: Lazily(sizes, lambda p, a=a, d=d: mapped(f"{folder}/{d}/{p}/{a}.npy")) for a, d in arrays.items()}
        self.n = int(self.bases[-1])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The item of each key, or -1. keys: sorted or not."""
        out = np.full(len(keys), -1, np.int64)
        part = np.searchsorted(self.firsts, keys, side="right") - 1
        for p, at in by_part(part):
            if p >= 0 and self.parts[p] is not None:
                found = self.parts[p].find(keys[at])
                out[at] = np.where(found >= 0, found + self.bases[p], -1)
        return out

    def take(self, name: str, items: np.ndarray) -> np.ndarray:
        """The values of array ``name`` of items (all at least 0)."""
        part = np.searchsorted(self.bases, items, side="right") - 1
        out = None
        for p, at in by_part(part):
            values = self.arrays[name][p][items[at] - self.bases[p]]
            if out is None:  # counts take as many bytes as their part needs
                out = np.zeros(len(items), np.int64 if name == "counts" else values.dtype)
            out[at] = values
        return np.zeros(len(items), np.int64) if out is None else out


class Model:
    """The levels that are there so far; ``about`` describes them and travels to the workers."""

    def __init__(self, about: dict):
        self.about, f = about, about["folder"]
        self.total, self.words = about["total"], Level(f, "1", about["sizes1"], about["firsts1"], {"counts": "1"})
        if "sizes2" in about:
            self.cuts = about["cuts2"]  # the first word of each part of the pairs, and the end
            own = np.diff(self.cuts).tolist()
            self.pairs = Level(f, "2", about["sizes2"], about["firsts2"], {"counts": "2", "p": "2p"})
            self.starts = Lazily(own, lambda p: EliasFano.open(f"{f}/2s/{p}"))
            self.back = Lazily(own, lambda p: mapped(f"{f}/2p/{p}/back.npy"))
        if "sizes3" in about:
            cuts = about["cuts3"]
            self.triples = Level(f, "3", about["sizes3"], about["firsts3"], {"p": "3p"})
            self.back3 = Level.__new__(Level)
            self.back3.bases = cuts
            self.back3.arrays = {"back": Lazily(np.diff(cuts).tolist(), lambda p: mapped(f"{f}/3p/{p}/back.npy"))}

    def known_pairs(self, w: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """The held pairs that occur, ascending, and for each token which of them it makes with the one before it, or -1."""
        ask = np.flatnonzero((w.before >= 0) & (w.numbers >= 0))
        keys = w.before[ask].astype(np.uint64) * np.uint64(self.words.n) + w.numbers[ask].astype(np.uint64)
        keys, back = np.unique(keys, return_inverse=True)
        found = self.pairs.find(keys)
        held = found >= 0
        which = np.full(len(w.numbers), -1, np.int64)
        which[ask] = np.where(held, np.cumsum(held) - 1, -1)[back]
        return found[held], which

    def first_of(self, words: np.ndarray) -> np.ndarray:
        """The item of the first pair of each word."""
        part = np.searchsorted(self.cuts, words, side="right") - 1
        out = np.zeros(len(words), np.int64)
        for p, at in by_part(part):
            out[at] = self.starts[p].get(words[at] - self.cuts[p]).astype(np.int64) + self.pairs.bases[p]
        return out

    def back_of(self, words: np.ndarray) -> np.ndarray:
        part = np.searchsorted(self.cuts, words, side="right") - 1
        out = np.zeros(len(words), np.uint16)
        for p, at in by_part(part):
            out[at] = self.back[p][words[at] - self.cuts[p]]
        return out

    def triple_keys(self, w: Tokens, pairs: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a triple can be held: tokens but a text's first whose pair and previous token's pair are; and its key there."""
        ok = np.empty(len(which), bool)
        ok[:1], ok[1:] = False, (which[1:] >= 0) & (which[:-1] >= 0)
        ok[w.ends[:-1]] = False
        at = np.flatnonzero(ok)
        first = w.each(self.first_of(w.distinct[w.known]), np.int64)  # of the pairs of each distinct word
        relative = pairs[which[at]] - first[w.back[at - 1]]
        return at, pairs[which[at - 1]].astype(np.uint64) * np.uint64(max(1, self.about["span"])) + relative.astype(np.uint64)

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + ADD) / (self.total + ADD * (self.words.n + 1))


_models: dict[tuple, Model] = {}


def opened(about: dict) -> Model:
    """The model of this process; one at a time."""
    key = (about["folder"], *sorted(about))
    if key not in _models:
        _models.clear()
        _models[key] = Model(about)
    return _models[key]


def contexts(numbers: np.ndarray, ends: np.ndarray, end: int) -> np.ndarray:
    """The number of the token before each; that of the end before a text's first."""
    out = np.roll(numbers, 1)
    out[np.concatenate([[0], ends[:-1]])] = end
    return out


class Tokens:
    """Tokens of some texts as distinct words (ascending) and their numbers; -1 for words that aren't known."""

    def __init__(self, m: Model, h: np.ndarray, ends: np.ndarray):
        distinct, self.back = np.unique(h, return_inverse=True)
        self.distinct = m.words.find(distinct)
        self.known = np.flatnonzero(self.distinct >= 0)
        self.numbers, self.ends = self.distinct[self.back], ends
        end = int(m.about["end"])
        self.before = contexts(self.numbers, ends, end)
        self.place = contexts(self.back, ends, int(np.searchsorted(distinct, END)))  # of the token before among distinct

    def each(self, values: np.ndarray, kind) -> np.ndarray:
        """Values of the known distinct words, for all distinct words; 0 for others."""
        out = np.zeros(len(self.distinct), kind)
        out[self.known] = values
        return out


def over_parts(spark, run, parts: int) -> None:
    """run(p) for each part, in tasks of a few parts each."""

    def each(batches):
        for b in batches:
            for p in b.column(0).to_pylist():
                run(p)
            yield b

    spark.range(0, parts, 1, min(parts, 4096)).mapInArrow(each, "id long").count()


def learn(train: DataFrame, text: str = "text", least: int = LEAST) -> dict:
    """Builds the trie over all rows of train and describes it."""
    spark = train.sparkSession
    folder = shared_folder(spark, "ngrams")
    chars = train.agg(F.sum(F.length(text))).first()[0] or 0
    shards = max(4, -(-chars // SHARD_CHARS))
    for d in ("1", "2", "2s", "2p", "3", "3c", "3p"):
        os.makedirs(f"{folder}/{d}")

    # ---- level 1: by ranges of hashes
    width = np.uint64(-(-(1 << 64) // shards))

    def words_of(texts):
        for h, _ in tokens(texts):
            yield h

    def level1(key, group):
        import pandas as pd

        keys, counts = summed(group)
        elias_fano.write(f"{folder}/1/{key[0]}", {**elias_fano.build(keys, 1 << 64), "counts": small(counts)})
        return pd.DataFrame({"part": [key[0]], "n": [len(keys)], "total": [int(counts.sum())], "cuts": [borders(counts, PART)]})

    found = gathered(train, words_of, shards, lambda k: (k // width).astype(np.int64), text).groupBy("shard").applyInPandas(level1, "part int, n long, total long, cuts array<long>").collect()  # a row for each part
    sizes = [0] * shards
    for r in found:
        sizes[r["part"]] = r["n"]
    about = {"folder": folder, "total": sum(r["total"] for r in found), "sizes1": sizes, "firsts1": np.arange(shards, dtype=np.uint64) * width, "span": 1}
    model = Model(about)
    about["end"] = int(model.words.find(np.array([END]))[0])
    vocabulary = np.uint64(model.words.n)
    if not model.words.n:
        return about

    release(spark)

    # ---- level 2: parts are ranges of first words
    cuts2 = joined(found, model.words.bases)

    def pair_keys(texts):
        m = opened(about)
        for h, ends in tokens(texts):
            w = Tokens(m, h, ends)
            yield w.before.astype(np.uint64) * vocabulary + w.numbers.astype(np.uint64)

    def level2(key, group):
        import pandas as pd

        p = key[0]
        keys, counts = summed(group)
        few, keys, counts = kept(keys, counts, least)
        begin = np.searchsorted((keys // vocabulary).astype(np.int64), np.arange(cuts2[p], cuts2[p + 1]))
        per = np.diff(np.append(begin, len(keys)))
        elias_fano.write(f"{folder}/2/{p}", {**elias_fano.build(keys, int(vocabulary) ** 2), "counts": small(counts)})
        elias_fano.write(f"{folder}/2s/{p}", elias_fano.build(begin.astype(np.uint64), len(keys) + 1))
        return pd.DataFrame({"part": [p], "n": [len(keys)], "ones": [few[0]], "twos": [few[1]], "span": [int(per.max(initial=0))], "cuts": [borders(counts, PART)]})

    parted = lambda k: np.searchsorted(cuts2, (k // vocabulary).astype(np.int64), side="right") - 1
    runs = gathered(train, pair_keys, len(cuts2) - 1, parted, text)
    laid = runs.groupBy("shard").applyInPandas(level2, "part int, n long, ones long, twos long, span long, cuts array<long>").collect()  # a row for each part
    sizes2 = [0] * (len(cuts2) - 1)
    for r in laid:
        sizes2[r["part"]] = r["n"]
    about |= {"sizes2": sizes2, "cuts2": cuts2, "firsts2": cuts2[:-1].astype(np.uint64) * vocabulary, "span": max((r["span"] for r in laid), default=1)}
    discount2 = discount(laid)
    del runs
    release(spark)

    def probabilities2(p: int) -> None:
        m = opened(about)
        own = np.arange(cuts2[p], cuts2[p + 1])
        seen = m.words.take("counts", own).astype(np.float64)
        if not sizes2[p]:  # no pairs: its words back off whole
            if not os.path.exists(f"{folder}/2s/{p}"):
                elias_fano.write(f"{folder}/2s/{p}", elias_fano.build(np.zeros(len(own), np.uint64), 1))
            elias_fano.write(f"{folder}/2p/{p}", {"back": np.zeros(len(own), np.uint16)})
            return
        keys, counts = m.pairs.parts[p].values(), m.pairs.arrays["counts"][p].astype(np.float64)
        left, right = (keys // vocabulary).astype(np.int64) - int(cuts2[p]), (keys % vocabulary).astype(np.int64)
        back = np.clip(1 - np.bincount(left, counts - discount2, len(own)) / np.maximum(seen, 1), 1e-12, 1)
        p2 = (counts - discount2) / seen[left] + back[left] * m.unigram(m.words.take("counts", right))
        elias_fano.write(f"{folder}/2p/{p}", {"p": quantised(np.log10(p2)), "back": quantised(np.log10(back))})

    over_parts(spark, probabilities2, len(sizes2))
    about["p2"] = True  # their probabilities are there
    if not sum(sizes2):
        return about
    bases2 = np.concatenate([[0], np.cumsum(sizes2)]).astype(np.int64)
    span = np.uint64(about["span"])

    # ---- level 3: parts are ranges of first pairs
    cuts3 = joined(laid, bases2)

    def triple_keys(texts):
        m = opened(about)
        for h, ends in tokens(texts):
            w = Tokens(m, h, ends)
            yield m.triple_keys(w, *m.known_pairs(w))[1]

    def level3(key, group):
        import pandas as pd

        p = key[0]
        keys, counts = summed(group)
        few, keys, counts = kept(keys, counts, least)
        elias_fano.write(f"{folder}/3/{p}", elias_fano.build(keys, int(bases2[-1]) * int(span)))
        elias_fano.write(f"{folder}/3c/{p}", {"counts": small(counts)})
        return pd.DataFrame({"part": [p], "n": [len(keys)], "ones": [few[0]], "twos": [few[1]]})

    parted3 = lambda k: np.searchsorted(cuts3, (k // span).astype(np.int64), side="right") - 1
    runs = gathered(train, triple_keys, len(cuts3) - 1, parted3, text)
    laid = runs.groupBy("shard").applyInPandas(level3, "part int, n long, ones long, twos long").collect()  # a row for each part
    sizes3 = [0] * (len(cuts3) - 1)
    for r in laid:
        sizes3[r["part"]] = r["n"]
    discount3 = discount(laid)
    del runs
    release(spark)

    def probabilities3(p: int) -> None:
        m = opened(about)
        own = np.arange(cuts3[p], cuts3[p + 1])
        if not sizes3[p]:
            elias_fano.write(f"{folder}/3p/{p}", {"back": np.zeros(len(own), np.uint16)})
            return
        keys, counts = EliasFano.open(f"{folder}/3/{p}").values(), mapped(f"{folder}/3c/{p}/counts.npy").astype(np.float64)
        parent, relative = (keys // span).astype(np.int64), (keys % span).astype(np.int64)
        seen = m.pairs.take("counts", own).astype(np.float64)
        at = parent - int(cuts3[p])
        back = np.clip(1 - np.bincount(at, counts - discount3, len(own)) / np.maximum(seen, 1), 1e-12, 1)
        # the pair of the last two words: the parent's last word, then the relative successor
        distinct, place = np.unique(parent, return_inverse=True)
        middle = np.empty(len(distinct), np.int64)
        for q, some in by_part(np.searchsorted(bases2, distinct, side="right") - 1):
            middle[some] = (m.pairs.parts[q].get(distinct[some] - bases2[q]) % vocabulary).astype(np.int64)
        lower = m.first_of(middle)[place] + relative
        p2 = 10.0 ** (-STEP * m.pairs.take("p", lower))
        p3 = (counts - discount3) / seen[at] + back[at] * p2
        elias_fano.write(f"{folder}/3p/{p}", {"p": quantised(np.log10(p3)), "back": quantised(np.log10(back))})

    over_parts(spark, probabilities3, len(sizes3))
    shutil.rmtree(f"{folder}/3c", ignore_errors=True)
    return about | {"sizes3": sizes3, "cuts3": cuts3, "firsts3": cuts3[:-1].astype(np.uint64) * span}


def joined(found: list, bases: np.ndarray) -> np.ndarray:
    """The first item of each part of the next level, and the end, from the borders that this level's parts name."""
    own = sorted(int(bases[r["part"]]) + c for r in found for c in r["cuts"])
    return np.array([*own, int(bases[-1])], np.int64) if own and own[0] == 0 else np.array([0, *own, int(bases[-1])], np.int64)


def kept(keys: np.ndarray, counts: np.ndarray, least: int) -> tuple[tuple[int, int], np.ndarray, np.ndarray]:
    """How many keys have one place and two; the keys with at least ``least`` and their counts."""
    few = int((counts == 1).sum()), int((counts == 2).sum())
    keep = counts >= least
    return (few, keys, counts) if keep.all() else (few, keys[keep], counts[keep])


def discount(laid: list) -> float:
    """n1 / (n1 + 2 n2) over all keys."""
    ones, twos = sum(r["ones"] for r in laid), sum(r["twos"] for r in laid)
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones + twos else 0.5


def score_texts(m: Model, texts: list) -> list[tuple]:
    """(n_tokens, n_known, base_score, score) of each text."""
    out = []
    for h, ends in tokens(texts):
        start = np.concatenate([[0], ends[:-1]])
        if not m.words.n:
            base = np.full(len(h), np.log10(m.unigram(np.zeros(1))[0]))
            known, score = np.zeros(len(h), bool), base
        else:
            w = Tokens(m, h, ends)
            mine = w.distinct[w.known]
            base = np.log10(m.unigram(w.each(m.words.take("counts", mine), np.int64)))[w.back]
            known, score = w.numbers >= 0, base
        if "sizes2" in m.about:
            pairs, which = m.known_pairs(w)
            hit = np.flatnonzero(which >= 0)
            score = base - STEP * w.each(m.back_of(mine), np.float64)[w.place]
            score[hit] = -STEP * m.pairs.take("p", pairs).astype(np.float64)[which[hit]]
        if "sizes3" in m.about:
            up = np.roll(which, 1)
            up[start] = -1
            has = np.flatnonzero(up >= 0)  # the two words before are a held pair
            score[has] -= STEP * m.back3.take("back", pairs).astype(np.float64)[up[has]]
            at, keys = m.triple_keys(w, pairs, which)
            order = np.argsort(keys)  # triples seldom occur twice in a batch; in order, neighbours touch the same places
            found = m.triples.find(keys[order])
            got = np.flatnonzero(found >= 0)
            score[at[order[got]]] = -STEP * m.triples.take("p", found[got]).astype(np.float64)
        out += zip(
            np.diff(ends, prepend=0).tolist(), np.add.reduceat(known.astype(np.int64), start).tolist(),
            np.add.reduceat(base, start).tolist(), np.add.reduceat(score, start).tolist(), strict=True,
        )
    return out


def lm_scores(docs: DataFrame, text: str = "text", key: str = "doc_id", folds: int = 10, least: int = LEAST) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score; learnt from all rows outside fold 0."""
    held_out = F.coalesce(fold(F.col(key), folds) == 0, F.lit(False))
    about = learn(docs.where(~held_out), text, least)

    def run(texts: list) -> list[tuple]:
        return score_texts(opened(about), texts)

    scored = per_text(docs, run, "n_tokens long, n_known long, base_score double, score double", text, key, BATCH)
    return scored.select(key, held_out.alias("held_out"), "n_tokens", "n_known", F.lit(about["total"]).cast("long").alias("train_tokens"), "base_score", "score")
