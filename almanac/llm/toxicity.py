"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs, for each word: of its hashed character n-grams (3 to 6 bytes, with word marks) and its hashed
word a learnt vector each, and three class odds: the mean and the highest of its n-grams', and its own.
Windows of 64 words start every 48 words and cover the whole text; a window's states of both
directions are pooled by attention into a logit, and a text's logit is its highest window. So
one short insult counts in a text of any length.

Training runs in one task, over a bounded sample (``PER_CLASS`` labelled rows of each class, of at
most ``MAX_CHARS`` characters, in the order of their ids' hashes). The sample is cut into ``FOLDS`` parts.
The odds that a part's rows see come from the other parts, so the network learns what odds are worth on rows they
weren't taken from; odds of all rows go into the model. In each round every text's highest window is
looked up, and Adam follows the gradient through the pooling, both recurrences and the vectors, which
shrink towards zero. The first part takes no steps: the round whose loss is least there is kept, and scale
and bias of the logit are fitted on it (Platt).

Defined cases: null or empty text: the score of one empty window; no labelled rows of one class: all scores
are the share of toxic labels (0.0 without labels); labels with null are ignored, and of several
labels of one id the highest counts; repeated rows get equal scores; an empty table gives no rows."""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, per_text, ship, sliced
from .words import chunks, mix, spans

PER_CLASS, MAX_CHARS = 2500, 20_000
WINDOW, STRIDE = 64, 48
DIM, ODDS, HIDDEN = 8, 3, 12
GRAMS, GRAM_BITS, WORD_BITS = (3, 4, 5, 6), 18, 16
#: Rounds of looking up windows, steps over each part of the sample in a round, and sample parts.
ROUNDS, PASSES, FOLDS = 5, 3, 5
RATE, DECAY = 0.02, 1e-3
#: Documents of both classes at which a bucket's odds count half.
SHRINK = 4


def fold(key: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n))


class Inputs:
    """Texts of a chunk as windows of distinct words, and those words' hashed features."""

    def __init__(self, offsets: np.ndarray, raw: bytes):
        h, starts, ends = spans(raw)
        self.docs = len(offsets)
        self.words, at, ids = np.unique(h, return_index=True, return_inverse=True)
        first = np.searchsorted(starts, offsets)
        counts = np.diff(np.append(first, len(h)))
        many = 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE))
        self.doc = np.repeat(np.arange(self.docs), many)
        before = np.cumsum(many) - many
        begin = first[self.doc] + (np.arange(len(self.doc)) - before[self.doc]) * STRIDE
        take = begin[:, None] + np.arange(WINDOW)[None, :]
        self.mask = take < (first + counts)[self.doc][:, None]
        self.first_window = before
        # word number 0 stands for no word
        self.ids = np.where(self.mask, np.append(ids + 1, 0)[np.minimum(take, len(h))], 0)
        self.features(raw, starts[at], ends[at])

    def features(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> None:
        """gram: bucket of each n-gram; owner: its word's number, ascending."""
        data = np.frombuffer(raw, np.uint8)
        length = ends - starts + 2
        owner = np.repeat(np.arange(len(starts), dtype=np.int32), length)
        head = np.cumsum(length) - length
        within = np.arange(len(owner), dtype=np.int32) - head.astype(np.int32)[owner]
        spelled = data[np.clip(starts[owner] + within - 1, 0, len(data) - 1)].astype(np.uint64)
        spelled[within == 0] = 256
        spelled[head + length - 1] = 257
        grams, owners = [], []
        for n in GRAMS:
            if len(owner) >= n:
                code = np.zeros(len(owner) - n + 1, np.uint64)
                for i in range(n):
                    code = code * np.uint64(259) + spelled[i : i + len(code)]
                inside = owner[: len(code)] == owner[n - 1 :]
                grams.append((mix(code[inside] + np.uint64(n << 50)) >> np.uint64(64 - GRAM_BITS)).astype(np.int32))
                owners.append(owner[: len(code)][inside])
        grams, owners = (np.concatenate(x) if x else np.empty(0, np.int32) for x in (grams, owners))
        order = np.argsort(owners, kind="stable")
        self.gram, self.owner = grams[order], owners[order]
        self.starts = np.searchsorted(self.owner, np.arange(len(starts)))
        self.many = np.diff(np.append(self.starts, len(self.owner)))[:, None].astype(np.float32)
        self.word = (self.words >> np.uint64(64 - WORD_BITS)).astype(np.int32)

    def only(self, some: np.ndarray) -> Inputs:
        """These windows, one for each text, and their words alone."""
        out = Inputs.__new__(Inputs)
        out.docs, out.mask = len(some), self.mask[some]
        out.doc = out.first_window = np.arange(len(some))
        used, ids = np.unique(self.ids[some], return_inverse=True)
        out.ids = ids.reshape(len(some), WINDOW) + (used[0] > 0)
        used = used[used > 0] - 1
        out.words, out.word, out.many = self.words[used], self.word[used], self.many[used]
        many = out.many[:, 0].astype(np.int64)
        out.starts = np.cumsum(many) - many
        out.owner = np.repeat(np.arange(len(used), dtype=np.int32), many)
        out.groups = {}
        out.gram = self.gram[np.repeat(self.starts[used] - out.starts, many) + np.arange(many.sum())]
        return out

    def held(self) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """(text, bucket, buckets) of all n-grams and of all words."""
        pairs = distinct(np.repeat(self.doc, self.mask.sum(axis=1)) * np.int64(len(self.words) + 1) + self.ids[self.mask])
        doc, word = pairs // (len(self.words) + 1), pairs % (len(self.words) + 1) - 1
        many = self.many[word, 0].astype(np.int64)
        at = np.repeat(self.starts[word] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return [(np.repeat(doc, many), self.gram[at], 1 << GRAM_BITS), (doc, self.word[word], 1 << WORD_BITS)]


def counted(batches: list[tuple[Inputs, np.ndarray]]) -> list[np.ndarray]:
    """How many texts of each class have each n-gram and each word, and how many there are."""
    out = [np.zeros((2, 1 << GRAM_BITS)), np.zeros((2, 1 << WORD_BITS)), np.zeros(2)]
    for x, y in batches:
        for seen, (doc, bucket, size) in zip(out, x.held(), strict=False):
            once = distinct(doc * np.int64(size) + bucket)
            for c in (0, 1):
                seen[c] += np.bincount(once[y[once // size] == c] % size, minlength=size)
        out[2] += np.bincount(y.astype(int), minlength=2)
    return out


def shrunk(grams: np.ndarray, words: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of toxic against other texts for each bucket, nearer to zero the fewer texts have it."""
    out = []
    for seen in (grams, words):
        odds = np.log((seen[1] + 0.5) / (totals[1] + 1)) - np.log((seen[0] + 0.5) / (totals[0] + 1))
        both = seen.sum(axis=0)
        out.append((odds * both / (both + SHRINK)).astype(np.float32))
    return tuple(out)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal keys stand together, and where each key begins."""
    order = np.argsort(keys, kind="stable")
    return order, np.flatnonzero(np.append(True, np.diff(keys[order]) != 0))


def summed(rows: np.ndarray, order: np.ndarray, at: np.ndarray, ids: np.ndarray, size: int) -> np.ndarray:
    """The sums of the rows of each id under size."""
    out = np.zeros((size, rows.shape[1]), rows.dtype)
    out[ids[order[at]]] = np.add.reduceat(rows[order], at)
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, np.diff(x) != 0)] if len(x) else x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters ``p``, the odds of hashed n-grams and words, and the passes over them."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        draw = lambda *shape, s=0.3: (r.standard_normal(shape) * s).astype(np.float32)
        self.p = {"grams": draw(1 << GRAM_BITS, DIM, s=0.02), "words": draw(1 << WORD_BITS, DIM, s=0.02)}
        for d in "fb":
            self.p |= {f"W{d}": draw(DIM + ODDS, 3 * HIDDEN), f"U{d}": draw(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"a": draw(2 * HIDDEN), "w": draw(2 * HIDDEN), "o": np.zeros(1, np.float32)}
        self.odds = (np.zeros(1 << GRAM_BITS, np.float32), np.zeros(1 << WORD_BITS, np.float32))
        self.scale, self.shift = 1.0, 0.0
        self.constant: float | None = None

    def vectors(self, x: Inputs, odds: tuple | None = None) -> np.ndarray:
        """A row for each distinct word after row 0, that of no word."""
        out = np.zeros((len(x.word) + 1, DIM + ODDS), np.float32)
        if len(x.word):
            of_grams, of_words = odds or self.odds
            out[1:, :DIM] = np.add.reduceat(self.p["grams"][x.gram], x.starts) / x.many + self.p["words"][x.word]
            seen = of_grams[x.gram]
            out[1:, DIM] = np.add.reduceat(seen, x.starts) / x.many[:, 0]
            out[1:, DIM + 1] = np.maximum.reduceat(seen, x.starts)
            out[1:, DIM + 2] = of_words[x.word]
        return out

    def recur(self, d: str, vectors: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        gates, u = vectors @ self.p[f"W{d}"] + self.p[f"c{d}"], self.p[f"U{d}"]
        h = np.zeros((len(ids), HIDDEN), np.float32)
        out = np.empty((len(ids), WINDOW, HIDDEN), np.float32)
        for t in range(WINDOW) if d == "f" else reversed(range(WINDOW)):
            g, hu = gates[ids[:, t]], h @ u
            zr = sigmoid(g[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(g[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            new *= mask[:, t, None]
            if keep is not None:
                keep.append((t, h, z, r, n, hu[:, 2 * HIDDEN :]))
            h = new
            out[:, t] = h
        return out

    def logits(self, x: Inputs, some: np.ndarray | None = None, keep: dict | None = None, odds: tuple | None = None) -> np.ndarray:
        """The logit of each window, or of ``some`` of them."""
        ids, mask = (x.ids, x.mask) if some is None else (x.ids[some], x.mask[some])
        v = self.vectors(x, odds)
        kept = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        h = np.concatenate([self.recur(d, v, ids, mask, kept[d]) for d in "fb"], axis=2)
        e = np.where(mask, h @ self.p["a"], -1e9)
        alpha = np.exp(e - e.max(axis=1, keepdims=True))
        alpha /= alpha.sum(axis=1, keepdims=True)
        c = np.einsum("bt,bth->bh", alpha, h)
        if keep is not None:
            keep |= {"ids": ids, "mask": mask, "v": v, "steps": kept, "h": h, "alpha": alpha, "c": c}
        return c @ self.p["w"] + self.p["o"]

    def gradient(self, x: Inputs, k: dict, by: np.ndarray) -> dict:
        """of the loss, from that of the logits in ``by``."""
        p, g = self.p, {}
        g["w"], g["o"] = by @ k["c"], by.sum(keepdims=True)
        dc = by[:, None] * p["w"]
        dalpha = np.einsum("bh,bth->bt", dc, k["h"])
        de = k["alpha"] * (dalpha - (k["alpha"] * dalpha).sum(axis=1, keepdims=True))
        g["a"] = np.einsum("bt,bth->h", de, k["h"])
        dh_all = k["alpha"][:, :, None] * dc[:, None, :] + de[:, :, None] * p["a"]
        dv = np.zeros_like(k["v"])
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            u = p[f"U{d}"]
            steps = np.empty((WINDOW, len(by), 3 * HIDDEN), np.float32)
            du, dh = np.zeros_like(u), np.zeros((len(by), HIDDEN), np.float32)
            for t, h, z, r, n, hn in reversed(k["steps"][d]):
                dh = (dh + dh_all[:, t, part]) * k["mask"][:, t, None]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * hn * r * (1 - r)
                dhu = np.concatenate([dz, dr, dn], axis=1)
                steps[t] = dhu
                dhu[:, 2 * HIDDEN :] *= r
                du += h.T @ dhu
                dh = dh * z + dhu @ u.T
            flat = k["ids"].T.reshape(-1)
            dgates = summed(steps.reshape(-1, 3 * HIDDEN), *grouped(flat), flat, len(k["v"]))
            g[f"U{d}"], g[f"c{d}"], g[f"W{d}"] = du, dgates.sum(axis=0), k["v"].T @ dgates
            dv += dgates @ p[f"W{d}"].T
        g["dv"] = dv[1:]
        return g

    def texts(self, x: Inputs, odds: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Each text's highest logit, and the window that has it."""
        w = self.logits(x, odds=odds)
        top = np.maximum.reduceat(w, x.first_window)
        hit = np.flatnonzero(w == top[x.doc])
        return top, hit[np.searchsorted(x.doc[hit], np.arange(x.docs))]

    def step(self, x: Inputs, g: dict, rate: float) -> None:
        """One step of Adam; vectors of hashed features move where the batch has them, and shrink."""
        dv = g.pop("dv")[:, :DIM]
        self.steps += 1
        for name, d in g.items():
            m = self.first[name] = 0.9 * self.first.get(name, 0) + 0.1 * d
            s = self.second[name] = 0.99 * self.second.get(name, 0) + 0.01 * d * d
            self.p[name] -= (rate * m / (1 - 0.9**self.steps) / (np.sqrt(s / (1 - 0.99**self.steps)) + 1e-6)).astype(np.float32)
        for name, buckets, d in (("grams", x.gram, (dv / x.many)[x.owner]), ("words", x.word, dv)):
            if len(buckets):
                if name not in x.groups:
                    x.groups[name] = grouped(buckets)
                order, at = x.groups[name]
                have = buckets[order[at]]
                self.p[name][have] = (1 - DECAY) * (self.p[name][have] - rate * np.add.reduceat(d[order], at))

    def train(self, texts: list, labels: np.ndarray, totals: tuple[int, int] | None = None) -> Network:
        """totals: labelled rows of class 0 and 1 that the sample stands for."""
        labels = np.asarray(labels, np.float32)
        if len(set(labels.tolist())) < 2:
            self.constant = float(labels.mean()) if len(labels) else 0.0
            return self
        # parts hold equal shares of both classes; forty batches at least, so that a small sample gets enough steps too
        order = np.random.default_rng(11).permutation(len(texts))
        order = order[np.argsort(labels[order], kind="stable")]
        total = sum(len(t or "") for t in texts)
        batches: list[tuple[int, Inputs, np.ndarray]] = []
        for k in range(FOLDS):
            mine = order[k::FOLDS]
            mine = mine[np.random.default_rng(k).permutation(len(mine))]
            for f, offsets, raw in chunks([texts[i] for i in mine], min(1 << 18, max(1 << 12, total // 40))):
                x = Inputs(offsets, raw)
                batches.append((k, x, labels[mine[f : f + x.docs]]))
        counts = [counted([(x, y) for j, x, y in batches if j == k]) for k in range(FOLDS)]
        whole = [sum(c[i] for c in counts) for i in range(3)]
        odds = [shrunk(*[w - c for w, c in zip(whole, own, strict=True)]) for own in counts]
        weight = (labels == 0).sum() / (labels == 1).sum()
        each = lambda y: np.where(y > 0, weight, 1)
        self.first, self.second, self.steps = {}, {}, 0
        apart, rest = [b for b in batches if b[0] == 0], [b for b in batches if b[0]]
        y0 = np.concatenate([y for _, _, y in apart])
        best = None
        for round_ in range(ROUNDS + 1):
            z = np.concatenate([self.texts(x, odds[0])[0] for _, x, _ in apart])
            loss = float((each(y0) * (np.logaddexp(0, z) - y0 * z)).mean())
            if best is None or loss < best[0]:
                best = (loss, {k: v.copy() for k, v in self.p.items()}, z)
            if round_ == ROUNDS:
                break
            shown = [(x.only(self.texts(x, odds[k])[1]), y, odds[k]) for k, x, y in rest]
            for pass_ in range(PASSES):
                for i in np.random.default_rng([round_, pass_]).permutation(len(shown)):
                    (x, y, seen), keep = shown[i], {}
                    z = self.logits(x, None, keep, seen)
                    g = self.gradient(x, keep, ((sigmoid(z) - y) * each(y)).astype(np.float32) / x.docs)
                    self.step(x, g, RATE * (1 - (round_ * PASSES + pass_) / (ROUNDS * PASSES)))
        _, self.p, z = best
        self.odds = shrunk(*whole)
        del self.first, self.second
        self.calibrate(z, y0, totals or (1, 1))
        return self

    def calibrate(self, z: np.ndarray, y: np.ndarray, totals: tuple[int, int]) -> None:
        """Platt's sigmoid by Newton steps, with his smoothed targets, weighted to the shares of all labelled rows."""
        n1, n0 = y.sum(), (1 - y).sum()
        each = np.where(y > 0, totals[1] / n1, totals[0] / n0)
        each = each / each.mean()
        target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = sigmoid(a * z + b)
            d, s = each * (p - target), each * p * (1 - p) + 1e-9
            hessian = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-3]])
            move = np.linalg.solve(hessian, [(d * z).sum() + 1e-3 * (a - 1), d.sum()])
            a, b = a - float(np.clip(move[0], -1, 1)), b - float(np.clip(move[1], -2, 2))
        self.scale, self.shift = max(a, 1e-3), b

    def score(self, texts: list) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out = np.empty(len(texts))
        for first, offsets, raw in chunks(texts, 1 << 19):
            x = Inputs(offsets, raw)
            out[first : first + x.docs] = sigmoid(self.scale * self.texts(x)[0].astype(np.float64) + self.shift)
        return out


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", folds: int = 5) -> Network:
    """Trains on labelled rows outside fold 0."""
    known = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (fold(F.col(key), folds) != 0))
        .groupBy(key).agg(F.max(label).alias("_y"))
    )
    picked = None
    for y in (0, 1):
        some = known.where(F.col("_y") == y).orderBy(F.xxhash64(key), key).limit(PER_CLASS)
        picked = some if picked is None else picked.union(some)
    picked = cut(picked)  # 2 * PER_CLASS ids at most
    many = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}  # two rows
    fit = docs.select(key, text).join(F.broadcast(picked), key).where(F.length(text) <= MAX_CHARS).dropDuplicates([key])
    ship(docs.sparkSession)

    def fitted(batches):
        import pyarrow as pa

        texts, labels = [], []
        for b in sliced(batches):
            labels += b.column(0).to_pylist()
            texts += b.column(1).to_pylist()
        model = Network().train(texts, np.array(labels), (many.get(0, 1), many.get(1, 1)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # the sample is bounded, and so is the model: one row of a fixed size comes back
    one = fit.repartition(1).sortWithinPartitions(F.xxhash64(key), key).select("_y", text)
    made = one.mapInArrow(fitted, "model binary").first()
    return pickle.loads(made["model"]) if made else Network().train([], np.empty(0))  # an empty sample may have no task at all


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", folds: int = 5) -> DataFrame:
    """key, held_out, score, predicted: one row for each row of docs."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(learn(docs, labels, text, key, label, folds))

    def run(texts: list) -> list[tuple]:
        return [(float(s), int(s >= 0.5)) for s in model.value.score(texts)]

    scored = per_text(docs, run, "score double, predicted int", text, key)
    return scored.select(key, (fold(F.col(key), folds) == 0).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without the rows that are predicted to be toxic."""
    import pyarrow as pa

    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(learn(docs, labels, text, key))
    at = docs.columns.index(text)

    def run(batches):
        for b in sliced(batches):
            yield b.filter(pa.array(model.value.score(b.column(at).to_pylist()) < 0.5, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
