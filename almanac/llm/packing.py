"""Best-fit packing of token sequences by bin completion.

Packing needs only how many pieces there are of each length, so the search runs on a histogram of at
most ``size`` numbers, whatever the corpus; pieces are then dealt to places by their rank within
their length, without a join to anything that grows with the corpus.

1. Tokens: a document's ids and one end id; only documents of more than ``size`` ids are cut, the
   first piece taking the remainder.
2. Histogram: one aggregate, at most ``size`` rows to the driver.
3. Search (``complete``): depth-first branch and bound over bin completions. The bin of the largest
   document left is completed by every filling that no other filling dominates, least waste first; a
   filling is tried as often as the histogram allows, then once less, and so on. A branch ends when its waste passes what a
   better packing may waste, or when the bins used and the lower bound of the rest reach the
   incumbent. The first incumbent is best-fit decreasing. ``nodes`` is the only limit.
4. Places: a run (length, first rank, how many) -> (sequence, offset) for each filling and length.

Defined cases: null or empty text is one piece of the end id; no documents, no pieces; repeated rows
are packed each; null keys are packed too; ties in rank go by key, piece and checksum."""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_right
from collections import defaultdict
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ship, sliced

SIZE = 2048
#: Fillings that the search may try before it settles for its incumbent.
NODES = 20_000
#: Fillings that are held for one bin at a time; those after them are found anew when their turn comes.
HELD = 64
PIECES = "piece int, start long, length long, ids_crc32 long"

_encoders: dict[str, object] = {}


def encoder(vocabulary: str):
    """The byte-level BPE of a ranks file next to ``vocabulary``; the same ids as that file, several times as fast."""
    if vocabulary not in _encoders:
        import public_tokenizers as P
        import tiktoken

        with open(P.path(vocabulary.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[vocabulary] = tiktoken.Encoding("pieces", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    return _encoders[vocabulary]


def tokens(text: str | None, vocabulary: str = "byte_bpe_50k.json", end: int = 0) -> np.ndarray:
    ids = encoder(vocabulary).encode_to_numpy((text or ""), allowed_special="all")
    return np.append(ids, np.uint32(end)).astype("<u4")


def pieces_of(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % size or min(n, size)
    return [(0, first)] + [(i, size) for i in range(first, n, size)]


def pieces(docs: DataFrame, size: int = SIZE, vocabulary: str = "byte_bpe_50k.json", text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each piece: key, piece, start, length, ids_crc32."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    ship(docs.sparkSession)
    own = StructType([StructField("k", docs.schema[key].dataType), *StructType.fromDDL(PIECES).fields])
    kinds = to_arrow_schema(own)

    def run(batches):
        for b in sliced(batches):
            rows, columns = [], [[], [], [], []]
            for i, t in enumerate(b.column(1).to_pylist()):
                ids = tokens(t, vocabulary)
                for n, (start, length) in enumerate(pieces_of(len(ids), size)):
                    rows.append(i)
                    for c, v in zip(columns, (n, start, length, zlib.crc32(ids[start : start + length].tobytes())), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, kinds.field(i + 1).type) for i, c in enumerate(columns)]], schema=kinds)

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, own).withColumnRenamed("k", key)


# ---------------------------------------------------------------- the search, on the driver


def lower_bound(count: np.ndarray, size: int) -> int:
    """Bins needed at least: by volume, and with large pieces that can't share (Martello and Toth's L2)."""
    lengths = np.arange(size + 1)
    total = int((count * lengths).sum())
    many, mass = np.append(np.cumsum(count[::-1])[::-1], 0), np.append(np.cumsum((count * lengths)[::-1])[::-1], 0)
    half = size // 2
    big = int(many[half + 1])
    # for each k: pieces over size - k stand alone, those over half take a bin each, those of k and more fill up the rest
    k = np.arange(1, half + 1)
    alone = many[size - k + 1]
    middle, middle_mass = big - alone, mass[half + 1] - mass[size - k + 1]
    small = mass[k] - mass[half + 1]
    needed = big + np.maximum(0, -(-(small - (middle * size - middle_mass)) // size))
    return max(-(-total // size), big, int(needed.max(initial=0)))


Filling = tuple[tuple[int, int], ...]  # (length, times), lengths descending


def best_fit(count: np.ndarray, size: int) -> dict[Filling, int]:
    """Best-fit decreasing over a histogram: how often each filling is made."""
    open_bins: dict[int, dict[Filling, int]] = defaultdict(dict)  # by room left

    def put(room: int, filling: Filling, n: int) -> None:
        open_bins[room][filling] = open_bins[room].get(filling, 0) + n

    for length in range(size, 0, -1):
        left = int(count[length])
        while left:
            room = min((r for r, x in open_bins.items() if r >= length and x), default=None)
            if room is None:
                filling, bins, room = (), left, size
            else:
                filling, bins = next(iter(open_bins[room].items()))
            each = min(room // length, left)
            made = min(bins, left // each)
            if room < size or filling:
                if made == bins:
                    del open_bins[room][filling]
                else:
                    open_bins[room][filling] = bins - made
            put(room - each * length, (*filling, (length, each)), made)
            left -= made * each
    out: dict[Filling, int] = defaultdict(int)
    for x in open_bins.values():
        for filling, n in x.items():
            out[filling] += n
    return dict(out)


def exact(lengths: list[int], counts: list[int], total: int, reach: list[int]):
    """All fillings of exactly ``total``, the largest lengths first. lengths ascend; reach[j]: bits of the sums of the lengths before j."""

    def below(i: int, left: int):
        if not left:
            yield ()
            return
        for j in range(min(i, bisect_right(lengths, left)) - 1, -1, -1):
            n = lengths[j]
            for k in range(min(counts[j], left // n), 0, -1):
                if reach[j] >> (left - k * n) & 1:
                    for rest in below(j, left - k * n):
                        yield ((n, k), *rest)
            if not reach[j] >> left & 1:  # the smaller lengths alone don't come to it
                return

    if reach[-1] >> total & 1:
        yield from below(len(lengths), total)


def sums_of(filling: Filling) -> tuple[int, int]:
    """Bits of the sums of all subsets of a filling, and of those of two and more pieces."""
    every, several, single = 1, 0, 0
    for n, k in filling:
        for _ in range(k):
            several |= (several | single) << n
            every |= every << n
            single |= 1 << n
    return every, several


def dominated(filling: Filling, waste: int, free: int) -> bool:
    """Whether a free length (bits of those that the filling leaves) can stand in for some of its pieces, or be added, at no loss.

    It stands in for pieces that are together at most as long, if the bin has room for it; of one piece of its own length it is no better."""
    every, several = sums_of(filling)
    spread, width = every << 1, 1  # sums moved by 1 to ``waste``
    if not waste:
        return bool(several & free)
    while width < waste:
        more = min(width, waste - width)
        spread |= spread << more
        width += more
    return bool((spread | several) & free)


class Fillings:
    """The undominated fillings of a bin that holds ``large`` already, least waste first, drawn in runs of HELD."""

    def __init__(self, large: int, size: int):
        self.large, self.room, self.waste, self.skip, self.ready = large, size - large, 0, 0, []
        self.tried = 0

    def next(self, count: np.ndarray, slack: int, tries: int) -> tuple[Filling, int] | None:
        """The next filling with its waste, at most ``slack``, after so many tries; count: the pieces left, as when the bin was opened."""
        tries += self.tried
        while not self.ready:
            if self.waste > min(self.room, slack) or self.tried >= tries:
                return None
            self.draw(count)
        filling, waste = self.ready[0]
        if waste > slack:
            return None
        self.ready.pop(0)
        return filling, waste

    def draw(self, count: np.ndarray) -> None:
        have = np.flatnonzero(count[: self.room + 1])
        lengths, counts = have.tolist(), count[have].tolist()
        if lengths and lengths[-1] == self.large:
            counts[-1] -= 1
            if not counts[-1]:
                lengths.pop(), counts.pop()
        mask, reach, free = (1 << self.room + 1) - 1, [1], 0
        for n, c in zip(lengths, counts, strict=True):
            free |= 1 << n
            bits, left, step = reach[-1], min(c, self.room // n), 1
            while left:
                step = min(step, left)
                bits |= bits << n * step & mask
                left -= step
                step *= 2
            reach.append(bits)
        left = dict(zip(lengths, counts, strict=True))
        while self.waste <= self.room and not self.ready:
            some = list(islice(exact(lengths, counts, self.room - self.waste, reach), self.skip, self.skip + HELD))
            self.tried += len(some) + 1
            for f in some:
                rest = free
                for n, k in f:
                    if left[n] == k:
                        rest &= ~(1 << n)
                if not dominated(f, self.waste, rest):
                    whole = dict(f)
                    whole[self.large] = whole.get(self.large, 0) + 1
                    self.ready.append((tuple(sorted(whole.items(), reverse=True)), self.waste))
            if len(some) < HELD:
                self.waste, self.skip = self.waste + 1, 0
            else:
                self.skip += HELD
                if not self.ready:
                    return


def complete(count: np.ndarray, size: int = SIZE, nodes: int = NODES) -> dict[Filling, int]:
    """Fillings and how often each is made, for count[length] pieces of each length from 1 to size."""
    count = np.asarray(count, np.int64).copy()
    best = best_fit(count, size)
    bins, least = sum(best.values()), lower_bound(count, size)
    lengths = np.arange(size + 1)
    path: list[tuple[Filling, int]] = []
    used, tried = 0, 0

    def move(filling: Filling, n: int) -> None:
        for length, k in filling:
            count[length] -= k * n

    def opened() -> list:
        """A frame: the path below it, its fillings, the one that is tried less often next, and how often."""
        return [len(path), Fillings(int(np.flatnonzero(count)[-1]), size), None, 0]

    stack = [opened()] if count.any() else []
    while stack and bins > least and tried < nodes:
        frame = stack[-1]
        while len(path) > frame[0]:
            filling, n = path.pop()
            move(filling, -n)
            used -= n
        slack = (bins - 1 - used) * size - int((count * lengths).sum())
        if frame[3] == 0:
            before = frame[1].tried
            found = frame[1].next(count, slack, nodes - tried)
            tried += frame[1].tried - before
            if found is None:
                stack.pop()
                continue
            frame[2] = found
            frame[3] = min(int(count[length]) // k for length, k in found[0])
        (filling, waste), n = frame[2], frame[3]
        frame[3] -= 1
        tried += 1
        if n * waste > slack:
            frame[3] = min(frame[3], slack // waste)
            continue
        path.append((filling, n))
        move(filling, n)
        used += n
        if not count.any():
            if used < bins:
                bins, best = used, defaultdict(int)
                for g, m in path:
                    best[g] += m
        elif used + lower_bound(count, size) < bins:
            stack.append(opened())
    return dict(best)


def runs(made: dict[Filling, int]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset, times in a sequence), sorted by length and rank."""
    rank: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for filling in sorted(made, reverse=True):
        n, offset = made[filling], 0
        for length, k in filling:
            out.append((length, rank[length], sequence, offset, k))
            rank[length] += n * k
            offset += length * k
        sequence += n
    return np.array(sorted(out), np.int64).reshape(-1, 5)


# ---------------------------------------------------------------- places for all pieces


def pack(docs: DataFrame, size: int = SIZE, vocabulary: str = "byte_bpe_50k.json", text: str = "text", key: str = "doc_id", nodes: int = NODES) -> DataFrame:
    """A row for each piece: key, piece, start, length, ids_crc32, sequence_id, offset."""
    import pyarrow as pa

    cutting = cut(pieces(docs, size, vocabulary, text, key))
    found = cutting.groupBy("length").count().collect()  # at most ``size`` rows
    count = np.zeros(size + 1, np.int64)
    for r in found:
        count[r["length"]] = r["count"]
    table = runs(complete(count, size, nodes))

    # the rank of a piece within its length: by bucket, then within the bucket
    buckets = max(1, int(count.sum()) // 20_000)
    dealt = cutting.withColumn("_bucket", F.pmod(F.xxhash64(key, "piece"), F.lit(buckets)))
    many = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = many.select("length", "_bucket", (F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_base"))
    within = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(key, "piece", "ids_crc32"))
    ranked = dealt.withColumn("_rank", within - 1).join(before, ["length", "_bucket"]).select(key, "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_base")).alias("_rank"))

    schema = ranked.drop("_rank").schema.add("sequence_id", "long").add("offset", "long")

    def place(batches):
        at_key = table[:, 0] << 44 | table[:, 1]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            i = np.searchsorted(at_key, length << 44 | rank, side="right") - 1
            past = rank - table[i, 1]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(table[i, 2] + past // table[i, 4]), pa.array(table[i, 3] + length * (past % table[i, 4]))],
                names=[*b.schema.names[:5], "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, schema)
