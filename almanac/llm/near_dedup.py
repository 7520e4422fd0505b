"""MinHash near-dedup with odd sketches.

1. Signatures, one pass over whole texts: the set of shingles (hashed to 64 bits), its digest, MinHash
   samples, band keys, and the odd sketch of the samples: a bitmap in which each sample flips one bit.
2. Documents with equal sets form a class; from here on its smallest id stands for it.
3. Band buckets with more than one class. Round one pairs each class with the smallest of its bucket.
   Odd sketches drop pairs: with n bits and k samples, popcount(x XOR y) = d estimates the
   similarity as 1 + n / (4k) * ln(1 - 2d / n), most precisely where it is high. Pairs that stay are
   confirmed on the full sets, and the links make components.
4. Round two, only for buckets that still hold several components: every class outside the bucket's
   largest component against all classes of the bucket, in blocks of bounded size; what sketches don't
   drop is confirmed on full sets inside its block. So no bucket's pairs are left out, those inside
   a component are never made, and only links leave a block.
5. Components of the links by smallest label, with pointer jumping.

A pair at the threshold is missed by all 25 bands of 5 samples with a chance under 5e-7 (at 0.85; under
5e-5 at 0.8), and by the sketch margin (six standard deviations) with less.

Defined cases: null text or no words: empty set, n_shingles 0, linked with nothing; fewer words than a
shingle: the whole sequence as one; repeated rows share a class and a decision; a null id joins its
class but never names it; several rows of one id with different texts share one of these texts' links; ids that are
no whole numbers are an error; an empty table gives no rows; other columns are not read."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, per_text, release
from .words import hashes, lowered, mix

SHINGLE = 5
BANDS, ROWS, SAMPLES = 25, 5, 128
SKETCH_BITS = 512
#: Similarities whose estimate is this much under the threshold are dropped: six standard deviations of 128 samples (more under 0.85).
MARGIN = 0.19
#: Classes in a block of round two.
BLOCK = 1024

_rng = np.random.default_rng(1826)
_TIMES = (_rng.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[None, :]
_PLUS = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32)[None, :]
_FACTORS = [np.uint64(x) for x in (_rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1))]
_LANES = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64))


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    h = hashes(lowered(text))
    if len(h) < width:
        if not len(h):
            return h
        width = len(h)  # fewer words: one shingle, told apart from others by its own factor
        return mix((h * np.array(_FACTORS[:width])).sum(keepdims=True) + _FACTORS[-width])
    n = len(h) - width + 1
    out = h[:n] * _FACTORS[0]
    for i in range(1, width):
        out += h[i : i + n] * _FACTORS[i]
    return np.unique(mix(out))


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash samples of a set."""
    low = (s & np.uint64(0xFFFFFFFF)).astype(np.uint32)[:, None]
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 4096):
        np.minimum(out, (low[i : i + 4096] * _TIMES + _PLUS).min(axis=0), out=out)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS)
    key = _LANES[:BANDS].copy()
    for i in range(ROWS):
        key = mix(key ^ rows[:, i] * _FACTORS[i])
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parities of how many samples hash to each bit, as 64-bit words."""
    at = (mix(samples.astype(np.uint64) ^ _LANES) % np.uint64(SKETCH_BITS)).astype(np.int64)
    bits = (np.bincount(at, minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view(np.int64)


def most_flips(threshold: float) -> int:
    """The largest XOR population count whose estimate reaches threshold - MARGIN."""
    floor = max(0.0, threshold - max(MARGIN, 6 * math.sqrt(threshold * (1 - threshold) / SAMPLES)))
    return math.floor(SKETCH_BITS / 2 * (1 - math.exp((floor - 1) * 4 * SAMPLES / SKETCH_BITS)))


def signatures(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = SHINGLE) -> DataFrame:

    def run(texts: list) -> list[tuple]:
        out = []
        for t in texts:
            s = shingles(t, width)
            if not len(s):
                out.append((0, 0, 0, None, None))
                continue
            one, two = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
            samples = signature(s)
            out.append((len(s), int(one), int(two), band_keys(samples), odd_sketch(samples)))
        return out

    return per_text(docs, run, "n long, d1 long, d2 long, bands array<long>, sketch array<long>", text, key).withColumnRenamed(key, "id")


def flips(x: str, y: str):
    """The XOR population count of two sketches."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b with 100 * intersection >= percent * union of their full sets."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            out = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([out.column(0), out.column(1)], names=["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, label: the smallest id of each linked node's component."""
    near = cut(links.select("a", "b").union(links.select("b", "a")).toDF("a", "b").distinct())
    labels = cut(near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")))
    while True:
        around = near.join(labels, near.b == labels.id).groupBy("a").agg(F.min("label").alias("m"))
        hooked = labels.join(around, labels.id == around.a).select("id", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jumped = hooked.alias("h").join(labels.select(F.col("id").alias("up"), F.col("label").alias("top")), F.col("label") == F.col("up"), "left")
        new = cut(jumped.select("id", "old", F.least("label", F.coalesce("top", "label")).alias("label")))
        release(links.sparkSession)
        labels = new.select("id", "label")
        if not new.where(F.col("label") != F.col("old")).limit(1).count():
            return labels


def crossing(buckets: DataFrame, labels: DataFrame, sets: DataFrame, most: int, percent: int) -> DataFrame:
    """Links a < b between components that share a bucket: for each class outside the bucket's largest
    component, one confirmed link to each component that it has links with there.

    buckets: bucket, head, id, sketch. Rows are all classes of a bucket in blocks, columns those outside
    its largest component in blocks; a cell holds one block of each. Pairs with the head are known
    already. Full sets are brought to a cell only for classes that sketches leave a partner there."""
    import pandas as pd

    told = cut(buckets.join(labels, "id", "left").select("bucket", "head", "id", "sketch", F.coalesce("label", "id").alias("label")))
    sizes = told.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    open_ = sizes.groupBy("bucket").agg(F.sum("n").alias("all"), F.max(F.struct("n", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1 and all > 2")
    cells = told.join(
        open_.select(
            "bucket", F.col("top.label").alias("main"), F.ceil(F.col("all") / BLOCK).cast("int").alias("rows"),
            F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("columns"),
        ),
        "bucket",
    )
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    shown = ["bucket", "head", "id", "sketch", "label"]
    row_side = cells.select(*shown, F.lit(False).alias("is_column"), deal("rows").alias("r"), spread("columns").alias("c"))
    column_side = cells.where("label != main").select(*shown, F.lit(True).alias("is_column"), spread("rows").alias("r"), deal("columns").alias("c"))

    def partners(frame):
        """(cell's rows, a column, places among the rows that its sketch leaves), as places in frame."""
        if not len(frame):
            return
        key = [frame[x].to_numpy() for x in ("is_column", "c", "r", "bucket")]
        order = np.lexsort(key)
        new = np.any([np.diff(x[order]) != 0 for x in key[1:]], axis=0)
        edges = np.concatenate([[0], np.flatnonzero(new) + 1, [len(order)]])
        sketch = np.stack(frame["sketch"].to_list()).view(np.uint64)
        head, ids, label = (frame[x].to_numpy() for x in ("head", "id", "label"))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            cell = order[lo:hi]
            split = int(np.searchsorted(key[0][cell], True))
            left, right = cell[:split], cell[split:]
            left, right = left[ids[left] != head[left]], right[ids[right] != head[right]]
            step = max(1, 65_536 // max(1, len(left)))
            for i in range(0, len(right) * (len(left) > 0), step):
                some = right[i : i + step]
                flipped = np.bitwise_count(sketch[left][None] ^ sketch[some][:, None]).sum(axis=2)
                near = (flipped <= most) & (label[left][None] != label[some][:, None])
                for k in np.flatnonzero(near.any(axis=1)):
                    yield left, some[k], np.flatnonzero(near[k])

    def left_over(frame):
        keep = np.zeros(len(frame), bool)
        for left, column, hit in partners(frame):
            keep[left[hit]] = keep[column] = True
        return frame[keep]

    def confirm(frame):
        ids, label, out = frame["id"].to_numpy(), frame["label"].to_numpy(), set()
        items = [np.frombuffer(x, np.uint64) for x in frame["items"]]
        size = np.array([len(x) for x in items])
        for left, column, hit in partners(frame):
            mine, others = items[column], left[hit]
            flat = np.concatenate([items[k] for k in others])
            at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
            shared = np.add.reduceat((mine[at] == flat).astype(np.int64), np.cumsum(size[others]) - size[others])
            linked = others[100 * shared >= percent * (size[others] + len(mine) - shared)]
            b = int(ids[column])
            for k in linked[np.unique(label[linked], return_index=True)[1]]:
                out.add((min(b, int(ids[k])), max(b, int(ids[k]))))
        return pd.DataFrame(sorted(out), columns=["a", "b"], dtype="int64")

    # many small cells share a group, so that none costs a call; a group holds whole cells
    groups = max(int(told.sparkSession.conf.get("spark.sql.shuffle.partitions")), told.count() // 20_000)
    dealt = lambda df: df.repartition(groups, "g").groupBy("g")
    both = row_side.union(column_side).withColumn("g", F.pmod(F.xxhash64("bucket", "r", "c"), F.lit(groups)).cast("int"))
    rest = dealt(both).applyInPandas(left_over, both.schema)
    return dealt(rest.join(sets, "id")).applyInPandas(confirm, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, text: str = "text", key: str = "doc_id", width: int = SHINGLE) -> DataFrame:
    """key, n_shingles, component_id, kept: one row for each row of docs. Ids are whole numbers of any width."""
    most, kind = most_flips(percent / 100), docs.schema[key].dataType
    if kind.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"ids have to be whole numbers, not {kind.simpleString()}")
    docs = docs.withColumn(key, F.col(key).cast("long"))
    own = cut(signatures(docs, text, key, width))
    classes = cut(
        own.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    )
    release(docs.sparkSession)
    named = classes.where("rep is not null")
    banded = named.select(F.col("rep").alias("id"), F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("head")).where("members > 1")
    buckets = cut(banded.join(shared.select("bucket", "head"), "bucket"))
    sketches = named.select(F.col("rep").alias("id"), "sketch")
    release(docs.sparkSession)

    stars = buckets.where("id != head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    first = cut(
        stars.join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("x")), "a")
        .join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("y")), "b")
        .where(flips("x", "y") <= most)
        .select("a", "b")
    )

    # full sets of the classes that share a bucket
    wanted = buckets.select(F.col("id").alias(key)).distinct()

    def run(texts: list) -> list[tuple]:
        return [(shingles(t, width).tobytes(),) for t in texts]

    picked = docs.select(key, text).join(wanted, key, "left_semi").dropDuplicates([key])
    sets = cut(per_text(picked, run, "items binary", text, key).withColumnRenamed(key, "id"))

    release(docs.sparkSession)
    links = cut(confirmed(first, sets, percent))
    labels = components(links)
    release(docs.sparkSession)
    more = cut(crossing(buckets.join(sketches, "id"), labels, sets, most, percent))
    release(docs.sparkSession)
    if more.limit(1).count():
        labels = components(links.union(more))
        release(docs.sparkSession)

    known = classes.select("n", "d1", "d2", "rep").join(labels, F.col("rep") == F.col("id"), "left").select("n", "d1", "d2", F.coalesce("label", "rep").alias("component_id"))
    linked = own.where("n > 0").select("id", "n", "d1", "d2").join(known, ["n", "d1", "d2"]).select("id", "n", "component_id")
    alone = own.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return linked.union(alone).select(
        F.col("id").cast(kind).alias(key), F.col("n").alias("n_shingles"), F.col("component_id").cast(kind).alias("component_id"), F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def near_dedup(docs: DataFrame, percent: int = 85, text: str = "text", key: str = "doc_id", width: int = SHINGLE) -> DataFrame:
    """docs without those that a document with a smaller id stands for; rows with a null id stay."""
    gone = near_duplicates(docs, percent, text, key, width).where(~F.col("kept")).select(key)
    return docs.join(gone.distinct(), key, "left_anti").select(docs.columns)
