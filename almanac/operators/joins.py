"""Joins beyond equality: null-safe, validated, in blocks, by ladder, by ancestor, as of a year."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Rows of a side up to which it may be broadcast; the side is counted before.
BROADCAST_ROWS = 200_000
#: Pairs that one task of a join within blocks makes, about.
TASK_PAIRS = 20_000_000
#: Rows of a key that ``gathered`` holds in one array, about.
CHUNK = 256


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def block_sizes(left: DataFrame, right: DataFrame, lkeys: list[str], rkeys: list[str], size: str | None = None) -> tuple[DataFrame, int, int]:
    """Rows of left (_l) and right (_r) and pairs (_n) by key (_b0, ...) of an equi join, the sum of pairs, and the number of partitions that make them.

    size: the column of both sides that says for how many rows a row stands."""
    names = [f"_b{i}" for i in range(len(lkeys))]
    count = lambda df, keys, n: df.groupBy(*[F.col(k).alias(b) for k, b in zip(keys, names, strict=True)]).agg((F.sum(size) if size else F.count(F.lit(1))).alias(n))
    blocks = count(left, lkeys, "_l").join(count(right, rkeys, "_r"), names).withColumn("_n", F.col("_l") * F.col("_r"))
    total = blocks.agg(F.sum("_n")).first()[0] or 0
    return blocks, total, int(min(20_000, max(2 * left.sparkSession.sparkContext.defaultParallelism, total // TASK_PAIRS * 2)))


def gathered(left: DataFrame, right: DataFrame, on: list[str], lvalue: str, rvalue: str) -> tuple[DataFrame, DataFrame, int]:
    """Both sides of an equi join with arrays of lvalue and of rvalue in place of rows (CHUNK of a key at most, about), and the partitions for its pairs.

    An array of left meets TASK_PAIRS / 4 rows of right at most, where it holds more than one. Keys that neither side cuts are one row of each."""
    blocks, _, n = block_sizes(left, right, on, on)
    fit = F.greatest(F.lit(1), F.least(F.lit(CHUNK), F.floor(F.lit(TASK_PAIRS) / 4 / F.col("_r"))))
    hot = blocks.select(*[F.col(f"_b{i}").alias(c) for i, c in enumerate(on)], F.ceil(F.col("_l") / fit).alias("_l"), F.ceil(F.col("_r") / CHUNK).alias("_r"))
    hot = sized(hot.where("_l > 1 or _r > 1"))

    def arrays(df, value, parts):
        # in structs, as lists are collected without nulls
        dealt = df.join(hot, on, "left").withColumn("_part", F.pmod(F.xxhash64(value), F.coalesce(parts, F.lit(1))))
        return dealt.groupBy(*on, "_part").agg(F.transform(F.collect_list(F.struct(F.col(value).alias("x"))), lambda v: v["x"]).alias(value))

    return arrays(left, lvalue, "_l"), arrays(right, rvalue, "_r").drop("_part"), n


def spread(left: DataFrame, right: DataFrame, lkeys: list[str], rkeys: list[str], by: str, size: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides of an equi join with ``_salt``, dealt so that no task makes many more than TASK_PAIRS pairs.

    Keys with more pairs are cut into salts: rows of left fall into one by ``by``, rows of right go to each. Join on the keys and _salt. size: as in block_sizes."""
    known = lambda df, keys: df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    left, right = known(left, lkeys), known(right, rkeys)
    blocks, total, n = block_sizes(left, right, lkeys, rkeys, size)
    if total <= TASK_PAIRS:
        return left.withColumn("_salt", F.lit(0)), right.withColumn("_salt", F.lit(0))
    names = [f"_b{i}" for i in range(len(lkeys))]
    hot = sized(blocks.where(F.col("_n") > TASK_PAIRS).select(*names, F.ceil(F.col("_n") / TASK_PAIRS).cast("int").alias("_salts")))
    salts = lambda df, keys: df.join(hot, reduce(lambda a, b: a & b, [F.col(k) == F.col(b) for k, b in zip(keys, names, strict=True)]), "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))
    a = salts(left, lkeys).withColumn("_salt", F.pmod(F.xxhash64(by), F.col("_salts")).cast("int"))
    b = salts(right, rkeys).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    return a.drop("_salts", *names).repartition(n, *lkeys, "_salt"), b.drop("_salts", *names).repartition(n, *rkeys, "_salt")


def null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Nulls of keys equal each other; keys come from the left."""
    r = right.select(*[F.col(c).alias(f"_k_{c}") if c in on else F.col(c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [left[c].eqNullSafe(r[f"_k_{c}"]) for c in on])
    return left.join(r, same, how).drop(*[f"_k_{c}" for c in on])


def one_to_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """A join that fails if a key occurs twice on a side."""
    for name, df in (("left", left), ("right", right)):
        twice = df.groupBy(*on).count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"key {twice[0].asDict()} occurs twice on the {name} side")
    return left.join(right, on, how)


def full_with_zeros(left: DataFrame, right: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """A full outer join with one column for each key and 0 for values that are missing."""
    return left.join(right, on, "full").fillna(0, values)


def multi_rule_pairs(records: DataFrame, id_: str, rules: list[list[str]], where: Column | None = None, near: tuple[str, DataFrame] | None = None, take: list[Column] = ()) -> DataFrame:
    """Pairs lid < rid that agree on all columns of at least one rule, once each.

    Each rule is an equi join, so an OR never becomes a nested loop; a pair comes from the first rule on which it agrees, so pairs
    aren't shuffled to find doubles (but for records whose ids repeat). where: on columns l.* and r.*. near: a column and the
    pairs (_x, _y) of its values that a left and a right row may have; they become part of each rule's equality. take: further
    columns of a pair, of l.* and r.*."""
    l, r = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    agree = lambda rule: reduce(lambda x, y: x & y, [F.coalesce(l(c) == r(c), F.lit(False)) for c in rule])
    out = None
    for i, rule in enumerate(rules):
        a = records if near is None else records.join(sized(near[1].withColumnsRenamed({"_x": near[0], "_y": "_y"})), near[0])
        a, b = spread(a, records, [*rule, *(["_y"] if near else [])], [*rule, *([near[0]] if near else [])], id_)
        a, b = a.alias("l"), b.alias("r")
        on = reduce(lambda x, y: x & y, [l(c) == r(c) for c in rule] + ([l("_y") == r(near[0])] if near else []) + [l("_salt") == r("_salt"), l(id_) < r(id_)])
        if where is not None:
            on = on & where
        for earlier in rules[:i]:
            on = on & ~agree(earlier)
        hits = a.join(b, on).select(l(id_).alias("lid"), r(id_).alias("rid"), *take)
        out = hits if out is None else out.union(hits)
    twice = records.groupBy(id_).count().where("count > 1").limit(1).count()
    return out.distinct() if twice else out


def fuzzy_join(left: DataFrame, right: DataFrame, lkey: str, rkey: str, prefix: int = 2, slack: int = 3, least: float = 0.92) -> DataFrame:
    """Pairs of strings with the same first letters and about the same length whose Jaro-Winkler
    similarity reaches ``least``. Works on distinct strings."""
    a = left.select(F.col(lkey)).where(F.col(lkey).isNotNull()).distinct()
    b = right.select(F.col(rkey)).where(F.col(rkey).isNotNull()).distinct()
    near = a.join(b, (F.substring(lkey, 1, prefix) == F.substring(rkey, 1, prefix)) & (F.abs(F.length(lkey) - F.length(rkey)) <= slack))
    return near.withColumn("similarity", text.jaro_winkler(F.col(lkey), F.col(rkey))).where(F.col("similarity") >= least)


def ladder_join(left: DataFrame, right: DataFrame, lid: str, keys: list[str], value: str) -> DataFrame:
    """(lid, value, rung) for the first key of the ladder on which a row of left meets right.

    The rung is found from the keys alone; only hits on it are made, and only ids with several keys on it can have doubles.
    Hits are made from arrays, so that runs of them share an id, and the values of one run are those of the next: writers encode them in few bytes."""
    from .. import cut

    told = left.select(lid, *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    for i, k in enumerate(keys):
        told = told.join(sized(right.select(F.col(k).alias(f"_k{i}")).where(F.col(f"_k{i}").isNotNull()).distinct().withColumn(f"_s{i}", F.col(f"_k{i}").cast("string"))), f"_k{i}", "left")
    met = F.filter(F.array(*[F.when(F.col(f"_s{i}").isNotNull(), F.struct(F.lit(i).alias("rung"), F.col(f"_s{i}").alias("k"))) for i in range(len(keys))]), lambda x: x.isNotNull())
    best = told.select(lid, F.explode(met).alias("_m")).groupBy(lid).agg(F.collect_set("_m").alias("_m"), F.min("_m.rung").alias("rung"))
    best = cut(best.select(lid, "rung", F.transform(F.filter("_m", lambda x: x["rung"] == F.col("rung")), lambda x: x["k"]).alias("_k")))
    values = None
    for i, k in enumerate(keys):
        v = right.select(F.lit(i).alias("rung"), F.col(k).cast("string").alias("_k"), value).where("_k is not null").distinct()
        values = v if values is None else values.union(v)
    values = cut(values)
    few = values.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    def hits(rows):
        on = ["rung", "_k"]
        a, b, n = gathered(rows, values, on, lid, value)
        if few:
            # each task meets the whole of right
            met = a.repartition(n).join(F.broadcast(b), on)
        else:
            a, b = spread(a.withColumn("_size", F.size(lid)), b.withColumn("_size", F.size(value)), on, on, "_part", "_size")
            met = a.join(b, [*on, "_salt"])
        # generated code holds all rows that it makes of one row; coalesce ends its stage, so these are CHUNK at most, about
        ids = met.coalesce(n).select(F.explode(lid).alias(lid), value, "rung").coalesce(n)
        return ids.select(lid, F.explode(value).alias(value), "rung")

    one = hits(best.where(F.size("_k") == 1).select(lid, "rung", F.col("_k")[0].alias("_k")))
    several = best.where(F.size("_k") > 1).select(lid, "rung", F.explode("_k").alias("_k"))
    return one.unionByName(hits(several).distinct()) if several.limit(1).count() else one


def keep_satisfied(df: DataFrame, by: list[str], ok: Column) -> DataFrame:
    """A hard constraint with a way out: rows that satisfy it, or all rows of a key where none does."""
    groups = df.groupBy(*by).agg(F.max(ok.cast("int")).alias("_any"))
    return df.withColumn("_ok", F.coalesce(ok, F.lit(False))).join(groups, by).where((F.col("_any") == 0) | F.col("_any").isNull() | F.col("_ok")).drop("_ok", "_any")


def closure(edges: DataFrame, child: str, parent: str, levels: int = 20) -> DataFrame:
    """child, ancestors (nearest first), depth: by doubling, so ``levels`` takes log2(levels) joins at most.

    Each doubling is written once, and the first that lengthens no path is the last. Edges from a node to itself are dropped, each child has one parent, and cycles end at ``levels``."""
    from .. import cut

    own = edges.where(F.col(child) != F.col(parent)).groupBy(child).agg(F.min(parent).alias("_p"))
    paths = cut(own.select(F.col(child).alias("_c"), F.array("_p").alias("_a")))
    reach = 1
    while reach < levels:
        up = paths.select(F.col("_c").alias("_t"), F.col("_a").alias("_more"))
        longer = F.slice(F.array_distinct(F.concat("_a", F.coalesce("_more", F.array().cast("array<bigint>")))), 1, levels)
        paths = cut(paths.join(up, F.element_at("_a", -1) == F.col("_t"), "left").select("_c", longer.alias("_a"), (F.size(longer) > F.size("_a")).alias("_grew")))
        if not paths.where("_grew").limit(1).count():
            break
        paths = paths.drop("_grew")
        reach *= 2
    clean = F.filter("_a", lambda x: x != F.col("_c"))
    return paths.select(F.col("_c").alias(child), clean.alias("ancestors"), F.size(clean).alias("depth"))


def as_of(left: DataFrame, right: DataFrame, on: list[str], ltime: str, rtime: str, values: list[str]) -> DataFrame:
    """left with values of the last row of right at or before ltime: one union and one window, no range join."""
    from pyspark.sql import Window

    a = left.select("*", F.col(ltime).alias("_t"), F.lit(1).alias("_side"), *[F.lit(None).cast(right.schema[v].dataType).alias(f"_v_{v}") for v in values])
    b = right.select(*on, F.col(rtime).alias("_t"), F.lit(0).alias("_side"), *[F.col(v).alias(f"_v_{v}") for v in values])
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*on).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = both.withColumn("_last", F.last(F.when(F.col("_side") == 0, F.struct(*[f"_v_{v}" for v in values])), ignorenulls=True).over(w))
    return filled.where("_side = 1").select(*left.columns, *[F.col(f"_last._v_{v}").alias(v) for v in values])
