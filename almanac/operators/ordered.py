"""Operators whose result depends on row order; each takes the order as explicit columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import sized


def window(by: list[str], order: list):
    return Window.partitionBy(*by).orderBy(*order)


def forward_fill(c: Column, by: list[str], order: list, limit: int | None = None) -> Column:
    """The last value that isn't null, from the row itself or at most ``limit`` rows before."""
    start = Window.unboundedPreceding if limit is None else -limit
    return F.last(c, ignorenulls=True).over(window(by, order).rowsBetween(start, Window.currentRow))


def fill_across(df: DataFrame, name: str, c: Column, block: str, order: list, limit: int | None = None) -> DataFrame:
    """df with ``name``: forward_fill() of c over the whole sequence (block, then order within it), without one task for all rows.

    Each block fills itself; a block's rows before its first value take the last one of the blocks before it, if that lies at most
    ``limit`` rows back. Only one row for each block (its number of rows, and its last value's place) meets in one window."""
    own, whole = window([block], order), Window.orderBy(block)
    told = df.withColumns({"_v": c, "_i": F.row_number().over(own)})
    last = F.max(F.when(F.col("_v").isNotNull(), F.struct(F.col("_i").alias("i"), F.col("_v").alias("v"))))
    ends = told.groupBy(block).agg(F.count(F.lit(1)).alias("_n"), last.alias("_last"))
    starts = ends.withColumn("_before", F.sum("_n").over(whole) - F.col("_n"))
    carried = F.last(F.when(F.col("_last").isNotNull(), F.struct((F.col("_before") + F.col("_last.i")).alias("i"), F.col("_last.v").alias("v"))), ignorenulls=True)
    starts = starts.select(F.col(block).alias("_b"), "_before", carried.over(whole.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    both = told.withColumn("_near", F.last(F.when(F.col("_v").isNotNull(), F.struct(F.col("_i").alias("i"), F.col("_v").alias("v"))), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    both = both.join(sized(starts), F.col(block).eqNullSafe(F.col("_b")))
    at, from_ = F.col("_before") + F.col("_i"), F.when(F.col("_near").isNotNull(), F.col("_before") + F.col("_near.i")).otherwise(F.col("_carry.i"))
    value = F.when(F.col("_near").isNotNull(), F.col("_near.v")).otherwise(F.col("_carry.v"))
    filled = value if limit is None else F.when(at - from_ <= limit, value)
    return both.withColumn(name, filled).drop("_v", "_i", "_b", "_before", "_carry", "_near")


def without_marks(c: Column, marks) -> Column:
    """Null where c is one of the marks that repeat the line above."""
    return F.when(c.isin(*marks), None).otherwise(c)


def ditto_fill(c: Column, marks, by: list[str], order: list, limit: int | None = None, keep_nulls: bool = False) -> Column:
    """Marks take the value above; keep_nulls: null values stay null and are not filled over."""
    if not keep_nulls:
        return forward_fill(without_marks(c, marks), by, order, limit)
    return real_nulls(forward_fill(without_marks(stand_ins(c), marks), by, order, limit))


def stand_ins(c: Column) -> Column:
    """c with a sign in place of null, so that a fill stops there; real_nulls() turns it back."""
    return F.coalesce(c, F.lit("\0"))


def real_nulls(c: Column) -> Column:
    return F.nullif(c, F.lit("\0"))


def best_per_key(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each key; order has to be total for one result."""
    return df.withColumn("_n", F.row_number().over(window(by, order))).where("_n = 1").drop("_n")


def first_rows(df: DataFrame, by: list[str], order: list, n: int, hit: str | None = None) -> DataFrame:
    """The first n rows of each key; hit: a column that tells whether the key had more."""
    w = window(by, order)
    out = df.withColumn("_n", F.row_number().over(w))
    if hit:
        out = out.withColumn(hit, F.count(F.lit(1)).over(Window.partitionBy(*by)) > n)
    return out.where(F.col("_n") <= n).drop("_n")


def margin(score: str, by: list[str], order: list, cap: float = 10.0) -> Column:
    """By how much a row's score leads over the next one of its key; ``cap`` without a next and at most."""
    return F.least(F.coalesce(F.col(score) - F.lead(score).over(window(by, order)), F.lit(cap)), F.lit(cap))


def record_id(df: DataFrame, order: list, name: str = "record_id") -> DataFrame:
    """Row numbers from 0 in a total order, without gathering the rows in one task.

    Ranges are sorted apart and written once, as their bounds are sampled; how many rows each has (a number for each range) gives their starts."""
    from .. import cut

    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}))
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    starts = sizes.select("_p", "_first", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_start"))
    return ranged.join(F.broadcast(starts), "_p").withColumn(name, F.col("_start") + F.col("_i") - F.col("_first")).drop("_p", "_i", "_first", "_start")


def repair_misread(df: DataFrame, value: str, by: list[str], order: list) -> DataFrame:
    """A value outside its neighbours' range becomes the next one's, where the neighbours don't fall."""
    w = window(by, order)
    before, after = F.coalesce(F.lag(value).over(w), F.col(value)), F.coalesce(F.lead(value).over(w), F.col(value))
    outside = (before <= after) & ~F.col(value).between(before, after)
    return df.withColumn(value, F.when(outside, after).otherwise(F.col(value)))


def steps_of_one(df: DataFrame, value: str, by: list[str], order: list) -> DataFrame:
    """The first row of each key, and those whose value is one more than that of the row before."""
    w = window(by, order)
    told = df.withColumns({"_n": F.row_number().over(w), "_b": F.lag(value).over(w)})
    return told.where((F.col("_n") == 1) | (F.col(value) == F.col("_b") + 1)).drop("_n", "_b")


def anchored(df: DataFrame, anchors: DataFrame, on: list[str], value: str, by: list[str], order: list) -> DataFrame:
    """value from anchors where a row has one, else from the row before."""
    joined = df.join(sized(anchors.select(*on, F.col(value).alias("_a"))), on, "left")
    own = F.coalesce(F.col(value), F.col("_a")) if value in df.columns else F.col("_a")
    return joined.withColumn(value, forward_fill(own, by, order)).drop("_a")


def gap_spells(df: DataFrame, by: list[str], time: str, order: list, gap: float) -> DataFrame:
    """spell (from 1 in each key): a new one starts where more than ``gap`` seconds lie between two rows."""
    w = window(by, order)
    at = F.col(time).cast("timestamp").cast("double")
    new = (at - F.lag(at).over(w) > gap).cast("int")
    return df.withColumn("spell", F.sum(F.coalesce(new, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + 1)
