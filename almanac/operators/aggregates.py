"""Aggregates with defined ties, shares, pivots and top lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType


def mode_smallest(df: DataFrame, by: list[str], value: str, name: str = "mode") -> DataFrame:
    """The most frequent value of each key; of several the smallest; nulls don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).count()
    return counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("count"), F.col(value))).alias(name))


def share(condition: Column) -> Column:
    """The share of rows where condition holds, of those where it isn't null."""
    return F.avg(condition.cast("int"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """over rows where both are known."""
    known = value.isNotNull() & weight.isNotNull()
    return F.try_divide(F.sum(F.when(known, value * weight)), F.sum(F.when(known, weight)))


def first_by(value: str, order: list[Column]) -> Column:
    """value of the first row in order."""
    return F.min_by(value, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))


def top_lists(df: DataFrame, by: list[str], order: list, columns: list[str], n: int) -> DataFrame:
    """Parallel lists of the first n rows of each key, in order."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n)
    rows = ranked.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_n", *columns))).alias("_l"))
    return rows.select(*by, *[F.col("_l").getField(c).alias(c) for c in columns])


def pivot_shares(df: DataFrame, row: str, column: str, values: list, weight: str | None = None, by: str = "column") -> DataFrame:
    """row x values with 0 for missing cells, and the shares of each cell in its column (or row)."""
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    wide = df.groupBy(row).pivot(column, values).agg(amount).fillna(0)
    if by == "row":
        total = reduce(lambda a, b: a + b, [F.col(str(v)) for v in values])
        return wide.select(row, *[F.try_divide(F.col(str(v)).cast("double"), total).alias(str(v)) for v in values])
    sums = wide.agg(*[F.sum(str(v)).alias(f"_s{i}") for i, v in enumerate(values)])
    return wide.join(F.broadcast(sums), F.lit(True)).select(row, *[F.try_divide(F.col(str(v)).cast("double"), F.col(f"_s{i}")).alias(str(v)) for i, v in enumerate(values)])


def top_and_other(df: DataFrame, label: str, weight: str, n: int, means: list[str] = (), other: str = "Other") -> DataFrame:
    """The n labels with the largest weight and one row for all others; means are weighted anew."""
    sums = df.groupBy(label).agg(F.sum(weight).alias(weight), *[F.sum(F.col(weight) * F.col(m)).alias(m) for m in means])
    # the n largest only are numbered: no window over all labels
    top = sums.orderBy(F.desc(weight), F.asc(label)).limit(n).select(label)
    marked = sums.join(F.broadcast(top.withColumn("_top", F.lit(True))), label, "left").withColumn(label, F.when(F.col("_top"), F.col(label)).otherwise(other))
    return marked.groupBy(label).agg(F.sum(weight).alias(weight), *[(F.sum(m) / F.sum(weight)).alias(m) for m in means])


def union_relaxed(frames: list[DataFrame]) -> DataFrame:
    """All rows by column name: missing columns are null; a column with text in one frame is text in all."""
    kinds: dict[str, list] = {}
    for df in frames:
        for f in df.schema.fields:
            kinds.setdefault(f.name, []).append(f.dataType)

    def common(types: list):
        if len({t.simpleString() for t in types}) == 1:
            return types[0]
        return "double" if all(isinstance(t, NumericType) for t in types) else StringType()

    to = {c: common(t) for c, t in kinds.items()}
    cast = [df.select(*[F.col(c).cast(to[c]).alias(c) for c in df.columns]) for df in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def sum_of(columns: list[str]) -> Column:
    """The sum of columns in a row, null as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in columns])


def fill_mean(df: DataFrame, column: str, default: float = 0.0) -> DataFrame:
    """Null in a column becomes the mean over all rows, or ``default`` where there is none; one aggregate, one number."""
    mean = df.agg(F.avg(column).alias("m")).first()["m"]
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(default if mean is None else mean)))


def key_share(df: DataFrame, key: str, name: str = "share") -> DataFrame:
    """key and the share of rows that have it, of those with a key."""
    total = df.agg(F.count(key).alias("_t"))
    return df.where(F.col(key).isNotNull()).groupBy(key).count().join(F.broadcast(total), F.lit(True)).select(key, (F.col("count") / F.col("_t")).alias(name))
