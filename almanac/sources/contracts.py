"""Checks of tables that fail loudly; each is one aggregate pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    pass


def structure(df: DataFrame, ids: list[str], texts: list[str], bad_ids: float = 0.01, numeric_texts: float = 0.5) -> DataFrame:
    """A row for each column: kind, bad share, ok. Ids must parse as numbers, texts must not be mostly numbers."""
    share = lambda c, wrong: F.coalesce(F.avg(F.when(F.col(c).isNotNull(), wrong.cast("int"))), F.lit(0.0))
    number = lambda c: F.col(c).try_cast("bigint")
    one = df.agg(*[share(c, number(c).isNull()).alias(f"i{i}") for i, c in enumerate(ids)], *[share(c, number(c).isNotNull()).alias(f"t{i}") for i, c in enumerate(texts)])
    cells = [F.struct(F.lit(c).alias("column"), F.lit("id").alias("kind"), F.col(f"i{i}").alias("bad"), (F.col(f"i{i}") <= bad_ids).alias("ok")) for i, c in enumerate(ids)]
    cells += [F.struct(F.lit(c).alias("column"), F.lit("text").alias("kind"), F.col(f"t{i}").alias("bad"), (F.col(f"t{i}") <= numeric_texts).alias("ok")) for i, c in enumerate(texts)]
    return one.select(F.inline(F.array(*cells)))


def domains(df: DataFrame, known: dict[str, list[str]], least: float = 0.8) -> DataFrame:
    """A row for each column: the share of (trimmed) values that are documented, ok."""
    one = df.agg(*[F.coalesce(F.avg(F.when(F.col(c).isNotNull(), F.trim(F.col(c)).isin(*v).cast("int"))), F.lit(1.0)).alias(f"d{i}") for i, (c, v) in enumerate(known.items())])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("covered"), (F.col(f"d{i}") >= least).alias("ok")) for i, c in enumerate(known)])))


def require(report: DataFrame, what: str) -> None:
    """Fails on the first row of a report that isn't ok."""
    bad = report.where(~F.col("ok")).limit(1).collect()
    if bad:
        raise ContractError(f"{what}: {bad[0].asDict()}")


def same_rows(before: DataFrame, after: DataFrame, columns: list[str]) -> None:
    """Cardinality and columns are kept: every row of before, as often as there, is in after."""
    a, b = (df.groupBy(F.xxhash64(*columns).alias("h")).count() for df in (before, after))
    if a.join(b.withColumnRenamed("count", "n"), "h", "full").where("count is null or n is null or count != n").limit(1).count():
        raise ContractError("rows were lost, added or changed")


def together(df: DataFrame, columns: list[str]) -> None:
    """Columns are null together."""
    first = F.col(columns[0]).isNull()
    wrong = F.lit(False)
    for c in columns[1:]:
        wrong |= F.col(c).isNull() != first
    if df.where(wrong).limit(1).count():
        raise ContractError(f"{columns} are not null together")


def refers(df: DataFrame, column: str, table: DataFrame, key: str) -> None:
    """Every value of column is in table."""
    if df.where(F.col(column).isNotNull()).join(table.select(F.col(key).alias(column)).distinct(), column, "left_anti").limit(1).count():
        raise ContractError(f"{column} has values that {key} doesn't")


def holds(df: DataFrame, condition: Column, what: str) -> None:
    if df.where(~condition).limit(1).count():
        raise ContractError(what)


def unique(df: DataFrame, columns: list[str]) -> None:
    if df.groupBy(*columns).count().where("count > 1").limit(1).count():
        raise ContractError(f"{columns} is not a key")


def deterministic(make, columns: list[str]) -> None:
    """make() twice gives the same rows."""
    same_rows(make(), make(), columns)
