"""Exact dedup by skew-safe combining.

Three stages, each comparing digest and full normalised text:

1. local: map-side partial aggregation joins the copies that one task sees;
2. salted: groups of one digest meet per salt. A digest held by more than ``bound`` rows is
   spread over ceil(rows / bound) salts, so that no task and no member list grows with a group;
3. global: the winners of the salts of those hot digests are combined, and the result goes back
   to the salted groups: broadcast while there are at most FEW hot digests (they are counted), joined beyond.

Members travel as a list inside their salted group, so nothing is joined back to the texts.

Defined cases: null text counts as empty; empty texts equal each other; of equal texts the row with
the smallest id stays (null ids last); of repeated rows with that id exactly one stays; an empty
table gives no rows; extra columns are carried if asked for, and clashing names are kept apart
because members travel in one struct."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut

#: Rows of one digest that may meet in one group, at every size of the input.
BOUND = 4096
#: Hot digests up to which their table, some 100 bytes a row, is broadcast.
FEW = 100_000


def exact_dedup(
    docs: DataFrame, text: str = "text", key: str = "doc_id", carry: list[str] | None = None, bound: int | None = None, only_kept: bool = False
) -> DataFrame:
    """carry and ``keep_id, group_size, kept, text_sha256``, one row for each row of docs.

    carry: columns of docs that are returned (default: the key only); text may be one of them.
    only_kept: the rows that stay, with the columns of carry alone."""
    carry = [key] if carry is None else carry
    bound = bound or BOUND
    norm = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")
    base = docs.select(
        norm.alias("_norm"),
        F.col(key).alias("_id"),
        F.struct(
            F.lit(1).alias("_"),
            *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry) if c != text],
            *([F.when(~F.col(text).eqNullSafe(norm), F.col(text)).alias("own"), F.col(text).isNull().alias("none")] if text in carry else []),
        ).alias("_row"),
    ).withColumn("_sha", F.sha2("_norm", 256))

    hot = cut(
        base.groupBy("_sha").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > bound)
        .select("_sha", F.ceil(F.col("_n") / bound).cast("int").alias("_salts"))
    )
    few = hot.limit(FEW + 1).count() <= FEW
    hinted = F.broadcast if few else (lambda df: df)
    salted = base.join(hinted(hot), "_sha", "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_salts")), F.lit(0)).cast("int")
    )
    groups = salted.groupBy("_sha", "_norm", "_salt").agg(
        F.min("_id").alias("_low"),
        F.count(F.lit(1)).alias("_size"),
        F.collect_list(F.struct(F.col("_id"), F.col("_row"))).alias("_members"),
    )

    winners = (
        salted.where(F.col("_salts").isNotNull())
        .groupBy("_sha", "_norm", "_salt")
        .agg(F.min("_id").alias("_low"), F.count(F.lit(1)).alias("_size"))
        .groupBy("_sha", "_norm")
        .agg(F.min(F.struct(F.col("_low").isNull().alias("no"), F.col("_low").alias("low"), F.col("_salt").alias("salt"))).alias("_first"), F.sum("_size").alias("_total"))
        # the text is told apart again only where one digest stands for two texts
        .withColumn("_texts", F.count(F.lit(1)).over(Window.partitionBy("_sha")))
        .select("_sha", F.when(F.col("_texts") > 1, F.col("_norm")).alias("_other"), "_first", "_total")
    )
    g, w = groups.alias("g"), hinted(winners).alias("w")
    whole = g.join(w, (F.col("g._sha") == F.col("w._sha")) & (F.col("w._other").isNull() | (F.col("w._other") == F.col("g._norm"))), "left").select(
        F.col("g._sha").alias("_sha"), "_norm", "_members",
        F.when(F.col("_first").isNull(), F.col("_low")).otherwise(F.col("_first.low")).alias("keep_id"),
        F.coalesce("_total", "_size").alias("group_size"),
        F.coalesce(F.col("_first.salt") == F.col("_salt"), F.lit(True)).alias("_here"),
    )
    # null ids sort last: the row that stays is the first member of the winning salt
    ordered = F.array_sort("_members", lambda a, b: F.when(a["_id"].eqNullSafe(b["_id"]), 0).when(a["_id"].isNull(), 1).when(b["_id"].isNull(), -1).when(a["_id"] < b["_id"], -1).otherwise(1))
    out = whole.select("_sha", "_norm", "keep_id", "group_size", "_here", F.posexplode(F.when(F.size("_members") > 1, ordered).otherwise(F.col("_members"))).alias("_at", "_m"))
    back = {c: F.col(f"_m._row.c{i}") for i, c in enumerate(carry) if c != text}
    if text in carry:
        back[text] = F.when(~F.col("_m._row.none"), F.coalesce("_m._row.own", "_norm"))
    if only_kept:
        return out.where(F.col("_here") & (F.col("_at") == 0)).select(*[back[c].alias(c) for c in carry])
    return out.select(
        *[back[c].alias(c) for c in carry],
        "keep_id", "group_size", (F.col("_here") & (F.col("_at") == 0)).alias("kept"), F.col("_sha").alias("text_sha256"),
    )
