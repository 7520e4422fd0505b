"""URL filters: rules first, then a ratio of character language models. DataFrame operations only.

Rules name a host (with all its subdomains) and a path prefix; the longest that fits decides. URLs
with a rule are the labelled rows: from all of them, a smoothed variable-order Markov model is made
for accepted and one for rejected URLs. Order 2 backs off to order 1 and 0 by Witten-Bell weights, so
a context counts as far as it was seen. The alphabet has 32 symbols, so the table of log-ratios has
32^3 = 32,768 numbers whatever the input; it goes to the tasks as one array literal, and scoring needs
no shuffle or join. A URL is accepted if its mean log-ratio per symbol reaches the calibrated
threshold, the midpoint of the labelled classes' means. Log-ratios and threshold are whole millionths,
so that sums don't depend on their order.

Defined cases: null URLs and those without :// have empty host and path, no rule, and the score 0;
without labelled rows of a class its model is uniform and the threshold 0; repeated rows are judged
each; an empty table gives no rows; other columns are not read."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_ascii

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
#: Symbol 0 is any other character, 1 the start; digits are one symbol.
LETTERS = "abcdefghijklmnopqrstuvwxyz0-./"
SYMBOLS = 2 + len(LETTERS)
UNIT = 1_000_000


def parts(url: Column) -> tuple[Column, Column]:
    rest = F.when(url.contains("://"), F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _code(c: Column) -> Column:
    at = F.call_function("instr", F.lit(LETTERS), c)
    return F.when(at > 0, at + 1).otherwise(0)


def codes(host: Column, path: Column) -> Column:
    """The symbols of host and path after two starts."""
    canonical = F.translate(lower_ascii(F.concat(host, path)), "123456789", "000000000")
    each = F.filter(F.split(canonical, ""), lambda c: c != "")
    return F.concat(F.array(F.lit(1), F.lit(1)), F.transform(each, _code))


def grams(symbols: Column) -> Column:
    """The table index of each symbol with the two before it."""
    n = F.size(symbols)
    at = lambda i: F.element_at(symbols, i)
    return F.when(n > 2, F.transform(F.sequence(F.lit(3), n), lambda i: (at(i - 2) * SYMBOLS + at(i - 1)) * SYMBOLS + at(i))).otherwise(F.array().cast("array<int>"))


def log_ratios(labelled: DataFrame) -> DataFrame:
    """index, ratio: a row for each of the SYMBOLS^3 grams. labelled: verdict, gram."""
    spark = labelled.sparkSession
    counted = cut(labelled.groupBy("verdict", "gram").agg(F.count(F.lit(1)).alias("n")))  # 2 * SYMBOLS^3 rows at most, read six times
    split = counted.select(
        "verdict", "n", (F.col("gram") % SYMBOLS).alias("c"), (F.floor(F.col("gram") / SYMBOLS) % SYMBOLS).alias("b"), F.floor(F.col("gram") / SYMBOLS**2).alias("a")
    )
    all_ = (
        spark.range(SYMBOLS**3)
        .select("id", (F.col("id") % SYMBOLS).alias("c"), (F.floor(F.col("id") / SYMBOLS) % SYMBOLS).alias("b"), F.floor(F.col("id") / SYMBOLS**2).alias("a"))
        .withColumn("verdict", F.explode(F.array(F.lit("allow"), F.lit("block"))))
    )

    def order(context: list[str]) -> tuple[DataFrame, DataFrame]:
        seen = split.groupBy("verdict", *context, "c").agg(F.sum("n").alias("n"))
        i = len(context)
        return seen.withColumnRenamed("n", f"n{i}"), seen.groupBy("verdict", *context).agg(F.sum("n").alias(f"s{i}"), F.count(F.lit(1)).alias(f"t{i}"))

    out = all_
    for context in ([], ["b"], ["a", "b"]):
        seen, totals = order(context)
        out = out.join(F.broadcast(seen), ["verdict", *context, "c"], "left").join(F.broadcast(totals), ["verdict", *context], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    p = (zero("n0") + 1) / (zero("s0") + SYMBOLS)
    for i in (1, 2):
        total = zero(f"s{i}") + zero(f"t{i}")
        p = F.when(total > 0, (zero(f"n{i}") + zero(f"t{i}") * p) / total).otherwise(p)
    each = out.select("id", "verdict", F.ln(p).alias("p"))
    return each.groupBy("id").agg(
        F.round((F.sum(F.when(F.col("verdict") == "allow", F.col("p"))) - F.sum(F.when(F.col("verdict") == "block", F.col("p")))) * UNIT).cast("long").alias("ratio")
    )


def judge(pages: DataFrame, url: str = "url", key: str = "page_id", rules=RULES) -> DataFrame:
    """key, host, path, rule, verdict, score (mean log-ratio per symbol)."""
    host, path = parts(F.col("url"))
    split = pages.select(F.col(key).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    name, by_rule = rule(F.col("host"), F.col("path"), rules)
    ruled = split.withColumns({"rule": name, "by_rule": by_rule})
    read = ruled.withColumn("symbols", codes(F.col("host"), F.col("path"))).withColumn("grams", grams(F.col("symbols")))

    labelled = read.where(F.col("by_rule").isNotNull())
    table = log_ratios(labelled.select(F.col("by_rule").alias("verdict"), F.explode("grams").alias("gram")))
    ratios = table.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "ratio"))), lambda x: x["ratio"]).alias("r")).first()["r"]  # SYMBOLS^3 numbers
    fixed = F.from_json(F.lit(json.dumps(ratios)), "array<bigint>")
    scored = lambda df: df.withColumns({
        "total": F.aggregate("grams", F.lit(0).cast("long"), lambda s, g: s + F.element_at(fixed, g + 1)), "long": F.size("grams")
    })
    mean = F.when(F.col("long") > 0, F.floor(F.col("total") / F.col("long"))).otherwise(0)
    means = scored(labelled).groupBy("by_rule").agg(F.sum(mean).alias("s"), F.count(F.lit(1)).alias("n")).collect()  # two rows at most
    threshold = sum(r["s"] / r["n"] for r in means) / 2 if len(means) == 2 else 0.0
    threshold = int(threshold // 1)
    return scored(read).select(
        F.col("page_id").alias(key), "host", "path", "rule",
        F.coalesce("by_rule", F.when(mean >= threshold, "allow").otherwise("block")).alias("verdict"),
        (mean / UNIT).alias("score"),
    )
