"""Queries of the engine's own operators over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, geo, text
from ..operators import aggregates, joins, linkage, ordered, panel
from ..sources import contracts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- panels and aggregates


@query("""
WITH f AS (SELECT c_nationkey AS origin, o_orderpriority AS dest, year(o_orderdate) AS period, count(*) AS flow
           FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
     o AS (SELECT n_nationkey AS origin FROM nation), d AS (SELECT DISTINCT o_orderpriority AS dest FROM orders), p AS (SELECT DISTINCT year(o_orderdate) AS period FROM orders)
SELECT origin, dest, period, coalesce(flow, 0) AS flow, round(coalesce(flow, 0) / sum(coalesce(flow, 0)) OVER (PARTITION BY origin, period), 9) AS share
FROM o CROSS JOIN d CROSS JOIN p LEFT JOIN f USING (origin, dest, period)
""")
def od_grid(spark, d):
    flows = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("origin"), F.col("o_orderpriority").alias("dest"), F.year("o_orderdate").alias("period")
    )
    grid = panel.od_grid(flows, "origin", "dest", "period", t(spark, d, "nation").select(F.col("n_nationkey").alias("origin")), flows.select("dest").distinct(), flows.select("period").distinct())
    return grid.withColumn("share", F.round(F.try_divide(F.col("flow"), F.sum("flow").over(Window.partitionBy("origin", "period"))), 9))


@query("""
WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_suppkey, l_returnflag AS flag FROM c QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag) = 1
""")
def mode_smallest(spark, d):
    return aggregates.mode_smallest(t(spark, d, "lineitem"), ["l_suppkey"], "l_returnflag", "flag")


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER w AS n, o_totalprice - lead(o_totalprice) OVER w AS m
           FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey))
SELECT o_custkey, o_orderkey, round(least(coalesce(m, 10), 10), 6) AS margin FROM r WHERE n = 1
""")
def best_per_key(spark, d):
    o, order = t(spark, d, "orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")]
    led = o.withColumn("margin", F.round(ordered.margin("o_totalprice", ["o_custkey"], order), 6))
    return ordered.best_per_key(led, ["o_custkey"], order).select("o_custkey", "o_orderkey", "margin")


@query("""
WITH s AS (SELECT p_brand AS label, sum(l_quantity) AS weight, sum(l_quantity * l_discount) AS x FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
     r AS (SELECT *, row_number() OVER (ORDER BY weight DESC, label) AS n FROM s)
SELECT CASE WHEN n <= 5 THEN label ELSE 'Other' END AS label, sum(weight) AS weight, round(sum(x) / sum(weight), 9) AS discount FROM r GROUP BY 1
""")
def top_and_other(spark, d):
    rows = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("label"), F.col("l_quantity").alias("weight"), F.col("l_discount").alias("discount"))
    return aggregates.top_and_other(rows, "label", "weight", 5, ["discount"]).withColumn("discount", F.round("discount", 9))


@query("""
WITH w AS (SELECT p_type, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r
           FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT p_type, round(a / sum(a) OVER (), 9) AS "A", round(n / sum(n) OVER (), 9) AS "N", round(r / sum(r) OVER (), 9) AS "R" FROM w
""")
def pivot_column_shares(spark, d):
    rows = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    out = aggregates.pivot_shares(rows, "p_type", "l_returnflag", ["A", "N", "R"])
    return out.select("p_type", *[F.round(c, 9).alias(c) for c in ("A", "N", "R")])


@query("""
WITH w AS (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1)
SELECT o_orderpriority, round(f / (f + o + p), 9) AS "F", round(o / (f + o + p), 9) AS "O", round(p / (f + o + p), 9) AS "P" FROM w
""")
def pivot_row_shares(spark, d):
    out = aggregates.pivot_shares(t(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"], by="row")
    return out.select("o_orderpriority", *[F.round(c, 9).alias(c) for c in ("F", "O", "P")])


@query("""
SELECT n_name, count(*) AS n, count(DISTINCT c_mktsegment) AS segments, round(avg(c_acctbal), 6) AS mean, min(c_acctbal) AS low, max(c_acctbal) AS high,
       bool_or(c_acctbal < 0) AS any_debt, round(avg((c_acctbal < 0)::int), 9) AS debt_share, count(*) FILTER (c_mktsegment = 'BUILDING') AS building,
       round(sum(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END), 4) AS assets
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 1
""")
def conditional_aggregates(spark, d):
    rows = t(spark, d, "customer").join(F.broadcast(t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    debt = F.col("c_acctbal") < 0
    return rows.groupBy("n_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("c_mktsegment").alias("segments"), F.round(F.avg("c_acctbal"), 6).alias("mean"), F.min("c_acctbal").alias("low"),
        F.max("c_acctbal").alias("high"), F.bool_or(debt).alias("any_debt"), F.round(aggregates.share(debt), 9).alias("debt_share"),
        F.count_if(F.col("c_mktsegment") == "BUILDING").alias("building"), F.round(F.sum(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).otherwise(0)), 4).alias("assets"),
    ).where("n > 1")


@query("""SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS mean_discount FROM lineitem GROUP BY 1""")
def weighted_mean(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(aggregates.weighted_mean(F.col("l_discount"), F.col("l_quantity")), 9).alias("mean_discount"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders)
SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY n), ' | ') AS orders, count(*) AS n FROM r WHERE n <= 4 GROUP BY 1
""")
def top_lists(spark, d):
    out = aggregates.top_lists(t(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], ["o_orderkey"], 4)
    return out.select("o_custkey", F.array_join(F.transform("o_orderkey", lambda x: x.cast("string")), " | ").alias("orders"), F.size("o_orderkey").cast("long").alias("n"))


@query("""SELECT p_brand, first(p_name ORDER BY length(p_name) DESC, p_name) AS longest FROM part GROUP BY 1""")
def first_by_order(spark, d):
    return t(spark, d, "part").groupBy("p_brand").agg(aggregates.first_by("p_name", [-F.length("p_name"), F.col("p_name")]).alias("longest"))


@query("""SELECT c_nationkey, array_to_string(list_sort(list_distinct(list(c_mktsegment))), ',') AS segments FROM customer GROUP BY 1""")
def sorted_lists(spark, d):
    return t(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.array_distinct(F.collect_list("c_mktsegment"))), ",").alias("segments"))


@query("""SELECT event_type, count(*) AS n FROM events GROUP BY 1""")
def value_counts(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_mktsegment AS key, count(*) / (SELECT count(c_mktsegment) FROM customer) AS share FROM customer GROUP BY 1""")
def key_share(spark, d):
    return aggregates.key_share(t(spark, d, "customer").select(F.col("c_mktsegment").alias("key")), "key")


@query("""SELECT event_id, round(coalesce(CASE WHEN event_id % 9 > 0 THEN value END, (SELECT avg(value) FROM events WHERE event_id % 9 > 0)), 6) AS value FROM events""")
def mean_fill(spark, d):
    e = t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 9 > 0, F.col("value")).alias("value"))
    return aggregates.fill_mean(e, "value").select("event_id", F.round("value", 6).alias("value"))


@query("""
WITH x AS (SELECT o_orderpriority AS dest, year(o_orderdate) >= 1998 AS post, c_nationkey >= 12 AS far, count(*) AS w FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
     s AS (SELECT dest, far, post, w / sum(w) OVER (PARTITION BY post, far) AS share FROM x)
SELECT dest, far::int AS far, round(coalesce(max(share) FILTER (NOT post), 0), 9) AS before, round(coalesce(max(share) FILTER (post), 0), 9) AS after,
       round(coalesce(max(share) FILTER (post), 0) - coalesce(max(share) FILTER (NOT post), 0), 9) AS change FROM s GROUP BY 1, 2
""")
def share_reallocation(spark, d):
    rows = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderpriority").alias("dest"), F.year("o_orderdate").alias("y"), F.col("c_nationkey").alias("o"), F.lit(1).alias("w"))
    out = panel.shares_by_period(rows, "dest", F.col("y") >= 1998, F.col("o") >= 12, "w")
    return out.select("dest", "far", *[F.round(c, 9).alias(c) for c in ("before", "after", "change")])


@query("""
WITH r AS (SELECT user_id AS spell, min(struct_pack(y := year(ts), e := event_id)) AS m FROM events GROUP BY 1)
SELECT spell, m.y AS first_year, m.e AS record, e.event_type FROM r JOIN events e ON e.event_id = m.e
""")
def spell_sample(spark, d):
    rows = t(spark, d, "events").select(F.col("user_id").alias("spell"), F.year("ts").alias("first_year"), F.col("event_id").alias("record"), "event_type")
    return panel.spell_sample(rows, "spell", "first_year", "record")


# ---------------------------------------------------------------- order


DITTO = "CASE WHEN event_type IN ('view', 'click') THEN NULL ELSE event_type END"


@query(f"""
WITH e AS (SELECT event_id, user_id, ts, {DITTO} AS x FROM events)
SELECT event_id, last(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS limited,
       last(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS unlimited FROM e
""".replace("last(x IGNORE NULLS)", "last_value(x IGNORE NULLS)"))
def ditto_fill(spark, d):
    e, order = t(spark, d, "events"), ["ts", "event_id"]
    fill = lambda n: ordered.ditto_fill(F.col("event_type"), ["view", "click"], ["user_id"], order, n)
    return e.select("event_id", fill(12).alias("limited"), fill(None).alias("unlimited"))


@query("""
WITH e AS (SELECT event_id, user_id, ts, hour(ts) AS h FROM events),
     n AS (SELECT *, coalesce(lag(h) OVER w, h) AS b, coalesce(lead(h) OVER w, h) AS a FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
     r AS (SELECT event_id, user_id, ts, CASE WHEN b <= a AND (h < b OR h > a) THEN a ELSE h END AS hour FROM n),
     s AS (SELECT *, row_number() OVER w AS i, lag(hour) OVER w AS l FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, hour FROM s WHERE i = 1 OR hour = l + 1
""")
def misread_repair(spark, d):
    e, order = t(spark, d, "events").withColumn("hour", F.hour("ts").cast("long")), ["ts", "event_id"]
    return ordered.steps_of_one(ordered.repair_misread(e, "hour", ["user_id"], order), "hour", ["user_id"], order).select("event_id", "hour")


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS record_id FROM orders""")
def record_ids(spark, d):
    return ordered.record_id(t(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "record_id")


@query("""
SELECT o_custkey, o_orderkey, n > 3 AS more FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE i <= 3
""")
def cap_per_group(spark, d):
    return ordered.first_rows(t(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 3, hit="more").select("o_custkey", "o_orderkey", "more")


@query("""
WITH x AS (SELECT event_id, user_id, ts, epoch(ts) - lag(epoch(ts)) OVER w > 7200 AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, (sum(coalesce(new, false)::int) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 1)::bigint AS spell FROM x
""")
def gap_spells(spark, d):
    return ordered.gap_spells(t(spark, d, "events"), ["user_id"], "ts", ["ts", "event_id"], 7200).select("event_id", "spell")


@query("""
WITH a AS (SELECT user_id, hour(ts) AS page, min(value) AS anchor FROM events WHERE event_id % 7 = 0 GROUP BY ALL)
SELECT event_id, round(last_value(anchor IGNORE NULLS) OVER (PARTITION BY e.user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 9) AS anchor
FROM events e LEFT JOIN a ON e.user_id = a.user_id AND hour(ts) = page
""")
def anchored_fill(spark, d):
    e = t(spark, d, "events").withColumn("page", F.hour("ts"))
    a = e.where("event_id % 7 = 0").groupBy("user_id", "page").agg(F.min("value").alias("anchor"))
    return ordered.anchored(e, a, ["user_id", "page"], "anchor", ["user_id"], ["ts", "event_id"]).select("event_id", F.round("anchor", 9).alias("anchor"))


# ---------------------------------------------------------------- joins


@query("""
WITH a AS (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END AS k, event_type FROM events),
     b AS (SELECT CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END AS k, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT a.event_id, b.n FROM a LEFT JOIN b ON a.k IS NOT DISTINCT FROM b.k AND a.event_type IS NOT DISTINCT FROM b.event_type
""")
def null_safe_join(spark, d):
    a = t(spark, d, "events").select("event_id", F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("k"), "event_type")
    b = a.groupBy("k", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return joins.null_safe(a, b, ["k", "event_type"]).select("event_id", "n")


@query("""
WITH a AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM a FULL JOIN b ON a.k = b.k
""")
def full_join_zero_fill(spark, d):
    a = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    b = t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return joins.full_with_zeros(a, b, ["k"], ["customers", "suppliers"])


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def semi_and_anti(spark, d):
    o = t(spark, d, "orders")
    rich, pending = o.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, d, "customer").join(rich, "c_custkey", "left_semi").join(pending, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("""SELECT o.o_orderkey, c.c_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderkey IN (SELECT min(o_orderkey) FROM orders GROUP BY o_custkey)""")
def one_to_one_join(spark, d):
    first = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("o_orderkey"))
    return joins.one_to_one(first, t(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"]).select("o_orderkey", "c_name")


@query("""
WITH s AS (SELECT c_custkey AS id, c_nationkey AS n, c_mktsegment AS m, CAST(floor(c_acctbal / 50) AS BIGINT) AS b, c_custkey % 10 AS g FROM customer),
     p AS (SELECT l.id AS lid, r.id AS rid FROM s l JOIN s r ON l.n = r.n AND l.b = r.b AND l.id < r.id AND l.g <> r.g
           UNION SELECT l.id, r.id FROM s l JOIN s r ON l.m = r.m AND l.b = r.b AND l.id < r.id AND l.g <> r.g)
SELECT lid, rid FROM p
""")
def multi_rule_blocking(spark, d):
    s = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("m"), F.floor(F.col("c_acctbal") / 50).alias("b"), (F.col("c_custkey") % 10).alias("g"))
    return joins.multi_rule_pairs(s, "id", [["n", "b"], ["m", "b"]], F.col("l.g") != F.col("r.g"))


WORDS = "SELECT DISTINCT w FROM (SELECT unnest(string_split(lower(s), ' ')) AS w FROM (SELECT p_name AS s FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT n_name FROM nation UNION ALL SELECT r_name FROM region)) WHERE w <> ''"


def words(spark, d):
    p = t(spark, d, "part")
    lines = p.select(F.col("p_name").alias("s")).union(p.select("p_type")).union(t(spark, d, "nation").select("n_name")).union(t(spark, d, "region").select("r_name"))
    return lines.select(F.explode(F.split(F.lower("s"), " ")).alias("w")).where("w != ''").distinct()


@query(f"""
WITH w AS ({WORDS})
SELECT a.w AS a, b.w AS b, round(jaro_winkler_similarity(a.w, b.w), 9) AS similarity FROM w a JOIN w b ON a.w < b.w AND a.w[1] = b.w[1]
""")
def jaro_winkler(spark, d):
    w = words(spark, d)
    pairs = w.select(F.col("w").alias("a")).join(w.select(F.col("w").alias("b")), (F.col("a") < F.col("b")) & (F.substring("a", 1, 1) == F.substring("b", 1, 1)))
    return pairs.select("a", "b", F.round(text.jaro_winkler(F.col("a"), F.col("b")), 9).alias("similarity"))


@query(f"""
WITH w AS ({WORDS}), x AS (SELECT w, w || 's' AS v FROM w)
SELECT a.w AS q, b.v, round(jaro_winkler_similarity(a.w, b.v), 9) AS similarity FROM x a JOIN x b ON a.w[1:2] = b.v[1:2] AND abs(length(a.w) - length(b.v)) <= 3 AND jaro_winkler_similarity(a.w, b.v) >= 0.92
""")
def fuzzy_join(spark, d):
    w = words(spark, d)
    return joins.fuzzy_join(w.select(F.col("w").alias("q")), w.select(F.concat("w", F.lit("s")).alias("v")), "q", "v").withColumn("similarity", F.round("similarity", 9))


@query("""
WITH l AS (SELECT c_custkey AS id, c_name AS k1, CAST(c_nationkey AS VARCHAR) || c_mktsegment AS k2, c_mktsegment AS k3 FROM customer),
     r AS (SELECT s_suppkey AS v, s_name AS k1, CAST(s_nationkey AS VARCHAR) || 'BUILDING' AS k2, 'MACHINERY' AS k3 FROM supplier),
     h AS (SELECT id, v, 0 AS rung FROM l JOIN r USING (k1) UNION ALL SELECT id, v, 1 FROM l JOIN r USING (k2) UNION ALL SELECT id, v, 2 FROM l JOIN r USING (k3))
SELECT id, v, rung FROM h QUALIFY rung = min(rung) OVER (PARTITION BY id)
""")
def ladder_join(spark, d):
    left = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("k1"), F.concat(F.col("c_nationkey").cast("string"), F.col("c_mktsegment")).alias("k2"), F.col("c_mktsegment").alias("k3"))
    right = t(spark, d, "supplier").select(F.col("s_suppkey").alias("v"), F.col("s_name").alias("k1"), F.concat(F.col("s_nationkey").cast("string"), F.lit("BUILDING")).alias("k2"), F.lit("MACHINERY").alias("k3"))
    return joins.ladder_join(left, right, "id", ["k1", "k2", "k3"], "v").withColumn("rung", F.col("rung").cast("int"))


@query("""
WITH RECURSIVE e AS (SELECT n_nationkey + 100 AS child, n_regionkey AS parent FROM nation UNION ALL SELECT c_custkey + 100000, c_nationkey + 100 FROM customer),
     a AS (SELECT child, parent AS up, 1 AS n FROM e UNION ALL SELECT a.child, e.parent, n + 1 FROM a JOIN e ON a.up = e.child)
SELECT child, array_to_string(list(up ORDER BY n), '>') AS path, count(*) AS depth FROM a GROUP BY 1
""")
def ancestor_closure(spark, d):
    e = t(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("child"), F.col("n_regionkey").cast("long").alias("parent")).union(
        t(spark, d, "customer").select(F.col("c_custkey") + 100000, (F.col("c_nationkey") + 100).cast("long")))
    return joins.closure(e, "child", "parent").select("child", F.array_join(F.transform("ancestors", lambda x: x.cast("string")), ">").alias("path"), F.col("depth").cast("long").alias("depth"))


@query("""
SELECT e.event_id, coalesce(o.o_orderkey, -1) AS o_orderkey FROM (SELECT event_id, user_id, TIMESTAMP '1995-01-01' + (event_id % 2000) * INTERVAL 1 DAY AS at FROM events) e
ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o ON e.user_id = o.o_custkey AND e.at >= o.o_orderdate
""")
def as_of_join(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", F.expr("timestamp_ntz '1995-01-01' + make_interval(0, 0, 0, cast(event_id % 2000 as int))").alias("at"))
    o = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("od")).agg(F.max("o_orderkey").alias("o_orderkey"))
    return joins.as_of(e, o, ["user_id"], "at", "od", ["o_orderkey"]).select("event_id", F.coalesce("o_orderkey", F.lit(-1)).alias("o_orderkey"))


@query("""
WITH x AS (SELECT *, o_totalprice > 250000 AS ok FROM orders)
SELECT o_custkey, o_orderkey FROM x QUALIFY ok OR NOT bool_or(ok) OVER (PARTITION BY o_custkey)
""")
def constraint_with_fallback(spark, d):
    return joins.keep_satisfied(t(spark, d, "orders"), ["o_custkey"], F.col("o_totalprice") > 250000).select("o_custkey", "o_orderkey")


@query("""SELECT o_orderkey, round(o_totalprice / (SELECT avg(o_totalprice) FROM orders), 9) AS relative, unnest(['low', 'high']) AS kind FROM orders""")
def scalar_and_unnest(spark, d):
    o = t(spark, d, "orders")
    mean = o.agg(F.avg("o_totalprice").alias("m"))
    return o.join(F.broadcast(mean), F.lit(True)).select("o_orderkey", F.round(F.col("o_totalprice") / F.col("m"), 9).alias("relative"), F.explode(F.array(F.lit("low"), F.lit("high"))).alias("kind"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, NULL AS extra FROM supplier UNION ALL SELECT n_name, NULL, CAST(n_regionkey AS VARCHAR) FROM nation""")
def relaxed_union(spark, d):
    a = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    b = t(spark, d, "nation").select(F.col("n_name").alias("id"), F.col("n_regionkey").cast("string").alias("extra"))
    return aggregates.union_relaxed([a, b])


@query("""SELECT DISTINCT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0""")
def set_operations(spark, d):
    a = t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(t(spark, d, "supplier").select("s_nationkey")).distinct()
    return a.join(t(spark, d, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("k")), "k", "left_anti")


# ---------------------------------------------------------------- functions


SPELT = "text"
for _a, _b in text.SPELT.items():
    SPELT = f"replace({SPELT}, '{_a}', '{_b}')"
    if len(_a.upper()) == 1:
        SPELT = f"replace({SPELT}, '{_a.upper()}', '{_b}')"


@query(rf"""
SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({SPELT})), '[-/_]', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))) AS folded FROM documents
""")
def fold_texts(spark, d):
    return t(spark, d, "documents").select("doc_id", F.sha2(text.fold(F.col("text")), 256).alias("folded"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'small' ELSE 'large' END AS class, c_mktsegment IN ('BUILDING', 'MACHINERY') AS works,
       CAST(floor(c_acctbal / 100) AS BIGINT) AS hundred, coalesce({'BUILDING': 'B', 'MACHINERY': 'M'}[c_mktsegment], c_mktsegment) AS kept, {'BUILDING': 'B', 'MACHINERY': 'M'}[c_mktsegment] AS strict,
       try_cast(substr(c_name, 10) AS BIGINT) AS num FROM customer""".replace("{'BUILDING': 'B', 'MACHINERY': 'M'}[c_mktsegment]", "CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' END"))
def case_and_lookup(spark, d):
    table, m = {"BUILDING": "B", "MACHINERY": "M"}, F.col("c_mktsegment")
    return t(spark, d, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 1000, "small").otherwise("large").alias("class"), m.isin("BUILDING", "MACHINERY").alias("works"),
        F.floor(F.col("c_acctbal") / 100).alias("hundred"), text.lenient(m, table).alias("kept"), text.mapped(m, table).alias("strict"), dates.number(F.substring("c_name", 10, 100)).alias("num"),
    )


@query("""
SELECT o_orderkey, CAST(floor((year(o_orderdate) - 1990) / 5) AS INT) + 1 AS era, CASE WHEN year(o_orderdate) >= 2000 THEN 2000 WHEN year(o_orderdate) >= 1997 THEN 1997 ELSE 1995 END AS layer,
       CAST(regexp_extract(strftime(o_orderdate, 'on %Y-%m-%d'), '(\\d{4})', 1) AS BIGINT) AS found FROM orders
""".replace("\\\\d", "\\d"))
def years(spark, d):
    y = F.year("o_orderdate")
    return t(spark, d, "orders").select("o_orderkey", dates.era(y, 1990, 5).alias("era"), dates.step_year(y, [1995, 1997, 2000]).alias("layer"), dates.year_in(F.date_format("o_orderdate", "'on 'yyyy-MM-dd")).alias("found"))


GEO = "SELECT n_nationkey AS k, n_name, (n_nationkey * 7 % 50) + 10.5 AS lat, (n_nationkey * 13 % 60) - 20.25 AS lon FROM nation"


def places(spark, d):
    return t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name", ((F.col("n_nationkey") * 7 % 50) + 10.5).cast("double").alias("lat"), ((F.col("n_nationkey") * 13 % 60) - 20.25).cast("double").alias("lon"))


@query(f"""
WITH p AS ({GEO}), x AS (SELECT a.k AS a, b.k AS b, 2 * 6371.0 * asin(sqrt(least(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 1.0))) AS km FROM p a CROSS JOIN p b)
SELECT a, b, round(km, 6) AS km, round(CASE WHEN km >= 1 THEN ln(km) ELSE ln(0.5) END, 9) AS log_km FROM x
""")
def distances(spark, d):
    p = places(spark, d)
    a, b = p.select(F.col("k").alias("a"), F.col("lat").alias("y1"), F.col("lon").alias("x1")), p.select(F.col("k").alias("b"), F.col("lat").alias("y2"), F.col("lon").alias("x2"))
    km = geo.haversine(F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2"))
    return a.crossJoin(F.broadcast(b)).select("a", "b", F.round(km, 6).alias("km"), F.round(geo.log_distance(km), 9).alias("log_km"))


@query(f"""
WITH p AS ({GEO}), f AS (SELECT n.k AS origin, o_orderpriority AS dest, count(*) AS flow FROM orders JOIN customer ON o_custkey = c_custkey JOIN p n ON n.k = c_nationkey GROUP BY ALL),
     x AS (SELECT o_orderpriority AS dest, k AS origin, 2 * 6371.0 * asin(sqrt(least(pow(sin(radians(50 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(50.0)) * pow(sin(radians(10 - lon) / 2), 2), 1.0))) AS km FROM (SELECT DISTINCT o_orderpriority FROM orders) CROSS JOIN p)
SELECT dest, CASE WHEN km < 500 THEN 'near' ELSE 'far' END AS reach, coalesce(sum(flow), 0)::bigint AS flow, round(sum(km * flow) / sum(flow), 6) AS mean_km FROM x LEFT JOIN f USING (origin, dest) GROUP BY ALL
""")
def flow_weighted_distance(spark, d):
    p = places(spark, d).withColumn("km", geo.haversine(F.col("lat"), F.col("lon"), F.lit(50.0), F.lit(10.0)))
    rows = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("o_orderpriority").alias("dest"), F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("flow"))
    grid = p.crossJoin(F.broadcast(rows.select("dest").distinct())).join(rows, ["dest", "k"], "left")
    return grid.groupBy("dest", F.when(F.col("km") < 500, "near").otherwise("far").alias("reach")).agg(F.coalesce(F.sum("flow"), F.lit(0)).alias("flow"), F.round(aggregates.weighted_mean(F.col("km"), F.col("flow")), 6).alias("mean_km"))


def _bins(column: str, upper: list[float]) -> str:
    return "CASE WHEN {c} IS NULL THEN -1 ".format(c=column) + "".join(f"WHEN log10(1 + {column}) < {u!r} THEN {i} " for i, u in enumerate(upper[:-1])) + f"ELSE {len(upper) - 1} END"


UPPER = geo.edges(8, 20000)
SHAPE = "(VALUES " + ", ".join(f"({i}, {w!r}::double)" for i, w, _ in geo.bin_shape(UPPER)) + ") AS s(bin, width)"


@query(f"""
WITH e AS (SELECT event_type AS school, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value * 10 END AS km FROM events),
     c AS (SELECT school, {_bins('km', UPPER)} AS bin, count(*)::double AS n FROM e WHERE km IS NOT NULL GROUP BY ALL),
     g AS (SELECT school, bin, width, coalesce(n, 0) AS n FROM (SELECT DISTINCT school FROM e) CROSS JOIN {SHAPE} LEFT JOIN c USING (school, bin)),
     p AS (SELECT *, sum(n) OVER (PARTITION BY bin) / sum(n) OVER () AS pooled, sum(n) OVER (PARTITION BY school) AS total, width / sum(width) OVER () AS flat FROM g),
     q AS (SELECT school, bin, width, 0.95 * (n + 50 * pooled) / (total + 50) + 0.05 * (0.85 * pooled + 0.15 * flat) AS p FROM p),
     r AS (SELECT school, bin, p / sum(p) OVER (PARTITION BY school) AS p, width FROM q)
SELECT school, bin, round(ln(p / width), 6) AS log_density FROM r UNION ALL SELECT school, -1, round(sum(p * ln(p / width)), 6) FROM r GROUP BY 1
""")
def distance_prior(spark, d):
    e = t(spark, d, "events").select(F.col("event_type").alias("school"), F.when(F.col("event_id") % 11 != 0, F.col("value") * 10).alias("km"), F.lit(1).alias("w"))
    return geo.distance_prior(e, "school", "km", "w", UPPER).withColumn("log_density", F.round("log_density", 6))


@query("""
SELECT p_partkey, regexp_matches(p_name, 'a') AS has_a, starts_with(p_type, 'S') AS starts, length(p_name) AS n, p_brand || ', ' || p_type AS whole, concat_ws(' ', NULL, p_brand) AS skipped,
       NULL || p_brand AS gone, trim(replace(p_brand, '#', ' ')) AS plain, nullif(regexp_extract(p_brand, '([0-9]+)', 1), '') AS digits FROM part
""")
def string_functions(spark, d):
    b = F.col("p_brand")
    return t(spark, d, "part").select(
        "p_partkey", F.col("p_name").rlike("a").alias("has_a"), F.col("p_type").startswith("S").alias("starts"), F.length("p_name").cast("long").alias("n"), text.place(b, F.col("p_type")).alias("whole"),
        F.concat_ws(" ", F.lit(None).cast("string"), b).alias("skipped"), F.concat(F.lit(None).cast("string"), b).alias("gone"), text.strip(F.replace(b, F.lit("#"), F.lit(" "))).alias("plain"),
        text.null_if_empty(F.regexp_extract(b, "([0-9]+)", 1)).alias("digits"),
    )


@query("""
WITH g AS (SELECT c_custkey, [c_nationkey, c_nationkey % 5, 3] AS a, [3, c_nationkey % 7] AS b FROM customer)
SELECT c_custkey, len(list_intersect(a, b)) AS shared, list_contains(a, 0) AS zero, array_to_string(list_sort(list_distinct(a || b)), ',') AS all_ FROM g
""")
def array_functions(spark, d):
    n = F.col("c_nationkey")
    g = t(spark, d, "customer").select("c_custkey", F.array(n, n % 5, F.lit(3)).alias("a"), F.array(F.lit(3), n % 7).alias("b"))
    return g.select("c_custkey", F.size(F.array_intersect("a", "b")).cast("long").alias("shared"), F.array_contains("a", 0).alias("zero"), F.array_join(F.array_sort(F.array_distinct(F.concat("a", "b"))).cast("array<string>"), ",").alias("all_"))


@query("""
SELECT 'o_orderkey' AS "column", 'id' AS kind, avg((try_cast(o_orderkey AS BIGINT) IS NULL)::int) AS bad, avg((try_cast(o_orderkey AS BIGINT) IS NULL)::int) <= 0.01 AS ok FROM orders
UNION ALL SELECT 'o_orderpriority', 'text', avg((try_cast(o_orderpriority AS BIGINT) IS NOT NULL)::int), avg((try_cast(o_orderpriority AS BIGINT) IS NOT NULL)::int) <= 0.5 FROM orders
""")
def structure_check(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_orderpriority")
    return contracts.structure(o, ["o_orderkey"], ["o_orderpriority"])


@query("""SELECT 'o_orderstatus' AS "column", avg((trim(o_orderstatus) IN ('F', 'O'))::int) AS covered, avg((trim(o_orderstatus) IN ('F', 'O'))::int) >= 0.8 AS ok FROM orders""")
def domain_check(spark, d):
    return contracts.domains(t(spark, d, "orders"), {"o_orderstatus": ["F", "O"]})


# ---------------------------------------------------------------- names, phonetics, linkage


NAMES = "SELECT DISTINCT upper(w[1]) || w[2:] AS name FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part) WHERE w <> ''"


def names(spark, d):
    w = t(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("w")).where("w != ''").distinct()
    return w.select(F.concat(F.upper(F.substring("w", 1, 1)), F.substring("w", 2, 100)).alias("name"))


def _code(letters: str) -> str:
    near = lambda i: f"coalesce(substr(s, i {i}, 1), '')"
    before, after = f"CASE WHEN i > 1 THEN {near('- 1')} ELSE '' END", near("+ 1")
    isin = lambda x, chars: f"({x} <> '' AND contains('{chars}', {x}))"
    each = f"""CASE WHEN contains('aeijouy', c) THEN '0' WHEN c = 'b' THEN '1' WHEN c = 'p' THEN CASE WHEN {after} = 'h' THEN '3' ELSE '1' END
      WHEN contains('dt', c) THEN CASE WHEN {isin(after, 'csz')} THEN '8' ELSE '2' END WHEN contains('fvw', c) THEN '3' WHEN contains('gkq', c) THEN '4'
      WHEN c = 'c' THEN CASE WHEN i = 1 THEN CASE WHEN {isin(after, 'ahkloqrux')} THEN '4' ELSE '8' END WHEN {isin(before, 'sz')} THEN '8' WHEN {isin(after, 'ahkoqux')} THEN '4' ELSE '8' END
      WHEN c = 'x' THEN CASE WHEN {isin(before, 'ckq')} THEN '8' ELSE '48' END WHEN c = 'l' THEN '5' WHEN contains('mn', c) THEN '6' WHEN c = 'r' THEN '7' WHEN contains('sz', c) THEN '8' ELSE '' END"""
    return f"""WITH x AS (SELECT name, {letters} AS s FROM n), y AS (SELECT name, s, unnest(range(1, length(s) + 1)) AS i FROM x), z AS (SELECT name, i, {each.replace(' c)', ' substr(s, i, 1))').replace('WHEN c =', 'WHEN substr(s, i, 1) =')} AS k FROM y),
     a AS (SELECT name, string_agg(k, '' ORDER BY i) AS code FROM z GROUP BY 1),
     b AS (SELECT name, unnest(range(1, length(code) + 1)) AS i, code FROM a), e AS (SELECT name, i, substr(code, i, 1) AS k FROM b WHERE i = 1 OR substr(code, i, 1) <> substr(code, i - 1, 1))
SELECT name, string_agg(k, '' ORDER BY i) FILTER (i = 1 OR k <> '0') AS code FROM e GROUP BY 1"""


@query(f"WITH n AS ({NAMES}) SELECT * FROM ({_code('lower(name)')})")
def phonetic_codes(spark, d):
    return names(spark, d).select("name", text.phonetic_name(F.col("name")).alias("code"))


def people(spark, d):
    """Persons made of the tables: two visits of customers under varying spellings."""
    c = t(spark, d, "customer").join(F.broadcast(t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    first = F.element_at(F.array(*[F.lit(x) for x in ("Johann Friedrich", "Carl", "Wilhelm August", "Georg", "Ludwig", "Heinrich", "Franz Joseph", "Peter")]), (F.col("c_custkey") % 8 + 1).cast("int"))
    last = F.concat(F.initcap("n_name"), F.element_at(F.array(*[F.lit(x) for x in ("mann", "er", "feld", "berg", "bach", "hoff", "stein")]), (F.col("c_custkey") % 7 + 1).cast("int")))
    base = c.select("c_custkey", last.alias("last_name"), first.alias("first_names"), (F.col("c_custkey") % 41).alias("location_id"), (1800 + F.col("c_custkey") % 40).alias("y"))
    visits = base.select("*", F.explode(F.sequence(F.lit(0), (F.col("c_custkey") % 3).cast("int"))).alias("v"))
    return visits.select(
        (F.col("c_custkey") * 10 + F.col("v")).alias("record_id"), "last_name", F.when(F.col("v") == 1, F.concat(F.substring("first_names", 1, 1), F.lit("."))).otherwise(F.col("first_names")).alias("first_names"),
        (F.col("y") + F.col("v")).alias("first_year"), F.element_at(F.array(F.lit("berlin"), F.lit("jena"), F.lit("kiel"), F.lit("bonn")), ((F.col("c_custkey") + F.floor(F.col("v") / 2)) % 4 + 1).cast("int")).alias("school"), "location_id", "c_custkey",
    )


@query()
def record_linkage(spark, d):
    rows = people(spark, d).select("record_id", "last_name", "first_names", F.col("first_year").cast("long").alias("first_year"), "school", "location_id")
    return linkage.link(rows, ["berlin", "jena", "bonn"], threshold=0.9)


@query("""
WITH s AS (SELECT c_nationkey AS found, c_mktsegment AS real FROM customer), c AS (SELECT found, real, count(*) AS n FROM s GROUP BY ALL),
     a AS (SELECT sum(n * (n - 1) / 2) AS tp, sum(n) AS n FROM c), f AS (SELECT sum(k * (k - 1) / 2) AS fp, sum(m) AS pure FROM (SELECT sum(n) AS k, max(n) AS m FROM c GROUP BY found)),
     r AS (SELECT sum(k * (k - 1) / 2) AS fn FROM (SELECT sum(n) AS k FROM c GROUP BY real))
SELECT round(pure / n, 9) AS purity, round(tp / fp, 9) AS precision, round(tp / fn, 9) AS recall, round(2 * (tp / fp) * (tp / fn) / (tp / fp + tp / fn), 9) AS f1 FROM a, f, r
""")
def cluster_evaluation(spark, d):
    c = t(spark, d, "customer")
    out = linkage.evaluate(c.select("c_custkey", F.col("c_nationkey").alias("f")), c.select("c_custkey", F.col("c_mktsegment").alias("r")), "c_custkey", "f", "r")
    return out.select(*[F.round(x, 9).alias(x) for x in out.columns])


@query()
def gravity_model(spark, d):
    from ..operators import econ

    grid = od_grid(spark, d).join(places(spark, d).select(F.col("k").alias("origin"), geo.haversine(F.col("lat"), F.col("lon"), F.lit(50.0), F.lit(10.0)).alias("km")), "origin")
    panel_ = grid.withColumn("far_urgent", (F.log("km") * (F.col("dest") == "1-URGENT").cast("double")))
    fit = econ.ppml(panel_, "flow ~ far_urgent | origin + dest^period", cluster="origin")
    return spark.createDataFrame([(n, round(b, 9), round(s, 9), round(p, 9)) for n, b, s, p in fit.tidy()], "coefficient string, estimate double, error double, p double")


@query("""
WITH p AS (SELECT c_custkey, (c_custkey % 100) / 10.0 AS x, (c_custkey * 7 % 100) / 10.0 AS y FROM customer)
SELECT c_custkey, CASE WHEN x <= 5 AND y <= 5 THEN 'sw' WHEN x >= 6 AND y >= 6 AND NOT (x > 7 AND x < 8 AND y > 7 AND y < 8) THEN 'ne' END AS area FROM p
""")
def point_in_polygon(spark, d):
    from ..operators import geometry

    ring = lambda a, b: [{"x": float(x), "y": float(y)} for x, y in ((a, a), (b, a), (b, b), (a, b), (a, a))]
    shapes = spark.createDataFrame([("sw", [ring(0, 5)]), ("ne", [ring(6, 10), ring(7, 8)])], f"area string, rings {geometry.RINGS}")
    pts = t(spark, d, "customer").select("c_custkey", ((F.col("c_custkey") % 100) / 10).alias("x"), ((F.col("c_custkey") * 7 % 100) / 10).alias("y"))
    return geometry.point_in_polygon(pts, shapes, "x", "y", cell=2.0).select("c_custkey", "area")
