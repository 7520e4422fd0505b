"""Queries of the gazetteer index and of the resolution of places, over places made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gazetteer, geocode
from .catalog import query, t

# ---------------------------------------------------------------- a gazetteer made of regions, nations and customers

NAME = "upper(n_name[1]) || lower(n_name[2:]) || ['mann', 'er', 'feld', 'berg', 'bach', 'hoff', 'stein'][c_custkey % 7 + 1]"
PLACES = f"""
SELECT 10 + r_regionkey AS id, upper(r_name[1]) || lower(r_name[2:]) AS name, NULL::bigint AS up, 'country' AS kind, 1 AS langs, NULL::bigint AS k FROM region
UNION ALL SELECT 1000 + n_nationkey, upper(n_name[1]) || lower(n_name[2:]), 10 + n_regionkey, 'province', 2, NULL FROM nation
UNION ALL SELECT 100000 + c_custkey, {NAME}, CASE WHEN c_custkey % 10 = 1 AND c_custkey > 1 THEN 100000 + c_custkey - 1 ELSE 1000 + c_nationkey END, ['city', 'village', 'suburb', 'hill'][c_custkey % 4 + 1], c_custkey % 3 + 1, c_custkey
          FROM customer JOIN nation ON c_nationkey = n_nationkey
"""
LAT, LON = "CASE WHEN k % 23 <> 0 THEN 47 + (k * 7 % 800) / 100 END", "CASE WHEN k % 23 <> 0 THEN 6 + (k * 13 % 900) / 100 END"


def all_places(spark, d):
    cap = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 100)))
    n, k = t(spark, d, "nation"), F.col("c_custkey")
    r = t(spark, d, "region").select((10 + F.col("r_regionkey")).cast("long").alias("id"), cap("r_name").alias("name"), F.lit(None).cast("long").alias("up"), F.lit("country").alias("kind"), F.lit(1).alias("langs"), F.lit(None).cast("long").alias("k"))
    m = n.select((1000 + F.col("n_nationkey")).cast("long").alias("id"), cap("n_name"), (10 + F.col("n_regionkey")).cast("long"), F.lit("province"), F.lit(2), F.lit(None).cast("long"))
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    c = t(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(
        100000 + k, F.concat(cap("n_name"), pick(("mann", "er", "feld", "berg", "bach", "hoff", "stein"))), F.when((k % 10 == 1) & (k > 1), 100000 + k - 1).otherwise((1000 + F.col("c_nationkey")).cast("long")),
        pick(("city", "village", "suburb", "hill")), (k % 3 + 1).cast("int"), k,
    )
    return r.union(m).union(c)


def coordinates(k):
    known = k % 23 != 0
    return F.when(known, 47 + (k * 7 % 800) / 100), F.when(known, 6 + (k * 13 % 900) / 100)


def tables(p) -> dict:
    """The gazetteer's tables of all_places(), with padded flags, code terms, physical features and merged records."""
    k = F.col("k")
    none, term = F.lit(None).cast("string"), "TERM string, TERM_ID long, SUBJECT_ID long, PREFERRED string, VERNACULAR string, HISTORIC_FLAG string, OTHER_FLAGS string"
    own = p.select(F.col("name"), F.col("id") * 10, F.col("id"), F.lit("P "), none, none, none)
    old = p.where(k % 3 == 0).select(F.concat("name", F.lit(" Stadt")), F.col("id") * 10 + 1, F.col("id"), F.lit("N"), none, F.lit("H "), none)
    codes = p.where("kind = 'country'").select(F.upper(F.substring("name", 1, 3)), F.col("id") * 10 + 2, F.col("id"), F.lit("P"), none, none, F.lit("ISO3L "))
    lat, lon = coordinates(k)
    box = lambda x, d: F.when(k % 4 == 0, x + d)
    kinds = p.select(F.col("id").alias("SUBJECT_ID"), F.lit(1).alias("PTYPE_ROLE_ID"), F.lit("P ").alias("PREFERRED"), F.col("kind").alias("PLACETYPE"))
    return {
        "terms": own.union(old).union(codes).toDF(*[x.split()[0] for x in term.split(", ")]),
        "subjects": p.select(F.col("id").alias("SUBJECT_ID"), F.when(k % 41 == 0, "P").otherwise("A ").alias("RECORD_TYPE"), F.when(k % 50 == 0, "M").otherwise("N").alias("MERGED_STAT")),
        "placetypes": kinds.union(p.where(k % 5 == 0).select("id", F.lit(2), F.lit("N"), F.lit("County seat"))),
        "rels": p.where("up is not null").select(F.col("up").alias("PARENT_ID"), F.col("id").alias("CHILD_ID"), F.lit("P ").alias("PREFERRED")),
        "coords": p.where("k is not null").select(F.col("id").alias("SUBJECT_ID"), lat.alias("LAT"), lon.alias("LON"), box(lat, -0.1).alias("LAT_MIN_BOX"), box(lat, 0.1).alias("LAT_MAX_BOX"), box(lon, -0.2).alias("LON_MIN_BOX"), box(lon, 0.2).alias("LON_MAX_BOX")),
        "languages": p.select(F.col("id").alias("SUBJECT_ID"), F.explode(F.sequence(F.lit(1), F.col("langs"))).alias("LANGUAGE_CODE")),
        "sources": p.select(F.col("id").alias("SUBJECT_ID"), F.coalesce(k % 6, F.lit(3)).alias("n_sources")),
    }


INDEX = f"""
WITH p AS ({PLACES}), terms AS (SELECT name AS "TERM", id * 10 AS "TERM_ID", id, 1.0::double AS q FROM p UNION ALL SELECT name || ' Stadt', id * 10 + 1, id, 0.8::double FROM p WHERE k % 3 = 0),
     live AS (SELECT * FROM p WHERE coalesce(k % 41, 1) <> 0 AND coalesce(k % 50, 1) <> 0),
     n AS (SELECT id, count(*) AS n_terms FROM terms GROUP BY 1), ch AS (SELECT up AS id, count(*) AS n_children FROM p WHERE up IS NOT NULL GROUP BY 1),
     a AS (SELECT live.*, n_terms, coalesce(n_children, 0) AS n_children, kind IN ('city', 'village', 'suburb') AS is_settlement,
           CASE WHEN kind IN ('city', 'village', 'suburb') THEN 'settlement' WHEN kind = 'province' THEN 'territory' WHEN kind = 'country' THEN 'country' WHEN k % 5 = 0 THEN 'district' ELSE 'unknown' END AS geo_precision,
           CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END AS n_placetypes, coalesce(k % 6, 3) AS n_sources, {LAT} AS lat, {LON} AS lon FROM live JOIN n USING (id) LEFT JOIN ch USING (id)),
     b AS (SELECT a.*, coalesce(CASE WHEN a.k % 4 = 0 THEN 0.2 * 0.4 * cos(a.lat * 3.14159265 / 180) * 12321 END, 0) AS area, a.is_settlement AND coalesce(u.is_settlement, false) AS is_sub FROM a LEFT JOIN a u ON a.up = u.id),
     i AS (SELECT *, 1.0 * ln(1 + n_terms) + 1.5 * ln(1 + langs) + 1.0 * ln(1 + n_children) + 0.75 * ln(1 + n_placetypes) + 0.5 * ln(1 + area) + 0.75 * ln(1 + n_sources) AS prominence FROM b)
"""


def index(spark, d):
    from .. import cut

    return cut(gazetteer.build_index(tables(cut(all_places(spark, d)))))


@query(INDEX + """
SELECT "TERM", "TERM_ID", i.id AS "SUBJECT_ID", q AS term_quality, n_terms, geo_precision, is_settlement, is_sub AS is_sub_settlement, up AS parent_id, round(lat, 6) AS "LAT", round(lon, 6) AS "LON", round(prominence, 6) AS prominence,
       lower(replace("TERM", '_', ' ')) AS k_fold FROM i JOIN terms ON terms.id = i.id
""")
def gazetteer_index(spark, d):
    """Terms without codes, living places only, with precision, sub-settlements, prominence and keys."""
    out = index(spark, d)
    return out.select("TERM", "TERM_ID", "SUBJECT_ID", "term_quality", "n_terms", "geo_precision", "is_settlement", "is_sub_settlement", "parent_id", F.round("LAT", 6).alias("LAT"), F.round("LON", 6).alias("LON"), F.round("prominence", 6).alias("prominence"), "k_fold")


def _plain(c: str) -> str:
    return f"trim(regexp_replace(replace(lower({c}), '_', ' '), '[^a-z0-9 ]', '', 'g'))"


@query(INDEX + f""", s AS (SELECT DISTINCT CASE k % 4 WHEN 0 THEN name WHEN 1 THEN upper(name) WHEN 2 THEN '  ' || name || '! ' ELSE name || ' Stadt' END AS src FROM p WHERE k IS NOT NULL),
     x AS (SELECT terms.*, {_plain('"TERM"')} AS kf FROM terms JOIN i ON terms.id = i.id), e AS (SELECT src, x.*, 0 AS rung FROM s JOIN x ON src = "TERM" UNION ALL
     SELECT src, x.*, 1 FROM s JOIN x ON {_plain('src')} = kf), h AS (SELECT * FROM e QUALIFY rung = min(rung) OVER (PARTITION BY src)),
     f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY src, id ORDER BY q DESC, "TERM_ID") = 1)
SELECT src AS src_raw, id AS "SUBJECT_ID", "TERM_ID", CASE rung WHEN 0 THEN 'exact' ELSE 'fold' END AS match_method, (CASE rung WHEN 0 THEN 1.0 ELSE 0.92 END)::double AS string_score FROM f
""")
def place_hits(spark, d):
    """Strings on their first rung of the ladder, one row for each place."""
    k = F.col("k")
    named = all_places(spark, d).where("k is not null").select(F.when(k % 4 == 0, F.col("name")).when(k % 4 == 1, F.upper("name")).when(k % 4 == 2, F.concat(F.lit("  "), "name", F.lit("! "))).otherwise(F.concat("name", F.lit(" Stadt"))).alias("src_raw")).distinct()
    strings = named.withColumns({"src": F.col("src_raw"), "corrected": F.lit(False)})
    hits = geocode.ladder_hits(strings, index(spark, d), geocode.Settings())
    return hits.where("match_method in ('exact', 'fold')").select("src_raw", "SUBJECT_ID", "TERM_ID", "match_method", "string_score")


CANDIDATES = """
SELECT 's' || (c_custkey % 40) AS src_raw, c_custkey AS id, [1.0, 0.92, 0.85][c_custkey % 3 + 1] AS score, c_custkey % 9 AS n_terms, CASE WHEN c_custkey % 17 <> 0 THEN 47 + (c_custkey * 7 % 800) / 100 END AS lat, 6 + (c_custkey * 13 % 900) / 100 AS lon,
       [c_custkey % 6 + 1, 1000] AS up FROM customer
"""


def some_candidates(spark, d):
    k = F.col("c_custkey")
    return t(spark, d, "customer").select(
        F.concat(F.lit("s"), (k % 40).cast("string")).alias("src_raw"), k.alias("SUBJECT_ID"), F.element_at(F.array(F.lit(1.0), F.lit(0.92), F.lit(0.85)), (k % 3 + 1).cast("int")).alias("string_score"), (k % 9).alias("n_terms"),
        F.when(k % 17 != 0, 47 + (k * 7 % 800) / 100).alias("LAT"), (6 + (k * 13 % 900) / 100).alias("LON"), F.array(k % 6 + 1, F.lit(1000).cast("long")).alias("ancestors"),
    )


def _km(y1: str, x1: str, y2: str, x2: str) -> str:
    return f"2 * 6371.0 * asin(sqrt(least(pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2), 1.0)))"


@query(f"""
WITH c AS ({CANDIDATES}), top AS (SELECT * FROM c WHERE lat IS NOT NULL QUALIFY row_number() OVER (PARTITION BY src_raw ORDER BY score DESC, n_terms DESC, id) <= 8),
     k AS (SELECT DISTINCT 's' || (c_custkey % 40) AS region, 's' || (c_custkey // 3 % 40) AS hometown FROM customer WHERE c_custkey % 5 > 0),
     b AS (SELECT region, hometown, r.id AS rid, h.id AS hid, {_km('r.lat', 'r.lon', 'h.lat', 'h.lon')} AS km, list_contains(h.up, r.id) OR list_contains(r.up, h.id) AS nest FROM k JOIN top r ON r.src_raw = region JOIN top h ON h.src_raw = hometown)
SELECT region, hometown, 1 AS field, rid AS "SUBJECT_ID", round(min(km), 6) AS cross_km, bool_or(nest) AS nested FROM b GROUP BY ALL UNION ALL SELECT region, hometown, 2, hid, round(min(km), 6), bool_or(nest) FROM b GROUP BY ALL
""")
def place_coherence(spark, d):
    """How near, and how nested, both fields' first candidates are, for each pair of strings."""
    k = F.col("c_custkey")
    s = lambda x: F.concat(F.lit("s"), x.cast("string"))
    keys = t(spark, d, "customer").where(k % 5 > 0).select(s(k % 40).alias("region"), s(F.floor(k / 3) % 40).alias("hometown")).distinct()
    out = geocode.coherence_table(some_candidates(spark, d), keys, geocode.Settings())
    return out.select("region", "hometown", "field", "SUBJECT_ID", F.round("cross_km", 6).alias("cross_km"), "nested")


SCORED = """
SELECT c_custkey // 8 AS key_id, c_custkey % 2 + 1 AS field, c_custkey AS id, round((c_custkey * 37 % 101) / 7.0, 4) AS score, c_custkey % 5 AS n_terms, ['settlement', 'district', 'territory', 'unknown'][c_custkey * 7 % 4 + 1] AS prec,
       50 + (c_custkey % 7) / 50.0 AS lat, 9 + (c_custkey % 11) / 50.0 AS lon FROM customer WHERE c_custkey % 8 <> 3 OR c_custkey % 16 < 8
"""


def scored(spark, d):
    k = F.col("c_custkey")
    return t(spark, d, "customer").where((k % 8 != 3) | (k % 16 < 8)).select(
        F.floor(k / 8).alias("key_id"), (k % 2 + 1).cast("int").alias("field"), k.alias("SUBJECT_ID"), F.round((k * 37 % 101) / 7.0, 4).alias("score"), (k % 5).alias("n_terms"),
        F.element_at(F.array(F.lit("settlement"), F.lit("district"), F.lit("territory"), F.lit("unknown")), (k * 7 % 4 + 1).cast("int")).alias("geo_precision"),
        (50 + (k % 7) / 50.0).alias("LAT"), (9 + (k % 11) / 50.0).alias("LON"), F.lit(50.0).alias("LAT0"), F.lit(9.0).alias("LON0"),
    )


DECIDED = f"""
WITH s AS ({SCORED}), d AS (SELECT *, least(coalesce(score - lead(score) OVER w, 10), 10) AS margin, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY key_id, field ORDER BY score DESC, n_terms DESC, id)),
     b AS (SELECT *, CASE prec WHEN 'settlement' THEN 0 WHEN 'district' THEN 1 WHEN 'territory' THEN 2 ELSE 4 END AS rank, 111.0 * sqrt(pow((9 - lon) * cos(radians((lat + 50) / 2)), 2) + pow(50 - lat, 2)) <= 15 AS seat FROM d WHERE n = 1),
     r AS (SELECT * FROM b WHERE field = 1), h AS (SELECT * FROM b WHERE field = 2)
"""


@query(DECIDED + 'SELECT key_id, field::int AS field, id AS "SUBJECT_ID", round(margin, 4) AS score_margin FROM b')
def place_decisions(spark, d):
    """The best candidate of each key and field, and its lead."""
    return geocode.decide(scored(spark, d)).select("key_id", "field", "SUBJECT_ID", F.round("score_margin", 4).alias("score_margin"))


@query(DECIDED + """
SELECT coalesce(h.key_id, r.key_id) AS key_id, CASE WHEN h.id IS NOT NULL AND (r.id IS NULL OR (h.rank - r.rank < 1 AND NOT h.seat)) THEN 2 ELSE 1 END AS field,
       CASE WHEN h.id IS NOT NULL AND (r.id IS NULL OR (h.rank - r.rank < 1 AND NOT h.seat)) THEN h.id ELSE r.id END AS "SUBJECT_ID" FROM h FULL JOIN r ON h.key_id = r.key_id
""")
def place_fields(spark, d):
    """Hometown or region: the finer place, and the region where the hometown is the seat's own."""
    return geocode.choose_field(geocode.decide(scored(spark, d))).select("key_id", "field", "SUBJECT_ID")


@query("""
WITH k AS (SELECT c_custkey AS key_id, CASE WHEN c_custkey % 3 > 0 THEN ' S' || (c_custkey % 40) || ' ' END AS region, 'h' || (c_custkey % 30) AS hometown FROM customer),
     o AS (SELECT * FROM (VALUES ('s1', 7), ('s2', NULL), ('h5', 9), ('h7', NULL)) AS o(raw, id)),
     f AS (SELECT key_id, raw, id, 1 AS field FROM k JOIN o ON trim(lower(region)) = raw UNION ALL SELECT key_id, raw, id, 2 FROM k JOIN o ON hometown = raw),
     b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY key_id ORDER BY field) = 1)
SELECT k.key_id, CASE WHEN b.key_id IS NULL THEN 1 WHEN b.id IS NOT NULL THEN b.field END AS field, CASE WHEN b.key_id IS NULL THEN 3 ELSE b.id END AS "SUBJECT_ID", b.key_id IS NOT NULL AS overridden,
       CASE WHEN b.key_id IS NULL THEN 'fold' ELSE 'override' END AS match_method, CASE WHEN b.id IS NOT NULL THEN 'T' || b.id END AS "TERM" FROM k LEFT JOIN b USING (key_id)
""")
def place_overrides(spark, d):
    """Curated ids after the choice, with their own place's columns; a null id clears it; the region's row first."""
    k = F.col("c_custkey")
    keys = t(spark, d, "customer").select(k.alias("key_id"), F.lit("x").alias("school"), F.when(k % 3 > 0, F.concat(F.lit(" S"), (k % 40).cast("string"), F.lit(" "))).alias("region"), F.concat(F.lit("h"), (k % 30).cast("string")).alias("hometown"))
    none = {"TERM": "string", "TERM_ID": "long", "LAT": "double", "LON": "double", "dist": "double", "geo_precision": "string", "is_settlement": "boolean", "string_score": "double", "n_candidates": "long", "cap_hit": "boolean", "score_margin": "double"}
    chosen = keys.select("key_id", F.lit(1).alias("field"), F.lit(3).cast("long").alias("SUBJECT_ID"), F.lit("fold").alias("match_method"), *[F.lit(None).cast(x).alias(c) for c, x in none.items()])
    forced = spark.createDataFrame([(" S1", 7, ""), ("s2", None, ""), ("H5 ", 9, ""), ("h7", None, "")], "raw string, subject_id long, reason string")
    table = spark.createDataFrame([(i, f"T{i}", i * 10, "settlement", 50.0, 9.0, True) for i in (3, 7, 9)], "SUBJECT_ID long, TERM string, TERM_ID long, geo_precision string, LAT double, LON double, is_settlement boolean")
    seats = spark.createDataFrame([("x", 50.0, 9.0)], "school string, LAT0 double, LON0 double")
    return geocode.override(chosen, keys, forced, table, seats).select("key_id", "field", "SUBJECT_ID", "overridden", "match_method", "TERM")


@query("""
WITH s AS (SELECT o_orderkey, 'r' || (o_custkey % 60) AS region, CASE WHEN o_orderkey % 4 > 0 THEN 'h' || (o_orderkey % 70) END AS hometown, o_orderstatus AS school FROM orders),
     e AS (SELECT region, hometown, school, 1 AS field, region AS src_raw FROM s UNION ALL SELECT region, hometown, school, 2, hometown FROM s WHERE hometown IS NOT NULL),
     b AS (SELECT *, CASE WHEN length(src_raw) = 3 AND school <> 'P' THEN (length(region) + coalesce(length(hometown), 0)) / 4.0 END AS margin FROM e),
     g AS (SELECT src_raw, count(*) AS freq, avg((margin IS NULL)::int) AS unresolved_rate, avg(margin) AS mean_margin FROM b GROUP BY 1), u AS (SELECT *, unresolved_rate + (1 - unresolved_rate) / (1 + coalesce(mean_margin, 0)) AS uncertainty FROM g)
SELECT src_raw, freq, round(unresolved_rate, 9) AS unresolved_rate, round(mean_margin, 9) AS mean_margin, round(freq * uncertainty, 6) AS priority FROM u WHERE uncertainty > 0.01 ORDER BY freq * uncertainty DESC, src_raw LIMIT 400
""")
def review_queue(spark, d):
    """The strings whose review is worth most (a top-k report)."""
    o = F.col("o_orderkey")
    students = t(spark, d, "orders").select(o, F.concat(F.lit("r"), (F.col("o_custkey") % 60).cast("string")).alias("region"), F.when(o % 4 > 0, F.concat(F.lit("h"), (o % 70).cast("string"))).alias("hometown"), F.col("o_orderstatus").alias("school"))
    keys = geocode.resolution_keys(students)
    margin = (F.length("region") + F.coalesce(F.length("hometown"), F.lit(0))) / 4.0
    sides = F.explode(F.array(F.struct(F.lit(1).alias("field"), F.col("region").alias("s")), F.struct(F.lit(2).alias("field"), F.col("hometown").alias("s"))))
    best = keys.select("key_id", "school", margin.alias("score_margin"), sides.alias("x")).select("key_id", "school", "score_margin", "x.*")
    best = best.where((F.length("s") == 3) & (F.col("school") != "P")).select("key_id", "field", F.lit(1).alias("SUBJECT_ID"), "score_margin", F.lit("fold").alias("match_method"))
    out = geocode.review_queue(students, keys, best)
    return out.select("src_raw", "freq", F.round("unresolved_rate", 9).alias("unresolved_rate"), F.round("mean_margin", 9).alias("mean_margin"), F.round("priority", 6).alias("priority"))


@query()
def place_resolution(spark, d):
    """The whole chain over the gazetteer above: customers' places as they might be written, to the place that is meant."""
    from .. import cut

    k = F.col("k")
    p = cut(all_places(spark, d))
    up = p.where("k is null").select(F.col("id").alias("up"), F.col("name").alias("region"))
    rows = p.where("k is not null").join(F.broadcast(up), "up", "left")
    spelt = F.when(k % 3 == 0, F.col("name")).when(k % 3 == 1, F.upper("name")).otherwise(F.replace(F.col("name"), F.lit("ck"), F.lit("k")))
    students = rows.select(k.alias("student"), "region", spelt.alias("hometown"), F.element_at(F.array(F.lit("kiel"), F.lit("jena")), (k % 2 + 1).cast("int")).alias("school"))
    seats = spark.createDataFrame([("kiel", 54.3, 10.1), ("jena", 50.9, 11.6)], "school string, LAT0 double, LON0 double")
    out = geocode.geocode(students, gazetteer.build_index(tables(p)), seats)
    return out.select("student", "location_id", "matched", "match_method", "geo_precision", F.round("dist", 6).alias("dist"), F.round("score_margin", 6).alias("score_margin"))

