"""Queries of record linkage: schools, blocks, comparison levels, patterns, scores, keys, over the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import text
from ..operators import linkage
from .catalog import _code, query, t

# ---------------------------------------------------------------- spells made of customers

#: Spells as SQL; spells() makes the same ones.
SPELLS = """
SELECT c_custkey AS spell_id, ['berlin', 'jena', 'kiel', 'bonn'][c_custkey % 4 + 1] AS school, 1800 + c_custkey % 37 AS first_seen, 1800 + c_custkey % 37 + c_custkey % 3 AS last_seen,
       ['maier', 'meier', 'schmit', 'schmidt', 'weber', 'webers', 'kraus'][c_custkey % 7 + 1] AS ln_norm, ['67', '67', '862', '862', '317', '3178', '478'][c_custkey % 7 + 1] AS ln_phon,
       CASE WHEN c_custkey % 11 = 0 THEN 'von' WHEN c_custkey % 11 = 1 THEN 'zu' END AS ln_particle, ['karl', 'johann friedrich', 'friedrich johann', 'georg', ''][c_custkey % 5 + 1] AS given,
       ['k', 'jf', 'fj', 'g', NULL][c_custkey % 5 + 1] AS gn_init, ['k', 'fj', 'fj', 'g', NULL][c_custkey % 5 + 1] AS gn_init_set, ['k', 'j', 'f', 'g', NULL][c_custkey % 5 + 1] AS gn_i1,
       c_custkey % 5 < 3 AS gn_has_full, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey * 7 % 400 END AS location_id FROM customer
"""
#: Pairs of a block that is made without the five rules, for the comparison alone.
PAIRS = "SELECT l.spell_id AS lid, r.spell_id AS rid FROM s l JOIN s r ON l.first_seen = r.first_seen AND l.spell_id < r.spell_id AND l.spell_id % 3 = r.spell_id % 3 AND l.school <> r.school"


def spells(spark, d):
    k = F.col("c_custkey")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    given = pick(("karl", "johann friedrich", "friedrich johann", "georg", ""))
    return t(spark, d, "customer").select(
        k.alias("spell_id"), pick(("berlin", "jena", "kiel", "bonn")).alias("school"), (1800 + k % 37).alias("first_seen"), (1800 + k % 37 + k % 3).alias("last_seen"),
        pick(("maier", "meier", "schmit", "schmidt", "weber", "webers", "kraus")).alias("ln_norm"), pick(("67", "67", "862", "862", "317", "3178", "478")).alias("ln_phon"),
        F.when(k % 11 == 0, "von").when(k % 11 == 1, "zu").alias("ln_particle"), F.filter(F.array_sort(F.split(given, " ")), lambda x: x != "").alias("gn_set"), pick(("k", "jf", "fj", "g", None)).alias("gn_init"),
        pick(("k", "fj", "fj", "g", None)).alias("gn_init_set"), pick(("k", "j", "f", "g", None)).alias("gn_i1"), (k % 5 < 3).alias("gn_has_full"), F.when(k % 13 != 0, k * 7 % 400).alias("location_id"),
    )


def blocks(s):
    """The pairs of PAIRS, to be compared."""
    return linkage.Blocks(s, ["first_seen", "spell_id % 3"], ["berlin", "jena"], F.col("l.school") != F.col("r.school"))


@query(f"""
WITH s AS ({SPELLS}), big AS (SELECT location_id FROM s WHERE location_id IS NOT NULL GROUP BY 1 HAVING count(*) / (SELECT count(location_id) FROM s) >= 0.003),
     o AS (SELECT s.*, CASE WHEN b.location_id IS NULL THEN s.location_id END AS ok, substr(ln_phon, 1, 3) AS phon3 FROM s LEFT JOIN big b ON s.location_id = b.location_id)
SELECT l.spell_id AS lid, r.spell_id AS rid FROM o l JOIN o r ON l.spell_id < r.spell_id AND l.school <> r.school AND greatest(r.first_seen - l.last_seen, l.first_seen - r.last_seen) >= -2
       AND ((l.ln_phon = r.ln_phon AND l.gn_i1 = r.gn_i1) OR (l.ln_phon = r.ln_phon AND l.location_id = r.location_id) OR (l.ok = r.ok AND l.gn_init = r.gn_init) OR l.ln_norm = r.ln_norm
            OR (l.phon3 = r.phon3 AND l.gn_init = r.gn_init AND l.gn_i1 = r.gn_i1))
WHERE greatest(r.first_seen - l.last_seen, l.first_seen - r.last_seen) <= 0
""")
def linkage_blocks(spark, d):
    """The five rules, with the bound on big places and on years; pairs that touch in time."""
    return linkage.block(spells(spark, d), region_share=0.003, enforce_gap=True, most_gap=0)


LEVELS = f"""
WITH s AS ({SPELLS}), p AS ({PAIRS}), fs AS (SELECT ln_phon, count(*) / (SELECT count(ln_phon) FROM s) AS f FROM s GROUP BY 1), fg AS (SELECT location_id, count(*) / (SELECT count(location_id) FROM s) AS f FROM s WHERE location_id IS NOT NULL GROUP BY 1),
     o AS (SELECT s.*, string_split(given, ' ') AS g, coalesce(fs.f, 1.0) AS f_sn, coalesce(fg.f, 1.0) AS f_geo FROM s LEFT JOIN fs USING (ln_phon) LEFT JOIN fg ON s.location_id = fg.location_id),
     b AS (SELECT p.lid, p.rid, l, r, CASE WHEN l.first_seen <= r.first_seen THEN l ELSE r END AS e, CASE WHEN l.first_seen <= r.first_seen THEN r ELSE l END AS t
           FROM p JOIN o l ON l.spell_id = p.lid JOIN o r ON r.spell_id = p.rid),
     c AS (SELECT *, greatest(0, t.first_seen - e.last_seen - CASE WHEN e.school IN ('berlin', 'jena') THEN 0 ELSE 2 END) AS gap, l.gn_has_full AND r.gn_has_full AS whole FROM b),
     x AS (SELECT lid, rid,
       CASE WHEN l.ln_norm = r.ln_norm THEN 0 WHEN l.ln_phon = r.ln_phon THEN 1 WHEN jaro_winkler_similarity(l.ln_norm, r.ln_norm) >= 0.92 AND least(length(l.ln_norm), length(r.ln_norm)) >= 0.6 * greatest(length(l.ln_norm), length(r.ln_norm)) THEN 2 ELSE 3 END AS sn,
       CASE WHEN whole AND list_sort(l.g) = list_sort(r.g) THEN 0 WHEN whole AND len(list_intersect(l.g, r.g)) > 0 AND l.gn_i1 = r.gn_i1 THEN 1 WHEN l.gn_init = r.gn_init AND length(l.gn_init) >= 2 THEN 2
            WHEN l.gn_init_set = r.gn_init_set AND length(l.gn_init) >= 2 THEN 3 WHEN l.gn_i1 = r.gn_i1 THEN 4 WHEN l.gn_i1 IS NULL OR r.gn_i1 IS NULL THEN 5 ELSE 6 END AS gn,
       CASE WHEN l.location_id IS NULL OR r.location_id IS NULL THEN 3 WHEN l.location_id = r.location_id THEN 0 ELSE 2 END AS geo,
       CASE WHEN gap <= 1 THEN 0 WHEN gap = 2 THEN 1 WHEN gap <= 4 THEN 2 WHEN gap <= 8 THEN 3 ELSE 4 END AS yr,
       CASE WHEN coalesce(l.ln_particle, '') <> coalesce(r.ln_particle, '') THEN 2 WHEN l.ln_particle IS NULL THEN 1 ELSE 0 END AS pt,
       CASE WHEN whole THEN 'both_full' WHEN l.gn_has_full OR r.gn_has_full THEN 'mixed' ELSE 'both_abbrev' END AS stratum, l.f_sn * r.f_sn AS tf_sn, l.f_geo * r.f_geo AS tf_geo FROM c)
"""


@query(LEVELS + "SELECT lid, rid, sn, gn, geo, yr, pt, stratum, round(tf_sn, 12) AS tf_sn, round(tf_geo, 12) AS tf_geo FROM x")
def linkage_levels(spark, d):
    """The five comparison levels, the stratum and both sides' term frequencies of each pair."""
    out = blocks(spells(spark, d)).compared({"tf_sn": F.round("tf_sn", 12), "tf_geo": F.round("tf_geo", 12)})
    return out.drop("rare")


@query(LEVELS + "SELECT stratum, sn, gn, geo, yr, pt, count(*) AS n FROM x GROUP BY ALL")
def linkage_patterns(spark, d):
    """How many pairs have each combination of levels."""
    rows = blocks(spells(spark, d)).patterns()
    return spark.createDataFrame([(r["stratum"], r["sn"], r["gn"], r["geo"], r["yr"], r["pt"], r["count"]) for r in rows], "stratum string, sn int, gn int, geo int, yr int, pt int, n long")


STRATA = ("both_full", "mixed", "both_abbrev")


def _shares(tilt: float) -> dict:
    """Probabilities of levels that fall with the level, by stratum."""
    out = {}
    for i, s in enumerate(STRATA):
        out[s] = {}
        for f, k in linkage.LEVELS.items():
            raw = [math.exp(-tilt * (1 + 0.1 * i) * x) for x in range(k)]
            out[s][f] = [x / sum(raw) for x in raw]
    return out


M, U, LAM = _shares(2.0), _shares(-0.5), 0.2


def _weight() -> str:
    parts = [repr(math.log2(LAM / (1 - LAM)))]
    for f, k in linkage.LEVELS.items():
        cases = " ".join(f"WHEN stratum = '{s}' AND {f} = {i} THEN {math.log2(M[s][f][i]) - math.log2(U[s][f][i])!r}" for s in STRATA for i in range(k))
        parts.append(f"CASE {cases} END")
    for f in ("sn", "geo"):
        u0 = "CASE stratum " + " ".join(f"WHEN '{s}' THEN {math.log2(U[s][f][0])!r}" for s in STRATA) + " END"
        parts.append(f"CASE WHEN {f} = 0 THEN greatest(-4.0, least(4.0, {u0} - log2(tf_{f}))) ELSE 0 END")
    return " + ".join(f"({p})" for p in parts)


@query(LEVELS + f", w AS (SELECT lid, rid, {_weight()} AS weight FROM x) SELECT lid, rid, round(weight, 6) AS weight, round(1 / (1 + pow(2, -weight)), 9) AS probability FROM w WHERE weight > -2")
def linkage_scores(spark, d):
    """log2 weights with term frequencies within four, probabilities, and the pairs over the retention weight."""
    out = blocks(spells(spark, d)).scored(M, U, LAM)
    return out.select("lid", "rid", F.round("weight", 6).alias("weight"), F.round("probability", 9).alias("probability"))


@query("""
SELECT school, avg(n) AS rows_per_key FROM (SELECT event_type AS school, user_id % 20 AS l, user_id % 7 AS g, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END AS p, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1 HAVING avg(n) > 1.25
""")
def annual_detection(spark, d):
    """Schools whose registers name a person each year."""
    u = F.col("user_id")
    rows = t(spark, d, "events").select(F.col("event_type").alias("school"), (u % 20).alias("ln_norm"), (u % 7).alias("gn_init"), F.when(u % 3 != 0, u).alias("location_id"))
    return linkage.annual_schools(rows)


@query("""
WITH e AS (SELECT c_custkey AS a, c_custkey + 7 AS b FROM customer WHERE c_custkey % 50 <> 0 AND c_custkey + 7 <= (SELECT max(c_custkey) FROM customer)),
     k AS (SELECT DISTINCT x AS id FROM (SELECT a AS x FROM e UNION ALL SELECT b FROM e)), g AS (SELECT id, id % 7 AS r, sum(CASE WHEN (id - 7) % 50 = 0 OR id <= 7 THEN 1 ELSE 0 END) OVER (PARTITION BY id % 7 ORDER BY id) AS run FROM k)
SELECT id, min(id) OVER (PARTITION BY r, run) AS component FROM g
""")
def linked_components(spark, d):
    """The smallest id that links lead to."""
    c = t(spark, d, "customer")
    top = c.agg(F.max("c_custkey")).first()[0]
    return linkage.connected(c.where(F.col("c_custkey") % 50 != 0).where(F.col("c_custkey") + 7 <= top).select(F.col("c_custkey").alias("lid"), (F.col("c_custkey") + 7).alias("rid")))


# ---------------------------------------------------------------- keys of place names


SAID = """
SELECT DISTINCT CASE p_partkey % 8 WHEN 0 THEN 'Herzogthum ' || a WHEN 1 THEN a || ' a. d. O.' WHEN 2 THEN a || ' in ' || b WHEN 3 THEN a || ', Kreis ' || b WHEN 4 THEN 'aus ' || a
       WHEN 5 THEN a || 'ensis' WHEN 6 THEN 'St. ' || a || '-' || b ELSE 'Mayn' || a END AS name
FROM (SELECT p_partkey, upper(string_split(p_name, ' ')[1][1]) || string_split(p_name, ' ')[1][2:] AS a, upper(string_split(p_type, ' ')[1][1]) || lower(string_split(p_type, ' ')[1][2:]) AS b FROM part)
"""


def said(spark, d):
    first = lambda c: F.concat(F.upper(F.substring(F.split(c, " ")[0], 1, 1)), F.substring(F.split(c, " ")[0], 2, 100))
    kind = F.split("p_type", " ")[0]
    p = t(spark, d, "part").select("p_partkey", first("p_name").alias("a"), F.concat(F.upper(F.substring(kind, 1, 1)), F.lower(F.substring(kind, 2, 100))).alias("b"))
    a, b, l = F.col("a"), F.col("b"), F.lit  # noqa: E741
    forms = (F.concat(l("Herzogthum "), a), F.concat(a, l(" a. d. O.")), F.concat(a, l(" in "), b), F.concat(a, l(", Kreis "), b), F.concat(l("aus "), a), F.concat(a, l("ensis")), F.concat(l("St. "), a, l("-"), b), F.concat(l("Mayn"), a))
    return p.select(F.element_at(F.array(*forms), (F.col("p_partkey") % 8 + 1).cast("int")).alias("name")).distinct()


def _rules(c: str, rules) -> str:
    for pattern, to in rules:
        to = to.replace("$1", "\\1")
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return c


def _fold(c: str) -> str:
    for x, y in text.SPELT.items():
        c = f"replace({c}, '{x}', '{y}')"
    flat = f"regexp_replace(regexp_replace(lower(strip_accents({c})), '[-/_]', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')"
    return f"trim(regexp_replace({flat}, '\\s+', ' ', 'g'))"


def ladder_sql(source: str) -> str:
    """A SELECT of name, k_fold, k_expand, k_modern, k_strip and hint from a relation with ``name``."""
    expand = _rules("k_fold", [(r"\b" + a.replace(" ", r"\s+") + r"\b", b) for a, b in text.ABBREVIATIONS])
    inner = r"\s+(?:" + "|".join(text.SPLITTING) + r")\s+(.+)$"
    prepositions = "^(?:" + "|".join(text.LEADING_PREPOSITIONS) + r")\s+"
    lead = text._leading()
    return f"""
    SELECT name, nullif(k_fold, '') AS k_fold, nullif(k_expand, '') AS k_expand, nullif(k_modern, '') AS k_modern, nullif(trim(regexp_replace(s2, '{inner}', '')), '') AS k_strip,
           nullif(concat_ws(' ', tail, kind, nullif(trim(regexp_extract(s2, '{inner}', 1)), '')), '') AS hint
    FROM (SELECT *, nullif(trim(regexp_extract(s1, '{lead}')), '') AS kind, regexp_replace(s1, '{lead}', '') AS s2
    FROM (SELECT *, regexp_replace(CASE WHEN regexp_matches(k_modern, '^([^,]+),\\s*(.+)$') THEN trim(regexp_extract(k_modern, '^([^,]+),\\s*(.+)$', 1)) ELSE k_modern END, '{prepositions}', '') AS s1,
           CASE WHEN regexp_matches(k_modern, '^([^,]+),\\s*(.+)$') THEN nullif(trim(regexp_extract(k_modern, '^([^,]+),\\s*(.+)$', 2)), '') END AS tail
    FROM (SELECT *, trim(regexp_replace({_rules('k_expand', text.SPELLING)}, '\\s+', ' ', 'g')) AS k_modern
    FROM (SELECT *, trim(regexp_replace({expand}, '\\s+', ' ', 'g')) AS k_expand FROM (SELECT name, {_fold('name')} AS k_fold FROM {source})))))"""


@query(f"WITH s AS ({SAID}) SELECT * FROM ({ladder_sql('s')})")
def key_ladder(spark, d):
    """All keys of free-text places but the phonetic one, which phonetic_places has."""
    return text.ladder(said(spark, d), "name").select("name", "k_fold", "k_expand", "k_modern", "k_strip", "hint")


def _place_code(letters: str) -> str:
    """_code() with the rules of place names: a final d, t or c and an initial x as if a sibilant stood beside them."""
    sql = _code(letters)
    after, before = "coalesce(substr(s, i + 1, 1), '')", "CASE WHEN i > 1 THEN coalesce(substr(s, i - 1, 1), '') ELSE '' END"
    for chars in ("csz", "ahkloqrux", "ahkoqux"):
        sql = sql.replace(f"({after} <> '' AND contains('{chars}', {after}))", f"({after} = '' OR contains('{chars}', {after}))")
    return sql.replace(f"({before} <> '' AND contains('ckq', {before}))", f"({before} = '' OR contains('ckq', {before}))")


@query(f"""
WITH said AS ({SAID}), w AS (SELECT DISTINCT unnest(string_split(lower(name), ' ')) AS name FROM said), n AS (SELECT name FROM w WHERE regexp_replace(name, '[^a-z]', '', 'g') <> '')
SELECT name, code FROM ({_place_code("regexp_replace(strip_accents(translate(lower(name), 'äöüéè', 'aouee')), '[^a-z]', '', 'g')")})
""")
def phonetic_places(spark, d):
    """The codes of the words of place names."""
    w = said(spark, d).select(F.explode(F.split(F.lower("name"), " ")).alias("name")).distinct().where(F.regexp_replace("name", "[^a-z]", "") != "")
    return w.select("name", text.phonetic_word(F.col("name")).alias("code"))


# ---------------------------------------------------------------- evaluation

FOUND = "SELECT c_custkey AS spell_id, c_custkey // 3 % 500 AS student_id, c_custkey // 4 % 400 AS person, ['berlin', 'jena', 'kiel'][c_custkey * 5 % 3 + 1] AS school, CASE WHEN c_custkey % 7 < 4 THEN 'full' ELSE 'short' END AS kind FROM customer"
TRUTH = "SELECT a.spell_id AS l, b.spell_id AS r, a.student_id = b.student_id AS linked, a.school AS s1, b.school AS s2, a.kind AS k1, b.kind AS k2 FROM s a JOIN s b ON a.person = b.person AND a.spell_id < b.spell_id AND a.school <> b.school"


def found(spark, d):
    k = F.col("c_custkey")
    return t(spark, d, "customer").select(
        k.alias("spell_id"), (F.floor(k / 3) % 500).alias("student_id"), (F.floor(k / 4) % 400).alias("person"),
        F.element_at(F.array(F.lit("berlin"), F.lit("jena"), F.lit("kiel")), (k * 5 % 3 + 1).cast("int")).alias("school"), F.when(k % 7 < 4, "full").otherwise("short").alias("kind"),
    )


@query(f"""
WITH s AS ({FOUND}), t AS ({TRUTH}), p AS (SELECT a.person = b.person AS ok FROM s a JOIN s b ON a.student_id = b.student_id AND a.spell_id < b.spell_id AND a.school <> b.school),
     n AS (SELECT (SELECT count(*) FROM p) AS predicted, (SELECT count(*) FROM t) AS actual, (SELECT count(*) FROM p WHERE ok) AS correct)
SELECT predicted, actual, correct, round(correct / predicted, 9) AS precision, round(correct / actual, 9) AS recall, round(2 * (correct / predicted) * (correct / actual) / (correct / predicted + correct / actual), 9) AS f1 FROM n
""")
def linkage_quality(spark, d):
    """Pairs of different schools: predicted, actual, correct."""
    out = linkage.cross_school_quality(found(spark, d))
    return out.select("predicted", "actual", "correct", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""
WITH s AS ({FOUND}), t AS ({TRUTH}), b AS (SELECT l.spell_id AS lid, r.spell_id AS rid FROM s l JOIN s r ON l.person = r.person AND l.kind = r.kind AND l.spell_id < r.spell_id)
SELECT count(*) AS true_pairs, count(b.lid) AS in_blocks, round(count(b.lid) / count(*), 9) AS recall FROM t LEFT JOIN b ON lid = l AND rid = r
""")
def linkage_blocking_recall(spark, d):
    """The share of true pairs that the blocks hold, the ceiling of all that follows."""
    s = found(spark, d)
    out = linkage.blocking_recall(linkage.multi_rule_pairs(s, "spell_id", [["person", "kind"]]), s.select("spell_id", "person", "school"))
    return out.withColumn("recall", F.round("recall", 9))


@query(f"""
WITH s AS ({FOUND}), t AS ({TRUTH}), e AS (SELECT a.person = b.person AS ok, (a.spell_id * 13 + b.spell_id * 7) % 100 / 100.0 AS p FROM s a JOIN s b ON a.student_id = b.student_id AND a.spell_id < b.spell_id AND a.school <> b.school),
     h AS (SELECT unnest([0.5, 0.7, 0.8, 0.9, 0.95, 0.99]) AS threshold)
SELECT threshold::double AS threshold, count(*) FILTER (p >= threshold) AS edges, round(count(*) FILTER (p >= threshold AND ok) / nullif(count(*) FILTER (p >= threshold), 0), 9) AS precision,
       round(count(*) FILTER (p >= threshold AND ok) / (SELECT count(*) FROM t), 9) AS recall FROM e, h GROUP BY threshold
""")
def linkage_thresholds(spark, d):
    """Edges, their precision and recall at six thresholds."""
    s = found(spark, d)
    edges = linkage.multi_rule_pairs(s, "spell_id", [["student_id"]], F.col("l.school") != F.col("r.school")).withColumn("probability", ((F.col("lid") * 13 + F.col("rid") * 7) % 100) / 100.0)
    out = linkage.threshold_sweep(edges, s.select("spell_id", "person", "school"))
    return out.select("threshold", "edges", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query(f"""
WITH s AS ({FOUND}), t AS ({TRUTH}), x AS (SELECT 'school' AS by, least(s1, s2) AS a, greatest(s1, s2) AS b, linked FROM t UNION ALL SELECT 'stratum', least(k1, k2), greatest(k1, k2), linked FROM t)
SELECT "by", a, b, count(*) AS true_pairs, round(avg(linked::int), 9) AS recall FROM x GROUP BY ALL HAVING count(*) >= 60 OR "by" = 'stratum'
""".replace("AS by", 'AS "by"'))
def linkage_recall(spark, d):
    """Recall by pair of schools (of sixty true pairs and more) and by abbreviation stratum."""
    s = found(spark, d)
    schools, strata = linkage.recall_by(s, "school", 60), linkage.recall_by(s, "kind")
    both = schools.withColumn("by", F.lit("school")).union(strata.withColumn("by", F.lit("stratum")))
    return both.select("by", "a", "b", "true_pairs", F.round("recall", 9).alias("recall"))


@query(f"""
WITH s AS ({FOUND}), c AS (SELECT student_id, list(DISTINCT school) AS schools FROM s GROUP BY 1), g AS (SELECT spell_id, ['berlin', 'jena', 'bonn'][spell_id % 3 + 1] AS target FROM s WHERE spell_id % 4 = 0)
SELECT count(*) AS reachable, count(*) FILTER (list_contains(schools, target)) AS hit, count(*) FILTER (NOT list_contains(schools, target) AND len(schools) > 1) AS wrong_school, count(*) FILTER (len(schools) = 1) AS unlinked
FROM g JOIN s USING (spell_id) JOIN c USING (student_id)
""")
def linkage_gold(spark, d):
    """Clusters against stated earlier schools."""
    s, k = found(spark, d), F.col("spell_id")
    gold = s.where(k % 4 == 0).select("spell_id", F.element_at(F.array(F.lit("berlin"), F.lit("jena"), F.lit("bonn")), (k % 3 + 1).cast("int")).alias("target"))
    return linkage.gold_validation(s.select("spell_id", "student_id", "school"), gold)
