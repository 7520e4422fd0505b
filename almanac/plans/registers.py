"""Queries of readers, register cleaning, names, years and places over the driver's tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from .. import checkpoint_dir
from ..functions import dates, geo, text
from ..operators import ordered, panel, registers
from ..sources import contracts, readers, sinks
from .catalog import GEO, places, query, t


def folder(spark, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def value(c: str, table: dict[str, str], other: str = "NULL") -> str:
    """A mapping as a SQL CASE."""
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {other} END"


# ---------------------------------------------------------------- readers and sinks


@query("""
WITH v AS (SELECT 0 AS file_rank, * FROM (SELECT n_name AS name, CAST(n_nationkey AS VARCHAR) AS key, CAST(n_regionkey AS VARCHAR) AS extra FROM nation)
           UNION ALL SELECT 2, s_name, CAST(s_suppkey AS VARCHAR), NULL FROM supplier)
SELECT file_rank, name, key, extra FROM v
""")
def csv_volumes(spark, d):
    """CSV sink and all-text scan, two of three volumes by manifest, relaxed union, a transform for each file."""
    to = folder(spark, "volumes")
    n, s = t(spark, d, "nation"), t(spark, d, "supplier")
    sinks.write_csv(n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("extra")), f"{to}/kiel_1")
    sinks.write_csv(n.select("n_name"), f"{to}/bonn_1")
    sinks.write_csv(s.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("key")), f"{to}/kiel_2", one_file=True)
    rows = readers.volumes(spark, to, ["kiel_1", "bonn_1", "kiel_2"], "kiel", per_file=lambda df: df.where("name is not null"))
    return rows.select(F.col("file_rank").cast("int"), "name", "key", "extra")


@query("""SELECT c_custkey AS key, c_name AS name, try_cast(c_mktsegment AS INTEGER) AS segment, c_acctbal AS balance, NULL::date AS missing FROM customer""")
def typed_csv(spark, d):
    """A scan under a schema: what doesn't parse is null, what isn't there too."""
    to = folder(spark, "typed")
    sinks.write_csv(t(spark, d, "customer").select(F.col("c_acctbal").alias("balance"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), to)
    return readers.typed_csv(spark, to, "key bigint, name string, segment int, balance double, missing date")


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS id, nullif(trim(p_brand), '') AS flag, NULL AS empty, '"' || p_name AS name FROM part
""")
def positional_rows(spark, d):
    """Headerless tab-separated lines: by place, quotes kept, surplus fields cut, blanks trimmed, empty ones null."""
    to = folder(spark, "positional")
    line = F.concat_ws("\t", F.col("p_partkey").cast("string"), F.concat(F.lit(" "), "p_brand", F.lit("  ")), F.lit("  "), F.concat(F.lit('"'), "p_name"), F.lit("extra"))
    t(spark, d, "part").select(line.alias("value")).write.text(to)
    return readers.positional_tsv(spark, to, ["id", "flag", "empty", "name"])


@query("""
WITH y AS (SELECT n_nationkey // 5 AS v, n_nationkey % 5 AS page, 1800 + n_nationkey % 5 + CASE WHEN n_nationkey % 7 = 3 THEN 50 ELSE 0 END AS year FROM nation),
     n AS (SELECT *, coalesce(lag(year) OVER w, year) AS b, coalesce(lead(year) OVER w, year) AS a FROM y WINDOW w AS (PARTITION BY v ORDER BY page)),
     r AS (SELECT v, page, CASE WHEN b <= a AND (year < b OR year > a) THEN a ELSE year END AS year FROM n),
     s AS (SELECT *, row_number() OVER w AS i, lag(year) OVER w AS l FROM r WINDOW w AS (PARTITION BY v ORDER BY page))
SELECT 'vol_' || v AS volume_id, page::int AS source_page, year::bigint AS year_helper FROM s WHERE i = 1 OR year = l + 1
""")
def page_head_years(spark, d):
    """Files of one JSON object {page: text}; years in the heads, misread ones repaired, only steps of one kept."""
    to = folder(spark, "heads")
    rows = t(spark, d, "nation").select("n_nationkey").collect()  # 25 rows
    for v in sorted({r[0] // 5 for r in rows}):
        heads = {str(r[0] % 5): f"Ostern {1800 + r[0] % 5 + (50 if r[0] % 7 == 3 else 0)}" for r in rows if r[0] // 5 == v}
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{to}/vol_{v}.json")
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
        out.write(json.dumps(heads).encode())
        out.close()
    return registers.page_years(readers.page_heads(spark, to))


@query("""
SELECT 'same_rows' AS contract, true AS holds UNION ALL SELECT 'unique', count(*) = count(DISTINCT c_custkey) FROM customer
UNION ALL SELECT 'refers', count(*) FILTER (c_nationkey NOT IN (SELECT n_nationkey FROM nation)) = 0 FROM customer
UNION ALL SELECT 'unique_segment', count(*) = count(DISTINCT c_mktsegment) FROM customer UNION ALL SELECT 'positive', min(c_acctbal) >= 0 FROM customer
""")
def output_contracts(spark, d):
    """Which of some contracts hold; a contract that doesn't raises an error."""
    c, n = t(spark, d, "customer"), t(spark, d, "nation")

    def holds(check) -> bool:
        try:
            check()
        except contracts.ContractError:
            return False
        return True

    rows = [
        ("same_rows", holds(lambda: contracts.same_rows(c, c.repartition(3, "c_name"), ["c_custkey", "c_name"]))), ("unique", holds(lambda: contracts.unique(c, ["c_custkey"]))),
        ("refers", holds(lambda: contracts.refers(c, "c_nationkey", n, "n_nationkey"))), ("unique_segment", holds(lambda: contracts.unique(c, ["c_mktsegment"]))),
        ("positive", holds(lambda: contracts.holds(c, F.col("c_acctbal") >= 0, "debt"))),
    ]
    return spark.createDataFrame(rows, "contract string, holds boolean")


# ---------------------------------------------------------------- order across volumes


@query("""
WITH e AS (SELECT event_id, user_id, CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS x, row_number() OVER (ORDER BY user_id, event_id) AS g FROM events),
     l AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN g END) OVER (ORDER BY g) AS at FROM e)
SELECT l.event_id, CASE WHEN l.g - l.at <= 2 THEN s.x END AS limited, s.x AS unlimited FROM l LEFT JOIN e s ON l.at = s.g
""")
def fill_across_volumes(spark, d):
    """A fill that runs on from volume to volume, each volume in its own task."""
    e = t(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_type") != "click", F.col("event_type")).alias("x"))
    both = ordered.fill_across(ordered.fill_across(e, "limited", F.col("x"), "user_id", ["event_id"], 2), "unlimited", F.col("x"), "user_id", ["event_id"])
    return both.select("event_id", "limited", "unlimited")


KEEP = "CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_type IN ('view', 'click') THEN '=' ELSE event_type END"


@query(f"""
WITH e AS (SELECT event_id, user_id, ts, CASE WHEN {KEEP} IS NULL THEN '\\0' WHEN {KEEP} = '=' THEN NULL ELSE {KEEP} END AS x FROM events)
SELECT event_id, nullif(last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND CURRENT ROW), '\\0') AS filled FROM e
""")
def ditto_fill_with_nulls(spark, d):
    """Ditto marks are filled, true nulls stay and are not filled over."""
    e = t(spark, d, "events").withColumn("x", F.expr(KEEP))
    return e.select("event_id", ordered.ditto_fill(F.col("x"), ["="], ["user_id"], ["ts", "event_id"], 10, keep_nulls=True).alias("filled"))


# ---------------------------------------------------------------- years


@query("""
WITH e AS (SELECT event_id, 1800 + event_id % 60 AS y, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 1800 + event_id % 57 END AS p, event_id % 3 = 0 AS s FROM events)
SELECT event_id, CASE WHEN s AND p IS NOT NULL THEN p WHEN abs(y - p) > 1 THEN coalesce(p, y) ELSE y END AS corrected, CASE WHEN abs(y - p) <= 2 OR event_id % 100 = 1 THEN y END AS checked,
       'kiel_' || (event_id % 90 + 10) AS volume, 1800 + event_id % 90 + 10 AS volume_year, CASE WHEN event_id % 7 <> 0 THEN 1810 + event_id % 9 END AS lenient,
       CASE WHEN event_id % 2 = 0 AND y < 1826 THEN 'muenchen_early' WHEN event_id % 2 = 0 THEN 'muenchen' ELSE 'bonn' END AS school FROM e
""")
def year_rules(spark, d):
    i = F.col("event_id")
    e = t(spark, d, "events").select("event_id", (1800 + i % 60).alias("y"), F.when(i % 5 != 0, 1800 + i % 57).alias("p"), (i % 3 == 0).alias("s"))
    volume = F.concat(F.lit("kiel_"), (i % 90 + 10).cast("string"))
    day = F.when(i % 7 == 0, "o. D.").otherwise(F.concat((1810 + i % 9).cast("string"), F.lit("-04-01")))
    return e.select(
        "event_id", dates.corrected_year(F.col("y"), F.col("p"), F.col("s")).alias("corrected"), dates.checked_year(F.col("y"), F.col("p"), 2, i % 100 == 1).alias("checked"), volume.alias("volume"),
        dates.volume_year(volume).alias("volume_year"), dates.lenient_year(day).cast("bigint").alias("lenient"),
        dates.period(F.when(i % 2 == 0, "muenchen").otherwise("bonn"), F.col("y"), "muenchen", 1826).alias("school"),
    )


PAGES = "SELECT n_nationkey // 13 AS v, (n_nationkey % 13 * 3)::bigint AS page, CASE WHEN n_nationkey % 2 = 0 THEN 1840 + n_nationkey % 13 // 2 END AS helper FROM nation"


@query(f"""
WITH p AS ({PAGES}), v AS (SELECT event_id, event_id % 2 AS v, event_id % 40 AS page, CASE WHEN event_id % 11 = 0 THEN NULL ELSE 1838 + event_id % 12 END AS y FROM events),
     j AS (SELECT v.*, p.helper, CASE v.v WHEN 0 THEN 'heidelberg_1846' ELSE 'heidelberg_1807' END AS volume FROM v LEFT JOIN p ON v.v = p.v AND v.page = p.page),
     f AS (SELECT *, last_value(helper IGNORE NULLS) OVER (PARTITION BY volume ORDER BY page, event_id ROWS UNBOUNDED PRECEDING) AS pg FROM j)
SELECT event_id, CASE WHEN v = 0 THEN CASE WHEN pg IS NULL THEN y WHEN y IS NULL OR y < pg OR y > pg + 2 THEN pg ELSE y END
       ELSE CASE WHEN y = 1807 AND pg > y THEN pg WHEN abs(y - coalesce(pg, y)) > 2 THEN pg ELSE y END END AS first_year FROM f
""")
def page_corrections(spark, d):
    """Years against their page's, strict in volumes that were confirmed."""
    i, n = F.col("event_id"), F.col("n_nationkey")
    name = lambda v: F.when(v == 0, "heidelberg_1846").otherwise("heidelberg_1807")
    helper = t(spark, d, "nation").select(name(F.floor(n / 13)).alias("volume_id"), (n % 13 * 3).cast("long").alias("source_page"), F.when(n % 2 == 0, 1840 + F.floor(n % 13 / 2)).alias("year_helper"))
    rows = t(spark, d, "events").select("event_id", name(i % 2).alias("volume_id"), (i % 40).alias("source_page"), F.when(i % 11 != 0, 1838 + i % 12).alias("first_year"), F.lit(0).alias("file_rank"), i.alias("line_no"))
    return registers.page_corrected(rows, helper).select("event_id", "first_year")


# ---------------------------------------------------------------- names


GIVEN = ("Johann Friedrich", "Carolus", "Wilh. Aug.", "Georgius", "Louis", "Joh.", "Franz-Joseph", "Hans Peter", "C. F.", "Petrus Paulus")
LAST = ("von der Tann", "Müller", "de la Motte", "Schöffler", "van der Velde", "O'Neill", "zu Solms", "Hoffmann", "vom Stein", "Ebbinghaus")
TOKENS = {"johann": "johann", "friedrich": "friedrich", "carolus": "karl", "georgius": "georg", "louis": "ludwig", "franz": "franz", "joseph": "joseph", "hans": "johann", "peter": "peter", "petrus": "peter", "paulus": "paul"}
SURNAMES = {
    "von der Tann": ("von der", "tan"), "Müller": (None, "mueler"), "de la Motte": ("de la", "mote"), "Schöffler": (None, "schoefler"), "van der Velde": ("van der", "velde"),
    "O'Neill": (None, "o'neil"), "zu Solms": ("zu", "solms"), "Hoffmann": (None, "hofman"), "vom Stein": ("vom", "stein"), "Ebbinghaus": (None, "ebinghaus"),
}


def _literal(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


_SURNAMES = ", ".join(f"({_literal(k)}, {_literal(p)}, {_literal(n)})" for k, (p, n) in SURNAMES.items())
_GIVEN_LIST = "[" + ", ".join(_literal(x) for x in GIVEN) + "]"
_LAST_LIST = "[" + ", ".join(_literal(x) for x in LAST) + "]"
_SHORT = "(ends_with(x, '.') OR length(x) <= 3)"


@query(f"""
WITH c AS (SELECT c_custkey, {_GIVEN_LIST}[c_custkey % 10 + 1] AS first_names, {_LAST_LIST}[c_custkey // 10 % 10 + 1] AS last_name FROM customer),
     s AS (SELECT * FROM (VALUES {_SURNAMES}) AS s(last_name, particle, name)),
     k AS (SELECT c_custkey, unnest(regexp_split_to_array(lower(first_names), '[ -]+')) AS x, generate_subscripts(regexp_split_to_array(lower(first_names), '[ -]+'), 1) AS i FROM c),
     m AS (SELECT c_custkey, i, {_SHORT} AS short, CASE WHEN {_SHORT} THEN x ELSE {value('x', TOKENS, 'x')} END AS x FROM k),
     g AS (SELECT c_custkey, string_agg(x, ' ' ORDER BY i) FILTER (NOT short) AS given, translate(string_agg(x[1], '' ORDER BY i), 'ciy', 'kjj') AS initials, bool_or(short) AS abbreviated FROM m GROUP BY 1)
SELECT c_custkey, s.particle, s.name, given, initials, array_to_string(list_sort(string_split(initials, '')), '') AS letters, abbreviated FROM c JOIN s USING (last_name) JOIN g USING (c_custkey)
""")
def person_names(spark, d):
    """Surname and particle, given names in one spelling, initials, their letters in order, and whether any is short."""
    k = F.col("c_custkey")
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), i.cast("int"))
    c = t(spark, d, "customer").select("c_custkey", pick(GIVEN, k % 10 + 1).alias("f"), pick(LAST, F.floor(k / 10) % 10 + 1).alias("l"))
    first = text.initials(F.col("f"))
    return c.select(
        "c_custkey", text.surname(F.col("l"))["particle"].alias("particle"), text.surname(F.col("l"))["name"].alias("name"), F.array_join(text.given_names(F.col("f")), " ").alias("given"),
        first.alias("initials"), text.sorted_letters(first).alias("letters"), text.has_abbreviation(F.col("f")).alias("abbreviated"),
    )


NOBLE = {
    "Graf Otto|Bernstorff": "titled_noble", "Karl|von Berg": "particle_untitled_ambiguous", "Karl v.|Arnim": "particle_untitled_ambiguous", "Karl|v.Arnim": "particle_untitled_ambiguous",
    "Otto|Grafe": "no_marker_likely_non_noble", "Freiherr|vom Stein": "titled_noble", "Anton|Zumbusch": "no_marker_likely_non_noble", "Max|Bethmann": "known_noble_bare_exception", "Max|von Holtei": "known_commoner_von_exception",
}
_NOBLE = "[" + ", ".join(_literal(x) for x in NOBLE) + "]"


@query(f"""
WITH c AS (SELECT c_custkey, {_NOBLE}[c_custkey % {len(NOBLE)} + 1] AS n FROM customer), k AS (SELECT *, {value('n', NOBLE)} AS kind FROM c)
SELECT c_custkey, kind, kind IN ('titled_noble', 'particle_untitled_ambiguous', 'known_noble_bare_exception') AS noble FROM k
""")
def nobility_classes(spark, d):
    both = F.split(F.element_at(F.array(*[F.lit(x) for x in NOBLE]), (F.col("c_custkey") % len(NOBLE) + 1).cast("int")), r"\|")
    kind, noble = text.nobility(both[0], both[1], ["Bethmann"], ["von Holtei"])
    return t(spark, d, "customer").select("c_custkey", kind.alias("kind"), noble.alias("noble"))


FIELDS = ("Jura", "Theol.", "Med", "Naturw", "Philol", "Kam", "Chir", None, "Berg", "Forstw")


@query(f"""
WITH c AS (SELECT c_custkey, [{', '.join(_literal(x) for x in FIELDS)}][c_custkey % 10 + 1] AS f, ['k.', 'ev', 'Jüd', '?', 'luth'][c_custkey % 5 + 1] AS r FROM customer)
SELECT c_custkey, regexp_matches(f, 'Jura|Kam|Staatsw') AS law_admin, regexp_matches(f, 'Theol') AS theology, regexp_matches(f, 'Med|Chir|Pharm') AS medicine, regexp_matches(f, 'Math|Physik|Berge|Naturw|Forstw') AS sciences,
       regexp_matches(f, 'Phil|Philol|Geschichte|Lit') AS humanities, CASE WHEN r = 'k.' THEN 'catholic' WHEN r = 'Jüd' THEN 'jewish' WHEN r IN ('ev', 'luth') THEN 'protestant' END AS faith FROM c
""")
def field_groups(spark, d):
    """A register's field names in five groups, and religion codes in three."""
    k = F.col("c_custkey")
    f = F.element_at(F.array(*[F.lit(x) for x in FIELDS]), (k % 10 + 1).cast("int"))
    r = F.element_at(F.array(*[F.lit(x) for x in ("k.", "ev", "Jüd", "?", "luth")]), (k % 5 + 1).cast("int"))
    flags = registers.field_flags(f, registers.SPECS["bonn"])
    return t(spark, d, "customer").select("c_custkey", *[c.alias(n) for n, c in flags.items()], F.when(r == "luth", "protestant").otherwise(registers.religion_class(r)).alias("faith"))


# ---------------------------------------------------------------- places, polities, distances


@query(f"""
WITH p AS ({GEO}), x AS (SELECT a.k AS a, b.k AS b, a.lat AS y1, a.lon AS x1, b.lat AS y2, b.lon AS x2 FROM p a CROSS JOIN p b)
SELECT a, b, round(111.0 * sqrt(pow((x2 - x1) * cos(radians((y1 + y2) / 2)), 2) + pow(y2 - y1, 2)), 6) AS flat_km,
       round(coalesce(abs(y2 - y1) * abs(x2 - x1) * cos((y1 + y2) / 2 * 3.14159265 / 180) * 12321, 0), 4) AS area, least(greatest(x2 - x1, -20.0), 20.0) AS clipped,
       round(CASE WHEN a % 3 = 0 THEN 0 ELSE -ln(1 + coalesce(CASE WHEN b % 4 <> 0 THEN abs(x2 - x1) * 10 END, 500.0) / 75) END, 9) AS coherence,
       round(1.5 * ln(1 + a) + 0.5 * ln(1 + b), 9) AS prominence FROM x
""")
def place_terms(spark, d):
    """Flat distance, box area, clipping, coherence of two fields, prominence."""
    p = places(spark, d)
    x = p.select(F.col("k").alias("a"), F.col("lat").alias("y1"), F.col("lon").alias("x1")).crossJoin(F.broadcast(p.select(F.col("k").alias("b"), F.col("lat").alias("y2"), F.col("lon").alias("x2"))))
    c = lambda n: F.col(n)
    return x.select(
        "a", "b", F.round(geo.equirectangular(c("y1"), c("x1"), c("y2"), c("x2")), 6).alias("flat_km"), F.round(geo.box_area(c("y1"), c("y2"), c("x1"), c("x2")), 4).alias("area"), geo.clip(c("x2") - c("x1"), -20.0, 20.0).alias("clipped"),
        F.round(geo.coherence(F.when(c("b") % 4 != 0, F.abs(c("x2") - c("x1")) * 10), c("a") % 3 != 0), 9).alias("coherence"), F.round(geo.prominence({"a": 1.5, "b": 0.5}), 9).alias("prominence"),
    )


@query("""
WITH g AS (SELECT n_name AS place, n_nationkey * 100 + n_regionkey AS polity, n_nationkey AS k FROM nation),
     a AS (SELECT CASE WHEN k % 3 = 0 THEN place END AS place, CASE WHEN k % 3 = 1 THEN polity END AS polity, CASE WHEN k % 5 = 0 THEN NULL ELSE 1805 + k END AS off, CASE WHEN k % 2 = 0 THEN 1815 + k END AS on_ FROM g WHERE k % 3 < 2),
     c AS (SELECT c_custkey, place, polity, 1800 + c_custkey % 50 AS year FROM customer JOIN g ON c_nationkey = k),
     j AS (SELECT c.*, l.off AS lo, l.on_ AS lr, p.off AS po, p.on_ AS pr FROM c LEFT JOIN a l ON c.place = l.place LEFT JOIN a p ON c.polity = p.polity)
SELECT c_custkey, polity, year >= coalesce(lo, po) AND (CASE WHEN lo IS NOT NULL THEN lr ELSE pr END IS NULL OR year < CASE WHEN lo IS NOT NULL THEN lr ELSE pr END) AS guild_abolished FROM j
""")
def guild_dates(spark, d):
    """Hierarchical polity ids, and whether guilds were abolished at a place and time."""
    n = t(spark, d, "nation").select(F.col("n_name").alias("place"), panel.polity_id(F.col("n_nationkey"), F.col("n_regionkey"), F.col("n_name"), {"-": 0}).alias("polity"), F.col("n_nationkey").alias("k"))
    k = F.col("k")
    dated = n.where(k % 3 < 2).select(
        F.when(k % 3 == 0, F.col("place")).alias("standard_location_name"), F.when(k % 3 == 1, F.col("polity")).alias("standard_polity_id"),
        F.when(k % 5 == 0, 0).otherwise(1805 + k).alias("abolition_year"), F.when(k % 2 == 0, 1815 + k).otherwise(0).alias("reinstatement_year"),
    )
    rows = t(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == k).select("c_custkey", "place", "polity", (1800 + F.col("c_custkey") % 50).alias("year"))
    return panel.guild_status(rows, dated, "place", "polity", "year").select("c_custkey", F.col("polity").cast("int"), "guild_abolished")


@query(f"""
WITH p AS ({GEO}), g AS (SELECT a.k AS o, b.k AS d, a.lat, a.lon, b.lat AS lat_uni, b.lon AS lon_uni, (a.k % 4) * 100 + a.k % 3 AS po, (b.k % 4) * 100 + b.k % 3 AS pd,
       ['protestant', 'catholic', 'mixed'][a.k % 3 + 1] AS co, ['protestant', 'catholic', 'mixed'][b.k % 3 + 1] AS cd FROM p a CROSS JOIN p b),
     x AS (SELECT *, 2 * 6371.0 * asin(sqrt(least(pow(sin(radians(lat_uni - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat_uni)) * pow(sin(radians(lon_uni - lon) / 2), 2), 1.0))) AS km,
       po // 100 = pd // 100 AS ss, co = cd AND co IN ('protestant', 'catholic') AS sc FROM g)
SELECT o, d, round(CASE WHEN km >= 1 THEN ln(km) ELSE ln(0.5) END, 9) AS log_dist, km < 1 AS same_city, po = pd AS same_polity, ss AS same_state, (ss AND sc)::int AS ss_sc, (ss AND NOT sc)::int AS ss_dc, (NOT ss AND sc)::int AS ds_sc FROM x
""")
def grid_covariates(spark, d):
    p = places(spark, d)
    faith = lambda c: F.element_at(F.array(F.lit("protestant"), F.lit("catholic"), F.lit("mixed")), (c % 3 + 1).cast("int"))
    k = F.col("k")
    code = (k % 4) * 100 + k % 3
    a = p.select(k.alias("o"), "lat", "lon", code.alias("polity_o"), faith(k).alias("confession_o"))
    b = p.select(k.alias("d"), F.col("lat").alias("lat_uni"), F.col("lon").alias("lon_uni"), code.alias("polity_d"), faith(k).alias("confession_d"))
    out = panel.covariates(a.crossJoin(F.broadcast(b)))
    return out.select("o", "d", F.round("log_dist", 9).alias("log_dist"), "same_city", "same_polity", "same_state", "ss_sc", "ss_dc", "ds_sc")


RESOLVED = {"Universität A": "EUROPE", "asia": "ASIA", "ex ac. afri": "AFRICA", "amer": "AMERICA", "xx": None}


@query("""
WITH w AS (SELECT c_custkey, ['Asia u. Afri', 'amer, europe', 'ex ac. Middle/asi', 'nowhere und asiat', 'EUROPE'][c_custkey % 5 + 1] AS said FROM customer),
     r AS (SELECT * FROM (VALUES ('Asia u. Afri', 'ASIA'), ('Asia u. Afri', 'AFRICA'), ('amer, europe', 'AMERICA'), ('amer, europe', 'EUROPE'), ('ex ac. Middle/asi', 'MIDDLE EAST'), ('nowhere und asiat', 'ASIA'), ('EUROPE', 'EUROPE')) AS r(said, name))
SELECT DISTINCT said, name FROM w JOIN r USING (said)
""")
def name_resolver(spark, d):
    """Parts of a free text that share a beginning of four letters or more with just one known name."""
    said = F.element_at(F.array(*[F.lit(x) for x in ("Asia u. Afri", "amer, europe", "ex ac. Middle/asi", "nowhere und asiat", "EUROPE")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    rows = t(spark, d, "customer").select(said.alias("said")).distinct()
    return text.resolve_names(rows, "said", t(spark, d, "region").select(F.col("r_name").alias("name")), "name")


@query("""
WITH p AS (SELECT c_custkey % 3 AS v, c_custkey, 1800 + c_custkey % 45 AS y, c_nationkey AS place, ['A', 'B'][c_custkey % 2 + 1] AS kind FROM customer)
SELECT place, first(kind ORDER BY y, c_custkey) AS kind, first(y ORDER BY y, c_custkey) AS first_year FROM p GROUP BY 1
""")
def origin_table(spark, d):
    k = F.col("c_custkey")
    rows = t(spark, d, "customer").select("c_custkey", (1800 + k % 45).alias("first_year"), F.col("c_nationkey").alias("place"), F.when(k % 2 == 0, "A").otherwise("B").alias("kind"))
    return panel.origins(rows, "place", ["kind", "first_year"], ["first_year", "c_custkey"])


@query("""
WITH x AS (SELECT o_orderkey, ['Pfarrer, Bonn', ' Förster ', 'kfm', 'Ober-Förster', NULL][o_orderkey % 5 + 1] AS said FROM orders)
SELECT o_orderkey, CASE said WHEN 'Pfarrer, Bonn' THEN 'Pfarrer, Bonn' WHEN ' Förster ' THEN 'forestry' WHEN 'kfm' THEN 'trade' WHEN 'Ober-Förster' THEN 'forestry' END AS profession, nullif(split_part(said, ',', 1), '') AS part FROM x
""".replace("nullif(split_part(said, ',', 1), '')", "trim(split_part(said, ',', 1))"))
def professions(spark, d):
    """A dictionary, then rules for what it lacks, once for each distinct text; the part before the first comma."""
    said = F.element_at(F.array(F.lit("Pfarrer, Bonn"), F.lit(" Förster "), F.lit("kfm"), F.lit("Ober-Förster"), F.lit(None)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    rows = t(spark, d, "orders").select("o_orderkey", said.alias("profession"), text.first_part(said).alias("part"))
    return registers.canonical(rows, "profession", {"kfm": "trade"}, [("förster", "forestry")])


@query("""
WITH y AS (SELECT unnest([1820, 1848]) AS year), c AS (SELECT s_suppkey AS k, (s_suppkey % 100) / 10.0 AS x, (s_suppkey * 7 % 100) / 10.0 AS y_ FROM supplier),
     g AS (SELECT k, year, x, y_, CASE WHEN year = 1820 AND x <= 5 THEN 'West' WHEN year = 1848 AND x <= 7 THEN 'West' WHEN year = 1848 AND x >= 8 THEN 'East' END AS state,
           CASE WHEN year = 1820 AND y_ <= 4 AND x <= 5 THEN 'South' END AS province FROM c, y)
SELECT k, year, concat_ws('/', state, province) AS label, CASE state WHEN 'West' THEN 100 WHEN 'East' THEN 200 ELSE 0 END + CASE WHEN province IS NULL THEN 0 ELSE 7 END AS polity_id, y_ BETWEEN 34 AND 72 OR state IS NOT NULL AS broad FROM g
""")
def polities_by_map_year(spark, d):
    """States and provinces of two map years, labels, ids, and the wide box."""
    out = panel.polities_by_year(*_polities(spark, d), [1820, 1848], "x", "y", cell=2.0)
    return out.select("k", "year", "label", "polity_id", panel.broad_europe(F.col("state").isNotNull(), F.col("y"), F.col("x")).alias("broad"))


def _polities(spark, d):
    from ..operators.geometry import RINGS

    ring = lambda a, b, c, e: [{"x": float(x), "y": float(y)} for x, y in ((a, c), (b, c), (b, e), (a, e), (a, c))]
    states = spark.createDataFrame([(1820, "West", 1, [ring(0, 5, 0, 10)]), (1848, "West", 1, [ring(0, 7, 0, 10)]), (1848, "East", 2, [ring(8, 10, 0, 10)])], f"year int, state string, state_id int, rings {RINGS}")
    provinces = spark.createDataFrame([(1820, "South", 7, [ring(0, 5, 0, 4)])], f"year int, province string, province_id int, rings {RINGS}")
    k = F.col("s_suppkey")
    return t(spark, d, "supplier").select(k.alias("k"), (k % 100 / 10).alias("x"), (k * 7 % 100 / 10).alias("y")), states, provinces


@query("""
WITH y AS (SELECT unnest([1820, 1848]) AS year), g AS (SELECT s_suppkey AS k, year, CASE WHEN year = 1820 THEN s_suppkey % 100 / 10.0 <= 5 ELSE s_suppkey % 100 / 10.0 <= 7 OR s_suppkey % 100 / 10.0 >= 8 END AS s,
     year = 1820 AND (s_suppkey * 7 % 100) / 10.0 <= 4 AND s_suppkey % 100 / 10.0 <= 5 AS p FROM supplier, y)
SELECT k, count(*) AS n_rows, count(*) FILTER (NOT s) AS no_state, count(*) FILTER (NOT p) AS no_province, 0::bigint AS several_states, count(*) = 2 AND count(*) FILTER (NOT s) = 0 AS ok FROM g GROUP BY 1
""")
def polity_quality(spark, d):
    """What the polity join left open, for each place."""
    return panel.polity_report(panel.polities_by_year(*_polities(spark, d), [1820, 1848], "x", "y", cell=2.0), "k", 2)


@query("""
WITH s AS (SELECT o_orderkey, 1 + o_orderkey % 4 AS era, ['catholic', 'protestant', 'jewish'][o_orderkey % 3 + 1] AS rel, o_totalprice / 1000 > 150 AS far FROM orders)
SELECT era, rel, round(avg(far::int), 9) AS share_far, count(*) AS n FROM s GROUP BY 1, 2
""")
def religion_far_shares(spark, d):
    """The share of far origins by era and religion."""
    o = F.col("o_orderkey")
    rows = t(spark, d, "orders").select((1 + o % 4).alias("era"), F.element_at(F.array(F.lit("catholic"), F.lit("protestant"), F.lit("jewish")), (o % 3 + 1).cast("int")).alias("rel"), (F.col("o_totalprice") / 1000 > 150).alias("far"))
    return panel.far_shares(rows, ["era", "rel"], F.col("far")).withColumn("share_far", F.round("share_far", 9))


@query("""
WITH p AS (SELECT o_orderpriority AS dest, o_custkey % 25 AS origin, count(*) AS flow FROM orders GROUP BY ALL)
SELECT dest, origin, flow FROM p WHERE dest IN ('1-URGENT', '2-HIGH', '5-LOW')
""")
def donor_pools(spark, d):
    rows = t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("dest"), (F.col("o_custkey") % 25).alias("origin")).agg(F.count(F.lit(1)).alias("flow"))
    return panel.donor_pool(rows, "dest", ["1-URGENT", "2-HIGH", "5-LOW"])
