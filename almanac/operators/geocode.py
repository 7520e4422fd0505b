"""Resolution of free-text places against a gazetteer index: candidates, scores, choice, review."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import cut, release, ship
from ..functions import geo, text
from .gazetteer import PRECISION
from .joins import fuzzy_join, keep_satisfied, null_safe, sized
from .ordered import best_per_key, first_rows, margin, record_id

# ---- fixed values: scores of the ways a string meets a term
METHODS = {"exact": 1.00, "correction": 0.98, "fold": 0.92, "modernize": 0.85, "strip": 0.75, "phonetic": 0.60, "fuzzy": 0.50}
RUNGS = (("fold", "k_fold"), ("modernize", "k_modern"), ("strip", "k_strip"), ("phonetic", "k_phon"))
# ---- fixed values: upper edges of the distance bins as log10(1 + km); one more bin lies beyond the last
EDGES = (0.3, 0.5, 1.0, 1.3, 1.6, 1.9, 2.2, 2.5, 3.0, 3.5, 4.0)
COARSE = ("strip", "phonetic", "fuzzy")
#: Rows of pools that a task collapses, about.
POOLED = 20_000


@dataclass
class Settings:
    gate_km: float = 2000.0
    collapse_km: float = 25.0
    pool: int = 200
    cap: int = 40
    cross: int = 8
    phonetic_guard: float = 0.75
    fuzzy_least: float = 0.92
    fuzzy_letters: int = 4
    at_seat_km: float = 15.0
    low_margin: float = 0.75
    queue: int = 400
    weights: dict = field(default_factory=lambda: {"string": 3.0, "term": 1.0, "prominence": 1.0, "sub": -1.5, "distance": 1.0, "coherence": 1.5, "nested": 2.0, "hint": 2.0, "nowhere": -1.5})


def inventory(students: DataFrame) -> DataFrame:
    """src_raw, freq: all distinct strings of both fields."""
    both = students.select(F.explode(F.array("region", "hometown")).alias("src_raw")).where("src_raw is not null")
    return both.groupBy("src_raw").agg(F.count(F.lit(1)).alias("freq"))


def corrected(strings: DataFrame, corrections: DataFrame | None, territories: str = "seat") -> DataFrame:
    """strings with src (rewritten where a curated row says so), corrected, not_a_place, context."""
    if corrections is None:
        return strings.withColumns({"src": F.col("src_raw"), "corrected": F.lit(False), "not_a_place": F.lit(False), "context": F.lit(None).cast("string")})
    key = lambda c: F.lower(text.strip(F.col(c)))
    rows = corrections if territories != "self" else corrections.where(~F.col("category").eqNullSafe("territory_seat"))
    rows = rows.withColumns({"_key": key("raw"), "canonical": text.null_if_empty(F.col("canonical")), "context": text.null_if_empty(F.col("context"))})
    one = best_per_key(rows, ["_key"], ["raw", "canonical"]).select("_key", "canonical", "context", F.lit(True).alias("_in"))
    out = strings.withColumn("_key", key("src_raw")).join(sized(one), "_key", "left")
    there = F.coalesce("_in", F.lit(False))
    return out.withColumns({
        "corrected": there & F.col("canonical").isNotNull(), "not_a_place": there & F.col("canonical").isNull(), "src": F.coalesce("canonical", "src_raw"),
    }).drop("_key", "_in", "canonical")


def rung_hits(tries: DataFrame, index: DataFrame, s: Settings) -> DataFrame:
    """src_raw, try, SUBJECT_ID, TERM, TERM_ID, term_quality, match_method, string_score: hits of each (src_raw, try, src) on the first rung that has any.

    The rung is found from the distinct keys of both sides, so terms are met on one rung only, and similarities are those of distinct
    pairs of keys; only strings without a hit go on to the phonetic rung, and to the similarity join."""
    by = ["src_raw", "try"]
    terms = index.select("TERM", "TERM_ID", "SUBJECT_ID", "term_quality", F.col("k_strip").alias("_rs"), *[F.col(k).alias(f"_{k}") for _, k in RUNGS])
    equal = [("exact", "src", "TERM"), *[(name, k, f"_{k}") for name, k in RUNGS[:-1]]]
    keyed = tries.join(text.ladder(tries.select("src"), "src"), "src", "left")
    for rung, (_, k, of) in enumerate(equal):
        keyed = keyed.join(sized(terms.where(F.col(of).isNotNull()).select(F.col(of).alias(k)).distinct().withColumn(f"_at{rung}", F.lit(rung))), k, "left")
    keyed = cut(keyed.withColumn("rung", F.coalesce(*[F.col(f"_at{i}") for i in range(len(equal))])).select(*by, "src", *[k for _, k in RUNGS], "rung"))
    told = lambda h, name: h.select(*by, "SUBJECT_ID", "TERM", "TERM_ID", "term_quality", F.lit(name).alias("match_method"), F.lit(METHODS[name]).alias("string_score"))
    release(index.sparkSession)
    hits = None
    for rung, (name, k, of) in enumerate(equal):
        h = told(keyed.where(F.col("rung") == rung).select(*by, F.col(k).alias("_k")).join(terms.withColumn("_k", F.col(of)), "_k"), name)
        hits = h if hits is None else hits.union(h)
    rest = keyed.where("rung is null")
    name, k = RUNGS[-1]
    sounds = rest.select(F.col(k).alias("_k"), F.col("k_strip").alias("_ls")).where("_k is not null and _ls is not null").distinct()
    alike = sounds.join(terms.select(F.col(f"_{k}").alias("_k"), "_rs").where("_k is not null and _rs is not null").distinct(), "_k")
    alike = cut(alike.where(text.jaro_winkler(F.col("_ls"), F.col("_rs")) >= s.phonetic_guard))
    heard = rest.select(*by, F.col(k).alias("_k"), F.col("k_strip").alias("_ls")).join(alike, ["_k", "_ls"]).join(terms.withColumn("_k", F.col(f"_{k}")), ["_k", "_rs"])
    hits = hits.union(told(heard, name))
    met = alike.select(F.col("_k").alias(k), F.col("_ls").alias("k_strip")).distinct()
    left = cut(rest.join(met, [k, "k_strip"], "left_anti").where(F.length("k_strip") >= s.fuzzy_letters).select(*by, F.col("k_strip").alias("_q")))
    near = cut(fuzzy_join(left, index, "_q", "k_strip", least=s.fuzzy_least))
    fuzzy = left.join(near, "_q").join(index.select("k_strip", "SUBJECT_ID", "TERM", "TERM_ID"), "k_strip").select(
        *by, "SUBJECT_ID", "TERM", "TERM_ID", F.lit(None).cast("double").alias("term_quality"), F.lit("fuzzy").alias("match_method"), (METHODS["fuzzy"] * F.col("similarity")).alias("string_score")
    )
    return best_per_key(hits.unionByName(fuzzy), [*by, "SUBJECT_ID"], [F.desc("string_score"), F.desc_nulls_last("term_quality"), F.asc("TERM_ID"), F.asc("TERM")])


def ladder_hits(strings: DataFrame, index: DataFrame, s: Settings) -> DataFrame:
    """rung_hits() of the corrected strings; where a correction meets nothing, of the string as it was written."""
    tries = strings.select("src_raw", F.lit(0).alias("try"), "src").union(strings.where("corrected").select("src_raw", F.lit(1), "src_raw"))
    found = rung_hits(tries, index, s)
    found = found.withColumn("_first", F.min("try").over(Window.partitionBy("src_raw"))).where("try = _first")
    told = found.join(strings.select("src_raw", "corrected"), "src_raw")
    score = F.when(F.col("corrected") & (F.col("match_method") == "exact"), METHODS["correction"]).otherwise(F.col("string_score"))
    return told.withColumn("string_score", score).drop("_first", "try", "corrected")


def coarse_ids(strings: DataFrame, index: DataFrame, column: str, name: str) -> DataFrame:
    """src_raw, name: ids of the regions (no settlements) that a text in ``column`` may mean, as one set for each string."""
    told = strings.where(F.col(column).isNotNull()).select("src_raw", F.col(column).alias("_c")).distinct()
    keys = text.ladder(told.select("_c"), "_c").select("_c", "k_modern")
    regions = index.where(F.col("geo_precision").isin("district", "territory", "country") & F.col("k_modern").isNotNull()).select("k_modern", "SUBJECT_ID").distinct()
    return told.join(keys, "_c").join(regions, "k_modern").groupBy("src_raw").agg(F.collect_set("SUBJECT_ID").alias(name))


def collapse(rows: list[tuple], radius: float) -> list[int]:
    """For each (id, lat, lon, ancestors) in order the place of the row it collapses into: its own if it is kept."""
    kept: list[int] = []
    out, far = [], radius * (1 + 1e-9)
    for i, (own, lat, lon, ancestors) in enumerate(rows):
        into = i
        if lat is not None and lon is not None and not (math.isnan(lat) or math.isnan(lon)):
            for j in kept:
                other, lat2, lon2, up = rows[j]
                if other in ancestors or own in up:
                    into = j
                    break
                if lat2 is None or math.isnan(lat2):
                    continue
                y = math.radians(lat - lat2)
                if geo.RADIUS_KM * abs(y) > far:  # by latitude alone
                    continue
                x = math.radians(lon - lon2) * math.cos(math.radians((lat + lat2) / 2))
                if geo.RADIUS_KM * math.hypot(x, y) <= radius:
                    into = j
                    break
        if into == i:
            kept.append(i)
        out.append(into)
    return out


def candidates(strings: DataFrame, index: DataFrame, seats: DataFrame, s: Settings | None = None) -> DataFrame:
    """Candidate places of each string: hits, distance gate, context, collapse of coincident places, cap."""
    s = s or Settings()
    ship(index.sparkSession)
    places = index.select("SUBJECT_ID", "n_terms", "LAT", "LON", "is_settlement", "is_sub_settlement", "geo_precision", "placetype", "ancestors", "depth", "prominence").dropDuplicates(["SUBJECT_ID"])
    cand = cut(ladder_hits(strings.where("not not_a_place"), index, s).join(places, "SUBJECT_ID"))
    release(index.sparkSession)
    # coarse hits must be near some seat
    seat_list = F.broadcast(seats.agg(F.collect_set(F.struct("LAT0", "LON0")).alias("_seats")))
    near = F.array_min(F.transform("_seats", lambda x: geo.haversine(F.col("LAT"), F.col("LON"), x["LAT0"], x["LON0"])))
    cand = cand.join(seat_list, F.lit(True)).where(~F.col("match_method").isin(*COARSE) | (F.col("LAT").isNotNull() & (near <= s.gate_km))).drop("_seats")
    # a curated context must be an ancestor, where any candidate has it
    cand = cand.join(coarse_ids(strings, index, "context", "_ctx"), "src_raw", "left").withColumn("_fits", F.col("_ctx").isNull() | F.coalesce(F.arrays_overlap("ancestors", "_ctx"), F.lit(False)) | F.array_contains("_ctx", F.col("SUBJECT_ID")))
    cand = cut(keep_satisfied(cut(cand), ["src_raw"], F.col("_fits")).drop("_ctx", "_fits"))
    order = [F.desc("is_settlement"), F.desc("string_score"), F.desc_nulls_last("depth"), F.desc("prominence"), F.asc("SUBJECT_ID")]
    pool = cut(first_rows(cand, ["src_raw"], order, s.pool))
    # few bytes, but much to compute: without a number of its own, all strings would meet in one task
    tasks = max(2 * index.sparkSession.sparkContext.defaultParallelism, pool.count() // POOLED)
    pool = pool.repartition(tasks, "src_raw").withColumn("_o", F.row_number().over(Window.partitionBy("src_raw").orderBy(*order)))

    def run(rows):
        rows = rows.sort_values("_o")
        lists = [(r.SUBJECT_ID, r.LAT, r.LON, set(r.ancestors) if r.ancestors is not None else set()) for r in rows.itertuples()]
        into = collapse(lists, s.collapse_km)
        rows = rows.assign(_into=into, n_merged=[into.count(i) for i in range(len(into))])
        return rows[[a == b for a, b in zip(into, range(len(into)), strict=True)]][["src_raw", "SUBJECT_ID", "n_merged"]]

    kept = pool.select("src_raw", "SUBJECT_ID", "LAT", "LON", "ancestors", "_o").groupBy("src_raw").applyInPandas(run, "src_raw string, SUBJECT_ID long, n_merged long")
    out = cut(pool.drop("_o").join(kept, ["src_raw", "SUBJECT_ID"]))
    out = out.withColumn("n_candidates", F.count(F.lit(1)).over(Window.partitionBy("src_raw")))
    return first_rows(out, ["src_raw"], [F.desc("string_score"), F.desc("n_terms"), F.asc("SUBJECT_ID")], s.cap, hit="cap_hit")


def resolution_keys(students: DataFrame) -> DataFrame:
    """key_id, region, hometown, school: each triple once."""
    distinct = students.select("region", "hometown", "school").distinct()
    return record_id(distinct, ["region", "hometown", "school"], "key_id")


def coherence_table(cand: DataFrame, keys: DataFrame, s: Settings) -> DataFrame:
    """region, hometown, field, SUBJECT_ID, cross_km, nested: to the nearest of the other field's first candidates."""
    top = first_rows(cand.where("LAT is not null"), ["src_raw"], [F.desc("string_score"), F.desc("n_terms"), F.asc("SUBJECT_ID")], s.cross).select("src_raw", "SUBJECT_ID", "LAT", "LON", "ancestors")
    pairs = keys.where("region is not null and hometown is not null").select("region", "hometown").distinct()
    side = lambda p: top.select(F.col("src_raw").alias({"r": "region", "h": "hometown"}[p]), *[F.col(c).alias(p + c) for c in ("SUBJECT_ID", "LAT", "LON", "ancestors")])
    both = pairs.join(side("r"), "region").join(side("h"), "hometown").withColumns({
        "km": geo.haversine(F.col("rLAT"), F.col("rLON"), F.col("hLAT"), F.col("hLON")),
        "nest": F.coalesce(F.array_contains("hancestors", F.col("rSUBJECT_ID")) | F.array_contains("rancestors", F.col("hSUBJECT_ID")), F.lit(False)),
    })
    of = lambda f, p: both.groupBy("region", "hometown", F.col(p + "SUBJECT_ID").alias("SUBJECT_ID")).agg(F.min("km").alias("cross_km"), F.bool_or("nest").alias("nested")).withColumn("field", F.lit(f))
    return of(1, "r").unionByName(of(2, "h"))


def score(keys: DataFrame, cand: DataFrame, seats: DataFrame, hints: DataFrame, prior: DataFrame, upper: list[float], s: Settings | None = None) -> DataFrame:
    """All candidates of each key and field (1 region, 2 hometown) with the sum of eight terms.

    seats: school, LAT0, LON0; hints: src_raw, hint_ids; prior: school, bin, log_density."""
    s = s or Settings()
    w = s.weights
    fields = keys.select("key_id", "school", "region", "hometown", F.explode(F.array(F.struct(F.lit(1).alias("field"), F.col("region").alias("src_raw")), F.struct(F.lit(2).alias("field"), F.col("hometown").alias("src_raw")))).alias("x")).select("key_id", "school", "region", "hometown", "x.*").where("src_raw is not null")
    rows = fields.join(cand, "src_raw").join(F.broadcast(seats), "school", "left").join(hints, "src_raw", "left")
    rows = rows.withColumn("dist", geo.haversine(F.col("LAT0"), F.col("LON0"), F.col("LAT"), F.col("LON")))
    rows = geo.interpolated(rows, prior, "school", "dist", upper)
    rows = rows.join(coherence_table(cand, keys, s), ["region", "hometown", "field", "SUBJECT_ID"], "left")
    other = F.col("region").isNotNull() & F.col("hometown").isNotNull()
    rows = cut(rows)
    mean = rows.agg(F.avg("dist_ll")).first()[0] or 0.0  # over all rows, for schools without a prior
    filled = F.coalesce("dist_ll", F.lit(mean))
    hit = F.coalesce(F.arrays_overlap("ancestors", "hint_ids"), F.lit(False))
    total = (
        w["string"] * F.ln("string_score") + w["term"] * F.ln(F.coalesce("term_quality", F.lit(1.0))) + w["prominence"] * F.col("prominence")
        + w["sub"] * F.col("is_sub_settlement").cast("int") + w["distance"] * filled + w["coherence"] * geo.coherence(F.col("cross_km"), other)
        + w["nested"] * F.coalesce(F.col("nested"), F.lit(False)).cast("int") + w["hint"] * hit.cast("int") + w["nowhere"] * F.col("LAT").isNull().cast("int")
    )
    return rows.withColumn("score", total)


def decide(scored: DataFrame) -> DataFrame:
    """The best candidate of each key and field with its lead."""
    order = [F.desc("score"), F.desc("n_terms"), F.asc("SUBJECT_ID")]
    by = ["key_id", "field"]
    return best_per_key(scored.withColumn("score_margin", margin("score", by, order)), by, order)


def choose_field(best: DataFrame, s: Settings | None = None) -> DataFrame:
    """One row for each key: the hometown, unless the region is a rank finer or the hometown is the seat's own place."""
    s = s or Settings()
    rank = text.mapped(F.col("geo_precision"), {k: str(v) for k, v in PRECISION.items()}).cast("int")
    ranked = best.withColumns({"_rank": F.coalesce(rank, F.lit(PRECISION["unknown"])), "_seat": geo.equirectangular(F.col("LAT"), F.col("LON"), F.col("LAT0"), F.col("LON0")) <= s.at_seat_km})
    w = Window.partitionBy("key_id")
    of = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c))).over(w)
    wide = ranked.withColumns({"_r": of(1, "_rank"), "_h": of(2, "_rank"), "_at": F.coalesce(of(2, "_seat"), F.lit(False))})
    home = F.col("_h").isNotNull() & (F.col("_r").isNull() | ((F.col("_h") - F.col("_r") < 1) & ~F.col("_at")))
    return wide.where(F.col("field") == F.when(home, 2).otherwise(1)).drop("_rank", "_seat", "_r", "_h", "_at")


def override(chosen: DataFrame, keys: DataFrame, overrides: DataFrame | None, index: DataFrame, seats: DataFrame) -> DataFrame:
    """Curated ids with their own place's columns instead of what was found; an id of null clears it. The region's row goes first."""
    if overrides is None:
        return chosen.withColumn("overridden", F.lit(False))
    forced = best_per_key(overrides.select(F.lower(text.strip(F.col("raw"))).alias("_k"), F.col("subject_id").alias("_id")), ["_k"], [F.asc_nulls_last("_id")])
    field = lambda c, n: keys.select("key_id", "school", F.lower(text.strip(F.col(c))).alias("_k"), F.lit(n).alias("field")).join(sized(forced), "_k")
    hits = best_per_key(field("region", 1).union(field("hometown", 2)), ["key_id"], ["field"])
    places = best_per_key(index.select(F.col("SUBJECT_ID").alias("_id"), "TERM", "TERM_ID", "geo_precision", "LAT", "LON", "is_settlement"), ["_id"], ["TERM_ID", "TERM"])
    rows = hits.join(places, "_id", "left").join(F.broadcast(seats), "school", "left")
    own = {
        "key_id": F.col("key_id"), "field": F.when(F.col("_id").isNotNull(), F.col("field")), "SUBJECT_ID": F.col("_id"), "TERM": F.col("TERM"), "TERM_ID": F.col("TERM_ID"), "LAT": F.col("LAT"), "LON": F.col("LON"),
        "dist": geo.haversine(F.col("LAT0"), F.col("LON0"), F.col("LAT"), F.col("LON")), "match_method": F.lit("override"), "geo_precision": F.coalesce("geo_precision", F.lit("unknown")),
        "is_settlement": F.col("is_settlement"), "string_score": F.lit(1.0), "n_candidates": F.lit(1).cast("long"), "cap_hit": F.lit(False), "score_margin": F.lit(10.0),
    }
    rows = cut(rows.select(*[c.alias(n) for n, c in own.items()]))
    rest = chosen.join(rows.select("key_id"), "key_id", "left_anti").withColumn("overridden", F.lit(False))
    return rest.unionByName(rows.withColumn("overridden", F.lit(True)), allowMissingColumns=True)


def assemble(students: DataFrame, keys: DataFrame, chosen: DataFrame, s: Settings | None = None) -> DataFrame:
    """students with the columns of their key's place."""
    s = s or Settings()
    place = chosen.select(
        "key_id", F.col("SUBJECT_ID").alias("location_id"), F.col("TERM").alias("location_name"), F.col("LAT").alias("lat"), F.col("LON").alias("lon"), "dist",
        F.col("field").alias("matched"), "match_method", "geo_precision", "is_settlement", "string_score", "n_candidates", "cap_hit", "score_margin",
        (F.col("score_margin") < s.low_margin).alias("low_confidence"),
    )
    return null_safe(students, keys, ["region", "hometown", "school"]).join(place, "key_id", "left").drop("key_id")


def review_queue(students: DataFrame, keys: DataFrame, best: DataFrame, n: int = 400) -> DataFrame:
    """The n strings (a top-k report) whose review is worth most: frequency times uncertainty."""
    keyed = null_safe(students, keys, ["region", "hometown", "school"])
    each = keyed.select("key_id", F.explode(F.array(F.struct(F.lit(1).alias("field"), F.col("region").alias("src_raw")), F.struct(F.lit(2).alias("field"), F.col("hometown").alias("src_raw")))).alias("x")).select("key_id", "x.*").where("src_raw is not null")
    told = each.join(best.select("key_id", "field", "SUBJECT_ID", "score_margin", "match_method"), ["key_id", "field"], "left")
    stats = told.groupBy("src_raw").agg(F.count(F.lit(1)).alias("freq"), F.avg(F.col("SUBJECT_ID").isNull().cast("int")).alias("unresolved_rate"), F.avg("score_margin").alias("mean_margin"), F.min("match_method").alias("match_method"))
    doubt = F.col("unresolved_rate") + (1 - F.col("unresolved_rate")) / (1 + F.coalesce("mean_margin", F.lit(0.0)))
    return stats.withColumn("uncertainty", doubt).where("uncertainty > 0.01").withColumn("priority", F.col("freq") * F.col("uncertainty")).orderBy(F.desc("priority"), F.asc("src_raw")).limit(n)


def difference(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """change, count: new, lost, moved and same places against an earlier run."""
    both = now.select(key, F.col("location_id").alias("a")).join(before.select(key, F.col("location_id").alias("b")), key)
    kind = F.when(F.col("a").eqNullSafe(F.col("b")), "same").when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "lost").otherwise("moved")
    return both.groupBy(kind.alias("change")).count()


def geocode(students: DataFrame, index: DataFrame, seats: DataFrame, corrections: DataFrame | None = None, overrides: DataFrame | None = None, s: Settings | None = None) -> DataFrame:
    """students (region, hometown, school) with their places; the whole chain."""
    s = s or Settings()
    spark = index.sparkSession
    index = cut(index)
    release(spark)
    strings = cut(corrected(inventory(students), corrections))
    cand = cut(candidates(strings, index, seats, s))
    release(spark)
    keys = cut(resolution_keys(students))
    told = text.ladder(strings.where("not not_a_place").select("src"), "src").where("hint is not null").select("src", F.col("hint").alias("_hint"))
    hints = cut(coarse_ids(strings.join(told, "src"), index, "_hint", "hint_ids"))
    upper = [*EDGES, math.inf]
    prior = cut(fitted_prior(students, cand, seats, upper))
    release(spark)
    best = cut(decide(cut(score(keys, cand, seats, hints, prior, upper, s))))
    chosen = override(choose_field(best, s), keys, overrides, index, seats)
    return assemble(students, keys, chosen, s)


def fitted_prior(students: DataFrame, cand: DataFrame, seats: DataFrame, upper: list[float]) -> DataFrame:
    """The distance prior of each school from the strings that have one candidate only, in both fields, once for each student."""
    sure = cand.where("n_candidates = 1").select("src_raw", "LAT", "LON")
    rows = students.select("school", F.explode(F.array("region", "hometown")).alias("src_raw")).groupBy("school", "src_raw").agg(F.count(F.lit(1)).alias("_w"))
    far = rows.join(sure, "src_raw").join(F.broadcast(seats), "school").withColumn("km", geo.haversine(F.col("LAT0"), F.col("LON0"), F.col("LAT"), F.col("LON")))
    return geo.distance_prior(far.where("km is not null"), "school", "km", "_w", upper)
