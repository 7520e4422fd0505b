"""A gazetteer index: terms with keys, places with precision, prominence and ancestors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import cut, release
from ..functions import geo, text
from .joins import closure, sized
from .ordered import best_per_key

# ---- fixed values: flags of terms that are codes, not names
CODES = ("ISO3L", "ISO2L", "ISO3N", "ISO2N", "USPS", "FIPS")
# ---- fixed values: quality of a term
QUALITY = {"preferred": 1.00, "vernacular": 0.95, "variant": 0.85, "historic_variant": 0.80}
# ---- fixed values: precision of a place, finest first
PRECISION = {"settlement": 0, "district": 1, "territory": 2, "country": 3, "unknown": 4}
# ---- fixed values: weights of log1p counts
PROMINENCE = {"n_terms": 1.0, "n_languages": 1.5, "n_children": 1.0, "n_placetypes": 0.75, "bbox_area": 0.5, "n_sources": 0.75}
NOTE = 0.5
# ---- fixed values: words of place types, in the order in which they are tried, and their precision
PLACE_TYPES = [
    ("inhabited place", "settlement"), ("city", "settlement"), ("town", "settlement"), ("village", "settlement"), ("hamlet", "settlement"),
    ("municipality", "settlement"), ("borough", "settlement"), ("settlement", "settlement"), ("deserted settlement", "settlement"),
    ("abandoned settlement", "settlement"), ("ruined settlement", "settlement"), ("market town", "settlement"), ("royal burgh", "settlement"),
    ("national capital", "settlement"), ("state capital", "settlement"), ("provincial capital", "settlement"), ("capital", "settlement"),
    ("university town", "settlement"), ("spa", "settlement"), ("resort", "settlement"), ("port", "settlement"), ("suburb", "settlement"),
    ("neighborhood", "settlement"), ("quarter", "settlement"), ("commune", "settlement"), ("township", "settlement"), ("parish", "settlement"),
    ("second level subdivision", "district"), ("third level subdivision", "district"), ("fourth level subdivision", "district"),
    ("arrondissement", "district"), ("prefecture", "district"), ("kreis", "district"), ("district", "district"), ("county", "district"),
    ("departement", "district"), ("department", "district"), ("circle", "district"),
    ("first level subdivision", "territory"), ("grand duchy", "territory"), ("duchy", "territory"), ("principality", "territory"),
    ("electorate", "territory"), ("landgraviate", "territory"), ("margraviate", "territory"), ("archbishopric", "territory"),
    ("bishopric", "territory"), ("kingdom", "territory"), ("empire", "territory"), ("province", "territory"), ("governorate", "territory"),
    ("oblast", "territory"), ("canton", "territory"), ("state", "territory"), ("region", "territory"), ("territory", "territory"),
    ("former administrative", "territory"), ("sovereign state", "country"), ("nation", "country"), ("country", "country"),
]


def quality(preferred, vernacular, historic):
    """of a term from its (padded) flags."""
    p, v, h = F.trim(preferred), F.trim(vernacular), F.trim(historic)
    return F.when(p == "P", QUALITY["preferred"]).when(v == "V", QUALITY["vernacular"]).when(h == "H", QUALITY["historic_variant"]).otherwise(QUALITY["variant"])


def precise(placetypes: DataFrame, table=PLACE_TYPES) -> DataFrame:
    """SUBJECT_ID, settles and role of each role; the smallest role is the preferred one, or else the finest."""
    kind = text.contains_case(F.lower(F.trim("PLACETYPE")), table)
    pt = placetypes.withColumns({"_k": kind, "_pref": F.coalesce(F.trim("PREFERRED") == "P", F.lit(False)).cast("int")})
    rank = text.mapped(F.col("_k"), {k: str(v) for k, v in PRECISION.items()}).cast("int")
    role = F.struct((-F.col("_pref")).alias("pref"), rank.alias("rank"), F.col("PTYPE_ROLE_ID").alias("id"), F.col("_k").alias("kind"), F.col("PLACETYPE").alias("name"))
    return pt.select("SUBJECT_ID", F.coalesce(F.col("_k") == "settlement", F.lit(False)).alias("settles"), F.when(F.col("_k").isNotNull(), role).alias("role"))


def build_index(tables: dict[str, DataFrame], remap: DataFrame | None = None) -> DataFrame:
    """One row for each term of each place. tables: terms, subjects; and as far as there are: placetypes, rels, coords,
    languages, sources, notes, merges. Tables that are missing switch their features off."""
    flag = F.coalesce(F.trim("OTHER_FLAGS"), F.lit(""))
    terms = tables["terms"].where(~flag.isin(*CODES))
    if remap is not None:
        moved = sized(remap.select(F.col("from_subject_id").alias("SUBJECT_ID"), "to_subject_id"))
        terms = terms.join(moved, "SUBJECT_ID", "left").withColumn("SUBJECT_ID", F.coalesce("to_subject_id", "SUBJECT_ID")).drop("to_subject_id")
    terms = terms.withColumn("term_quality", quality(F.col("PREFERRED"), F.col("VERNACULAR"), F.col("HISTORIC_FLAG")))
    terms = cut(best_per_key(terms, ["SUBJECT_ID", "TERM"], [F.desc("term_quality"), F.asc("TERM_ID")]))
    subjects = tables["subjects"].where(F.trim("RECORD_TYPE").isin("A", "B"))
    if "merges" in tables:
        gone = tables["merges"].select("SUBJECT_ID").distinct()
        subjects = subjects.join(gone, "SUBJECT_ID", "left_anti")
    else:
        subjects = subjects.where(F.coalesce(F.trim("MERGED_STAT"), F.lit("")) != "M")
    # what is told of a place, from all tables in one union, so that it is dealt and sorted once
    told, features = [subjects.select("SUBJECT_ID", F.lit(True).alias("_there")), terms.select("SUBJECT_ID", F.lit(1).alias("_term"))], [F.bool_or("_there").alias("_there"), F.sum("_term").alias("n_terms")]

    def tell(name: str, rows, kinds: str, *columns) -> None:
        """columns, over the rows that rows(table) makes, or nulls of these kinds."""
        if name in tables:
            told.append(rows(tables[name]))
            features.extend(columns)
        else:
            features.extend(F.max(F.lit(None).cast(kind)).alias(c) for c, kind in (x.split() for x in kinds.split(", ")))

    box = [F.col(c) for c in ("LAT_MIN_BOX", "LAT_MAX_BOX", "LON_MIN_BOX", "LON_MAX_BOX")]
    one_of = lambda c, *names: [F.first(c, ignorenulls=True)[n].alias(n) for n in names]
    tell("placetypes", precise, "is_settlement boolean, n_placetypes long, geo_precision string, placetype string",
         F.bool_or("settles").alias("is_settlement"), F.count("settles").alias("n_placetypes"), F.min("role")["kind"].alias("geo_precision"), F.min("role")["name"].alias("placetype"))
    tell("coords", lambda t: t.select("SUBJECT_ID", F.struct("LAT", "LON", geo.box_area(*box).alias("bbox_area")).alias("_at")), "LAT double, LON double, bbox_area double", *one_of("_at", "LAT", "LON", "bbox_area"))
    tell("languages", lambda t: t.select("SUBJECT_ID", "LANGUAGE_CODE").distinct().select("SUBJECT_ID", F.col("LANGUAGE_CODE").isNotNull().cast("int").alias("_language")), "n_languages long", F.sum("_language").alias("n_languages"))
    for name, c in (("sources", "n_sources"), ("notes", "n_notes")):
        tell(name, lambda t, c=c: t.select("SUBJECT_ID", F.col(c).alias(f"_{c}")), f"{c} long", F.sum(f"_{c}").alias(c))
    if "rels" in tables:
        tree = tables["rels"].where(F.trim("PREFERRED") == "P").select(F.col("CHILD_ID").alias("SUBJECT_ID"), F.col("PARENT_ID").alias("parent_id")).where("SUBJECT_ID != parent_id")
        one = cut(tree.groupBy("SUBJECT_ID").agg(F.min("parent_id").alias("parent_id")))
        told += [one, closure(one, "SUBJECT_ID", "parent_id").select("SUBJECT_ID", F.struct("ancestors", "depth").alias("_up")), one.where("parent_id is not null").select(F.col("parent_id").alias("SUBJECT_ID"), F.lit(1).alias("_child"))]
        features += [F.min("parent_id").alias("parent_id"), *one_of("_up", "ancestors", "depth"), F.sum("_child").alias("n_children")]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), told).repartition("SUBJECT_ID")
    places = together.groupBy("SUBJECT_ID").agg(*features).where("_there").drop("_there")
    if "rels" in tables:
        places = cut(places)
        release(places.sparkSession)
        up = places.where("n_children > 0").select(F.col("SUBJECT_ID").alias("parent_id"), F.col("is_settlement").alias("parent_is_settlement"))
        places = places.join(sized(up), "parent_id", "left")
    else:
        places = places.withColumns({"parent_id": F.lit(None).cast("long"), "ancestors": F.lit(None).cast("array<bigint>"), "depth": F.lit(None).cast("int"), "n_children": F.lit(None).cast("long"), "parent_is_settlement": F.lit(None).cast("boolean")})
    places = places.withColumns({
        "geo_precision": F.coalesce("geo_precision", F.lit("unknown")), "is_settlement": F.coalesce("is_settlement", F.lit(False)),
        "is_sub_settlement": F.coalesce(F.col("is_settlement") & F.col("parent_is_settlement"), F.lit(False)),
        "prominence": geo.prominence(PROMINENCE) + NOTE * F.coalesce((F.col("n_notes") > 0).cast("double"), F.lit(0.0)),
    })
    keys = text.ladder(terms, "TERM")
    return terms.select("TERM", "TERM_ID", "SUBJECT_ID", "term_quality").join(places, "SUBJECT_ID").join(sized(keys), "TERM", "left")
