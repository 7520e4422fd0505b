"""Register cleaners: one table-driven specification for each source over shared operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from .aggregates import union_relaxed
from .joins import sized
from .ordered import ditto_fill, fill_across, forward_fill, real_nulls, record_id, stand_ins, without_marks

GROUPS = ("law_admin", "theology", "medicine", "sciences", "humanities")
ORDER = ["file_rank", "line_no"]
#: A school's rows are one sequence: file after file, and by line within each.
SEQUENCE = ("file_rank", ["line_no"])


@dataclass
class Spec:
    """fill: column -> (marks, most rows or None, by file); year: the rule's name; groups: five lists or patterns;
    squash: non-word characters of the field go before it is grouped; expanded: field_expanded goes before field."""

    needles: tuple[str, ...]
    groups: tuple
    year: str = "volume"
    fill: dict = field(default_factory=dict)
    place: str = "both"
    expanded: bool = False
    squash: bool = False
    lower: bool = False
    mapping: dict = field(default_factory=dict)
    strict_map: bool = False
    sort: tuple[str, ...] = ()


DITTO_12 = {c: (text.DITTO, 12, False) for c in ("field", "hometown", "region", "street")}
# ---- fixed values: what each register's field names stand for
SPECS = {
    "berlin": Spec(("berlin",), (["Kam", "Recht", "Rechte"], ["Theol"], ["Med"], ["Mineral", "Math", "Naturw"], ["Phil"]), fill=DITTO_12, squash=True),
    "bonn": Spec(("bonn",), ("(Jura|Kam|Staatsw)", "(Theol)", "(Med|Chir|Pharm)", "(Math|Physik|Berge|Naturw|Forstw)", "(Phil|Philol|Geschichte|Lit)"), fill=DITTO_12),
    "erlangen": Spec(("erlangen",), ("(Jura|Kam|Staatsw|Kriegsw|Rechte)", "(Theol)", "(Med|Chir|Pharm)", "(Math|Physik|Berge|Naturw|Forstw|Eng|Chem)", "(Phil|Philol|Geschichte|Lit|Aesth)"), year="year", fill={"field": (("desgl.", "="), 10, False)}),
    "freiburg": Spec(("freiburg",), (["jur"], ["theol"], ["med", "pharm", "chir"], ["math"], ["phil"]), year="matrikel_year", place="given"),
    "giessen": Spec(("giessen",), ("(Rechtswissenschaft|Kameralwissenschaft)", "Theologie", "(Medizin|Chirurgie|Pharmazie|Tierheilkunde)", "(Forstwissenschaft|Chemie|Mathematik|Architektur)", "(Philosophie|Philologie)"), year="enrolment_date", place="hometown"),
    "goettingen": Spec(("goettingen_1734", "goettingen_1837"), ("(jura|jur|kam|cam|staatsw)", "(theol)", "(med|chir|pharm)", "(math|physik|berge|naturw|forstw)", "(phil|philol|geschichte|lit|hist)"), year="anchored", expanded=True, squash=True, lower=True),
    "heidelberg": Spec(("heidelberg",), (["Cameralia", "Jura Cameralia", "Jura", "Criminalia", "Jura, Cameralia", "Notariat", "Jura und Cameralia", "juris candidatus", "Staatswissenschaften"], ["Theologie", "Theologie Philosophie", "Philosophie Theologie"], ["Medizin", "Cr.", "Chirurgie", "Pharmacie", "Pharmazie", "Medizin Chirurgie"], ["Forstwissenschaft", "Mathematik", "Naturwissenschaften"], ["Philosophie", "Pl.", "Philologie", "Geschichte"]), year="page", place="hometown", expanded=True),
    "jena": Spec(("jena", "jona"), (["J.", "Cam.", "J.u.C.", "J. u. C."], ["T.", "Th.", "T. u. P.", "T.u.P."], ["M.", "Pm.", "Ph.", "Chir."], ["Math."], ["P.", "Oec.", "Phil.", "Phll."]), place="jena", sort=("volume_id",)),
    "kiel": Spec(("kiel",), (["Jura", "Cameralwissenschaft", "Jura und Cameralwissenschaft"], ["Theologie", "Theologie und Philologie", "Theologie und Philosophie", "Philosophie und Theologie", "Philologie und Theologie"], ["Medizin", "Pharmazie", "Medizin und Chirurgie", "Pharmacie"], ["Mathematik", "Chemie"], ["Philosophie", "Philologie"]), year="date_year", place="hometown", expanded=True),
    "marburg": Spec(("marburg",), (["Rechtswissenschaft (Jura)", "Rechtswissenschaft", "Oeconomia politica (Staatswirtschaft)", "Kameralwissenschaft", "Staatswirtschaft", "Rechtswissenschaft und Staatswirtschaft"], ["Theologie", "Theologie und Philologie", "Theologie & Philologie"], ["Medizin", "Chirurgie", "Pharmazie", "Veterinärmedizin", "Tierheilkunde", "Medizin und Chirurgie"], ["Forstwissenschaft", "Res saltuaria (Forstwissenschaft)", "Mathematik", "Bergbauwissenschaft", "Chemie", "Architektur"], ["Philosophie", "Philologie"]), year="date_iso_filled", expanded=True),
    "muenchen": Spec(("muenchen",), (["Jura", "Cameralwissenschaft", "Jura Cameralwissenschaft", "Jura, Cameralwissenschaft"], ["Theologie", "Theologie Philosophie"], ["Medizin", "Chirurgie", "Pharmazie", "Veterinärmedizin", "Tierheilkunde", "Medizin und Chirurgie"], ["Forstwissenschaft", "Res saltuaria (Forstwissenschaft)", "Mathematik", "Bergbauwissenschaft", "Chemie", "Logik", "Architektur", "Log.", "Archit.", "Phys.", "Physik", "Bergw.", "Bauw.", "Bauwesen"], ["Philosophie", "Philologie", "Philol."]), year="academic", expanded=True),
    "tuebingen": Spec(("tuebingen",), ("(Rechts|Cameral|Staats)", "(Theol|theol|Théol)", "(Med|Medicin|Chirur|Pharm)", "Forstwissenschaft", "(Phil)"), year="years", fill={"field": ((), None, True)}, place="hometown_full", squash=True, sort=("first_year", "last_name", "first_names")),
    "wuerzburg": Spec(("wuerzburg",), (["Jura", "Kameralwissenschaft", "Cameralia", "Oeconomie", "Staatswirtschaft", "Jura und Kameralwissenschaft", "Kameralistik"], ["Theologie"], ["Medizin", "Chirurgie", "Pharmazie", "Veterinärmedizin", "Tierheilkunde", "Medizin und Chirurgie"], ["Forstwissenschaft", "Res saltuaria (Forstwissenschaft)", "Mathematik", "Bergbauwissenschaft", "Logik", "Architektur", "Log.", "Archit.", "Phys.", "Physik", "Bergw.", "Bauw.", "Bauwesen", "Technologie"], ["Philosophie", "Philologie", "Philol."]), year="date_iso", place="hometown", expanded=True),
}
#: Volumes whose page years were confirmed against the print.
STRICT_VOLUMES = ("heidelberg_1846",)


def field_flags(c: Column, spec: Spec) -> dict[str, Column]:
    """Five booleans from a register's field name."""
    if spec.lower:
        c = F.lower(c)
    if spec.squash:
        c = F.regexp_replace(c, r"[^\p{L}\p{N}_]", "")
    if spec.mapping:
        c = text.mapped(c, spec.mapping) if spec.strict_map else text.lenient(c, spec.mapping)
    return {g: c.rlike(v) if isinstance(v, str) else c.isin(*v) for g, v in zip(GROUPS, spec.groups, strict=True)}


def page_corrected(df: DataFrame, page_years: DataFrame) -> DataFrame:
    """first_year against the page's year (filled within the volume).

    Strict volumes: no entry is older than its page or more than two years younger. Others: an entry with the volume's
    opening year on a later page, or more than two years off, takes the page's."""
    joined = df.join(sized(page_years), ["volume_id", "source_page"], "left")
    order = ["source_page", *ORDER]
    page = forward_fill(F.col("year_helper"), ["volume_id"], order)
    joined = joined.withColumn("_p", page)
    y, p, opening = F.col("first_year"), F.col("_p"), dates.year_in(F.col("volume_id"))
    strict = F.when(p.isNull(), y).when(y.isNull() | (y < p) | (y > p + 2), p).otherwise(y)
    loose = F.when((y == opening) & (p > y), p).when(F.abs(y - F.coalesce(p, y)) > 2, p).otherwise(y)
    return joined.withColumn("first_year", F.when(F.col("volume_id").isin(*STRICT_VOLUMES), strict).otherwise(loose)).drop("_p", "year_helper")


def page_years(heads: DataFrame) -> DataFrame:
    """volume_id, source_page, year_helper: the pages on which a year starts. heads: volume, page, head."""
    from .ordered import repair_misread, steps_of_one

    years = heads.withColumn("year_helper", dates.year_in(F.col("head"))).where("year_helper is not null")
    fixed = repair_misread(years, "year_helper", ["volume"], ["page"])
    return steps_of_one(fixed, "year_helper", ["volume"], ["page"]).select(F.col("volume").alias("volume_id"), F.col("page").alias("source_page"), "year_helper")


def with_year(df: DataFrame, rule: str, anchors: DataFrame | None, helper: DataFrame | None) -> DataFrame:
    across = lambda df, c: fill_across(df, "first_year", c, *SEQUENCE)
    if rule == "volume":
        return df.withColumn("first_year", dates.volume_year(F.col("volume_id")))
    if rule in ("year", "matrikel_year", "date_year"):
        return df.withColumn("first_year", dates.number(F.col(rule)))
    if rule == "enrolment_date":
        return df.withColumn("first_year", dates.lenient_year(F.col(rule)).cast("bigint"))
    if rule in ("date_iso", "date_iso_filled", "page"):
        out = df.withColumn("first_year", dates.year_in(F.col("date_iso")))
        if rule == "page":
            return page_corrected(out.withColumn("source_page", dates.number(F.col("source_page"))), helper) if helper is not None else out
        return across(out, F.col("first_year")) if rule.endswith("filled") else out
    if rule == "years":
        return df.withColumn("first_year", F.coalesce(dates.year_in(F.col("years")), dates.volume_year(F.col("volume_id"))))
    if rule == "anchored":
        out = df.withColumns({"first_year": dates.year_in(F.col("date")), "source_page": dates.number(F.col("source_page"))})
        if anchors is not None:
            out = out.join(sized(anchors), ["last_name", "first_names", "source_page"], "left").withColumn("first_year", F.coalesce("first_year", "year_helper")).drop("year_helper")
        return across(out, F.col("first_year"))
    if rule == "academic":
        known = F.when((F.col("academic_year") == "ibid") | F.coalesce(F.col("extraction_notes").rlike(r"Year\w* inferred"), F.lit(False)), None).otherwise(F.col("academic_year"))
        notes = F.coalesce(F.col("extraction_notes"), F.lit(""))
        out = df.withColumns({
            "first_year": dates.year_in(known), "source_page": dates.number(F.col("source_page")),
            "first_names": F.when(notes.contains("'v.'") | notes.contains("'von'"), F.concat("first_names", F.lit("von"))).otherwise(F.col("first_names")),
        }).where((F.col("first_year") >= 1799) & (F.col("source_page") != 261))
        if helper is None:
            return out
        out = out.join(sized(helper), ["source_page"], "left")
        bad = F.col("year_helper").isNull() | (F.abs(F.col("first_year") - F.col("year_helper")) > 2) | (F.col("source_page") == 262)
        kept = F.coalesce(F.when(~bad, F.col("first_year")), F.col("year_helper"))
        return across(out, kept).drop("year_helper")
    raise ValueError(rule)


COLUMNS = ("last_name", "first_names", "first_year", "field", "hometown", "region", "location_full", "address", "religion", "father", "father_occupation", "father_location", "prev_university", "source_page")


def clean(raw: DataFrame, school: str, anchors: DataFrame | None = None, helper: DataFrame | None = None, spec: Spec | None = None) -> DataFrame:
    """One school's rows (as text, with file_rank and line_no) in the common columns.

    Fills run in register order; that order is one sequence over a school's volumes, as ditto marks cross them. Each volume is
    filled apart, and what it begins with comes from the volumes before."""
    spec = spec or SPECS[school]
    there = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    df = raw
    for c, (marks, most, by_file) in spec.fill.items():
        if c in df.columns:
            keep_nulls = bool(marks) and "" not in marks
            if by_file:
                df = df.withColumn(c, ditto_fill(F.col(c), marks, ["file_rank"], ORDER, most, keep_nulls) if marks else forward_fill(F.col(c), ["file_rank"], ORDER, most))
            else:
                value = stand_ins(F.col(c)) if keep_nulls else F.col(c)
                df = fill_across(df, c, without_marks(value, marks) if marks else value, *SEQUENCE, most)
                df = df.withColumn(c, real_nulls(F.col(c))) if keep_nulls else df
    df = df.withColumn("first_names", F.coalesce(there("first_names"), there("first_name")))
    df = with_year(df, spec.year, anchors, helper)
    df = df.withColumn("field", F.coalesce(there("field_expanded"), there("field")) if spec.expanded else (there("field_of_study") if school == "giessen" else there("field")))
    both = text.place(there("hometown"), there("region"))
    if spec.place == "jena":
        df = df.withColumns({c: F.regexp_replace(there(c), r"\.$", "") for c in ("hometown", "region")})
        df = fill_across(df, "_place", F.nullif(text.strip(text.place(F.col("hometown"), F.col("region"))), F.lit("Daher")), "volume_id", ORDER, 10)
        both = F.col("_place")
    df = df.withColumn("location_full", {"both": both, "jena": both, "given": there("location_full")}.get(spec.place, there(spec.place)))
    df = df.withColumn("address", there("lodging") if school == "jena" else F.concat(there("street"), F.lit(" "), there("house_number")))
    if school == "giessen":
        df = df.withColumn("father_occupation", there("father_profession"))
    out = df.withColumns(field_flags(F.col("field"), spec)).select(*[there(c).alias(c) for c in COLUMNS], *GROUPS, *ORDER)
    return out.withColumn("school", F.lit(school))


def stack(frames: list[DataFrame]) -> DataFrame:
    """All schools, without rows that lack a name or year; record_id in school and register order."""
    rows = union_relaxed(frames).where("last_name is not null and first_year is not null")
    return record_id(rows, ["school", *ORDER], "record_id")


def finalize(df: DataFrame, occupations: dict[str, str] | None = None, classes: dict[str, str] | None = None, state_places: list[int] = ()) -> DataFrame:
    """Derived columns: nobility, era, one field, kinds of university, father's class; years 1800 to 1848."""
    kind, noble = text.nobility(F.col("first_names"), F.col("last_name"))
    one = F.when(F.col("law_admin"), "law/admin").when(F.col("theology"), "theology").when(F.col("medicine"), "medicine").when(F.col("humanities"), "humanities").when(F.col("sciences"), "sciences")
    out = df.where(F.col("first_year").between(1800, 1848)).withColumns({
        "nobility_class": kind, "noble": noble, "era": dates.era(F.col("first_year")), "field_raw": F.col("field"), "field": one,
        "new_school": F.col("school").isin("bonn", "berlin"), "catholic_uni": F.col("school").isin("muenchen", "freiburg", "wuerzburg"),
        "protestant_uni": F.col("school").isin("marburg", "jena", "tuebingen", "heidelberg", "erlangen", "goettingen", "kiel", "giessen"),
    })
    if "location_id" in df.columns:
        out = out.withColumn("only_state", F.col("location_id").isin(*state_places) if state_places else F.lit(False))
    if occupations is not None:
        out = out.withColumn("father_occupation", text.mapped(text.mapped(text.first_part(F.col("father_occupation")), occupations), classes or {"": ""}))
    return out


def religion_class(c: Column) -> Column:
    """by the code's first letter."""
    first = F.lower(F.substring(F.trim(c), 1, 1))
    return F.when(first == "k", "catholic").when(first == "j", "jewish").when(first.isin(*"elprgvch"), "protestant")


def canonical(df: DataFrame, column: str, table: dict[str, str], rules: list[tuple[str, str]]) -> DataFrame:
    """column by a dictionary, else by the first rule (pattern, label) that matches, else as it is.

    Rules run once for each distinct value that the dictionary lacks."""
    values = df.select(column).distinct()
    hit = text.mapped(F.lower(text.strip(F.col(column))), table) if table else F.lit(None).cast("string")
    by_rule = F.lit(None).cast("string")
    for pattern, label in reversed(rules):
        by_rule = F.when(F.lower(F.col(column)).rlike(pattern), label).otherwise(by_rule)
    made = values.withColumn("_c", F.coalesce(hit, by_rule, F.col(column)))
    return df.join(made.withColumnRenamed(column, "_v"), F.col(column).eqNullSafe(F.col("_v")), "left").withColumn(column, F.col("_c")).drop("_v", "_c")


