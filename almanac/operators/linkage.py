"""Record linkage: spells, blocks, comparison levels, Fellegi-Sunter weights, constrained clusters."""

from __future__ import annotations

import math
import random
from collections import defaultdict
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import cut, ship
from ..functions import text
from .aggregates import key_share, mode_smallest
from .joins import multi_rule_pairs, sized, spread

LEVELS = {"sn": 4, "gn": 7, "geo": 4, "yr": 5, "pt": 3}
RETAIN, SPAN, SCHOOLS, OVERLAP = -2.0, 9, 3, 1
#: Kinds of spells (name columns and shares) up to which pairs of kinds are compared instead of pairs of spells.
KINDS = 500


def prepare(df: DataFrame) -> DataFrame:
    """Name columns of records with record_id, school, last_name, first_names, first_year, location_id."""
    # surnames once for each distinct one, and written, so that later columns don't repeat the work
    last = df.select("last_name").where("last_name is not null").distinct().withColumn("_n", text.surname(F.col("last_name")))
    last = cut(last.select("last_name", F.col("_n.name").alias("ln_norm"), F.col("_n.particle").alias("ln_particle")))
    last = cut(last.withColumn("ln_phon", text.phonetic_name(F.col("ln_norm"))))
    out = df.join(last, "last_name", "left").withColumns({
        "gn_tokens": text.given_names(F.col("first_names")),
        "gn_init": text.initials(F.col("first_names")), "gn_is_abbrev": text.has_abbreviation(F.col("first_names")),
    })
    return cut(out).withColumns({
        "gn_set": F.array_sort("gn_tokens"), "gn_init_set": text.sorted_letters(F.col("gn_init")),
        "gn_i1": F.substring("gn_init", 1, 1), "gn_has_full": F.coalesce(F.size("gn_tokens"), F.lit(0)) > 0,
    })


def annual_schools(df: DataFrame, least: float = 1.25) -> DataFrame:
    """Schools whose registers name a person each year: rows for each name key over ``least``."""
    per = df.groupBy("school", "ln_norm", "gn_init", "location_id").count()
    return per.groupBy("school").agg(F.avg("count").alias("rows_per_key")).where(F.col("rows_per_key") > least)


def chain(rows: list[tuple]) -> list[int]:
    """The chain of each row (year, initials, tokens) of one key, in order: the first open one that fits."""
    chains: list[list] = []
    out = []
    for year, initials, tokens in rows:
        initials, tokens = initials or "", set(tokens if tokens is not None else ())
        for i, c in enumerate(chains):
            if c[0] < year <= c[0] + 2 and (c[1].startswith(initials) or initials.startswith(c[1])) and (not c[2] or not tokens or c[2] & tokens):
                c[0], c[1] = year, max(c[1], initials, key=len)
                c[2] |= tokens
                out.append(i)
                break
        else:
            chains.append([year, initials, tokens])
            out.append(len(chains) - 1)
    return out


def spells(records: DataFrame, annual: list[str]) -> DataFrame:
    """records with spell_key and chain: consecutive years of one person at one annual school.

    Within a key (school, phonetic name, initial, place) rows chain in order, with open chains as state; a key's rows are
    those of one name at one place."""
    ship(records.sparkSession)
    key = F.concat_ws("|", "school", F.coalesce("ln_phon", F.lit("~")), F.coalesce("gn_i1", F.lit("~")), F.coalesce(F.col("location_id").cast("string"), F.lit("~")))
    keyed = records.withColumn("spell_key", key)
    single = keyed.where(~F.col("school").isin(*annual)).withColumn("chain", F.col("record_id").cast("long"))

    many = keyed.where(F.col("school").isin(*annual))

    def run(batches):
        import pyarrow as pa

        # a key's rows may lie in several batches
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        ids, found = [], []
        for _, of in groupby(rows, key=lambda row: row[0]):
            of = list(of)
            ids += [row[1] for row in of]
            found += chain([(math.nan if year is None else year, *rest) for _, _, year, *rest in of])
            if len(ids) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], ["record_id", "chain"])
                ids, found = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], ["record_id", "chain"])

    narrow = many.select("spell_key", "record_id", "first_year", "gn_init", "gn_set").repartition("spell_key").sortWithinPartitions("spell_key", F.asc_nulls_last("first_year"), "record_id")
    narrow = narrow.mapInArrow(run, "record_id long, chain long")
    return many.join(narrow, "record_id").unionByName(single)


def spell_table(chained: DataFrame) -> DataFrame:
    """One row for each spell with its consensus columns; spell_id counts in key order."""
    longest = lambda c: F.min_by(c, F.struct(-F.coalesce(F.length(c), F.lit(0)), F.col(c)))
    by = ["spell_key", "chain"]
    out = chained.groupBy(*by).agg(
        F.first("school").alias("school"), F.min("first_year").alias("first_seen"), F.max("first_year").alias("last_seen"), F.count(F.lit(1)).alias("n_rec"),
        longest("ln_norm").alias("ln_norm"), longest("ln_particle").alias("ln_particle"), longest("gn_init").alias("gn_init"),
        F.min("ln_phon").alias("ln_phon"), F.min("gn_i1").alias("gn_i1"), F.first("location_id").alias("location_id"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("gn_set")))).alias("gn_set"), F.min("record_id").alias("first_record"),
    )
    field = mode_smallest(chained, by, "field") if "field" in chained.columns else None
    if field is not None:
        out = out.join(field.withColumnRenamed("mode", "field"), by, "left")
    numbered = out.withColumns({"gn_init_set": text.sorted_letters(F.col("gn_init")), "gn_has_full": F.size("gn_set") > 0})
    from .ordered import record_id

    return record_id(numbered, ["spell_key", "chain"], "spell_id")


def block(spell: DataFrame, region_share: float = 0.002, enforce_gap: bool = False, most_gap: int = 9) -> DataFrame:
    """Pairs lid < rid of different schools that agree on one of five rules and don't overlap by more than two years.

    With the bound on years, years that fit become part of each rule's equality."""
    big = key_share(spell, "location_id").where(F.col("share") >= region_share).select("location_id")
    ok = spell.join(sized(big.withColumn("_big", F.lit(True))), "location_id", "left").withColumn("ok_place", F.when(F.col("_big").isNull(), F.col("location_id")))
    ok = ok.withColumn("phon3", F.substring("ln_phon", 1, 3))
    l, r = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    apart = F.greatest(r("first_seen") - l("last_seen"), l("first_seen") - r("last_seen"))
    where, near = (l("school") != r("school")) & (apart >= -2), None
    if enforce_gap:
        where = l("school") != r("school")
        ok = ok.withColumn("_years", F.struct("first_seen", "last_seen"))
        years = ok.select("first_seen", "last_seen", "_years").distinct()
        near = ("_years", cut(years.alias("l").join(years.alias("r"), (apart >= -2) & (apart <= most_gap)).select(l("_years").alias("_x"), r("_years").alias("_y"))))
    rules = [["ln_phon", "gn_i1"], ["ln_phon", "location_id"], ["ok_place", "gn_init"], ["ln_norm"], ["phon3", "gn_init", "gn_i1"]]
    ok = ok.select("spell_id", "school", "first_seen", "last_seen", *{c: 0 for x in rules for c in x}, *(["_years"] if near else []))
    return multi_rule_pairs(ok, "spell_id", rules, where, near)


#: Columns that the levels of names, the stratum and the shares are made of.
NAMED = ["ln_norm", "ln_phon", "ln_particle", "gn_set", "gn_init", "gn_init_set", "gn_i1", "gn_has_full", "f_sn", "f_geo"]
SEEN = ["spell_id", "school", "first_seen", "last_seen", "location_id"]


def _own(spell: DataFrame) -> DataFrame:
    """The columns of spells that a comparison takes, with the shares of their surnames' sounds and places."""
    tf = lambda c, n: key_share(spell, c, n)
    rows = spell.select(*SEEN, *NAMED[:-2]).join(sized(tf("ln_phon", "f_sn")), "ln_phon", "left").join(sized(tf("location_id", "f_geo")), "location_id", "left")
    return rows.fillna(1.0, ["f_sn", "f_geo"])


def _similar(both: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """both (l.*, r.*) with _jw where names that differ in sound are alike; computed once for each distinct pair of names.

    named: pairs _ln, _rn that hold those of both, where they are known otherwise."""
    l, r = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    differ = (l("ln_norm") != r("ln_norm")) & ~F.coalesce(l("ln_phon") == r("ln_phon"), F.lit(False))
    if named is None:
        named = both.where(differ).select(l("ln_norm").alias("_ln"), r("ln_norm").alias("_rn")).distinct()
    near = named.where(F.least(F.length("_ln"), F.length("_rn")) >= 0.6 * F.greatest(F.length("_ln"), F.length("_rn"))).where(text.alike(F.col("_ln"), F.col("_rn"), 0.92)).withColumn("_jw", F.lit(True))
    return both.join(near, differ & (l("ln_norm") == F.col("_ln")) & (r("ln_norm") == F.col("_rn")), "left")


def _name_levels() -> dict[str, Column]:
    l, r = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    full = l("gn_has_full") & r("gn_has_full")
    none = lambda c: c.isNull() | (c == "")
    two = F.length(l("gn_init")) >= 2
    return {
        "sn": F.when(l("ln_norm") == r("ln_norm"), 0).when(l("ln_phon") == r("ln_phon"), 1).when(F.col("_jw").isNotNull(), 2).otherwise(3),
        "gn": F.when(full & (l("gn_set") == r("gn_set")), 0)
        .when(full & (F.size(F.array_intersect(l("gn_set"), r("gn_set"))) > 0) & (l("gn_i1") == r("gn_i1")), 1)
        .when((l("gn_init") == r("gn_init")) & two, 2).when((l("gn_init_set") == r("gn_init_set")) & two, 3).when(l("gn_i1") == r("gn_i1"), 4)
        .when(none(l("gn_i1")) | none(r("gn_i1")), 5).otherwise(6),
        "pt": F.when((F.coalesce(l("ln_particle"), F.lit("")) == F.coalesce(r("ln_particle"), F.lit(""))), F.when(none(l("ln_particle")), 1).otherwise(0)).otherwise(2),
        "stratum": F.when(full, "both_full").when(l("gn_has_full") | r("gn_has_full"), "mixed").otherwise("both_abbrev"),
        "tf_sn": l("f_sn") * r("f_sn"), "tf_geo": l("f_geo") * r("f_geo"), "rare": F.greatest(l("f_sn"), r("f_sn")),
    }


def _years(annual: list[str]) -> Column:
    l, r = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    first = l("first_seen") <= r("first_seen")
    e, t = (lambda c: F.when(first, l(c)).otherwise(r(c))), (lambda c: F.when(first, r(c)).otherwise(l(c)))
    gap = F.greatest(F.lit(0), t("first_seen") - e("last_seen") - F.when(e("school").isin(*annual), 0).otherwise(2))
    return F.when(gap <= 1, 0).when(gap == 2, 1).when(gap <= 4, 2).when(gap <= 8, 3).otherwise(4)


def _place_and_years(annual: list[str]) -> dict[str, Column]:
    l, r = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    return {"geo": F.when(l("location_id").isNull() | r("location_id").isNull(), 3).when(l("location_id") == r("location_id"), 0).otherwise(2), "yr": _years(annual)}


COMPARED = ["sn", "gn", "geo", "yr", "pt", "stratum", "tf_sn", "tf_geo", "rare"]


def compare(pairs: DataFrame, spell: DataFrame, annual: list[str]) -> DataFrame:
    """lid, rid, levels sn gn geo yr pt, stratum, tf_sn, tf_geo (products of both sides' shares)."""
    own = _own(spell)
    both = pairs.join(own.alias("l"), F.col("lid") == F.col("l.spell_id")).join(own.alias("r"), F.col("rid") == F.col("r.spell_id"))
    found = {**_name_levels(), **_place_and_years(annual)}
    return _similar(both).select("lid", "rid", *[found[c].alias(c) for c in COMPARED])


class Blocks:
    """Pairs lid < rid of spells that agree on ``by`` (and ``where``, on l.* and r.*), compared without a row for each pair before its levels.

    Spells are of few kinds (name columns and shares), so pairs of kinds are compared, and pairs of spells look theirs up; with more
    than KINDS kinds each pair is compared by itself. Spells are dealt by block, so no pair is shuffled."""

    def __init__(self, spell: DataFrame, by: list[str], annual: list[str], where: Column | None = None):
        self.annual, self.keys = annual, [f"_by{i}" for i in range(len(by))]
        own = cut(_own(spell).join(spell.select("spell_id", *[F.expr(b).alias(k) for b, k in zip(by, self.keys, strict=True)]), "spell_id"))
        kinds = own.select(*NAMED).distinct()
        self.few = kinds.limit(KINDS + 1).count() <= KINDS
        if self.few:
            kinds = cut(kinds.withColumn("kind", F.row_number().over(Window.orderBy(*NAMED))))
            key = F.struct(*NAMED)
            told = F.broadcast(kinds.select(key.alias("_key"), "kind"))
            own = cut(own.withColumn("_key", key).join(told, "_key").select(*SEEN, *self.keys, "kind"))
            pairs = _similar(kinds.alias("l").join(F.broadcast(kinds.alias("r")), F.lit(True)))
            self.kinds = cut(pairs.select(F.col("l.kind").alias("lk"), F.col("r.kind").alias("rk"), *[c.alias(n) for n, c in _name_levels().items()]))
        self.own, self.where = own, F.lit(True) if where is None else where

    def _both(self, left: DataFrame | None = None, lkeys: list[str] = (), rkeys: list[str] = ()) -> DataFrame:
        """Pairs of rows of own (l.*, r.*) with the smaller id first, where further keys agree too; left: own with further columns."""
        lkeys, rkeys = [*self.keys, *lkeys], [*self.keys, *rkeys]
        a, b = spread(self.own if left is None else left, self.own, lkeys, rkeys, "spell_id")
        on = (F.col("l._salt") == F.col("r._salt")) & (F.col("l.spell_id") < F.col("r.spell_id")) & self.where
        for x, y in zip(lkeys, rkeys, strict=True):
            on = on & (F.col(f"l.{x}") == F.col(f"r.{y}"))
        return a.alias("l").join(b.alias("r"), on)

    def _told(self, both: DataFrame) -> DataFrame:
        """lid, rid, both kinds, geo, yr of each pair."""
        return both.select(F.col("l.spell_id").alias("lid"), F.col("r.spell_id").alias("rid"), F.col("l.kind").alias("lk"), F.col("r.kind").alias("rk"), *[c.alias(n) for n, c in _place_and_years(self.annual).items()])

    def _each(self) -> DataFrame:
        found = {**_name_levels(), **_place_and_years(self.annual)}
        return _similar(self._both()).select(F.col("l.spell_id").alias("lid"), F.col("r.spell_id").alias("rid"), *[found[c].alias(c) for c in COMPARED])

    def compared(self, change: dict[str, Column] | None = None) -> DataFrame:
        """As compare(); change: columns made of those that hang on kinds alone."""
        change = change or {}
        if not self.few:
            return self._each().withColumns(change)
        return self._told(self._both()).join(F.broadcast(self.kinds.withColumns(change)), ["lk", "rk"]).select("lid", "rid", *COMPARED)

    def _symmetric(self) -> bool:
        """Whether a pair has the same levels with its sides exchanged."""
        told = ["sn", "gn", "pt", "stratum"]
        turned = self.kinds.select(F.col("rk").alias("lk"), F.col("lk").alias("rk"), F.struct(*told).alias("_t"))
        names = self.kinds.join(turned, ["lk", "rk"]).where(F.struct(*told) != F.col("_t")).limit(1).count()
        return not names and not self.own.where("first_seen is null or last_seen is null or last_seen < first_seen").limit(1).count()

    def _counted(self, *by: str) -> DataFrame:
        """lk, rk, geo, yr, _n: twice the pairs of spells, from pairs of cells (own's rows by keys, kind, school, years and ``by``)."""
        columns = [*self.keys, "kind", "school", "first_seen", "last_seen", *by]
        cells = cut(self.own.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).withColumns({"cell": F.struct(*columns), "_c": F.xxhash64(*columns)}))
        keys = [*self.keys, *[c for c in by if c == "location_id"]]
        a, b = spread(cells, cells, keys, keys, "_c")
        on = (F.col("l._salt") == F.col("r._salt")) & self.where
        for k in keys:
            on = on & (F.col(f"l.{k}") == F.col(f"r.{k}"))
        geo = F.lit(0) if "location_id" in by else F.when(F.col("l.located") & F.col("r.located"), 2).otherwise(3)
        n = F.col("l.n") * F.col("r.n") - F.when(F.col("l.cell") == F.col("r.cell"), F.col("l.n")).otherwise(0)
        both = a.alias("l").join(b.alias("r"), on).select(F.col("l.kind").alias("lk"), F.col("r.kind").alias("rk"), geo.alias("geo"), _years(self.annual).alias("yr"), n.alias("_n"))
        return both.groupBy("lk", "rk", "geo", "yr").agg(F.sum("_n").alias("_n"))

    def patterns(self) -> list:
        """As patterns(), from counts of cells (no pairs are made) where levels don't hang on the order; ``where`` may take school and years."""
        if not self.few:
            return patterns(self._each())
        if self._symmetric():
            own, self.own = self.own, self.own.withColumn("located", F.col("location_id").isNotNull())
            same = cut(self._counted("location_id"))
            cells = self._counted("located").union(same).union(same.select("lk", "rk", F.lit(2), "yr", -F.col("_n")))
            self.own, half = own, 2
        else:
            cells, half = self._told(self._both()).groupBy("lk", "rk", "geo", "yr").agg(F.count(F.lit(1)).alias("_n")), 1
        total = cells.join(F.broadcast(self.kinds), ["lk", "rk"]).groupBy("stratum", *LEVELS).agg((F.sum("_n") / half).cast("long").alias("count"))
        return total.where(F.col("count") > 0).collect()

    def scored(self, m: dict, u: dict, lam: float) -> DataFrame:
        """As score(): kinds are scored for each level of place and years, and only pairs whose score stays are made."""
        if not self.few:
            return score(self._each(), m, u, lam)
        level = lambda f, values: F.explode(F.array(*[F.lit(i) for i in values])).alias(f)
        cells = self.kinds.select("*", level("geo", (0, 2, 3))).select("*", level("yr", range(LEVELS["yr"]))).withColumns({"lid": F.struct("lk", "rk", "geo", "yr"), "rid": F.lit(0)})
        kept = cut(score(cells, m, u, lam).select("lid.*", "weight", "probability"))
        # pairs of one place are few; others are made for kinds that stay only
        near = self._both(None, ["location_id"], ["location_id"])
        apart = self.own.join(sized(kept.where("geo > 0").select(F.col("lk").alias("kind"), "rk").distinct()), "kind")
        far = self._both(apart, ["rk"], ["kind"]).where(F.coalesce(F.col("l.location_id") != F.col("r.location_id"), F.lit(True)))
        return self._told(near).union(self._told(far)).join(sized(kept), ["lk", "rk", "geo", "yr"]).select("lid", "rid", "weight", "probability")


def patterns(compared: DataFrame, *extra: Column) -> list:
    """How many pairs have each combination of levels: at most strata x products of levels rows on the driver."""
    return compared.groupBy("stratum", *LEVELS, *extra).count().collect()


def _draws(spell: DataFrame, n: int, seed: int) -> list[DataFrame]:
    """spell_id, school of two seeded draws of n spells.

    Each draw is one from the sorted ids at every size: it takes places in their order, so the ids stay where they are."""
    from .ordered import record_id

    spark, total, draw = spell.sparkSession, spell.count(), random.Random(seed)
    left, right = draw.sample(range(total), min(n, total)), draw.sample(range(total), min(n, total))
    placed = cut(record_id(spell.select("spell_id", "school"), ["spell_id"], "_at"))
    return [placed.join(F.broadcast(spark.createDataFrame([(i,) for i in at], "_at long")), "_at").select("spell_id", "school") for at in (left, right)]


def random_pairs(spell: DataFrame, n: int = 3000, seed: int = 1848) -> DataFrame:
    """Pairs lid < rid of different schools from a seeded draw of n spells on both sides (a sampling operator)."""
    left, right = _draws(spell, n, seed)
    a, b = left.toDF("lid", "ls"), right.toDF("rid", "rs")
    return a.join(F.broadcast(b), (F.col("lid") < F.col("rid")) & (F.col("ls") != F.col("rs"))).select("lid", "rid")


def random_patterns(spell: DataFrame, annual: list[str], n: int = 3000, seed: int = 1848) -> list:
    """patterns() of compare() of random_pairs(): both draws' rows meet as they are, and names' similarity is that of distinct names."""
    own = spell.withColumns({"f_sn": F.lit(1.0), "f_geo": F.lit(1.0)}).select(*SEEN, *NAMED)
    a, b = (cut(own.join(F.broadcast(x.select("spell_id")), "spell_id")) for x in _draws(spell, n, seed))
    name = lambda df, c: df.select(F.col("ln_norm").alias(c)).where("ln_norm is not null").distinct()
    named = name(a, "_ln").join(F.broadcast(name(b, "_rn")), F.lit(True))
    l, r = F.col("l.spell_id"), F.col("r.spell_id")
    dealt = a.repartition(spell.sparkSession.sparkContext.defaultParallelism, "spell_id")
    both = dealt.alias("l").join(F.broadcast(b.alias("r")), (l < r) & (F.col("l.school") != F.col("r.school")))
    found = {**_name_levels(), **_place_and_years(annual)}
    return patterns(_similar(both, named).select(*[found[c].alias(c) for c in COMPARED[:6]]))


def smoothed(counts: dict[int, float], k: int) -> list[float]:
    total = sum(counts.values())
    return [(counts.get(i, 0) + 0.5) / (total + 0.5 * k) for i in range(k)]


def by_stratum(rows: list, fields: list[str], keep=lambda r: True) -> dict:
    """stratum -> field -> smoothed shares of levels; a stratum that isn't there gets the mean of the others."""
    out: dict = {}
    strata = ("both_full", "mixed", "both_abbrev")
    for s in strata:
        mine = [r for r in rows if r["stratum"] == s and keep(r)]
        if mine:
            out[s] = {}
            for f in fields:
                counts: dict = defaultdict(float)
                for r in mine:
                    counts[r[f]] += r["count"]
                out[s][f] = smoothed(counts, LEVELS[f])
    for s in strata:
        if s not in out:
            known = [v for k, v in out.items() if k in strata]
            out[s] = {f: [sum(x[f][i] for x in known) / len(known) if known else 1 / LEVELS[f] for i in range(LEVELS[f])] for f in fields}
    return out


def seeds(rows: list, rare: float = 2e-4) -> dict:
    """m of each stratum from three sets of pairs that are matches by evidence other than the field's own."""
    m = by_stratum(rows, ["gn", "yr", "pt"], lambda r: r["sn"] == 0 and r["geo"] == 0 and r["is_rare"])
    sn = by_stratum(rows, ["sn"], lambda r: r["gn"] <= 1 and r["geo"] == 0)
    geo = by_stratum(rows, ["geo"], lambda r: r["sn"] == 0 and r["gn"] <= 2 and r["is_rare"])
    return {s: {**m[s], **sn[s], **geo[s]} for s in m}


def em(rows: list, m: dict, u: dict, lam: float, rounds: int = 8) -> dict:
    """m by expectation and maximisation over level patterns, with u and the share of matches fixed."""
    prior = math.log(lam / (1 - lam))
    for _ in range(rounds):
        new = {s: {f: [1e-9] * k for f, k in LEVELS.items()} for s in m}
        for r in rows:
            s = r["stratum"]
            z = prior + sum(math.log(max(m[s][f][r[f]], 1e-12)) - math.log(max(u[s][f][r[f]], 1e-12)) for f in LEVELS)
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))
            for f in LEVELS:
                new[s][f][r[f]] += p * r["count"]
        m = {s: {f: [max(x / sum(v), 1e-12) for x in v] for f, v in fs.items()} for s, fs in new.items()}
    return m


def match_share(n_spells: int, n_pairs: int, mean_schools: float = 1.45) -> float:
    return min(0.5, n_spells * (1 - 1 / mean_schools) / max(1, n_pairs))


def _rarity(u: dict, f: str, tf: str) -> Column:
    """What a pair's common value of field f adds to its weight, from the product of both sides' shares."""
    u0 = F.create_map(*[x for s in u for x in (F.lit(s), F.lit(math.log2(u[s][f][0])))])
    rarity = F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.element_at(u0, F.col("stratum")) - F.log2(F.col(tf))))
    return F.when(F.col(f) == 0, rarity).otherwise(0.0)


def _weight(m: dict, u: dict, lam: float) -> Column:
    """The weight of a pair (log2) but for the rarity of its place."""
    weight = F.lit(math.log2(lam / (1 - lam)))
    for f in LEVELS:
        flat = {(s, i): math.log2(max(m[s][f][i], 1e-12)) - math.log2(max(u[s][f][i], 1e-12)) for s in m for i in range(LEVELS[f])}
        table = F.create_map(*[x for (s, i), v in flat.items() for x in (F.lit(f"{s}|{i}"), F.lit(v))])
        weight = weight + F.element_at(table, F.concat_ws("|", "stratum", F.col(f).cast("string")))
    return weight + _rarity(u, "sn", "tf_sn")


def _probability(weight: str) -> Column:
    return 1 / (1 + F.pow(F.lit(2.0), -F.col(weight)))


def score(compared: DataFrame, m: dict, u: dict, lam: float) -> DataFrame:
    """lid, rid, weight (log2), probability; pairs over the retention weight."""
    scored = compared.withColumn("weight", _weight(m, u, lam) + _rarity(u, "geo", "tf_geo"))
    return scored.where(F.col("weight") > RETAIN).select("lid", "rid", "weight", _probability("weight").alias("probability"))


def connected(edges: DataFrame, a: str = "lid", b: str = "rid") -> DataFrame:
    """id, component: the smallest id that edges lead to; labels spread with pointer jumping."""
    near = cut(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(b, a)).distinct())
    labels = cut(near.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("id"), F.least("x", "m").alias("component")))
    while True:
        around = near.join(labels, F.col("y") == F.col("id")).groupBy("x").agg(F.min("component").alias("m"))
        hooked = labels.join(around, F.col("id") == F.col("x")).select("id", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        up = labels.select(F.col("id").alias("u"), F.col("component").alias("top"))
        new = cut(hooked.join(up, F.col("component") == F.col("u"), "left").select("id", "old", F.least("component", F.coalesce("top", "component")).alias("component")))
        labels = new.select("id", "component")
        if not new.where("component != old").limit(1).count():
            return labels


def merge(rows: list[tuple], spans: dict) -> dict:
    """id -> root, joining (weight, lid, rid) from the heaviest on, where no rule forbids it.

    spans: id -> (school, first, last). No two spells of one school, at most SCHOOLS schools, no overlap of more
    than OVERLAP years, and SPAN years at most in all."""
    root = {i: i for i in spans}
    members = {i: [i] for i in spans}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for _, lid, rid in sorted(rows, key=lambda r: (-r[0], r[1], r[2])):
        a, b = find(lid), find(rid)
        if a == b:
            continue
        group = [spans[i] for i in members[a] + members[b]]
        schools = [g[0] for g in group]
        if len(set(schools)) < len(schools) or len(schools) > SCHOOLS or max(g[2] for g in group) - min(g[1] for g in group) + 1 > SPAN:
            continue
        if any(min(p[2], q[2]) - max(p[1], q[1]) + 1 > OVERLAP for i, p in enumerate(group) for q in group[:i]):
            continue
        root[b] = a
        members[a] += members.pop(b)
    return {i: find(i) for i in spans}


def cluster(scored: DataFrame, spell: DataFrame, threshold: float = 0.95) -> DataFrame:
    """spell_id, student_id: constrained clusters of the pairs with at least ``threshold``.

    Pairs that may not share a cluster by themselves never lead to a merge, so they go first, which also takes large components
    of common names apart. Merges never leave a component of the graph, so components are merged apart, each in the global edge order."""
    span = lambda p, k: spell.select(F.col("spell_id").alias(k), F.struct("school", "first_seen", "last_seen").alias(p))
    told = scored.where(F.col("probability") >= threshold).join(span("_l", "lid"), "lid").join(span("_r", "rid"), "rid")
    return merged(cut(told.where(_together("_l", "_r")).select("lid", "rid", "weight", "_l", "_r")), spell)


def _together(a: str, b: str) -> Column:
    """Whether two spells may share a cluster by themselves."""
    of = lambda f, c: f(F.col(f"{a}.{c}"), F.col(f"{b}.{c}"))
    spans = of(F.greatest, "last_seen") - of(F.least, "first_seen") + 1 <= SPAN
    return (F.col(f"{a}.school") != F.col(f"{b}.school")) & spans & (of(F.least, "last_seen") - of(F.greatest, "first_seen") + 1 <= OVERLAP)


def merged(edges: DataFrame, spell: DataFrame) -> DataFrame:
    """spell_id, student_id of all spells: edges (lid, rid, weight, both sides' school and years _l, _r) merged within connected components."""
    ship(spell.sparkSession)
    comp = connected(edges)
    kept = edges.join(comp, F.col("lid") == F.col("id")).select("component", "lid", "rid", "weight", *[f"{x}.{c}" for x in ("_l", "_r") for c in ("school", "first_seen", "last_seen")])
    kept = kept.toDF("component", "lid", "rid", "weight", "ls", "lf", "lt", "rs", "rf", "rt").repartition("component").sortWithinPartitions("component")

    def run(batches):
        import pyarrow as pa

        # a component's edges may lie in several batches
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        ids, roots = [], []
        for _, of in groupby(rows, key=lambda row: row[0]):
            edge, spans = [], {}
            for _, lid, rid, weight, ls, lf, lt, rs, rf, rt in of:
                edge.append((weight, lid, rid))
                spans[lid], spans[rid] = (ls, lf, lt), (rs, rf, rt)
            found = merge(edge, spans)
            ids += found
            roots += found.values()
            if len(ids) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(roots, pa.int64())], ["spell_id", "student_id"])
                ids, roots = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(roots, pa.int64())], ["spell_id", "student_id"])

    linked = kept.mapInArrow(run, "spell_id long, student_id long")
    return spell.select("spell_id").join(linked, "spell_id", "left").select("spell_id", F.coalesce("student_id", "spell_id").alias("student_id"))


def evaluate(clusters: DataFrame, truth: DataFrame, id_: str = "spell_id", found: str = "student_id", real: str = "person") -> DataFrame:
    """One row: purity, pairwise precision, recall and F1, from cell counts (no pairs are made)."""
    rows = clusters.join(truth, id_)
    pairs = lambda n: n * (n - 1) / 2
    cells = rows.groupBy(found, real).count()
    both = cells.agg(F.sum(pairs(F.col("count"))).alias("tp"), F.sum("count").alias("n"))
    mine = cells.groupBy(found).agg(F.sum("count").alias("c"), F.max("count").alias("m")).agg(F.sum(pairs(F.col("c"))).alias("fp"), F.sum("m").alias("pure"))
    theirs = cells.groupBy(real).agg(F.sum("count").alias("c")).agg(F.sum(pairs(F.col("c"))).alias("fn"))
    one = both.join(mine, F.lit(True)).join(theirs, F.lit(True))
    p, r = F.try_divide("tp", "fp"), F.try_divide("tp", "fn")
    return one.select((F.col("pure") / F.col("n")).alias("purity"), p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def _pairs(df: DataFrame, *by: str) -> DataFrame:
    """One row: how many pairs of spells of different schools agree on ``by``, from counts (no pairs are made)."""
    two = lambda n: n * (n - 1) / 2
    cells = df.groupBy(*by, "school").agg(F.count(F.lit(1)).alias("n"))
    whole = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(two(F.col("n"))).alias("same"))
    return whole.agg(F.coalesce(F.sum(two(F.col("n")) - F.col("same")), F.lit(0.0)).cast("long").alias("n"))


def cross_school_quality(found: DataFrame) -> DataFrame:
    """One row: predicted, actual and correct pairs of different schools, precision, recall, F1. found: student_id, person, school."""
    one = _pairs(found, "student_id").withColumnRenamed("n", "predicted").crossJoin(_pairs(found, "person").withColumnRenamed("n", "actual")).crossJoin(_pairs(found, "student_id", "person").withColumnRenamed("n", "correct"))
    p, r = F.try_divide("correct", "predicted"), F.try_divide("correct", "actual")
    return one.select("predicted", "actual", "correct", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def blocking_recall(blocked: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: pairs of one person at two schools, and how many of them the blocks (lid, rid) hold. truth: spell_id, person, school."""
    side = lambda p, k: truth.select(F.col("spell_id").alias(k), F.col("person").alias(p + "p"), F.col("school").alias(p + "s"))
    told = blocked.join(side("l", "lid"), "lid").join(side("r", "rid"), "rid").where("lp = rp and ls != rs")
    held = told.agg(F.count(F.lit(1)).alias("in_blocks"))
    return _pairs(truth, "person").withColumnRenamed("n", "true_pairs").crossJoin(held).withColumn("recall", F.try_divide("in_blocks", "true_pairs"))


def threshold_sweep(scored: DataFrame, truth: DataFrame, thresholds: tuple = (0.5, 0.7, 0.8, 0.9, 0.95, 0.99)) -> DataFrame:
    """A row for each threshold: edges at or over it, their precision, and the share of true pairs among them; one pass."""
    side = lambda p, k: truth.select(F.col("spell_id").alias(k), F.col("person").alias(p))
    told = scored.join(side("_l", "lid"), "lid").join(side("_r", "rid"), "rid").withColumn("_ok", F.col("_l") == F.col("_r"))
    cells = []
    for i, th in enumerate(thresholds):
        over = F.col("probability") >= th
        cells += [F.count_if(over).alias(f"n{i}"), F.count_if(over & F.col("_ok")).alias(f"k{i}")]
    one = told.agg(*cells).crossJoin(_pairs(truth, "person"))
    rows = [F.struct(F.lit(th).alias("threshold"), F.col(f"n{i}").alias("edges"), F.try_divide(f"k{i}", f"n{i}").alias("precision"), F.try_divide(F.col(f"k{i}"), F.col("n")).alias("recall")) for i, th in enumerate(thresholds)]
    return one.select(F.inline(F.array(*rows)))


def recall_by(found: DataFrame, label: str, least: int = 1) -> DataFrame:
    """a, b (labels of both spells, a <= b), true pairs and the share of them that is linked. found: student_id, person, school, ``label``.

    A person has few labels, so counts by person and label meet, not spells."""
    both = None
    for name, by in (("true_pairs", ["person"]), ("linked", ["person", "student_id"])):
        n = found.groupBy(*by, "school", label).agg(F.count(F.lit(1)).alias("n"))
        l, r = n.select(*by, F.col("school").alias("ls"), F.col(label).alias("a"), F.col("n").alias("ln")), n.select(*by, F.col("school").alias("rs"), F.col(label).alias("b"), F.col("n").alias("rn"))
        # each pair of cells once: by school, as schools differ
        cells = l.join(r, by).where("ls < rs").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("ln") * F.col("rn")).alias("n"))
        total = cells.groupBy("a", "b").agg(F.sum("n").alias(name))
        both = total if both is None else both.join(total, ["a", "b"], "left")
    return both.where(F.col("true_pairs") >= least).select("a", "b", "true_pairs", (F.coalesce("linked", F.lit(0)) / F.col("true_pairs")).alias("recall"))


def gold_validation(found: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: of the spells whose earlier school is stated, how many were linked to it, to other schools only, or to none.

    found: spell_id, student_id, school; gold: spell_id, target."""
    schools = found.groupBy("student_id").agg(F.collect_set("school").alias("_s"))
    told = gold.join(found.select("spell_id", "student_id"), "spell_id").join(schools, "student_id")
    hit = F.array_contains("_s", F.col("target"))
    return told.agg(
        F.count(F.lit(1)).alias("reachable"), F.count_if(hit).alias("hit"), F.count_if(~hit & (F.size("_s") > 1)).alias("wrong_school"), F.count_if(F.size("_s") == 1).alias("unlinked")
    )


class Met:
    """Pairs of block(), as counts of level patterns and as edges; no row is made for a pair that doesn't become an edge.

    Spells are of kinds (their name columns; a kind's number is its smallest id), so names are compared once for each pair of kinds.
    Pairs of spells are counted from cells of spells of one kind, school and years: where names alone put them into a block by whether
    both places are known, and where places agree by place."""

    NAMES = [["ln_phon", "gn_i1"], ["ln_norm"], ["phon3", "gn_init", "gn_i1"]]
    PLACES = [["location_id", "ln_phon"], ["ok_place", "gn_init"], ["location_id", "ln_norm"], ["location_id", "phon3", "gn_init", "gn_i1"]]

    def __init__(self, spell: DataFrame, annual: list[str], region_share: float = 0.002):
        self.annual, names = annual, NAMED[:-2]
        own = cut(spell.select(*SEEN, *names).withColumn("_key", F.struct(*names)))
        kinds = cut(own.groupBy("_key").agg(F.min("spell_id").alias("kind")).join(sized(key_share(own, "ln_phon", "f_sn")), F.col("_key.ln_phon") == F.col("ln_phon"), "left").select("kind", "_key", F.coalesce("f_sn", F.lit(1.0)).alias("f_sn"), F.lit(1.0).alias("f_geo")))
        places = key_share(own, "location_id", "f_geo").withColumn("ok_place", F.when(F.col("f_geo") < region_share, F.col("location_id")))
        own = own.join(sized(kinds.select("_key", "kind")), "_key").join(sized(places), "location_id", "left")
        own = own.withColumns({"phon3": F.substring("ln_phon", 1, 3), "f_geo": F.coalesce("f_geo", F.lit(1.0))})
        self.own = cut(own.select(*SEEN, "kind", "f_geo", *{c: 0 for rule in self.NAMES + self.PLACES for c in rule if c != "location_id"}))
        self.kinds = kinds.select("kind", "_key.*", "f_sn", "f_geo")
        self._count(None)
        odd = self._levels()
        if odd is not None:
            # names that are alike one way round only: their spells are cells of their own, and keep their order
            self._count(odd)
            self._levels()

    def _count(self, odd: DataFrame | None) -> None:
        """counts: lk, rk, geo, yr, n of all pairs in blocks."""
        l, r = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
        rows = self.own.withColumn("single", F.lit(None).cast("long")) if odd is None else self.own.join(sized(odd.withColumn("_odd", F.lit(True))), "kind", "left").withColumn("single", F.when(F.col("_odd"), F.col("spell_id"))).drop("_odd")
        rules = {c: 0 for rule in self.NAMES + self.PLACES for c in rule if c not in ("location_id", "ok_place")}
        where = (l("school") != r("school")) & (F.greatest(r("first_seen") - l("last_seen"), l("first_seen") - r("last_seen")) >= -2)
        ordered = l("single").isNotNull() & r("single").isNotNull()
        sides = [F.when(ordered, l("kind")).otherwise(F.least(l("kind"), r("kind"))).alias("lk"), F.when(ordered, r("kind")).otherwise(F.greatest(l("kind"), r("kind"))).alias("rk")]

        def pairs(by, rules_, **more):
            cells = cut(rows.groupBy("kind", "school", "first_seen", "last_seen", "single", *by, *rules).agg(F.count(F.lit(1)).alias("n"), F.min("spell_id").alias("cell")))
            met = multi_rule_pairs(cells, "cell", rules_, where, take=[*sides, _years(self.annual).alias("yr"), (l("n") * r("n")).alias("n"), *[c.alias(k) for k, c in more.items()]])
            return met.groupBy("lk", "rk", "yr", *more).agg(F.sum("n").alias("n"))

        rows = rows.withColumn("located", F.col("location_id").isNotNull())
        agree = F.lit(False)
        for rule in self.NAMES:
            one = F.lit(True)
            for c in rule:
                one = one & F.coalesce(l(c) == r(c), F.lit(False))
            agree = agree | one
        named = pairs(["located"], self.NAMES, geo=F.when(l("located") & r("located"), 2).otherwise(3))
        same = cut(pairs(["location_id", "ok_place"], self.PLACES, named=agree))
        all_ = named.select("lk", "rk", "geo", "yr", "n").union(same.select("lk", "rk", F.lit(0), "yr", "n")).union(same.where("named").select("lk", "rk", F.lit(2), "yr", -F.col("n")))
        self.counts = cut(all_.groupBy("lk", "rk", "geo", "yr").agg(F.sum("n").alias("n")).where("n > 0"))

    def _levels(self) -> DataFrame | None:
        """levels: lk, rk and their levels, both ways round; the kinds whose levels hang on the order, if there are any."""
        pairs = self.counts.select("lk", "rk")
        pairs = pairs.union(pairs.select("rk", "lk")).distinct()
        both = pairs.join(sized(self.kinds).alias("l"), F.col("lk") == F.col("l.kind")).join(sized(self.kinds).alias("r"), F.col("rk") == F.col("r.kind"))
        self.levels = cut(_similar(both).select("lk", "rk", *[c.alias(n) for n, c in _name_levels().items()]))
        told = F.struct("sn", "gn", "pt", "stratum")
        turned = self.levels.select(F.col("rk").alias("lk"), F.col("lk").alias("rk"), told.alias("_t"))
        odd = self.levels.join(turned, ["lk", "rk"]).where(told != F.col("_t"))
        return odd.select(F.col("lk").alias("kind")).distinct() if odd.limit(1).count() else None

    def patterns(self, rare: float) -> list:
        """patterns() of all pairs, by is_rare too."""
        told = self.counts.join(sized(self.levels.withColumn("is_rare", F.col("rare") < rare)), ["lk", "rk"])
        return sorted(told.groupBy("stratum", *LEVELS, "is_rare").agg(F.sum("n").alias("count")).collect())

    def edges(self, m: dict, u: dict, lam: float, threshold: float) -> DataFrame:
        """lid, rid, weight, _l, _r as merged() takes them, of the pairs that reach threshold and may share a cluster."""
        told = self.levels.withColumn("tf_sn", F.when(F.col("sn") == 0, F.col("tf_sn")).otherwise(1.0))
        by = ["stratum", "sn", "gn", "pt", "tf_sn"]
        level = lambda f, values: F.explode(F.array(*[F.lit(i) for i in values])).alias(f)
        cells = told.select(*by).distinct().select("*", level("geo", (0, 2, 3))).select("*", level("yr", range(LEVELS["yr"])))
        # where places agree, the share of the place isn't known yet: the most that it may add is taken
        cells = cells.withColumn("named", _weight(m, u, lam)).withColumn("most", F.col("named") + F.when(F.col("geo") == 0, 4.0).otherwise(0.0))
        kept = cut(cells.where((F.col("most") > RETAIN) & (_probability("most") >= threshold)))
        kept = cut(kept.join(told, by).select("lk", "rk", "geo", "yr", "named", "stratum"))
        l, r = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
        span = lambda x: F.struct(*[x(c).alias(c) for c in ("school", "first_seen", "last_seen")])
        where = _together("l", "r") & (F.greatest(r("first_seen") - l("last_seen"), l("first_seen") - r("last_seen")) >= -2)
        of = [l("kind").alias("lk"), r("kind").alias("rk"), _years(self.annual).alias("yr"), span(l).alias("_l"), span(r).alias("_r")]
        pairs = multi_rule_pairs(self.own, "spell_id", self.PLACES, where, take=[*of, (l("f_geo") * r("f_geo")).alias("tf_geo")]).withColumn("geo", F.lit(0))
        far = kept.where("geo > 0").select("lk", "rk").distinct()
        if far.limit(1).count():
            a, b = spread(self.own.join(sized(far), F.col("kind") == F.col("lk")).drop("lk"), self.own, ["rk"], ["kind"], "spell_id")
            on = (l("rk") == r("kind")) & (l("_salt") == r("_salt")) & (l("spell_id") < r("spell_id")) & where & F.coalesce(l("location_id") != r("location_id"), F.lit(True))
            geo = F.when(l("location_id").isNull() | r("location_id").isNull(), 3).otherwise(2)
            pairs = pairs.unionByName(a.alias("l").join(b.alias("r"), on).select(l("spell_id").alias("lid"), r("spell_id").alias("rid"), *of, F.lit(1.0).alias("tf_geo"), geo.alias("geo")))
        exact = pairs.join(sized(kept), ["lk", "rk", "geo", "yr"]).withColumn("weight", F.col("named") + _rarity(u, "geo", "tf_geo"))
        return cut(exact.where((F.col("weight") > RETAIN) & (_probability("weight") >= threshold)).select("lid", "rid", "weight", "_l", "_r"))


def link(records: DataFrame, annual: list[str], threshold: float = 0.95, mean_schools: float = 1.45, sample: int = 3000, rare: float = 2e-4) -> DataFrame:
    """record_id, spell_id, student_id for records; the whole chain."""
    chained = cut(spells(prepare(records), annual))
    spell = cut(spell_table(chained))
    met = Met(spell, annual)
    n, rows = spell.count(), met.patterns(rare)
    u = by_stratum(random_patterns(spell, annual, sample), list(LEVELS))
    lam = match_share(n, sum(r["count"] for r in rows), mean_schools)
    m = em(rows, seeds(rows, rare), u, lam)
    clusters = merged(met.edges(m, u, lam, threshold), spell)
    ids = chained.select("record_id", "spell_key", "chain").join(spell.select("spell_key", "chain", "spell_id"), ["spell_key", "chain"])
    return ids.join(clusters, "spell_id").select("record_id", "spell_id", "student_id")
