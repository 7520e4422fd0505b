"""Origin x destination x period panels, padded with zeros, and their covariates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo


def spell_sample(df: DataFrame, spell: str, year: str, record: str) -> DataFrame:
    """One row for each spell: the earliest year's, by record; rows without a spell count as one."""
    rows = df.groupBy(spell).agg(F.min_by(F.struct(*[c for c in df.columns if c != spell]), F.struct(year, record)).alias("_r"))
    return rows.select(spell, "_r.*")


def origins(df: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """One row for each place, from its first row in order."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_r")).select(key, "_r.*")


def od_grid(flows: DataFrame, origin: str, dest: str, period: str, origin_table: DataFrame, dest_table: DataFrame, periods: DataFrame) -> DataFrame:
    """All origins x destinations x periods with their flow, 0 where nobody went.

    The tables of destinations and periods are small (checked by their callers' use: seats and years), so
    the product is made by broadcast; flows are counted first and joined on the key."""
    counted = flows.groupBy(origin, dest, period).agg(F.count(F.lit(1)).alias("flow"))
    grid = origin_table.crossJoin(F.broadcast(dest_table)).crossJoin(F.broadcast(periods))
    return grid.join(counted, [origin, dest, period], "left").fillna(0, ["flow"])


def same_state(a: Column, b: Column) -> Column:
    """of hierarchical codes: state * 100 + province."""
    return F.floor(a / 100) == F.floor(b / 100)


def covariates(grid: DataFrame, confession_map: dict[str, str] | None = None) -> DataFrame:
    """Distances and same-state, same-confession cells of a grid with lat, lon, lat_uni, lon_uni, polity_o, polity_d, confession_o, confession_d."""
    from ..functions.text import lenient

    km = geo.haversine(F.col("lat"), F.col("lon"), F.col("lat_uni"), F.col("lon_uni"))
    out = grid.withColumn("dist_km", km)
    if confession_map:
        out = out.withColumns({c: lenient(F.col(c), confession_map) for c in ("confession_o", "confession_d")})
    out = out.withColumns({
        "log_dist": geo.log_distance(F.col("dist_km")), "same_city": F.col("dist_km") < 1, "same_polity": F.col("polity_o") == F.col("polity_d"),
        "same_state": same_state(F.col("polity_o"), F.col("polity_d")),
        "same_confession": (F.col("confession_o") == F.col("confession_d")) & F.col("confession_o").isin("protestant", "catholic"),
    })
    state, faith = F.coalesce("same_state", F.lit(False)), F.coalesce("same_confession", F.lit(False))
    return out.withColumns({"ss_sc": (state & faith).cast("int"), "ss_dc": (state & ~faith).cast("int"), "ds_sc": (~state & faith).cast("int")})


def shares_by_period(df: DataFrame, dest: str, post: Column, far: Column, weight: str) -> DataFrame:
    """Each destination's share before and after, among near and far origins, and the change."""
    cells = df.groupBy(dest, post.cast("int").alias("post"), far.cast("int").alias("far")).agg(F.sum(weight).alias("w"))
    totals = cells.groupBy("post", "far").agg(F.sum("w").alias("t"))
    shares = cells.join(F.broadcast(totals), ["post", "far"]).withColumn("share", F.try_divide(F.col("w").cast("double"), F.col("t")))
    wide = shares.groupBy(dest, "far").pivot("post", [0, 1]).agg(F.first("share")).fillna(0.0)
    return wide.select(dest, "far", F.col("0").alias("before"), F.col("1").alias("after"), (F.col("1") - F.col("0")).alias("change"))


def guild_status(df: DataFrame, guilds: DataFrame, place: str, polity: str, year: str) -> DataFrame:
    """guild_abolished: true from the year of abolition until that of reinstatement; null without dates.

    Dates of a place go before those of its polity; 0 stands for no date."""
    date = lambda c: F.nullif(F.col(c).cast("int"), F.lit(0))
    by = lambda key, p: guilds.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_{p}")).agg(F.min(date("abolition_year")).alias(f"_{p}a"), F.min(date("reinstatement_year")).alias(f"_{p}r"))
    out = df.join(F.broadcast(by("standard_location_name", "l")), F.col(place) == F.col("_l"), "left").join(F.broadcast(by("standard_polity_id", "p")), F.col(polity) == F.col("_p"), "left")
    off, on = F.coalesce("_la", "_pa"), F.when(F.col("_la").isNotNull(), F.col("_lr")).otherwise(F.col("_pr"))
    gone = (F.col(year) >= off) & (on.isNull() | (F.col(year) < on))
    return out.withColumn("guild_abolished", gone).drop("_l", "_la", "_lr", "_p", "_pa", "_pr")


def polity_id(state: Column, province: Column, name: Column, override: dict[str, int]) -> Column:
    """state * 100 + province, but for the names of override."""
    out = state * 100 + F.coalesce(province, F.lit(0))
    for n, v in override.items():
        out = F.when(name == n, v).otherwise(out)
    return out


def place_label(state: Column, province: Column) -> Column:
    """'state/province', or the one that is there."""
    return F.concat_ws("/", state, province)


def broad_europe(in_borders: Column, lat: Column, lon: Column) -> Column:
    """Within the borders, or in a wide box around Europe."""
    return F.coalesce(in_borders, F.lit(False)) | F.coalesce(lat.between(34, 72) & lon.between(-25, 45), F.lit(False))


def polities_by_year(points: DataFrame, states: DataFrame, provinces: DataFrame, years: list[int], x: str, y: str, cell: float = 1.0) -> DataFrame:
    """points in each map year with their state and province of that year's map, label and polity id.

    states: year, state, state_id, rings; provinces: year, province, province_id, rings."""
    from .geometry import point_in_polygon

    dated = points.crossJoin(F.broadcast(points.sparkSession.createDataFrame([(v,) for v in years], "year int")))
    both = point_in_polygon(point_in_polygon(dated, states, x, y, ["year"], cell=cell), provinces, x, y, ["year"], cell=cell)
    return both.withColumns({"label": place_label(F.col("state"), F.col("province")), "polity_id": polity_id(F.coalesce("state_id", F.lit(0)), F.col("province_id"), F.col("state"), {})})


def polity_report(found: DataFrame, key: str, years: int) -> DataFrame:
    """A row for each point: rows, years without a state or a province, years with several states, and whether all is well."""
    per = found.groupBy(key, "year").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("state").alias("s"), F.count("province").alias("p"))
    out = per.groupBy(key).agg(F.sum("n").alias("n_rows"), F.count_if(F.col("s") == 0).alias("no_state"), F.count_if(F.col("p") == 0).alias("no_province"), F.count_if(F.col("s") > 1).alias("several_states"))
    return out.withColumn("ok", (F.col("n_rows") == years) & (F.col("no_state") == 0) & (F.col("several_states") == 0))


def donor_pool(grid: DataFrame, dest: str, keep: list[str] | None) -> DataFrame:
    """The rows of the destinations of a pool; None stands for all."""
    return grid if keep is None else grid.where(F.col(dest).isin(*keep))


def far_shares(df: DataFrame, by: list[str], far: Column) -> DataFrame:
    """The share of far rows, and how many rows there are, in each group."""
    return df.groupBy(*by).agg(F.avg(far.cast("int")).alias("share_far"), F.count(F.lit(1)).alias("n"))
