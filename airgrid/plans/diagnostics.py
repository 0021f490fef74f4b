"""Completeness, exceedance, missingness and census overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.functions.keys import ordered_list
from airgrid.functions.numbers import wmean
from airgrid.functions.times import hours_in_year, iso_weekday
from airgrid.operators.ordered import quantiles, rank_quintile
from airgrid.operators.reshape import to_long, to_wide
from airgrid.operators.spatial import rank_nearest
from airgrid.session import broadcast_if_small

# Annual guideline concentrations.
GUIDELINES = {"pm10": 15.0, "pm25": 5.0}


def stations_by_pollutant(panel: DataFrame, pollutants: list[str], min_share: float) -> DataFrame:
    """Stations whose readings cover the calendar year well enough.

    The share uses the hours of the calendar year, so hours without a row count as missing.
    """
    year = F.year("datetime")
    per = panel.groupBy("station", year.alias("year")).agg(*[F.count(p).alias(p) for p in pollutants])
    long = to_long(per, ["station", "year"], list(pollutants), "pollutant", "valid_n")
    ok = long.where(F.col("valid_n") / hours_in_year(F.col("year")) >= min_share)
    return ok.groupBy("year", "pollutant").agg(
        F.count_distinct("station").alias("n_stations"), ordered_list("station").alias("stations")
    )


def exceedances(
    panel: DataFrame, guidelines: dict[str, float] | None = None, station_level: bool = True, how: str = "mean"
) -> DataFrame:
    """City mean (or median) by year over station means or over pooled hours, and its guideline factor."""
    guidelines = GUIDELINES if guidelines is None else guidelines
    pols = [p for p in guidelines if p in panel.columns]
    base = panel.withColumn("year", F.year("datetime"))
    long = to_long(base, ["year", "station"], pols, "pollutant", "value", keep_null=False)
    keys = ["year", "pollutant"]
    counts = [F.count_distinct("station").alias("n_stations")]
    if station_level:
        long = long.groupBy(*keys, "station").agg(F.avg("value").alias("value"), F.count("value").alias("_n"))
        counts.append(F.sum("_n").alias("n_valid_hrs"))
    else:
        counts.append(F.count("value").alias("n_valid_hrs"))
    out = long.groupBy(*keys).agg(F.avg("value").alias("city_avg"), *counts)
    if how == "median":
        mid = quantiles(long, keys, "value", {"city_avg": 0.5})
        out = out.drop("city_avg").join(F.broadcast(mid), keys)  # one row per year and pollutant
    level = F.create_map(*[F.lit(x) for p in pols for x in (p, guidelines[p])])
    out = out.withColumn("who_aqg", level[F.col("pollutant")])
    return out.withColumn("exceedance_factor", F.col("city_avg") / F.col("who_aqg"))


DIMENSIONS = {
    "station": lambda: F.col("station"),
    "year": lambda: F.year("datetime"),
    "month": lambda: F.month("datetime"),
    "hour": lambda: F.hour("datetime"),
    "day_of_week": lambda: iso_weekday("datetime"),
}


def _missing_share(p: str) -> Column:
    return F.lit(100.0) * F.count_if(F.col(p).isNull()) / F.count(F.lit(1))


def missing_proportions(panel: DataFrame, pollutants: list[str], dims: list[str]) -> DataFrame:
    """Share of rows without a value, by one or more calendar dimensions."""
    return panel.groupBy(*[DIMENSIONS[d]().alias(d) for d in dims]).agg(
        *[_missing_share(p).alias(f"{p}_missing_pct") for p in pollutants], F.count(F.lit(1)).alias("total_hrs")
    )


def missing_independent(panel: DataFrame, pollutant: str, first: str, second: str) -> DataFrame:
    """Two-way share approximated by the mean of the two one-way shares.

    Dimension values are few and fixed by the calendar; the second list is one array per row.
    """
    a = missing_proportions(panel, [pollutant], [first]).select(first, F.col(f"{pollutant}_missing_pct").alias("_a"))
    b = missing_proportions(panel, [pollutant], [second]).agg(
        F.collect_list(F.struct(F.col(second), F.col(f"{pollutant}_missing_pct").alias("_b"))).alias("v")
    )
    grid = a.withColumn("_x", F.explode(b.scalar()))
    return grid.select(first, F.col("_x")[second].alias(second), ((F.col("_a") + F.col("_x")["_b"]) / 2).alias("missing_pct"))


def stations_reporting(panel: DataFrame, pollutants: list[str], year: int | None = None) -> DataFrame:
    """Stations with at least one value, one column per pollutant."""
    df = panel.where(F.col("year") == year) if year else panel
    return df.agg(*[F.count_distinct(F.when(F.col(p).isNotNull(), F.col("station"))).alias(p) for p in pollutants])


def active_stations(panel: DataFrame, pollutants: list[str], need_all: bool = False) -> DataFrame:
    """Stations with a value of any, or of every, pollutant."""
    flags = panel.groupBy("station").agg(*[F.bool_or(F.col(p).isNotNull()).alias(p) for p in pollutants])
    test = F.col(pollutants[0])
    for p in pollutants[1:]:
        test = (test & F.col(p)) if need_all else (test | F.col(p))
    return flags.where(test).select("station")


def unit_quintiles(people: DataFrame, value: str = "educ_years", weight: str = "person_weight") -> DataFrame:
    """Average-rank quintile of the units' weighted mean."""
    units = people.groupBy("geo_id").agg(wmean(value, weight).alias("_mean"), F.sum(weight).alias("_pop"))
    usable = units.where(F.col("_mean").isNotNull() & (F.col("_pop") > 0))
    return rank_quintile(usable, "_mean", "quintile").select("geo_id", "quintile")


def station_quintiles(distances: DataFrame, quintiles: DataFrame) -> DataFrame:
    """Quintile of the unit nearest to each station; ties go to the smaller unit id."""
    first = rank_nearest(distances, "station_id", "geo_id", 1).select("station_id", "geo_id")
    return first.join(broadcast_if_small(quintiles), "geo_id").select("station_id", "quintile").distinct()


def missing_by_quintile(panel: DataFrame, quintiles: DataFrame, pollutants: list[str], report: str = "missing") -> DataFrame:
    """Share of missing or present rows by station quintile, long."""
    q = quintiles.withColumnRenamed("station_id", "station")
    joined = panel.join(broadcast_if_small(q), "station")
    test = (lambda p: F.col(p).isNull()) if report == "missing" else (lambda p: F.col(p).isNotNull())
    wide = joined.groupBy("quintile").agg(
        F.count(F.lit(1)).alias("total_obs"), *[F.count_if(test(p)).cast("double").alias(p) for p in pollutants]
    )
    long = to_long(wide, ["quintile", "total_obs"], list(pollutants), "pollutant", "_n")
    return long.select("pollutant", "quintile", (F.col("_n") / F.col("total_obs")).alias("value"), "total_obs")


def census_summary(units: DataFrame, pop: str = "pop_total") -> DataFrame:
    """Population, distinct units and mean population of usable rows."""
    ok = units.where(F.col("geo_id").isNotNull() & (F.col(pop) > 0))
    return ok.agg(
        F.sum(pop).alias("total_population"), F.count_distinct("geo_id").alias("n_census_geographic_units")
    ).withColumn("average_population_per_unit", F.col("total_population") / F.col("n_census_geographic_units"))


def match_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct left ids that do and do not occur on the right."""
    a = left.select(key).distinct()
    b = right.select(key).distinct().withColumn("_hit", F.lit(1))
    return a.join(b, key, "left").agg(
        F.count("_hit").alias("n_matched"), F.count_if(F.col("_hit").isNull()).alias("n_unmatched")
    )


def counts_table(long: DataFrame, rows: list[str], name: str, values: list, value: str) -> DataFrame:
    """Report pivot with zeros for absent cells."""
    return to_wide(long, rows, name, values, value, F.max, fill=0)
