"""Stations in their socioeconomic surroundings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.functions.keys import normalize_station
from airgrid.functions.numbers import wmean
from airgrid.operators.ordered import percentile_rank
from airgrid.operators.spatial import containing_unit, nearest, pairs_within
from airgrid.plans.exposure import TARGETS


def unit_reach(units: DataFrame, stations: DataFrame, radius_km: float, start_km: float = 5.0) -> DataFrame:
    """Distance to the nearest station and stations within the radius, per unit."""
    first = nearest(units, stations, "geo_id", "station_id", 1, start_km).select("geo_id", F.col("distance_km").alias("nearest_km"))
    n = pairs_within(units, stations, "geo_id", "station_id", radius_km).groupBy("geo_id").agg(F.count(F.lit(1)).alias("n_stations"))
    return first.join(n, "geo_id", "left").na.fill(0, ["n_stations"])


def distance_trend(units: DataFrame, stations: DataFrame, value: str, radius_km: float) -> DataFrame:
    """Reach of every unit with its percentile along ``value``."""
    ranked = percentile_rank(units.where(F.col(value).isNotNull()), value, ["geo_id"], "percentile")
    return ranked.join(unit_reach(units, stations, radius_km), "geo_id")


def station_annual(panel: DataFrame, pollutants: list[str] = ("pm10", "pm25"), targets: dict | None = None,
                   min_obs: int = 1) -> DataFrame:
    """Values, mean and target hours per station; stations below ``min_obs`` everywhere are left out."""
    targets = TARGETS if targets is None else targets
    aggs = [F.min("station").alias("station_name")]
    for p in pollutants:
        aggs += [F.count(p).alias(f"n_obs_{p}"), F.avg(p).alias(f"avg_{p}")]
        aggs += [F.count_if(F.col(p) >= v).alias(f"hrs_d_{p}_{name}") for name, v in targets.get(p, {}).items()]
    out = panel.groupBy(normalize_station("station").alias("station_id")).agg(*aggs)
    return out.where(F.greatest(*[F.col(f"n_obs_{p}") for p in pollutants], F.lit(0)) >= min_obs)


def buffer_context(stations: DataFrame, units: DataFrame, attributes: list[str], radius_km: float,
                   pop: str = "pop_total") -> DataFrame:
    """Population-weighted unit attributes around each station; none in reach gives NULLs."""
    near = pairs_within(stations, units, "station_id", "geo_id", radius_km).select("station_id", "geo_id")
    joined = near.join(units.select("geo_id", pop, *attributes), "geo_id")
    w = F.when(F.col(pop) > 0, F.col(pop))
    agg = joined.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n_geo_context"),
        F.coalesce(F.sum(pop), F.lit(0.0)).alias("context_population"),
        *[wmean(F.when(w.isNotNull(), F.col(a)), w).alias(a) for a in attributes],
    )
    return stations.select("station_id").join(agg, "station_id", "left").na.fill(0, ["n_geo_context"])


def containing_context(stations: DataFrame, polygons: DataFrame, units: DataFrame, attributes: list[str],
                       pop: str = "pop_total", cell_deg: float = 0.05) -> DataFrame:
    """Attributes of the unit that contains each station."""
    hit = containing_unit(stations, polygons, "station_id", "geo_id", cell_deg)
    joined = hit.join(units.select("geo_id", F.col(pop).alias("context_population"), *attributes), "geo_id", "left")
    return joined.withColumnRenamed("geo_id", "station_geo_id").withColumn(
        "n_geo_context", F.col("station_geo_id").isNotNull().cast("int"))


def scatter_inputs(summary: DataFrame, context: DataFrame) -> DataFrame:
    """Station summary with its context and a flag for a match."""
    marked = context.withColumn("_m", F.lit(1))
    return summary.join(marked, "station_id", "left").withColumn(
        "matched_context", F.coalesce((F.col("n_geo_context") > 0).cast("int"), F.lit(0))).drop("_m")
