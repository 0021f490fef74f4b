"""Gridded satellite hours and city time series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airgrid.functions.numbers import ratio
from airgrid.functions.times import add_hours, year_month
from airgrid.operators.ordered import with_group_total
from airgrid.session import broadcast_if_small

AEROSOLS = ("DUSMASS25", "OCSMASS", "BCSMASS", "SSSMASS25", "SO4SMASS")
# Kg to micrograms, and the mass ratio of ammonium sulphate to sulphate.
KG_TO_UG = 1e9
SULPHATE_RATIO = (132.14, 96.06)
# Thresholds of the two run targets.
RUN_TARGETS = {"IT1": 75.0, "IT2": 50.0}


def zonal_mean(cells: DataFrame, weights: DataFrame, variables: list[str] = AEROSOLS) -> DataFrame:
    """Coverage-weighted region mean per hour; hours lacking any variable are dropped.

    The long cell table joins the small weights table, and sums combine before the shuffle.
    """
    joined = cells.join(broadcast_if_small(weights), "cell_id")
    w = F.col("coverage")
    aggs = [ratio(F.sum(F.col(v) * w), F.sum(F.when(F.col(v).isNotNull(), w))).alias(v) for v in variables]
    return joined.groupBy("region", "date", "hour").agg(*aggs).dropna(subset=list(variables))


def cell_panel(cells: DataFrame, weights: DataFrame, variables: list[str] = AEROSOLS) -> DataFrame:
    """Covered cells kept apart instead of averaged."""
    kept = weights.where(F.col("coverage") > 0).select("region", "cell_id")
    return cells.join(broadcast_if_small(kept), "cell_id").dropna(subset=list(variables))


def add_pm25(df: DataFrame, out: str = "pm25_estimate") -> DataFrame:
    """Masses to micrograms and their sum, sulphate scaled to ammonium sulphate."""
    scaled = df.withColumns({v: F.col(v) * KG_TO_UG for v in AEROSOLS})
    sulphate = F.col("SO4SMASS") * SULPHATE_RATIO[0] / SULPHATE_RATIO[1]
    return scaled.withColumn(out, reduce(lambda a, b: a + b, [F.col(v) for v in AEROSOLS[:4]]) + sulphate)


def city_hours(panel: DataFrame, value: str, out: str, keys: list[str] = ()) -> DataFrame:
    """Mean over stations by date and hour."""
    return panel.groupBy(*keys, F.to_date("datetime").alias("date"), F.hour("datetime").alias("hour")).agg(F.avg(value).alias(out))


def combine(satellite: DataFrame, stations: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Satellite hours left-joined to station hours."""
    return satellite.join(stations, [*keys, "date", "hour"], "left")


def monthly_against(own: DataFrame, published: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """Own monthly mean next to a published monthly series."""
    months = own.groupBy(*keys, year_month("date").alias("year_month")).agg(F.avg(value).alias("own_mean"))
    return months.join(published, [*keys, "year_month"])


SCALES = {"hourly": None, "daily": lambda: F.col("date").cast("string"), "monthly": lambda: year_month("date")}


def correlations(df: DataFrame, a: str, b: str, by: str = "city", scales: list[str] = ("hourly", "daily", "monthly")) -> DataFrame:
    """Pearson correlation over complete pairs per city and time scale."""
    parts = []
    for scale in scales:
        key = SCALES[scale]
        rows = df if key is None else df.groupBy(by, key().alias("_t")).agg(F.avg(a).alias(a), F.avg(b).alias(b))
        parts.append(rows.groupBy(by).agg(F.corr(a, b).alias("correlation")).withColumn("time_scale", F.lit(scale)))
    return reduce(lambda x, y: x.unionByName(y), parts)


def hour_profile(df: DataFrame, columns: list[str], hour: str = "hour", by: list[str] = ()) -> DataFrame:
    """Mean, deviation, count and standard error by hour of day."""
    aggs = []
    for c in columns:
        n, sd = F.count(c), F.stddev_samp(c)
        aggs += [F.avg(c).alias(f"mean_{c}"), sd.alias(f"sd_{c}"), n.alias(f"n_{c}"),
                 (sd / F.sqrt(F.nullif(n, F.lit(0)))).alias(f"se_{c}")]
    return df.groupBy(*by, hour).agg(*aggs)


def station_hour_profile(panel: DataFrame, value: str) -> DataFrame:
    """Station by hour mean with the station's overall mean as its order."""
    per = panel.where(F.col(value).isNotNull()).groupBy("station", F.hour("datetime").alias("hour")).agg(
        F.sum(value).alias("_s"), F.count(value).alias("_n")
    )
    whole = per.groupBy("station").agg((F.sum("_s") / F.sum("_n")).alias("station_mean"))
    return per.join(broadcast_if_small(whole), "station").select(
        "station", "hour", (F.col("_s") / F.col("_n")).alias("mean_value"), "station_mean"
    )


def running_mean_24(series: DataFrame, value: str, out: str, by: list[str]) -> DataFrame:
    """Right-aligned mean of 24 rows, NULL unless all 24 are known.

    The input is one row per city and hour, so a group is bounded by the length of the record.
    """
    w = Window.partitionBy(*by).orderBy("date", "hour").rowsBetween(-23, 0)
    return series.withColumn(out, F.when(F.count(value).over(w) == 24, F.avg(value).over(w)))


def runs_above(series: DataFrame, value: str, threshold: float, by: list[str]) -> DataFrame:
    """Start and length of runs of neighbouring rows at or above the threshold.

    Adjacency is by row; a NULL ends a run. One row per city and hour is expected.
    """
    order = Window.partitionBy(*by).orderBy("date", "hour")
    over = F.coalesce(F.col(value) >= threshold, F.lit(False))
    marked = series.withColumn("_over", over).withColumn("_i", F.row_number().over(order))
    per = Window.partitionBy(*by, "_over").orderBy("date", "hour")
    runs = marked.where("_over").withColumn("_run", F.col("_i") - F.row_number().over(per))
    first = F.min(F.struct("date", "hour"))
    out = runs.groupBy(*by, "_run").agg(first.alias("_f"), F.count(F.lit(1)).alias("time_span_above_target"))
    return out.select(*by, F.col("_f.date").alias("date"), F.col("_f.hour").alias("hour"), "time_span_above_target")


def hour_shares(panel: DataFrame, threshold: float, value: str) -> DataFrame:
    """Share of each station in the hours above a threshold, by hour of day."""
    counts = panel.where(F.col(value) > threshold).groupBy(F.hour("datetime").alias("hour"), "station").agg(
        F.count(F.lit(1)).alias("n_hours")
    )
    out = with_group_total(counts, ["hour"], F.col("n_hours"), "_total")
    return out.withColumn("share", F.col("n_hours") / F.col("_total")).drop("_total")


def drop_inversions(series: DataFrame, dummies: DataFrame, flag: str = "inversion") -> DataFrame:
    """Rows whose day is not marked; unknown days stay."""
    j = series.join(broadcast_if_small(dummies), "date", "left")
    return j.where((F.col(flag) != 1) | F.col(flag).isNull()).drop(flag)


def label_stations(df: DataFrame, names: DataFrame, code: str = "station") -> DataFrame:
    """Station name, or a label made of the code."""
    j = df.join(broadcast_if_small(names.select(code, F.col("name").alias("_name"))), code, "left")
    return j.withColumn("station_label", F.coalesce("_name", F.concat(F.lit("Station "), F.col(code)))).drop("_name")


def hour_clock(df: DataFrame) -> DataFrame:
    """Timestamp from date and hour."""
    return df.withColumn("datetime", add_hours(F.col("date").cast("timestamp_ntz"), F.col("hour")))
