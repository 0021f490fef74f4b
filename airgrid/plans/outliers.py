"""Outlier rules on the hourly panel.

All pollutants, stations and years go through one plan. Readings are laid out long and sent once to
their (pollutant, station, month) cell: as the station's own value, as the value of a nearest
neighbour of another station, and, at a month's edge, as the adjacent hour of the next cell. A cell
holds at most the hours of a month, so no window grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airgrid.functions.keys import normalize_station
from airgrid.functions.times import year_month
from airgrid.operators.reshape import dense_hours
from airgrid.operators.spatial import nearest
from airgrid.session import broadcast_if_small, reliable_checkpoint

HOUR = "INTERVAL 1 HOUR"


def eligible_neighbours(long: DataFrame, distances: DataFrame, with_data: bool = True) -> DataFrame:
    """Nearest two stations of each station with readings, per pollutant and year.

    ``with_data`` ranks only neighbours that report the pollutant in that year.
    """
    present = long.where(F.col("value").isNotNull()).select("pollutant", "year", "station").distinct()
    pairs = distances.where(F.col("distance_km") > 0)
    origin = present.withColumnRenamed("station", "station_from")
    cand = origin.join(pairs, "station_from")
    if with_data:
        cand = cand.join(present.withColumnRenamed("station", "station_to"), ["pollutant", "year", "station_to"], "left_semi")
    w = Window.partitionBy("pollutant", "year", "station_from").orderBy("distance_km", "station_to")
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 2).select(
        "pollutant", "year", "station_from", "station_to", "rank"
    )


def reporting_neighbours(long: DataFrame, points: DataFrame, with_data: bool = True, start_km: float = 25.0) -> DataFrame:
    """Nearest two stations of each station with readings, per pollutant and year, over all distances.

    ``points`` is (station, lon, lat). With ``with_data`` the search itself runs over the stations that report the
    pollutant in that year, so a neighbour is found however far it is, and no table of distances is needed.
    """
    present = long.where(F.col("value").isNotNull()).select("pollutant", "year", "station").distinct()
    if with_data:
        here = reliable_checkpoint(present.join(points, "station"))
        near = nearest(here, here, "station", "station", 2, start_km, positive_only=True, by=["pollutant", "year"])
        return near.select("pollutant", "year", F.col("station").alias("station_from"), F.col("station_to"), "rank")
    near = nearest(points, points, "station", "station", 2, start_km, positive_only=True)
    near = near.select(F.col("station").alias("station_from"), "station_to", "rank")
    return present.withColumnRenamed("station", "station_from").join(near, "station_from").select("pollutant", "year", "station_from", "station_to", "rank")


def flag_long(
    panel: DataFrame,
    distances: DataFrame | None = None,
    pollutants: list[str] = ("pm10", "pm25"),
    pct_flag: float = 0.99,
    n_sd: float = 2.0,
    on_missing_temporal: str = "continue",
    on_missing_neighbor: str = "second",
    neighbor_eligibility: str = "with_data",
    stations: DataFrame | None = None,
) -> DataFrame:
    """Flags per (pollutant, station, hour) on the dense grid of each year.

    Neighbours are the nearest of ``stations`` (station_id, lon, lat), at any distance; or, where a table of
    ``distances`` (station_from, station_to, distance_km) is given instead, the nearest in it. Two raw names that
    normalise to one station are averaged first, readings and places alike.
    """
    if (distances is None) == (stations is None):
        raise ValueError("give either stations or distances")
    if on_missing_temporal not in ("continue", "finish") or on_missing_neighbor not in ("second", "finish"):
        raise ValueError("unknown missing-value option")
    if neighbor_eligibility not in ("with_data", "all"):
        raise ValueError("unknown neighbour option")
    pols = [p for p in pollutants if p in panel.columns]
    base = panel.groupBy(normalize_station("station").alias("station"), "datetime").agg(*[F.avg(p).alias(p) for p in pols])
    long = base.unpivot(["station", "datetime"], pols, "pollutant", "value").withColumn("year", F.year("datetime"))
    known = long.where(F.col("value").isNotNull())
    with_data = neighbor_eligibility == "with_data"
    if stations is not None:
        points = stations.groupBy(normalize_station("station_id").alias("station")).agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
        near = reporting_neighbours(long, points, with_data)
    else:
        pairs = distances.select(normalize_station("station_from").alias("station_from"), normalize_station("station_to").alias("station_to"), "distance_km")
        near = eligible_neighbours(long, pairs, with_data)
    if on_missing_neighbor == "finish":
        near = near.where(F.col("rank") == 1)
    present = known.select("pollutant", "year", F.col("station").alias("station_from")).distinct()
    roles = near.unionByName(present.withColumn("station_to", F.col("station_from")).withColumn("rank", F.lit(0)))
    sent = known.withColumnRenamed("station", "station_to").join(
        broadcast_if_small(roles), ["pollutant", "year", "station_to"]
    )
    dt = F.col("datetime")
    own_month = year_month(dt)
    edge = F.array_distinct(F.array(own_month, year_month(dt + F.expr(HOUR)), year_month(dt - F.expr(HOUR))))
    months = F.when(F.col("rank") == 0, edge).otherwise(F.array(own_month))
    sent = sent.select(
        "pollutant", F.col("station_from").alias("station"), "datetime", "rank", "value", F.explode(months).alias("ym")
    )
    grid = dense_hours(base, "station").select(
        F.explode(F.array(*[F.lit(p) for p in pols])).alias("pollutant"),
        "station",
        "datetime",
        F.lit(-1).alias("rank"),
        F.lit(None).cast("double").alias("value"),
        own_month.alias("ym"),
    )
    n = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = sent.unionByName(grid).repartition(n, "pollutant", "station", "ym")
    pick = lambda r: F.max(F.when(F.col("rank") == r, F.col("value")))
    rows = cells.groupBy("pollutant", "station", "ym", "datetime").agg(
        pick(0).alias("value"), pick(1).alias("nb1"), pick(2).alias("nb2")
    )
    cell = Window.partitionBy("pollutant", "station", "ym")
    along = cell.orderBy("datetime")
    v = F.col("value")
    inner = year_month(dt) == F.col("ym")
    shifted = lambda f, gap: F.when(f("datetime").over(along) == gap, f("value").over(along))
    rows = rows.withColumns({
        "_lag": shifted(F.lag, dt - F.expr(HOUR)),
        "_lead": shifted(F.lead, dt + F.expr(HOUR)),
        "_own": F.when(inner, v),
        "_d1": F.when(inner, v - F.col("nb1")),
        "_d2": F.when(inner, v - F.col("nb2")),
    }).withColumn("_diff", F.when(inner, v - F.col("_lag")))
    stats = {"_p": F.expr(f"percentile(_own, {float(pct_flag)})")}
    for name, c in (("t", "_diff"), ("1", "_d1"), ("2", "_d2")):
        stats["_m" + name] = F.avg(c)
        stats["_s" + name] = F.stddev_samp(c)
    rows = rows.withColumns({name: agg.over(cell) for name, agg in stats.items()})
    return _classify(rows.where(inner), cell, n_sd, on_missing_temporal)


def _band(x: str, mean: str, sd: str, n_sd: float):
    d, m, s = F.col(x), F.col(mean), F.col(sd)
    feasible = d.isNotNull() & m.isNotNull() & s.isNotNull()
    return feasible, feasible & (d > m - F.lit(n_sd) * s) & (d < m + F.lit(n_sd) * s)


def _classify(rows: DataFrame, cell, n_sd: float, on_missing_temporal: str) -> DataFrame:
    lag, lead, v = F.col("_lag"), F.col("_lead"), F.col("value")
    bench = F.coalesce((lag + lead) / 2, lag, lead)
    rows = rows.withColumns({"_flag": F.coalesce(v > F.col("_p"), F.lit(False)), "_b": v - bench})
    _, calm = _band("_b", "_mt", "_st", n_sd)
    feas1, pass1 = _band("_d1", "_m1", "_s1", n_sd)
    feas2, pass2 = _band("_d2", "_m2", "_s2", n_sd)
    kind = F.when(bench.isNull(), 3).when(calm, 1).otherwise(2)
    failed = F.when(feas1, ~pass1).otherwise(feas2 & ~pass2)
    passed = F.when(feas1, pass1).otherwise(pass2)
    rows = rows.withColumns({"_kind": kind, "_none": ~feas1 & ~feas2, "_failed": failed, "_passed": passed})
    k = F.col("_kind")
    rescued = F.col("_passed") & ((k == 2) | (k == 3) if on_missing_temporal == "continue" else k == 2)
    final = F.when(rescued, 1).otherwise(k)
    reason = (
        F.when((final == 3) & F.col("_none"), 1)
        .when((final == 2) & F.col("_none"), 2)
        .when((final == 2) & F.col("_failed"), 3)
        .when((final == 3) & F.col("_failed"), 4)
        .otherwise(0)
    )
    if on_missing_temporal == "finish":
        reason = F.when(final == 3, 1).otherwise(reason)
    missing_s = F.col("_s1").isNull() & F.col("_s2").isNull()
    zero_s = F.coalesce(F.col("_s1") == 0, F.lit(False)) | F.coalesce(F.col("_s2") == 0, F.lit(False))
    flagged = F.col("_flag")
    counts = {
        "n_missing_temporal_sd": flagged & F.col("_st").isNull(),
        "n_zero_temporal_sd": flagged & F.coalesce(F.col("_st") == 0, F.lit(False)),
        "n_missing_spatial_sd": flagged & missing_s,
        "n_zero_spatial_sd": flagged & zero_s,
    }
    code = F.when(flagged, reason).otherwise(0)
    return rows.select(
        "pollutant",
        "station",
        "datetime",
        v.alias("raw_value"),
        F.when(code == 0, v).alias("value"),
        (code > 0).cast("int").alias("outlier"),
        code.alias("outlier_reason"),
        *[F.count_if(test).over(cell).cast("int").alias(name) for name, test in counts.items()],
    )


def detect_outliers(panel: DataFrame, distances: DataFrame | None = None, pollutants: list[str] = ("pm10", "pm25"), **options) -> DataFrame:
    """Clean panel: masked pollutants with their flag, reason and four diagnostic counts."""
    long = flag_long(panel, distances, pollutants, **options)
    pols = [p for p in pollutants if p in panel.columns]
    aggs = []
    for p in pols:
        at = lambda c: F.max(F.when(F.col("pollutant") == p, F.col(c)))
        aggs.append(at("value").alias(p))
        for c in ("outlier", "outlier_reason", "n_missing_temporal_sd", "n_zero_temporal_sd",
                  "n_missing_spatial_sd", "n_zero_spatial_sd"):
            aggs.append(at(c).alias(f"{p}_{c}"))
    wide = long.groupBy("station", "datetime").agg(*aggs).withColumn("year", F.year("datetime"))
    rest = [c for c in panel.columns if c not in ("station", "datetime", "year", *pols)]
    if not rest:
        return wide
    keyed = panel.select(normalize_station("station").alias("station"), "datetime", *rest)
    other = keyed.groupBy("station", "datetime").agg(*[F.max(c).alias(c) for c in rest])
    return wide.join(other, ["station", "datetime"], "left")


def step_summary(flags: DataFrame) -> DataFrame:
    """Per pollutant: values seen, removed, share removed and counts by reason."""
    r = F.col("outlier_reason")
    n, removed = F.count("raw_value"), F.count_if(r > 0)
    return flags.groupBy("pollutant").agg(
        n.alias("n_values"),
        removed.alias("n_removed"),
        (F.lit(100.0) * removed / F.nullif(n, F.lit(0))).alias("pct_removed"),
        *[F.count_if(r == k).alias(f"n_reason_{k}") for k in (1, 2, 3, 4)],
    )


def per_station(flags: DataFrame, other: DataFrame) -> DataFrame:
    """Removed values per station under two rules."""
    count = lambda df, name: df.groupBy("station").agg(F.count_if(F.col("outlier_reason") > 0).alias(name))
    j = count(flags, "n_new").join(count(other, "n_old"), "station", "full")
    return j.na.fill(0, ["n_new", "n_old"]).withColumn("diff", F.col("n_new") - F.col("n_old"))
