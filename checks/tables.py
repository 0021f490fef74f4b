"""Domain tables derived from the driver tables, once in Spark and once in SQL.

Every adapter reads its whole source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.functions.times import floor_hour
from airgrid.operators.reshape import calendar
from airgrid.operators.spatial import pairs_within
from airgrid.plans.panel import widen

PARAMS = {"pm10": ["view", "click"], "pm25": ["purchase", "signup"], "ozone": ["error"]}
N_STATIONS = 25


_OPENED: dict = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Driver table; the handle is kept, so footers are read once per session."""
    key = (spark.sparkContext.applicationId, id(spark), folder, name)
    if key not in _OPENED:
        _OPENED[key] = spark.read.parquet(f"{folder}/{name}.parquet")
    return _OPENED[key]


def rnd(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column half away from zero, as the SQL twins do."""
    k = float(10**digits)
    half_up = lambda c: F.floor(F.abs(F.col(c)) * k + 0.5) / k
    return df.select(*[(F.signum(c) * half_up(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def readings(spark, folder) -> DataFrame:
    e = table(spark, folder, "events")
    station = F.concat(F.lit("ST"), F.lpad((F.col("user_id") % N_STATIONS).cast("string"), 2, "0"))
    return e.select("event_id", station.alias("station"), floor_hour("ts").alias("datetime"),
                    F.col("event_type").alias("param"), "value")


def panel(spark, folder) -> DataFrame:
    """Hourly panel; the odd divisor keeps means away from rounding ties."""
    p = widen(readings(spark, folder), PARAMS)
    return p.withColumns({c: F.col(c) / 0.9973 for c in PARAMS})


def stations(spark, folder) -> DataFrame:
    """One station per nation, placed at the mean of its share of the vectors."""
    v = table(spark, folder, "embeddings").groupBy((F.col("vec_id") % N_STATIONS).cast("int").alias("n_nationkey")).agg(
        F.avg(F.col("embedding")[0].cast("double")).alias("x"), F.avg(F.col("embedding")[1].cast("double")).alias("y")
    )
    n = table(spark, folder, "nation").join(v, "n_nationkey")
    return n.select(
        F.concat(F.lit("ST"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("station_id"),
        F.col("n_name").alias("name"), (F.col("x") - 74).alias("lon"), (F.col("y") + 4.6).alias("lat"),
    )


def units(spark, folder) -> DataFrame:
    v = table(spark, folder, "embeddings")
    return v.select(
        F.concat(F.lit("G"), F.lpad(F.col("vec_id").cast("string"), 6, "0")).alias("geo_id"),
        (F.col("embedding")[2].cast("double") * 0.3 - 74).alias("lon"),
        (F.col("embedding")[3].cast("double") * 0.3 + 4.6).alias("lat"), "label",
    )


def unit_distances(spark, folder, radius=10.0) -> DataFrame:
    return pairs_within(units(spark, folder), stations(spark, folder), "geo_id", "station_id", radius)


def station_distances(spark, folder, radius=30.0) -> DataFrame:
    s = stations(spark, folder)
    return pairs_within(s, s, "station_id", "station_id", radius).select(
        F.col("station_id").alias("station_from"), F.col("station_id_to").alias("station_to"), "distance_km")


def many_stations(spark, folder, n=200) -> tuple[DataFrame, DataFrame]:
    """``n`` stations far apart and their hourly panel: readings by user, places from the vectors, spread over degrees."""
    v = table(spark, folder, "embeddings").groupBy((F.col("vec_id") % n).alias("_k")).agg(
        F.avg(F.col("embedding")[4].cast("double")).alias("x"), F.avg(F.col("embedding")[5].cast("double")).alias("y"))
    name = lambda k: F.concat(F.lit("W"), F.lpad(k.cast("string"), 3, "0"))
    places = v.select(name(F.col("_k")).alias("station_id"), (F.col("x") * 40 - 74).alias("lon"), (F.col("y") * 40 + 4.6).alias("lat"))
    e = table(spark, folder, "events")
    rows = e.select(name(F.col("user_id") % n).alias("station"), floor_hour("ts").alias("datetime"), F.col("event_type").alias("param"), "value")
    wide = widen(rows, PARAMS)
    return places, wide.withColumns({c: F.col(c) / 0.9973 for c in PARAMS})


def people(spark, folder) -> DataFrame:
    """One person per order; schooling is unknown for some, units follow the customer."""
    n_units = table(spark, folder, "embeddings").agg(F.count(F.lit(1)).alias("n")).scalar()
    o = table(spark, folder, "orders").withColumn("_n", n_units)
    k = F.col("o_orderkey")
    return o.select(
        k.alias("row_key"),
        F.concat(F.lit("G"), F.lpad((F.col("o_custkey") % F.col("_n")).cast("string"), 6, "0")).alias("geo_id"),
        F.when(k % 11 != 0, (k % 24).cast("double")).alias("educ_years"),
        F.col("o_totalprice").alias("income"),
        (k % 7 + 1).cast("double").alias("person_weight"),
        (F.col("o_custkey") % 90).cast("double").alias("age"),
        F.when(F.col("o_orderstatus") == "F", 2).otherwise(1).alias("sex"),
        F.col("o_orderpriority").alias("job"),
    ).withColumn("adult", F.coalesce((F.col("age") >= 25).cast("int"), F.lit(0)))


def long_panel(spark, folder) -> DataFrame:
    """Several years of sparse hours from the orders; pm25 is missing for one order state."""
    o = table(spark, folder, "orders")
    station = F.concat(F.lit("ST"), F.lpad((F.col("o_custkey") % N_STATIONS).cast("string"), 2, "0"))
    ts = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"))
    value = F.col("o_totalprice") / 8191
    wide = o.groupBy(station.alias("station"), ts.alias("datetime")).agg(
        F.avg(F.when(F.col("o_orderstatus") != "F", value)).alias("pm10"),
        F.avg(F.when(F.col("o_orderstatus") != "P", value / 2)).alias("pm25"))
    return wide.withColumn("year", F.year("datetime"))


def cells(spark, folder) -> DataFrame:
    """Satellite-like cells: one cell per nation, hourly statistics of the event values as masses."""
    e = table(spark, folder, "events")
    v = F.col("value") / 9.973e9
    return e.groupBy((F.col("user_id") % N_STATIONS).alias("cell_id"), F.to_date("ts").alias("date"), F.hour("ts").alias("hour")).agg(
        F.avg(v).alias("DUSMASS25"), F.min(v).alias("OCSMASS"), F.max(v).alias("BCSMASS"),
        F.avg(F.when(F.col("event_type") != "view", v)).alias("SSSMASS25"), F.avg(F.when(F.col("event_type") != "error", v)).alias("SO4SMASS"))


def coverage(spark, folder) -> DataFrame:
    """Region weights of the cells: share of a nation's customers in its region."""
    c = table(spark, folder, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    n = table(spark, folder, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"))
    return n.join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("region"), F.col("n_nationkey").cast("long").alias("cell_id"), F.col("n").cast("double").alias("coverage"))


# ---- the same tables in SQL -------------------------------------------------------------------

HAVERSINE = ("2.0*{r}*asin(sqrt(least(1.0, pow(sin(radians({b}.lat-{a}.lat)/2),2)"
             "+cos(radians({a}.lat))*cos(radians({b}.lat))*pow(sin(radians({b}.lon-{a}.lon)/2),2))))")


def hav(a: str, b: str, r: float = 6378.137) -> str:
    return HAVERSINE.format(a=a, b=b, r=r)


SQL = {
    "readings": """SELECT event_id, 'ST' || lpad(CAST(user_id % 25 AS VARCHAR), 2, '0') AS station,
        date_trunc('hour', ts) AS datetime, event_type AS param, value FROM events""",
    "panel": """SELECT station, datetime, CAST(year(datetime) AS INTEGER) AS year,
        avg(CASE WHEN param IN ('view','click') THEN value END) / 0.9973 AS pm10,
        avg(CASE WHEN param IN ('purchase','signup') THEN value END) / 0.9973 AS pm25,
        avg(CASE WHEN param = 'error' THEN value END) / 0.9973 AS ozone FROM readings GROUP BY station, datetime""",
    "stations": """SELECT 'ST' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS station_id, n_name AS name,
        x - 74 AS lon, y + 4.6 AS lat FROM nation JOIN (SELECT vec_id % 25 AS k, avg(CAST(embedding[1] AS DOUBLE)) AS x,
        avg(CAST(embedding[2] AS DOUBLE)) AS y FROM embeddings GROUP BY 1) ON k = n_nationkey""",
    "units": """SELECT 'G' || lpad(CAST(vec_id AS VARCHAR), 6, '0') AS geo_id, CAST(embedding[3] AS DOUBLE) * 0.3 - 74 AS lon,
        CAST(embedding[4] AS DOUBLE) * 0.3 + 4.6 AS lat, label FROM embeddings""",
    "unit_distances": f"""SELECT geo_id, station_id, {hav('u', 's')} AS distance_km FROM units u, stations s
        WHERE {hav('u', 's')} <= 10""",
    "station_distances": f"""SELECT a.station_id AS station_from, b.station_id AS station_to, {hav('a', 'b')} AS distance_km
        FROM stations a, stations b WHERE {hav('a', 'b')} <= 30""",
    "station_pairs": f"""SELECT a.station_id AS station_from, b.station_id AS station_to, {hav('a', 'b')} AS distance_km
        FROM stations a, stations b""",
    "many_stations": """SELECT 'W' || lpad(CAST(vec_id % 200 AS VARCHAR), 3, '0') AS station_id, avg(CAST(embedding[5] AS DOUBLE)) * 40 - 74 AS lon,
        avg(CAST(embedding[6] AS DOUBLE)) * 40 + 4.6 AS lat FROM embeddings GROUP BY 1""",
    "many_pairs": f"""SELECT a.station_id AS station_from, b.station_id AS station_to, {hav('a', 'b')} AS distance_km
        FROM many_stations a, many_stations b""",
    "many_readings": """SELECT 'W' || lpad(CAST(user_id % 200 AS VARCHAR), 3, '0') AS station, date_trunc('hour', ts) AS datetime, event_type AS param, value FROM events""",
    "many_panel": """SELECT station, datetime, CAST(year(datetime) AS INTEGER) AS year, avg(CASE WHEN param IN ('view','click') THEN value END) / 0.9973 AS pm10,
        avg(CASE WHEN param IN ('purchase','signup') THEN value END) / 0.9973 AS pm25 FROM many_readings GROUP BY station, datetime""",
    "people": """SELECT *, CASE WHEN age >= 25 THEN 1 ELSE 0 END AS adult FROM (SELECT o_orderkey AS row_key,
        'G' || lpad(CAST(o_custkey % (SELECT count(*) FROM embeddings) AS VARCHAR), 6, '0') AS geo_id,
        CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 24 AS DOUBLE) END AS educ_years, o_totalprice AS income,
        CAST(o_orderkey % 7 + 1 AS DOUBLE) AS person_weight, CAST(o_custkey % 90 AS DOUBLE) AS age,
        CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS sex, o_orderpriority AS job FROM orders)""",
    "long_panel": """SELECT 'ST' || lpad(CAST(o_custkey % 25 AS VARCHAR), 2, '0') AS station,
        o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS datetime,
        CAST(year(o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER))) AS INTEGER) AS year,
        avg(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice / 8191 END) AS pm10,
        avg(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 8191 / 2 END) AS pm25 FROM orders GROUP BY 1, 2, 3""",
    "cells": """SELECT user_id % 25 AS cell_id, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour,
        avg(value / 9.973e9) AS DUSMASS25, min(value / 9.973e9) AS OCSMASS, max(value / 9.973e9) AS BCSMASS,
        avg(CASE WHEN event_type <> 'view' THEN value / 9.973e9 END) AS SSSMASS25,
        avg(CASE WHEN event_type <> 'error' THEN value / 9.973e9 END) AS SO4SMASS FROM events GROUP BY 1, 2, 3""",
    "coverage": """SELECT r_name AS region, CAST(n_nationkey AS BIGINT) AS cell_id, CAST(n AS DOUBLE) AS coverage
        FROM nation JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = n_nationkey
        JOIN region ON r_regionkey = n_regionkey""",
    "weights": """SELECT geo_id, station_id, 1.0 / distance_km AS inv_d FROM unit_distances
        WHERE distance_km > 0 AND distance_km <= {buffer}""",
}
NEEDS = {
    "panel": ["readings"], "unit_distances": ["units", "stations"], "station_distances": ["stations"],
    "weights": ["unit_distances"], "station_pairs": ["stations"], "many_pairs": ["many_stations"], "many_panel": ["many_readings"],
}


def ctes(*names: str, buffer: float = 5) -> str:
    """WITH list of the named tables and what they need, in order."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in NEEDS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ", ".join(f"{n} AS ({SQL[n].replace('{buffer}', str(buffer))})" for n in order)
