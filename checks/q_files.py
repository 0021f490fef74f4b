"""Queries: files written from the driver tables into the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.plans import ingest as ig
from airgrid.session import shared_folder
from airgrid.sources import readers as rd
from airgrid.sources import sinks as sk
from checks import tables as t
from checks.registry import query


def scratch(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def bare(df: DataFrame) -> DataFrame:
    """The names that ``write_lines`` was given."""
    return df.withColumn("file", F.replace("file", F.lit("file="), F.lit("")))


def write_lines(lines: DataFrame, path: str) -> str:
    """One folder per value of ``file`` with its lines in the order of ``ord``."""
    placed = lines.repartition("file").sortWithinPartitions("file", "ord").select("file", "value")
    placed.write.partitionBy("file").text(path)
    return path


@query("A12_partitioned_sink", t.ctes("long_panel") + " SELECT station, datetime, year, round(pm10, 6) AS pm10, round(pm25, 6) AS pm25 FROM long_panel")
def _(s, d):
    root = scratch(s)
    sk.write_panel(t.long_panel(s, d), root, files_per_year=2)
    return t.rnd(rd.read_panel(s, root, columns=["station", "datetime", "year", "pm10", "pm25"]))


@query("A1_partition_scan", t.ctes("long_panel") + " SELECT station, datetime, year, round(pm10, 6) AS pm10 FROM long_panel WHERE year IN (1996, 1998)")
def _(s, d):
    root = scratch(s)
    sk.write_panel(t.long_panel(s, d), root)
    return t.rnd(rd.read_panel(s, root, [1996, 1998], ["station", "datetime", "year", "pm10"]))


@query("A1_leaf_scan", t.ctes("long_panel") + " SELECT station, datetime, year, round(pm25, 6) AS pm25 FROM long_panel WHERE year = 1999")
def _(s, d):
    root = scratch(s)
    sk.write_panel(t.long_panel(s, d), root)
    return t.rnd(rd.read_panel(s, root, columns=["station", "datetime", "year", "pm25"], leaf=f"{root}/year=1999"))


@query("A3_text_csv", "SELECT CAST(c_custkey AS VARCHAR) AS C_CUSTKEY, CASE WHEN c_nationkey <> 3 THEN c_mktsegment END AS C_MKTSEGMENT, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS C_NAME FROM customer")
def _(s, d):
    root = scratch(s)
    c = t.table(s, d, "customer")
    c.select(F.col("c_custkey").cast("string").alias(" c_custkey "), F.when(F.col("c_nationkey") == 3, "NA").otherwise(F.concat(F.lit("  "), F.col("c_mktsegment"))).alias("c_mktsegment"),
             F.when(F.col("c_custkey") % 4 == 0, "NA").otherwise(F.col("c_name")).alias("c_name")).write.csv(root, header=True, ignoreLeadingWhiteSpace=False)
    return rd.read_text_csv(s, root, nulls=("", " ", "NA"))


@query("A4_sentinel_csv", "SELECT CAST(o_orderkey AS DOUBLE) AS k, CASE WHEN o_custkey % 100 <> 99 THEN CAST(o_custkey % 100 AS DOUBLE) END AS v FROM orders WHERE o_orderkey NOT IN (99, 999) UNION ALL SELECT NULL, CASE WHEN o_custkey % 100 <> 99 THEN CAST(o_custkey % 100 AS DOUBLE) END FROM orders WHERE o_orderkey IN (99, 999)")
def _(s, d):
    root = scratch(s)
    o = t.table(s, d, "orders")
    o.select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 100).alias("v"), "o_orderpriority").write.csv(root, header=True, sep=";")
    return rd.read_numeric_csv(s, root, ["k", "v"])


@query("A5_latin1_cleanup", "SELECT CAST(n_nationkey AS VARCHAR) AS k, CASE n_regionkey WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 'Perú ' || n_name ELSE n_name END AS name FROM nation")
def _(s, d):
    root = scratch(s)
    n = t.table(s, d, "nation")
    r = F.col("n_regionkey")
    name = F.when(r == 0, " - -").when(r == 1, F.lit(" ")).when(r == 2, F.concat(F.lit("Perú "), F.col("n_name"))).otherwise(F.concat(F.lit(" "), F.col("n_name"), F.lit(" ")))
    n.select(F.col("n_nationkey").cast("string").alias("k"), name.alias("name")).write.csv(root, header=True, encoding="ISO-8859-1", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return rd.clean_text_columns(s.read.csv(root, header=True, encoding="ISO-8859-1"))


@query("A6_preamble_csv", "SELECT CAST(ts AS DATE) AS day, round(avg(value), 6) AS v, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    root = scratch(s)
    e = t.table(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("n"))
    body = e.select(F.lit("series").alias("file"), (F.lit(100) + F.unix_date("day")).alias("ord"), F.concat_ws(",", F.col("day").cast("string"), F.round("v", 6).cast("string"), F.col("n").cast("string")).alias("value"))
    head = s.range(14).select(F.lit("series").alias("file"), F.col("id").cast("int").alias("ord"), F.when(F.col("id") == 13, "day,v,n").otherwise("# note").alias("value"))
    return rd.read_after_preamble(s, write_lines(head.unionByName(body), root) + "/*/", 13, "day date, v double, n bigint")


def broken_series(s, d) -> tuple[str, str]:
    """Preamble, header, one line for each event, and a line that is no row for every tenth user."""
    e = t.table(s, d, "events").select(F.concat(F.lit("part"), (F.col("user_id") % 3).cast("string")).alias("file"), (F.col("event_id") + 100).alias("ord"), F.when(F.col("user_id") % 10 == 0, F.concat(F.lit("lost,"), F.col("event_id").cast("string"))).otherwise(
        F.concat_ws(",", F.to_date("ts").cast("string"), F.format_string("%.2f", "value"), F.col("event_id").cast("string"))).alias("value"))
    head = s.range(42).select(F.concat(F.lit("part"), (F.col("id") % 3).cast("string")).alias("file"), F.floor(F.col("id") / 3).alias("ord"), F.when(F.col("id") >= 39, "day,v,n").otherwise("# note").alias("value"))
    return write_lines(head.unionByName(e), scratch(s)) + "/*/", "day date, v double, n bigint"


@query("A6_rows_and_rejects", """SELECT 'part' || (user_id % 3) AS file, count(*) FILTER (user_id % 10 <> 0) AS n_rows, count(*) FILTER (user_id % 10 = 0) AS n_rejects FROM events GROUP BY 1""")
def _(s, d):
    path, schema = broken_series(s, d)
    lost = bare(rd.preamble_rejects(s, path, 13, schema, level=-2)).groupBy("file").agg(F.count("reason").alias("n_rejects"))
    good = rd.read_after_preamble(s, path, 13, schema).join(t.table(s, d, "events").select(F.col("event_id").alias("n"), "user_id"), "n")
    return good.groupBy(F.concat(F.lit("part"), (F.col("user_id") % 3).cast("string")).alias("file")).agg(F.count(F.lit(1)).alias("n_rows")).join(lost, "file")


@query("A7_marker_rejects", """SELECT 'REGION__ST' || lpad(CAST(user_id % 25 AS VARCHAR), 2, '0') AS file, count(*) FILTER (event_type IN ('view', 'click')) AS n_rows, CASE event_type WHEN 'purchase' THEN 'unreadable value' WHEN 'signup' THEN 'unreadable time' WHEN 'error' THEN 'no value' END AS reason, count(*) AS n
 FROM events GROUP BY 1, 3""")
def _(s, d):
    e = t.table(s, d, "events").withColumn("file", F.concat(F.lit("REGION__ST"), F.lpad((F.col("user_id") % 25).cast("string"), 2, "0")))
    kind = F.col("event_type")
    day = F.when(kind == "signup", "999999").otherwise(F.date_format("ts", "yyMMdd"))
    cell = F.when(kind == "purchase", "n/a").when(kind == "error", "").otherwise(F.format_string("%.2f", "value"))
    body = e.select("file", (F.col("event_id") + 10).alias("ord"), F.concat_ws(",", day, F.date_format("ts", "HH00"), cell, F.lit("")).alias("value"))
    marks = e.select("file").distinct().select("file", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("ord"), F.lit("#DATA").alias("value")), F.struct(F.lit(1 << 60).alias("ord"), F.lit("EOF").alias("value")))).alias("m")).select("file", "m.*")
    path = write_lines(body.unionByName(marks), scratch(s)) + "/*/"
    good = bare(rd.read_marker_files(s, path, level=-2)).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    lost = bare(rd.marker_rejects(s, path, level=-2)).groupBy("file", "reason").agg(F.count(F.lit(1)).alias("n"))
    both = good.withColumn("reason", F.lit(None).cast("string")).unionByName(lost)
    return both.select("file", F.when(F.col("reason").isNull(), F.col("n")).otherwise(F.lit(0).cast("long")).alias("n_rows"), "reason", "n")


@query("A10_many_files", "SELECT s_suppkey AS k, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def _(s, d):
    root = scratch(s)
    t.table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance")).write.parquet(root + "/a")
    t.table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")).write.parquet(root + "/b")
    return rd.read_many(s, root, "*.parquet").select("k", "balance", "segment")


@query("A11_file_name_as_data", "SELECT event_type AS param, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def _(s, d):
    root = scratch(s)
    e = t.table(s, d, "events").select(F.concat(F.lit("net__x__"), "event_type", F.lit("__"), F.date_format("ts", "yyyyMMdd")).alias("file"), F.col("event_id").alias("ord"), F.col("value").cast("string").alias("value"))
    lines = rd.read_lines(s, write_lines(e, root) + "/*/", level=-2)
    return lines.groupBy(rd.file_part("file", "__", 2).alias("param"), rd.file_date("file").alias("day")).agg(F.count(F.lit(1)).alias("n"))


HOURLY = """WITH r AS (SELECT user_id % 25 AS k, date_trunc('hour', ts) AS datetime, event_type, max(value) AS value FROM events GROUP BY 1, 2, 3)"""


def hourly(s, d) -> DataFrame:
    r = t.readings(s, d)
    return r.groupBy("station", "datetime", "param").agg(F.max("value").alias("value"))


def marker_files(s, d) -> str:
    """One file per station and parameter, values in one of three columns."""
    h = hourly(s, d).withColumn("file", F.concat(F.lit("REGION__"), "station", F.lit("__"), F.when(F.col("param") == "view", "PM10").when(F.col("param") == "click", "PM25").otherwise(F.upper("param"))))
    v = F.format_string("%.2f", "value")
    slot = F.pmod(F.hour("datetime"), F.lit(3))
    line = F.concat_ws(",", F.date_format("datetime", "yyMMdd"), F.date_format("datetime", "HHmm").cast("int").cast("string"),
                       F.when(slot == 0, v).otherwise(""), F.when(slot == 1, v).otherwise(""), F.when(slot == 2, v).otherwise(""))
    body = h.select("file", F.unix_seconds(F.col("datetime").cast("timestamp")).alias("ord"), line.alias("value"))
    files = h.select("file").distinct()
    marks = files.withColumn("m", F.explode(F.array(*[F.struct(F.lit(o).cast("long").alias("ord"), F.lit(x).alias("value")) for o, x in ((0, "header, anything"), (1, "#DATA"), (99999999999, "EOF"), (99999999999 + 1, "240101,0100,9.99,,"))])))
    return write_lines(body.unionByName(marks.select("file", "m.ord", "m.value")), scratch(s)) + "/*/"


@query("A7_marker_files", HOURLY + """ SELECT 'ST' || lpad(CAST(k AS VARCHAR), 2, '0') AS station, datetime, round(sum(value), 2) AS total, count(*) AS n FROM r GROUP BY 1, 2""")
def _(s, d):
    rows = rd.read_marker_files(s, marker_files(s, d), level=-2)
    return rows.groupBy(rd.file_part("file", "__", 1).alias("station"), "datetime").agg(F.round(F.sum("value"), 2).alias("total"), F.count(F.lit(1)).alias("n"))


SANTIAGO_SQL = """ SELECT 'ST' || lpad(CAST(k AS VARCHAR), 2, '0') AS station, datetime, CAST(year(datetime) AS INTEGER) AS year, avg(CASE WHEN event_type = 'view' THEN value END) AS pm10,
 avg(CASE WHEN event_type = 'click' THEN value END) AS pm25 FROM r WHERE event_type IN ('view', 'click') GROUP BY 1, 2"""


@query("K2_ingest_santiago", HOURLY + SANTIAGO_SQL)
def _(s, d):
    reg = t.stations(s, d).select(F.col("station_id").alias("station"))
    long = ig.read_santiago(s, marker_files(s, d), reg, level=-2)
    return ig.ingest_panel(long, ig.CityConfig("santiago", [2024], ["pm10", "pm25"]))


@query("K2_ingest_sao_paulo", HOURLY + """, g AS (SELECT datetime + INTERVAL 1 HOUR AS datetime, k, event_type, value FROM r) SELECT 'ST' || lpad(CAST(k AS VARCHAR), 2, '0') AS station, datetime, CAST(year(datetime) AS INTEGER) AS year,
 avg(CASE WHEN event_type = 'view' THEN value END) AS pm10, avg(CASE WHEN event_type = 'click' THEN value END) AS pm25, avg(CASE WHEN event_type = 'purchase' THEN value END) AS ozone, avg(CASE WHEN event_type = 'signup' THEN value END) AS no2, avg(CASE WHEN event_type = 'error' THEN value END) AS rh FROM g GROUP BY 1, 2""")
def _(s, d):
    kinds = ["view", "click", "purchase", "signup", "error"]
    wide = hourly(s, d).groupBy("station", "datetime").agg(*[F.max(F.when(F.col("param") == k, F.col("value"))).alias(k) for k in kinds])
    num = lambda c: F.coalesce(F.replace(F.format_string("%.2f", c), F.lit("."), F.lit(",")), F.lit(""))
    text = lambda c: F.when(F.col(c).isNotNull(), num(c)).otherwise("")
    clock = F.concat(F.lpad((F.hour("datetime") + 1).cast("string"), 2, "0"), F.lit(":00"))
    body = wide.select(F.concat(F.lit("f_"), "station").alias("file"), (F.lit(100) + F.unix_seconds(F.col("datetime").cast("timestamp"))).alias("ord"),
                       F.concat_ws(";", F.date_format("datetime", "dd/MM/yyyy"), clock, *map(text, kinds)).alias("value"))
    heads = wide.select("station").distinct().withColumn("m", F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("ord"), F.concat(F.lit("Codigo da estacao: "), F.substring("station", 3, 2)).alias("value")),
        F.struct(F.lit(1).cast("long").alias("ord"), F.concat(F.lit("Nome da estacao: "), F.initcap("station")).alias("value")),
        F.struct(F.lit(2).cast("long").alias("ord"), F.lit("Data;Hora;Media;Media;Media;Media;Media").alias("value")),
        F.struct(F.lit(3).cast("long").alias("ord"), F.lit(";;MP10 (ug/m3);MP2.5 (ug/m3);O3 (ug/m3);NO2 (ug/m3);UR (%)").alias("value")))))
    path = write_lines(body.unionByName(heads.select(F.concat(F.lit("f_"), "station").alias("file"), "m.ord", "m.value")), scratch(s)) + "/*/"
    reg = t.stations(s, d).select(F.col("station_id").alias("station"))
    return ig.ingest_panel(ig.read_sao_paulo(s, path, reg, level=-2), ig.CityConfig("sao_paulo", [2024], ["pm10", "pm25", "ozone", "no2", "rh"]))


#: What each kind of event is called in the name of its wide file; one is only to be guessed.
WIDE_NAMES = {"view": "a__b__c__PM10", "click": "a__b__c__PM2.5", "purchase": "datos_ozono_2024", "signup": "a__b__c__NO2", "error": "a__b__c__RH"}


def wide_files(s, d) -> str:
    """One file per kind of event with a column for every station."""
    names = [f"ST{i:02d}" for i in range(t.N_STATIONS)]
    called = F.create_map(*[F.lit(x) for kv in WIDE_NAMES.items() for x in kv])
    h = hourly(s, d).withColumn("file", called[F.col("param")])
    w = h.groupBy("file", "datetime").agg(*[F.max(F.when(F.col("station") == n, F.col("value"))).alias(n) for n in names])
    cell = [F.when(F.col(n).isNotNull(), F.format_string("%.2f", n)).otherwise("-") for n in names]
    body = w.select("file", (F.lit(10) + F.unix_seconds(F.col("datetime").cast("timestamp"))).alias("ord"), F.concat_ws(",", F.date_format("datetime", "yyyy-MM-dd"), F.date_format("datetime", "HH:mm"), *cell).alias("value"))
    head = h.select("file").distinct().withColumn("ord", F.lit(0).cast("long")).withColumn("value", F.lit("Fecha,Hora," + ",".join(f'"C{n[2:]} : {n}"' for n in names)))
    return write_lines(head.unionByName(body), scratch(s)) + "/*/"


WIDE_PARAM = "CASE event_type WHEN 'view' THEN 'PM10' WHEN 'click' THEN 'PM2.5' WHEN 'signup' THEN 'NO2' WHEN 'error' THEN 'RH' ELSE 'unknown' END"


@query("A9_wide_station_csv", HOURLY + f""", h AS (SELECT DISTINCT event_type, datetime FROM r), st AS (SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS k FROM nation)
 SELECT 'ST' || lpad(CAST(st.k AS VARCHAR), 2, '0') AS station, 'C' || lpad(CAST(st.k AS VARCHAR), 2, '0') AS station_code, h.datetime, {WIDE_PARAM.replace('event_type', 'h.event_type')} AS param, r.value
 FROM h CROSS JOIN st LEFT JOIN r ON r.k = st.k AND r.datetime = h.datetime AND r.event_type = h.event_type""")
def _(s, d):
    rows = rd.read_wide_stations(s, wide_files(s, d), level=-2)
    return rows.select("station", "station_code", "datetime", "param", "value")


@query("A9_wide_rejects", """SELECT 'f' || (user_id % 4) AS file, CASE WHEN user_id % 4 = 3 THEN 'no header' WHEN event_type = 'error' THEN 'unreadable time' WHEN event_type = 'click' THEN 'unreadable value' END AS reason,
 CASE WHEN user_id % 4 <> 3 THEN 'C01 : one' END AS cell, count(*) AS n FROM events GROUP BY 1, 2, 3""")
def _(s, d):
    e = t.table(s, d, "events").withColumn("file", F.concat(F.lit("f"), (F.col("user_id") % 4).cast("string")))
    kind = F.col("event_type")
    body = e.select("file", (F.col("event_id") + 10).alias("ord"), F.concat_ws(",", F.when(kind == "error", "soon").otherwise(F.date_format("ts", "yyyy-MM-dd")), F.date_format("ts", "HH:mm"), F.when(kind == "click", "n/a").otherwise(F.format_string("%.2f", "value"))).alias("value"))
    head = e.select("file").distinct().where("file <> 'f3'").select("file", F.lit(0).cast("long").alias("ord"), F.lit('Fecha,Hora,"C01 : one"').alias("value"))
    path = write_lines(head.unionByName(body), scratch(s)) + "/*/"
    lost = bare(rd.wide_station_rejects(s, path, level=-2)).groupBy("file", "reason", "cell").agg(F.count(F.lit(1)).alias("n"))
    good = bare(rd.read_wide_stations(s, path, level=-2)).where("value is not null").groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    good = good.select("file", F.lit(None).cast("string").alias("reason"), F.lit("C01 : one").alias("cell"), "n")
    return good.unionByName(lost)


@query("K2_ingest_mexico", HOURLY + """, st AS (SELECT DISTINCT 'ST' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS station, 'C' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS station_code, CAST(n_nationkey AS BIGINT) AS k FROM nation),
 hrs AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-12-31 23:00:00', INTERVAL 1 HOUR)) AS datetime)
 SELECT st.station, station_code, hrs.datetime, CAST(2024 AS INTEGER) AS year, avg(CASE WHEN event_type = 'view' THEN value END) AS pm10, avg(CASE WHEN event_type = 'click' THEN value END) AS pm25, avg(CASE WHEN event_type = 'purchase' THEN value END) AS ozone,
  avg(CASE WHEN event_type = 'signup' THEN value END) AS no2, avg(CASE WHEN event_type = 'error' THEN value END) AS rh FROM st CROSS JOIN hrs LEFT JOIN r ON r.k = st.k AND r.datetime = hrs.datetime GROUP BY 1, 2, 3""")
def _(s, d):
    long = ig.read_mexico(s, wide_files(s, d), level=-2)
    return ig.ingest_panel(long, ig.CityConfig("cdmx", [2024], ["pm10", "pm25", "ozone", "no2", "rh"], dense=True))


@query("M5_registered_city", HOURLY + """ SELECT CASE k WHEN 4 THEN 'FOUR' ELSE 'ST' || lpad(CAST(k AS VARCHAR), 2, '0') END AS station, datetime, CAST(year(datetime) AS INTEGER) AS year, avg(CASE WHEN event_type = 'view' THEN value END) AS pm10, avg(CASE WHEN event_type = 'click' THEN value END) AS pm25
 FROM r GROUP BY 1, 2""")
def _(s, d):
    names = {"view": "pm10", "click": "pm25"}
    read = lambda spark, folder: hourly(spark, folder).withColumn("param", F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("param")], "param"))
    ig.register_city(ig.CityConfig("demo", [2024], ["pm10", "pm25"], read=read, harmonise=lambda x: ig.map_stations(x, {"ST04": "FOUR"}, [])))
    return ig.run_city(s, "demo", d)


@query("K2_ingest_bogota", HOURLY + """, p AS (SELECT k, datetime, event_type AS param, value FROM r WHERE event_type <> 'purchase' AND k <> 3), q AS (SELECT k, datetime, 'view' AS param, value FROM r WHERE event_type = 'purchase'),
 cov AS (SELECT DISTINCT k, param FROM p), m AS (SELECT p.* FROM p UNION ALL SELECT q.* FROM q WHERE NOT EXISTS (SELECT 1 FROM cov WHERE cov.k = q.k AND cov.param = q.param))
 SELECT 'ST' || lpad(CAST(k AS VARCHAR), 2, '0') AS station, datetime, CAST(year(datetime) AS INTEGER) AS year, avg(CASE WHEN param = 'view' THEN value END) AS pm10, avg(CASE WHEN param = 'click' THEN value END) AS pm25, avg(CASE WHEN param = 'signup' THEN value END) AS ozone, avg(CASE WHEN param = 'error' THEN value END) AS no2 FROM
 (SELECT * FROM m UNION ALL SELECT k, datetime, 'none', NULL FROM q WHERE EXISTS (SELECT 1 FROM cov WHERE cov.k = q.k AND cov.param = q.param) AND NOT EXISTS (SELECT 1 FROM p WHERE p.k = q.k AND p.datetime = q.datetime)) GROUP BY 1, 2""")
def _(s, d):
    h = hourly(s, d)
    stamp = F.when(F.hour("datetime") == 0, F.concat(F.date_format(F.col("datetime") - F.expr("INTERVAL 1 DAY"), "dd-MM-yyyy"), F.lit(" 24:00"))).otherwise(F.date_format("datetime", "dd-MM-yyyy HH:mm"))
    kinds = {"view": "PM10", "click": "PM2.5", "signup": "O3", "error": "NO2"}
    first = h.where("param <> 'purchase' and station <> 'ST03'").groupBy("station", stamp.alias("datetime")).agg(*[F.max(F.when(F.col("param") == k, F.col("value"))).alias(c) for k, c in kinds.items()])
    a, b = scratch(s), scratch(s)
    first.withColumn("station", F.lower("station")).write.csv(a, header=True)
    late = F.date_format(F.col("datetime") + F.expr("INTERVAL 20 MINUTES"), "yyyy-MM-dd HH:mm")
    h.where("param = 'purchase'").select(F.col("station").alias("Estacion"), late.alias("Fecha inicial"), late.alias("Fecha final"), F.col("value").alias("PM10")).write.csv(b, header=True)
    return ig.ingest_panel(ig.read_bogota_primary(s, a), ig.CityConfig("bogota", [2024], ["pm10", "pm25", "ozone", "no2"]), ig.read_bogota_secondary(s, b, "pm10"))


@query("K19_legacy_preparation", t.ctes("readings") + """, x AS (SELECT CASE station WHEN 'ST01' THEN 'ALPHA' ELSE station END AS station, datetime + INTERVAL 1 HOUR AS datetime, value FROM readings),
 k AS (SELECT station, datetime, min(value) AS value FROM x WHERE datetime >= TIMESTAMP '2024-01-03' AND datetime < TIMESTAMP '2024-01-28' GROUP BY 1, 2),
 g AS (SELECT station, unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-12-31 23:00:00', INTERVAL 1 HOUR)) AS datetime FROM (SELECT DISTINCT station FROM k))
 SELECT g.station, g.datetime, CAST(year(g.datetime) AS INTEGER) AS year, value FROM g LEFT JOIN k ON k.station = g.station AND k.datetime = g.datetime""")
def _(s, d):
    r = t.readings(s, d).select("station", F.to_date("datetime").alias("date"), (F.hour("datetime") + 1).alias("hour"), "value")
    return ig.prepare_legacy(r, {"ST01": "ALPHA"}, "2024-01-03 00:00:00", "2024-01-28 00:00:00")


@query("A13_twin_sink", "SELECT CAST(s_suppkey AS VARCHAR) AS k, s_name AS name FROM supplier UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name FROM supplier")
def _(s, d):
    root = scratch(s)
    sk.write_twin(t.table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("k"), F.col("s_name").alias("name")), root)
    return s.read.parquet(root + "_parquet").unionByName(s.read.csv(root + "_csv", header=True))


@query("A14_inferred_name", t.ctes("long_panel") + """ SELECT 'demo_' || min(year) || '_' || max(year) || '_parquet' AS name, count(*) AS n, count(*) AS n_csv, round(sum(pm10), 3) AS total_csv FROM long_panel""")
def _(s, d):
    base = sk.write_inferred(t.long_panel(s, d).withColumn("city", F.lit("demo")), scratch(s), ["parquet", "csv.gz"])
    name = base.rsplit("/", 1)[1] + "_parquet"
    text = s.read.csv(base + "_csv_gz", header=True).agg(F.count(F.lit(1)).alias("n_csv"), F.round(F.sum(F.col("pm10").cast("double")), 3).alias("total_csv"))
    return s.read.parquet(base + "_parquet").agg(F.count(F.lit(1)).alias("n")).withColumns({"name": F.lit(name), **{c: text.select(c).scalar() for c in text.columns}})


@query("A15_result_writer", "SELECT 'demo' AS city, 3 AS buffer_km, s_suppkey, s_name FROM supplier")
def _(s, d):
    root = scratch(s)
    sk.write_result(t.table(s, d, "supplier").select("s_suppkey", "s_name"), root, "demo", 3, 2023, {"city": "demo", "buffer_km": 3})
    return rd.read_artifact(s, root, "exposure", "demo", 3, 2023)


@query("A17_provenance_sink", "SELECT s_suppkey, s_name, 'v1' AS version, 'suppliers' AS source FROM supplier")
def _(s, d):
    root = scratch(s)
    sk.write_with_provenance(t.table(s, d, "supplier").select("s_suppkey", "s_name"), root, {"version": "v1", "source": "suppliers"})
    side = s.read.parquet(root + "_provenance")
    out = s.read.parquet(root)
    notes = out.schema["s_name"].metadata
    return out.withColumn("version", F.lit(notes["version"])).withColumn("source", side.select("source").scalar())


@query("B15_coordinate_box", t.ctes("units") + " SELECT geo_id FROM units WHERE lon BETWEEN -74.02 AND -73.99 AND lat BETWEEN 4.58 AND 4.62")
def _(s, d):
    from airgrid.functions.coords import in_box
    return t.units(s, d).where(in_box("lon", "lat", (-74.02, -73.99), (4.58, 4.62))).select("geo_id")


@query("B16_coordinate_corrections", t.ctes("stations") + " SELECT station_id, CASE station_id WHEN 'ST03' THEN -74.5 ELSE round(lon, 6) END AS lon, CASE station_id WHEN 'ST03' THEN CAST(5 AS DOUBLE) ELSE round(lat, 6) END AS lat FROM stations")
def _(s, d):
    from airgrid.functions.coords import override_point
    fix = s.createDataFrame([("ST03", -74.5, 5.0)], "station_id string, lon double, lat double")
    return t.rnd(override_point(t.stations(s, d), fix, "station_id").select("station_id", "lon", "lat"))
