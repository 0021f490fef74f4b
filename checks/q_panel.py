"""Queries: filters, joins, panel building, reshaping, clocks and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from airgrid.functions import numbers as nb
from airgrid.functions import times as tm
from airgrid.operators import ordered, reshape
from airgrid.plans import diagnostics as dg
from airgrid.plans import panel as pn
from checks import tables as t
from checks.registry import query

POLS = ["pm10", "pm25"]
PANEL = "SELECT station, datetime, year, round(pm10, 6) AS pm10, round(pm25, 6) AS pm25, round(ozone, 6) AS ozone FROM panel"
SRC = """, prim AS (SELECT * FROM readings WHERE event_id % 3 <> 0), seco AS (SELECT * FROM readings WHERE event_id % 3 = 0)"""


def two_sources(s, d):
    """Every reading, split into two sources by its id; the secondary one is made to miss some stations."""
    r = t.readings(s, d)
    return r.where("event_id % 3 <> 0"), r.where("event_id % 3 = 0")


@query("D6_wide_panel", t.ctes("panel") + " " + PANEL)
def _(s, d):
    return t.rnd(t.panel(s, d))


@query("D7_duplicate_mean", t.ctes("readings") + " SELECT station, datetime, param, round(avg(value), 6) AS value FROM readings GROUP BY 1, 2, 3")
def _(s, d):
    return t.rnd(pn.mean_duplicates(t.readings(s, d), ["station", "datetime", "param"]))


@query("F1_long_to_wide", t.ctes("readings") + " SELECT station, datetime, " + ", ".join(
    f"round(avg(CASE WHEN param = '{p}' THEN value END), 6) AS {p}" for p in ("click", "error", "purchase", "signup", "view")) + " FROM readings GROUP BY 1, 2")
def _(s, d):
    return t.rnd(pn.pivot_mean(t.readings(s, d), ["click", "error", "purchase", "signup", "view"]))


@query("D8_smallest_tag", t.ctes("readings") + " SELECT station, min(param) AS param FROM readings GROUP BY station")
def _(s, d):
    return pn.smallest_tag(t.readings(s, d), ["station"], "param")


@query("K1_precedence_merge", t.ctes("readings") + SRC + """, a AS (SELECT station, datetime, param, avg(value) AS v FROM prim WHERE station <> 'ST03' GROUP BY 1, 2, 3),
 b AS (SELECT station, datetime, param, avg(value) AS v FROM seco GROUP BY 1, 2, 3),
 cov AS (SELECT DISTINCT station, year(datetime) AS y, param FROM prim WHERE station <> 'ST03'),
 j AS (SELECT coalesce(a.station, b.station) AS station, coalesce(a.datetime, b.datetime) AS datetime, coalesce(a.param, b.param) AS param, a.v AS av, b.v AS bv
   FROM a FULL JOIN b ON a.station = b.station AND a.datetime = b.datetime AND a.param = b.param)
 SELECT j.station, j.datetime, j.param, CAST(year(j.datetime) AS INTEGER) AS year, round(CASE WHEN cov.y IS NOT NULL THEN av ELSE bv END, 6) AS value,
  CASE WHEN cov.y IS NULL THEN 'secondary' WHEN av IS NULL THEN 'primary (hour missing, not filled)' ELSE 'primary' END AS source FROM j LEFT JOIN cov ON cov.station = j.station AND cov.y = year(j.datetime) AND cov.param = j.param""")
def _(s, d):
    a, b = two_sources(s, d)
    return t.rnd(pn.precedence_merge(a.where("station <> 'ST03'"), b))


@query("D9_source_discrepancy", t.ctes("readings") + SRC + """, a AS (SELECT station, datetime, param, avg(value) AS v FROM prim GROUP BY 1, 2, 3), b AS (SELECT station, datetime, param, avg(value) AS v FROM seco GROUP BY 1, 2, 3)
 SELECT a.station, a.param, count(*) AS n_overlap, round(avg(abs(a.v - b.v)), 6) AS mean_abs_diff, round(max(abs(a.v - b.v)), 6) AS max_abs_diff FROM a JOIN b USING (station, datetime, param) GROUP BY 1, 2""")
def _(s, d):
    return t.rnd(pn.source_discrepancy(*two_sources(s, d)))


@query("D42_codes_per_name", t.ctes("readings") + " SELECT station, count(DISTINCT param) AS n_codes FROM readings GROUP BY 1 HAVING count(DISTINCT param) > 1")
def _(s, d):
    return pn.one_code_per_name(t.readings(s, d), "station", "param")


@query("D42_duplicate_keys", t.ctes("readings") + " SELECT station, datetime, param, count(*) AS n_rows FROM readings GROUP BY 1, 2, 3 HAVING count(*) > 1")
def _(s, d):
    return pn.duplicate_keys(t.readings(s, d), ["station", "datetime", "param"])


@query("D46_first_by_key", t.ctes("readings") + """ SELECT event_id, station, datetime, param, value FROM (SELECT *, row_number() OVER (PARTITION BY station, param ORDER BY datetime, event_id) AS r FROM readings) WHERE r = 1""")
def _(s, d):
    return ordered.first_by(t.readings(s, d), ["station", "param"], ["datetime", "event_id"])


@query("E9_modal_code", t.ctes("readings") + """ SELECT station, param AS code FROM (SELECT station, param, row_number() OVER (PARTITION BY station ORDER BY count(*) DESC, param) AS r FROM readings GROUP BY 1, 2) WHERE r = 1""")
def _(s, d):
    return ordered.modal_value(t.readings(s, d), "station", "param", "code")


@query("C8_coded_grid_join", t.ctes("readings") + """, ref AS (SELECT station, param AS code FROM (SELECT station, param, row_number() OVER (PARTITION BY station ORDER BY count(*) DESC, param) AS r FROM readings GROUP BY 1, 2) WHERE r = 1),
 g AS (SELECT DISTINCT station, datetime FROM readings)
 SELECT g.station, g.datetime, count(r.event_id) AS n, round(sum(r.value), 6) AS total FROM g LEFT JOIN ref ON g.station = ref.station
 LEFT JOIN readings r ON r.station = g.station AND r.datetime = g.datetime AND coalesce(ref.code, r.param) = r.param GROUP BY 1, 2""")
def _(s, d):
    r = t.readings(s, d)
    ref = ordered.modal_value(r, "station", "param", "code")
    coded = r.withColumn("code", F.col("param"))
    j = pn.attach_code(r.select("station", "datetime").distinct(), coded, ref)
    return t.rnd(j.groupBy("station", "datetime").agg(F.count("value").alias("n"), F.sum("value").alias("total")))


@query("C28_enrich_then_append", """ SELECT n_nationkey AS k, n_name AS name, c.n AS n, 'base' AS source FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) c ON c.s_nationkey = n_nationkey
 WHERE n_regionkey <> 0 UNION ALL SELECT s_nationkey, NULL, n, 'extra' FROM (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 0)""")
def _(s, d):
    base = t.table(s, d, "nation").where("n_regionkey <> 0").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    extra = t.table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return pn.merge_registries(base, extra, "k", "extra")


@query("F3_to_long_with_nulls", t.ctes("panel") + " SELECT station, datetime, 'pm10' AS param, round(pm10, 6) AS value FROM panel UNION ALL SELECT station, datetime, 'pm25', round(pm25, 6) FROM panel")
def _(s, d):
    return t.rnd(reshape.to_long(t.panel(s, d), ["station", "datetime"], POLS))


@query("F4_to_long_without_nulls", t.ctes("panel") + " SELECT station, datetime, 'pm10' AS param, round(pm10, 6) AS value FROM panel WHERE pm10 IS NOT NULL UNION ALL SELECT station, datetime, 'pm25', round(pm25, 6) FROM panel WHERE pm25 IS NOT NULL")
def _(s, d):
    return t.rnd(reshape.to_long(t.panel(s, d), ["station", "datetime"], POLS, keep_null=False))


DENSE = """, span AS (SELECT year, min(datetime) AS lo, max(datetime) AS hi FROM panel GROUP BY 1),
 grid AS (SELECT station, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS datetime FROM (SELECT DISTINCT station, year FROM panel) JOIN span USING (year))"""


@query("F5_dense_hours", t.ctes("panel") + DENSE + " SELECT station, datetime, CAST(year(datetime) AS INTEGER) AS year FROM grid")
def _(s, d):
    return reshape.dense_hours(t.panel(s, d))


@query("C7_densify", t.ctes("panel") + DENSE + " SELECT g.station, g.datetime, CAST(year(g.datetime) AS INTEGER) AS year, round(pm10, 6) AS pm10, round(pm25, 6) AS pm25, round(ozone, 6) AS ozone FROM grid g LEFT JOIN panel p ON p.station = g.station AND p.datetime = g.datetime")
def _(s, d):
    return t.rnd(reshape.densify(t.panel(s, d)))


@query("C13_missing_combinations", t.ctes("long_panel") + ", v AS (SELECT DISTINCT station, CAST(datetime AS DATE) AS day FROM long_panel) SELECT a.station, b.day FROM (SELECT DISTINCT station FROM v) a, (SELECT DISTINCT day FROM v) b EXCEPT SELECT station, day FROM v")
def _(s, d):
    return reshape.missing_combinations(t.long_panel(s, d).withColumn("day", F.to_date("datetime")), "station", "day")


@query("F6_stack", """ SELECT s_suppkey AS k, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer""")
def _(s, d):
    a = t.table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance"))
    b = t.table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return reshape.stack([a, b])


@query("F7_membership", """ SELECT coalesce(a.k, b.k) AS k, CAST(a.k IS NOT NULL AS INTEGER) AS in_old, CAST(b.k IS NOT NULL AS INTEGER) AS in_new
 FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') b ON a.k = b.k""")
def _(s, d):
    o = t.table(s, d, "orders").withColumn("k", F.col("o_custkey"))
    return reshape.membership(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"), "k")


@query("F7_set_difference", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def _(s, d):
    o = t.table(s, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return o.where("o_orderstatus = 'F'").select("k").subtract(o.where("o_orderstatus = 'P'").select("k"))


@query("F11_random_rows", "SELECT * FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42'), o_orderkey LIMIT 200")
def _(s, d):
    return reshape.random_rows(t.table(s, d, "orders"), 200, "o_orderkey", 42)


@query("F2_counts_table", t.ctes("long_panel") + """, c AS (SELECT year, count(DISTINCT station) FILTER (pm10 IS NOT NULL) AS pm10, count(DISTINCT station) FILTER (pm25 IS NOT NULL) AS pm25 FROM long_panel GROUP BY 1)
 SELECT year, pm10, pm25 FROM c""")
def _(s, d):
    long = reshape.to_long(t.long_panel(s, d), ["station", "year"], POLS, keep_null=False)
    n = long.groupBy("year", "param").agg(F.count_distinct("station").alias("n"))
    return dg.counts_table(n, ["year"], "param", POLS, "n")


@query("A2_year_pushdown", t.ctes("long_panel") + " SELECT station, datetime, round(pm10, 6) AS pm10 FROM long_panel WHERE year = 1997")
def _(s, d):
    return t.rnd(t.long_panel(s, d).where("year = 1997").select("station", "datetime", "pm10"))


@query("B7_time_range", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def _(s, d):
    return t.table(s, d, "events").where(tm.in_range("ts", "2024-01-05 00:00:00", "2024-01-12 00:00:00")).select("event_id", "ts")


@query("B9_membership_filter", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(s, d):
    keep = t.table(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.table(s, d, "orders").join(keep, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("B10_valid_groups", t.ctes("people") + " SELECT geo_id, sex AS \"group\", sum(person_weight) AS pop FROM people WHERE sex IN (1, 2) AND person_weight > 0 GROUP BY 1, 2")
def _(s, d):
    from airgrid.plans.regress import unit_groups
    return unit_groups(t.people(s, d), "sex", [1, 2])


@query("B11_adult_report", t.ctes("people") + " SELECT count(*) AS n_rows, count(*) FILTER (adult = 1) AS n_adults FROM people")
def _(s, d):
    from airgrid.plans.exposure import kept_rows
    return kept_rows(t.people(s, d))


@query("B12_sentinel_mask", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 AND c_acctbal < 9000 THEN c_acctbal END AS v FROM customer")
def _(s, d):
    return t.table(s, d, "customer").select("c_custkey", nb.mask_sentinel("c_acctbal", 0, 9000).alias("v"))


@query("B13_non_finite_mask", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN round(value / (event_id % 5), 6) END AS v FROM events")
def _(s, d):
    k = F.col("event_id") % 5
    raw = F.when(k == 0, F.when(F.col("value") > 10, F.lit(float("inf"))).otherwise(F.lit(float("nan")))).otherwise(F.col("value") / k)
    return t.rnd(t.table(s, d, "events").select("event_id", nb.finite(raw).alias("v")))


@query("B14_value_threshold", t.ctes("panel") + " SELECT station, datetime, round(pm25, 6) AS pm25 FROM panel WHERE pm25 > 50")
def _(s, d):
    return t.rnd(t.panel(s, d).where("pm25 > 50").select("station", "datetime", "pm25"))


@query("B17_exclusion", "SELECT event_id, event_type FROM events WHERE event_type <> 'error' AND user_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def _(s, d):
    from airgrid.plans.compare import exclude
    bad = t.table(s, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("user_id"))
    return exclude(t.table(s, d, "events"), ["error"], bad, "event_type").select("event_id", "event_type")


@query("B18_preferred_name", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE NOT (n_regionkey = 1 AND n_name <> 'NATION_1')")
def _(s, d):
    from airgrid.plans.compare import prefer_names
    n = t.table(s, d, "nation").withColumn("code", F.col("n_regionkey").cast("string"))
    return prefer_names(n, {"1": "NATION_1"}, "code", "n_name").drop("code")


@query("B19_rescale_if_large", "SELECT p_partkey, CASE WHEN (SELECT max(p_retailprice) FROM part) > 100 THEN p_retailprice / 1000 ELSE p_retailprice END AS p_retailprice, CASE WHEN (SELECT max(p_size) FROM part) > 100 THEN p_size / 1000.0 ELSE p_size END AS size FROM part")
def _(s, d):
    p = t.table(s, d, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("size"))
    return nb.rescale_if_large(nb.rescale_if_large(p, "p_retailprice"), "size")


@query("B20_any_present", t.ctes("panel") + " SELECT station, datetime FROM panel WHERE pm10 IS NOT NULL OR pm25 IS NOT NULL")
def _(s, d):
    return t.panel(s, d).where(nb.any_present(POLS)).select("station", "datetime")


@query("B21_active_stations", t.ctes("long_panel") + " SELECT station FROM long_panel WHERE year = 1996 GROUP BY 1 HAVING count(pm10) > 0 AND count(pm25) > 0")
def _(s, d):
    return dg.active_stations(t.long_panel(s, d).where("year = 1996"), POLS, need_all=True)


@query("C14_semi_join_stations", t.ctes("panel") + " SELECT station, count(*) AS n FROM panel WHERE station IN (SELECT station FROM panel WHERE pm10 > 200) GROUP BY 1")
def _(s, d):
    p = t.panel(s, d)
    hot = p.where("pm10 > 200").select("station").distinct()
    return p.join(hot, "station", "left_semi").groupBy("station").agg(F.count(F.lit(1)).alias("n"))


@query("C6_neighbour_hour", t.ctes("panel", "station_pairs") + """, n AS (SELECT station_from, min_by(station_to, distance_km) AS near FROM station_pairs WHERE distance_km > 0 GROUP BY 1)
 SELECT p.station, p.datetime, round(p.pm10 - q.pm10, 6) AS diff FROM panel p LEFT JOIN n ON n.station_from = p.station LEFT JOIN panel q ON q.station = near AND q.datetime = p.datetime""")
def _(s, d):
    from airgrid.operators.spatial import nearest
    p = t.panel(s, d).select("station", "datetime", "pm10")
    st = t.stations(s, d)
    near = nearest(st, st, "station_id", "station_id", 1, 25.0, positive_only=True)
    j = p.join(near.select(F.col("station_id").alias("station"), F.col("station_id_to").alias("near")), "station", "left")
    q = p.select(F.col("station").alias("near"), "datetime", F.col("pm10").alias("v"))
    return t.rnd(j.join(q, ["near", "datetime"], "left").select("station", "datetime", (F.col("pm10") - F.col("v")).alias("diff")))


# ---- clocks ------------------------------------------------------------------------------------

@query("G1_first_format", """ SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS ts FROM orders""")
def _(s, d):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return t.table(s, d, "orders").select("o_orderkey", tm.parse_first(text, ["yyyy-MM-dd", "dd/MM/yyyy"]).alias("ts"))


@query("G2_hour_24_text", """ SELECT event_id, date_trunc('minute', ts) + CASE WHEN hour(ts) = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS ts FROM events""")
def _(s, d):
    hour = F.when(F.hour("ts") == 0, "24").otherwise(F.date_format("ts", "HH"))
    text = F.concat(F.date_format("ts", "dd-MM-yyyy "), hour, F.date_format("ts", ":mm"))
    return t.table(s, d, "events").select("event_id", tm.parse_with_hour_24(text).alias("ts"))


@query("G3_date_plus_hour", "SELECT o_orderkey, o_orderdate + to_hours(CAST(o_orderkey % 25 AS INTEGER)) AS ts FROM orders")
def _(s, d):
    return t.table(s, d, "orders").select("o_orderkey", tm.date_plus_hour(F.to_date("o_orderdate"), F.col("o_orderkey") % 25).alias("ts"))


@query("G4_clamped_hour", "SELECT o_orderkey, CAST(greatest(0, least(23, o_orderkey % 30 - 3)) AS INTEGER) AS h FROM orders")
def _(s, d):
    return t.table(s, d, "orders").select("o_orderkey", tm.clamp_hour((F.col("o_orderkey") % 30 - 3).cast("string")).alias("h"))


@query("G5_compact_clock", "SELECT event_id, date_trunc('minute', ts) AS ts FROM events")
def _(s, d):
    day = F.regexp_replace(F.date_format("ts", "yyMMdd"), "^0+", "")
    clock = F.date_format("ts", "HHmm").cast("int").cast("string")
    return t.table(s, d, "events").select("event_id", tm.parse_compact(day, clock).alias("ts"))


@query("G6_shift_clock", t.ctes("panel") + """ SELECT station, datetime - INTERVAL 5 HOUR AS datetime, CAST(year(datetime - INTERVAL 5 HOUR) AS INTEGER) AS year, CAST(hour(datetime - INTERVAL 5 HOUR) AS INTEGER) AS hour FROM panel""")
def _(s, d):
    p = t.panel(s, d).select("station", "datetime", "year").withColumn("hour", F.hour("datetime"))
    return tm.shift_clock(p, -5)


@query("G8_calendar", t.ctes("panel") + """ SELECT station, datetime, CAST(year(datetime) AS INTEGER) AS year, CAST(month(datetime) AS INTEGER) AS month, CAST(hour(datetime) AS INTEGER) AS hour,
 CAST(isodow(datetime) AS INTEGER) AS weekday, strftime(datetime, '%Y-%m') AS year_month FROM panel""")
def _(s, d):
    return reshape.calendar(t.panel(s, d).select("station", "datetime"))


@query("G10_iso_text", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS txt FROM events")
def _(s, d):
    return t.table(s, d, "events").select("event_id", tm.iso_text("ts").alias("txt"))


@query("G11_month_name_text", "SELECT event_id, date_trunc('second', ts) AS ts FROM events")
def _(s, d):
    return t.table(s, d, "events").select("event_id", tm.parse_month_name(F.lower(F.date_format("ts", "ddMMMyyyy HH:mm:ss"))).alias("ts"))


@query("G12_hours_in_year", "SELECT o_orderkey, CAST(date_diff('hour', make_date(year(o_orderdate), 1, 1), make_date(year(o_orderdate) + 1, 1, 1)) AS INTEGER) AS h FROM orders")
def _(s, d):
    return t.table(s, d, "orders").select("o_orderkey", tm.hours_in_year(F.year("o_orderdate")).alias("h"))


@query("G13_clock_from_date_and_hour", t.ctes("cells") + " SELECT cell_id, CAST(date AS TIMESTAMP) + to_hours(hour) AS datetime FROM cells")
def _(s, d):
    from airgrid.plans.series import hour_clock
    return hour_clock(t.cells(s, d)).select("cell_id", "datetime")


# ---- diagnostics ---------------------------------------------------------------------------------

@query("D10_completeness", t.ctes("long_panel") + """, per AS (SELECT station, year, count(pm10) AS pm10, count(pm25) AS pm25 FROM long_panel GROUP BY 1, 2),
 l AS (SELECT station, year, 'pm10' AS pollutant, pm10 AS n FROM per UNION ALL SELECT station, year, 'pm25', pm25 FROM per)
 SELECT year, pollutant, count(DISTINCT station) AS n_stations, string_agg(DISTINCT station, ';' ORDER BY station) AS stations FROM l
 WHERE n * 1.0 / date_diff('hour', make_date(year, 1, 1), make_date(year + 1, 1, 1)) >= 0.006 GROUP BY 1, 2""")
def _(s, d):
    return dg.stations_by_pollutant(t.long_panel(s, d), POLS, 0.006)


EXC = """, l AS (SELECT year, station, 'pm10' AS pollutant, pm10 AS v FROM long_panel WHERE pm10 IS NOT NULL UNION ALL SELECT year, station, 'pm25', pm25 FROM long_panel WHERE pm25 IS NOT NULL),
 sm AS (SELECT year, pollutant, station, avg(v) AS v, count(v) AS n FROM l GROUP BY 1, 2, 3)"""
EXC_OUT = "round(city_avg, 6) AS city_avg, n_stations, n_valid_hrs, CASE pollutant WHEN 'pm10' THEN CAST(15 AS DOUBLE) ELSE CAST(5 AS DOUBLE) END AS who_aqg, round(city_avg / CASE pollutant WHEN 'pm10' THEN 15 ELSE 5 END, 6) AS exceedance_factor"


@query("D11_exceedance_station_means", t.ctes("long_panel") + EXC + f", r AS (SELECT year, pollutant, avg(v) AS city_avg, count(DISTINCT station) AS n_stations, CAST(sum(n) AS BIGINT) AS n_valid_hrs FROM sm GROUP BY 1, 2) SELECT year, pollutant, {EXC_OUT} FROM r")
def _(s, d):
    return t.rnd(dg.exceedances(t.long_panel(s, d)))


@query("D11_exceedance_station_medians", t.ctes("long_panel") + EXC + f", r AS (SELECT year, pollutant, median(v) AS city_avg, count(DISTINCT station) AS n_stations, CAST(sum(n) AS BIGINT) AS n_valid_hrs FROM sm GROUP BY 1, 2) SELECT year, pollutant, {EXC_OUT} FROM r")
def _(s, d):
    return t.rnd(dg.exceedances(t.long_panel(s, d), how="median"))


@query("D12_exceedance_pooled", t.ctes("long_panel") + EXC + f", r AS (SELECT year, pollutant, avg(v) AS city_avg, count(DISTINCT station) AS n_stations, count(v) AS n_valid_hrs FROM l GROUP BY 1, 2) SELECT year, pollutant, {EXC_OUT} FROM r")
def _(s, d):
    return t.rnd(dg.exceedances(t.long_panel(s, d), station_level=False))


MISS = "round(100.0 * count(*) FILTER (pm10 IS NULL) / count(*), 6) AS pm10_missing_pct, round(100.0 * count(*) FILTER (pm25 IS NULL) / count(*), 6) AS pm25_missing_pct, count(*) AS total_hrs"
DIMS = {"station": "station", "year": "CAST(year(datetime) AS INTEGER)", "month": "CAST(month(datetime) AS INTEGER)",
        "hour": "CAST(hour(datetime) AS INTEGER)", "day_of_week": "CAST(isodow(datetime) AS INTEGER)"}


def _missing(dims):
    name = "D13_missing_by_" + dims[0] if len(dims) == 1 else "D14_missing_by_" + "_and_".join(dims)
    sel = ", ".join(f"{DIMS[x]} AS {x}" for x in dims)

    @query(name, t.ctes("long_panel") + f" SELECT {sel}, {MISS} FROM long_panel GROUP BY {', '.join(str(i + 1) for i in range(len(dims)))}")
    def _(s, d):
        return t.rnd(dg.missing_proportions(t.long_panel(s, d), POLS, dims))


for _dims in (["station"], ["year"], ["month"], ["hour"], ["day_of_week"], ["month", "hour"]):
    _missing(_dims)


@query("D15_missing_independent", t.ctes("long_panel") + """, a AS (SELECT CAST(month(datetime) AS INTEGER) AS month, 100.0 * count(*) FILTER (pm10 IS NULL) / count(*) AS p FROM long_panel GROUP BY 1),
 b AS (SELECT CAST(hour(datetime) AS INTEGER) AS hour, 100.0 * count(*) FILTER (pm10 IS NULL) / count(*) AS p FROM long_panel GROUP BY 1) SELECT month, hour, round((a.p + b.p) / 2, 6) AS missing_pct FROM a, b""")
def _(s, d):
    return t.rnd(dg.missing_independent(t.long_panel(s, d), "pm10", "month", "hour"))


@query("D16_stations_reporting", t.ctes("long_panel") + " SELECT count(DISTINCT CASE WHEN pm10 IS NOT NULL THEN station END) AS pm10, count(DISTINCT CASE WHEN pm25 IS NOT NULL THEN station END) AS pm25 FROM long_panel WHERE year = 1997")
def _(s, d):
    return dg.stations_reporting(t.long_panel(s, d), POLS, 1997)


@query("K13_missing_by_quintile", t.ctes("panel", "unit_distances", "people") + """, m AS (SELECT geo_id, sum(educ_years * person_weight) / sum(CASE WHEN educ_years IS NOT NULL THEN person_weight END) AS v, sum(person_weight) AS pop FROM people GROUP BY 1),
 q AS (SELECT geo_id, CAST(least(5, greatest(1, ceil(5.0 * (rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0) / count(*) OVER ()))) AS INTEGER) AS quintile FROM m WHERE v IS NOT NULL AND pop > 0),
 nr AS (SELECT station_id, geo_id FROM (SELECT station_id, geo_id, row_number() OVER (PARTITION BY station_id ORDER BY distance_km, geo_id) AS r FROM unit_distances) WHERE r = 1),
 sq AS (SELECT DISTINCT station_id, quintile FROM nr JOIN q USING (geo_id)),
 w AS (SELECT quintile, count(*) AS total_obs, count(*) FILTER (pm10 IS NULL) AS a, count(*) FILTER (pm25 IS NULL) AS b FROM panel JOIN sq ON sq.station_id = station GROUP BY 1)
 SELECT quintile, 'pm10' AS pollutant, round(CAST(a AS DOUBLE) / total_obs, 6) AS value, total_obs FROM w UNION ALL SELECT quintile, 'pm25', round(CAST(b AS DOUBLE) / total_obs, 6), total_obs FROM w""")
def _(s, d):
    q = dg.station_quintiles(t.unit_distances(s, d), dg.unit_quintiles(t.people(s, d)))
    return t.rnd(dg.missing_by_quintile(t.panel(s, d), q, POLS))


@query("D20_census_summary", t.ctes("people") + ", u AS (SELECT geo_id, sum(person_weight) AS pop_total FROM people GROUP BY 1) SELECT sum(pop_total) AS total_population, count(DISTINCT geo_id) AS n_census_geographic_units, round(sum(pop_total) / count(DISTINCT geo_id), 6) AS average_population_per_unit FROM u WHERE pop_total > 0")
def _(s, d):
    u = t.people(s, d).groupBy("geo_id").agg(F.sum("person_weight").alias("pop_total"))
    return t.rnd(dg.census_summary(u))


@query("D43_match_report", "SELECT count(DISTINCT o_custkey) FILTER (o_custkey IN (SELECT s_suppkey FROM supplier)) AS n_matched, count(DISTINCT o_custkey) FILTER (o_custkey NOT IN (SELECT s_suppkey FROM supplier)) AS n_unmatched FROM orders")
def _(s, d):
    a = t.table(s, d, "orders").select(F.col("o_custkey").alias("k"))
    b = t.table(s, d, "supplier").select(F.col("s_suppkey").alias("k"))
    return dg.match_report(a, b, "k")
