"""Queries: distances, exposure, groups, outliers and regressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from airgrid.functions import geo
from airgrid.operators import ordered, spatial
from airgrid.plans import exposure as ex
from airgrid.plans import outliers as out
from airgrid.plans import regress as rg
from checks import tables as t
from checks.registry import query

POLS = ["pm10", "pm25"]
HOURLY = """, hourly AS (SELECT geo_id, datetime,
  sum(pm10 * inv_d) / sum(CASE WHEN pm10 IS NOT NULL THEN inv_d END) AS pm10,
  sum(pm25 * inv_d) / sum(CASE WHEN pm25 IS NOT NULL THEN inv_d END) AS pm25
  FROM panel p JOIN weights w ON p.station = w.station_id
  WHERE coalesce(pm10, pm25) IS NOT NULL GROUP BY geo_id, datetime)"""


def _annual_sql() -> str:
    cols = []
    for p in POLS:
        cols.append(f"avg({p}) AS avg_{p}, nullif(count({p}), 0) AS total_hrs_{p}")
        for it, v in ex.TARGETS[p].items():
            cols.append(f"CASE WHEN count({p}) > 0 THEN count(*) FILTER ({p} >= {v}) END AS hrs_d_{p}_{it}")
    return f", exposure AS (SELECT geo_id, CAST(year(datetime) AS INTEGER) AS year, {', '.join(cols)} FROM hourly GROUP BY 1, 2)"


ANNUAL = _annual_sql()
ANNUAL_COLS = ", ".join(
    ["geo_id", "year"]
    + [f"round(avg_{p}, 6) AS avg_{p}, total_hrs_{p}, " + ", ".join(f"hrs_d_{p}_{it}" for it in ex.TARGETS[p]) for p in POLS]
)


def hourly(s, d, **kw):
    return ex.hourly_idw(t.panel(s, d), t.unit_distances(s, d), POLS, 5, **kw)


def annual(s, d):
    return ex.idw_exposure(t.panel(s, d), t.unit_distances(s, d), POLS, 5)


@query("J5_haversine_pairs", t.ctes("unit_distances") + " SELECT geo_id, station_id, round(distance_km, 6) AS distance_km FROM unit_distances")
def _(s, d):
    return t.rnd(t.unit_distances(s, d))


@query("J6_s2_sphere_pairs", t.ctes("units", "stations") + f""" SELECT geo_id, station_id, round({t.hav('u', 's', 6371.01)}, 6) AS distance_km
  FROM units u, stations s WHERE {t.hav('u', 's', 6371.01)} <= 10""")
def _(s, d):
    return t.rnd(spatial.pairs_within(t.units(s, d), t.stations(s, d), "geo_id", "station_id", 10, geo.S2_EARTH_KM))


AEQD = """, pts AS (SELECT lon, lat FROM units UNION ALL SELECT lon, lat FROM stations),
 mid AS (SELECT radians((min(lon)+max(lon))/2) AS l0, radians((min(lat)+max(lat))/2) AS p0 FROM pts),
 ang AS (SELECT id, kind, radians(lat) AS p, radians(lon) - l0 AS dl, p0,
   acos(greatest(-1.0, least(1.0, sin(p0)*sin(radians(lat)) + cos(p0)*cos(radians(lat))*cos(radians(lon)-l0)))) AS c
   FROM (SELECT geo_id AS id, 'u' AS kind, lon, lat FROM units UNION ALL SELECT station_id, 's', lon, lat FROM stations), mid),
 xy AS (SELECT id, kind, 6378.137*(CASE WHEN sin(c) < 1e-12 THEN 1.0 ELSE c/sin(c) END)*cos(p)*sin(dl) AS x,
   6378.137*(CASE WHEN sin(c) < 1e-12 THEN 1.0 ELSE c/sin(c) END)*(cos(p0)*sin(p) - sin(p0)*cos(p)*cos(dl)) AS y FROM ang)"""


@query("J7_planar_pairs", t.ctes("units", "stations") + AEQD + """
 SELECT a.id AS geo_id, b.id AS station_id, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), 5) AS distance_km FROM xy a, xy b
 WHERE a.kind = 'u' AND b.kind = 's' AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) <= 10""")
def _(s, d):
    return t.rnd(spatial.planar_pairs_within(t.units(s, d), t.stations(s, d), "geo_id", "station_id", 10), 5)


def _ellipsoid_sql() -> str:
    """Plane coordinates of units and stations around the middle of their box, on the ellipsoid, step by step."""
    f, a = geo.FLATTENING, geo.ELLIPSOID_KM
    b = a * (1 - f)
    circle = """sqrt(pow(c2 * sin(lam), 2) + pow(c1 * s2 - s1 * c2 * cos(lam), 2)) AS ss, s1 * s2 + c1 * c2 * cos(lam) AS cs"""
    def ctes(k):
        return f""", a{k} AS (SELECT id, kind, s1, c1, s2, c2, gap, lam, {circle} FROM l{k}),
 b{k} AS (SELECT *, atan2(ss, cs) AS sg, CASE WHEN ss = 0 THEN 0 ELSE c1 * c2 * sin(lam) / ss END AS sa FROM a{k}),
 d{k} AS (SELECT *, 1 - sa * sa AS ca2, CASE WHEN 1 - sa * sa < 1e-15 THEN 0 ELSE cs - 2 * s1 * s2 / (1 - sa * sa) END AS c2m FROM b{k}),
 e{k} AS (SELECT *, {f!r} / 16 * ca2 * (4 + {f!r} * (4 - 3 * ca2)) AS cc FROM d{k})"""
    def more(k):
        return f""", l{k} AS (SELECT id, kind, s1, c1, s2, c2, gap, gap + (1 - cc) * {f!r} * sa * (sg + cc * ss * (c2m + cc * cs * (2 * c2m * c2m - 1))) AS lam FROM e{k - 1})"""
    n = geo.GEODESIC_STEPS
    return f""", pts AS (SELECT lon, lat FROM units UNION ALL SELECT lon, lat FROM stations),
 mid AS (SELECT (min(lon) + max(lon)) / 2 AS l0, (min(lat) + max(lat)) / 2 AS p0 FROM pts),
 u0 AS (SELECT id, kind, atan({(1 - f)!r} * tan(radians(p0))) AS u1, atan({(1 - f)!r} * tan(radians(lat))) AS u2, radians(lon - l0) AS gap
   FROM (SELECT geo_id AS id, 'u' AS kind, lon, lat FROM units UNION ALL SELECT station_id, 's', lon, lat FROM stations), mid),
 l0 AS (SELECT id, kind, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2, gap, gap AS lam FROM u0)""" + ctes(0) + "".join(more(k) + ctes(k) for k in range(1, n + 1)) + f""",
 v AS (SELECT *, ca2 * {((a * a - b * b) / (b * b))!r} AS u FROM e{n}),
 w AS (SELECT *, 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))) AS aa, u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) AS bb FROM v),
 z AS (SELECT id, kind, {b!r} * aa * (sg - bb * ss * (c2m + bb / 4 * (cs * (2 * c2m * c2m - 1) - bb / 6 * c2m * (4 * ss * ss - 3) * (4 * c2m * c2m - 3)))) AS s, atan2(c2 * sin(lam), c1 * s2 - s1 * c2 * cos(lam)) AS az FROM w),
 xy AS (SELECT id, kind, s * sin(az) AS x, s * cos(az) AS y FROM z)"""


@query("J7_ellipsoidal_pairs", t.ctes("units", "stations") + _ellipsoid_sql() + """
 SELECT a.id AS geo_id, b.id AS station_id, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), 6) AS distance_km FROM xy a, xy b
 WHERE a.kind = 'u' AND b.kind = 's' AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) <= 10""")
def _(s, d):
    return t.rnd(spatial.planar_pairs_within(t.units(s, d), t.stations(s, d), "geo_id", "station_id", 10, ellipsoid=True))


@query("J8_station_matrix", t.ctes("station_distances") + " SELECT station_from, station_to, round(distance_km, 6) AS distance_km FROM station_distances")
def _(s, d):
    return t.rnd(t.station_distances(s, d))


@query("J10_utm_zone", t.ctes("units") + """ SELECT round((min(lon)+max(lon))/2, 6) AS lon0, round((min(lat)+max(lat))/2, 6) AS lat0,
  CAST(CASE WHEN (min(lat)+max(lat))/2 >= 0 THEN 32600 ELSE 32700 END + floor(((min(lon)+max(lon))/2 + 180)/6) + 1 AS INTEGER) AS utm_epsg FROM units""")
def _(s, d):
    return t.rnd(spatial.box_summary(t.units(s, d)))


@query("B8_buffer_weights", t.ctes("weights", buffer=3) + " SELECT geo_id, station_id, round(inv_d, 6) AS inv_d FROM weights")
def _(s, d):
    return t.rnd(ex.in_buffer(t.unit_distances(s, d), 3))


@query("B8_zero_distances", t.ctes("station_distances") + " SELECT count(*) FILTER (distance_km = 0) AS n_zero FROM station_distances")
def _(s, d):
    return ex.zero_distances(t.station_distances(s, d))


@query("D1_hourly_idw", t.ctes("panel", "weights", buffer=5) + HOURLY + """
  SELECT geo_id, datetime, round(pm10, 6) AS pm10, round(pm25, 6) AS pm25 FROM hourly""")
def _(s, d):
    return t.rnd(hourly(s, d))


@query("C2_idw_without_broadcast", t.ctes("panel", "weights", buffer=5) + HOURLY + """
  SELECT geo_id, datetime, round(pm10, 6) AS pm10, round(pm25, 6) AS pm25 FROM hourly""")
def _(s, d):
    return t.rnd(hourly(s, d, max_broadcast_rows=0, salts=4))


@query("K4_idw_exposure", t.ctes("panel", "weights", buffer=5) + HOURLY + ANNUAL + f" SELECT {ANNUAL_COLS} FROM exposure")
def _(s, d):
    return t.rnd(annual(s, d))


@query("D3_one_pass_three_km", t.ctes("panel", "weights", buffer=3) + HOURLY + ANNUAL + f" SELECT {ANNUAL_COLS} FROM exposure")
def _(s, d):
    return t.rnd(ex.idw_exposure(t.panel(s, d), t.unit_distances(s, d), POLS, 3))


@query("D4_day_metrics", t.ctes("panel", "weights", buffer=5) + HOURLY + """,
  days AS (SELECT geo_id, CAST(datetime AS DATE) AS day, count(*) FILTER (pm25 >= 75) AS a, count(*) FILTER (pm25 >= 50) AS b
    FROM hourly WHERE pm25 IS NOT NULL GROUP BY 1, 2)
  SELECT geo_id, count(*) FILTER (a >= 1) AS days_with_hr_above_it1, count(*) FILTER (a >= 2) AS days_with_2hr_above_it1,
   count(*) FILTER (b >= 1) AS days_with_hr_above_it2, count(*) FILTER (b >= 2) AS days_with_2hr_above_it2 FROM days GROUP BY geo_id""")
def _(s, d):
    return ex.day_metrics(hourly(s, d), "pm25", {"it1": 75.0, "it2": 50.0})


@query("D5_legacy_weights", t.ctes("panel", "weights", buffer=5) + """
  SELECT geo_id, datetime, round(sum(coalesce(pm10, 0) * inv_d) / sum(inv_d), 6) AS pm10
  FROM panel p JOIN weights w ON p.station = w.station_id GROUP BY geo_id, datetime""")
def _(s, d):
    return t.rnd(ex.hourly_idw(t.panel(s, d), t.unit_distances(s, d), ["pm10"], 5, missing="zero"))


@query("D43_station_match", t.ctes("panel", "unit_distances") + """, a AS (SELECT station AS station_id, count(pm10) + count(pm25) AS n_obs, 1 AS p FROM panel GROUP BY 1),
  b AS (SELECT DISTINCT station_id, 1 AS q FROM unit_distances)
  SELECT coalesce(a.station_id, b.station_id) AS station_id, coalesce(n_obs, 0) AS n_obs, coalesce(p, 0) AS in_panel, coalesce(q, 0) AS in_distances
  FROM a FULL JOIN b ON a.station_id = b.station_id""")
def _(s, d):
    return ex.station_match(t.panel(s, d), t.unit_distances(s, d), POLS)


GROUPED = """, grouped AS (SELECT *, CAST(1 + {} AS INTEGER) AS edu_quintile FROM (SELECT *, sum(person_weight) OVER (ORDER BY educ_years, geo_id, row_key
  ROWS UNBOUNDED PRECEDING) / sum(person_weight) OVER () AS sh FROM people WHERE adult = 1 AND educ_years IS NOT NULL))""".format(
    " + ".join(f"CASE WHEN sh > CAST({k} AS DOUBLE) / 5 THEN 1 ELSE 0 END" for k in range(1, 5))
)


def persons(s, d):
    return ordered.assign_groups(t.people(s, d).where("adult = 1"), "educ_years", "person_weight", 5, "edu_quintile", ["geo_id", "row_key"])


@query("E5_equal_population_groups", t.ctes("people") + GROUPED + """ SELECT row_key, geo_id, edu_quintile FROM grouped
  UNION ALL SELECT row_key, geo_id, NULL FROM people WHERE adult = 1 AND educ_years IS NULL""")
def _(s, d):
    return persons(s, d).select("row_key", "geo_id", "edu_quintile")


@query("E6_share_bands", t.ctes("people") + """ SELECT row_key, CAST(CASE WHEN sh <= 0.2 THEN 1 WHEN sh <= 0.4 THEN 2 WHEN sh <= 0.6 THEN 3
  WHEN sh <= 0.8 THEN 4 ELSE 5 END AS INTEGER) AS band FROM (SELECT row_key, sum(person_weight) OVER (ORDER BY income, row_key ROWS UNBOUNDED PRECEDING)
  / sum(person_weight) OVER () AS sh FROM people)""")
def _(s, d):
    return ordered.share_bands(t.people(s, d), "income", "person_weight", [0.2, 0.4, 0.6, 0.8], "band", ["row_key"]).select("row_key", "band")


@query("E7_rank_quintile", t.ctes("people") + """, m AS (SELECT geo_id, sum(educ_years * person_weight) / sum(CASE WHEN educ_years IS NOT NULL THEN person_weight END) AS v,
  sum(person_weight) AS pop FROM people GROUP BY 1), ok AS (SELECT * FROM m WHERE v IS NOT NULL AND pop > 0)
  SELECT geo_id, CAST(least(5, greatest(1, ceil(5.0 * (rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0) / count(*) OVER ()))) AS INTEGER) AS quintile FROM ok""")
def _(s, d):
    from airgrid.plans.diagnostics import unit_quintiles
    return unit_quintiles(t.people(s, d))


@query("E8_percentile_rank", t.ctes("people") + """ SELECT row_key, round(CAST(row_number() OVER (ORDER BY educ_years, row_key) AS DOUBLE) / count(*) OVER (), 9) AS pct
  FROM people WHERE educ_years IS NOT NULL""")
def _(s, d):
    p = t.people(s, d).where("educ_years IS NOT NULL")
    return t.rnd(ordered.percentile_rank(p, "educ_years", ["row_key"], "pct").select("row_key", "pct"), 9)


@query("D23_weighted_median", t.ctes("people") + """, c AS (SELECT sex, income, sum(person_weight) OVER (PARTITION BY sex ORDER BY income, row_key ROWS UNBOUNDED PRECEDING)
  / sum(person_weight) OVER (PARTITION BY sex) AS sh FROM people) SELECT sex, min(income) AS median_income FROM c WHERE sh >= 0.5 GROUP BY sex""")
def _(s, d):
    return ordered.weighted_quantile(t.people(s, d), ["sex"], "income", "person_weight", 0.5, "median_income")


@query("D24_upper_trim", t.ctes("people") + """, c AS (SELECT *, sum(person_weight) OVER (PARTITION BY sex ORDER BY income, row_key ROWS UNBOUNDED PRECEDING)
  / sum(person_weight) OVER (PARTITION BY sex) AS sh FROM people), q AS (SELECT sex AS s2, min(income) AS top FROM c WHERE sh >= 0.995 GROUP BY 1)
  SELECT p.row_key, p.sex, p.income FROM people p JOIN q ON sex = s2 WHERE income <= top""")
def _(s, d):
    return rg.trim_upper(t.people(s, d), ["sex"], "income", "person_weight").select("row_key", "sex", "income")


@query("D34_quantiles", t.ctes("people") + """ SELECT job, round(quantile_cont(income, 0.95), 6) AS p95, round(quantile_cont(income, 0.5), 6) AS p50 FROM people GROUP BY job""")
def _(s, d):
    return t.rnd(ordered.quantiles(t.people(s, d), ["job"], "income", {"p95": 0.95, "p50": 0.5}))


@query("D44_winsorise", t.ctes("people") + """, q AS (SELECT quantile_cont(income, 0.99) AS hi, (SELECT quantile_cont(income, 0.01) FROM people WHERE income > 0) AS lo FROM people)
  SELECT row_key, round(CASE WHEN income > 0 THEN least(greatest(income, lo), hi) ELSE income END, 6) AS income_w FROM people, q""")
def _(s, d):
    return t.rnd(ordered.winsorise(t.people(s, d), "income", "income_w").select("row_key", "income_w"))


@query("C19_nearest_neighbours", t.ctes("stations") + f""" SELECT station_id, station_id_to, round(distance_km, 6) AS distance_km, CAST(rank AS INTEGER) AS rank FROM (
  SELECT a.station_id, b.station_id AS station_id_to, {t.hav('a', 'b')} AS distance_km,
  row_number() OVER (PARTITION BY a.station_id ORDER BY {t.hav('a', 'b')}, b.station_id) AS rank FROM stations a, stations b WHERE {t.hav('a', 'b')} > 0) WHERE rank <= 2""")
def _(s, d):
    st = t.stations(s, d)
    return t.rnd(spatial.nearest(st, st, "station_id", "station_id", 2, 4.0, positive_only=True))


@query("C20_nearest_unit", t.ctes("units", "stations") + f""" SELECT station_id, min_by(geo_id, r) AS geo_id, round(min(d), 6) AS distance_km FROM (
  SELECT station_id, geo_id, {t.hav('s', 'u')} AS d, row_number() OVER (PARTITION BY station_id ORDER BY {t.hav('s', 'u')}, geo_id) AS r FROM stations s, units u) WHERE r = 1 GROUP BY 1""")
def _(s, d):
    return t.rnd(spatial.nearest(t.stations(s, d), t.units(s, d), "station_id", "geo_id", 1, 1.0).drop("rank"))


@query("D28_unit_reach", t.ctes("units", "stations") + f""" SELECT geo_id, round(min({t.hav('u', 's')}), 6) AS nearest_km,
  count(*) FILTER ({t.hav('u', 's')} <= 5) AS n_stations FROM units u, stations s GROUP BY geo_id""")
def _(s, d):
    from airgrid.plans.socio import unit_reach
    return t.rnd(unit_reach(t.units(s, d), t.stations(s, d), 5.0))


def _outlier_sql(miss_temp="continue", second=True, with_data=True, panel="panel", pairs="station_pairs") -> str:
    """Long twin of the outlier rules for one option set; neighbours are ranked over all pairs of stations."""
    spat2 = "true" if second else "false"
    semi = ("JOIN present c ON c.pollutant = o.pollutant AND c.year = o.year AND c.station = d.station_to" if with_data else "")
    return t.ctes(panel, pairs) + f""",
 long AS (SELECT 'pm10' AS pollutant, station, datetime, year, pm10 AS value FROM {panel} UNION ALL SELECT 'pm25', station, datetime, year, pm25 FROM {panel}),
 span AS (SELECT year, min(datetime) AS lo, max(datetime) AS hi FROM {panel} GROUP BY 1),
 grid AS (SELECT pollutant, station, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS datetime
   FROM (SELECT DISTINCT station, year FROM {panel}) JOIN span USING (year), (VALUES ('pm10'), ('pm25')) v(pollutant)),
 full_rows AS (SELECT g.pollutant, g.station, g.datetime, CAST(year(g.datetime) AS INTEGER) AS year, strftime(g.datetime, '%Y-%m') AS ym, l.value
   FROM grid g LEFT JOIN long l USING (pollutant, station, datetime)),
 present AS (SELECT DISTINCT pollutant, year, station FROM long WHERE value IS NOT NULL),
 near AS (SELECT * FROM (SELECT o.pollutant, o.year, d.station_from AS station, d.station_to, row_number() OVER (PARTITION BY o.pollutant, o.year, d.station_from
   ORDER BY d.distance_km, d.station_to) AS rk FROM present o JOIN {pairs} d ON d.station_from = o.station AND d.distance_km > 0 {semi}) WHERE rk <= 2),
 r1 AS (SELECT f.*, lagr.value AS lag_v, leadr.value AS lead_v, v1.value AS nb1, v2.value AS nb2 FROM full_rows f
   LEFT JOIN long lagr ON lagr.pollutant = f.pollutant AND lagr.station = f.station AND lagr.datetime = f.datetime - INTERVAL 1 HOUR
   LEFT JOIN long leadr ON leadr.pollutant = f.pollutant AND leadr.station = f.station AND leadr.datetime = f.datetime + INTERVAL 1 HOUR
   LEFT JOIN near n1 ON n1.pollutant = f.pollutant AND n1.year = f.year AND n1.station = f.station AND n1.rk = 1
   LEFT JOIN long v1 ON v1.pollutant = f.pollutant AND v1.station = n1.station_to AND v1.datetime = f.datetime
   LEFT JOIN near n2 ON n2.pollutant = f.pollutant AND n2.year = f.year AND n2.station = f.station AND n2.rk = 2 AND {spat2}
   LEFT JOIN long v2 ON v2.pollutant = f.pollutant AND v2.station = n2.station_to AND v2.datetime = f.datetime),
 r2 AS (SELECT *, value - lag_v AS df, value - nb1 AS d1, value - nb2 AS d2, coalesce((lag_v + lead_v) / 2, lag_v, lead_v) AS bench FROM r1),
 st AS (SELECT pollutant, station, ym, quantile_cont(value, 0.99) AS p99, avg(df) AS mt, stddev_samp(df) AS st, avg(d1) AS m1, stddev_samp(d1) AS s1,
   avg(d2) AS m2, stddev_samp(d2) AS s2 FROM r2 GROUP BY 1, 2, 3),
 r3 AS (SELECT r2.*, p99, mt, st, m1, s1, m2, s2, coalesce(value > p99, false) AS flag,
   CASE WHEN bench IS NULL THEN 3 WHEN coalesce(value - bench > mt - 2 * st AND value - bench < mt + 2 * st, false) THEN 1 ELSE 2 END AS kind,
   (d1 IS NOT NULL AND m1 IS NOT NULL AND s1 IS NOT NULL) AS f1, coalesce(d1 > m1 - 2 * s1 AND d1 < m1 + 2 * s1, false) AS p1,
   (d2 IS NOT NULL AND m2 IS NOT NULL AND s2 IS NOT NULL) AS f2, coalesce(d2 > m2 - 2 * s2 AND d2 < m2 + 2 * s2, false) AS p2
   FROM r2 JOIN st USING (pollutant, station, ym)),
 r4 AS (SELECT *, CASE WHEN {'kind > 1' if miss_temp == 'continue' else 'kind = 2'} AND ((f1 AND p1) OR (NOT f1 AND f2 AND p2)) THEN 1 ELSE kind END AS cat,
   (NOT f1 AND NOT f2) AS none, CASE WHEN f1 THEN NOT p1 ELSE f2 AND NOT p2 END AS failed FROM r3),
 flags AS (SELECT pollutant, station, datetime, value AS raw_value, CAST(CASE WHEN NOT flag THEN 0
   {"WHEN cat = 3 THEN 1" if miss_temp == "finish" else ""}
   WHEN cat = 3 AND none THEN 1 WHEN cat = 2 AND none THEN 2 WHEN cat = 2 AND failed THEN 3 WHEN cat = 3 AND failed THEN 4 ELSE 0 END AS INTEGER) AS outlier_reason,
   CAST(count(*) FILTER (flag AND st IS NULL) OVER w AS INTEGER) AS n_missing_temporal_sd,
   CAST(count(*) FILTER (flag AND st = 0) OVER w AS INTEGER) AS n_zero_temporal_sd,
   CAST(count(*) FILTER (flag AND s1 IS NULL AND s2 IS NULL) OVER w AS INTEGER) AS n_missing_spatial_sd,
   CAST(count(*) FILTER (flag AND (s1 = 0 OR s2 = 0)) OVER w AS INTEGER) AS n_zero_spatial_sd
   FROM r4 WINDOW w AS (PARTITION BY pollutant, station, ym))"""


FLAG_COLS = """ SELECT pollutant, station, datetime, round(raw_value, 6) AS raw_value, round(CASE WHEN outlier_reason = 0 THEN raw_value END, 6) AS value,
  CAST(outlier_reason > 0 AS INTEGER) AS outlier, outlier_reason, n_missing_temporal_sd, n_zero_temporal_sd, n_missing_spatial_sd, n_zero_spatial_sd FROM flags"""


def flags(s, d, **kw):
    return out.flag_long(t.panel(s, d), pollutants=POLS, stations=t.stations(s, d), **kw)


@query("K3_outliers_long", _outlier_sql() + FLAG_COLS)
def _(s, d):
    return t.rnd(flags(s, d))


@query("K3_outliers_finish", _outlier_sql("finish") + FLAG_COLS)
def _(s, d):
    return t.rnd(flags(s, d, on_missing_temporal="finish"))


@query("K3_outliers_first_neighbour", _outlier_sql(second=False) + FLAG_COLS)
def _(s, d):
    return t.rnd(flags(s, d, on_missing_neighbor="finish"))


@query("K3_outliers_any_neighbour", _outlier_sql(with_data=False) + FLAG_COLS)
def _(s, d):
    return t.rnd(flags(s, d, neighbor_eligibility="all"))


@query("K3_outliers_many_stations", _outlier_sql(panel="many_panel", pairs="many_pairs") + FLAG_COLS)
def _(s, d):
    places, panel = t.many_stations(s, d)
    return t.rnd(out.flag_long(panel, pollutants=POLS, stations=places))


@query("C6_reporting_neighbours", t.ctes("many_panel", "many_pairs") + """, present AS (SELECT DISTINCT p.pollutant, year, station FROM (SELECT station, year, unnest(['pm10', 'pm25']) AS pollutant, unnest([pm10, pm25]) AS v FROM many_panel) p WHERE v IS NOT NULL)
 SELECT pollutant, year, station_from, station_to, CAST(rk AS INTEGER) AS rank FROM (SELECT o.pollutant, o.year, station_from, station_to, row_number() OVER (PARTITION BY o.pollutant, o.year, station_from ORDER BY distance_km, station_to) AS rk
  FROM present o JOIN many_pairs d ON d.station_from = o.station AND distance_km > 0 JOIN present c ON c.pollutant = o.pollutant AND c.year = o.year AND c.station = d.station_to) WHERE rk <= 2""")
def _(s, d):
    places, panel = t.many_stations(s, d)
    long = panel.unpivot(["station", "year"], POLS, "pollutant", "value")
    return out.reporting_neighbours(long, places.withColumnRenamed("station_id", "station"))


def _wide_flags() -> str:
    cols = []
    for p in POLS:
        at = lambda c, p=p: f"max({c}) FILTER (pollutant = '{p}')"
        cols.append(f"round({at('CASE WHEN outlier_reason = 0 THEN raw_value END')}, 6) AS {p}")
        cols.append(f"{at('CAST(outlier_reason > 0 AS INTEGER)')} AS {p}_outlier, {at('outlier_reason')} AS {p}_outlier_reason")
        for c in ("n_missing_temporal_sd", "n_zero_temporal_sd", "n_missing_spatial_sd", "n_zero_spatial_sd"):
            cols.append(f"{at(c)} AS {p}_{c}")
    return ", ".join(cols)


@query("K3_clean_panel", _outlier_sql() + f""", w AS (SELECT station, datetime, {_wide_flags()} FROM flags GROUP BY 1, 2)
  SELECT w.*, CAST(year(w.datetime) AS INTEGER) AS year, round(p.ozone, 6) AS ozone FROM w LEFT JOIN panel p ON p.station = w.station AND p.datetime = w.datetime""")
def _(s, d):
    return t.rnd(out.detect_outliers(t.panel(s, d), pollutants=POLS, stations=t.stations(s, d)))


@query("D36_outlier_summary", _outlier_sql() + """ SELECT pollutant, count(raw_value) AS n_values, count(*) FILTER (outlier_reason > 0) AS n_removed,
  round(100.0 * count(*) FILTER (outlier_reason > 0) / count(raw_value), 6) AS pct_removed, count(*) FILTER (outlier_reason = 1) AS n_reason_1,
  count(*) FILTER (outlier_reason = 2) AS n_reason_2, count(*) FILTER (outlier_reason = 3) AS n_reason_3, count(*) FILTER (outlier_reason = 4) AS n_reason_4 FROM flags GROUP BY 1""")
def _(s, d):
    return t.rnd(out.step_summary(flags(s, d)))


@query("D37_outliers_per_station", _outlier_sql() + """, o AS (SELECT station, count(*) FILTER (outlier_reason > 0) AS n_new, count(*) FILTER (outlier_reason IN (3, 4)) AS n_old FROM flags GROUP BY 1)
  SELECT *, n_new - n_old AS diff FROM o""")
def _(s, d):
    f = flags(s, d)
    return out.per_station(f, f.withColumn("outlier_reason", F.when(F.col("outlier_reason") >= 3, F.col("outlier_reason")).otherwise(0)))


# ---- summaries and regressions ------------------------------------------------------------------

OUTCOMES = [f"avg_{p}" for p in POLS] + [f"hrs_d_{p}_it{k}" for p in POLS for k in (1, 2, 3, 4)]
CI_OUTCOMES = [f"hrs_d_{p}_it{k}" for p in POLS for k in (1, 2)]


def _cells_sql(outcomes: list[str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS col, '{'avg' if c.startswith('avg') else 'hrs_d_' + c[-3:]}' AS outcome, '{'pm10' if 'pm10' in c else 'pm25'}' AS pollutant, geo_id, CAST({c} AS DOUBLE) AS y FROM exposure"
        for c in outcomes)
    return f""", lng AS ({parts}), pops AS (SELECT geo_id, edu_quintile AS grp, sum(person_weight) AS pop FROM grouped GROUP BY 1, 2),
 cell AS (SELECT col, outcome, pollutant, l.geo_id, grp, pop, y FROM lng l JOIN pops p ON l.geo_id = p.geo_id WHERE y IS NOT NULL)"""


BASE = t.ctes("panel", "weights", "people", buffer=5) + HOURLY + ANNUAL + GROUPED


@query("D22_group_summary", BASE + _cells_sql(OUTCOMES) + """, run AS (SELECT *, sum(pop) OVER (PARTITION BY col, grp ORDER BY y, geo_id ROWS UNBOUNDED PRECEDING) / sum(pop) OVER (PARTITION BY col, grp) AS sh FROM cell)
 SELECT outcome, pollutant, grp AS "group", 'edu_quintile' AS group_col, round(sum(pop * y) / sum(pop), 6) AS weighted_mean,
 round(min(CASE WHEN sh >= 0.5 THEN y END), 6) AS weighted_median, sum(pop) AS weighted_population, count(*) AS n_geo_group_cells, count(DISTINCT geo_id) AS n_geo_units
 FROM run GROUP BY outcome, pollutant, grp""")
def _(s, d):
    return t.rnd(rg.exposure_summaries(annual(s, d), persons(s, d)))


COVERAGE = """, gp AS (SELECT geo_id, sum(person_weight) AS pop FROM grouped GROUP BY 1),
 lngc AS (SELECT 'pm10' AS pollutant, geo_id FROM exposure WHERE avg_pm10 IS NOT NULL UNION ALL SELECT 'pm25', geo_id FROM exposure WHERE avg_pm25 IS NOT NULL),
 tot AS (SELECT sum(person_weight) AS pm FROM people WHERE adult = 1),
 cov AS (SELECT pollutant, (SELECT count(*) FROM units) AS n_geo_metro, (SELECT count(*) FROM stations) AS n_station_metro,
  (SELECT count(DISTINCT geo_id) FROM weights) AS n_geo_in_buffer, (SELECT count(DISTINCT station_id) FROM weights) AS n_station_in_buffer,
  (SELECT count(DISTINCT geo_id) FROM exposure) AS n_geo_exposure, count(DISTINCT l.geo_id) AS n_geo_pollutant, count(DISTINCT gp.geo_id) AS n_geo_estimation,
  (SELECT pm FROM tot) AS pop_metro, sum(pop) AS pop_estimation, round(sum(pop) / (SELECT pm FROM tot), 6) AS share_pop_estimation
 FROM lngc l LEFT JOIN gp ON l.geo_id = gp.geo_id GROUP BY pollutant)"""


@query("D25_coverage", BASE + COVERAGE + " SELECT * FROM cov")
def _(s, d):
    return t.rnd(rg.exposure_coverage(annual(s, d), persons(s, d), t.unit_distances(s, d), t.units(s, d), t.stations(s, d), buffer_km=5))


#: Quantile of Student's t for each of the degrees of freedom in ``dof(nu)``, by bisection of the finite trigonometric sum of its distribution.
T_QUANTILE = """, tsum AS (SELECT nu, CAST(0 AS DOUBLE) AS lo, CAST(200 AS DOUBLE) AS hi, 0 AS step FROM dof UNION ALL SELECT nu, CASE WHEN below THEN mid ELSE lo END, CASE WHEN below THEN hi ELSE mid END, step + 1 FROM (
   SELECT *, CASE WHEN nu % 2 = 1 THEN 2 / pi() * (th + CASE WHEN nu = 1 THEN 0 ELSE sin(th) * list_sum(list_transform(range(0, CAST((nu - 1) / 2 AS BIGINT)), lambda k: exp(0.5 * ln(pi()) - ln(2) + lgamma(k + 1.0) - lgamma(k + 1.5) + (2 * k + 1) * ln(cos(th))))) END)
     ELSE sin(th) * list_sum(list_transform(range(0, CAST(nu / 2 AS BIGINT)), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0) - 0.5 * ln(pi()) + 2 * k * ln(cos(th))))) END < 0.95 AS below
   FROM (SELECT *, (lo + hi) / 2 AS mid, atan((lo + hi) / 2 / sqrt(nu)) AS th FROM tsum WHERE step < 90))),
 tq AS (SELECT nu, (lo + hi) / 2 AS t FROM tsum WHERE step = 90)"""


def _interval_sql() -> str:
    """The normalised clustered fit with its 95 percent intervals."""
    fit = _fit_sql(True, True)
    head, tail = fit.rsplit(" SELECT outcome, pollutant,", 1)
    se = "CASE WHEN \"group\" = 5 THEN 0 WHEN g_n > 5 THEN sqrt(g_n / (g_n - 1) * (n - 1) / (n - 5) * v) END"
    return head.replace("WITH ", "WITH RECURSIVE ", 1) + ", dof AS (SELECT DISTINCT CAST(g_n - 1 AS BIGINT) AS nu FROM fin)" + T_QUANTILE + f""" SELECT outcome, pollutant, "group", round(est, 6) AS estimate, round({se}, 6) AS std_error, CAST(n AS BIGINT) AS n_units, CAST(g_n AS BIGINT) AS n_clusters, 5 AS n_coef,
  round(est - coalesce(t * {se}, NULL), 6) AS ci_low, round(est + t * {se}, 6) AS ci_high, 5 AS base_group, 'edu_quintile' AS group_col, 'geo_group' AS regression_unit, 'cluster_geo' AS se_type, true AS normalized FROM fin JOIN tq ON nu = CAST(g_n - 1 AS BIGINT)"""


def _fit_sql(normalized: bool, clustered: bool) -> str:
    scale = "y / b" if normalized else "y"
    se = ("CASE WHEN g_n > 5 THEN sqrt(g_n / (g_n - 1) * (n - 1) / (n - 5) * v) END" if clustered
          else "sqrt(rss / (n - 5) * (1 / wg + 1 / wb))")
    return BASE + _cells_sql(CI_OUTCOMES) + f""", base AS (SELECT col, sum(pop * y) / sum(pop) AS b FROM cell WHERE grp = 5 GROUP BY 1),
 z AS (SELECT c.col, outcome, pollutant, geo_id, grp, {scale} AS y, pop / sum(pop) OVER (PARTITION BY c.col, grp) AS w FROM cell c JOIN base b ON c.col = b.col {'WHERE b <> 0' if normalized else ''}),
 mu AS (SELECT col, grp, sum(w * y) / sum(w) AS m, sum(w) AS wsum FROM z GROUP BY 1, 2),
 e AS (SELECT z.*, y - m AS e FROM z JOIN mu ON z.col = mu.col AND z.grp = mu.grp),
 tot AS (SELECT col, any_value(outcome) AS outcome, any_value(pollutant) AS pollutant, CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT geo_id) AS DOUBLE) AS g_n, sum(w * e * e) AS rss FROM e GROUP BY 1),
 sc AS (SELECT col, geo_id, grp, sum(w * e) AS s FROM e GROUP BY 1, 2, 3),
 ks AS (SELECT DISTINCT col, geo_id, k FROM e, (VALUES (1), (2), (3), (4), (5)) t(k)),
 va AS (SELECT ks.col, k, sum(pow(coalesce(a.s, 0) - coalesce(b.s, 0), 2)) AS v FROM ks LEFT JOIN sc a ON a.col = ks.col AND a.geo_id = ks.geo_id AND a.grp = k
   LEFT JOIN sc b ON b.col = ks.col AND b.geo_id = ks.geo_id AND b.grp = 5 GROUP BY 1, 2),
 fin AS (SELECT outcome, pollutant, CAST(va.k AS INTEGER) AS "group", CASE WHEN va.k = 5 THEN 0 ELSE mg.m - mb.m END AS est, n, g_n, rss, v, mg.wsum AS wg, mb.wsum AS wb
   FROM tot JOIN va ON va.col = tot.col LEFT JOIN mu mg ON mg.col = tot.col AND mg.grp = va.k LEFT JOIN mu mb ON mb.col = tot.col AND mb.grp = 5 WHERE n >= 5)
 SELECT outcome, pollutant, "group", round(est, 6) AS estimate, round(CASE WHEN "group" = 5 THEN 0 ELSE {se} END, 6) AS std_error,
  CAST(n AS BIGINT) AS n_units, CAST(g_n AS BIGINT) AS n_clusters, 5 AS n_coef FROM fin"""


GAP_COLS = ["outcome", "pollutant", "group", "estimate", "std_error", "n_units", "n_clusters", "n_coef"]


@query("K6_gap_regression", _fit_sql(True, True))
def _(s, d):
    return t.rnd(rg.exposure_regressions(annual(s, d), persons(s, d), conf_level=None).select(*GAP_COLS))


@query("K6_gap_classic_raw", _fit_sql(False, False))
def _(s, d):
    r = rg.exposure_regressions(annual(s, d), persons(s, d), conf_level=None, normalized=False, se_type="classic")
    return t.rnd(r.select(*GAP_COLS))


@query("K6_gap_intervals", _interval_sql())
def _(s, d):
    return t.rnd(rg.exposure_regressions(annual(s, d), persons(s, d)))


@query("E15_base_scaling", BASE + _cells_sql(CI_OUTCOMES) + """, base AS (SELECT col, sum(pop * y) / sum(pop) AS b FROM cell WHERE grp = 5 GROUP BY 1)
 SELECT cell.col AS outcome, geo_id, grp AS "group", pop, round(y / b, 6) AS y FROM cell JOIN base ON cell.col = base.col WHERE b <> 0""")
def _(s, d):
    return t.rnd(rg.scale_by_base(rg.outcome_cells(annual(s, d), persons(s, d), CI_OUTCOMES, "edu_quintile", [1, 2, 3, 4, 5]), 5))


@query("E13_group_share", BASE + _cells_sql(CI_OUTCOMES) + """ SELECT col AS outcome, geo_id, grp AS "group", pop, round(y, 6) AS y, round(pop / sum(pop) OVER (PARTITION BY col, grp), 9) AS w FROM cell""")
def _(s, d):
    c = rg.group_share(rg.outcome_cells(annual(s, d), persons(s, d), CI_OUTCOMES, "edu_quintile", [1, 2, 3, 4, 5]))
    return c.select("outcome", "geo_id", "group", "pop", F.round("y", 6).alias("y"), F.round("w", 9).alias("w"))
