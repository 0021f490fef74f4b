"""Queries: runs of two cities that share station names, in one plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from airgrid.plans import compare as cp
from airgrid.plans import exposure as ex
from airgrid.plans import runs
from airgrid.plans.panel import widen
from checks import q_exposure as qe
from checks import tables as t
from checks.registry import query

RUNS = [
    runs.Run("North", "north", 2024, 3, "education", "edu_quintile", 5),
    runs.Run("North", "north", 2024, 5, "education", "edu_quintile", 5),
    runs.Run("South", "south", 2024, 5, "education", "edu_quintile", 5),
    runs.Run("North", "north", 2024, 5, "income", "inc_decile", 10),
    runs.Run("South", "south", 2024, 5, "income", "inc_decile", 10),
]
RULES = [runs.Rule("three", 3), runs.Rule("five", 5), runs.Rule("five_zero", 5, missing="zero"), runs.Rule("five_square", 5, power=2.0)]


def _city(number):
    return F.when(number % 2 == 0, "north").otherwise("south")


def _of_unit(df):
    return df.withColumn("city_id", _city(F.substring("geo_id", 2, 6).cast("int")))


def tables(s, d):
    """Panel, pairs, people, units and stations of two cities; readings are dealt by event, units by number, stations are in both."""
    e = t.readings(s, d).withColumn("city_id", _city(F.col("event_id")))
    panel = widen(e, t.PARAMS, by=["city_id"]).withColumns({c: F.col(c) / 0.9973 for c in t.PARAMS})
    people = _of_unit(t.people(s, d)).where("adult = 1")
    people = runs.city_groups(people, "educ_years", "person_weight", 5, "edu_quintile", ["geo_id", "row_key"])
    people = runs.city_groups(people, "income", "person_weight", 10, "inc_decile", ["geo_id", "row_key"])
    stations = t.stations(s, d).withColumn("city_id", F.explode(F.array(F.lit("north"), F.lit("south"))))
    return panel, _of_unit(t.unit_distances(s, d)), people, _of_unit(t.units(s, d)), stations


UNIT_CITY = "CASE WHEN CAST(substr(geo_id, 2) AS INTEGER) % 2 = 0 THEN 'north' ELSE 'south' END"


def _groups(var: str, n: int, name: str) -> str:
    return f"""CASE WHEN {var} IS NOT NULL THEN CAST(1 + {' + '.join(f"CASE WHEN {name}_sh > CAST({k} AS DOUBLE) / {n} THEN 1 ELSE 0 END" for k in range(1, n))} AS INTEGER) END AS {name}"""


def _running(var: str, name: str) -> str:
    some = f"CASE WHEN {var} IS NOT NULL THEN person_weight END"
    return f"""sum({some}) OVER (PARTITION BY city_id ORDER BY {var} NULLS LAST, geo_id, row_key ROWS UNBOUNDED PRECEDING) / sum({some}) OVER (PARTITION BY city_id) AS {name}_sh"""


def _rules(rules) -> str:
    return "(VALUES " + ", ".join(f"('{label}', {b}.0, {p}, {str(zero).lower()})" for label, b, p, zero in rules) + ") v(rule, buffer_km, power, zero)"


def _base(rules) -> str:
    """Hourly and annual exposure of each rule and city."""
    hours = ", ".join(f"""CASE WHEN zero THEN sum(coalesce({p}, 0) * inv_d) / sum(inv_d) ELSE sum({p} * inv_d) / sum(CASE WHEN {p} IS NOT NULL THEN inv_d END) END AS {p}""" for p in qe.POLS)
    cols = []
    for p in qe.POLS:
        cols.append(f"avg({p}) AS avg_{p}, nullif(count({p}), 0) AS total_hrs_{p}")
        cols += [f"CASE WHEN count({p}) > 0 THEN count(*) FILTER ({p} >= {v}) END AS hrs_d_{p}_{it}" for it, v in ex.TARGETS[p].items()]
    return t.ctes("readings", "unit_distances", "people") + f""",
 cpanel AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'north' ELSE 'south' END AS city_id, station, datetime, avg(CASE WHEN param IN ('view','click') THEN value END) / 0.9973 AS pm10,
   avg(CASE WHEN param IN ('purchase','signup') THEN value END) / 0.9973 AS pm25 FROM readings GROUP BY 1, 2, 3),
 cpairs AS (SELECT rule, buffer_km, zero, {UNIT_CITY} AS city_id, geo_id, station_id, 1.0 / pow(distance_km, power) AS inv_d FROM unit_distances, {_rules(rules)} WHERE distance_km > 0 AND distance_km <= buffer_km),
 chourly AS (SELECT rule, buffer_km, zero, p.city_id, geo_id, datetime, {hours} FROM cpanel p JOIN cpairs w ON p.city_id = w.city_id AND p.station = w.station_id
   WHERE zero OR coalesce(pm10, pm25) IS NOT NULL GROUP BY rule, buffer_km, zero, p.city_id, geo_id, datetime),
 cexposure AS (SELECT rule, buffer_km, city_id, geo_id, CAST(year(datetime) AS INTEGER) AS year, {', '.join(cols)} FROM chourly GROUP BY 1, 2, 3, 4, 5),
 cpeople AS (SELECT *, {_groups('educ_years', 5, 'edu_quintile')}, {_groups('income', 10, 'inc_decile')} FROM (
   SELECT *, {_running('educ_years', 'edu_quintile')}, {_running('income', 'inc_decile')} FROM (SELECT *, {UNIT_CITY} AS city_id FROM people WHERE adult = 1)))"""


BUFFERS = [("3.0", 3, 1, False), ("5.0", 5, 1, False)]


def _cells(outcomes: list[str]) -> str:
    long = " UNION ALL ".join(
        f"SELECT city_id, geo_id, year, buffer_km, '{c}' AS col, '{'avg' if c.startswith('avg') else 'hrs_d_' + c[-3:]}' AS outcome, '{'pm10' if 'pm10' in c else 'pm25'}' AS pollutant, CAST({c} AS DOUBLE) AS y FROM cexposure" for c in outcomes)
    wanted = ", ".join(f"('{r.city}', '{r.city_id}', {r.year}, {r.buffer_km}.0, '{r.socioeconomic_var}', '{runs.GROUP_TYPES[r.n_groups]}', '{r.group_col}', {r.n_groups})" for r in RUNS)
    return f""", wanted AS (SELECT * FROM (VALUES {wanted}) v(city, city_id, year, buffer_km, socioeconomic_var, group_type, group_col, base)),
 pops AS (SELECT city_id, 'edu_quintile' AS group_col, geo_id, edu_quintile AS grp, sum(person_weight) AS pop FROM cpeople WHERE edu_quintile IS NOT NULL GROUP BY 1, 3, 4
   UNION ALL SELECT city_id, 'inc_decile', geo_id, inc_decile, sum(person_weight) FROM cpeople WHERE inc_decile IS NOT NULL GROUP BY 1, 3, 4),
 lng AS ({long}),
 cell AS (SELECT w.*, col, outcome, pollutant, l.geo_id, grp, pop, y FROM wanted w JOIN lng l ON l.city_id = w.city_id AND l.year = w.year AND l.buffer_km = w.buffer_km
   JOIN pops p ON p.city_id = w.city_id AND p.group_col = w.group_col AND p.geo_id = l.geo_id WHERE y IS NOT NULL)"""


LABELS = "city, city_id, CAST(year AS INTEGER) AS year, CAST(buffer_km AS DOUBLE) AS buffer_km, socioeconomic_var, group_type"
MODEL = "city, city_id, year, buffer_km, socioeconomic_var, group_type, group_col, base, col"


def stacked(s, d):
    return runs.exposure_runs(*tables(s, d), RUNS, conf_level=None)


@query("K8_city_summaries", _base(BUFFERS) + _cells(qe.OUTCOMES) + f""", ran AS (SELECT *, sum(pop) OVER (PARTITION BY {MODEL}, grp ORDER BY y, geo_id ROWS UNBOUNDED PRECEDING) / sum(pop) OVER (PARTITION BY {MODEL}, grp) AS sh FROM cell)
 SELECT {LABELS}, group_col, outcome, pollutant, grp AS "group", round(sum(pop * y) / sum(pop), 6) AS weighted_mean, round(min(CASE WHEN sh >= 0.5 THEN y END), 6) AS weighted_median,
  sum(pop) AS weighted_population, count(*) AS n_geo_group_cells, count(DISTINCT geo_id) AS n_geo_units FROM ran GROUP BY {MODEL}, outcome, pollutant, grp""")
def _(s, d):
    return t.rnd(stacked(s, d)["summary"])


def _fit() -> str:
    return _base(BUFFERS) + _cells(qe.CI_OUTCOMES) + f""", bm AS (SELECT {MODEL}, sum(pop * y) / sum(pop) AS b FROM cell WHERE grp = base GROUP BY ALL),
 z AS (SELECT cell.*, y / b AS yy, pop / sum(pop) OVER (PARTITION BY {', '.join('cell.' + c for c in MODEL.split(', '))}, grp) AS w FROM cell JOIN bm USING ({MODEL}) WHERE b <> 0),
 mu AS (SELECT {MODEL}, grp, sum(w * yy) / sum(w) AS m FROM z GROUP BY ALL),
 e AS (SELECT z.*, yy - m AS e FROM z JOIN mu USING ({MODEL}, grp)),
 tot AS (SELECT {MODEL}, outcome, pollutant, CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT geo_id) AS DOUBLE) AS g_n, count(DISTINCT grp) AS k FROM e GROUP BY ALL),
 sc AS (SELECT {MODEL}, geo_id, grp, sum(w * e) AS s FROM e GROUP BY ALL),
 ks AS (SELECT DISTINCT {MODEL}, geo_id, g.grp FROM e JOIN (SELECT DISTINCT {MODEL}, grp FROM mu) g USING ({MODEL})),
 va AS (SELECT {MODEL}, grp, sum(pow(coalesce(a, 0) - coalesce(b, 0), 2)) AS v FROM (
   SELECT ks.*, x.s AS a, o.s AS b FROM ks LEFT JOIN sc x USING ({MODEL}, geo_id, grp) LEFT JOIN (SELECT {MODEL}, geo_id, s FROM sc WHERE grp = base) o USING ({MODEL}, geo_id)) GROUP BY ALL),
 fin AS (SELECT tot.*, va.grp, v, mg.m - mb.m AS est FROM tot JOIN va USING ({MODEL}) JOIN mu mg USING ({MODEL}, grp) LEFT JOIN (SELECT {MODEL}, m FROM mu WHERE grp = base) mb USING ({MODEL}) WHERE n >= k)
 """


@query("K8_city_regressions", _fit() + f"""SELECT {LABELS}, group_col, CAST(base AS INTEGER) AS base_group, outcome, pollutant, grp AS "group", round(CASE WHEN grp = base THEN 0 ELSE est END, 6) AS estimate,
  round(CASE WHEN grp = base THEN 0 WHEN g_n > k THEN sqrt(g_n / (g_n - 1) * (n - 1) / nullif(n - k, 0) * v) END, 6) AS std_error, CAST(n AS BIGINT) AS n_units, CAST(g_n AS BIGINT) AS n_clusters,
  CAST(k AS INTEGER) AS n_coef, 'geo_group' AS regression_unit, 'cluster_geo' AS se_type, true AS normalized FROM fin""")
def _(s, d):
    return t.rnd(stacked(s, d)["ci"])


@query("K8_city_coverage", _fit().rstrip() + f""", used AS (SELECT city_id, socioeconomic_var, pollutant, CAST(max(g_n) AS BIGINT) AS n_clusters, CAST(max(n) AS BIGINT) AS n_units, CAST(max(k) AS INTEGER) AS n_coef FROM tot GROUP BY ALL),
 gp AS (SELECT city_id, group_col, geo_id, sum(pop) AS pop FROM pops GROUP BY ALL),
 ce AS (SELECT w.*, geo_id, avg_pm10, avg_pm25 FROM wanted w JOIN cexposure USING (city_id, year, buffer_km)),
 cl AS (SELECT * FROM ce UNPIVOT (y FOR what IN (avg_pm10, avg_pm25))),
 cov AS (SELECT {LABELS}, group_col, replace(what, 'avg_', '') AS pollutant, count(DISTINCT geo_id) AS n_geo_pollutant, count(DISTINCT gp.geo_id) AS n_geo_estimation, sum(gp.pop) AS pop_estimation
   FROM cl LEFT JOIN gp USING (city_id, group_col, geo_id) GROUP BY ALL)
 SELECT cov.* EXCLUDE (group_col), (SELECT count(DISTINCT geo_id) FROM ce x WHERE x.city_id = cov.city_id AND x.buffer_km = cov.buffer_km AND x.group_col = cov.group_col) AS n_geo_exposure,
  (SELECT count(DISTINCT geo_id) FROM cpairs x WHERE x.city_id = cov.city_id AND x.buffer_km = cov.buffer_km) AS n_geo_in_buffer,
  (SELECT count(DISTINCT station_id) FROM cpairs x WHERE x.city_id = cov.city_id AND x.buffer_km = cov.buffer_km) AS n_station_in_buffer,
  (SELECT count(*) FROM embeddings WHERE (vec_id % 2 = 0) = (cov.city_id = 'north')) AS n_geo_metro, (SELECT count(*) FROM nation WHERE n_nationkey IN (SELECT vec_id % 25 FROM embeddings)) AS n_station_metro,
  pm AS pop_metro, round(pop_estimation / pm, 6) AS share_pop_estimation, n_clusters, n_units, n_coef
 FROM cov JOIN (SELECT city_id, sum(person_weight) AS pm FROM cpeople GROUP BY 1) USING (city_id) LEFT JOIN used USING (city_id, socioeconomic_var, pollutant)""")
def _(s, d):
    return t.rnd(stacked(s, d)["coverage"])


STEPS = [("three", 3, 1, False), ("five", 5, 1, False), ("five_zero", 5, 1, True), ("five_square", 5, 2, False)]


@query("K16_city_progression", _base(STEPS) + """, gg AS (SELECT city_id, geo_id, edu_quintile, sum(person_weight) AS w FROM cpeople WHERE edu_quintile IS NOT NULL GROUP BY 1, 2, 3),
 dom AS (SELECT city_id, geo_id, edu_quintile, pop_w FROM (SELECT *, sum(w) OVER (PARTITION BY geo_id) AS pop_w, row_number() OVER (PARTITION BY geo_id ORDER BY w DESC, edu_quintile) AS r FROM gg) WHERE r = 1),
 dd AS (SELECT rule, geo_id, CAST(datetime AS DATE) AS day, count(*) FILTER (pm25 >= 75) AS a FROM chourly WHERE pm25 IS NOT NULL GROUP BY 1, 2, 3),
 dm AS (SELECT rule, geo_id, count(*) FILTER (a >= 1) AS d1, count(*) FILTER (a >= 2) AS d2 FROM dd GROUP BY 1, 2)
 SELECT rule AS step_id, x.city_id, edu_quintile, 'pm25' AS pollutant, count(*) AS n_geo, round(sum(avg_pm25 * pop_w) / sum(pop_w), 6) AS weighted_mean_conc,
  round(sum(hrs_d_pm25_it1) / greatest(sum(total_hrs_pm25), 1), 6) AS share_hrs_above_it1, round(sum(hrs_d_pm25_it4) / greatest(sum(total_hrs_pm25), 1), 6) AS share_hrs_above_it4,
  round(sum(d1 * pop_w) / sum(CASE WHEN d1 IS NOT NULL THEN pop_w END), 6) AS days_with_hr_above_it1, round(sum(d2 * pop_w) / sum(CASE WHEN d2 IS NOT NULL THEN pop_w END), 6) AS days_with_2hr_above_it1
 FROM cexposure x JOIN dom USING (geo_id) LEFT JOIN dm USING (rule, geo_id) WHERE avg_pm25 IS NOT NULL GROUP BY rule, x.city_id, edu_quintile""")
def _(s, d):
    panel, pairs, people, _, _ = tables(s, d)
    dom = _of_unit(cp.dominant_group(people, "edu_quintile"))
    return t.rnd(runs.progression_tables(panel, pairs, dom, RULES, "pm25"))
