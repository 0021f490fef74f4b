"""Runs of several cities in one plan, censuses from specifications, repaired unit ids."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from airgrid.operators import ordered
from airgrid.plans import exposure as ex
from airgrid.plans import harmonise as hm
from airgrid.plans import regress as rg
from airgrid.plans import runs

POLS = ["pm10", "pm25"]


def city(seed):
    """A city's panel, pairs, people and units; stations and units have the same names in every city."""
    draw = random.Random(seed)
    start = dt.datetime(2023, 1, 1)
    panel = [(f"s{k}", start + dt.timedelta(hours=h), None if draw.random() < 0.2 else draw.uniform(20, 160), None if draw.random() < 0.4 else draw.uniform(10, 90)) for k in range(4) for h in range(60)]
    pairs = [(f"g{u}", f"S{k}", draw.choice([0.0, draw.uniform(0.5, 7)])) for u in range(12) for k in range(4)]
    people = [(f"g{u % 12}", k, draw.uniform(0, 20), float(draw.randrange(1, 5)), 1) for k, u in enumerate(range(240))]
    return panel, pairs, people, [(f"g{u}",) for u in range(12)]


@pytest.fixture(scope="module")
def cities(spark):
    shapes = ("station string, datetime timestamp_ntz, pm10 double, pm25 double", "geo_id string, station_id string, distance_km double", "geo_id string, row_key long, educ_years double, person_weight double, adult int", "geo_id string")
    return {name: [spark.createDataFrame(rows, shape) for rows, shape in zip(city(seed), shapes, strict=True)] for name, seed in (("a", 1), ("b", 2))}


def test_rules_in_tiles_equal_rules_by_broadcast(cities, monkeypatch):
    panel, pairs = (runs.from_cities({c: t[k] for c, t in cities.items()}) for k in range(2))
    rules = [runs.Rule("three", 3), runs.Rule("five_zero", 5, missing="zero")]
    rows = lambda df: {(r.rule, r.city_id, r.geo_id, r.day): (r.n_pm10, r.n_pm25, r.sum_pm10 or 0, r.sum_pm25 or 0) for r in df.collect()}
    want = rows(runs.daily_by_rule(panel, pairs, POLS, rules))
    monkeypatch.setattr(runs, "BROADCAST_ROWS", 0, raising=False)
    monkeypatch.setattr(runs, "fan_out", lambda *a, **k: ex.fan_out(*a, **{**k, "max_broadcast_rows": 0}), raising=False)
    monkeypatch.setattr(ex, "PAIRS_PER_SLICE", 20, raising=False)
    days = runs.daily_by_rule(panel, pairs, POLS, rules, salts=2)
    plan = days._jdf.queryExecution().executedPlan().toString()
    got = rows(days)
    assert set(got) == set(want) and len(want) > 60
    for key, row in want.items():
        assert got[key] == pytest.approx(row)
    # The tiles, and days; not the fan-out.
    assert plan.count("Exchange hashpartitioning") == 2, plan


def test_runs_equal_one_city_at_a_time(spark, cities):
    panel, pairs, people, units = (runs.from_cities({c: t[k] for c, t in cities.items()}) for k in range(4))
    people = runs.city_groups(people, "educ_years", "person_weight", 5, "edu_quintile", ["geo_id", "row_key"])
    stations = pairs.select("city_id", "station_id").distinct()
    wanted = [runs.Run(c.upper(), c, 2023, b, "education", "edu_quintile", 5) for c in cities for b in (3, 5)]
    got = runs.exposure_runs(panel, pairs, people, units, stations, wanted)
    tables = {k: v.collect() for k, v in got.items()}
    for c, (own_panel, own_pairs, own_people, own_units) in cities.items():
        grouped = ordered.assign_groups(own_people, "educ_years", "person_weight", 5, "edu_quintile", ["geo_id", "row_key"])
        for b in (3, 5):
            exposure = ex.idw_exposure(own_panel, own_pairs, POLS, b)
            mine = lambda rows: [r for r in rows if r.city_id == c and r.buffer_km == b]  # noqa: B023, E731
            summary = {(r.outcome, r.pollutant, r.group): r for r in rg.exposure_summaries(exposure, grouped).collect()}
            assert {(r.outcome, r.pollutant, r.group) for r in mine(tables["summary"])} == set(summary)
            for r in mine(tables["summary"]):
                want = summary[r.outcome, r.pollutant, r.group]
                for name in ("weighted_mean", "weighted_median", "weighted_population", "n_geo_group_cells", "n_geo_units"):
                    assert r[name] == pytest.approx(want[name])
            fits = {(r.outcome, r.pollutant, r.group): r for r in rg.exposure_regressions(exposure, grouped).collect()}
            assert {(r.outcome, r.pollutant, r.group) for r in mine(tables["ci"])} == set(fits)
            for r in mine(tables["ci"]):
                want = fits[r.outcome, r.pollutant, r.group]
                for name in ("estimate", "std_error", "ci_low", "ci_high", "n_units", "n_clusters", "n_coef"):
                    assert r[name] == pytest.approx(want[name], abs=1e-9)
            cover = {r.pollutant: r for r in rg.exposure_coverage(exposure, grouped, own_pairs, own_units, own_pairs.select("station_id").distinct(), buffer_km=b).collect()}
            for r in mine(tables["coverage"]):
                assert all(r[n] == pytest.approx(cover[r.pollutant][n]) for n in ("n_geo_metro", "n_station_metro", "n_geo_in_buffer", "n_station_in_buffer", "n_geo_exposure", "n_geo_pollutant", "n_geo_estimation", "pop_metro", "pop_estimation"))
    with pytest.raises(ValueError):
        runs.run_table(spark, [wanted[0], wanted[0]])
    assert set(runs.result_tables(got)) == {"ci_estimates_education", "group_summaries_education", "ci_estimates_income", "group_summaries_income", "coverage"}


def test_rules_equal_single_runs(cities):
    panel, pairs = (runs.from_cities({c: t[k] for c, t in cities.items()}) for k in range(2))
    rules = [runs.Rule("near", 3), runs.Rule("far", 6, power=2.0), runs.Rule("zero", 5, missing="zero")]
    got = {(r.rule, r.city_id, r.geo_id): r for r in runs.annual_by_rule(runs.daily_by_rule(panel, pairs, POLS, rules), POLS).collect()}
    want = {}
    for c, (own_panel, own_pairs, *_) in cities.items():
        for rule in rules:
            for r in ex.idw_exposure(own_panel, own_pairs, POLS, rule.buffer_km, rule.power, missing=rule.missing).collect():
                want[rule.label, c, r.geo_id] = r
    assert set(got) == set(want)
    for key, r in got.items():
        for name in want[key].asDict():
            if name != "geo_id":
                assert r[name] == pytest.approx(want[key][name])


def test_panel_is_read_once(spark, cities, tmp_path):
    panel, pairs = (runs.from_cities({c: t[k] for c, t in cities.items()}) for k in range(2))
    panel.write.parquet(str(tmp_path / "panel"))
    stored = spark.read.parquet(str(tmp_path / "panel"))
    days = runs.daily_by_rule(stored, pairs, POLS, [runs.Rule(str(b), b) for b in (1, 2, 3, 4, 5)])
    plan = runs.annual_by_rule(days, POLS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1


def test_overwriting_rules_keep_their_order(spark):
    rules = [hm.Overwrite("a < 5", "1"), hm.Overwrite("b = 1", "2", clears=True), hm.Overwrite("a = 3", "null"), hm.Overwrite("a = 4", "a * 10")]
    rows = spark.createDataFrame([(0, 0), (0, 1), (3, 1), (4, 0), (1, None), (4, None), (9, 0), (None, 1), (None, None)], "a int, b int")
    assert [r.v for r in rows.withColumn("v", hm.overwritten(rules)).collect()] == [1.0, 2.0, None, 40.0, None, 40.0, None, 2.0, None]


def test_unknown_age_is_no_adult_and_zones_filter(spark):
    rows = [("9", str(k % 3 + 2), "3", "101", "1", age, "10", income, "2", "12", "3", "1") for k, (age, income) in enumerate([("30", "100"), ("20", "0"), ("999", "50"), ("40", ""), ("60", "900")])]
    raw = spark.createDataFrame(rows, "ENT string, MUN string, SEXO string, PARENTESCO string, PERTE_INDIGENA string, EDAD string, CONACT string, INGTRMEN string, FACTOR string, ESCOACUM string, NIVACAD string, ESCOLARI string")
    got = hm.harmonise(raw, hm.MEXICO_2020).collect()
    assert [r.adult for r in got] == [1, 0, None, 1, 1] and [r.income_raw for r in got] == [100.0, 0.0, 50.0, None, 900.0]
    assert {r.educ_years for r in got} == {12.0} and {(r.women, r.hh_head, r.hh_head_women, r.indigena, r.employed) for r in got} == {(1, 1, 1, 1, 1)}
    some = hm.harmonise(raw, hm.MEXICO_2020, ["09002"])
    assert {r.geo_id for r in some.collect()} == {"09002"}
    units = {r.geo_id: r for r in hm.collapse(hm.harmonise(raw, hm.MEXICO_2020), hm.MEXICO_2020).collect()}
    assert units["09002"].n_records == 2 and units["09002"].share_hs_com_pop == 1.0 and units["09003"].pop_total == 2.0


def test_run_repairs_ids_that_lost_zeros(spark, cities):
    panel, pairs, people, _ = cities["a"]
    code = lambda c: F.lpad(F.substring(c, 2, 3), 5, "0")
    people = people.withColumn("geo_id", code("geo_id"))
    bare = pairs.withColumn("geo_id", F.when(F.col("geo_id") == "g3", "77777").otherwise(code("geo_id").cast("int").cast("string")))
    units = people.groupBy("geo_id").agg(F.sum("person_weight").alias("pop_total"), F.avg("educ_years").alias("education_mean"))
    got = ex.repaired_city_run(panel, bare, people, units, buffer_km=5)
    report, ids = got["report"].first(), {r.geo_id for r in got["exposure"].select("geo_id").collect()}
    assert report.n_unmatched == ("77777" in ids) and all(len(i) == 5 for i in ids)
    assert report.n_units == len(ids) == report.n_matched_as_is + report.n_repaired_left + report.n_repaired_right + report.n_repaired_strip + report.n_unmatched
    assert report.n_rows == 240 == report.n_adults
