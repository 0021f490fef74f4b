import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from airgrid.operators.ordered import assign_groups
from airgrid.plans import exposure as ex

DIST = [("g1", "s1", 1.0), ("g1", "s2", 2.0), ("g1", "s3", 4.0), ("g2", "s1", 1.0), ("g2", "s2", 1.0), ("g2", "s3", 2.0), ("g3", "s1", 0.0)]
T = [dt.datetime(2023, 1, 1, h) for h in range(3)]
ROWS = [("s1", T[0], 60.0), ("s2", T[0], 120.0), ("s3", T[0], 300.0), ("s1", T[1], 40.0), ("s2", T[1], None), ("s3", T[1], 60.0),
        ("s1", T[2], None), ("s2", T[2], None), ("s3", T[2], None)]


@pytest.fixture(scope="module")
def toy(spark):
    d = spark.createDataFrame(DIST, "geo_id string, station_id string, distance_km double")
    p = spark.createDataFrame(ROWS, "station string, datetime timestamp_ntz, pm10 double").withColumn("year", F.lit(2023))
    return d, p


@pytest.mark.parametrize("bound", [500_000, 0])
def test_golden_exposure(toy, bound):
    d, p = toy
    hourly = ex.hourly_idw(p, d, ["pm10"], 3, max_broadcast_rows=bound, salts=3)
    got = {r.geo_id: r for r in ex.annual_exposure(hourly, ["pm10"]).collect()}
    assert set(got) == {"g1", "g2"}
    assert got["g1"].avg_pm10 == pytest.approx(60)
    assert got["g2"].avg_pm10 == pytest.approx((132 + 70 / 1.5) / 2)
    assert [got["g1"][f"hrs_d_pm10_it{k}"] for k in (1, 2, 3, 4)] == [0, 0, 1, 1]
    assert [got["g2"][f"hrs_d_pm10_it{k}"] for k in (1, 2, 3, 4)] == [0, 1, 1, 1]
    assert got["g1"].total_hrs_pm10 == got["g2"].total_hrs_pm10 == 2
    assert ex.zero_distances(d).first().n_zero == 1


def test_year_selection_and_missing_rule(toy):
    d, p = toy
    assert ex.idw_exposure(p, d, ["pm10"], 3, years=[2022]).count() == 0
    zero = {(r.geo_id, r.datetime.hour): r.pm10 for r in ex.hourly_idw(p, d, ["pm10"], 3, missing="zero").collect()}
    assert zero[("g1", 1)] == pytest.approx(40 / 1.5)
    assert zero[("g1", 2)] == 0


def test_absent_pollutant_for_a_unit_is_null(spark):
    d = spark.createDataFrame([("a", "s1", 1.0), ("b", "s2", 1.0)], "geo_id string, station_id string, distance_km double")
    p = spark.createDataFrame([("S1", T[0], 5.0, None), ("S2", T[0], None, 7.0)], "station string, datetime timestamp_ntz, pm10 double, pm25 double")
    got = {r.geo_id: r for r in ex.idw_exposure(p, d, buffer_km=3).collect()}
    assert got["a"].avg_pm25 is None and got["a"].total_hrs_pm25 is None and got["a"].hrs_d_pm25_it1 is None
    assert got["b"].avg_pm10 is None and got["b"].avg_pm25 == 7.0


@pytest.fixture(scope="module")
def scattered(spark):
    """40 units within reach of some of 6 stations, 90 hours over five days with gaps; an unnamed station and an unknown hour."""
    draw = random.Random(3)
    start = dt.datetime(2023, 12, 29)
    value = lambda gap: None if draw.random() < gap else draw.uniform(1, 200)
    panel = [(f"s{k}", start + dt.timedelta(hours=h), value(0.2), value(0.5)) for k in range(6) for h in range(90) if draw.random() < 0.9]
    panel += [("s1", None, 5.0, 6.0), (None, start, 7.0, 8.0)]
    pairs = [(f"g{u}", f"S{k}", draw.uniform(0.5, 7)) for u in range(40) for k in range(6)] + [("g1", None, 1.0), ("g2", "s9", 1.0), (None, "s1", 1.0)]
    return (spark.createDataFrame(panel, "station string, datetime timestamp_ntz, pm10 double, pm25 double"),
            spark.createDataFrame(pairs, "geo_id string, station_id string, distance_km double"))


def hours_by_hand(panel, pairs, buffer, missing):
    sums, near = {}, pairs.collect()
    for r in panel.collect():
        for g, s, d in near:
            if s and r.station and s.upper() == r.station.upper() and d <= buffer and (missing == "zero" or r.pm10 is not None or r.pm25 is not None):
                at = sums.setdefault((g, r.datetime), [0, 0, 0, 0])
                for k, x in enumerate((r.pm10, r.pm25)):
                    if x is not None or missing == "zero":
                        at[2 * k] += (x or 0) / d
                        at[2 * k + 1] += 1 / d
    return {key: (v[0] / v[1] if v[1] else None, v[2] / v[3] if v[3] else None) for key, v in sums.items()}


@pytest.mark.parametrize("missing", ["drop", "zero"])
@pytest.mark.parametrize("way", ["pairs", "readings", "tiles"])
def test_sums_of_the_fan_out_are_never_shuffled(spark, scattered, way, missing, monkeypatch):
    panel, pairs = scattered
    # Readings are fewer than the pairs in one case, so that they are what is sent to the others.
    monkeypatch.setattr(ex, "PAIRS_PER_SLICE", 50, raising=False)
    monkeypatch.setattr(ex, "PAIRS_PER_TASK", 50, raising=False)
    if way == "readings":
        panel = panel.where("coalesce(day(datetime), 30) = 30 AND coalesce(hour(datetime), 0) < 12")
    bound = {"pairs": 1_000, "readings": 80, "tiles": 0}[way]
    hourly = ex.hourly_idw(panel, pairs, ["pm10", "pm25"], 5, missing=missing, max_broadcast_rows=bound, salts=3)
    plan = hourly._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan
    got = {(r.geo_id, r.datetime): (r.pm10, r.pm25) for r in hourly.collect()}
    want = hours_by_hand(panel, pairs, 5, missing)
    assert hourly.columns == ["geo_id", "datetime", "pm10", "pm25"] and set(got) == set(want) and len(want) > 400
    for key, pair in want.items():
        assert got[key] == pytest.approx(pair)
    if way == "readings":
        days = ex.day_metrics(hourly, "pm25", {"it1": 75.0})._jdf.queryExecution().executedPlan().toString()
        assert days.count("Exchange hashpartitioning") == 1, days


def groups(spark, rows, n, shuffle=False, partitions=None):
    rows = [(i, *r) for i, r in enumerate(rows)]
    if shuffle:
        random.Random(20260808).shuffle(rows)
    df = spark.createDataFrame(rows, "row_key long, geo_id string, val double, w double")
    out = assign_groups(df, "val", "w", n, "g", ["geo_id", "row_key"], partitions).collect()
    return {r.geo_id: r.g for r in out}


FIFTHS = [(f"u{i:02d}", float(i), 1.0) for i in range(1, 11)]


def test_groups(spark):
    assert list(groups(spark, FIFTHS, 5).values()) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5] or sorted(groups(spark, FIFTHS, 5).items()) == [
        (f"u{i:02d}", (i + 1) // 2) for i in range(1, 11)]
    assert groups(spark, [("a", 1.0, 2.0), ("b", 2.0, 1.0), ("c", 3.0, 1.0)], 2) == {"a": 1, "b": 2, "c": 2}
    ties = [(x, 5.0, 1.0) for x in "faebdc"] + [("g", 9.0, 1.0), ("h", 9.0, 1.0)]
    want = {**{x: 1 for x in "abcd"}, **{x: 2 for x in "efgh"}}
    assert groups(spark, ties, 2) == want
    assert groups(spark, ties, 2, shuffle=True) == want
    nulls = groups(spark, FIFTHS + [("x", None, 1.0), ("y", 99.0, None)], 5)
    assert nulls.pop("x") is None and nulls.pop("y") is None and nulls == groups(spark, FIFTHS, 5)


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_groups_do_not_depend_on_partitions(spark, partitions):
    rng = random.Random(1)
    # One value holds a third of all rows.
    rows = [(f"g{rng.randrange(40):02d}", 12.0 if rng.random() < 0.34 else float(rng.randrange(20)), float(rng.randrange(1, 6))) for _ in range(3000)]
    keyed = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(keyed, "row_key long, geo_id string, val double, w double")
    got = {r.row_key: r.g for r in assign_groups(df, "val", "w", 5, "g", ["geo_id", "row_key"], partitions).collect()}
    total, run, want = sum(r[3] for r in keyed), 0.0, {}
    for key, _, _, w in sorted(keyed, key=lambda r: (r[2], r[1], r[0])):
        run += w
        want[key] = 1 + sum(run / total > k / 5 for k in range(1, 5))
    assert got == want
