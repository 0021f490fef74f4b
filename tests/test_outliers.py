"""Outlier rules against a plain-Python reading of them."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from airgrid.plans import outliers as ol

HOUR = dt.timedelta(hours=1)


def brute(rows, pairs, temporal="continue", second=True, with_data=True, n_sd=2.0):
    """{(station, hour): (reason, counts)} for one pollutant; rows are (station, hour, value)."""
    val = {(s, t): v for s, t, v in rows}
    out = {}
    for year in sorted({t.year for _, t in val}):
        hours = sorted(t for _, t in val if t.year == year)
        stations = sorted({s for s, t in val if t.year == year})
        grid, t = [], hours[0]
        while t <= hours[-1]:
            grid.append(t)
            t += HOUR
        has = {s for s, t in val if t.year == year and val[(s, t)] is not None}
        near = {}
        for s in stations:
            cand = sorted((d, b) for a, b, d in pairs if a == s and d > 0 and (not with_data or (s in has and b in has)))
            near[s] = [b for _, b in cand[:2]] + [None, None]
        get = lambda s, t: val.get((s, t)) if s is not None else None
        diff = lambda a, b: None if a is None or b is None else a - b
        for s in stations:
            for month in sorted({g.month for g in grid}):
                cell = [g for g in grid if g.month == month]
                v = {g: get(s, g) for g in cell}
                lag, lead = {g: get(s, g - HOUR) for g in cell}, {g: get(s, g + HOUR) for g in cell}
                d0 = {g: diff(v[g], lag[g]) for g in cell}
                dn = [{g: diff(v[g], get(near[s][i], g)) for g in cell} for i in (0, 1)]
                if not second:
                    dn[1] = dict.fromkeys(cell)
                stat = lambda d: (lambda x: (np.mean(x) if x else None, np.std(x, ddof=1) if len(x) > 1 else None))([y for y in d.values() if y is not None])
                (m, sd), (m1, s1), (m2, s2) = stat(d0), stat(dn[0]), stat(dn[1])
                known = [x for x in v.values() if x is not None]
                top = np.quantile(known, 0.99) if known else None
                flagged = {g for g in cell if v[g] is not None and v[g] > top}
                counts = (len(flagged) if sd is None else 0, len(flagged) if sd == 0 else 0, len(flagged) if s1 is None and s2 is None else 0,
                          len(flagged) if s1 == 0 or s2 == 0 else 0)
                for g in cell:
                    reason = 0
                    if g in flagged:
                        b = [x for x in (lag[g], lead[g]) if x is not None]
                        kind = 3 if not b else (1 if sd is not None and m - n_sd * sd < v[g] - np.mean(b) < m + n_sd * sd else 2)
                        feas = [dn[0][g] is not None and s1 is not None, dn[1][g] is not None and s2 is not None]
                        ok = [feas[0] and m1 - n_sd * s1 < dn[0][g] < m1 + n_sd * s1, feas[1] and m2 - n_sd * s2 < dn[1][g] < m2 + n_sd * s2]
                        used = 0 if feas[0] else (1 if feas[1] else None)
                        if used is not None and ok[used] and (kind == 2 or (kind == 3 and temporal == "continue")):
                            kind = 1
                        if kind == 3 and temporal == "finish":
                            reason = 1
                        elif kind > 1:
                            reason = {(3, True): 1, (2, True): 2, (2, False): 3, (3, False): 4}[(kind, used is None)]
                    out[(s, g)] = (reason, *counts)
    return out


def fixture(seed=1):
    rng = random.Random(seed)
    rows, start = [], dt.datetime(2022, 12, 28)
    for s in ("A", "B", "C", "D"):
        for h in range(240):
            r = rng.random()
            if r < 0.12:
                continue
            v = None if r < 0.25 or (s == "D" and h < 96) else round(20 + 5 * rng.random() + (60 if rng.random() < 0.03 else 0), 2)
            rows.append((s, start + h * HOUR, v))
    names = "ABCD"
    pairs = [(a, b, abs(names.index(a) - names.index(b)) + 0.1 * names.index(b)) for a in names for b in names if a != b] + [(a, a, 0.0) for a in names]
    return rows, pairs


OPTIONS = [("continue", "second", "with_data"), ("finish", "second", "with_data"), ("continue", "finish", "with_data"), ("continue", "second", "all")]


@pytest.mark.parametrize("temporal,neighbor,elig", OPTIONS)
def test_rules_across_a_year_end(spark, temporal, neighbor, elig):
    rows, pairs = fixture()
    panel = spark.createDataFrame(rows, "station string, datetime timestamp_ntz, pm10 double").withColumn("year", F.year("datetime"))
    dist = spark.createDataFrame(pairs, "station_from string, station_to string, distance_km double")
    flags = ol.flag_long(panel, dist, ["pm10"], on_missing_temporal=temporal, on_missing_neighbor=neighbor, neighbor_eligibility=elig).collect()
    got = {(r.station, r.datetime): (r.outlier_reason, r.n_missing_temporal_sd, r.n_zero_temporal_sd, r.n_missing_spatial_sd, r.n_zero_spatial_sd) for r in flags}
    want = brute(rows, pairs, temporal, neighbor == "second", elig == "with_data")
    assert got == want
    assert sum(v[0] > 0 for v in want.values()) > 3


def test_clean_panel_keeps_other_columns_and_averages_duplicates(spark):
    t = dt.datetime(2023, 5, 1)
    panel = spark.createDataFrame([("são a", t, 10.0, 1.0), ("SAO A", t, 20.0, 1.0), ("B", t, 5.0, 2.0)], "station string, datetime timestamp_ntz, pm10 double, temp double")
    dist = spark.createDataFrame([("SAO A", "B", 1.0), ("B", "SAO A", 1.0)], "station_from string, station_to string, distance_km double")
    got = {r.station: r for r in ol.detect_outliers(panel, dist, ["pm10"]).collect()}
    assert got["SAO A"].pm10 == 15.0 and got["SAO A"].temp == 1.0 and got["B"].pm10_outlier == 0


def test_unknown_option(spark):
    rows, pairs = fixture()
    with pytest.raises(ValueError):
        ol.flag_long(spark.createDataFrame(rows, "station string, datetime timestamp_ntz, pm10 double"), None, ["pm10"], on_missing_temporal="skip")
