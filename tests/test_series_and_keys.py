import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from airgrid.functions import keys
from airgrid.functions import times as tm
from airgrid.operators import identifiers as ids
from airgrid.plans import compare as cp
from airgrid.plans import impute as im
from airgrid.plans import series as se

D = dt.date(2023, 1, 1)


def hours(spark, values):
    rows = [("c", D + dt.timedelta(days=i // 24), i % 24, v) for i, v in enumerate(None if v is None else float(v) for v in values)]
    return spark.createDataFrame(rows, "city string, date date, hour int, v double")


def test_runs_end_at_null_and_stay_open(spark):
    got = {(r.hour, r.time_span_above_target) for r in se.runs_above(hours(spark, [80, 75, None, 90, 10, 75, 99, 80]), "v", 75.0, ["city"]).collect()}
    assert got == {(0, 2), (3, 1), (5, 3)}


def test_running_mean_needs_24_values(spark):
    vals = [float(i) for i in range(30)]
    vals[3] = None
    got = [r.m for r in se.running_mean_24(hours(spark, vals), "v", "m", ["city"]).orderBy("date", "hour").collect()]
    assert got[:27] == [None] * 27 and got[27] == pytest.approx(np.mean(vals[4:28]))


def test_key_functions(spark):
    df = spark.createDataFrame([(' "São José" ', "09 : Ñuñoa", 1e5)], "s string, c string, g double")
    code, name = keys.split_code_name("c")
    r = df.select(keys.normalize_station("s").alias("a"), keys.normalize_key("s").alias("b"), keys.slug("s").alias("c"), code.alias("d"), name.alias("e"),
                  keys.safe_text(df, "g").alias("f"), keys.pad_left(F.lit("1234567"), 5).alias("g")).first()
    assert tuple(r) == ("SAO JOSE", "SAOJOSE", "SAO_JOSE", "09", "Ñuñoa", "100000", "1234567")


def test_clock_functions(spark):
    df = spark.createDataFrame([("31-12-2023 24:00", "bad")], "a string, b string")
    r = df.select(tm.parse_with_hour_24("a").alias("a"), tm.parse_with_hour_24("b").alias("b"), tm.clamp_hour(F.lit("24")).alias("c"),
                  tm.date_plus_hour(F.lit("2023-12-31").cast("date"), F.lit(24)).alias("d"), tm.hours_in_year(F.lit(2024)).alias("e")).first()
    assert tuple(r) == (dt.datetime(2024, 1, 1), None, 23, dt.datetime(2024, 1, 1), 8784)


def test_reconcile_rules(spark):
    census = spark.createDataFrame([(x,) for x in ("9002", "00017", "12300", "00123", "777")], "geo_id string")
    geo = spark.createDataFrame([(x,) for x in ("09002", "17", "123", "777", "555", "0777")], "geo_id string")
    got = {r.original: (r.repaired, r.rule) for r in ids.reconcile_ids(geo, census).collect()}
    assert got == {"09002": ("9002", "strip"), "17": ("00017", "left"), "123": ("123", None), "777": ("777", None), "555": ("555", None), "0777": ("777", "strip")}


def test_named_rules_alone_are_tried(spark):
    census = spark.createDataFrame([(x,) for x in ("12300", "00123", "90000", "4", "777")], "geo_id string")
    geo = spark.createDataFrame([(x,) for x in ("123", "9", "004", "777")], "geo_id string")
    got = lambda *rules: {r.original: (r.repaired, r.rule) for r in ids.reconcile_ids(geo, census, rules=rules).collect()}
    alone = {x: (x, None) for x in ("123", "9", "004", "777")}
    assert got("left") == {**alone, "123": ("00123", "left")} and got("strip") == {**alone, "004": ("4", "strip")} and got() == alone
    assert got("left", "right", "strip") == {**alone, "9": ("90000", "right"), "004": ("4", "strip")}
    with pytest.raises(ValueError):
        ids.reconcile_ids(geo, census, rules=["middle"])


def test_acronyms(spark):
    df = spark.createDataFrame([(x,) for x in ("Las Ferias", "Las Flores", "Usme", "El Alto Norte Sur", "Á")], "n string")
    got = {r.n: r.a for r in ids.acronyms(df, "n", "a").collect()}
    assert got == {"Las Ferias": "LA1", "Las Flores": "LA2", "Usme": "USM", "El Alto Norte Sur": "EAN", "Á": "AXX"}


def test_prefix_fallback_and_unmapped_population(spark):
    sc = spark.createDataFrame([("111111", 1, 10.0), ("111112", 4, 20.0), ("112000", 3, 30.0), ("999999", 5, 40.0)], "k string, q int, p double")
    u = spark.createDataFrame([("111111",), ("111113",), ("112999",), ("500000",)], "k string")
    out = ids.prefix_fallback(u, sc.select("k", "q"), "k", "q", [5, 3])
    assert {(r.k, r.q, r.key_used) for r in out.collect()} == {("111111", 1, "111111"), ("111113", 2, "11111"), ("112999", 3, "112"), ("500000", None, None)}
    r = ids.unmapped_population(sc, out, "k", "p", [5, 3]).first()
    assert (r.pop_total, r.pop_unmapped) == (100.0, 40.0)


def test_preferred_names_and_exclusion(spark):
    df = spark.createDataFrame([("1", "A"), ("1", "B"), ("1", None), ("2", "C"), (None, "D")], "station_code string, station string")
    assert {(r.station_code, r.station) for r in cp.prefer_names(df, {"1": "A"}).collect()} == {("1", "A"), ("1", None), ("2", "C"), (None, "D")}
    assert cp.exclude(df, ["1"]).count() == 2


def test_imputation_equals_least_squares(spark):
    rng = random.Random(9)
    start, rows, truth = dt.datetime(2023, 3, 1), [], {}
    for h in range(24 * 40):
        t = start + dt.timedelta(hours=h)
        a, b = rng.uniform(5, 50), rng.uniform(5, 50)
        c = 3 + 0.5 * a + 0.25 * b + 2 * (t.hour == 7) - 4 * (t.weekday() == 6)
        truth[t] = c
        rows += [("a", t, a), ("b", t, b), ("c", t, None if h % 9 == 4 else c)]
    p = spark.createDataFrame(rows, "station string, datetime timestamp_ntz, pm10 double").withColumn("year", F.year("datetime"))
    out = im.impute_ols(p, "pm10")
    filled = out.where("pm10_imputed_from IS NOT NULL").collect()
    assert len(filled) == sum(v is None for _, _, v in rows) and {r.station for r in filled} == {"c"}
    for r in filled:
        assert r.pm10 == pytest.approx(truth[r.datetime], abs=1e-6)
    assert {(r.year, r.n_imputed) for r in im.imputed_counts(out, "pm10").collect()} == {(2023, len(filled))}
    kept = {(r.station, r.datetime): r.pm10 for r in out.where("pm10_imputed_from IS NULL").collect()}
    assert all(kept[(s, t)] == v for s, t, v in rows if v is not None)


def test_pooled_imputation_fills_every_gap(spark):
    rng = random.Random(10)
    start, rows = dt.datetime(2023, 3, 1), []
    for h in range(24 * 20):
        t = start + dt.timedelta(hours=h)
        base = rng.uniform(5, 50)
        rows += [("a", t, base), ("b", t, base + 2), ("c", t, None if h % 7 == 3 else base + 5)]
    p = spark.createDataFrame(rows, "station string, datetime timestamp_ntz, pm10 double").withColumn("year", F.year("datetime"))
    out = im.impute_pooled(p, "pm10")
    assert out.where("pm10 IS NULL").count() == 0
    assert out.where("pm10_imputed_from = 'OLS_Legacy'").count() == sum(v is None for _, _, v in rows)


def plain_fit(y, columns):
    """Least squares by columns in order; dependent ones are left out."""
    kept, basis = [], []
    for k, c in enumerate(columns):
        r = c.copy()
        for _ in range(2):
            for q in basis:
                r -= (q @ r) * q
        if r @ r > 1e-9 * (c @ c):
            kept.append(k)
            basis.append(r / np.sqrt(r @ r))
    beta = np.zeros(len(columns))
    if kept:
        beta[kept] = np.linalg.lstsq(np.stack([columns[k] for k in kept], 1), y, rcond=None)[0]
    return beta


def test_imputation_by_sums_equals_a_plain_fit(spark, monkeypatch):
    """Two years, three months, dependent columns, hours in several chunks."""
    monkeypatch.setattr(im, "CHUNK_HOURS", 300)
    draw = random.Random(21)
    start, rows = dt.datetime(2022, 12, 10), []
    for h in range(24 * 45):
        t = start + dt.timedelta(hours=h)
        a = draw.uniform(5, 50)
        rows += [("a", t, None if draw.random() < 0.1 else a), ("b", t, None if draw.random() < 0.2 else draw.uniform(5, 50)), ("c", t, None if draw.random() < 0.3 else 2 * a + draw.gauss(0, 3)), ("d", t, 7.0)]
    p = spark.createDataFrame(rows, "station string, datetime timestamp_ntz, pm10 double").withColumn("year", F.year("datetime"))
    got = {(r.station, r.datetime): r.pm10 for r in im.impute_ols(p, "pm10").where("pm10_imputed_from is not null").collect()}
    pooled = {(r.station, r.datetime): r.pm10 for r in im.impute_pooled(p, "pm10").where("pm10_imputed_from is not null").collect()}
    value = {(s, t): v for s, t, v in rows}
    names = ["a", "b", "c", "d"]
    missing = [k for k, v in value.items() if v is None]
    assert set(got) == set(missing) == set(pooled)
    for year in (2022, 2023):
        hours = sorted({t for _, t, _ in rows if t.year == year})
        levels = [sorted({f(t) for t in hours}) for f in (lambda t: t.month, lambda t: t.weekday(), lambda t: t.hour)]

        def calendar(t):
            m, w, h = ([1.0 * (v == x) for x in lv[1:]] for lv, v in zip(levels, (t.month, t.weekday(), t.hour), strict=True))
            out = m + w + h
            for first, second in ((m, w), (w, h), (m, h)):
                out += [x * y for y in second for x in first]
            return out

        def check(design, ys, keys, found):
            design, known = np.array(design, float), np.array([y is not None for y in ys])
            beta = plain_fit(np.array([y for y in ys if y is not None]), list(design[known].T))
            for k, row in zip(keys, design, strict=True):
                if value[k] is None:
                    assert found[k] == pytest.approx(row @ beta, rel=1e-6, abs=1e-5)

        for s in names[:3]:
            others = [o for o in names if o != s and len({value[o, t] or 0.0 for t in hours}) > 1]
            design = [[1.0, *[value[o, t] or 0.0 for o in others], *[1.0 * (value[o, t] is None) for o in others], *calendar(t)] for t in hours]
            check(design, [value[s, t] for t in hours], [(s, t) for t in hours], got)
        design, ys, keys = [], [], []
        for s in names:
            for t in hours:
                present = [value[o, t] for o in names if o != s and value[o, t] is not None]
                gap = 3 - len(present)
                design.append([1.0, *present, *[0.0] * gap, *[0.0] * len(present), *[1.0] * gap, *[1.0 * (s == o) for o in names[1:]], *calendar(t)])
                ys.append(value[s, t])
                keys.append((s, t))
        check(design, ys, keys, pooled)


def test_longest_key_holds_no_substrings(spark):
    import random

    from airgrid.operators import identifiers as own

    draw = random.Random(5)
    word = lambda a, b: "".join(draw.choice("ABC") for _ in range(draw.randrange(a, b)))
    names, keys = [word(1, 30) for _ in range(60)] + ["ABABABAB", None, ""], [word(2, 6) for _ in range(12)] + ["", None]
    out = own.longest_key_match(spark.createDataFrame([(x,) for x in names], "f string"), spark.createDataFrame([(x,) for x in keys], "k string"), "f", "k")
    hit = lambda f: min((k for k in keys if k and f and k in f), key=lambda k: (-len(k), k), default=None)
    assert sorted(map(str, out.collect())) == sorted(map(str, [type(out.first())(f=f, k=hit(f)) for f in names]))
    k, f = spark.createDataFrame([("AB",)], "k string"), spark.createDataFrame([("AB" * 40,)], "f string")
    seen = []
    whole = own.broadcast_if_small
    own.broadcast_if_small = lambda df, *a: seen.append(df._jdf.queryExecution().executedPlan().toString()) or whole(df, *a)
    try:
        own.longest_key_match(f, k, "f", "k")
    finally:
        own.broadcast_if_small = whole
    # The substrings of a file key are joined as they come, not grouped first.
    assert not any("keys=[f#" in line and "_k#" in line.split("functions=")[0] for plan in seen for line in plan.splitlines())
