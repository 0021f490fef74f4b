import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from airgrid.operators import ordered as o


def frame(spark, n=2000, groups=3):
    rng = random.Random(5)
    rows = [(i, "hot" if rng.random() < 0.4 else f"k{rng.randrange(groups)}", float(rng.randrange(50)), float(rng.randrange(0, 4))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, k string, x double, w double")


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_running_sum_per_group(spark, partitions):
    rows, df = frame(spark)
    got = {r.id: (r.running, r.total) for r in o.running_sum(df, ["k"], ["x", "id"], "w", partitions=partitions).collect()}
    want, sums = {}, {}
    for r in rows:
        sums[r[1]] = sums.get(r[1], 0) + r[3]
    run = {}
    for i, k, x, w in sorted(rows, key=lambda r: (r[2], r[0])):
        run[k] = run.get(k, 0) + w
        want[i] = (run[k], sums[k])
    assert got == want


def test_running_sum_keeps_rows_with_null_group(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, 3.0), (3, "a", 4.0)], "id long, k string, w double")
    got = {r.id: r.running for r in o.running_sum(df, ["k"], ["id"], "w").collect()}
    assert got == {1: 2.0, 2: 5.0, 3: 4.0}


def test_quantiles_and_weighted_quantile(spark):
    rows, df = frame(spark)
    q = {r.k: r for r in o.quantiles(df, ["k"], "x", {"a": 0.01, "b": 0.5, "c": 0.99}).collect()}
    med = {r.k: r.m for r in o.weighted_quantile(df, ["k"], "x", "w", 0.5, "m").collect()}
    for k in {r[1] for r in rows}:
        x = np.array([r[2] for r in rows if r[1] == k])
        w = np.array([r[3] for r in rows if r[1] == k])
        assert [q[k].a, q[k].b, q[k].c] == pytest.approx(list(np.quantile(x, [0.01, 0.5, 0.99])))
        keep = w > 0
        order = np.argsort(x[keep], kind="stable")
        share = np.cumsum(w[keep][order]) / w[keep].sum()
        assert med[k] == x[keep][order][np.argmax(share >= 0.5)]


def test_average_rank(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", 3.0), ("e", None)], "id string, x double")
    got = {r.id: (r["rank"], r.n) for r in o.average_rank(df, "x").collect()}
    assert got == {"a": (1.0, 4), "b": (2.5, 4), "c": (2.5, 4), "d": (4.0, 4)}


def test_winsorise_moves_only_positive_values(spark):
    x = [0.0] * 5 + [float(i) for i in range(1, 200)] + [None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id long, x double")
    got = {r.id: r.y for r in o.winsorise(df, "x", "y").collect()}
    known = np.array([v for v in x if v is not None])
    hi, lo = np.quantile(known, 0.99), np.quantile(known[known > 0], 0.01)
    for i, v in enumerate(x):
        assert got[i] == (pytest.approx(min(max(v, lo), hi)) if v else v)


def test_first_by_and_modal_value(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "x"), ("a", 3, "y")], "k string, o int, v string")
    assert {(r.k, r.o, r.v) for r in o.first_by(df, ["k"], ["o"]).collect()} == {("a", 1, "y"), ("b", 1, "x")}
    assert {(r.k, r.m) for r in o.modal_value(df, "k", "v", "m").collect()} == {("a", "y"), ("b", "x")}


def test_group_total(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, v double")
    got = {(r.k, r.v, r.t) for r in o.with_group_total(df, ["k"], F.col("v"), "t").collect()}
    assert got == {("a", 1.0, 4.0), ("a", 3.0, 4.0), ("b", 5.0, 5.0)}
