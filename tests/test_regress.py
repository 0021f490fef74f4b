import numpy as np
import pytest

from airgrid.functions.student import t_quantile_value
from airgrid.plans import regress as rg

EXPOSURE = [("g1", 2023, 1.0), ("g2", 2023, 2.0), ("g3", 2023, 4.0), ("g4", 2023, 0.5)]
PEOPLE = [("g1", 1, 10.0), ("g1", 2, 20.0), ("g2", 1, 30.0), ("g2", 2, 10.0), ("g3", 1, 20.0), ("g3", 2, 10.0), ("g4", 1, 40.0), ("g4", 2, 60.0)]


def frames(spark, exposure=EXPOSURE, people=PEOPLE):
    e = spark.createDataFrame(exposure, "geo_id string, year int, hrs_d_pm10_it1 double")
    p = spark.createDataFrame(people, "geo_id string, edu_quintile int, person_weight double")
    return e, p


def run(spark, exposure=EXPOSURE, people=PEOPLE, groups=(1, 2), **kw):
    e, p = frames(spark, exposure, people)
    return {r.group: r for r in rg.exposure_regressions(e, p, groups=list(groups), pollutants=["pm10"], **kw).collect()}


@pytest.mark.parametrize("p,df,want", [(0.975, 1, 12.706205), (0.975, 5, 2.570582), (0.975, 11, 2.200985), (0.95, 30, 1.697261), (0.995, 200, 2.600634)])
def test_t_quantile(p, df, want):
    assert t_quantile_value(p, df) == pytest.approx(want, abs=1e-6)


def test_gap_is_the_difference_of_weighted_means(spark):
    raw, norm = run(spark, normalized=False), run(spark)
    assert raw[1].estimate == pytest.approx(1.7 - 1.1)
    assert norm[1].estimate == pytest.approx(1.7 / 1.1 - 1)
    assert raw[1].estimate / raw[1].std_error == pytest.approx(norm[1].estimate / norm[1].std_error)
    assert (raw[2].estimate, raw[2].std_error, raw[2].ci_low, raw[2].ci_high) == (0, 0, 0, 0)
    assert run(spark, base=1)[2].estimate == pytest.approx(1.1 / 1.7 - 1)


def test_too_few_clusters_give_no_error(spark):
    exp = [(f"g{i}", 2023, i + 0.5) for i in range(1, 6)]
    people = [(f"g{(i - 1) // 5 + 1}", (i - 1) % 5 + 1, 10.0 * i) for i in range(1, 26)]
    rows = run(spark, exp, people, groups=(1, 2, 3, 4, 5))
    for g in range(1, 5):
        assert rows[g].estimate is not None and rows[g].std_error is None and rows[g].ci_low is None
        assert rows[g].n_clusters == 5 and rows[g].n_coef == 5


def sandwich(y, group, cluster, w, groups, base):
    """Generic weighted least squares with clustered HC1 and classic errors."""
    order = [base] + [g for g in groups if g != base]
    x = np.column_stack([np.ones(len(y))] + [(group == g).astype(float) for g in order[1:]])
    bread = np.linalg.inv(x.T @ (x * w[:, None]))
    beta = bread @ x.T @ (w * y)
    e = y - x @ beta
    n, k, ids = len(y), x.shape[1], np.unique(cluster)
    meat = sum(np.outer(s, s) for s in ((x * (w * e)[:, None])[cluster == c].sum(0) for c in ids))
    clustered = len(ids) / (len(ids) - 1) * (n - 1) / (n - k) * bread @ meat @ bread
    classic = bread * (w * e * e).sum() / (n - k)
    return dict(zip(order, beta)), dict(zip(order, np.sqrt(np.diag(clustered)))), dict(zip(order, np.sqrt(np.diag(classic))))


@pytest.mark.parametrize("se_type", ["cluster_geo", "classic"])
def test_closed_form_equals_generic_solver(spark, se_type):
    rng = np.random.default_rng(2)
    units = [f"g{i}" for i in range(9)]
    exp = [(u, 2023, float(v)) for u, v in zip(units, rng.uniform(1, 9, 9))]
    people = [(u, g, float(rng.integers(1, 60))) for u in units for g in range(1, 6) if rng.random() < 0.9]
    rows = run(spark, exp, people, groups=(1, 2, 3, 4, 5), normalized=False, se_type=se_type)
    y = np.array([dict((u, v) for u, _, v in exp)[p[0]] for p in people])
    group, cluster, pop = np.array([p[1] for p in people]), np.array([p[0] for p in people]), np.array([p[2] for p in people])
    w = pop / np.array([pop[group == g].sum() for g in group])
    beta, cl, classic = sandwich(y, group, cluster, w, [1, 2, 3, 4, 5], 5)
    se = cl if se_type == "cluster_geo" else classic
    dof = len(set(cluster)) - 1 if se_type == "cluster_geo" else len(y) - 5
    for g in range(1, 5):
        assert rows[g].estimate == pytest.approx(beta[g])
        assert rows[g].std_error == pytest.approx(se[g])
        assert rows[g].ci_high - rows[g].estimate == pytest.approx(t_quantile_value(0.975, dof) * se[g])


def test_several_years_average(spark):
    two = EXPOSURE + [(g, 2022, v + 2) for g, _, v in EXPOSURE]
    rows = run(spark, two, normalized=False)
    assert rows[1].estimate == pytest.approx(1.7 - 1.1)
    assert run(spark, two, normalized=False, years=[2023])[1].estimate == pytest.approx(1.7 - 1.1)


def test_empty_group_has_no_row_and_no_coefficient(spark):
    rows = run(spark, groups=(1, 2, 3, 4), base=2, normalized=False)
    plain = run(spark, groups=(1, 2), base=2, normalized=False)
    assert set(rows) == {1, 2} and rows[1].n_coef == 2
    assert rows[1].std_error == pytest.approx(plain[1].std_error)
    assert rows[1].estimate == pytest.approx(1.7 - 1.1)


def test_summary(spark):
    e, p = frames(spark)
    rows = {r.group: r for r in rg.exposure_summaries(e, p, groups=[1, 2], pollutants=["pm10"]).collect()}
    assert rows[1].weighted_mean == pytest.approx(1.7) and rows[2].weighted_mean == pytest.approx(1.1)
    assert rows[1].outcome == "hrs_d_it1" and rows[1].pollutant == "pm10"
    assert rows[1].weighted_median == 1.0 and rows[2].weighted_median == 0.5
    assert rows[1].weighted_population == 100 and rows[1].n_geo_units == 4


def test_bad_arguments(spark):
    e, p = frames(spark)
    with pytest.raises(ValueError):
        rg.exposure_regressions(e, p, groups=[1, 2], base=7)
    with pytest.raises(ValueError):
        rg.exposure_regressions(e, p, pollutants=["so2"])
