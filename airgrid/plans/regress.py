"""Group summaries, coverage and gap regressions of exposure outcomes.

Exposure is constant inside a unit, so people are summed to (unit, group) cells before they meet it.
A weighted regression on group dummies has a closed form, so each model is a few aggregates and all
outcomes run in one plan. Frames keyed by outcome and group are broadcast without a count: their rows
are the outcome columns times the groups named by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.functions.numbers import ratio, wmean
from airgrid.functions.student import t_quantile
from airgrid.operators.ordered import weighted_quantile, with_group_total
from airgrid.operators.reshape import columns_matching, split_outcome
from airgrid.session import broadcast_if_small, reliable_checkpoint


def unit_groups(people: DataFrame, group: str, groups: list[int], weight: str = "person_weight") -> DataFrame:
    """Population per (unit, group) from rows in a valid group with positive weight."""
    ok = F.col(group).isin(list(groups)) & (F.col(weight) > 0)
    return people.where(ok).groupBy("geo_id", F.col(group).alias("group")).agg(F.sum(weight).alias("pop"))


def outcome_cells(exposure: DataFrame, people: DataFrame, outcomes: list[str], group: str, groups: list[int],
                  years: list[int] | None = None) -> DataFrame:
    """Long cells (outcome, geo_id, group, pop, y) with a known outcome, written out once.

    Several years of one unit count as repeated people, so they average with equal weight.
    """
    exp = exposure.where(F.col("year").isin(list(years))) if years else exposure
    long = exp.select("geo_id", *[F.col(c).cast("double") for c in outcomes]).unpivot(["geo_id"], outcomes, "outcome", "y")
    long = long.where(F.col("y").isNotNull())
    per_unit = long.groupBy("outcome", "geo_id").agg(F.avg("y").alias("y"), F.count("y").alias("_n"))
    cells = per_unit.join(unit_groups(people, group, groups), "geo_id")
    cells = cells.select("outcome", "geo_id", "group", (F.col("pop") * F.col("_n")).alias("pop"), "y")
    return reliable_checkpoint(cells)


def _labels(df: DataFrame, outcomes: list[str], pollutants: list[str]) -> DataFrame:
    """Replace the column name by outcome label and pollutant."""
    parts = {c: split_outcome(c, pollutants) for c in outcomes}
    label = F.create_map(*[F.lit(x) for c, (o, _) in parts.items() for x in (c, o)])
    token = F.create_map(*[F.lit(x) for c, (_, p) in parts.items() for x in (c, p)])
    return df.withColumn("pollutant", token[F.col("outcome")]).withColumn("outcome", label[F.col("outcome")])


def exposure_summaries(
    exposure: DataFrame,
    people: DataFrame,
    group: str = "edu_quintile",
    groups: list[int] = (1, 2, 3, 4, 5),
    pollutants: list[str] = ("pm10", "pm25"),
    pattern: str = r"^(avg|hrs_d)_",
    years: list[int] | None = None,
) -> DataFrame:
    """Weighted mean and median, population, cells and units per outcome and group."""
    outcomes = columns_matching(exposure, pattern, list(pollutants))
    cells = outcome_cells(exposure, people, outcomes, group, list(groups), years)
    keys = ["outcome", "group"]
    sums = cells.groupBy(*keys).agg(
        wmean("y", "pop").alias("weighted_mean"),
        F.sum("pop").alias("weighted_population"),
        F.count(F.lit(1)).alias("n_geo_group_cells"),
        F.count_distinct("geo_id").alias("n_geo_units"),
    )
    medians = weighted_quantile(cells, keys, "y", "pop", 0.5, "weighted_median")
    out = sums.join(F.broadcast(medians), keys).withColumn("group_col", F.lit(group))
    return _labels(out, outcomes, list(pollutants))


def exposure_coverage(
    exposure: DataFrame,
    people: DataFrame,
    distances: DataFrame,
    units: DataFrame,
    stations: DataFrame,
    group: str = "edu_quintile",
    groups: list[int] = (1, 2, 3, 4, 5),
    pollutants: list[str] = ("pm10", "pm25"),
    buffer_km: float = 3,
) -> DataFrame:
    """Units, stations and people left at each stage, one row per pollutant.

    ``units`` and ``stations`` are the full registries; ``distances`` needs the pairs in reach only.
    """
    near = distances.where((F.col("distance_km") > 0) & (F.col("distance_km") <= buffer_km))
    exposure = reliable_checkpoint(exposure)
    avg = [f"avg_{p}" for p in pollutants]
    long = exposure.select("geo_id", *avg).unpivot(["geo_id"], avg, "outcome", "y").where(F.col("y").isNotNull())
    valid = unit_groups(people, group, list(groups)).groupBy("geo_id").agg(F.sum("pop").alias("_pop"))
    joined = long.join(valid, "geo_id", "left")
    per = joined.groupBy("outcome").agg(
        F.count_distinct("geo_id").alias("n_geo_pollutant"),
        F.count_distinct(F.when(F.col("_pop").isNotNull(), F.col("geo_id"))).alias("n_geo_estimation"),
        F.sum("_pop").alias("pop_estimation"),
    )
    one = lambda df, agg: df.agg(agg.alias("v")).scalar()
    pop = one(people, F.sum("person_weight"))
    out = (
        per.withColumn("n_geo_metro", one(units, F.count_distinct("geo_id")))
        .withColumn("n_station_metro", one(stations, F.count_distinct("station_id")))
        .withColumn("_near", one(near, F.struct(F.count_distinct("geo_id").alias("g"), F.count_distinct("station_id").alias("s"))))
        .withColumn("n_geo_in_buffer", F.col("_near.g"))
        .withColumn("n_station_in_buffer", F.col("_near.s"))
        .withColumn("n_geo_exposure", one(exposure, F.count_distinct("geo_id")))
        .withColumn("pop_metro", pop)
        .withColumn("share_pop_estimation", F.col("pop_estimation") / F.col("pop_metro"))
        .withColumn("pollutant", F.regexp_replace("outcome", "^avg_", ""))
    )
    return out.drop("outcome", "_near")


def _base(base: int | Column) -> Column:
    return F.lit(base) if isinstance(base, int) else base


def scale_by_base(cells: DataFrame, base: int | Column, keys: list[str] = ("outcome",)) -> DataFrame:
    """Outcome divided by the base group's weighted mean; models (``keys``) without one are left out."""
    keys = list(keys)
    means = cells.where(F.col("group") == _base(base)).groupBy(*keys).agg(wmean("y", "pop").alias("_base"))
    usable = means.where(F.col("_base") != 0)
    return cells.join(F.broadcast(usable), keys).withColumn("y", F.col("y") / F.col("_base")).drop("_base")


def group_share(cells: DataFrame, keys: list[str] = ("outcome",)) -> DataFrame:
    """Cell weight: population share inside (``keys``, group)."""
    out = with_group_total(cells, [*keys, "group"], F.col("pop"), "_total")
    return out.withColumn("w", F.col("pop") / F.col("_total")).drop("_total")


def fit_gaps(cells: DataFrame, groups: list[int], base: int | Column, se_type: str, conf_level: float | None, keys: list[str] = ("outcome",)) -> DataFrame:
    """Gap of every group to the base with its standard error and interval, one model for each of ``keys``.

    A group without cells in a model gets no row there and is no coefficient of it (``n_coef``). ``base`` may be a
    column of ``keys`` where models differ in it.

    ``cells`` holds one row per (``keys``, geo_id, group) with y and w. With ``conf_level=None`` the
    interval columns are left out.
    """
    keys, base = list(keys), _base(base)
    means = cells.groupBy(*keys, "group").agg(wmean("y", "w").alias("_mu"), F.sum("w").alias("_W"))
    e = cells.join(F.broadcast(means), [*keys, "group"]).withColumn("_e", F.col("y") - F.col("_mu"))
    score = F.col("w") * F.col("_e") / F.col("_W")
    zero = F.lit(0.0)
    per_cluster = e.groupBy(*keys, "geo_id").agg(
        F.count(F.lit(1)).alias("_cells"),
        F.sum(F.col("w") * F.col("_e") * F.col("_e")).alias("_rss"),
        F.coalesce(F.sum(F.when(F.col("group") == base, score)), zero).alias("_sb"),
        *[F.coalesce(F.sum(F.when(F.col("group") == g, score)), zero).alias(f"_s{g}") for g in groups],
    )
    model = per_cluster.groupBy(*keys).agg(
        F.sum("_cells").alias("n_units"),
        F.count(F.lit(1)).alias("n_clusters"),
        F.sum("_rss").alias("_rss"),
        *[F.sum(F.pow(F.col(f"_s{g}") - F.col("_sb"), F.lit(2.0))).alias(f"_v{g}") for g in groups],
    )
    at = lambda g, c: F.max(F.when(F.col("group") == g, F.col(c)))
    stats = means.groupBy(*keys).agg(
        F.count_if(F.col("group").isin(groups)).cast("int").alias("n_coef"),
        at(base, "_mu").alias("_mub"), at(base, "_W").alias("_Wb"),
        *[at(g, "_mu").alias(f"_mu{g}") for g in groups],
        *[at(g, "_W").alias(f"_W{g}") for g in groups],
    )
    n, g_n, k = F.col("n_units"), F.col("n_clusters"), F.col("n_coef")
    rows = model.join(F.broadcast(stats), keys).where(n >= k)
    if se_type == "cluster_geo":
        factor = ratio(g_n, g_n - 1.0) * ratio(n - 1.0, (n - k).cast("double"))
        se = lambda g: F.when(g_n > k, F.sqrt(factor * F.col(f"_v{g}")))
        dof = g_n - 1
    else:
        sigma2 = ratio(F.col("_rss"), (n - k).cast("double"))
        se = lambda g: F.sqrt(sigma2 * (1 / F.col(f"_W{g}") + 1 / F.col("_Wb")))
        dof = n - k
    per_group = F.array(*[
        F.struct(
            F.lit(g).alias("group"),
            F.col(f"_W{g}").isNotNull().alias("_present"),
            F.when(base == g, zero).otherwise(F.col(f"_mu{g}") - F.col("_mub")).alias("estimate"),
            F.when(base == g, zero).when(F.col(f"_mu{g}").isNotNull(), se(g)).alias("std_error"),
        )
        for g in groups
    ])
    out = rows.select(*keys, "n_units", "n_clusters", dof.alias("_dof"), "n_coef", F.explode(per_group).alias("r"))
    out = out.where("r._present").select(*keys, "r.*", "n_units", "n_clusters", "_dof", "n_coef").drop("_present")
    if conf_level is not None:
        crit = t_quantile(1 - (1 - conf_level) / 2, F.col("_dof"))
        out = out.withColumn("_half", F.when(F.col("std_error") == 0, F.lit(0.0)).otherwise(crit * F.col("std_error")))
        out = out.withColumn("ci_low", F.col("estimate") - F.col("_half")).withColumn("ci_high", F.col("estimate") + F.col("_half"))
    return out.drop("_half", "_dof")


def exposure_regressions(
    exposure: DataFrame,
    people: DataFrame,
    group: str = "edu_quintile",
    groups: list[int] = (1, 2, 3, 4, 5),
    base: int | None = None,
    pollutants: list[str] = ("pm10", "pm25"),
    pattern: str = r"^hrs_d_.*_it[12]$",
    years: list[int] | None = None,
    conf_level: float | None = 0.95,
    normalized: bool = True,
    se_type: str = "cluster_geo",
) -> DataFrame:
    """Gap regressions of all matching outcomes.

    Clustered errors need more clusters than coefficients; otherwise error and interval are NULL.
    """
    groups = list(groups)
    base = max(groups) if base is None else base
    if base not in groups:
        raise ValueError("the base group must be one of the groups")
    if se_type not in ("cluster_geo", "classic"):
        raise ValueError("unknown se_type")
    outcomes = columns_matching(exposure, pattern, list(pollutants))
    cells = outcome_cells(exposure, people, outcomes, group, groups, years)
    if normalized:
        cells = scale_by_base(cells, base)
    fit = fit_gaps(group_share(cells), groups, base, se_type, conf_level)
    return _labels(
        fit.withColumn("base_group", F.lit(base))
        .withColumn("group_col", F.lit(group))
        .withColumn("regression_unit", F.lit("geo_group"))
        .withColumn("se_type", F.lit(se_type))
        .withColumn("normalized", F.lit(normalized)),
        outcomes,
        list(pollutants),
    )


def legacy_regressions(
    exposure: DataFrame,
    people: DataFrame,
    outcomes: list[str],
    group: str = "edu_quintile",
    groups: list[int] = (1, 2, 3, 4, 5),
    base: int | None = None,
    pollutants: list[str] = ("pm10", "pm25"),
    conf_level: float | None = 0.95,
    listwise: bool = False,
) -> DataFrame:
    """Older rule: weights are shares over every cell, also those without exposure; classic errors."""
    groups = list(groups)
    base = max(groups) if base is None else base
    pops = unit_groups(people, group, groups)
    exp = exposure.select("geo_id", *[F.col(c).cast("double") for c in outcomes])
    wide = pops.join(exp, "geo_id", "left")
    if listwise:
        wide = wide.dropna(subset=list(outcomes))
    wide = with_group_total(reliable_checkpoint(wide), ["group"], F.col("pop"), "_total").withColumn("w", F.col("pop") / F.col("_total"))
    cells = wide.unpivot(["geo_id", "group", "pop", "w"], outcomes, "outcome", "y").where(F.col("y").isNotNull())
    fit = fit_gaps(scale_by_base(cells, base), groups, base, "classic", conf_level)
    return _labels(fit.withColumn("base_group", F.lit(base)), outcomes, list(pollutants))


def attach_clusters(coverage: DataFrame, regressions: DataFrame) -> DataFrame:
    """Coverage with the largest cluster and coefficient counts of each pollutant, thinnest sample first."""
    counts = regressions.groupBy("pollutant").agg(F.max("n_clusters").alias("n_clusters"), F.max("n_coef").alias("n_coef"))
    return coverage.join(F.broadcast(counts), "pollutant", "left").orderBy("n_clusters", "pollutant")


def group_means(units: DataFrame, group: str, weight: str, columns: list[str]) -> DataFrame:
    """Weighted mean of each column per group."""
    return units.groupBy(group).agg(*[wmean(c, weight).alias(c) for c in columns])


def density_input(df: DataFrame, by: list[str], x: str, w: str, low: float, high: float, bins: int) -> DataFrame:
    """Weighted histogram per group on a fixed grid."""
    b = F.least(F.lit(bins), F.width_bucket(F.col(x), F.lit(low), F.lit(high), F.lit(bins)))
    return df.where(F.col(x).between(low, high)).groupBy(*by, b.cast("int").alias("bin")).agg(F.sum(w).alias("weight"))


def trim_upper(df: DataFrame, by: list[str], x: str, w: str, q: float = 0.995) -> DataFrame:
    """Rows up to the weighted quantile of their group."""
    top = weighted_quantile(df, by, x, w, q, "_top")
    return df.join(broadcast_if_small(top), by).where(F.col(x) <= F.col("_top")).drop("_top")
