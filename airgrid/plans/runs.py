"""All exposure runs of all cities in one plan.

A run is a city with a year, a buffer and a grouping. The panel, the pairs and the people carry ``city_id``, so that
cities may share station and unit names. The panel meets its pairs once; every rule (buffer, power, treatment of
missing readings) is a conditional sum over that fan-out, and rules become rows only after hours are summed to days.
Groups, summaries, regressions and coverage are keyed by the run from there on, and no step runs once for each city.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.functions.keys import normalize_station, safe_text
from airgrid.functions.numbers import wmean
from airgrid.operators.ordered import running_sum, weighted_quantile
from airgrid.operators.reshape import columns_matching
from airgrid.plans.compare import quintile_rows
from airgrid.plans.exposure import TARGETS, fan_out
from airgrid.plans.regress import _labels, fit_gaps, group_share, scale_by_base
from airgrid.session import reliable_checkpoint

GROUP_TYPES = {5: "quintile", 10: "decile"}


@dataclass(frozen=True)
class Rule:
    """How readings around a unit are weighted; ``missing`` is ``drop`` or ``zero`` as in ``hourly_idw``."""

    label: str
    buffer_km: float
    power: float = 1.0
    missing: str = "drop"


@dataclass(frozen=True)
class Run:
    """One city and grouping; the base group is the highest."""

    city: str
    city_id: str
    year: int
    buffer_km: float
    socioeconomic_var: str
    group_col: str
    n_groups: int

    def __post_init__(self):
        if self.n_groups not in GROUP_TYPES:
            raise ValueError("n_groups must be 5 or 10")


def _pairs(distances: DataFrame, rules: list[Rule]) -> DataFrame:
    """Pairs in reach of any rule, with one weight for each rule, null outside its buffer."""
    d = F.col("distance_km")
    widest = max(r.buffer_km for r in rules)
    weights = [F.when(d <= r.buffer_km, F.lit(1.0) / F.pow(d, F.lit(float(r.power)))).alias(f"_w{k}") for k, r in enumerate(rules)]
    kept = distances.where((d > 0) & (d <= widest))
    return kept.select("city_id", safe_text(distances, "geo_id").alias("geo_id"), normalize_station("station_id").alias("station_id"), *weights)


def daily_by_rule(panel: DataFrame, distances: DataFrame, pollutants: list[str], rules: list[Rule], targets: dict | None = None, salts: int = 32) -> DataFrame:
    """Rows (rule, city_id, geo_id, day) with sum, known hours and hours at each target of every pollutant.

    A row says that the rule has a value in some hour of the day. Readings meet the pairs as in ``fan_out``.
    """
    targets = TARGETS if targets is None else targets
    keep = [p for p in pollutants if p in panel.columns]
    rows = panel.select("city_id", normalize_station("station").alias("station_id"), "datetime", *keep)
    if all(r.missing == "drop" for r in rules):
        rows = rows.where(F.coalesce(*[F.col(p) for p in keep]).isNotNull())
    fan, keys = fan_out(rows, _pairs(distances, rules), ["city_id", "station_id"], salts=salts)
    values, met = [], []
    for k, r in enumerate(rules):
        w = F.col(f"_w{k}")
        for p in keep:
            known = F.col(p).isNotNull()
            if r.missing == "drop":
                values.append((F.sum(F.col(p) * w) / F.sum(F.when(known, w))).alias(f"_{k}_{p}"))
            else:
                values.append((F.sum(F.coalesce(F.col(p), F.lit(0.0)) * w) / F.sum(w)).alias(f"_{k}_{p}"))
        # An hour of a dropping rule counts if any pollutant is known within its buffer.
        any_known = w.isNotNull() if r.missing == "zero" else w.isNotNull() & F.coalesce(*[F.col(p) for p in keep]).isNotNull()
        met.append(F.max(any_known).alias(f"_{k}_met"))
    hourly = fan.groupBy(*keys).agg(*values, *met)
    sums = []
    for k in range(len(rules)):
        sums.append(F.max(f"_{k}_met").alias(f"_{k}_met"))
        for p in keep:
            x = F.col(f"_{k}_{p}")
            sums += [F.sum(x).alias(f"_{k}_sum_{p}"), F.count(x).alias(f"_{k}_n_{p}")]
            sums += [F.count_if(x >= level).alias(f"_{k}_h_{p}_{name}") for name, level in targets.get(p, {}).items()]
    days = hourly.groupBy("city_id", "geo_id", F.to_date("datetime").alias("day")).agg(*sums)
    names = [(f"sum_{p}", "sum") for p in keep] + [(f"n_{p}", "n") for p in keep] + [(f"h_{p}_{name}", "h") for p in keep for name in targets.get(p, {})]
    each = F.array(*[F.struct(F.lit(r.label).alias("rule"), F.col(f"_{k}_met").alias("met"), *[F.col(f"_{k}_{n}").alias(n) for n, _ in names]) for k, r in enumerate(rules)])
    return days.select("city_id", "geo_id", "day", F.explode(each).alias("_r")).where("_r.met").select("city_id", "geo_id", "day", "_r.rule", *[f"_r.{n}" for n, _ in names])


def annual_by_rule(days: DataFrame, pollutants: list[str], targets: dict | None = None) -> DataFrame:
    """Annual exposure of every (rule, city_id, geo_id, year), with the columns of ``annual_exposure``."""
    targets = TARGETS if targets is None else targets
    aggs = []
    for p in pollutants:
        if f"n_{p}" not in days.columns:
            continue
        n = F.sum(f"n_{p}")
        aggs += [(F.sum(f"sum_{p}") / F.nullif(n, F.lit(0))).alias(f"avg_{p}"), F.nullif(n, F.lit(0)).alias(f"total_hrs_{p}")]
        aggs += [F.when(n > 0, F.sum(f"h_{p}_{name}")).alias(f"hrs_d_{p}_{name}") for name in targets.get(p, {})]
    return days.groupBy("rule", "city_id", "geo_id", F.year("day").alias("year")).agg(*aggs)


def day_counts_by_rule(days: DataFrame, pollutant: str, names: list[str]) -> DataFrame:
    """Days of every (rule, city_id, geo_id) with one and with two hours at each named target."""
    aggs = []
    for name in names:
        h = F.col(f"h_{pollutant}_{name}")
        aggs += [F.count_if(h >= 1).alias(f"days_with_hr_above_{name}"), F.count_if(h >= 2).alias(f"days_with_2hr_above_{name}")]
    return days.where(F.col(f"n_{pollutant}") > 0).groupBy("rule", "city_id", "geo_id").agg(*aggs)


def city_groups(people: DataFrame, var: str, weight: str, n: int, out: str, tie: list[str]) -> DataFrame:
    """Equal-population groups 1..n of ``var`` within each city; rows without value or weight get NULL."""
    valid = F.col(var).isNotNull() & F.col(weight).isNotNull()
    ranked = running_sum(people.where(valid), ["city_id"], [var, *tie], weight, "_cum", "_tot")
    share = F.col("_cum") / F.col("_tot")
    passed = sum([F.when(share > F.lit(k / n), 1).otherwise(0) for k in range(1, n)], F.lit(0))
    grouped = ranked.withColumn(out, (passed + 1).cast("int")).drop("_cum", "_tot")
    return grouped.unionByName(people.where(~valid).withColumn(out, F.lit(None).cast("int")))


RUN_KEYS = ["city", "city_id", "year", "buffer_km", "socioeconomic_var", "group_type"]


def run_table(spark, runs: list[Run]) -> DataFrame:
    """The runs as rows; as many as the caller names, so the frame may be broadcast."""
    if len({(r.city_id, r.year, r.buffer_km, r.socioeconomic_var, r.group_col) for r in runs}) != len(runs):
        raise ValueError("two runs are alike")
    rows = [(r.city, r.city_id, r.year, float(r.buffer_km), r.socioeconomic_var, GROUP_TYPES[r.n_groups], r.group_col, r.n_groups) for r in runs]
    return F.broadcast(spark.createDataFrame(rows, "city string, city_id string, year int, buffer_km double, socioeconomic_var string, group_type string, group_col string, base int"))


def run_groups(people: DataFrame, runs: list[Run], weight: str = "person_weight") -> DataFrame:
    """Population of every (city_id, group_col, geo_id, group), all groupings in one pass."""
    columns = sorted({r.group_col for r in runs})
    most = {c: max(r.n_groups for r in runs if r.group_col == c) for c in columns}
    each = F.array(*[F.struct(F.lit(c).alias("group_col"), F.when(F.col(c).between(1, most[c]), F.col(c).cast("int")).alias("group")) for c in columns])
    long = people.where(F.col(weight) > 0).select("city_id", safe_text(people, "geo_id").alias("geo_id"), F.col(weight).alias("_w"), F.inline(each)).where(F.col("group").isNotNull())
    return long.groupBy("city_id", "group_col", "geo_id", "group").agg(F.sum("_w").alias("pop"))


def run_cells(exposure: DataFrame, groups: DataFrame, runs: DataFrame, outcomes: list[str]) -> DataFrame:
    """Cells (run keys, outcome, geo_id, group, pop, y) with a known outcome; each run takes its year, buffer and grouping."""
    long = exposure.select("city_id", "geo_id", "year", "buffer_km", *[F.col(c).cast("double") for c in outcomes])
    long = long.unpivot(["city_id", "geo_id", "year", "buffer_km"], outcomes, "outcome", "y").where(F.col("y").isNotNull())
    keyed = long.join(runs, ["city_id", "year", "buffer_km"])
    cells = keyed.join(groups, ["city_id", "group_col", "geo_id"]).where(F.col("group") <= F.col("base"))
    return reliable_checkpoint(cells.select(*RUN_KEYS, "group_col", "base", "outcome", "geo_id", "group", "pop", "y"))


def _coverage(exposure: DataFrame, groups: DataFrame, people: DataFrame, distances: DataFrame, units: DataFrame, stations: DataFrame, runs: DataFrame, pollutants: list[str]) -> DataFrame:
    """One row for each run and pollutant with an exposure: units, stations and people left at each stage."""
    avg = [f"avg_{p}" for p in pollutants]
    d = F.col("distance_km")
    buffers = runs.select("city_id", "buffer_km").distinct()
    near = distances.where(d > 0).join(F.broadcast(buffers), "city_id").where(d <= F.col("buffer_km"))
    near = near.groupBy("city_id", "buffer_km").agg(F.count_distinct(safe_text(distances, "geo_id")).alias("n_geo_in_buffer"), F.count_distinct(normalize_station("station_id")).alias("n_station_in_buffer"))
    per_run = exposure.join(runs, ["city_id", "year", "buffer_km"])
    per_unit = groups.join(runs.select("city_id", "group_col", "base").distinct(), ["city_id", "group_col"]).where(F.col("group") <= F.col("base"))
    per_unit = per_unit.groupBy("city_id", "group_col", "base", "geo_id").agg(F.sum("pop").alias("_pop"))
    keys = [*RUN_KEYS, "group_col", "base"]
    all_units = per_run.groupBy(*keys).agg(F.count_distinct("geo_id").alias("n_geo_exposure"))
    long = per_run.select(*keys, "geo_id", *avg).unpivot([*keys, "geo_id"], avg, "outcome", "y").where(F.col("y").isNotNull())
    joined = long.join(per_unit, ["city_id", "group_col", "base", "geo_id"], "left")
    per = joined.groupBy(*keys, "outcome").agg(
        F.count_distinct("geo_id").alias("n_geo_pollutant"), F.count_distinct(F.when(F.col("_pop").isNotNull(), F.col("geo_id"))).alias("n_geo_estimation"), F.sum("_pop").alias("pop_estimation"))
    # One row for each city or run on the right of these joins.
    out = per.join(all_units, keys).join(near, ["city_id", "buffer_km"], "left")
    out = out.join(units.groupBy("city_id").agg(F.count_distinct("geo_id").alias("n_geo_metro")), "city_id", "left")
    out = out.join(stations.groupBy("city_id").agg(F.count_distinct("station_id").alias("n_station_metro")), "city_id", "left")
    out = out.join(people.groupBy("city_id").agg(F.sum("person_weight").alias("pop_metro")), "city_id", "left")
    out = out.withColumn("share_pop_estimation", F.col("pop_estimation") / F.col("pop_metro")).withColumn("pollutant", F.regexp_replace("outcome", "^avg_", ""))
    return out.drop("outcome", "base", "group_col")


def exposure_runs(
    panel: DataFrame, distances: DataFrame, people: DataFrame, units: DataFrame, stations: DataFrame, runs: list[Run], pollutants: list[str] = ("pm10", "pm25"),
    summary_pattern: str = r"^(avg|hrs_d)_", ci_pattern: str = r"^hrs_d_.*_it[12]$", conf_level: float | None = 0.95, normalized: bool = True, se_type: str = "cluster_geo", targets: dict | None = None,
) -> dict[str, DataFrame]:
    """``summary``, ``ci`` and ``coverage`` of all runs, stacked, each with the run's labels; coverage with the regressions' counts.

    ``panel``, ``distances``, ``people``, ``units`` and ``stations`` have ``city_id``; ``people`` holds the group
    columns. Each distinct buffer is one rule of a single fan-out.
    """
    pollutants = list(pollutants)
    spark = panel.sparkSession
    buffers = sorted({float(r.buffer_km) for r in runs})
    panel = panel.where(F.year("datetime").isin(sorted({r.year for r in runs})))
    days = daily_by_rule(panel, distances, pollutants, [Rule(repr(b), b) for b in buffers], targets)
    exposure = reliable_checkpoint(annual_by_rule(days, pollutants, targets).withColumn("buffer_km", F.col("rule").cast("double")).drop("rule"))
    table, groups = run_table(spark, runs), reliable_checkpoint(run_groups(people, runs))
    summary_of, ci_of = columns_matching(exposure, summary_pattern, pollutants), columns_matching(exposure, ci_pattern, pollutants)
    cells = run_cells(exposure, groups, table, sorted({*summary_of, *ci_of}))
    keys = [*RUN_KEYS, "group_col", "outcome"]
    own = cells.where(F.col("outcome").isin(summary_of))
    sums = own.groupBy(*keys, "group").agg(
        wmean("y", "pop").alias("weighted_mean"), F.sum("pop").alias("weighted_population"), F.count(F.lit(1)).alias("n_geo_group_cells"), F.count_distinct("geo_id").alias("n_geo_units"))
    medians = weighted_quantile(own, [*keys, "group"], "y", "pop", 0.5, "weighted_median")
    summary = _labels(sums.join(medians, [*keys, "group"]), summary_of, pollutants)
    fitted = cells.where(F.col("outcome").isin(ci_of))
    of_model = [*keys, "base"]
    if normalized:
        fitted = scale_by_base(fitted, F.col("base"), of_model)
    fit = fit_gaps(group_share(fitted, of_model), list(range(1, max(r.n_groups for r in runs) + 1)), F.col("base"), se_type, conf_level, of_model)
    ci = _labels(fit.withColumnRenamed("base", "base_group").withColumns({"regression_unit": F.lit("geo_group"), "se_type": F.lit(se_type), "normalized": F.lit(normalized)}), ci_of, pollutants)
    ci = reliable_checkpoint(ci)
    used = ci.groupBy("city_id", "socioeconomic_var", "pollutant").agg(F.max("n_clusters").alias("n_clusters"), F.max("n_units").alias("n_units"), F.max("n_coef").alias("n_coef"))
    coverage = _coverage(exposure, groups, people, distances, units, stations, table, pollutants)
    return {"summary": summary, "ci": ci, "coverage": coverage.join(used, ["city_id", "socioeconomic_var", "pollutant"], "left")}


def result_tables(stacked: dict[str, DataFrame], education: str = "education", income: str = "income") -> dict[str, DataFrame]:
    """The five result tables; education and income apart, because their groups differ, coverage with the thinnest samples first."""
    of = lambda name, var: stacked[name].where(F.col("socioeconomic_var") == var)
    return {
        "ci_estimates_education": of("ci", education), "group_summaries_education": of("summary", education),
        "ci_estimates_income": of("ci", income), "group_summaries_income": of("summary", income),
        "coverage": stacked["coverage"].orderBy("n_clusters", "city_id", "socioeconomic_var", "pollutant"),
    }


def progression_tables(panel: DataFrame, distances: DataFrame, units: DataFrame, rules: list[Rule], pollutant: str, day_targets: list[str] = ("it1",), targets: dict | None = None) -> DataFrame:
    """Quintile table of every rule (a step of the progression) from one fan-out, stacked under ``step_id``.

    ``units`` is (city_id, geo_id, edu_quintile, pop_w), the dominant group of each unit.
    """
    targets = TARGETS if targets is None else targets
    days = reliable_checkpoint(daily_by_rule(panel, distances, [pollutant], rules, targets))
    annual = annual_by_rule(days, [pollutant], targets)
    counts = day_counts_by_rule(days, pollutant, list(day_targets))
    return quintile_rows(annual, counts, units, pollutant, ["rule", "city_id"]).withColumnRenamed("rule", "step_id")


def from_cities(tables: dict[str, DataFrame]) -> DataFrame:
    """One table of the cities' tables under ``city_id``."""
    out = None
    for city_id, df in tables.items():
        part = df.withColumn("city_id", F.lit(city_id))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def as_city(df: DataFrame, city: Column | str = "city") -> DataFrame:
    """A single city's table with a ``city_id``."""
    return df.withColumn("city_id", F.lit(city) if isinstance(city, str) else city)
