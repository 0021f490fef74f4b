"""Comparison of two versions of a table, and of result vintages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.functions.numbers import any_present, ratio, wmean
from airgrid.functions.times import shift_clock
from airgrid.operators.ordered import quantiles
from airgrid.operators.reshape import stack
from airgrid.session import reliable_checkpoint, require_columns


def exclude(df: DataFrame, codes: list[str] | None = None, rows: DataFrame | None = None, code: str = "station_code") -> DataFrame:
    """Drop listed codes and rows matched by a frame on their shared columns."""
    out = df
    if codes and code in df.columns:
        out = out.where(~F.coalesce(F.col(code).isin(list(codes)), F.lit(False)))
    if rows is not None:
        shared = [c for c in rows.columns if c in df.columns]
        if shared:
            out = out.join(rows.select(*shared).distinct(), shared, "left_anti")
    return out


def prefer_names(df: DataFrame, preferred: dict[str, str], code: str = "station_code", name: str = "station") -> DataFrame:
    """For codes with a preferred name, drop the rows under another name; unnamed rows stay."""
    pref = F.create_map(*[F.lit(x) for kv in preferred.items() for x in kv])[F.col(code)]
    return df.where(pref.isNull() | F.col(name).isNull() | (F.col(name) == pref))


def join_versions(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer join with ``_old`` and ``_new`` columns."""
    require_columns(old, [*keys, *values], "old table")
    require_columns(new, [*keys, *values], "new table")
    a = old.select(*keys, *[F.col(v).alias(f"{v}_old") for v in values])
    b = new.select(*keys, *[F.col(v).alias(f"{v}_new") for v in values])
    return a.join(b, keys, "full")


def only_in(joined: DataFrame, keys: list[str], values: list[str], side: str) -> DataFrame:
    """Rows with any value on one side and none on the other."""
    other = "new" if side == "old" else "old"
    here, there = [f"{v}_{side}" for v in values], [f"{v}_{other}" for v in values]
    return joined.where(any_present(here) & ~any_present(there)).select(*keys, *here)


def difference_rows(joined: DataFrame, keys: list[str], values: list[str], tolerance: dict[str, float]) -> DataFrame:
    """Long cell differences with a tolerance flag; cells unknown on both sides are left out."""
    cells = F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(f"{v}_old").cast("double").alias("value_old"),
                 F.col(f"{v}_new").cast("double").alias("value_new"), F.lit(float(tolerance.get(v, 0.0))).alias("tol"))
        for v in values
    ])
    long = joined.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")
    long = long.where(F.col("value_old").isNotNull() | F.col("value_new").isNotNull())
    long = long.withColumn("diff", F.col("value_new") - F.col("value_old")).withColumn("absv", F.abs("diff"))
    return long.withColumn("within_tol", F.col("absv") <= F.col("tol")).drop("tol")


def difference_summary(rows: DataFrame) -> DataFrame:
    """Counts, share and size of differences per variable; the rows are written once for the sums and the quantile."""
    rows = reliable_checkpoint(rows.select("variable", "value_old", "value_new", "absv", "within_tol"))
    n, n_diff = F.count(F.lit(1)), F.count_if(~F.coalesce(F.col("within_tol"), F.lit(False)))
    sums = rows.groupBy("variable").agg(
        n.alias("n"),
        n_diff.alias("n_diff"),
        F.count_if(F.col("value_old").isNull() & F.col("value_new").isNull()).alias("n_both_na"),
        (n_diff / n).alias("share_diff"),
        F.avg("absv").alias("mean_abs_diff"),
    )
    p95 = quantiles(rows, ["variable"], "absv", {"p95_abs_diff": 0.95})
    return sums.join(F.broadcast(p95), "variable", "left")  # one row per compared column


def compare_panels(
    old: DataFrame,
    new: DataFrame,
    keys: list[str],
    values: list[str],
    tolerance: dict[str, float],
    shift_hours: int = 0,
    drop_codes: list[str] | None = None,
    drop_rows: DataFrame | None = None,
    preferred: dict[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Prepare the new table, then report one-sided rows, cell differences and their summary."""
    prepared = exclude(new, drop_codes, drop_rows)
    if preferred:
        prepared = prefer_names(prepared, preferred)
    if shift_hours:
        prepared = shift_clock(prepared, shift_hours)
    joined = join_versions(old, prepared, keys, values)
    diffs = difference_rows(joined, keys, values, tolerance)
    return {
        "only_old": only_in(joined, keys, values, "old"),
        "only_new": only_in(joined, keys, values, "new"),
        "diffs_long": diffs,
        "diff_summary": difference_summary(diffs),
    }


def match_summary(rows: DataFrame, by: str = "variable") -> DataFrame:
    """Match counts per variable where a cell unknown on both sides counts as a match."""
    both = F.col("value_old").isNull() & F.col("value_new").isNull()
    ok = F.coalesce(F.col("within_tol"), both)
    n = F.count(F.lit(1))
    return rows.groupBy(by).agg(
        n.alias("n_units"), F.count_if(ok).alias("n_match"), F.count_if(~ok).alias("n_diff"),
        (F.count_if(ok) / n).alias("share_match"), F.avg("absv").alias("mean_abs_diff"), F.max("absv").alias("max_abs_diff"),
    )


def distance_agreement(old: DataFrame, new: DataFrame, keys: list[str], tol_km: float, near_km: float) -> DataFrame:
    """Agreement of two distance tables, also for the near pairs that decide buffer membership."""
    j = join_versions(old, new, keys, ["distance_km"]).where(F.col(keys[0]) != F.col(keys[1]))
    j = j.where(F.col("distance_km_old").isNotNull() & F.col("distance_km_new").isNotNull())
    gap = F.abs(F.col("distance_km_new") - F.col("distance_km_old"))
    near = (F.col("distance_km_new") <= near_km) | (F.col("distance_km_old") <= near_km)
    ok = gap <= tol_km
    n, n_near = F.count(F.lit(1)), F.count_if(near)
    return j.agg(
        n.alias("n_pairs"), F.count_if(ok).alias("n_match"), F.avg(gap).alias("mean_abs_diff"), F.max(gap).alias("max_abs_diff"),
        ratio(F.count_if(ok).cast("double"), n).alias("share_match"),
        n_near.alias("n_pairs_near"), F.count_if(ok & near).alias("n_match_near"),
        F.avg(F.when(near, gap)).alias("mean_abs_diff_near"), F.max(F.when(near, gap)).alias("max_abs_diff_near"),
        ratio(F.count_if(ok & near).cast("double"), n_near).alias("share_match_near"),
    )


def census_profile(frames: dict[str, DataFrame]) -> DataFrame:
    """Size, adults, weight, schooling and women's share per labelled person table."""
    tagged = stack([df.withColumn("source", F.lit(k)) for k, df in frames.items()])
    return tagged.groupBy("source").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("adult") == 1).alias("n_adults"),
        F.sum("person_weight").alias("weighted_n"),
        wmean("educ_years", "person_weight").alias("mean_schooling"),
        F.avg(F.col("women").cast("double")).alias("share_women"),
        F.count_distinct("geo_id").alias("n_geo_units"),
    )


def dominant_group(people: DataFrame, group: str, weight: str = "person_weight") -> DataFrame:
    """Group with the largest weight in each unit; ties go to the smaller group."""
    sums = people.where(F.col(group).isNotNull()).groupBy("geo_id", group).agg(F.sum(weight).alias("_w"))
    return sums.groupBy("geo_id").agg(
        F.max_by(group, F.struct(F.col("_w"), -F.col(group))).alias(group), F.sum("_w").alias("pop_w")
    )


def quintile_rows(exposure: DataFrame, days: DataFrame | None, units: DataFrame, pollutant: str, by: list[str] = ()) -> DataFrame:
    """Mean, hour shares and day counts by the units' dominant group, for each of ``by`` apart.

    Tables that share columns of ``by`` are joined on these as well as on the unit.
    """
    by = list(by)
    e = exposure.select(*by, "geo_id", F.col(f"avg_{pollutant}").alias("_x"), F.col(f"hrs_d_{pollutant}_it1").alias("_h1"),
                        F.col(f"hrs_d_{pollutant}_it4").alias("_h4"), F.col(f"total_hrs_{pollutant}").alias("_n"))
    j = e.where(F.col("_x").isNotNull()).join(units, [c for c in by if c in units.columns] + ["geo_id"])
    if days is not None:
        j = j.join(days, [c for c in by if c in days.columns] + ["geo_id"], "left")
    total = F.greatest(F.coalesce(F.sum("_n"), F.lit(0)), F.lit(1))
    day_cols = [c for c in (days.columns if days is not None else []) if c not in ("geo_id", *by)]
    return j.groupBy(*by, "edu_quintile").agg(
        F.count(F.lit(1)).alias("n_geo"),
        wmean("_x", "pop_w").alias("weighted_mean_conc"),
        (F.coalesce(F.sum("_h1"), F.lit(0)) / total).alias("share_hrs_above_it1"),
        (F.coalesce(F.sum("_h4"), F.lit(0)) / total).alias("share_hrs_above_it4"),
        *[wmean(F.col(c).cast("double"), "pop_w").alias(c) for c in day_cols],
    ).withColumn("pollutant", F.lit(pollutant))


def quintile_table(exposure: DataFrame, days: DataFrame | None, units: DataFrame, pollutant: str, step: str) -> DataFrame:
    """One vintage's table under its label."""
    return quintile_rows(exposure, days, units, pollutant).withColumn("step_id", F.lit(step))


def progression(steps: list[DataFrame]) -> DataFrame:
    """All vintages stacked."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), steps)


def top_bottom_gap(table: DataFrame, value: str = "weighted_mean_conc") -> DataFrame:
    """Difference and ratio of the fifth and first group per step and pollutant."""
    at = lambda g: F.max(F.when(F.col("edu_quintile") == g, F.col(value)))
    p = table.groupBy("step_id", "pollutant").agg(at(1).alias("q1"), at(5).alias("q5"))
    return p.withColumn("gap", F.col("q5") - F.col("q1")).withColumn("ratio", ratio(F.col("q5"), F.col("q1")))
