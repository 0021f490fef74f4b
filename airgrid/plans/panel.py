"""From long readings to the wide hourly panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.operators.reshape import to_wide
from airgrid.session import broadcast_if_small


def mean_duplicates(readings: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """One row per key with the mean of its values."""
    return readings.groupBy(*keys).agg(F.avg(value).alias(value))


def widen(readings: DataFrame, params: dict[str, list[str]], station: str = "station", by: list[str] = ()) -> DataFrame:
    """Wide panel: one column per pollutant, the mean over the parameters listed for it; ``by`` keeps further keys."""
    cols = [
        F.avg(F.when(F.col("param").isin(list(codes)), F.col("value"))).alias(name)
        for name, codes in params.items()
    ]
    return readings.groupBy(*by, station, "datetime").agg(*cols).withColumn("year", F.year("datetime"))


#: Label of an hour that the primary source covers without a value.
NOT_FILLED = "primary (hour missing, not filled)"


def precedence_merge(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Merge two sources hour by hour.

    Where the primary source covers a (station, year, param) with any value, it decides every hour of
    it, NULLs included; elsewhere the secondary source does. ``source`` tells hours that the primary
    source decides without a value apart.
    """
    keys = ["station", "datetime", "param"]
    a = mean_duplicates(primary, keys).withColumnRenamed("value", "_first")
    b = mean_duplicates(secondary, keys).withColumnRenamed("value", "_second")
    both = a.join(b, keys, "full").withColumn("year", F.year("datetime"))
    covered = (
        primary.where(F.col("value").isNotNull())
        .groupBy("station", F.year("datetime").alias("year"), "param")
        .agg(F.lit(True).alias("_covered"))
    )
    out = both.join(broadcast_if_small(covered), ["station", "year", "param"], "left")
    use_first = F.coalesce(F.col("_covered"), F.lit(False))
    return out.select(
        *keys,
        "year",
        F.when(use_first, F.col("_first")).otherwise(F.col("_second")).alias("value"),
        F.when(use_first & F.col("_first").isNull(), F.lit(NOT_FILLED)).when(use_first, F.lit("primary")).otherwise(F.lit("secondary")).alias("source"),
    )


def source_discrepancy(a: DataFrame, b: DataFrame) -> DataFrame:
    """Hours both sources report, with count, mean and maximum absolute difference."""
    keys = ["station", "datetime", "param"]
    x = mean_duplicates(a, keys).where(F.col("value").isNotNull()).withColumnRenamed("value", "_a")
    y = mean_duplicates(b, keys).where(F.col("value").isNotNull()).withColumnRenamed("value", "_b")
    gap = F.abs(F.col("_a") - F.col("_b"))
    return x.join(y, keys).groupBy("station", "param").agg(
        F.count(F.lit(1)).alias("n_overlap"), F.avg(gap).alias("mean_abs_diff"), F.max(gap).alias("max_abs_diff")
    )


def smallest_tag(readings: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """Deterministic tag per key."""
    return readings.groupBy(*keys).agg(F.min(tag).alias(tag))


def one_code_per_name(readings: DataFrame, name: str, code: str) -> DataFrame:
    """Names that carry more than one code."""
    return readings.groupBy(name).agg(F.count_distinct(code).alias("n_codes")).where(F.col("n_codes") > 1)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def attach_code(grid: DataFrame, readings: DataFrame, reference: DataFrame) -> DataFrame:
    """Grid rows with readings whose code equals the reference code, if the station has one."""
    j = grid.join(broadcast_if_small(reference.select("station", F.col("code").alias("_ref"))), "station", "left")
    r = readings.select(F.col("station").alias("_s"), F.col("datetime").alias("_d"), "code", "param", "value")
    cond = (
        (j["station"] == r["_s"]) & (j["datetime"] == r["_d"])
        & (F.coalesce(j["_ref"], r["code"]) == r["code"])
    )
    return j.join(r, cond, "left").drop("_s", "_d", "_ref")


def merge_registries(base: DataFrame, extra: DataFrame, key: str, tag: str) -> DataFrame:
    """Enrich the base registry, then append the rows only the second one has."""
    new_cols = [c for c in extra.columns if c != key and c not in base.columns]
    enriched = base.join(broadcast_if_small(extra.select(key, *new_cols)), key, "left").withColumn("source", F.lit("base"))
    rest = extra.join(broadcast_if_small(base.select(key)), key, "left_anti").withColumn("source", F.lit(tag))
    return enriched.unionByName(rest, allowMissingColumns=True)


def pivot_mean(readings: DataFrame, params: list[str]) -> DataFrame:
    """Conditional pivot-average over a fixed parameter list."""
    return to_wide(readings, ["station", "datetime"], "param", params)
