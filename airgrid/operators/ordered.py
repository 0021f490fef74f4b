"""Running sums, quantiles and ranks over long ordered groups.

A window ordered over a whole group puts that group into one task. Here rows are range-partitioned
on (group, order) instead, so a group of any size spreads over many tasks. The range number is
written with the rows to the checkpoint folder, which keeps it fixed when an executor is lost; sums
per range are then added up and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airgrid.session import broadcast_if_small, reliable_checkpoint


def running_sum(
    df: DataFrame,
    by: list[str],
    order: list[str],
    value: str,
    out: str = "running",
    total: str = "total",
    partitions: int | None = None,
) -> DataFrame:
    """Add the inclusive running sum of ``value`` within ``by`` along ``order`` and the group total.

    ``order`` must be a full order inside the group; NULL counts as zero.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in by + order]
    placed = df.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id())
    placed = reliable_checkpoint(placed)
    sums = placed.groupBy(*by, "_range").agg(F.coalesce(F.sum(value), F.lit(0)).alias("_sum"))
    # Without groups there is one row per range; with groups the number of rows is checked.
    bounded = broadcast_if_small if by else F.broadcast
    # One row per (group, range): at most the number of groups plus the number of ranges.
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    offsets = sums.select(
        *[F.col(c).alias(f"_of_{c}") for c in by],
        F.col("_range").alias("_of_range"),
        F.coalesce(
            F.sum("_sum").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
        F.sum("_sum").over(whole).alias(total),
    )
    local = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = placed.withColumn("_local", F.coalesce(F.sum(value).over(local), F.lit(0)))
    cond = F.col("_range") == F.col("_of_range")
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    joined = inner.join(bounded(offsets), cond, "inner")
    return joined.select(*df.columns, (F.col("_before") + F.col("_local")).alias(out), total)


def assign_groups(
    df: DataFrame, var: str, weight: str, n: int, out: str, tie: list[str], partitions: int | None = None
) -> DataFrame:
    """Equal-population groups 1..n by running weight share of ``var``.

    ``tie`` completes the order (unit id, then a unique row key). Rows without value or weight get
    NULL and stay outside the total. A share equal to k/n still belongs to group k.
    """
    valid = F.col(var).isNotNull() & F.col(weight).isNotNull()
    ranked = running_sum(df.where(valid), [], [var] + tie, weight, "_cum", "_tot", partitions)
    share = F.col("_cum") / F.col("_tot")
    passed = sum([F.when(share > F.lit(k / n), 1).otherwise(0) for k in range(1, n)], F.lit(0))
    grouped = ranked.withColumn(out, (passed + 1).cast("int")).drop("_cum", "_tot")
    return grouped.unionByName(df.where(~valid).withColumn(out, F.lit(None).cast("int")))


def share_bands(
    df: DataFrame, var: str, weight: str, edges: list[float], out: str, tie: list[str], partitions: int | None = None
) -> DataFrame:
    """Right-closed bands of the running weight share, numbered from 1; edges are the upper bounds."""
    ranked = running_sum(df.where(F.col(var).isNotNull()), [], [var] + tie, weight, "_cum", "_tot", partitions)
    share = F.col("_cum") / F.col("_tot")
    band = F.lit(len(edges) + 1)
    for i in range(len(edges), 0, -1):
        band = F.when(share <= F.lit(edges[i - 1]), F.lit(i)).otherwise(band)
    return ranked.withColumn(out, band.cast("int")).drop("_cum", "_tot")


def weighted_quantile(
    df: DataFrame, by: list[str], x: str, w: str, q: float, out: str, partitions: int | None = None
) -> DataFrame:
    """Smallest x whose cumulative weight share reaches ``q``; rows without x or positive w are ignored."""
    points = df.where(F.col(x).isNotNull() & (F.col(w) > 0)).groupBy(*by, x).agg(F.sum(w).alias("_w"))
    ranked = running_sum(points, by, [x], "_w", "_cum", "_tot", partitions)
    return ranked.groupBy(*by).agg(F.min(F.when(F.col("_cum") / F.col("_tot") >= q, F.col(x))).alias(out))


def quantiles(
    df: DataFrame, by: list[str], x: str, probs: dict[str, float], partitions: int | None = None
) -> DataFrame:
    """Exact interpolated quantiles (h = (n - 1) p), one column per entry of ``probs``."""
    points = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_sum(points, by, [x], "_n", "_cum", "_tot", partitions)
    aggs = [F.max("_tot").alias("_tot")]
    for name, p in probs.items():
        h = (F.col("_tot") - 1) * F.lit(float(p))
        aggs.append(F.min(F.when(F.col("_cum") > F.floor(h), F.col(x))).alias(f"_lo_{name}"))
        aggs.append(F.min(F.when(F.col("_cum") > F.ceil(h), F.col(x))).alias(f"_hi_{name}"))
    found = ranked.groupBy(*by).agg(*aggs)
    cols = []
    for name, p in probs.items():
        h = (F.col("_tot") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        cols.append((lo + (h - F.floor(h)) * (hi - lo)).alias(name))
    return found.select(*by, *cols)


def average_rank(df: DataFrame, x: str, out: str = "rank", total: str = "n", partitions: int | None = None) -> DataFrame:
    """Rank with ties at their average, and the number of ranked rows; rows without x are dropped."""
    counts = df.where(F.col(x).isNotNull()).groupBy(x).agg(F.count(F.lit(1)).alias("_ties"))
    ranked = running_sum(counts, [], [x], "_ties", "_cum", total, partitions)
    rank = F.col("_cum") - F.col("_ties") + (F.col("_ties") + 1) / F.lit(2.0)
    return df.join(broadcast_if_small(ranked.select(x, rank.alias(out), total)), x)


def rank_quintile(df: DataFrame, x: str, out: str, n: int = 5, partitions: int | None = None) -> DataFrame:
    """ceil(n * average rank / N), kept within 1..n."""
    ranked = average_rank(df, x, "_rank", "_n", partitions)
    band = F.ceil(F.lit(float(n)) * F.col("_rank") / F.col("_n"))
    return ranked.withColumn(out, F.least(F.lit(n), F.greatest(F.lit(1), band)).cast("int")).drop("_rank", "_n")


def percentile_rank(df: DataFrame, x: str, tie: list[str], out: str, partitions: int | None = None) -> DataFrame:
    """Row position along (x, tie) divided by the number of rows."""
    ones = df.withColumn("_one", F.lit(1).cast("long"))
    ranked = running_sum(ones, [], [x] + tie, "_one", "_pos", "_n", partitions)
    return ranked.withColumn(out, F.col("_pos") / F.col("_n")).drop("_one", "_pos", "_n")


def with_group_total(df: DataFrame, by: list[str], value: Column, out: str) -> DataFrame:
    """Group sum on every row by aggregate and join back, so no group is gathered in one task."""
    totals = df.groupBy(*by).agg(F.sum(value).alias(out))
    return df.join(broadcast_if_small(totals), by)


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first along ``order``, found by a combinable aggregate."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("_first")
    )
    return picked.select(*keys, *[F.col("_first")[c].alias(c) for c in rest]).select(*df.columns)


def modal_value(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Most frequent value per key; ties go to the smallest value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(out))


def winsorise(df: DataFrame, x: str, out: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip positive values into [low quantile of positive values, high quantile of all values].

    Both come from one sort of the distinct values: a positive value's rank among positive ones is its rank among all
    less the number of others.
    """
    points = df.where(F.col(x).isNotNull()).groupBy(x).agg(F.count(F.lit(1)).alias("_n"))
    ranked = reliable_checkpoint(running_sum(points, [], [x], "_n", "_cum", "_tot"))
    others = ranked.agg(F.coalesce(F.sum(F.when(F.col(x) <= 0, F.col("_n"))), F.lit(0)).alias("v")).scalar()
    ranked = ranked.withColumn("_others", others)
    spots = {"low": (F.col("_tot") - F.col("_others") - 1) * F.lit(float(low)), "high": (F.col("_tot") - 1) * F.lit(float(high))}
    shift = {"low": F.col("_others"), "high": F.lit(0)}
    aggs = []
    for name, h in spots.items():
        aggs += [F.min(F.when(F.col("_cum") > shift[name] + step(h), F.col(x))).alias(f"{end}_{name}") for end, step in (("a", F.floor), ("b", F.ceil))]
        aggs.append(F.max(h - F.floor(h)).alias(f"f_{name}"))
    found = ranked.agg(*aggs)
    at = lambda name: F.col(f"a_{name}") + F.col(f"f_{name}") * (F.col(f"b_{name}") - F.col(f"a_{name}"))
    lo, hi = (found.select(at(name).alias(name)).scalar() for name in ("low", "high"))
    return df.withColumn(out, F.when(F.col(x) > 0, F.least(F.greatest(F.col(x), lo), hi)).otherwise(F.col(x)))
