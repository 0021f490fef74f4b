"""Wide and long forms, dense grids, set membership and samples."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.functions import times
from airgrid.session import require_columns


def to_long(df: DataFrame, keys: list[str], values: list[str], name: str = "param", value: str = "value",
            keep_null: bool = True) -> DataFrame:
    """Wide to long; ``keep_null=False`` drops missing values."""
    out = df.select(*keys, *values).unpivot(keys, values, name, value)
    return out if keep_null else out.where(F.col(value).isNotNull())


def to_wide(df: DataFrame, keys: list[str], name: str, values: list, value: str = "value", how=F.avg,
            fill: float | None = None) -> DataFrame:
    """Long to wide over a known value list by conditional aggregation; duplicates meet in ``how``."""
    cols = [how(F.when(F.col(name) == F.lit(v), F.col(value))).alias(str(v)) for v in values]
    out = df.groupBy(*keys).agg(*cols)
    return out if fill is None else out.na.fill(fill, [str(v) for v in values])


def hour_sequence(start, end):
    return F.explode(F.sequence(start, end, F.expr("INTERVAL 1 HOUR")))


def dense_hours(df: DataFrame, key: str = "station", ts: str = "datetime", per_year: bool = True) -> DataFrame:
    """Every key of a year with every hour between the first and last hour of that year.

    With ``per_year=False`` the span is that of the whole table.
    """
    span_keys = ["year"] if per_year else []
    base = df.select(key, ts, F.year(ts).alias("year"))
    members = base.groupBy(*span_keys, key).agg(F.min(ts).alias("_first"))
    if per_year:
        spans = base.groupBy("year").agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
        grid = members.join(F.broadcast(spans), "year")  # one row per year
    else:
        spans = base.agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
        grid = members.withColumn("_lo", spans.select("_lo").scalar()).withColumn("_hi", spans.select("_hi").scalar())
    hours = grid.select(key, hour_sequence(F.col("_lo"), F.col("_hi")).alias(ts))
    return hours.withColumn("year", F.year(ts))


def densify(df: DataFrame, key: str = "station", ts: str = "datetime", per_year: bool = True) -> DataFrame:
    """Left join of the table onto its dense grid."""
    grid = dense_hours(df, key, ts, per_year)
    return grid.join(df.drop("year"), [key, ts], "left")


def missing_combinations(df: DataFrame, left: str, right: str) -> DataFrame:
    """(left, right) combinations of the values present that have no row.

    The right side is the short list (years); it is packed into one array and exploded, so each left
    value is expanded on its own.
    """
    present = df.select(left, right).distinct()
    years = present.select(right).distinct().agg(F.array_sort(F.collect_set(right)).alias("v"))
    every = present.select(left).distinct().withColumn(right, F.explode(years.scalar()))
    return every.join(present, [left, right], "left_anti")


def stack(frames: list[DataFrame]) -> DataFrame:
    """Union by name; absent columns are NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def membership(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Every id of either table with flags for where it occurs."""
    a = old.select(key).distinct().withColumn("in_old", F.lit(1))
    b = new.select(key).distinct().withColumn("in_new", F.lit(1))
    both = a.unionByName(b, allowMissingColumns=True).groupBy(key)
    return both.agg(F.count("in_old").cast("int").alias("in_old"), F.count("in_new").cast("int").alias("in_new"))


def random_rows(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """Reproducible sample of n rows: those whose key and seed have the least MD5, which any engine can repeat."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), F.col(key)).limit(n)


def columns_matching(df: DataFrame, pattern: str, any_of: list[str] | None = None) -> list[str]:
    """Column names matching a pattern and, if given, holding one of the tokens."""
    found = [c for c in df.columns if re.search(pattern, c)]
    if any_of:
        found = [c for c in found if any(t in c for t in any_of)]
    if not found:
        raise ValueError("no column matches")
    return found


def split_outcome(name: str, pollutants: list[str]) -> tuple[str, str]:
    """(outcome label, pollutant) of a column name; the longest pollutant token wins."""
    token = max((p for p in pollutants if p in name), key=len)
    label = re.sub(f"_{re.escape(token)}_?", "_", name, count=1)
    return label.strip("_"), token


def resolve_column(df: DataFrame, candidates: list[str]) -> str:
    """First candidate present, compared without case."""
    lower = {c.lower(): c for c in df.columns}
    for c in candidates:
        if c.lower() in lower:
            return lower[c.lower()]
    raise ValueError(f"none of {candidates} is a column")


def select_aliases(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Select canonical names from the first alias present; absent ones are left out."""
    lower = {c.lower(): c for c in df.columns}
    cols = []
    for name, options in aliases.items():
        hit = next((lower[o.lower()] for o in options if o.lower() in lower), None)
        if hit:
            cols.append(F.col(hit).alias(name))
    return df.select(*cols)


def canonical_names(df: DataFrame, mapping: dict[str, str], geo_level: str, raw_cols: list[str] = (),
                    width: int | None = None, state: str | None = None) -> DataFrame:
    """Rename provider columns, mark raw ones once, force identifiers to text, stamp the level."""
    from airgrid.functions.keys import canonical_geo_id, safe_text

    require_columns(df, mapping, "mapping")
    out = df.withColumnsRenamed(mapping)
    marked = {c: "raw_" + c for c in raw_cols if c in out.columns and not c.startswith("raw_")}
    out = out.withColumnsRenamed(marked)
    if "geo_id" in out.columns:
        out = out.withColumn("geo_id", canonical_geo_id(safe_text(out, "geo_id"), width, state))
    return out.withColumn("geo_level", F.lit(geo_level))


def calendar(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """Add year, month, hour, ISO weekday and year-month label."""
    return (
        df.withColumn("year", F.year(ts))
        .withColumn("month", F.month(ts))
        .withColumn("hour", F.hour(ts))
        .withColumn("weekday", times.iso_weekday(ts))
        .withColumn("year_month", times.year_month(ts))
    )
