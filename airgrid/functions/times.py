"""Wall-clock functions. Timestamps carry no zone anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_first(c: str | Column, formats: list[str]) -> Column:
    """First format that parses wins; none gives NULL."""
    return F.coalesce(*[F.try_to_timestamp(_col(c), F.lit(f)) for f in formats]).cast("timestamp_ntz")


def add_hours(ts: Column, hours: Column) -> Column:
    """Shift a wall-clock timestamp by whole hours."""
    return ts + F.make_dt_interval(F.lit(0), hours.cast("int"))


def parse_with_hour_24(c: str | Column) -> Column:
    """``dd-MM-yyyy HH:mm`` where 24:00 is midnight of the next day; other text gives NULL."""
    text = F.trim(_col(c))
    ok = text.rlike(r"^\d{2}-\d{2}-\d{4} \d{2}:\d{2}$")
    late = F.substring(text, 12, 2) == "24"
    plain = F.when(late, F.concat(F.substring(text, 1, 11), F.lit("00"), F.substring(text, 14, 3))).otherwise(text)
    ts = F.try_to_timestamp(F.when(ok, plain), F.lit("dd-MM-yyyy HH:mm")).cast("timestamp_ntz")
    return F.when(late, ts + F.expr("INTERVAL 1 DAY")).otherwise(ts)


def date_plus_hour(day: Column, hour: Column) -> Column:
    """Date plus an hour of day; hour 24 rolls over by itself."""
    return add_hours(day.cast("timestamp_ntz"), hour)


def clamp_hour(c: str | Column) -> Column:
    """Hour forced into 0..23, the per-source alternative to rolling over."""
    return F.greatest(F.lit(0), F.least(F.lit(23), _col(c).try_cast("int")))


def parse_compact(day: Column, clock: Column) -> Column:
    """``yyMMdd`` and ``HHmm`` numbers that lost leading zeros."""
    text = F.concat(F.lpad(F.trim(day), 6, "0"), F.lit(" "), F.lpad(F.trim(clock), 4, "0"))
    return F.try_to_timestamp(text, F.lit("yyMMdd HHmm")).cast("timestamp_ntz")


def parse_month_name(c: str | Column) -> Column:
    """``01jan2023 05:00:00``."""
    text = _col(c)
    fixed = F.concat(F.substring(text, 1, 2), F.initcap(F.substring(text, 3, 3)), F.substring(text, 6, 100))
    return F.try_to_timestamp(fixed, F.lit("ddMMMyyyy HH:mm:ss")).cast("timestamp_ntz")


def shift_clock(df: DataFrame, hours: int, ts: str = "datetime") -> DataFrame:
    """Shift ``ts`` and rebuild the calendar columns that are present."""
    moved = add_hours(F.col(ts), F.lit(hours))
    out = df.withColumn(ts, moved)
    for name, fn in (("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("hour", F.hour)):
        if name in df.columns:
            out = out.withColumn(name, fn(F.col(ts)))
    return out


def floor_hour(c: str | Column) -> Column:
    return F.date_trunc("hour", _col(c)).cast("timestamp_ntz")


def iso_weekday(c: str | Column) -> Column:
    """Monday is 1."""
    return F.weekday(_col(c)) + F.lit(1)


def year_month(c: str | Column) -> Column:
    return F.date_format(_col(c), "yyyy-MM")


def iso_text(c: str | Column) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd HH:mm:ss")


def hours_in_year(year: Column) -> Column:
    """8760 or 8784."""
    return F.datediff(F.make_date(year + 1, F.lit(1), F.lit(1)), F.make_date(year, F.lit(1), F.lit(1))) * 24


def in_range(c: str | Column, start: str, end: str) -> Column:
    """Half-open timestamp range."""
    return (_col(c) >= F.lit(start).cast("timestamp_ntz")) & (_col(c) < F.lit(end).cast("timestamp_ntz"))
