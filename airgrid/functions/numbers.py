"""Masks, number parsing and weighted means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """NaN and infinities become NULL."""
    x = _col(c)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def mask_sentinel(c: str | Column, low: float = 0, high: float = 9999) -> Column:
    """Values below ``low`` or from ``high`` upwards become NULL."""
    x = _col(c)
    return F.when((x >= low) & (x < high), x)


def mask_values(c: str | Column, values) -> Column:
    """Listed codes become NULL."""
    x = _col(c)
    return F.when(~x.isin(list(values)), x)


def is_in(c: str | Column, values) -> Column:
    """Membership that is false, not unknown, for NULL."""
    return F.coalesce(_col(c).isin(list(values)), F.lit(False))


def parse_number(c: str | Column, decimal: str = ".") -> Column:
    """Text to double. With a decimal point, commas are thousands marks; junk gives NULL."""
    text = F.trim(_col(c))
    text = F.replace(text, F.lit(","), F.lit("." if decimal == "," else ""))
    return text.try_cast("double")


def ratio(num: Column, den: Column) -> Column:
    """Quotient, NULL where the denominator is zero."""
    return num / F.nullif(den, F.lit(0.0))


def wmean(x: str | Column, w: str | Column) -> Column:
    """Aggregate: weighted mean over rows where the value is known."""
    x, w = _col(x), _col(w)
    known = x.isNotNull()
    return ratio(F.sum(F.when(known, x * w)), F.sum(F.when(known, w)))


def any_present(cols) -> Column:
    """True when at least one column is non-NULL."""
    return F.coalesce(*[_col(c) for c in cols]).isNotNull()


def rescale_if_large(df: DataFrame, name: str, limit: float = 100.0, factor: float = 1000.0) -> DataFrame:
    """Divide a whole column by ``factor`` when its maximum passes ``limit``."""
    top = df.agg(F.max(name)).scalar()
    return df.withColumn(name, F.when(top > limit, F.col(name) / factor).otherwise(F.col(name)))
