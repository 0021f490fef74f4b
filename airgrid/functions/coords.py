"""Coordinates and heights written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A magnitude and the letter of its hemisphere.
HALF = r"(-?\d+(?:[.,]\d+)?)\s*([neosw])"


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def _angle(text: Column, letters: str, negative: str) -> Column:
    """First angle of ``text`` whose hemisphere is one of ``letters``; those in ``negative`` turn it below zero."""
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(HALF), F.lit(1)).alias("size"), F.regexp_extract_all(text, F.lit(HALF), F.lit(2)).alias("half")
    )
    own = F.get(F.filter(found, lambda x: F.contains(F.lit(letters), x["half"])), F.lit(0))
    size = _number(own["size"])
    return F.when(F.contains(F.lit(negative), own["half"]), -F.abs(size)).otherwise(size)


def text_lat_lon(c: str | Column) -> tuple[Column, Column]:
    """``20.06 N, 99.22 O`` to (lat, lon), in either order; south, west and O are negative."""
    text = F.lower(F.col(c) if isinstance(c, str) else c)
    return _angle(text, "ns", "s"), _angle(text, "eow", "ow")


def text_altitude(c: str | Column) -> Column:
    """First number of a text such as ``2240 msnm``."""
    kept = F.regexp_replace(F.lower(F.col(c) if isinstance(c, str) else c), r"[^0-9.,-]", "")
    return F.regexp_replace(kept, r"^([^,]*),", "$1.").try_cast("double")


def utm_from_text(c: str | Column) -> tuple[Column, Column]:
    """Easting and northing: the first number, and the last one of a text that ends in N, else the second."""
    text = F.trim(F.col(c) if isinstance(c, str) else c)
    numbers = F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0))
    north = F.when(F.endswith(text, F.lit("N")), F.try_element_at(numbers, F.lit(-1))).otherwise(F.get(numbers, F.lit(1)))
    return F.get(numbers, F.lit(0)).try_cast("double"), north.try_cast("double")


def shifted_utm(x: str, y: str, zone: str) -> tuple[Column, Column]:
    """Repair of rows whose columns slipped: six whole digits are an easting, seven a northing."""

    def pick(digits: int, order: list[str]) -> Column:
        values = F.array(*[F.col(c).try_cast("double") for c in order])
        return F.get(F.filter(values, lambda v: (v >= 10.0 ** (digits - 1)) & (v < 10.0**digits)), F.lit(0))

    return pick(6, [x, y, zone]), pick(7, [y, zone, x])


def in_box(x: str | Column, y: str | Column, x_range: tuple, y_range: tuple) -> Column:
    """Plausibility box; unknown coordinates fail."""
    xc, yc = (F.col(v) if isinstance(v, str) else v for v in (x, y))
    return F.coalesce(xc.between(*x_range) & yc.between(*y_range), F.lit(False))


def override_point(df, corrections, key: str):
    """Replace coordinates of listed ids; ``corrections`` is a short literal table."""
    c = corrections.select(key, F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    joined = df.join(F.broadcast(c), key, "left")
    return joined.withColumn("lon", F.coalesce("_lon", "lon")).withColumn("lat", F.coalesce("_lat", "lat")).drop("_lon", "_lat")
