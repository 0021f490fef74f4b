"""Schooling recodes of the supported censuses: provider codes to years of schooling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Years of schooling per provider code.
BOGOTA_2005_LONG = {
    0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 2, 6: 3, 7: 4, 8: 5, 9: 6, 10: 7, 11: 8, 12: 9, 13: 10, 14: 12, 15: 10,
    16: 12, 17: 10, 18: 12, 19: 13, 20: 14, 21: 13, 22: 14, 23: 13, 24: 14, 25: 15, 26: 13, 27: 14, 28: 15,
    29: 16, 30: 17, 31: 17, 32: 17, 33: 17, 34: 18, 35: 19, 36: 19, 37: 20, 38: 21, 39: 22, 40: 23, 41: 23,
    42: 23, 43: 0,
}
BOGOTA_2005_SHORT = {13: 0, 1: 0, 2: 5, 3: 9, 4: 11, 5: 11, 6: 13, 7: 14, 8: 15, 9: 17, 10: 18, 11: 19, 12: 23}
BOGOTA_2018 = {10: 0, 1: 0, 2: 5, 3: 9, 4: 11, 5: 11, 6: 13, 7: 14, 8: 17, 9: 19}

# Fixed values: (level attended, finished 1 / not finished 2 / unknown None) to years of schooling.
SAO_PAULO_2010 = {
    ("02", "2"): 0, ("02", "1"): 2, ("03", "2"): 0, ("03", "1"): 5, ("04", "2"): 5, ("04", "1"): 9,
    ("05", "2"): 0, ("05", "1"): 4, ("05", None): 2, ("06", "2"): 4, ("06", "1"): 5, ("06", None): 4.5,
    ("07", "2"): 5, ("07", "1"): 9, ("08", "2"): 0, ("08", "1"): 9, ("09", "2"): 9, ("09", "1"): 12,
    ("10", "2"): 9, ("10", "1"): 12, ("11", "2"): 12, ("11", "1"): 17, ("12", "2"): 17, ("12", "1"): 19,
    ("13", "2"): 17, ("13", "1"): 19, ("14", "2"): 19, ("14", "1"): 23,
}
NO_SCHOOL = "01"


def years_from_code(c: str | Column, table: dict[int, int]) -> Column:
    """Single-code recode; unlisted codes give NULL."""
    code = (F.col(c) if isinstance(c, str) else c).try_cast("int")
    return F.create_map(*[F.lit(v) for k, y in table.items() for v in (k, float(y))])[code]


def sao_paulo_years(level: str | Column, finished: str | Column) -> Column:
    """Recode by level and completion; no schooling needs no completion code."""
    lv = F.col(level) if isinstance(level, str) else level
    fin = F.col(finished) if isinstance(finished, str) else finished
    key = F.concat_ws("/", lv, F.coalesce(fin, F.lit("?")))
    pairs = {f"{a}/{b or '?'}": float(y) for (a, b), y in SAO_PAULO_2010.items()}
    listed = F.create_map(*[F.lit(v) for k, y in pairs.items() for v in (k, y)])[key]
    return F.when(lv == NO_SCHOOL, F.lit(0.0)).otherwise(listed)


def mexico_years(accumulated: str, level: str, grade: str) -> Column:
    """Accumulated years, overruled by level and grade for tertiary and technical schooling."""
    ac, lv, gr = (F.col(c).try_cast("double") for c in (accumulated, level, grade))
    by_grade = lambda lvl, years: F.when(lv == lvl, F.create_map(*[F.lit(v) for g, y in years.items() for v in (float(g), float(y))])[gr])
    doctorate = F.coalesce(F.when((lv == 14) & (gr >= 4), F.lit(23.0)), by_grade(14, {1: 20, 2: 21, 3: 22}))
    master = F.when((lv == 13) & gr.between(2, 6) & (gr == F.floor(gr)), F.lit(19.0)).otherwise(by_grade(13, {1: 18}))
    degree = F.when(((lv == 10) & (gr == 6)) | ((lv == 11) & gr.isin(6.0, 7.0, 8.0)), F.lit(17.0))
    special = F.when(lv == 12, F.lit(17.0))
    counted = F.when(ac.between(13, 19), ac)
    technical = F.when(ac.isNotNull(), by_grade(8, {1: 13, 2: 14, 3: 15, 4: 16}))
    base = F.when(ac.between(0, 12), ac)
    # Thirteen to nineteen counted years stand, so a technical grade decides only for other counts.
    years = F.coalesce(doctorate, degree, master, special, counted, technical, base)
    return F.when(ac == 0, F.lit(0.0)).when((gr == 99) | (ac == 99), F.lit(None).cast("double")).otherwise(years)


def santiago_years(counted: str, level: str, finished: str) -> Column:
    """Counted years with doctorate and master refinements."""
    n, lv, fin = (F.col(c).try_cast("double") for c in (counted, level, finished))
    doctorate = F.when(lv == 14, F.when(fin == 4, F.lit(23.0)).when(fin == 3, F.lit(22.0)))
    top = F.coalesce(doctorate, F.lit(21.0))
    return (
        F.when(n == 21, top)
        .when((n == 20) & (lv == 13), F.lit(19.0))
        .when(n == 20, F.lit(20.0))
        .when(n.between(0, 19), n)
    )
