"""Census harmonisation and collapse to geographic units."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.functions.numbers import is_in, ratio, wmean
from airgrid.operators.reshape import canonical_names

# Inclusive years of schooling per education band.
BANDS = {
    "no_ed": (0, 0),
    "hs_inc": (1, 11),
    "hs_com": (12, 12),
    "col_inc": (13, 16),
    "col_com": (17, 17),
    "grad": (18, 99),
}
BANDS_11 = {**BANDS, "hs_inc": (1, 10), "hs_com": (11, 12)}


def education_bands(df: DataFrame, years: str = "educ_years", bands: dict | None = None) -> DataFrame:
    """One 0/1 column per band, NULL where schooling is unknown."""
    x = F.col(years)
    out = df
    for name, (lo, hi) in (BANDS if bands is None else bands).items():
        out = out.withColumn(name, F.when(x.isNotNull(), x.between(lo, hi).cast("int")))
    return out


def age_from_band(c: Column) -> Column:
    """Middle of a five-year age band numbered from 1."""
    return (c - 1) * 5 + 2.5


def indicators(df: DataFrame, sex: str | None = None, female=2, age: str = "age", employed: str | None = None,
               employed_codes=(), adult_age: int = 25) -> DataFrame:
    """Women, adult and employed flags; codes outside a set, also unknown ones, count as zero."""
    out = df.withColumn("adult", F.coalesce((F.col(age) >= adult_age).cast("int"), F.lit(0)))
    if sex:
        out = out.withColumn("women", is_in(sex, [female]).cast("int"))
    if employed:
        out = out.withColumn("employed", is_in(employed, employed_codes).cast("int"))
    return out


def collapse_census(
    people: DataFrame,
    key: str = "geo_id",
    weight: str = "person_weight",
    years: str = "educ_years",
    bands: list[str] = tuple(BANDS),
    others: list[str] = (),
    means: list[str] = (),
    denominator: str = "known",
) -> DataFrame:
    """Unit table: population, records, mean schooling, weighted counts and shares.

    Education shares are over people with known schooling, other shares over everybody;
    ``denominator="all"`` puts everything over the whole population, the rule of the older census.
    """
    w, x = F.col(weight), F.col(years)
    aggs = [
        F.sum(w).alias("pop_total"),
        F.count(F.lit(1)).alias("n_records"),
        F.coalesce(F.sum(F.when(x.isNotNull(), w)), F.lit(0.0)).alias("pop_educ_known"),
        wmean(x, w).alias("education_mean"),
        *[F.coalesce(F.sum(F.col(b) * w), F.lit(0.0)).alias(f"count_{b}") for b in [*bands, *others]],
        *[wmean(m, w).alias(f"{m}_mean") for m in means],
    ]
    out = people.groupBy(key).agg(*aggs)
    base = F.col("pop_educ_known") if denominator == "known" else F.col("pop_total")
    for b in bands:
        out = out.withColumn(f"share_{b}_pop", ratio(F.col(f"count_{b}"), base))
    for b in others:
        out = out.withColumn(f"share_{b}_pop", ratio(F.col(f"count_{b}"), F.col("pop_total")))
    return out


@dataclass
class CensusSpec:
    """What one census needs: rename map, level, identifier width and the recode of schooling."""

    mapping: dict[str, str]
    geo_level: str
    width: int | None = None
    state: str | None = None
    raw: list[str] = field(default_factory=list)
    bands: dict = field(default_factory=lambda: dict(BANDS))
    sex: str | None = None
    employed: str | None = None
    employed_codes: tuple = ()


def harmonise_census(raw: DataFrame, spec: CensusSpec) -> DataFrame:
    """Provider microdata to the canonical person table."""
    named = canonical_names(raw, spec.mapping, spec.geo_level, spec.raw, spec.width, spec.state)
    flagged = indicators(named, spec.sex, employed=spec.employed, employed_codes=spec.employed_codes)
    return education_bands(flagged, bands=spec.bands)


def star_join(people: DataFrame, households: DataFrame, dwellings: DataFrame, zones: DataFrame,
              household_key: str, dwelling_key: str, zone_key: str, kept_zones: DataFrame | None = None) -> DataFrame:
    """Person to household to dwelling to zone, optionally only for kept zones."""
    out = people.join(households, household_key).join(dwellings, dwelling_key).join(zones, zone_key)
    return out.join(kept_zones.select(zone_key).distinct(), zone_key, "left_semi") if kept_zones is not None else out
