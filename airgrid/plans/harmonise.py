"""Six censuses as specifications: provider microdata to canonical person and unit tables.

A census is a set of SQL expressions over its provider's columns. Schooling rules may overwrite each other in
order; they are compiled to one ``when`` chain with the last rule on the outside, so the whole person table is one
projection. Spark sees plain expressions: columns no rule names are never read, and zones filter before anything else.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.functions import recode
from airgrid.functions.numbers import ratio, wmean
from airgrid.operators.ordered import winsorise
from airgrid.plans.census import BANDS, BANDS_11


@dataclass(frozen=True)
class Overwrite:
    """Where ``when`` holds the value becomes ``then`` (SQL); with ``clears`` it is lost where ``when`` is unknown."""

    when: str
    then: str
    clears: bool = False


def overwritten(rules: list[Overwrite]) -> Column:
    """Rules in order, each overwriting the ones before, as one chain; NULL where none holds."""
    out = F.lit(None).cast("double")
    for rule in rules:
        test, value = F.expr(rule.when), F.expr(f"cast({rule.then} as double)")
        out = F.when(test.isNull(), F.lit(None)).when(test, value).otherwise(out) if rule.clears else F.when(test, value).otherwise(out)
    return out


def by_code(code: str, years: dict) -> list[Overwrite]:
    """One rule for each listed code."""
    return [Overwrite(f"{code} = {k}", repr(float(v))) for k, v in years.items()]


def within(column: str, codes) -> str:
    """SQL of membership that is false, not unknown, for NULL."""
    return f"coalesce({column} in ({', '.join(repr(c) for c in codes)}), false)"


@dataclass(frozen=True)
class Census:
    """What one census needs. ``numbers`` are helper columns, read as doubles; flags are boolean SQL and stay unknown where it is."""

    name: str
    geo_level: str
    geo_id: str
    weight: str
    age: str
    years: list[Overwrite]
    flags: dict[str, str]
    adult: str = "age >= 25"
    numbers: dict[str, str] = field(default_factory=dict)
    income: str | None = None
    missing: tuple[str, ...] = ("", "NA")
    bands: dict = field(default_factory=lambda: dict(BANDS))
    zone_of: str = "geo_id"
    keep: str | None = None
    known_years_only: bool = False
    counted: tuple[str, ...] = ()
    raw: tuple[str, ...] = ()
    share_of_all: bool = False


def harmonise(raw: DataFrame, census: Census, zones: list[str] | None = None) -> DataFrame:
    """Canonical person table: geo_id, geo_level, person_weight, educ_years, age, adult, the bands, the flags, income and ``raw_`` columns.

    Provider codes are texts; those listed as missing are NULL. ``zones`` keeps the units whose zone (``zone_of``) is
    listed. Income at positive values is drawn to its 1st percentile among them and to the 99th of all values.
    """
    lost = list(census.missing)
    rows = raw.select(*[F.when(~F.trim(c).isin(lost), F.trim(c)).alias(c) if t == "string" else F.col(c) for c, t in raw.dtypes])
    if census.keep:
        rows = rows.where(F.expr(census.keep))
    rows = rows.withColumn("geo_id", F.expr(census.geo_id))
    if zones is not None:
        rows = rows.where(F.expr(census.zone_of).isin(list(zones)))
    for name, c in census.numbers.items():
        rows = rows.withColumn(name, F.expr(f"try_cast({c} as double)"))
    rows = rows.withColumns({"person_weight": F.expr(f"cast({census.weight} as double)"), "age": F.expr(f"cast({census.age} as double)"), "educ_years": overwritten(census.years)})
    if census.known_years_only:
        rows = rows.where(F.col("educ_years").isNotNull())
    flag = lambda sql: F.expr(sql).cast("int")
    rows = rows.withColumn("adult", flag(census.adult))
    for name, sql in census.flags.items():
        rows = rows.withColumn(name, flag(sql))
    x = F.col("educ_years")
    rows = rows.withColumns({name: F.lit(None).cast("int") if edges is None else x.between(*edges).cast("int") for name, edges in census.bands.items()})
    kept = ["person_weight", "educ_years", "age", "adult", *census.bands, *census.flags]
    out = rows.select("geo_id", F.lit(census.geo_level).alias("geo_level"), *kept, *([F.expr(f"try_cast({census.income} as double)").alias("income_raw")] if census.income else []), *[F.col(c).alias(f"raw_{c}") for c in census.raw])
    if not census.income:
        return out
    return winsorise(out, "income_raw", "income")


def collapse(people: DataFrame, census: Census) -> DataFrame:
    """Unit table of the adults: population, records, schooling, weighted counts and shares, income.

    Schooling is measured over adults who report it, other shares over all; with ``share_of_all`` every share is over all.
    """
    w = F.col("person_weight")
    counted = list(census.counted)
    adults = people.where("adult = 1")
    total = lambda c: F.coalesce(F.sum(F.col(c) * w), F.lit(0.0))
    aggs = [
        F.coalesce(F.sum("person_weight"), F.lit(0.0)).alias("pop_total"), F.count(F.lit(1)).alias("n_records"),
        F.coalesce(F.sum(F.when(F.col("educ_years").isNotNull(), w)), F.lit(0.0)).alias("pop_educ_known"), wmean("educ_years", "person_weight").alias("education_mean"),
        *[total(c).alias(f"count_{c}") for c in [*census.bands, *counted]],
    ]
    if census.income:
        aggs += [wmean("income", "person_weight").alias("income_mean"), (total("income_raw") / F.nullif(F.sum("person_weight"), F.lit(0.0))).alias("income_raw")]
    out = adults.groupBy("geo_id", "geo_level").agg(*aggs)
    known = F.col("pop_total") if census.share_of_all else F.col("pop_educ_known")
    shares = {f"share_{b}_pop": ratio(F.col(f"count_{b}"), known) for b in census.bands}
    return out.withColumns(shares | {f"share_{c}_pop": ratio(F.col(f"count_{c}"), F.col("pop_total")) for c in counted})


# ---- the six censuses -------------------------------------------------------------------------------

def _pad(column: str, width: int) -> str:
    return f"lpad(coalesce({column}, '0'), {width}, '0')"


# Parts of the 2005 block identifier with their widths, and its length by class of place.
BLOCK_2005 = (("I0A_DPTO", 2), ("I0B_MPIO", 3), ("I0C_CLASE", 1), ("I0D_SECT_R", 3), ("I0D_SEC_R", 2), ("I0D_CPOB", 3), ("I0D_SECT_U", 4), ("I0D_SEC_U", 2), ("I0D_MZA", 2))
LENGTH_2005 = {"2": 14, "3": 11}
_BLOCK = f"concat({', '.join(_pad(c, n) for c, n in BLOCK_2005)})"
_PLACE = f"concat({_pad('I0A_DPTO', 2)}, {_pad('I0B_MPIO', 3)})"
_WOMEN_2005 = "try_cast(P25B_SEXO as double) = 2"

BOGOTA_2005_EXTENDED = Census(
    "bogota_2005_extended", "localidad", f"case when REGION = 'bogota' then {_PLACE} || lpad(I0B1_LOCALIDAD, 2, '0') else {_PLACE} end", "round(coalesce(try_cast(FACT_EXP_CAL_P_N as double), 0))", "try_cast(PC09B_EDAD as double)",
    by_code("level", recode.BOGOTA_2005_LONG), {"women": _WOMEN_2005, "employed": f"case when age >= 25 then {within('P47B_OCUPACION', ('1', '2'))} end"},
    numbers={"level": "P44B3_NIVEL_ANOS"}, zone_of="substr(geo_id, 1, 5)", counted=("employed",), share_of_all=True,
)
BOGOTA_2005_BASIC = Census(
    "bogota_2005_basic", "manzana", f"case I0C_CLASE {' '.join(f'when {k!r} then substr({_BLOCK}, 1, {n})' for k, n in LENGTH_2005.items())} else {_BLOCK} end", "1", "(band - 1) * 5 + 2.5",
    by_code("level", recode.BOGOTA_2005_SHORT), {"women": _WOMEN_2005, "employed": "cast(null as boolean)"}, adult="band >= 6", numbers={"level": "P44B1_TIP_ESTUD", "band": "PC09B_EDADQ"},
    bands={"no_ed": (0, 0), "hs_inc": (5, 9), "hs_com": (11, 11), "col_inc": None, "col_com": (17, 17), "grad": (18, 99)}, zone_of="substr(geo_id, 1, 5)", counted=("employed",), share_of_all=True,
)
BOGOTA_2018_BLOCKS = Census(
    "bogota_2018", "manzana", "COD_DANE_ANM", "1", "(band - 1) * 5 + 2.5", by_code("level", recode.BOGOTA_2018), {"women": "P_SEXO = '2'", "employed": f"case when adult = 1 then {within('P_TRABAJO', ('1', '2'))} end"},
    adult="band >= 6", numbers={"level": "P_NIVEL_ANOSR", "band": "P_EDADR"}, bands=dict(BANDS_11), zone_of="substr(geo_id, 1, 5)", counted=("employed", "women"),
)
# Years of schooling by level (na) and grade (es), over the counted years (ac); later lines overrule earlier ones.
MEXICO_YEARS = [
    Overwrite("ac between 0 and 12", "ac", clears=True),
    Overwrite("na = 8 and es = 1", "13"), Overwrite("na = 8 and es = 2", "14"), Overwrite("na = 8 and es = 3", "15"), Overwrite("na = 8 and es = 4", "16"),
    Overwrite("ac between 13 and 17", "ac", clears=True), Overwrite("ac between 18 and 19", "ac", clears=True),
    Overwrite("na = 12", "17"), Overwrite("na = 13 and es = 1", "18"), Overwrite("na = 13 and es in (2, 3, 4, 5, 6)", "19"),
    Overwrite("na = 11 and es in (6, 7, 8)", "17"), Overwrite("na = 10 and es = 6", "17"),
    Overwrite("na = 14 and es = 1", "20"), Overwrite("na = 14 and es = 2", "21"), Overwrite("na = 14 and es = 3", "22"), Overwrite("na = 14 and es >= 4", "23"),
    Overwrite("es = 99", "null"), Overwrite("ac = 99", "null"), Overwrite("ac = 0", "0"),
]
MEXICO_2020 = Census(
    "cdmx_2020", "municipio", "lpad(ENT, 2, '0') || lpad(MUN, 3, '0')", "try_cast(FACTOR as double)", "try_cast(EDAD as double)", MEXICO_YEARS,
    {
        "women": "SEXO = '3'", "hh_head": "PARENTESCO = '101'", "hh_head_women": "hh_head = 1 and women = 1",
        "indigena": "case when try_cast(PERTE_INDIGENA as int) = 9 then null else coalesce(try_cast(PERTE_INDIGENA as int) = 1, false) end",
        "employed": within("try_cast(CONACT as int)", (10, 20, 13, 14, 15, 16, 17, 18, 19)),
    },
    numbers={"ac": "ESCOACUM", "na": "NIVACAD", "es": "ESCOLARI"}, income="INGTRMEN", missing=("", "NA", "999"), counted=("employed", "women", "indigena"),
)
SANTIAGO_2017 = Census(
    "santiago_2017", "zona_censal", "zona_id", "1", "p09",
    [Overwrite("n between 0 and 19", "n"), Overwrite("n = 20", "20"), Overwrite("n = 20 and p15 = 13", "19"), Overwrite("n = 21", "21"), Overwrite("n = 21 and p15 = 14 and p14 = 3", "22"), Overwrite("n = 21 and p15 = 14 and p14 = 4", "23")],
    {
        "employed": "p17 = 1 or p17 = 3", "women": "p08 = 2", "hh_head": "p07 = 1", "hh_head_women": "hh_head = 1 and women = 1",
        "indigena": "case when p16 = 99 then null else coalesce(p16 = 1, false) end",
    },
    numbers={"n": "escolaridad"}, known_years_only=True, counted=("employed",),
)
SANTIAGO_2024 = Census(
    "santiago_2024", "comuna", "comuna", "1", "try_cast(edad as double)", [Overwrite("n is not null", "n")],
    {
        "employed": "try_cast(sit_fuerza_trabajo as int) = 1", "women": "try_cast(sexo as int) = 2", "hh_head": "try_cast(parentesco as int) = 1", "hh_head_women": "hh_head = 1 and women = 1",
        "indigena": "case try_cast(p28_autoid_pueblo as int) when 1 then true when 2 then false end",
    },
    numbers={"n": "escolaridad"}, missing=("", "NA", "-99", "-66", "99", "999"), counted=("employed", "women", "indigena"),
)
SAO_PAULO_2010 = Census(
    "sao_paulo_2010", "area_ponderacao", "V0011", "try_cast(V0010 as double)", "try_cast(V6036 as double)",
    [Overwrite(f"V0633 = '{recode.NO_SCHOOL}'", "0")] + [Overwrite(f"V0633 = '{a}' and V0634 {'is null' if b is None else f'= {b!r}'}", repr(float(y))) for (a, b), y in recode.SAO_PAULO_2010.items()],
    {
        "women": "V0601 = '2'", "white": "V0606 = '1'", "black_pardo": within("V0606", ("2", "4")), "employed": within("V0648", ("1", "2", "3", "4", "5", "6")),
        "formal": within("V0648", ("1", "2", "3", "6")), "informal": within("V0648", ("4", "5")),
    },
    income="V6525", keep="V1004 = '20'", counted=("employed", "formal", "informal", "women", "white", "black_pardo"),
    raw=("V0010", "V1004", "V0601", "V0606", "V0633", "V0634", "V0648", "V6036", "V6400"),
)
CENSUSES = {c.name: c for c in (BOGOTA_2005_EXTENDED, BOGOTA_2005_BASIC, BOGOTA_2018_BLOCKS, MEXICO_2020, SANTIAGO_2017, SANTIAGO_2024, SAO_PAULO_2010)}
