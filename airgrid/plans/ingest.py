"""City registry and the path from raw station files to the stored panel."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.functions import keys, times
from airgrid.operators.ordered import first_by, modal_value
from airgrid.operators.reshape import to_long
from airgrid.plans import panel as pn
from airgrid.session import broadcast_if_small
from airgrid.sources import readers

# Provider parameter names and their codes.
MEXICO_PARAMS = {
    "PM10": "pm10", "PARTICULAS MENORES A 10 MICRAS": "pm10", "PM2.5": "pm25", "PM2,5": "pm25", "PARTICULAS MENORES A 2.5": "pm25",
    "OZONO": "ozone", "O3": "ozone", "DIOXIDO DE NITROGENO": "no2", "NO2": "no2", "OXIDOS DE NITROGENO": "nox", "NOX": "nox",
    "MONOXIDO DE NITROGENO": "no", "NO": "no", "MONOXIDO DE CARBONO": "co", "CO": "co", "DIOXIDO DE AZUFRE": "so2", "SO2": "so2",
    "DIOXIDO DE CARBONO": "co2", "CO2": "co2", "TEMPERATURA": "temperatura", "TEMP": "temperatura", "HUMEDAD RELATIVA": "rh", "RH": "rh",
    "VELOCIDAD DEL VIENTO": "vel viento", "VEL VIENTO": "vel viento", "DIRECCION DEL VIENTO": "dir viento", "DIR VIENTO": "dir viento",
    "PRESION BAROMETRICA": "presion baro", "PRESION BARO": "presion baro", "PRECIPITACION": "precipitacion", "LLUVIA": "precipitacion",
    "RADIACION": "radiation", "RADIACION SOLAR": "radiation",
}
# Patterns on lower-case file names, for files that name no parameter otherwise; first match wins.
MEXICO_FILES = [
    ("pm10", "pm10"), (r"pm2_5|pm2\.5", "pm25"), (r"dioxido_de_nitrogeno|\bno2\b", "no2"), (r"dioxido_de_azufre|\bso2\b", "so2"),
    (r"ozono|\bo3\b", "ozone"), (r"monoxido.*carbono|\bco\b", "co"),
]
BOGOTA_PARAMS = {
    "pm2.5": "pm25", "pm10": "pm10", "o3": "ozone", "no": "no", "no2": "no2", "nox": "nox", "co": "co",
    "so2": "so2", "temperatura": "temp", "rh": "rh", "presion baro": "pressure", "radiation": "radiation",
    "precipitacion": "precipitation", "vel viento": "vel_viento", "dir viento": "dir_viento",
}
BOGOTA_NAMES = {"CARVAJAL - SEVILLANA": "CARVAJAL-SEVILLANA", "EL JAZMIN": "JAZMIN"}
BOGOTA_NAME_PATTERNS = [("CAMI.*FONTIBON", "FONTIBON")]
# Patterns on upper-case parameter names, first match wins.
SAO_PAULO_PARAMS = [
    (r"^MP10", "pm10"), (r"^MP2\.5", "pm25"), (r"^NO\b|^NO\(", "no"), (r"^NO2", "no2"), (r"^NOX", "nox"),
    (r"^O3|^OZONO", "ozone"), (r"^PRESS", "pressure"), (r"^RADG", "solar_rad"), (r"^RADUV", "uv_rad"),
    (r"^SO2", "so2"), (r"^TEMP", "temperature"), (r"^UR", "rh"), (r"^VV", "wind_speed"),
    (r"^DVG", "wind_dir_global"), (r"^DV", "wind_dir"), (r"^CO\b|^CO\(", "co"),
]
# Patterns on upper-case file names, first match wins.
SANTIAGO_PARAMS = [
    (r"MP10|PM10", "pm10"), (r"MP2.5|PM2.5|MP25|PM25", "pm25"), (r"NO2", "no2"), (r"_NO_", "no"), (r"NOX", "nox"),
    (r"O3|OZONO", "ozone"), (r"_CO_", "co"), (r"SO2", "so2"), (r"TEMP", "temperature"), (r"HR|HUMEDAD", "rh"),
    (r"VV|VELOCIDAD", "wind_speed"), (r"DV|DIRECCION", "wind_dir"),
]
POLLUTANTS = ["pm10", "pm25", "ozone", "no2", "co", "so2"]


@dataclass
class CityConfig:
    """One city: its years and how to read and harmonise its sources."""

    city: str
    years: list[int]
    params: list[str] = field(default_factory=lambda: list(POLLUTANTS))
    read: Callable[..., DataFrame] | None = None
    harmonise: Callable[..., DataFrame] | None = None
    dense: bool = False


CITIES: dict[str, CityConfig] = {}


def register_city(config: CityConfig) -> CityConfig:
    CITIES[config.city] = config
    return config


def map_stations(readings: DataFrame, exact: dict[str, str], patterns: list[tuple[str, str]]) -> DataFrame:
    """Normalised station names with synonyms replaced; patterns come before exact names."""
    name = keys.normalize_station("station")
    options = ([keys.recode_patterns(name, patterns)] if patterns else []) + ([keys.recode_exact(name, exact)] if exact else [])
    return readings.withColumn("station", F.coalesce(*options, name))


def only_listed(readings: DataFrame, stations: DataFrame) -> DataFrame:
    """Readings of registered stations."""
    listed = stations.select(keys.normalize_station("station").alias("station")).distinct()
    return readings.join(broadcast_if_small(listed), "station", "left_semi")


def read_bogota_primary(spark: SparkSession, path: str) -> DataFrame:
    """Wide station sheets saved as CSV: datetime text, station and one column per parameter."""
    raw = readers.read_text_csv(spark, path, nulls=("", " ", "NA"), upper=False)
    low = raw.toDF(*[c.lower() for c in raw.columns])
    values = [c for c in low.columns if c in BOGOTA_PARAMS]
    renamed = low.select("station", times.parse_with_hour_24("datetime").alias("datetime"),
                         *[F.col(f"`{c}`").try_cast("double").alias(BOGOTA_PARAMS[c]) for c in values])
    long = to_long(renamed, ["station", "datetime"], [BOGOTA_PARAMS[c] for c in values], keep_null=False)
    return map_stations(long, BOGOTA_NAMES, BOGOTA_NAME_PATTERNS).where(F.col("datetime").isNotNull())


def read_bogota_secondary(spark: SparkSession, path: str, param: str) -> DataFrame:
    """Station CSV of one parameter, finer times floored to the hour."""
    raw = readers.read_text_csv(spark, path, nulls=("", " ", "NA"), upper=False)
    ts = times.floor_hour(times.parse_first("Fecha inicial", ["yyyy-MM-dd HH:mm"]))
    value = [c for c in raw.columns if c not in ("Estacion", "Fecha inicial", "Fecha final")][0]
    long = raw.select(F.col("Estacion").alias("station"), ts.alias("datetime"), F.lit(param).alias("param"),
                      F.col(f"`{value}`").try_cast("double").alias("value"))
    return map_stations(long, BOGOTA_NAMES, BOGOTA_NAME_PATTERNS).where(F.col("datetime").isNotNull())


def read_mexico(spark: SparkSession, path: str, codes: list[str] | None = None, level: int = -1) -> DataFrame:
    """Wide hourly files with parameter names in Spanish; a file that names none is judged by its own name."""
    long = readers.read_wide_stations(spark, path, codes, level)
    named = keys.literal_map(MEXICO_PARAMS)[F.upper(F.trim(keys.strip_accents(F.upper("param"))))]
    return long.withColumn("param", F.coalesce(named, keys.recode_patterns(F.lower("file"), MEXICO_FILES))).where(F.col("param").isNotNull())


def read_santiago(spark: SparkSession, path: str, registry: DataFrame, level: int = -1) -> DataFrame:
    """Marker files; station by the longest registered key inside the file name, parameter by pattern."""
    from airgrid.operators.identifiers import longest_key_match

    bare = F.regexp_replace(F.upper("file"), r"METROPOLITANA[ _]DE[ _]SANTIAGO", "")
    rows = readers.read_marker_files(spark, path, level).withColumn("file_key", keys.normalize_key(bare))
    reg = registry.select(keys.normalize_key("station").alias("station_key"), "station")
    files = rows.select("file", "file_key").distinct()
    matched = longest_key_match(files, reg, "file_key", "station_key").join(reg, "station_key")
    named = rows.drop("file_key").join(broadcast_if_small(matched.select("file", "station")), "file")
    return named.withColumn("param", keys.recode_patterns(F.upper("file"), SANTIAGO_PARAMS)).where(F.col("param").isNotNull())


def read_sao_paulo(spark: SparkSession, path: str, registry: DataFrame, level: int = -1) -> DataFrame:
    """Report files; station by normalised name."""
    rows = readers.read_station_reports(spark, path, SAO_PAULO_PARAMS, level)
    reg = registry.select(keys.normalize_key("station").alias("_k"), "station")
    return rows.withColumn("_k", keys.normalize_key("station_name")).join(broadcast_if_small(reg), "_k").drop("_k")


def ingest_panel(readings: DataFrame, config: CityConfig, secondary: DataFrame | None = None,
                 stations: DataFrame | None = None) -> DataFrame:
    """Long readings to the wide panel of a city's years, optionally of registered stations only.

    A secondary source fills what the primary does not cover. Cities marked dense get a row for every
    hour of their calendar years, with the commonest code of each station attached.
    """

    def in_years(df: DataFrame) -> DataFrame:
        kept = df.where(F.year("datetime").isin(list(config.years)))
        return kept if stations is None else only_listed(kept, stations)

    long = in_years(readings)
    if secondary is not None:
        long = pn.precedence_merge(long, in_years(secondary))
    wide = pn.pivot_mean(long, config.params)
    if config.dense:
        codes = modal_value(readings, "station", "station_code", "station_code")
        wide = calendar_grid(wide.withColumn("year", F.year("datetime"))).join(broadcast_if_small(codes), "station", "left")
    return wide.withColumn("year", F.year("datetime"))


def run_city(spark: SparkSession, city: str, *sources, stations: DataFrame | None = None) -> DataFrame:
    """Panel of a registered city: its ``read`` over the sources, its ``harmonise`` over the readings, then the ingest.

    ``read(spark, *sources)`` gives long readings, or a primary and a secondary table of them; ``harmonise`` takes and
    returns readings and is applied to each.
    """
    config = CITIES[city]
    if config.read is None:
        raise ValueError(f"{city} has no reader")
    read = config.read(spark, *sources)
    tables = read if isinstance(read, tuple) else (read,)
    if config.harmonise:
        tables = tuple(config.harmonise(x) for x in tables)
    return ingest_panel(tables[0], config, tables[1] if len(tables) > 1 else None, stations)


def calendar_grid(wide: DataFrame) -> DataFrame:
    """Every hour of the calendar year for each station of that year."""
    members = wide.select("station", "year").distinct()
    start = F.make_date("year", F.lit(1), F.lit(1)).cast("timestamp_ntz")
    end = F.make_date("year", F.lit(12), F.lit(31)).cast("timestamp_ntz") + F.expr("INTERVAL 23 HOURS")
    grid = members.withColumn("datetime", F.explode(F.sequence(start, end, F.expr("INTERVAL 1 HOUR"))))
    return grid.drop("year").join(wide.drop("year"), ["station", "datetime"], "left")


def prepare_legacy(readings: DataFrame, exact: dict[str, str], start: str, end: str) -> DataFrame:
    """Older panel rules: date plus hour with 24 rolling over, synonyms, one whole row per key, calendar years.

    Of rows with one (station, hour) the first by written date, hour and values stays as it is. Each station
    gets every hour from 1 January of the first to 31 December of the last year of the range.
    """
    stamped = readings.withColumn("datetime", times.date_plus_hour(F.col("date"), F.col("hour")))
    named = stamped.withColumn("station", keys.recode_exact(keys.normalize_station("station"), exact))
    kept = named.where(times.in_range("datetime", start, end))
    value_cols = [c for c in kept.columns if c not in ("station", "datetime", "date", "hour")]
    single = first_by(kept, ["station", "datetime"], ["date", "hour", *value_cols]).drop("date", "hour")
    first, last = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz") - F.expr("INTERVAL 1 HOUR")
    opening = F.make_date(F.year(first), F.lit(1), F.lit(1)).cast("timestamp_ntz")
    closing = F.make_date(F.year(last), F.lit(12), F.lit(31)).cast("timestamp_ntz") + F.expr("INTERVAL 23 HOURS")
    grid = single.select("station").distinct().withColumn("datetime", F.explode(F.sequence(opening, closing, F.expr("INTERVAL 1 HOUR"))))
    return grid.join(single, ["station", "datetime"], "left").withColumn("year", F.year("datetime"))


register_city(CityConfig("bogota", list(range(2000, 2024)), read=read_bogota_primary))
register_city(CityConfig("cdmx", list(range(2000, 2024)), read=read_mexico, dense=True))
register_city(CityConfig("santiago", list(range(2000, 2024)), read=read_santiago))
register_city(CityConfig("sao_paulo", list(range(2000, 2024)), read=read_sao_paulo))


def _bogota(spark: SparkSession, primary: str, secondary: str, param: str) -> tuple[DataFrame, DataFrame]:
    return read_bogota_primary(spark, primary), read_bogota_secondary(spark, secondary, param)


def upper_stations(readings: DataFrame) -> DataFrame:
    """Readings under the normalised names of their stations."""
    return readings.withColumn("station", keys.normalize_station("station"))


# The four cities of the study; the years are those of the stored histories.
register_city(CityConfig("bogota", list(range(2000, 2024)), read=_bogota, harmonise=upper_stations))
register_city(CityConfig("cdmx", list(range(2000, 2024)), read=read_mexico, harmonise=upper_stations, dense=True))
register_city(CityConfig("santiago", list(range(2000, 2024)), read=read_santiago, harmonise=upper_stations))
register_city(CityConfig("sao_paulo", list(range(2000, 2024)), read=read_sao_paulo, harmonise=upper_stations))
