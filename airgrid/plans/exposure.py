"""Inverse-distance exposure of geographic units to station readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.functions.keys import normalize_station, safe_text
from airgrid.operators.identifiers import REPAIR_RULES, apply_repairs, reconcile_ids
from airgrid.operators.ordered import assign_groups
from airgrid.operators.reshape import stack
from airgrid.session import BROADCAST_ROWS, reliable_checkpoint, require_columns

# Pairs of one task where the readings come to them, and pairs and readings of one slice where both are cut.
PAIRS_PER_TASK, PAIRS_PER_SLICE, READINGS_PER_SLICE = 10_000, 20_000, 500_000

# Interim target concentrations per pollutant.
TARGETS = {
    "pm10": {"it1": 150.0, "it2": 100.0, "it3": 75.0, "it4": 50.0},
    "pm25": {"it1": 75.0, "it2": 50.0, "it3": 37.5, "it4": 25.0},
}


def in_buffer(distances: DataFrame, buffer_km: float, power: float = 1.0) -> DataFrame:
    """Positive distances inside the buffer with their inverse-distance weight."""
    require_columns(distances, ["geo_id", "station_id", "distance_km"], "distances")
    d = F.col("distance_km")
    kept = distances.where((d > 0) & (d <= buffer_km))
    return kept.select(
        safe_text(distances, "geo_id").alias("geo_id"),
        normalize_station("station_id").alias("station_id"),
        (F.lit(1.0) / F.pow(d, F.lit(float(power)))).alias("inv_d"),
    )


def zero_distances(distances: DataFrame) -> DataFrame:
    """Count of pairs at distance zero, which the buffer excludes."""
    return distances.agg(F.count_if(F.col("distance_km") == 0).alias("n_zero"))


def fan_out(rows: DataFrame, pairs: DataFrame, by: list[str], max_broadcast_rows: int = BROADCAST_ROWS, salts: int = 32) -> tuple[DataFrame, list[str]]:
    """Readings met with the pairs of their station, and the keys whose sums need no shuffle of that fan-out.

    ``by`` names what a station is known by. The smaller side comes whole to the parts of the other while it is within
    ``max_broadcast_rows``: pairs to readings spread by hour, else readings to pairs spread by unit, where days and
    years need no shuffle either. Beyond that both are cut, days into ``salts`` slices at least and units into slices of
    ``PAIRS_PER_SLICE``; each slice of the one is copied to the slices of the other, and every (unit, hour) lies in one
    of these tiles. Only the copies are sent, never the fan-out.
    """
    unit = [c for c in ("city_id", "geo_id") if c in pairs.columns]
    pairs = reliable_checkpoint(pairs)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if pairs.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows:
        spread = rows.repartition(n, "datetime").sortWithinPartitions("datetime")
        return spread.join(F.broadcast(pairs), by), [*unit, "datetime"]
    rows, n_pairs = reliable_checkpoint(rows), pairs.count()
    n_rows = rows.count()
    if n_rows <= max_broadcast_rows:
        spread = pairs.repartition(max(n, -(-n_pairs // PAIRS_PER_TASK)), "geo_id")
        return spread.join(F.broadcast(rows), by), [*unit, "datetime"]
    across, down = max(salts, -(-n_rows // READINGS_PER_SLICE)), -(-n_pairs // PAIRS_PER_SLICE)
    tile = lambda unit_slice, day_slice: (unit_slice * F.lit(across) + day_slice).cast("long").alias("_tile")
    slices = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    own = lambda key, count: F.pmod(F.xxhash64(key), F.lit(count))
    pair, reading = F.struct(*[c for c in pairs.columns if c not in by]), F.struct(*[c for c in rows.columns if c not in by])
    a = pairs.withColumn("_day", slices(across)).select(*by, tile(own("geo_id", down), F.col("_day")), pair.alias("_pair"))
    b = rows.withColumn("_unit", slices(down)).select(*by, tile(F.col("_unit"), own(F.to_date("datetime"), across)), reading.alias("_reading"))
    both = a.unionByName(b, allowMissingColumns=True).dropna(subset=by).repartition(max(n, across * down), "_tile")
    met = both.groupBy("_tile", *by).agg(F.collect_list("_pair").alias("_pairs"), F.collect_list("_reading").alias("_readings"))
    fan = met.select("_tile", *by, "_readings", F.inline("_pairs")).select("*", F.inline("_readings")).drop("_readings")
    return fan, ["_tile", *unit, "datetime"]


def hourly_idw(
    panel: DataFrame,
    distances: DataFrame,
    pollutants: list[str],
    buffer_km: float = 3,
    power: float = 1.0,
    missing: str = "drop",
    max_broadcast_rows: int = BROADCAST_ROWS,
    salts: int = 32,
) -> DataFrame:
    """Interpolated value per unit and hour, one column per pollutant.

    ``missing="drop"`` leaves a missing reading out of both sums; ``"zero"`` keeps its weight in the
    denominator, as the older rule did.

    The readings meet the pairs as in ``fan_out``, so that the (unit, hour) sums need no shuffle.
    """
    keep = [p for p in pollutants if p in panel.columns]
    rows = panel.where(F.coalesce(*[F.col(p) for p in keep]).isNotNull()) if missing == "drop" else panel
    rows = rows.select(normalize_station("station").alias("station_id"), "datetime", *keep)
    fan, keys = fan_out(rows, in_buffer(distances, buffer_km, power), ["station_id"], max_broadcast_rows, salts)
    w = F.col("inv_d")
    sums = []
    for p in keep:
        known = F.col(p).isNotNull()
        den = F.when(known, w) if missing == "drop" else w
        num = F.col(p) * w if missing == "drop" else F.coalesce(F.col(p), F.lit(0.0)) * w
        sums.append((F.sum(num) / F.sum(den)).alias(p))
    return fan.groupBy(*keys).agg(*sums).drop("_tile")


def annual_exposure(hourly: DataFrame, pollutants: list[str], targets: dict | None = None) -> DataFrame:
    """Annual mean, hours with a value and hours at or above each target."""
    targets = TARGETS if targets is None else targets
    aggs = []
    for p in pollutants:
        if p not in hourly.columns:
            continue
        x = F.col(p)
        aggs += [F.avg(x).alias(f"avg_{p}"), F.nullif(F.count(x), F.lit(0)).alias(f"total_hrs_{p}")]
        for name, level in targets.get(p, {}).items():
            hours = F.when(F.count(x) > 0, F.count_if(x >= level))
            aggs.append(hours.alias(f"hrs_d_{p}_{name}"))
    return hourly.groupBy("geo_id", F.year("datetime").alias("year")).agg(*aggs)


def idw_exposure(
    panel: DataFrame,
    distances: DataFrame,
    pollutants: list[str] = ("pm10", "pm25"),
    buffer_km: float = 3,
    power: float = 1.0,
    targets: dict | None = None,
    years: list[int] | None = None,
    missing: str = "drop",
) -> DataFrame:
    """Annual exposure table of every unit with a station in reach."""
    if years:
        panel = panel.where(F.col("year").isin(list(years)))
    hourly = hourly_idw(panel, distances, list(pollutants), buffer_km, power, missing)
    return annual_exposure(hourly, list(pollutants), targets)


def day_metrics(hourly: DataFrame, pollutant: str, targets: dict[str, float]) -> DataFrame:
    """Days per unit with at least one and at least two hours at or above each target."""
    x = F.col(pollutant)
    days = (
        hourly.where(x.isNotNull())
        .groupBy("geo_id", F.to_date("datetime").alias("day"))
        .agg(*[F.count_if(x >= level).alias(name) for name, level in targets.items()])
    )
    aggs = []
    for name in targets:
        aggs.append(F.count_if(F.col(name) >= 1).alias(f"days_with_hr_above_{name}"))
        aggs.append(F.count_if(F.col(name) >= 2).alias(f"days_with_2hr_above_{name}"))
    return days.groupBy("geo_id").agg(*aggs)


def station_match(panel: DataFrame, distances: DataFrame, pollutants: list[str]) -> DataFrame:
    """Per station: readings, and whether it occurs in the panel and in the distance table."""
    n_obs = sum([F.count(p) for p in pollutants], F.lit(0))
    a = panel.groupBy(normalize_station("station").alias("station_id")).agg(n_obs.alias("n_obs"))
    b = distances.select(normalize_station("station_id").alias("station_id")).distinct().withColumn("_d", F.lit(1))
    j = a.withColumn("_p", F.lit(1)).join(b, "station_id", "full")
    return j.select(
        "station_id",
        F.coalesce("n_obs", F.lit(0)).cast("long").alias("n_obs"),
        F.coalesce("_p", F.lit(0)).alias("in_panel"),
        F.coalesce("_d", F.lit(0)).alias("in_distances"),
    )


def attach_census(exposure: DataFrame, census: DataFrame) -> DataFrame:
    """Exposure left-joined to census rows; units without census keep NULLs."""
    return exposure.join(census, "geo_id", "left")


def city_run(
    panel: DataFrame,
    distances: DataFrame,
    people: DataFrame,
    units: DataFrame,
    pollutants: list[str] = ("pm10", "pm25"),
    buffer_km: float = 3,
    n: int = 5,
    person_key: str = "row_key",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One interpolation, two groupings: exposure, grouped people, grouped units."""
    exposure = reliable_checkpoint(idw_exposure(panel, distances, pollutants, buffer_km))
    adults = people.where(F.col("adult") == 1)
    persons = assign_groups(adults, "educ_years", "person_weight", n, "edu_quintile", ["geo_id", person_key])
    joined = attach_census(exposure, units)
    grouped = assign_groups(joined, "education_mean", "pop_total", n, "edu_quintile", ["geo_id", "year"])
    return exposure, persons, grouped


def repaired_city_run(
    panel: DataFrame,
    distances: DataFrame,
    people: DataFrame,
    units: DataFrame,
    pollutants: list[str] = ("pm10", "pm25"),
    buffer_km: float = 3,
    n: int = 5,
    person_key: str = "row_key",
    rules: Sequence[str] = REPAIR_RULES,
) -> dict[str, DataFrame]:
    """A city run whose exposure carries the census's spelling of the unit ids, and what became of them.

    ``exposure``, ``persons`` and ``units`` as in ``city_run``; ``repairs`` has one row for each exposure unit
    (original, repaired, rule, matched), checked against people and units together; ``report`` is one row of counts:
    exposure units, those matched as they are, by which repair, unmatched, and people before and after the adult filter.
    ``rules`` as in ``reconcile_ids``.
    """
    exposure = reliable_checkpoint(idw_exposure(panel, distances, pollutants, buffer_km))
    key = lambda df: df.select(safe_text(df, "geo_id").alias("geo_id"))
    census = reliable_checkpoint(key(people).unionByName(key(units)).where(F.col("geo_id").isNotNull()).distinct())
    repairs = reconcile_ids(exposure, census, rules=rules)
    known = census.select(F.col("geo_id").alias("repaired"), F.lit(True).alias("_known"))
    repairs = reliable_checkpoint(repairs.join(known, "repaired", "left").select("original", "repaired", "rule", F.coalesce("_known", F.lit(False)).alias("matched")))
    exposure = reliable_checkpoint(apply_repairs(exposure, repairs))
    adults = people.where(F.col("adult") == 1)
    persons = assign_groups(adults, "educ_years", "person_weight", n, "edu_quintile", ["geo_id", person_key])
    grouped = assign_groups(attach_census(exposure, units), "education_mean", "pop_total", n, "edu_quintile", ["geo_id", "year"])
    rule = F.col("rule")
    counts = repairs.agg(
        F.count(F.lit(1)).alias("n_units"), F.count_if(F.col("matched") & rule.isNull()).alias("n_matched_as_is"),
        *[F.count_if(rule == r).alias(f"n_repaired_{r}") for r in ("left", "right", "strip")], F.count_if(~F.col("matched")).alias("n_unmatched"),
    )
    kept = kept_rows(people)
    report = counts.withColumns({c: kept.select(c).scalar() for c in kept.columns})
    return {"exposure": exposure, "persons": persons, "units": grouped, "repairs": repairs, "report": report}


def kept_rows(people: DataFrame) -> DataFrame:
    """Rows before and after the adult filter."""
    return people.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("adult") == 1).alias("n_adults"))


def stack_runs(runs: dict[str, DataFrame]) -> DataFrame:
    """Stack labelled results."""
    return stack([df.withColumn("city_id", F.lit(label)) for label, df in runs.items()])
