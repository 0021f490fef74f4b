"""Filling gaps of the hourly panel by least squares on the other stations.

Spark sums the normal equations: hours are cut into chunks, each chunk gives the cross products of one model's
columns, and a model's few chunks are added up. Only that sum is solved, column by column in the order of the model;
a column that depends on earlier ones is dropped, as statistical packages do. Gaps are predicted in columns again.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.functions.keys import slug
from airgrid.functions.numbers import finite
from airgrid.session import reliable_checkpoint

# Tasks get the functions themselves, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Known readings that a model needs, hours that one chunk holds, and the share of a column's square left by earlier ones below which it depends on them.
MIN_ROWS, CHUNK_HOURS, DEPENDENT = 50, 1024, 1e-9
#: Levels of month, weekday and hour, the pairs of them that make products, and where each block begins behind the numeric columns.
LEVELS = {"month": 12, "weekday": 7, "hour": 24}
PRODUCTS = (("month", "weekday"), ("weekday", "hour"), ("month", "hour"))
BLOCKS = [(name,) for name in LEVELS] + list(PRODUCTS)


def block_width(block: tuple[str, ...]) -> int:
    """Columns of a calendar term or product."""
    return int(np.prod([LEVELS[n] for n in block]))


STARTS = dict(zip(BLOCKS, np.concatenate([[0], np.cumsum([block_width(b) for b in BLOCKS])[:-1]]).tolist(), strict=True))
CALENDAR_WIDTH = sum(map(block_width, BLOCKS))


def place_in(block: tuple[str, ...], codes):
    """Column of a row within a block; ``codes`` gives the level from 0 of each term, the first varies fastest."""
    at, step = 0, 1
    for name in block:
        at, step = at + codes(name) * step, step * LEVELS[name]
    return at


def cross_products(rows: pd.DataFrame, stations: int) -> tuple[np.ndarray, np.ndarray]:
    """Cross products of (1, numeric columns, station, calendar, y) over the known rows, and what all rows hold.

    The second is, for each numeric column, its least and largest value, and for each calendar level whether it occurs.
    """
    num = np.stack(rows["num"].to_numpy())
    y = rows["y"].to_numpy(float)
    codes = {n: rows[n].to_numpy() for n in LEVELS}
    design = np.zeros((len(rows), 1 + num.shape[1] + stations + CALENDAR_WIDTH + 1))
    design[:, 0] = 1
    design[:, 1 : 1 + num.shape[1]] = num
    at = np.arange(len(rows))
    first = 1 + num.shape[1]
    if stations:
        design[at, first + rows["place"].to_numpy()] = 1
    for block in BLOCKS:
        design[at, first + stations + STARTS[block] + place_in(block, codes.__getitem__)] = 1
    design[:, -1] = np.nan_to_num(y)
    known = design[~np.isnan(y)]
    held = np.concatenate([num.min(0), num.max(0), *[np.bincount(codes[n], minlength=k) > 0 for n, k in LEVELS.items()]])
    return known.T @ known, held


def solved(gram: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Coefficients of ``columns`` in this order, zero for columns that depend on earlier ones; y is last in ``gram``."""
    order = np.append(columns, len(gram) - 1)
    a = gram[np.ix_(order, order)].copy()
    whole = a.diagonal().copy()
    used = []
    for k in range(len(columns)):
        if a[k, k] <= DEPENDENT * whole[k]:
            continue
        row = a[k] / a[k, k]
        a -= np.outer(a[:, k], row)
        a[k] = row
        used.append(k)
    beta = np.zeros(len(gram) - 1)
    beta[columns[used]] = a[used, -1]
    return beta


def model_columns(held: np.ndarray, numeric: np.ndarray, q: int, stations: int) -> np.ndarray:
    """Columns of the model in order: intercept, chosen numeric ones, stations but the first, calendar terms and products without their first level.

    ``held`` says which levels occur; a term with one level is left out with its products.
    """
    out = [np.zeros(1, int), 1 + numeric, 1 + q + np.arange(1, stations)]
    seen, at = {}, 0
    for n, k in LEVELS.items():
        seen[n] = np.flatnonzero(held[at : at + k])[1:]
        at += k
    for block in BLOCKS:
        if all(len(seen[n]) for n in block):
            grid = np.meshgrid(*[seen[n] for n in reversed(block)], indexing="ij")
            codes = dict(zip(reversed(block), (g.ravel() for g in grid), strict=True))
            out.append(1 + q + stations + STARTS[block] + place_in(block, codes.__getitem__))
    return np.concatenate(out)


def fitted(rows: DataFrame, keys: list[str], choose, stations: int = 0, least: int = MIN_ROWS) -> DataFrame:
    """Coefficients (keys, beta array<double>) of one model for each of ``keys``.

    ``rows`` has y, num array<double>, month, weekday, hour (from 0), hour_of_year and, with ``stations``, place (a
    station's number). A model with at least ``least`` known rows is fitted; ``choose(held, q)`` gives its numeric
    columns from what its rows hold, or None for no model.
    """
    shape = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def part(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        gram, held = cross_products(group, stations)
        return pd.DataFrame([[*key[:-1], gram.tobytes(), held.astype(float).tobytes()]], columns=[*keys, "gram", "held"])

    def whole(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        gram = sum(np.frombuffer(x) for x in group["gram"])
        held = np.stack([np.frombuffer(x) for x in group["held"]])
        size = int(round(len(gram) ** 0.5))
        q = size - 2 - stations - CALENDAR_WIDTH
        held = np.concatenate([held[:, :q].min(0), held[:, q : 2 * q].max(0), held[:, 2 * q :].max(0)])
        gram = gram.reshape(size, size)
        numeric = choose(held, q) if gram[0, 0] >= least else None
        beta = None if numeric is None else solved(gram, model_columns(held[2 * q :], numeric, q, stations))
        return pd.DataFrame([[*key, beta]], columns=[*keys, "beta"])

    chunks = rows.withColumn("_chunk", (F.col("hour_of_year") / CHUNK_HOURS).cast("int"))
    # A chunk of a station is a thousand hours at most, a model's chunks are nine for each station in it.
    parts = chunks.groupBy(*keys, "_chunk").applyInPandas(part, f"{shape}, gram binary, held binary")
    return parts.groupBy(*keys).applyInPandas(whole, f"{shape}, beta array<double>").where(F.col("beta").isNotNull())


def predicted(stations: int = 0) -> Column:
    """Prediction of a row with ``num``, calendar codes, ``beta`` and, with ``stations``, ``place``."""
    beta, q = F.col("beta"), F.size("num")
    out = F.get(beta, F.lit(0)) + F.aggregate(F.zip_with("num", F.slice(beta, F.lit(2), q), lambda x, b: x * b), F.lit(0.0), lambda a, x: a + x)
    if stations:
        out = out + F.get(beta, q + 1 + F.col("place"))
    for block in BLOCKS:
        out = out + F.get(beta, q + 1 + stations + STARTS[block] + place_in(block, F.col))
    return out


def station_hours(panel: DataFrame, pollutant: str, station: str = "station") -> DataFrame:
    """Readings (_id, datetime, year, y) averaged by station-hour, with calendar codes and ``_all``: the hour's readings by station."""
    base = panel.withColumn("_id", slug(station)).withColumn("_x", finite(F.col(pollutant)))
    rows = base.groupBy("_id", "datetime").agg(F.avg("_x").alias("y"))
    t = F.col("datetime")
    rows = rows.withColumns({
        "year": F.year(t), "month": F.month(t) - 1, "weekday": F.weekday(t), "hour": F.hour(t), "hour_of_year": (F.dayofyear(t) - 1) * 24 + F.hour(t),
    })
    hours = rows.groupBy("datetime").agg(F.array_sort(F.collect_list(F.struct("_id", "y"))).alias("_all"))
    return rows.join(hours, "datetime")


def station_names(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_names``: the stations of the year in order."""
    names = rows.groupBy("year").agg(F.array_sort(F.collect_set("_id")).alias("_names"))
    return rows.join(F.broadcast(names), "year")  # one row for each year


def _filled(panel: DataFrame, pollutant: str, station: str, predictions: DataFrame, label: str) -> DataFrame:
    base = panel.withColumn("_id", slug(station)).withColumn("_x", finite(F.col(pollutant)))
    out = base.join(predictions.select("_id", "datetime", F.col("prediction").alias("_p")), ["_id", "datetime"], "left")
    gap = F.col("_x").isNull() & F.col("_p").isNotNull()
    return out.withColumn(pollutant, F.coalesce("_x", "_p")).withColumn(f"{pollutant}_imputed_from", F.when(gap, F.lit(label))).drop("_id", "_x", "_p")


def neighbour_features(panel: DataFrame, pollutant: str, station: str = "station") -> DataFrame:
    """Rows for ``fitted``: values of the year's stations (zero where missing, and the station's own), then flags of missing ones.

    Values are taken from their station's mean of the year, which with the flags leaves predictions as they are but
    keeps the sums exact.
    """
    rows = station_hours(panel, pollutant, station)
    means = rows.groupBy("year", "_id").agg(F.avg("y").alias("m"))
    names = means.groupBy("year").agg(F.array_sort(F.collect_list(F.struct("_id", "m"))).alias("_names"))
    rows = rows.join(F.broadcast(names), "year")  # one row for each year
    values = F.map_from_entries(F.filter("_all", lambda r: r["y"].isNotNull()))
    other = lambda s: F.when(s["_id"] != F.col("_id"), F.element_at("_map", s["_id"]))
    num = F.concat(
        F.transform("_names", lambda s: F.coalesce(other(s) - s["m"], F.lit(0.0))),
        F.transform("_names", lambda s: F.when(other(s).isNull() & (s["_id"] != F.col("_id")), 1.0).otherwise(0.0)),
    )
    return rows.withColumn("_map", values).withColumn("num", num).drop("_all", "_map", "_names")


def varying_neighbours(held: np.ndarray, q: int) -> np.ndarray | None:
    """Value columns that vary over a model's rows, in value or in being known, then their flags; none: no model."""
    stations = q // 2
    vary = held[:q] != held[q : 2 * q]
    varying = np.flatnonzero(vary[:stations] | vary[stations:])
    return np.concatenate([varying, stations + varying]) if len(varying) else None


def impute_ols(panel: DataFrame, pollutant: str, station: str = "station") -> DataFrame:
    """Fill gaps of one pollutant; filled rows say so in ``{pollutant}_imputed_from``.

    One model for each station and year with ``MIN_ROWS`` known readings: the other stations' readings of the hour
    (zero where missing), a flag for each missing one, month, weekday and hour and their products in pairs. Stations
    whose readings don't vary are left out. A level that the known rows lack counts as the first one.
    """
    rows = neighbour_features(panel, pollutant, station)
    models = reliable_checkpoint(fitted(rows, ["_id", "year"], varying_neighbours))
    gaps = rows.where(F.col("y").isNull()).join(models, ["_id", "year"])
    return _filled(panel, pollutant, station, gaps.select("_id", "datetime", predicted().alias("prediction")), "OLS_Unbiased")


def pooled_features(panel: DataFrame, pollutant: str, station: str = "station") -> DataFrame:
    """Readings with the other stations' present values of the hour, in order of their names, padded with zeros to the year's stations."""
    rows = station_names(station_hours(panel, pollutant, station))
    present = F.transform(F.filter("_all", lambda r: (r["_id"] != F.col("_id")) & r["y"].isNotNull()), lambda r: r["y"])
    rows = rows.withColumns({"_present": present, "_others": F.size("_names") - 1})
    gap = F.col("_others") - F.size("_present")
    fill = lambda x, n: F.array_repeat(F.lit(x), n.cast("int"))
    return rows.select(
        F.col("_id").alias("station"), "datetime", "year", F.col("y").alias("value"), F.concat("_present", fill(0.0, gap)).alias("others"),
        F.concat(fill(0.0, F.size("_present")), fill(1.0, gap)).alias("others_missing"), (F.array_position("_names", F.col("_id")) - 1).cast("int").alias("place"),
        (F.col("month") + 1).alias("month"), "weekday", "hour", "hour_of_year",
    )


def impute_pooled(panel: DataFrame, pollutant: str, station: str = "station") -> DataFrame:
    """Pooled variant: one model for each year over all its stations, with anonymous neighbours and a term for each station.

    Stations with at most one reading take no part in the fit, but their gaps are filled; a year with one station or
    with no more than ``MIN_ROWS`` rows to fit gets no model. Calendar terms are as in ``impute_ols``.
    """
    feats = pooled_features(panel, pollutant, station).withColumn("month", F.col("month") - 1)
    rows = feats.withColumn("num", F.concat("others", "others_missing")).withColumnRenamed("value", "y")
    counts = rows.groupBy("year", "station").agg(F.count("y").alias("_n"))
    width = rows.agg(F.max("place")).first()[0]
    if width is None:
        return panel.withColumn(f"{pollutant}_imputed_from", F.lit(None).cast("string"))
    stations = width + 1
    train = rows.join(F.broadcast(counts.where("_n > 1").select("year", "station")), ["year", "station"], "left_semi")  # as many rows as stations and years
    # Years with fewer stations have shorter arrays; models are apart, so only the stations' block has a common width.
    models = reliable_checkpoint(fitted(train, ["year"], lambda held, q: np.arange(q) if q else None, stations))
    gaps = rows.where(F.col("y").isNull()).join(models, "year")
    found = gaps.select(F.col("station").alias("_id"), "datetime", predicted(stations).alias("prediction"))
    return _filled(panel, pollutant, station, found, "OLS_Legacy")


def imputed_counts(filled: DataFrame, pollutant: str) -> DataFrame:
    """Filled values per year."""
    return filled.groupBy("year").agg(F.count(f"{pollutant}_imputed_from").alias("n_imputed"))
