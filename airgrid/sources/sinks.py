"""Writers for panels and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.sources.readers import artifact_path


def write_panel(panel: DataFrame, root: str, files_per_year: int | None = None, keys: list[str] = ("station", "datetime")) -> None:
    """Year-partitioned Parquet, rows sorted inside each file; only written years are replaced.

    Rows are gathered by year and a year too large for one task is split by adaptive execution.
    ``files_per_year`` fixes the number of files instead, by hashed station.
    """
    if files_per_year is None:
        spread = panel.hint("rebalance", F.col("year"))
    else:
        spread = panel.repartition("year", F.pmod(F.xxhash64(keys[0]), F.lit(files_per_year)))
    (
        spread.sortWithinPartitions("year", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy").partitionBy("year").parquet(root)
    )


def write_twin(df: DataFrame, path: str) -> None:
    """Parquet and CSV copies of one result table; the CSV is written from the Parquet copy."""
    df.write.mode("overwrite").parquet(path + "_parquet")
    df.sparkSession.read.parquet(path + "_parquet").write.mode("overwrite").csv(path + "_csv", header=True)


def write_inferred(df: DataFrame, root: str, formats: list[str] = ("parquet",), city: str = "city", year: str = "year") -> str:
    """Write in several formats under a name made of city and year range; returns the base path."""
    row = df.agg(F.min(city).alias("c"), F.min(year).alias("a"), F.max(year).alias("b")).first()
    span = f"{row.a}" if row.a == row.b else f"{row.a}_{row.b}"
    base = f"{root.rstrip('/')}/{row.c}_{span}"
    for f in formats:
        w = df.write.mode("overwrite")
        if f == "parquet":
            w.parquet(base + "_parquet")
        elif f in ("csv", "csv.gz"):
            w.csv(base + "_" + f.replace(".", "_"), header=True, compression="gzip" if f.endswith("gz") else "none")
        else:
            raise ValueError(f"unknown format {f}")
    return base


def with_labels(df: DataFrame, labels: dict) -> DataFrame:
    """Run labels as leading columns."""
    rest = [c for c in df.columns if c not in labels]
    return df.select(*[F.lit(v).alias(k) for k, v in labels.items()], *rest)


def write_result(df: DataFrame, root: str, name: str, buffer_km: float, year: int, labels: dict) -> str:
    """Result table under its standard name, labels first."""
    path = artifact_path(root, "exposure", name, buffer_km, year)
    with_labels(df, labels).write.mode("overwrite").parquet(path)
    return path


def write_with_provenance(df: DataFrame, path: str, provenance: dict[str, str]) -> None:
    """Table plus a one-row sidecar of provenance keys; the keys also ride on the columns' metadata."""
    notes = {k: str(v) for k, v in provenance.items()}
    tagged = df.select(*[F.col(c).alias(c, metadata=notes) for c in df.columns])
    tagged.write.mode("overwrite").parquet(path)
    side = df.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in notes.items()])
    side.write.mode("overwrite").parquet(path + "_provenance")
