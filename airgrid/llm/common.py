"""Helpers shared by the operators of this folder: written tables, text buffers, rolling hashes, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.session import shared_folder

#: Text that one vectorised step handles at a time.
SLICE_BYTES = 1 << 19
#: Rows up to which the small side of a join with whole texts is broadcast; they hold an id and a short list each.
SMALL_ROWS = 300_000
#: A fixed odd base and fixed random letters for hashes modulo 2**64.
BASE = 0x9E3779B97F4A7C15
LETTERS = np.random.default_rng(20240517).integers(1, 1 << 63, 257, dtype=np.uint64) | np.uint64(1)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again; the copy goes when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df`` written out, with a hint to broadcast it if it holds at most ``most`` rows; else joins shuffle both sides."""
    kept = written(df)
    most = SMALL_ROWS if most is None else most
    return F.broadcast(kept) if kept.limit(most + 1).count() <= most else kept


def text_or_empty(name: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``limit`` bytes of ``column``, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def byte_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and where each begins (one more entry for the end); null is empty."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def powers(n: int, base: int = BASE) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below n."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (the finaliser of splitmix64)."""
    values = values.astype(np.uint64, copy=True)
    values ^= values >> np.uint64(30)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``links`` (a long, b long) as (id, component_id), the smallest id reachable.

    Each round links every vertex's larger neighbours, then its smaller ones, to the smallest vertex it knows;
    both keep the components and shorten paths, so that some ten rounds serve long chains. A round is two
    grouped minima and one join; the edges are written in between. Self links are dropped; no rows, no result.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = written(edges)
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.where("a <> m").select("a", F.col("m").alias("b"))
        large = large.union(own).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.where("a <> b").union(down.select("a", F.col("m").alias("b"))).distinct())
        after = edges.agg(F.count("*"), F.sum("b"), F.countDistinct("a")).first()
        if after[0] == after[2] and tuple(after) == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
        before = tuple(after)
    raise RuntimeError("the components did not settle")
