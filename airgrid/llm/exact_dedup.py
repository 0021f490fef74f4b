"""Exact duplicates by sorting contents: texts are range-partitioned, sorted externally, and compared with their neighbours.

Splitters are sampled from a short prefix of each text and the hash of all of it, so that the sample stays small and
long common beginnings are split. Behind the splitters rows are sorted by whole texts; equal ones lie side by side, and
a group ends where a text differs from the one before. Texts with very many copies are dealt over several ranges by a
salt; each range keeps its own candidate, and the candidates of a text meet in a second sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from airgrid.llm.common import written

#: Characters of a text that splitters are sampled from.
SPLIT_CHARACTERS = 32
#: Share of all rows beyond which the copies of a text are dealt over several ranges, each with about as many; fewer hashes than its inverse are broadcast.
SHARE = 1 / 2000


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", normalise: Callable[[Column], Column] | None = None, columns: list[str] | None = None) -> DataFrame:
    """``docs`` with keep_id, group_size long, kept boolean and sha256 string: equal texts and the one of them that stays.

    Texts are equal when their normalised forms are identical, by default with no change; null counts as empty, and
    ``sha256`` is of the normalised UTF-8. Of equal texts the row with the largest id stays, null ids last; of rows
    with one id exactly one, whichever is first in the sort. Every row comes back once, with ``columns`` (default: all).
    Columns of the added names are replaced, others stay whatever their names; an empty table gives no rows.
    """
    added = ["keep_id", "group_size", "kept", "sha256"]
    names = [c for c in (docs.columns if columns is None else columns) if c not in added]
    rest = [c for c in names if c != text_column]

    def content(raw: Column) -> Column:
        text = F.coalesce(raw, F.lit(""))
        return normalise(text) if normalise else text

    text = content(F.col(text_column))
    # A hash alone never makes texts equal; it only says which texts to deal over several ranges.
    sizes = written(docs.select(F.xxhash64(text).alias("hash")).groupBy("hash").agg(F.count("*").alias("n")))
    most = (sizes.agg(F.sum("n")).first()[0] or 0) * SHARE
    hot = sizes.where((F.col("n") > most) & (F.col("n") > 1)).select("hash", F.ceil(F.col("n") / max(most, 1.0)).cast("long").alias("salts"))
    rows = docs.select(
        F.col(id_column).alias("id"), F.col(text_column).alias("raw"), F.struct(F.lit(0).alias("none"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(rest)]).alias("row"),
        F.substring(text, 1, SPLIT_CHARACTERS).alias("start"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("at"),
    ).join(F.broadcast(hot), "hash", "left")
    rows = rows.withColumn("salt", F.when(F.col("salts").isNull(), F.lit(-1).cast("long")).otherwise(F.pmod("at", "salts"))).drop("salts", "at")
    keys = ["start", "hash", "salt"]
    # The keys of the ranges lead, so that the window sorts the ranges as they are; the whole text behind them decides.
    ranges = rows.repartitionByRange(*keys).withColumn("text", content(F.col("raw")))
    near = W.partitionBy(*keys, "text")
    last = near.orderBy(F.col("id").desc_nulls_last())
    own = ranges.withColumns({"place": F.row_number().over(last), "own_id": F.first("id").over(last), "own_size": F.count(F.lit(1)).over(near)})
    head = (F.col("salt") >= 0) & (F.col("place") == 1)
    raw = F.col("raw") if text_column in names else F.when(head, F.col("raw"))
    own = written(own.select("row", "id", raw.alias("raw"), "place", "own_id", "own_size", "hash", "salt", F.sha2("text", 256).alias("sha256")))
    # The salts of a hot text meet: one row for each, of fewer than 1 / SHARE texts.
    heads = own.where("salt >= 0 and place = 1").withColumn("text", content(F.col("raw"))).withColumn("start", F.substring("text", 1, SPLIT_CHARACTERS))
    all_salts = W.partitionBy("start", "hash", "text")
    best = all_salts.orderBy(F.col("own_id").desc_nulls_last(), "salt")
    met = heads.repartitionByRange("start", "hash").select(
        "hash", "sha256", F.row_number().over(best).alias("place"), F.col("own_id").alias("keep_id"), F.col("salt").alias("keep_salt"), F.sum("own_size").over(all_salts).alias("all_size"),
    ).where("place = 1").drop("place")
    cold = own.where("salt < 0").select("row", "id", "raw", F.col("own_id").alias("keep_id"), F.col("own_size").alias("group_size"), (F.col("place") == 1).alias("kept"), "sha256")
    dealt = own.where("salt >= 0").join(F.broadcast(met), ["hash", "sha256"])
    dealt = dealt.select("row", "id", "raw", "keep_id", F.col("all_size").alias("group_size"), ((F.col("place") == 1) & (F.col("salt") == F.col("keep_salt"))).alias("kept"), "sha256")
    place = {c: F.col("row")[f"c{k}"] for k, c in enumerate(rest)} | {text_column: F.col("raw")}
    return cold.union(dealt).select(*[place[c].alias(c) for c in names], *added)
