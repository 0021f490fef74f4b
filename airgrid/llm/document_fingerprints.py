"""Document fingerprints: invertible Bloom lookup tables of paragraph digests, subtracted and peeled.

A table has three parts of cells; a digest enters one cell of each with a count, itself and a check value
(both by XOR). Subtracting two tables leaves what differs; a cell with count 1 or -1 and a fitting check
value gives a digest up, which leaves its other cells too. Long texts are dealt into shards by digest, so
that a table stays small and work grows with the text. A shard that does not peel is tried again with a table
of twice the size under other hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from airgrid.llm.common import text_or_empty, written

#: Longer lines count as several paragraphs.
LONGEST_LINE = 256
#: Cells in each of the three parts of the published table.
CELLS = 8
#: Digests of both sides that one shard holds on average, and tables tried for it, each of twice the size.
SHARD_LOAD, TRIES = 12, 6
#: Ids that share one window.
BUCKET = 256
#: Rows that one window without a key may hold.
FEW = 100_000


def paragraph_digests(text: Column) -> Column:
    """Distinct digests of a text's lines in the order they come; empty lines count for nothing."""
    lines = F.regexp_extract_all(text, F.lit(f"[^\\n]{{1,{LONGEST_LINE}}}"), F.lit(0))
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))


def _placed(entries: str, seed: int, size: int) -> str:
    """SQL of ``entries`` (struct<n int, key long>) with check value and the cell that each takes in the three parts of a table."""
    spot = f"shiftrightunsigned(xxhash64(e.key, {seed}), {{0}}) & 1048575L"
    places = ", ".join(f"'p{k}', cast({k} * {size} + pmod({spot.format(k * 20)}, {size}) as int)" for k in range(3))
    return f"transform({entries}, e -> named_struct('n', e.n, 'key', e.key, 'mark', xxhash64(e.key, -1), {places}))"


def _summed(cell: str, placed: str, start: str, sign: str) -> str:
    """SQL of a cell with the placed entries that lie in cell number ``cell`` added or taken out."""
    return f"aggregate(filter({placed}, e -> e.p0 = {cell} or e.p1 = {cell} or e.p2 = {cell}), {start}, (a, e) -> named_struct('n', a.n {sign} e.n, 'key', a.key ^ e.key, 'mark', a.mark ^ e.mark))"


def _cells(entries: str, seed: int, size: int) -> str:
    """SQL of a table over ``entries``, an array of struct<n int, key long>."""
    zero = "named_struct('n', 0, 'key', 0L, 'mark', 0L)"
    return f"transform(array({_placed(entries, seed, size)}), ps -> transform(sequence(0, {3 * size - 1}), c -> {_summed('c', 'ps', zero, '+')}))[0]"


def _peeled(entries: str, seed: int, size: int) -> str:
    """SQL of the number of digests that a table of ``entries`` gives up, null if some stay in it."""
    pure = "array_distinct(transform(filter(s.cells, c -> abs(c.n) = 1 and c.mark = xxhash64(c.key, -1)), c -> named_struct('n', c.n, 'key', c.key)))"
    left = f"transform(array({_placed('pure', seed, size)}), ps -> transform(s.cells, (c, i) -> {_summed('i', 'ps', 'c', '-')}))[0]"
    step = f"transform(array({pure}), pure -> if(size(pure) = 0, named_struct('cells', s.cells, 'found', s.found, 'over', true), named_struct('cells', {left}, 'found', s.found + size(pure), 'over', false)))[0]"
    start = f"named_struct('cells', {_cells(entries, seed, size)}, 'found', 0, 'over', false)"
    end = "if(exists(s.cells, c -> c.n <> 0 or c.key <> 0 or c.mark <> 0), cast(null as int), s.found)"
    return f"aggregate(sequence(1, {4 * size}), {start}, (s, r) -> if(s.over, s, {step}), s -> {end})"


def _dealt(entries: str, shards: str) -> str:
    """SQL of ``entries`` (struct<n int, key long>) dealt into ``shards`` arrays by digest, in three steps.

    Each step splits every array into as many as the cube root of the shards, so an entry is looked at some three times
    that root, not once for each shard.
    """
    width = f"cast(ceil(pow({shards}, 1/3)) as int)"
    keyed = f"transform({entries}, x -> named_struct('n', x.n, 'key', x.key, 'h', cast(pmod(xxhash64(x.key, -2), {shards}) as int)))"

    def split(arrays: str, part: str) -> str:
        return f"flatten(transform({arrays}, es -> transform(sequence(0, w - 1), b -> filter(es, e -> {part} = b))))"

    first = split("array(all)", "cast(e.h / (w * w) as int)")
    second = split(first, "cast(e.h / w as int) % w")
    third = split(second, "e.h % w")
    return f"transform(array({width}), w -> transform(array({keyed}), all -> {third})[0])[0]"


def difference_size(left: str, right: str) -> Column:
    """Number of digests in one of two digest arrays only, found by peeling.

    A shard that no table gives up (three equal cells in each of ``TRIES`` tables) is counted by set difference.
    """
    shards = f"cast(ceil((size({left}) + size({right}) + 1) / {SHARD_LOAD}) as int)"
    signed = f"concat(transform({left}, x -> named_struct('n', 1, 'key', x)), transform({right}, x -> named_struct('n', -1, 'key', x)))"
    tries = [_peeled("es", seed, CELLS << seed) for seed in range(TRIES)]
    last = "size(filter(es, a -> not exists(es, b -> b.key = a.key and b.n <> a.n)))"
    one = f"coalesce({', '.join(tries)}, {last})"
    dealt = f"transform(array({shards}), m -> if(m = 1, array({signed}), transform({_dealt(signed, 'm')}, es -> transform(es, e -> named_struct('n', e.n, 'key', e.key)))))[0]"
    return F.expr(f"aggregate(transform(filter({dealt}, es -> size(es) > 0), es -> {one}), 0, (a, x) -> a + x)")


def likeness(left: str, right: str) -> Column:
    """Share of common digests among all of two arrays, from their sizes and the peeled difference; 1 if both are empty."""
    total, differ = F.size(left) + F.size(right), difference_size(left, right)
    return F.when(total == 0, F.lit(1.0)).otherwise((total - differ) / (total + differ))


def fingerprint(digests: str) -> Column:
    """The published table as text: number of digests, then count, digest and check value of each cell in hex."""
    cells = _cells(f"transform({digests}, x -> named_struct('n', 1, 'key', x))", 0, CELLS)
    text = f"concat_ws('-', cast(size({digests}) as string), array_join(transform({cells}, c -> concat_ws('.', hex(c.n), hex(c.key), hex(c.mark))), '-'))"
    return F.expr(text)


def _lower_neighbours(buckets: DataFrame, name: str) -> DataFrame:
    """For distinct longs, the next smaller one as ``lower``; null for the smallest. Ranges of 256 are linked first, then what begins them."""
    rows = buckets.select(F.col(name).alias("b"))
    if len(rows.take(FEW + 1)) <= FEW:
        return rows.select(F.col("b").alias(name), F.lag("b").over(W.orderBy("b")).alias("lower"))
    rows = rows.withColumn("above", F.floor(F.col("b") / BUCKET))
    tops = written(rows.groupBy("above").agg(F.max("b").alias("top")))
    linked = _lower_neighbours(tops, "above").join(tops.select(F.col("above").alias("lower"), "top"), "lower", "left").select("above", "top")
    own = F.lag("b").over(W.partitionBy("above").orderBy("b"))
    return rows.withColumn("own", own).join(linked, "above", "left").select(F.col("b").alias(name), F.coalesce("own", "top").alias("lower"))


def edited(text: Column, following: Column) -> Column:
    """The text with its last half (rounded down) replaced by the first as many characters of ``following``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of all texts and their edited texts, with likenesses; one row for each row of ``docs``.

    Columns: id, n_chars long, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The next
    document is the one with the next smaller id, after the last the first; a single document follows itself.
    Equal ids are ordered by the hash of their text, null ids come last. A null text is empty; empty texts have
    an empty table and are alike. Repeated lines count once. Other columns are not read; an empty table gives
    no rows.

    Ids are dealt by ranges of 256 to windows; only the first and last text of each range is kept to link ranges.
    """
    text = text_or_empty(text_column)
    low = F.lit(-(1 << 54)).cast("long")
    rows = docs.select(F.col(id_column).alias("id"), text.alias("text")).withColumn("bucket", F.coalesce(F.floor(F.col("id") / BUCKET), low)).repartition("bucket")
    rows = rows.withColumn("own", paragraph_digests(F.col("text")))
    order = W.partitionBy("bucket").orderBy(F.col("id").desc_nulls_last(), F.xxhash64("text"))
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("after", F.lead(F.struct("text", "own")).over(order))
    last = F.col("after").isNull()
    other = edited(F.col("text"), F.col("after.text"))
    known = written(rows.select(
        "bucket", "id", F.length("text").cast("long").alias("n_chars"), "place", last.alias("last"), F.when(last | (F.col("place") == 1), F.col("text")).alias("edge"),
        "own", F.col("after.own").alias("following"), F.sha2(other.cast("binary"), 256).alias("edited_sha256"), paragraph_digests(other).alias("changed"),
    ))
    buckets = written(known.where("place = 1").select("bucket"))
    links = _lower_neighbours(buckets, "bucket")
    top = buckets.agg(F.max("bucket")).first()[0]
    links = links.select("bucket", F.coalesce("lower", F.lit(top).cast("long")).alias("lower"))
    heads = known.where("place = 1").select(F.col("bucket").alias("lower"), F.col("edge").alias("head"), F.col("own").alias("head_own"))
    tails = known.where("last").drop("edited_sha256", "changed", "following").join(links, "bucket").join(heads, "lower")
    other = edited(F.col("edge"), F.col("head"))
    tails = tails.select("id", "n_chars", "own", F.col("head_own").alias("following"), F.sha2(other.cast("binary"), 256).alias("edited_sha256"), paragraph_digests(other).alias("changed"))
    every = known.where("not last").select("id", "n_chars", "own", "following", "edited_sha256", "changed").unionByName(tails)
    return every.select(
        F.col("id").alias(id_column), "n_chars", "edited_sha256", fingerprint("own").alias("fingerprint"), fingerprint("changed").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"), likeness("own", "following").alias("near_next"),
    )
