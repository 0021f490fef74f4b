"""Collocations: phrases of a few words, counted in depth-truncated suffix trees that are built independently.

A suffix is the run of up to ``DEPTH`` words that begins at a word and stays in its piece. Vertical partitioning
deals the suffixes out by a prefix of words: the first word, two words where the first is too frequent, the whole
suffix where the two are. A task takes its prefixes in order and groups them until a group fills the memory
budget; the group's subtree is its sorted suffixes, a node is a run of suffixes with the same first words, and its
count is the sum of the leaves below it. Nodes above a prefix are summed over the groups that hold a part of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airgrid.llm.common import byte_buffer, slices, written

DEPTH = 3
#: Least count of a candidate, percentage of its count in a longer candidate at which it is dropped, phrases listed for a language.
LEAST, INSIDE, TOP = 10, 50, 2000
#: Suffixes that one group of prefixes holds: the memory budget of a subtree.
GROUP_ROWS = 200_000
#: A prefix with more than this share of all words is extended, if it also exceeds ``GROUP_ROWS``; so at most twice as many hashes are broadcast.
SHARE = 1 / 20_000
#: Bytes of text that one vectorised step counts before its leaves are sent.
LEAF_BYTES = 4 << 20
#: Lower case, all ends of pieces as a line feed and the tab as a space.
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[ord("A") : ord("Z") + 1] += 32
_BYTES[list(b".,;:!?\n\v\f\r")] = 10
_BYTES[9] = 32


def _words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """All words of the texts, dictionary-encoded, with the number of the piece and of the text that each lies in."""
    raw, ends = byte_buffer(texts)
    data = _BYTES[raw]
    gap = (data == 10) | (data == 32)
    head = ~gap
    head[1:] &= gap[:-1]
    # A text begins a word even where the one before ends without a gap.
    begins = ends[:-1][ends[:-1] < len(data)]
    head[begins] = ~gap[begins]
    start = np.flatnonzero(head)
    offsets = np.append(np.cumsum(~gap) - ~gap, (~gap).sum())[np.append(start, len(data))].astype(np.int32)
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[~gap])).dictionary_encode()
    owner = np.searchsorted(ends, start, side="right") - 1
    breaks = np.cumsum(data == 10)[start] if len(start) else np.zeros(0, np.int64)
    return words, breaks + owner, owner


def _languages(part: pa.RecordBatch, column: str) -> pa.DictionaryArray:
    return pc.fill_null(part.column(column), "und").dictionary_encode()


def _counted(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """One entry of each column for every distinct key, and how often it occurs."""
    _, first, n = np.unique(keys, return_index=True, return_counts=True)
    return [c[first] for c in columns], n


def _paired(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """A number for each distinct (a, b), with b from -1 below ``width``; small enough to be paired again."""
    key = a * (width + 1) + b + 1
    if len(a) and int(a.max()) + 1 > (1 << 62) // (width + 1) // (width + 1):
        return np.unique(key, return_inverse=True)[1]
    return key


def _leaf_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For slices of text: languages, words, and for each word its language, own, next and second next code (-1: none)."""
    for part in slices(batches, "text", LEAF_BYTES):
        words, piece, owner = _words(part.column("text"))
        lang = _languages(part, "lang")
        own = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        follows = [np.full(len(own), -1, np.int64) for _ in range(2)]
        for k, later in enumerate(follows, 1):
            if len(own) > k:
                later[:-k] = np.where(piece[k:] == piece[:-k], own[k:], -1)
        yield lang.dictionary, words.dictionary, lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[owner], own, *follows


def _taken(values: pa.Array, codes: np.ndarray) -> pa.Array:
    return values.take(pa.array(codes, mask=codes < 0))


def prefix_counts(source: DataFrame) -> DataFrame:
    """Rows (lang, w1, w2, n) of each slice: all its words together (no w1), and prefixes of one and two words with a share of ``SHARE``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, words, lang, one, two, _ in _leaf_batches(batches):
            width, least = len(words), len(one) * SHARE
            none = np.full(len(langs), -1, np.int64)
            blocks = [((np.arange(len(langs)), none, none), np.bincount(lang, minlength=len(langs)))]
            first = _paired(lang, one, width)
            for keys, columns in ((first, [lang, one, np.full(len(one), -1, np.int64)]), (_paired(first, two, width), [lang, one, two])):
                columns, n = _counted(keys, columns)
                held = (n > least) & ((columns[2] >= 0) | (keys is first))
                blocks.append((tuple(c[held] for c in columns), n[held]))
            lang, one, two = (np.concatenate([b[0][k] for b in blocks]) for k in range(3))
            n = np.concatenate([b[1] for b in blocks]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([_taken(langs, lang), _taken(words, one), _taken(words, two), pa.array(n)], ["lang", "w1", "w2", "n"])

    return source.mapInArrow(work, "lang string, w1 string, w2 string, n long")


def leaves(source: DataFrame) -> DataFrame:
    """Rows (lang, w1, w2, w3, n): the suffixes of all words, counted within each slice; words beyond a piece are null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, words, lang, one, two, three in _leaf_batches(batches):
            keys = _paired(_paired(_paired(lang, one, len(words)), two, len(words)), three, len(words))
            (lang, one, two, three), n = _counted(keys, [lang, one, two, three])
            columns = [_taken(langs, lang), *(_taken(words, c) for c in (one, two, three)), pa.array(n.astype(np.int64))]
            batch = pa.RecordBatch.from_arrays(columns, ["lang", "w1", "w2", "w3", "n"])
            for k in range(0, batch.num_rows, 100_000):
                yield batch.slice(k, 100_000)

    return source.mapInArrow(work, "lang string, w1 string, w2 string, w3 string, n long")


def _changed(column: pa.Array) -> np.ndarray:
    """Where a column differs from the row before; the first row does."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = pc.fill_null(column.dictionary_encode().indices, -1)
    values = column.to_numpy(zero_copy_only=False)
    return np.concatenate([[True], values[1:] != values[:-1]])


def _split(texts: pa.Array) -> list[pa.Array]:
    """Language and words of ``lang TAB w1 TAB w2 TAB w3 TAB``; missing words are null."""
    parts = pc.split_pattern(texts, "\t")
    begin, end = parts.offsets.to_numpy()[:-1], parts.offsets.to_numpy()[1:] - 1
    return [parts.values.take(pa.array(begin + k, mask=begin + k >= end)) for k in range(DEPTH + 1)]


def subtree(rows: pa.Table, least: int) -> pa.Table:
    """Nodes (lang, size, phrase, n, whole) of the subtrees over a group's suffixes (text, m), sorted by text.

    ``m`` is four times the count and the words of the prefix. A node at or below its prefix is whole and left out
    below ``least``; one above it holds this group's part.
    """
    m = rows["m"].to_numpy()
    n, depth = m // 4, m % 4
    lang, *words = _split(rows["text"].combine_chunks())
    change = _changed(lang)
    out, phrase = [], None
    for size in range(1, DEPTH + 1):
        change = change | _changed(words[size - 1])
        first = np.flatnonzero(change)
        totals = np.add.reduceat(n, first)
        held = words[size - 1].is_valid().to_numpy(zero_copy_only=False)[first]
        whole = depth[first] <= size
        held &= ~whole | (totals >= least)
        take = pa.array(first[held])
        parts = [w.take(take) for w in words[:size]]
        phrase = pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0]
        nodes = pa.table([lang.take(take), pa.array(np.full(len(take), size, np.int32)), phrase, pa.array(totals[held].astype(np.int64)), pa.array(whole[held])], names=NODE_NAMES)
        part = nodes.filter(pc.invert(nodes["whole"])).group_by(["lang", "size", "phrase", "whole"]).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})
        out += [nodes.filter(nodes["whole"]), part.select(NODE_NAMES)]
    return pa.concat_tables(out)


NODE_NAMES = ["lang", "size", "phrase", "n", "whole"]


def phrase_nodes(source: DataFrame, hot: DataFrame, least: int = LEAST) -> DataFrame:
    """Rows (lang, size, phrase, n): all phrases of up to ``DEPTH`` words that occur ``least`` times; ``hot`` is (hash) of prefixes to extend.

    A suffix travels as one text, each word closed by a tab, which no word holds; so the suffixes of a prefix lie side
    by side in the order of bytes, and the prefix itself is cut from the text to deal them out.
    """
    rows = leaves(source).withColumns({"h1": F.xxhash64("lang", "w1"), "h2": F.xxhash64("lang", "w1", "w2")})
    # At most two prefixes for each word share are hot.
    rows = rows.join(F.broadcast(hot.select(F.col("hash").alias("h1"), F.lit(True).alias("hot1"))), "h1", "left")
    rows = rows.join(F.broadcast(hot.select(F.col("hash").alias("h2"), F.lit(True).alias("hot2"))), "h2", "left")
    # Suffixes that end with an extended prefix count as extended too: their nodes are parts like all others below it.
    depth = F.when(F.col("hot1") & F.col("hot2"), 3).when(F.col("hot1"), 2).otherwise(1)
    # A tab within the name of a language is written as %09.
    named = F.replace(F.replace("lang", F.lit("%"), F.lit("%25")), F.lit("\t"), F.lit("%09"))
    rows = rows.select(F.concat(F.concat_ws("\t", named, "w1", "w2", "w3"), F.lit("\t")).alias("text"), (F.col("n") * 4 + depth).alias("m"))
    dealt = rows.repartition(F.expr("xxhash64(substring_index(text, '\t', cast(m % 4 + 1 as int)))")).sortWithinPartitions("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < GROUP_ROWS:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            # A group ends where a prefix does; one of the longest ends with its text.
            lang, *words = _split(rows["text"].combine_chunks())
            depth = rows["m"].to_numpy() % 4
            change = _changed(lang) | _changed(words[0])
            change |= (depth >= 2) & _changed(words[1])
            change |= (depth == 3) & _changed(words[2])
            last = int(np.flatnonzero(change)[-1])
            if last:
                yield from subtree(rows.slice(0, last), least).to_batches()
            held, size = rows.slice(last).to_batches(), rows.num_rows - last
        if size:
            yield from subtree(pa.Table.from_batches(held).combine_chunks(), least).to_batches()

    nodes = written(dealt.mapInArrow(work, "lang string, size int, phrase string, n long, whole boolean"))
    nodes = nodes.withColumn("lang", F.replace(F.replace("lang", F.lit("%09"), F.lit("\t")), F.lit("%25"), F.lit("%")))
    parts = nodes.where("not whole").groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return nodes.where("whole").drop("whole").union(parts.select("lang", "size", "phrase", "n"))


def collocations(docs: DataFrame, least: int = LEAST, inside: int = INSIDE, top: int = TOP, lang_column: str = "lang", text_column: str = "text") -> DataFrame:
    """The ``top`` phrases of 2 and 3 words of each language: (lang, rank, phrase, a, l, r, n, score), numbers long.

    Letters A-Z are lower-cased, texts end pieces at ``. , ; : ! ?`` and at line ends, pieces fall into words at
    spaces and tabs. a, l, r count the phrase and the two parts of its weakest cut, n the words of the language;
    score is floor(1000000 a a / (l r)), in decimals of 38 digits, exact for counts below 10**16. Phrases that occur
    less than ``least`` times are no candidates; those with ``inside`` percent of their count inside one longer
    candidate are dropped. A null language is ``und``, a null or empty text has no words, repeated rows count each,
    further columns are not read, and an empty table gives no rows. Equal scores go by a, then by the bytes of the phrase.
    """
    source = docs.select(F.coalesce(F.col(lang_column), F.lit("und")).alias("lang"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    prefixes = written(prefix_counts(source))
    n = prefixes.where("w1 is null").groupBy("lang").agg(F.sum("n").alias("n"))
    total = prefixes.where("w1 is null").agg(F.sum("n")).first()[0] or 0
    frequent = max(GROUP_ROWS, total * SHARE)
    hashes = F.when(F.col("w2").isNull(), F.xxhash64("lang", "w1")).otherwise(F.xxhash64("lang", "w1", "w2"))
    hot = written(prefixes.where("w1 is not null").groupBy(hashes.alias("hash")).agg(F.sum("n").alias("n")).where(F.col("n") > frequent).select("hash"))
    nodes = written(phrase_nodes(source, hot, least))
    counts = nodes.select("lang", F.col("phrase").alias("part"), F.col("n").alias("count"))

    def counted(rows: DataFrame, part, name: str) -> DataFrame:
        return rows.withColumn("part", part).join(counts, ["lang", "part"]).drop("part").withColumnRenamed("count", name)

    word = lambda k: F.split("phrase", " ")[k - 1]
    pair = lambda k: F.concat_ws(" ", word(k), word(k + 1))
    score = lambda left, right: F.expr(f"cast((cast(a as decimal(38,0)) * cast(a as decimal(20,0)) * 1000000) div (cast({left} as decimal(20,0)) * cast({right} as decimal(20,0))) as long)")
    found = nodes.where("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"))
    twos = counted(counted(found.where("size = 2"), word(1), "l"), word(2), "r").withColumn("score", score("l", "r"))
    threes = found.where("size = 3")
    for part, name in ((word(1), "l1"), (pair(2), "r1"), (pair(1), "l2"), (word(3), "r2")):
        threes = counted(threes, part, name)
    threes = threes.withColumn("s1", score("l1", "r1")).withColumn("s2", score("l2", "r2"))
    least_cut = lambda x, y: F.when(F.col("s1") <= F.col("s2"), F.col(x)).otherwise(F.col(y))
    threes = threes.select("lang", "size", "phrase", "a", least_cut("l1", "l2").alias("l"), least_cut("r1", "r2").alias("r"), least_cut("s1", "s2").alias("score"))
    longer = found.where("size = 3").select("lang", "a", F.explode(F.array(pair(1), pair(2))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    twos = twos.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < inside * F.col("a"))).drop("most")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = twos.unionByName(threes).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
