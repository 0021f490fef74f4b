"""Exact Jaccard join of documents on word shingles, by groups of similar documents and the union of their tokens.

1. One pass gives each document the size, a 128-bit digest and three minima of its shingle set. Equal sets become one class.
2. Classes that share a minimum meet the first of them; those similar enough are linked, which gathers groups of similar
   documents in time linear in their number.
3. A token-group matrix holds, for each group, the union of its members' leading tokens. Two similar sets share one of
   their leading tokens, in any order of tokens common to all; frequent tokens come last in it, the most frequent ones at the very end. How many they share at
   least follows from their sizes, for a group from the one of its sizes that asks for the fewest. Two groups that share fewer, or of unlike sizes, aren't compared.
4. For the other pairs the queries of one group meet blocks of the other. A block's union bounds the overlap with any member;
   only blocks that pass are opened and compared in full.
Shingles are 64-bit hashes; two that differ are taken as equal with odds of 2**-64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.llm.common import BASE, LETTERS, byte_buffer, components, mixed, powers, slices, small_side, written

WORDS = 5
#: Similarity as a ratio of integers.
LEAST, OF = 75, 100
#: Members of a block of a group, and tokens whose order follows their frequency.
BLOCK_ROWS, MOST_FREQUENT = 128, 200_000
#: Shingles that a task counts at a time to find frequent ones.
COUNTED = 8_000_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_INVERSE = pow(BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0], np.uint64)


def shingle_sets(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text with fewer words is one shingle, one without words none."""
    data, ends = byte_buffer(column)
    size = len(data)
    empty = np.zeros(0, np.uint64)
    if not size:
        return [empty] * (len(ends) - 1)
    inside = ~_SPACE[data]
    border = np.zeros(size + 1, bool)
    border[ends] = True
    starts = np.flatnonzero(inside & (border[:-1] | np.concatenate([[True], ~inside[:-1]])))
    stops = np.flatnonzero(inside & (border[1:] | np.concatenate([~inside[1:], [True]]))) + 1
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(LETTERS[_FOLD[data]] * powers(size), out=sums[1:])
    word = mixed((sums[stops] - sums[starts]) * powers(size, _INVERSE)[starts] + (stops - starts).astype(np.uint64) * _STEP)
    of = np.searchsorted(ends, starts, side="right") - 1
    n = len(word) - words + 1
    runs, owner = empty, np.zeros(0, np.int64)
    if n > 0:
        runs = np.zeros(n, np.uint64)
        for k in range(words):
            runs = runs * _STEP + word[k : k + n]
        whole = of[:n] == of[words - 1 :]
        runs, owner = mixed(runs[whole]), of[:n][whole]
    first = np.searchsorted(owner, np.arange(len(ends)))
    count = np.searchsorted(of, np.arange(len(ends)))
    out = []
    for k in range(len(ends) - 1):
        if first[k + 1] > first[k]:
            out.append(np.unique(runs[first[k] : first[k + 1]]))
        elif count[k + 1] > count[k]:
            h = np.full(1, count[k + 1] - count[k], np.uint64) * np.uint64(BASE)
            for x in word[count[k] : count[k + 1]]:
                h = h * _STEP + x
            out.append(mixed(h))
        else:
            out.append(empty)
    return out


def similar(a: np.ndarray, b: np.ndarray, least: int = LEAST, of: int = OF) -> bool:
    """Whether two sorted sets reach the similarity."""
    if of * min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return of * common >= least * (len(a) + len(b) - common)


def _facts(docs: DataFrame, words: int) -> DataFrame:
    """One row for each document, and rows without id for shingles that come twice in what a task holds."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held, seen = [], 0, set()
        names = ["doc_id", "n_shingles", "s1", "s2", "m0", "m1", "m2", "token"]

        def frequent() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            token, count = token[count > 1].view(np.int64), count[count > 1]
            none = pa.nulls(len(token), pa.int64())
            return pa.RecordBatch.from_arrays([none, pa.array(count), none, none, none, none, none, pa.array(token)], names)

        for part in slices(batches):
            rows = []
            for own in shingle_sets(part.column("text"), words):
                digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                minima = [int(mixed(own ^ s).min().view(np.int64)) if len(own) else 0 for s in _SEEDS]
                rows.append((len(own), *np.frombuffer(digest, np.int64).tolist(), *minima))
                if digest not in seen:
                    seen.add(digest)
                    held.append(own)
                    n_held += len(own)
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns, pa.nulls(len(rows), pa.int64())], names)
            if n_held > COUNTED:
                yield frequent()
                held, n_held, seen = [], 0, set()
        yield frequent()

    return docs.mapInArrow(work, "doc_id long, n_shingles long, s1 long, s2 long, m0 long, m1 long, m2 long, token long")


def _star_links(docs: DataFrame, classes: DataFrame, words: int, least: int, of: int) -> DataFrame:
    """Links (a, b) between a class and the first of those that share one of its minima, where they are similar."""
    firsts = []
    for name in ("m0", "m1", "m2"):
        first = classes.groupBy(name).agg(F.min("rep").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        firsts.append(classes.join(first, name).where("rep <> first").select("rep", "first"))
    pairs = written(firsts[0].union(firsts[1]).union(firsts[2]).distinct())
    blocks = pairs.groupBy("first").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    members = pairs.join(blocks, "first").select(F.col("rep").alias("doc_id"), "first", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"))
    leaders = blocks.select(F.col("first").alias("doc_id"), "first", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    wanted = members.union(leaders).groupBy("doc_id").agg(F.collect_list(F.struct("first", "block")).alias("places"))
    texts = docs.join(small_side(wanted), "doc_id").select("doc_id", "text", F.explode("places").alias("place")).select("doc_id", "text", "place.first", "place.block")

    def work(batch: pa.Table) -> pa.Table:
        ids, first = batch.column("doc_id").to_numpy(), batch.column("first").to_numpy()[0]
        sets = dict(zip(ids.tolist(), shingle_sets(batch.column("text").combine_chunks(), words), strict=True))
        found = [i for i, own in sets.items() if i != first and similar(own, sets[first], least, of)]
        return pa.table({"a": pa.array([first] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return written(texts.groupBy("first", "block").applyInArrow(work, "a long, b long"))


def _leading_tokens(docs: DataFrame, frequent: np.ndarray, rank: np.ndarray, words: int, least: int, of: int) -> DataFrame:
    """Rows (doc_id, tokens): as many of a set's first tokens, frequent ones last, as leave too few for the similarity.

    ``frequent`` is sorted; ``rank`` holds for each of them its place, the most frequent one's being 0.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            parts = []
            for own in shingle_sets(part.column("text"), words):
                n = len(own) - -(-least * len(own) // of) + 1 if len(own) else 0
                if len(frequent) and n:
                    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
                    late = frequent[at] == own
                    own = np.concatenate([own[~late], own[late][np.argsort(-rank[at[late]])]])
                parts.append(own[:n])
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "tokens"])

    return docs.mapInArrow(work, "doc_id long, tokens array<long>")


def _group_links(docs: DataFrame, members: DataFrame, matrix: DataFrame, words: int, least: int, of: int) -> DataFrame:
    """Links (a, b) between documents of different groups; one for each query and block of a group is enough."""
    left, right = matrix.select("token", F.col("grp").alias("g")), matrix.select("token", F.col("grp").alias("h"))
    meet = left.join(right, "token").where("g < h").groupBy("g", "h").agg(F.count("*").alias("shared"))
    sizes = members.groupBy("grp").agg(F.count("*").alias("n"), F.min("n_shingles").alias("lo"), F.max("n_shingles").alias("hi"))
    meet = meet.join(sizes.select(*[F.col(c).alias(f"{c}_g") for c in ("n", "lo", "hi")], F.col("grp").alias("g")), "g")
    meet = meet.join(sizes.select(*[F.col(c).alias(f"{c}_h") for c in ("n", "lo", "hi")], F.col("grp").alias("h")), "h")

    # The demand falls with the size of the set whose leading tokens end first, but not at every step: from a larger size it can rise by
    # rounding. Only so few sizes below the largest can demand less than it; no group holds sizes below its smallest.
    below = [d for d in range(2 * of * (of + least) // least**2 + 2) if d == 0 or least * d // of < -(-least * d // (of + least))]

    def demand(own: str, other: str):
        """Leading tokens that a set of group ``own`` shares at least with a similar one of group ``other``, if its own end first."""
        sizes = [f"greatest(hi_{own} - {d}, lo_{own})" for d in below]
        return F.array_min(F.array(*[F.expr(f"1 - ceil({least} * {n} / {of}) + ceil({least} * ({n} + lo_{other}) / {of + least})") for n in sizes]))

    meet = meet.where((F.col("lo_g") * least <= F.col("hi_h") * of) & (F.col("lo_h") * least <= F.col("hi_g") * of))
    meet = meet.where(F.col("shared") >= F.least(demand("g", "h"), demand("h", "g")))
    turned = F.col("n_g") > F.col("n_h")
    meet = meet.select(F.when(turned, F.col("h")).otherwise(F.col("g")).alias("asks"), F.when(turned, F.col("g")).otherwise(F.col("h")).alias("grp"), F.ceil(F.greatest("n_g", "n_h") / BLOCK_ROWS).cast("int").alias("blocks"))
    asked = written(meet)
    held = members.join(asked.select("grp", "blocks").distinct(), "grp").select("doc_id", "grp", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("asks"))
    queries = members.select("doc_id", F.col("grp").alias("asks")).join(asked, "asks").select("doc_id", "grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"))
    wanted = held.union(queries).groupBy("doc_id").agg(F.collect_list(F.struct("grp", "block", "asks")).alias("places"))
    texts = docs.join(small_side(wanted), "doc_id").select("doc_id", "text", F.explode("places").alias("place")).select("doc_id", "text", "place.*")

    def work(batch: pa.Table) -> pa.Table:
        ids, asks = batch.column("doc_id").to_pylist(), batch.column("asks").to_pylist()
        sets = shingle_sets(batch.column("text").combine_chunks(), words)
        block = sorted((i, s) for i, s, q in zip(ids, sets, asks, strict=True) if not q)
        union = np.unique(np.concatenate([s for _, s in block])) if block else np.zeros(0, np.uint64)
        found = []
        for i, own, q in zip(ids, sets, asks, strict=True):
            if q and of * len(np.intersect1d(own, union, assume_unique=True)) >= least * len(own):
                other = next((j for j, s in block if similar(own, s, least, of)), None)
                found += [] if other is None else [(i, other)]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return texts.groupBy("grp", "block").applyInArrow(work, "a long, b long")


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, least: int = LEAST, of: int = OF) -> DataFrame:
    """Rows (id long, n_shingles long, class_id long, component_id long), one for each row of ``docs``.

    ``class_id`` is the smallest id with an equal shingle set, ``component_id`` the smallest reachable by
    links; for a document without words both are its own id. Null texts are empty. Ids should differ; rows that share an id are
    taken as one document whose text is the first in order of their hash. A row with a null id has a null
    class and component and links with nothing. Other columns are not read; an empty table gives no rows.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    facts = written(_facts(source, words))
    sized = facts.where("token is null")
    known = sized.where("n_shingles > 0 and doc_id is not null")
    classes = written(known.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"), *(F.min(m).alias(m) for m in ("m0", "m1", "m2"))))
    top = facts.where("token is not null").groupBy("token").agg(F.sum("n_shingles").alias("n")).orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).select("token").toPandas()
    frequent = top["token"].to_numpy(np.int64).view(np.uint64)
    rank = np.argsort(frequent)
    frequent = frequent[rank]
    stars = _star_links(source, classes, words, least, of)
    groups = components(stars)
    members = written(classes.select(F.col("rep").alias("doc_id"), "n_shingles").join(groups.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("grp")))
    tokens = _leading_tokens(source, frequent, rank, words, least, of).join(members.drop("n_shingles"), "doc_id")
    matrix = tokens.select(F.explode("tokens").alias("token"), "grp").distinct()
    links = _group_links(source, members, matrix, words, least, of)
    whole = written(components(stars.union(links)))
    named = classes.select("s1", "s2", F.col("rep").alias("class_id")).join(whole.withColumnRenamed("id", "class_id"), "class_id", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id"))
    return sized.join(named, ["s1", "s2"], "left").select(
        F.col("doc_id").alias(id_column), "n_shingles",
        F.when(F.col("doc_id").isNotNull(), own).alias("class_id"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "class_id")).otherwise(F.col("doc_id"))).alias("component_id"),
    )
