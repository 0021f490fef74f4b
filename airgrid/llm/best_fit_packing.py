"""Packing of token pieces into sequences: best fit decreasing in partitions, certified by lower bounds, repacked across partitions."""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from airgrid.llm.common import byte_buffer, slices, written

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CAPACITY = 4096
#: Id that ends every document.
END = 1
#: Pieces that one partition packs, and rounds in which partitions exchange pieces.
PARTITION_ROWS, ROUNDS = 8192, 4
#: Distinct words that a worker remembers; beyond it the memory starts anew.
REMEMBERED = 600_000
#: What parts words that are encoded together, and bytes of text whose words are looked up at a time.
BAR, WORD_BYTES = " | ", 4 << 20
#: The tokenizer takes A-Z as a-z; line ends and spaces both end words.
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[ord("A") : ord("Z") + 1] += 32
_BYTES[10] = 32


class WordIds(dict):
    """Numbers words and keeps their ids. The tokenizer drops spaces and line ends, so words may be encoded alone."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.bar = self.tokenizer.encode("|", add_special_tokens=False).ids[0]
        self.forget()

    def __missing__(self, word: str) -> int:
        self[word] = out = len(self)
        return out

    def forget(self) -> None:
        self.clear()
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and how many each has; runs of words go through the tokenizer as one text with a bar between them."""
        flat, sizes = [], []
        for k in range(0, len(words), 2000):
            some = words[k : k + 2000]
            text = BAR.join(some)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            bars = np.flatnonzero(ids == self.bar)
            # Words that hold a bar themselves are told by their number, and are encoded one by one.
            if text.count("|") == len(some) - 1 == len(bars):
                sizes.append(np.diff(np.concatenate([[-1], bars, [len(ids)]])) - 1)
                flat.append(np.delete(ids, bars))
                continue
            each = [x.ids for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, each), np.int64, len(each)))
            flat.append(np.fromiter(itertools.chain.from_iterable(each), np.uint32, int(sizes[-1].sum())))
        return np.concatenate(flat), np.concatenate(sizes)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; words are found in the buffer of all texts, and only distinct ones become strings."""
        if len(self) > REMEMBERED:
            self.forget()
        raw, ends = byte_buffer(texts)
        data = _BYTES[raw]
        inner = data != 32
        head = inner.copy()
        head[1:] &= ~inner[:-1]
        # A text begins a word even where the one before ends without a space.
        begins = ends[:-1][ends[:-1] < len(data)]
        head[begins] = inner[begins]
        starts = np.flatnonzero(head)
        offsets = np.append(np.cumsum(inner) - inner, inner.sum())[np.append(starts, len(data))].astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inner])).dictionary_encode()
        known = len(self)
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.__getitem__, distinct), np.int64, len(distinct))
        fresh = list(itertools.islice(self, known, None))
        if fresh:
            ids, size = self.encoded(fresh)
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, ids])
        number = number[words.indices.to_numpy(zero_copy_only=False)]
        size = self.size[number]
        done = np.concatenate([[0], np.cumsum(size)])
        shift = np.repeat(self.start[number] - done[:-1], size)
        ids = self.flat[shift + np.arange(len(shift))]
        border = done[np.searchsorted(starts, ends)]
        return [ids[a:b] for a, b in zip(border[:-1].tolist(), border[1:].tolist(), strict=True)]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end: int | None = END, id_column: str = "doc_id", text_column: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """Rows (id, piece int, start long, length long, ids_crc32 long): each document's ids cut into pieces of ``capacity``.

    A document's ids end with ``end`` (None: nothing). Null texts are empty. A document without ids gives no
    row; equal ids and equal texts are packed once for each row; other columns are not read.
    """
    schema = T.StructType([docs.schema[id_column], *(T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer)
        tail = np.array([] if end is None else [end], "<u4")
        for part in slices(batches, text_column, WORD_BYTES):
            rows = []
            for k, ids in enumerate(words.encode(part.column(text_column))):
                ids = np.concatenate([ids, tail]).astype("<u4")
                rows += [(k, i, at, min(capacity, len(ids) - at), zlib.crc32(ids[at : at + capacity].tobytes())) for i, at in enumerate(range(0, len(ids), capacity))]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [part.column(id_column).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], schema.fieldNames(),
            )

    return docs.select(id_column, text_column).mapInArrow(work, schema)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each size, and the free space of each bin; larger sizes first, each into the fullest bin it fits."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    free: list[int] = []
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces = 0  # bit s is set when a bin has s free
    for k in np.argsort(-sizes, kind="stable").tolist():
        need = int(sizes[k])
        fit = spaces >> need
        if fit:
            space = need + (fit & -fit).bit_length() - 1
            b = waiting[space].pop()
            if not waiting[space]:
                spaces ^= 1 << space
        else:
            b, space = len(free), capacity
            free.append(capacity)
        bins[k], offsets[k] = b, capacity - space
        free[b] = space - need
        waiting[space - need].append(b)
        spaces |= 1 << (space - need)
    return bins, offsets, np.array(free, np.int64)


def lower_bound(sizes: np.ndarray, capacity: int, most: int = 20) -> int:
    """Bins that ``sizes`` need at least, by dual feasible functions.

    For each threshold t, sizes above capacity - t count as full and those below t as nothing; for each k,
    sizes are rounded to multiples of capacity / k as Fekete and Schepers do.
    """
    if not len(sizes):
        return 0
    counts = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    number, weight = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * np.arange(capacity + 1))])
    t = np.arange(0, capacity // 2 + 1)
    top = capacity - t + 1
    totals = capacity * (number[-1] - number[top]) + weight[top] - weight[t]
    best = -(-int(totals.max()) // capacity)
    x = np.arange(capacity + 1)
    for k in range(1, most + 1):
        part = (k + 1) * x
        value = np.where(part % capacity == 0, k * x, part // capacity * capacity)  # k times the function
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def _packer(names: list[str], length_column: str, capacity: int, turn: int, last: bool):
    """Function that packs one partition in the order of a hash and says which rows stay where they are."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__order", kind="stable")
        sizes = rows[length_column].to_numpy()
        if not ((sizes >= 1) & (sizes <= capacity)).all():
            raise ValueError(f"lengths must be from 1 to {capacity}")
        sizes = sizes.astype(np.int64)
        bins, offsets, free = best_fit_decreasing(sizes, capacity)
        if last:
            kept = np.ones(len(free), bool)
        elif len(free) <= lower_bound(sizes, capacity):
            kept = np.arange(len(free)) != free.argmax()
        else:
            kept = free == 0
        first = (turn << 58) + (int(rows["__part"].iloc[0]) << 26)
        return rows[names].assign(sequence_id=first + bins, offset=offsets, __kept=kept[bins])

    return work


def pack(pieces: DataFrame, capacity: int = CAPACITY, length_column: str = "length") -> DataFrame:
    """``pieces`` with sequence_id long and offset long; sequences are gapless from 0 and hold ``capacity`` at most.

    Partitions of some ``PARTITION_ROWS`` rows pack by best fit decreasing. A partition whose bins are no more
    than its lower bound is certified: it keeps its bins but the emptiest. Any other keeps its full bins only.
    What is released is dealt anew over fewer partitions, until one is left or ``ROUNDS`` are over. Lengths
    must be from 1 to ``capacity``; a row with another or a null length is an error. Equal rows are packed
    each; an empty table gives no rows.
    """
    width = max(1, pieces.count())
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("__kept", T.BooleanType())])
    names = pieces.columns
    done: list[DataFrame] = []
    rest = pieces
    for turn in range(ROUNDS):
        parts = -(-width // PARTITION_ROWS)
        last = parts == 1 or turn == ROUNDS - 1
        work = _packer(names, length_column, capacity, turn, last)
        order = F.xxhash64(*names, F.lit(turn))
        dealt = rest.select(*names, F.pmod(order, F.lit(parts)).alias("__part"), order.alias("__order"))
        packed = written(dealt.groupBy("__part").applyInPandas(work, schema))
        done.append(packed.where("__kept"))
        if last:
            break
        rest = packed.where("not __kept")
        width = rest.count()
        if not width:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("__kept")
