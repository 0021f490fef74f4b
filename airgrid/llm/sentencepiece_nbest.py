"""N-best SentencePiece segmentations and decoding.

The lattice of a text falls apart into units (see ``lattice``). Forward and backward Viterbi scores of all new
units of a batch are found by array operations, which gives the best segmentation and, as the best score over
all edges off it, the exact gap to the second. Only the N - 1 units of a text with the smallest gaps can differ
in its N best segmentations; for these, A* runs backward through the unit's lattice with the forward scores as
exact heuristic.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from airgrid.llm import lattice
from airgrid.llm.common import mixed, slices

#: Distinct units that a worker remembers, and their characters in all; beyond either the memory starts anew.
REMEMBERED, REMEMBERED_CHARACTERS = 400_000, 4_000_000
#: Bytes of text whose units are looked up at a time.
TEXT_BYTES = 1 << 20
#: Longer units are searched one by one.
VECTOR_LENGTH = 24
FACTOR = np.uint64(0x9E3779B97F4A7C15)


#: Marks a unit that follows a line end and so has no space before it.
BARE = "\x00"


class Numbering(dict):
    """Numbers keys in the order they come."""

    def __missing__(self, key: str) -> int:
        self[key] = out = len(self)
        return out


def plain(unit: str) -> str:
    """The characters of the lattice behind a unit's key."""
    if unit == "\n" or unit.startswith(lattice.SPACE):
        return unit
    return unit[1:] if unit.startswith(BARE) else lattice.SPACE + unit


class Segmenter:
    """Best segmentations of units and texts under one vocabulary."""

    def __init__(self, vocabulary: lattice.Vocabulary, n: int):
        self.vocabulary, self.n = vocabulary, n
        known = sorted(vocabulary.pieces.items())
        keys = np.array([self._key(p) for p, _ in known], np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ids = np.array([x[0] for _, x in known], np.int32)[order]
        self.scores = np.array([x[1] for _, x in known], np.float64)[order]
        self.lengths = {len(p) for p, _ in known}
        self.clear()

    @staticmethod
    def _key(piece: str) -> int:
        h = np.zeros(1, np.uint64)
        for c in piece:
            h = h * FACTOR + np.uint64(ord(c) + 1)
        return int(mixed(h)[0])

    def clear(self) -> None:
        """Forget all units."""
        self.number = Numbering()
        self.characters = 0
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.best, self.gap = np.zeros(0), np.zeros(0)
        self.alternatives: dict[int, list[tuple[float, list[int]]]] = {}

    # Units ------------------------------------------------------------------------------------------------

    def search(self, unit: str) -> list[tuple[float, list[int]]]:
        """The n best (score, ids) of a unit, best first; backward A* with exact forward scores."""
        v = self.vocabulary
        size = len(unit)
        forward = [0.0] + [float("-inf")] * size
        into: list[list[tuple[int, float, list[int]]]] = [[] for _ in range(size + 1)]
        for i in range(size):
            for j in range(i + 1, min(size, i + v.longest) + 1):
                piece = v.pieces.get(unit[i:j])
                if piece is not None:
                    into[j].append((i, piece[1], [piece[0]]))
                elif j == i + 1:
                    into[j].append((i, v.unknown_score, v.fallback(unit[i])))
                else:
                    continue
                forward[j] = max(forward[j], forward[i] + into[j][-1][1])
        # Entries: (minus best total, place, order of entry, score behind, ids behind in reverse). Of equal totals the one nearest to the begin goes first.
        agenda, entered, found = [(-forward[size], size, 0, 0.0, None)], 1, []
        while agenda and len(found) < self.n:
            total, at, _, behind, path = heapq.heappop(agenda)
            if not at:
                ids = []
                while path is not None:
                    ids += path[0]
                    path = path[1]
                found.append((-total, ids))
                continue
            for i, score, ids in into[at]:
                heapq.heappush(agenda, (-(forward[i] + score + behind), i, entered, score + behind, (ids, path)))
                entered += 1
        return found

    def learn(self, units: list[str]) -> None:
        """Best ids, score and gap of units that are new; their numbers go on from those known."""
        n = len(units)
        size, start, best, gap = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.full(n, np.inf)
        flats, filled = [self.flat], len(self.flat)
        by_length: dict[int, list[int]] = {}
        for k, unit in enumerate(units):
            if 0 < len(unit) <= VECTOR_LENGTH and self.vocabulary.singles.issuperset(unit):
                by_length.setdefault(len(unit), []).append(k)
            elif unit:
                found = self.search(unit)
                start[k], size[k], best[k] = filled, len(found[0][1]), found[0][0]
                flats.append(np.array(found[0][1], np.int32))
                filled += len(flats[-1])
                if len(found) > 1:
                    gap[k] = found[0][0] - found[1][0]
        for length, rows in by_length.items():
            for k in range(0, len(rows), 20_000):
                some = np.array(rows[k : k + 20_000])
                ids, size[some], best[some], gap[some] = self._vector([units[x] for x in some], length)
                start[some] = filled + np.cumsum(size[some]) - size[some]
                flats.append(ids)
                filled += len(ids)
        self.flat = np.concatenate(flats)
        self.start, self.size = np.concatenate([self.start, start]), np.concatenate([self.size, size])
        self.best, self.gap = np.concatenate([self.best, best]), np.concatenate([self.gap, gap])

    def _vector(self, units: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(units), length).T.astype(np.uint64) + np.uint64(1)
        n = len(units)
        edges = {}
        for i in range(length):
            h = np.zeros(n, np.uint64)
            for j in range(i + 1, min(length, i + self.vocabulary.longest) + 1):
                h = h * FACTOR + chars[j - 1]
                key = mixed(h)
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                if hit.any():
                    edges[i, j] = at, np.where(hit, self.scores[at], -np.inf)
        forward, backward = np.full((length + 1, n), -np.inf), np.full((length + 1, n), -np.inf)
        came = np.zeros((length + 1, n), np.int64)
        forward[0], backward[length] = 0, 0
        for j in range(1, length + 1):
            for i in range(max(0, j - self.vocabulary.longest), j):
                if (i, j) in edges:
                    score = forward[i] + edges[i, j][1]
                    better = score > forward[j]
                    forward[j][better] = score[better]
                    came[j][better] = i
        for i in range(length - 1, -1, -1):
            for j in range(i + 1, min(length, i + self.vocabulary.longest) + 1):
                if (i, j) in edges:
                    np.maximum(backward[i], backward[j] + edges[i, j][1], out=backward[i])
        second, ids = np.full(n, -np.inf), np.full((n, length + 1), -1, np.int32)
        on = np.zeros((length + 1, n), bool)
        on[length] = True
        for j in range(length, 0, -1):
            for i in range(max(0, j - self.vocabulary.longest), j):
                if (i, j) in edges:
                    at, score = edges[i, j]
                    best = on[j] & (came[j] == i)
                    on[i] |= best
                    ids[best, j] = self.ids[at[best]]
                    np.maximum(second, np.where(best, -np.inf, forward[i] + score + backward[j]), out=second)
        held = ids >= 0
        return ids[held], held.sum(1), forward[length], forward[length] - second

    # Texts ------------------------------------------------------------------------------------------------

    def units(self, text: str | None) -> list[str]:
        """Keys of a text's units in order: words, line ends, and what follows a line end; ``plain`` gives their characters."""
        if not text:
            return []
        if text[0] == " " or "  " in text or lattice.SPACE in text or BARE in text:
            return [x if x[0] == lattice.SPACE else BARE + x for x in self.vocabulary.split(text)]
        return text.replace("\n", f" \n {BARE}").split(" ")

    def numbers(self, texts: list[str | None]) -> list[np.ndarray]:
        """Numbers of the units of each text; new units are learned."""
        if len(self.number) > REMEMBERED or self.characters > REMEMBERED_CHARACTERS:
            self.clear()
        known = len(self.number)
        out = [np.fromiter(map(self.number.__getitem__, units), np.int64, len(units)) for units in map(self.units, texts)]
        if len(self.number) > known:
            new = [plain(x) for x in itertools.islice(self.number, known, None)]
            self.characters += sum(map(len, new))
            self.learn(new)
        return out

    def others(self, number: int, unit: str) -> list[tuple[float, list[int]]]:
        """The n best of one unit, remembered."""
        if number not in self.alternatives:
            self.alternatives[number] = self.search(unit)
        return self.alternatives[number]

    def text_best(self, numbers: np.ndarray, units) -> list[tuple[float, dict[int, int]]]:
        """The n best segmentations of a text as (score, {place: which of its unit's}); ``units(place)`` gives a unit's text."""
        best = float(self.best[numbers].sum())
        gaps = self.gap[numbers]
        places = np.argsort(gaps, kind="stable")[: self.n - 1] if self.n > 1 else []
        found: list[tuple[float, dict[int, int]]] = [(0.0, {})]
        for place in places:
            if not np.isfinite(gaps[place]):
                break
            options = self.others(int(numbers[place]), units(int(place)))
            joint = [(loss + options[0][0] - score, chosen if not k else {**chosen, int(place): k}) for loss, chosen in found for k, (score, _) in enumerate(options)]
            found = sorted(joint, key=lambda x: (x[0], len(x[1]), sorted(x[1].items())))[: self.n]
        return [(best - loss, chosen) for loss, chosen in found]

    def ids_of(self, numbers: np.ndarray) -> np.ndarray:
        """Ids of the best segmentation of a row of units."""
        sizes = self.size[numbers]
        shift = np.repeat(self.start[numbers] - (np.cumsum(sizes) - sizes), sizes)
        return self.flat[shift + np.arange(len(shift))]

    def encode(self, texts: list[str | None]) -> list[list[tuple[float, np.ndarray]]]:
        """For each text its n best (score, ids), best first; one empty one for an empty text."""
        rows = self.numbers(texts)
        out = []
        for text, numbers in zip(texts, rows, strict=True):
            if not len(numbers):
                out.append([(0.0, np.zeros(0, np.int32))])
                continue
            names = self.units(text)
            unit = lambda place, names=names: plain(names[place])
            ids, mine = self.ids_of(numbers), []
            ends = np.cumsum(self.size[numbers])
            for score, chosen in self.text_best(numbers, unit):
                if not chosen:
                    mine.append((score, ids))
                    continue
                parts, done = [], 0
                for place in sorted(chosen):
                    parts += [ids[done : ends[place] - self.size[numbers[place]]], np.array(self.others(int(numbers[place]), unit(place))[chosen[place]][1], np.int32)]
                    done = ends[place]
                mine.append((score, np.concatenate([*parts, ids[done:]])))
            out.append(mine)
        return out


class Decoder:
    """Text of ids by table look-up; runs of byte pieces are read as UTF-8."""

    def __init__(self, vocabulary: lattice.Vocabulary):
        self.texts = np.array([x.replace(lattice.SPACE, " ").encode() for x in vocabulary.names], object)
        for value, i in enumerate(vocabulary.byte_ids):
            self.texts[i] = bytes([value])

    def __call__(self, ids: np.ndarray) -> str:
        return b"".join(self.texts[ids].tolist()).decode("utf-8", "replace").removeprefix(" ")


def encode_nbest(docs: DataFrame, n: int = 3, id_column: str = "doc_id", text_column: str = "text", model: str = lattice.MODEL, decoded: str | None = None) -> DataFrame:
    """Rows (id, rank int from 1, score double, n_pieces int, ids array<int>), up to ``n`` for each row of ``docs``.

    With ``decoded`` the same worker adds the text of the ids under that name, as ``decode`` does.

    Scores fall with the rank; of equal scores the segmentation that changes fewer and earlier units comes
    first, and within a unit the one found first by the search. A text with fewer segmentations has fewer
    rows. Null and empty texts give one row without pieces, score 0. Equal ids stay separate rows; an empty
    table gives no rows; other columns are not read. Memory follows the largest text, not the partition.
    """
    schema = docs.select(id_column).schema.add("rank", T.IntegerType()).add("score", "double").add("n_pieces", T.IntegerType()).add("ids", T.ArrayType(T.IntegerType()))
    if decoded:
        schema = schema.add(decoded, T.StringType())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = lattice.load(model)
        segmenter, decoder = Segmenter(vocabulary, n), Decoder(vocabulary) if decoded else None
        for part in slices(batches, text_column, TEXT_BYTES):
            found = segmenter.encode(part.column(text_column).to_pylist())
            flat = [(k, rank, score, ids) for k, best in enumerate(found) for rank, (score, ids) in enumerate(best, 1)]
            sizes = np.array([len(x[3]) for x in flat])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate([x[3] for x in flat])))
            columns = [part.column(id_column).take(pa.array([x[0] for x in flat])), pa.array([x[1] for x in flat], pa.int32()), pa.array([x[2] for x in flat], pa.float64()), pa.array(sizes, pa.int32()), lists]
            if decoder:
                columns.append(pa.array([decoder(x[3]) for x in flat], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    return docs.select(id_column, text_column).mapInArrow(work, schema)


def decode(encoded: DataFrame, ids_column: str = "ids", text_column: str = "decoded", model: str = lattice.MODEL) -> DataFrame:
    """``encoded`` with the text of its ids as one more column; null ids give null, no ids an empty text.

    Byte pieces that are no valid UTF-8 become U+FFFD. Decoding what ``encode_nbest`` gave returns the text,
    with U+2581 read as a space.
    """
    schema = T.StructType([*encoded.schema.fields, T.StructField(text_column, T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lattice.load(model))
        for batch in batches:
            lists = batch.column(ids_column)
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            texts = [decoder(flat[a:b]) if known else None for a, b, known in zip(ends[:-1], ends[1:], lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.fieldNames())

    return encoded.mapInArrow(work, schema)
