"""Exact removal of repeated passages, byte by byte, by sorted suffixes that begin at content-defined anchors.

Every window of ``WINDOW`` bytes holds an anchor: the string of ``SEED`` bytes with the least hash among all in
the window. Equal windows have the same anchor at the same place, so only anchors whose string comes again can
lie in a repeated window. ``low`` .. ``high`` are the bytes by which the windows that an anchor leads begin before it.

* An anchor whose whole surrounding (all its windows together) comes again is settled at once.
* The others are sorted by what follows the anchor. Two suffixes are compared by prefix polynomial hashes: binary
  search finds how far they agree, in both directions from the anchor; bytes are compared to verify it.
* An anchor shared by many different surroundings is split: half of its windows contain more text before it, half
  more text behind it, and each half is grouped anew by the text that all its windows share, down to single windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.llm.common import BASE, LETTERS, byte_buffer, mixed, powers, slices, small_side, written

WINDOW, SEED = 400, 160
#: Different surroundings of one anchor that are sorted in one task; beyond it the anchor is split.
GROUP_ROWS = 64
_INVERSE = pow(BASE, -1, 1 << 64)
SPANS = "doc_id {id}, hash long, start int, stop int"


def _prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash modulo 2**64."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LETTERS[data] * powers(len(data)), out=sums[1:])
    return sums


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` entries."""
    out, span = values, 1
    while span * 2 <= width:
        out, span = np.minimum(out[:-span], out[span:]), span * 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of a text's anchors, their hashes, and how far before them the first and last window begins (low, high).

    Of equal hashes in a window the first place counts. A text shorter than a window has none.
    """
    n, width = len(data), window - seed + 1
    if n < window:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    sums, back = _prefix(data), powers(n, _INVERSE)
    count = n - seed + 1
    h = mixed((sums[seed:] - sums[:count]) * back[:count])
    # Windows begin at 0 .. n - window; the window's anchor is the first place of its least hash.
    least = _least(h, width)
    order = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    place = np.empty(len(least), np.int64)
    starts, stops = order, np.append(order[1:], len(least))
    for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
        # Over a run of windows with one least value its place moves on only where it leaves the window.
        where = a + np.flatnonzero(h[a : b - 1 + width] == least[a])
        if len(where) == 1:
            place[a:b] = where[0]
        else:
            place[a:b] = where[np.searchsorted(where, np.arange(a, b))]
    change = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.append(change[1:], len(place)) - 1
    spot = place[change]
    return spot, h[spot], spot - last, spot - change


def _anchor_rows(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """Rows (doc_id, hash, place, low, high, seed, z1, z2): anchors, and 128 bits of the bytes of all their windows."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, ends = byte_buffer(part.column("text"))
            owner, rows, zones = [], [], []
            for k in range(part.num_rows):
                own = data[ends[k] : ends[k + 1]]
                spot, h, low, high = anchors(own, window, seed)
                if not len(spot):
                    continue
                owner.append(np.full(len(spot), k))
                rows.append((spot, h, low, high))
                raw = own.tobytes()
                zones += [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip((spot - high).tolist(), (spot + window - low).tolist(), strict=True)]
            if not rows:
                continue
            spot, h, low, high = (np.concatenate(x) for x in zip(*rows, strict=True))
            zone = np.frombuffer(b"".join(zones), np.int64).reshape(-1, 2)
            take = pa.array(np.concatenate(owner))
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id").take(take), part.column("hash").take(take), *(pa.array(x.astype(np.int32)) for x in (spot, low, high)),
                pa.array(h.view(np.int64)), pa.array(zone[:, 0].copy()), pa.array(zone[:, 1].copy()),
            ], ["doc_id", "hash", "place", "low", "high", "seed", "z1", "z2"])

    return docs.mapInArrow(work, f"doc_id {kind}, hash long, place int, low int, high int, seed long, z1 long, z2 long")


class Suffix:
    """Surroundings of an anchor: bytes from ``high`` before it, with prefix hashes in both directions."""

    def __init__(self, around: bytes, high: int, low: int):
        self.around, self.high, self.low = around, high, low
        data = np.frombuffer(around, np.uint8)
        self.right, self.left = _prefix(data[high:]), _prefix(data[:high][::-1])


def extension(a: Suffix, b: Suffix, side: str, known: int = 0) -> int:
    """Length of the common part behind ("right") or before ("left") the anchors, by binary search, bytes verified."""
    x, y = getattr(a, side), getattr(b, side)
    low, high = known, min(len(x), len(y)) - 1
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if x[middle] == y[middle] else (low, middle - 1)
    if side == "right":
        same = a.around[a.high : a.high + low] == b.around[b.high : b.high + low]
    else:
        same = a.around[a.high - low : a.high] == b.around[b.high - low : b.high]
    if same:
        return low
    # Two strings with one hash: look at the bytes themselves.
    pairs = zip(a.around[a.high :], b.around[b.high :]) if side == "right" else zip(reversed(a.around[: a.high]), reversed(b.around[: b.high]))
    return next((i for i, (p, q) in enumerate(pairs) if p != q), low)


def sorted_suffixes(rows: list[Suffix]) -> tuple[list[int], list[int]]:
    """Order of what follows the anchors, by mergesort, and how far each agrees with the one before it in that order."""

    def before(i: int, j: int) -> bool:
        a, b = rows[i], rows[j]
        n = extension(a, b, "right")
        return a.around[a.high + n : a.high + n + 1] <= b.around[b.high + n : b.high + n + 1]

    runs = [[i] for i in range(len(rows))]
    while len(runs) > 1:
        merged = []
        for k in range(0, len(runs) - 1, 2):
            x, y, out = runs[k], runs[k + 1], []
            i = j = 0
            while i < len(x) and j < len(y):
                if before(x[i], y[j]):
                    out.append(x[i])
                    i += 1
                else:
                    out.append(y[j])
                    j += 1
            merged.append(out + x[i:] + y[j:])
        runs = merged + runs[len(runs) - len(runs) % 2 :]
    order = runs[0] if runs else []
    return order, [0] + [extension(rows[i], rows[j], "right") for i, j in zip(order, order[1:])]


def repeated_windows(rows: list[Suffix], window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """For each row the ranges (first, last) of bytes by which windows shared with another row begin before the anchor."""
    order, agree = sorted_suffixes(rows)
    out: list[list[tuple[int, int]]] = [[] for _ in rows]
    for i in range(len(order)):
        a, right = rows[order[i]], window
        for k in range(i + 1, len(order)):
            b = rows[order[k]]
            right = min(right, agree[k])
            if right < window - a.high:
                break
            left = extension(a, b, "left")
            first, last = max(window - right, a.low, b.low), min(left, a.high, b.high)
            if first <= last:
                out[order[i]].append((first, last))
                out[order[k]].append((first, last))
    return out


def _same_rows(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """Inner join on equal ``names``; only doc_id may be null, and null ids equal each other. Each name comes once."""
    renamed = right.withColumnsRenamed({name: f"__{name}" for name in names})
    equal = [F.col(name).eqNullSafe(F.col(f"__{name}")) if name == "doc_id" else F.col(name) == F.col(f"__{name}") for name in names]
    return left.join(renamed, equal).drop(*(f"__{name}" for name in names))


def repeated_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Rows (doc_id, hash, start, stop): bytes of each text that lie in a window which begins anywhere else too.

    ``docs`` is (doc_id, hash, text); rows that agree in all of these share their spans.
    """
    kind, id_type = docs.schema["doc_id"].dataType.simpleString(), _arrow(docs.schema["doc_id"].dataType)
    rows = _anchor_rows(docs, window, seed)
    seeds = rows.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed")
    again = written(rows.join(seeds, "seed"))
    zones = again.groupBy("seed", "z1", "z2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "hash", "place")).alias("first"))
    found = written(again.join(zones.where("n > 1").select("seed", "z1", "z2"), ["seed", "z1", "z2"]).select("doc_id", "hash", (F.col("place") - F.col("high")).alias("start"), (F.col("place") + window - F.col("low")).alias("stop")))
    spans = [found]
    # One row for each different surrounding of an anchor that has several.
    several = zones.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed")
    one = zones.join(several, "seed").select("seed", "z1", "z2", "first.*", F.col("n").alias("copies"))
    one = _same_rows(one, again.select("seed", "z1", "z2", "doc_id", "hash", "place", "low", "high"), ["seed", "z1", "z2", "doc_id", "hash", "place"]).distinct()
    asked = one.groupBy("doc_id", "hash").agg(F.collect_list(F.struct("seed", "place", "low", "high", "copies")).alias("places"))
    texts = _same_rows(docs, small_side(asked), ["doc_id", "hash"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = []
            for i, h, text, places in zip(*(part.column(c).to_pylist() for c in ("doc_id", "hash", "text", "places")), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                out += [{"doc_id": i, "hash": h, **p, "around": raw[p["place"] - p["high"] : p["place"] + window - p["low"]]} for p in places]
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    shape = pa.schema([
        ("doc_id", id_type), ("hash", pa.int64()), ("seed", pa.int64()), ("place", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("copies", pa.int64()), ("around", pa.binary()),
    ])
    pending = texts.mapInArrow(cut, f"doc_id {kind}, hash long, seed long, place int, low int, high int, copies long, around binary")
    pending = written(pending.distinct().select("*", F.col("high").alias("full"), F.col("seed").cast("string").alias("key"), F.lit(0).alias("near"), F.lit(window - seed).alias("far")))

    def compare(batch: pa.Table) -> pa.Table:
        columns = {c: batch.column(c).to_pylist() for c in ("doc_id", "hash", "place", "low", "high", "full", "copies", "around")}
        n, out = batch.num_rows, []
        # A piece of an anchor's windows [low, high] sees the bytes of just these windows.
        suffixes = [Suffix(columns["around"][i][columns["full"][i] - columns["high"][i] :], columns["high"][i], columns["low"][i]) for i in range(n)]
        for i, ranges in enumerate(repeated_windows(suffixes, window)):
            if columns["copies"][i] == 1:
                out += [(columns["doc_id"][i], columns["hash"][i], columns["place"][i] - last, columns["place"][i] - first + window) for first, last in ranges]
        names, types = ("doc_id", "hash", "start", "stop"), (id_type, pa.int64(), pa.int32(), pa.int32())
        return pa.table([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names=list(names))

    while True:
        sizes = pending.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        sized = written(pending.join(sizes, "key"))
        few = sized.where(F.col("n") <= GROUP_ROWS).drop("n")
        spans.append(written(few.groupBy("key").applyInArrow(compare, SPANS.format(id=kind))))
        many = sized.where(F.col("n") > GROUP_ROWS).drop("n")
        if not many.take(1):
            break
        # All rows of a key look at windows that begin ``near`` .. ``far`` bytes before the anchor; these are halved.
        middle = F.floor((F.col("near") + F.col("far")) / 2).cast("int")
        halves = many.withColumn("half", F.explode(F.array(F.struct(F.col("near").alias("n"), middle.alias("f")), F.struct((middle + 1).alias("n"), F.col("far").alias("f")))))
        halves = halves.withColumns({"near": F.col("half.n"), "far": F.col("half.f"), "low": F.greatest("low", "half.n"), "high": F.least("high", "half.f")}).where("low <= high").drop("half", "key")
        # All windows of a half hold the bytes from ``near`` before the anchor to where the earliest window ends.
        shared = F.sha2(F.concat(F.expr(f"substring(around, full - near + 1, {window} - far + near)"), F.encode(F.concat_ws(":", F.lit(""), "seed", "near", "far"), "utf-8")), 256)
        own = F.sha2(F.concat(F.expr(f"substring(around, full - high + 1, {window} - low + high)"), F.encode(F.concat_ws(":", F.lit(""), "low", "high"), "utf-8")), 256)
        halves = written(halves.withColumn("key", shared).withColumn("zone", own))
        known = halves.groupBy("key", "zone").agg(F.sum("copies").alias("all"), F.min(F.struct("doc_id", "hash", "place")).alias("first"))
        twice = known.where("all > 1").select("key", "zone")
        whole = halves.where("copies = 1").join(twice, ["key", "zone"]).select("doc_id", "hash", (F.col("place") - F.col("high")).alias("start"), (F.col("place") + window - F.col("low")).alias("stop"))
        spans.append(written(whole))
        kept = known.select("key", "zone", "first.*", F.when(F.col("all") > 1, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("copies"))
        pending = _same_rows(halves.drop("copies"), kept, ["key", "zone", "doc_id", "hash", "place"]).select("doc_id", "hash", "seed", "place", "low", "high", "copies", "around", "full", "key", "near", "far").distinct()
        pending = written(pending)
    out = spans[0]
    for more in spans[1:]:
        out = out.union(more)
    return out


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``docs`` with kept_text, n_bytes long, n_removed long, n_spans long, kept_sha256: texts without their repeated bytes.

    Texts are bytes of UTF-8 and matches stay within a document. A byte goes if a string of ``window`` bytes
    that covers it begins anywhere else, in the same document or another; all is judged on the input. In
    ``kept_text`` what is left of a cut character becomes U+FFFD; the digest is of the bytes themselves. Null
    texts are empty; repeated rows remove each other's bytes, whatever their ids, null ids too; other columns stay, columns of
    the added names are replaced; an empty table gives no rows.
    """
    added = ["kept_text", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    own = F.coalesce(F.col(text_column), F.lit(""))
    keyed = docs.drop(*added).withColumn("__hash", F.xxhash64(F.col(id_column), own))
    source = keyed.select(F.col(id_column).alias("doc_id"), F.col("__hash").alias("hash"), own.alias("text"))
    spans = repeated_spans(source, window, seed)
    spans = spans.groupBy("doc_id", "hash").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("__spans"))
    spans = small_side(spans.select(F.col("hash").alias("__hash"), F.col("doc_id").alias("__id"), "__spans"))
    joined = keyed.join(spans, (keyed["__hash"] == spans["__hash"]) & keyed[id_column].eqNullSafe(spans["__id"]), "left").drop("__id", spans["__hash"]).drop("__hash")
    shape = docs.drop(*added).schema
    for name, kind in zip(added, ("string", "long", "long", "long", "string"), strict=True):
        shape = shape.add(name, kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_column):
            rows = []
            for text, ranges in zip(part.column(text_column).to_pylist(), part.column("__spans").to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                kept, at, n, end = [], 0, 0, -1
                for x in ranges or ():
                    if x["start"] > end:
                        kept.append(raw[at : x["start"]])
                        n += 1
                    end = max(end, x["stop"])
                    at = end
                left = b"".join([*kept, raw[at:]])
                rows.append((left.decode("utf-8", "replace"), len(raw), len(raw) - len(left), n, hashlib.sha256(left).hexdigest()))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in shape.names[: -len(added)]), *columns], shape.names)

    return joined.mapInArrow(work, shape)
