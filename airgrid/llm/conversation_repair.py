"""Repair of conversations by weighted CYK parsing with edits.

The repaired roles are ``(s?(ua)+)?``. Four states say what has been written so far: nothing, the system turn, a user
turn, a whole pair. The grammar is in Chomsky normal form over pairs of states: ``X[p,q] -> X[p,r] X[r,q]``; a turn
derives ``X[p,q]`` by keeping, rewriting the role or deleting it; inserted turns are folded into the cells as a
closure behind each turn. A cell holds the least (cost, audit) of its span.

Every split of a span gives the same cells, because equally dear audits of one span cannot begin one another (the
longer one would hold more inserted turns). So each span is split once, in halves, and spans are combined bottom-up
by length 1, 2, 4, ...; long conversations are cut into segments that tasks parse independently.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.llm.common import written

NOTHING, SYSTEM, USER, PAIR = range(4)
#: Letter written and the states it leads from and to.
WRITES = {"s": ((NOTHING, SYSTEM),), "u": ((NOTHING, USER), (SYSTEM, USER), (PAIR, USER)), "a": ((USER, PAIR),)}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
LEGAL = ("su", "ua", "au")
#: Turns of one segment, and characters of a text that order turns of one number.
SEGMENT_ROWS, ORDER_CHARACTERS = 4096, 64
#: White space of texts.
BLANKS = " \t\n\x0b\x0c\r"
FAULTS = ("blank", "duplicate", "truncated")

Cells = dict[tuple[int, int], tuple[int, str]]


def joined_cells(left: Cells, right: Cells) -> Cells:
    """Cells of two spans together: X[p,q] -> X[p,r] X[r,q], least (cost, audit)."""
    out: Cells = {}
    for (p, r), (cost, audit) in left.items():
        for q in range(4):
            more = right.get((r, q))
            if more is not None:
                both = (cost + more[0], audit + more[1])
                if (p, q) not in out or both < out[p, q]:
                    out[p, q] = both
    return out


def _closure() -> Cells:
    """Cells of turns inserted where none was; a walk over four states needs three steps at most."""
    step = {edge: (INSERT, "I") for letter in "ua" for edge in WRITES[letter]}
    cells: Cells = {(p, p): (0, "") for p in range(4)}
    for _ in range(3):
        for key, value in joined_cells(cells, step).items():
            cells[key] = min(value, cells.get(key, value))
    return cells


INSERTED = _closure()


def turn_cells(initial: str, fault: str | None) -> Cells:
    """Cells of one turn, with the turns inserted behind it."""
    cells: Cells = {(p, p): (DELETE, "D") for p in range(4)}
    if fault not in ("blank", "duplicate"):
        extra = TRUNCATED if fault == "truncated" else 0
        for letter in "ua":
            cells.update({edge: (REROLE + extra, "R") for edge in WRITES[letter]})
        cells.update({edge: (extra, "K") for edge in WRITES.get(initial, ())})
    return joined_cells(cells, INSERTED)


class Chart:
    """Cells of a growing row of spans; spans of equal length are combined, so that lengths are powers of two."""

    def __init__(self):
        self.spans: list[tuple[int, Cells]] = []

    def add(self, cells: Cells, length: int = 1) -> None:
        while self.spans and self.spans[-1][0] <= length:
            n, before = self.spans.pop()
            cells, length = joined_cells(before, cells), n + length
        self.spans.append((length, cells))

    def total(self) -> Cells:
        """Cells of all spans together, the insertions before the first turn included."""
        out = None
        for _, cells in reversed(self.spans):
            out = cells if out is None else joined_cells(cells, out)
        return INSERTED if out is None else joined_cells(INSERTED, out)

    def whole(self) -> Cells:
        """Cells of all spans together."""
        out = None
        for _, cells in reversed(self.spans):
            out = cells if out is None else joined_cells(cells, out)
        return out


def best(cells: Cells) -> tuple[int, str]:
    """Least (cost, audit) that writes whole pairs or nothing."""
    return min(cells[NOTHING, q] for q in (NOTHING, PAIR) if (NOTHING, q) in cells)


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with the faults that crc32 of ``conv_id:turn`` deals; nulls in strings are one space.

    0 drops a row, 1 empties its text, 2 takes ``. ! ?`` out of it, 3 repeats the row, 4 makes it a user's.
    """
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("deal"))
    text = F.when(F.col("deal") == 1, F.lit("")).when(F.col("deal") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("deal") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("deal") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("deal <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows with ``at`` long: their place, growing by one within a range; conversations of any length spread over ranges."""
    head, hash_ = F.substring("text", 1, ORDER_CHARACTERS), F.xxhash64("text")
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    keys = ["conv_id", "turn", "role", "head", "hash"]
    rows = rows.withColumns({"head": head, "hash": hash_}).repartitionByRange(*keys).sortWithinPartitions(*keys, "text")
    return written(rows.drop("head", "hash").withColumn("at", F.monotonically_increasing_id()))


def _faulty(placed: DataFrame) -> DataFrame:
    """Rows (conv_id, at, turn, initial, fault int: 0 none, else 1 + its number in ``FAULTS``)."""
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    same = F.sha2(F.concat_ws(":", F.col("conv_id").isNull().cast("string"), F.length(conv), conv, F.length("role"), "role", "text"), 256)
    rows = placed.select("conv_id", "at", "turn", F.substring("role", 1, 1).alias("initial"), (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"), same.alias("same"))
    firsts = rows.groupBy("same").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = F.coalesce(F.col("at") > F.col("first"), F.lit(False))
    fault = F.when(F.col("blank"), 1).when(again, 2).when(F.col("cut"), 3).otherwise(0)
    return rows.join(firsts, "same", "left").select("conv_id", "at", "turn", "initial", fault.alias("fault"))


def _segments(faulty: DataFrame) -> DataFrame:
    """Rows (conv_id, first, length, illegal, head, tail, cells) of runs of turns that follow each other in one range."""
    kind = faulty.schema["conv_id"].dataType.simpleString()
    known: dict[tuple[str, int], Cells] = {}

    def leaf(initial: str, fault: int) -> Cells:
        key = (initial if initial in WRITES else "", fault)
        if key not in known:
            known[key] = turn_cells(key[0], FAULTS[fault - 1] if fault else None)
        return known[key]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, chart, done = None, None, []

        def ended() -> None:
            cells = [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in chart.whole().items()]
            done.append({**row, "cells": cells})

        for batch in batches:
            for conv, at, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "at", "initial", "fault")), strict=True):
                if row is None or row["conv_id"] != conv or row["first"] + row["length"] != at or row["length"] >= SEGMENT_ROWS:
                    if row is not None:
                        ended()
                    row, chart = {"conv_id": conv, "first": at, "length": 0, "illegal": 0, "head": initial, "tail": None}, Chart()
                elif row["tail"] + initial not in LEGAL:
                    row["illegal"] += 1
                row["length"] += 1
                row["tail"] = initial
                chart.add(leaf(initial, fault))
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=pa.schema(shape).set(0, pa.field("conv_id", batch.schema.field("conv_id").type)))
                done = []
            types = batch.schema.field("conv_id").type
        if row is not None:
            ended()
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema(shape).set(0, pa.field("conv_id", types)))

    cell = pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    shape = [("conv_id", pa.int64()), ("first", pa.int64()), ("length", pa.int64()), ("illegal", pa.int64()), ("head", pa.string()), ("tail", pa.string()), ("cells", pa.list_(cell))]
    # Segments that begin elsewhere on a second run would still parse to the same audit.
    dealt = faulty.drop("turn").repartitionByRange("at").sortWithinPartitions("at")
    return dealt.mapInArrow(work, f"conv_id {kind}, first long, length long, illegal long, head string, tail string, cells array<struct<p int, q int, cost long, audit string>>")


def _parsed(segments: DataFrame) -> DataFrame:
    """Rows (conv_id, first, part, written, illegal, cost, audit): the edits of each segment; the last three in the first one only."""
    kind = segments.schema["conv_id"].dataType.simpleString()

    def work(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda x: x["first"])
        chart, illegal = Chart(), sum(x["illegal"] for x in rows)
        for k, x in enumerate(rows):
            chart.add({(c["p"], c["q"]): (c["cost"], c["audit"]) for c in x["cells"]}, x["length"])
            illegal += k > 0 and rows[k - 1]["tail"] + x["head"] not in LEGAL
        cost, audit = best(chart.total())
        letters = np.frombuffer(audit.encode(), np.uint8)
        turns = np.append(np.flatnonzero(letters != ord("I")), len(letters))
        lines = np.concatenate([[0], np.cumsum(letters != ord("D"))])
        # Pairs are even; an odd number of written turns begins with the system's.
        at, done, out = 0, 0, []
        for k, x in enumerate(rows):
            done += x["length"]
            end = int(turns[done]) if done < len(turns) - 1 else len(letters)
            first = {"illegal": illegal, "cost": cost, "audit": audit} if not k else {"illegal": None, "cost": None, "audit": None}
            out.append({"conv_id": x["conv_id"], "first": x["first"], "part": audit[at:end], "written": int(lines[at] - lines[-1] % 2), **first})
            at = end
        return pa.Table.from_pylist(out, schema=pa.schema([group.schema.field("conv_id"), ("first", pa.int64()), ("part", pa.string()), ("written", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]))

    return segments.groupBy("conv_id").applyInArrow(work, f"conv_id {kind}, first long, part string, written long, illegal long, cost long, audit string")


def _edits(parsed: DataFrame) -> DataFrame:
    """Rows (conv_id, first, k, edit, at, new_role): one for each letter of the audits; no ``at`` for inserted turns, a role for new ones."""
    kind = parsed.schema["conv_id"].dataType.simpleString()
    source = parsed.select("conv_id", "first", "part", "written")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                conv, part = batch.column("conv_id").slice(i, 1), batch.column("part")[i].as_py()
                first, written_ = batch.column("first")[i].as_py(), batch.column("written")[i].as_py()
                letters = np.frombuffer(part.encode(), np.uint8)
                if not len(letters):
                    continue
                own = letters != ord("I")
                line = written_ + np.cumsum(letters != ord("D")) - 1
                renamed = (letters == ord("I")) | (letters == ord("R"))
                yield pa.RecordBatch.from_arrays([
                    conv.take(pa.array(np.zeros(len(letters), np.int64))), pa.array(np.full(len(letters), first)), pa.array(np.arange(len(letters), dtype=np.int64)), pa.array(list(part)),
                    pa.array(first + np.cumsum(own) - 1, mask=~own), pa.array(np.where(line % 2, "assistant", "user").tolist(), pa.string(), mask=~renamed),
                ], ["conv_id", "first", "k", "edit", "at", "new_role"])

    return source.mapInArrow(work, f"conv_id {kind}, first long, k long, edit string, at long, new_role string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repaired turns (conv_id, first, k, edit, role, text, in that order within a conversation) and a report for each conversation.

    ``rows`` is (conv_id, turn, role, text); further columns are not read, null roles and texts are one space. Turns
    are taken by number, nulls first; of one number by role, then text (its first 64 characters, then its hash). A
    turn's first fault counts: blank, duplicate (role and text seen earlier), truncated (does not end in ``. ! ?``).
    Blank and duplicate turns are deleted (3); others may be kept (0), given the role user or assistant (2) or deleted;
    turns without text may be inserted (2); a truncated turn that stays costs 1 more. The cheapest edits that make the
    initials of the roles ``(s?(ua)+)?`` count, of equally dear ones the least audit in ASCII.

    The report has gaps, blank, duplicate, truncated, illegal, cost (long) and audit for each conv_id with rows, null
    included; an empty table gives none.
    """
    placed = _ordered(rows)
    faulty = written(_faulty(placed))
    # The parts of an audit, all from one parse.
    parsed = written(_parsed(_segments(faulty)))
    edits = _edits(parsed).where("edit <> 'D'").join(placed.select("at", "role", "text"), "at", "left")
    turns = edits.select("conv_id", "first", "k", "edit", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    held = [F.sum((F.col("fault") == k).cast("long")).alias(name) for k, name in enumerate(FAULTS, 1)]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)).cast("long") - F.count_distinct("turn")
    counts = faulty.groupBy("conv_id").agg(gaps.alias("gaps"), *held)
    found = parsed.where("audit is not null").select("conv_id", "illegal", "cost", "audit")
    # Each conversation has one row on either side.
    report = counts.withColumnRenamed("conv_id", "__conv").join(found, F.col("__conv").eqNullSafe(F.col("conv_id")))
    return turns, report.select("conv_id", "gaps", *FAULTS, "illegal", "cost", "audit")


def digests(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, sha256) over ``role:text`` of a conversation's turns, newline-joined; rows are streamed, none is held."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "first", "k").select("conv_id", F.concat_ws(":", "role", "text").alias("line"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, now, kind_ = None, None, None
        for batch in batches:
            ids, hashes, kind_ = [], [], batch.schema.field("conv_id").type
            for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist(), strict=True):
                line = line.encode("utf-8", "surrogatepass")
                if hasher is not None and conv == now:
                    hasher.update(b"\n" + line)
                    continue
                if hasher is not None:
                    ids.append(now)
                    hashes.append(hasher.hexdigest())
                hasher, now = hashlib.sha256(line), conv
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind_), pa.array(hashes, pa.string())], ["conv_id", "sha256"])
        if hasher is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind_), pa.array([hasher.hexdigest()])], ["conv_id", "sha256"])

    return dealt.mapInArrow(work, f"conv_id {kind}, sha256 string")
