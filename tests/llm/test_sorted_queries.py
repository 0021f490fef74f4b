"""Collocations, exact dedup and conversation repair against plain versions."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from airgrid.llm import conversation_repair as repair
from airgrid.llm import exact_dedup, phrase_collocations

DOCS = "doc_id long, text string, lang string, score double, phrase string"


def brute_collocations(rows, least, inside, top):
    counts, sizes = defaultdict(Counter), Counter()
    for text, lang in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, 4):
                    if i + k <= len(words):
                        counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) > len(p) and c >= least and 100 * c >= inside * a and p in (q[:2], q[1:]) for q, c in f.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, sizes[lang], -s))
    return sorted(out)


def odd_texts(seed=3):
    draw = random.Random(seed)
    words = ["a", "B", "c\x01", "été", "Éa", "the", "the", "the", "x" * 400]
    texts = [" ".join(draw.choices(words, k=draw.randrange(30))) + draw.choice(["", ".", "\n", "a, b", "\t\tthe  the"]) for _ in range(120)]
    return [*texts, None, "", " ", "...", "the " * 3000, "a.b.c", texts[0], texts[0]]


@pytest.mark.parametrize("hot", [False, True])
def test_collocations_equal_counting(spark, monkeypatch, hot):
    if hot:  # every prefix with over ten words is extended, groups are small
        monkeypatch.setattr(phrase_collocations, "GROUP_ROWS", 10)
        monkeypatch.setattr(phrase_collocations, "LEAF_BYTES", 500)
    rows = [(t, [None, "en", "d%09\te"][k % 3]) for k, t in enumerate(odd_texts())]
    docs = spark.createDataFrame([(k, t, lang, 0.5, "p") for k, (t, lang) in enumerate(rows)], DOCS)
    for least, top in ((2, 20), (10, 2000)):
        got = phrase_collocations.collocations(docs, least=least, top=top)
        assert sorted(map(tuple, got.collect())) == brute_collocations(rows, least, 50, top)
    assert phrase_collocations.collocations(docs.limit(0)).collect() == []


def test_collocation_scores_stay_exact_beyond_64_bits(spark):
    a, left, right = 3_000_000_019, 7_000_000_033, 4_000_000_007
    row = spark.range(1).select(F.lit(a).alias("a"), F.lit(left).alias("x"), F.lit(right).alias("y"))
    got = row.selectExpr("cast((cast(a as decimal(38,0)) * cast(a as decimal(20,0)) * 1000000) div (cast(x as decimal(20,0)) * cast(y as decimal(20,0))) as long)").first()[0]
    assert got == 1_000_000 * a * a // (left * right)


@pytest.mark.parametrize("share", [exact_dedup.SHARE, 0.9, 0.01])
def test_exact_dedup_equals_grouping(spark, monkeypatch, share):
    monkeypatch.setattr(exact_dedup, "SHARE", share)
    draw = random.Random(1)
    long = "y" * 5000
    texts = [draw.choice(["same", "same", "same ", "Same", None, "", "x" * 40 + "1", "x" * 40 + "2", long, long + "!", f"own {k}"]) for k in range(400)]
    rows = [(None if k % 37 == 0 else k // 2, t, None, 1.5, "p") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id string, hash double, salt string").repartition(5)
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    got = exact_dedup.dedup(docs)
    assert got.columns == ["doc_id", "text", "hash", "salt", "keep_id", "group_size", "kept", "sha256"]
    got = got.collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == sorted((i or -1, t or "") for i, t, *_ in rows)
    assert {(r.hash, r.salt) for r in got} == {(1.5, "p")}
    kept = defaultdict(list)
    for r in got:
        group = groups[r.text or ""]
        assert r.keep_id == max((i for i in group if i is not None), default=None)
        assert r.group_size == len(group)
        assert r.sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        if r.kept:
            kept[r.text or ""].append(r.doc_id)
    assert {t: v for t, v in kept.items()} == {t: [max((i for i in g if i is not None), default=None)] for t, g in groups.items()}
    assert exact_dedup.dedup(docs.limit(0)).collect() == []


def test_exact_dedup_normalises_and_sorts_without_a_second_exchange(spark):
    docs = spark.createDataFrame([(1, "A"), (2, "a"), (3, "b")], "doc_id long, text string")
    got = exact_dedup.dedup(docs, normalise=F.lower, columns=["doc_id"])
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in got.collect()) == [(1, 2, False), (2, 2, True), (3, 3, True)]


def plain_edits(initials, faults):
    """Least (cost, audit) by a shortest path over (turns read, state), all audits kept as strings."""
    moves = {"s": [(0, 1)], "u": [(0, 2), (1, 2), (3, 2)], "a": [(2, 3)]}
    best = {(0, 0): (0, "")}
    agenda = [(0, "", 0, 0)]
    while agenda:
        agenda.sort()
        cost, audit, at, state = agenda.pop(0)
        if best.get((at, state), (cost, audit)) < (cost, audit):
            continue
        steps = [(2, "I", at, q) for c in "ua" for p, q in moves[c] if p == state]
        if at < len(initials):
            steps.append((3, "D", at + 1, state))
            if faults[at] not in ("blank", "duplicate"):
                extra = int(faults[at] == "truncated")
                steps += [(2 + extra, "R", at + 1, q) for c in "ua" for p, q in moves[c] if p == state]
                steps += [(extra, "K", at + 1, q) for p, q in moves.get(initials[at], []) if p == state]
        for more, letter, i, q in steps:
            new = (cost + more, audit + letter)
            if new < best.get((i, q), (10**9, "")):
                best[i, q] = new
                agenda.append((*new, i, q))
    n = len(initials)
    return min(best[n, q] for q in (0, 3) if (n, q) in best)


def chart_edits(initials, faults):
    chart = repair.Chart()
    for c, f in zip(initials, faults, strict=True):
        chart.add(repair.turn_cells(c, f))
    return repair.best(chart.total())


def test_cells_give_the_cheapest_least_edits():
    kinds = [(c, f) for c in "suax" for f in (None, "blank", "truncated")]
    for n in range(4):
        for turns in itertools.product(kinds, repeat=n):
            initials, faults = [t[0] for t in turns], [t[1] for t in turns]
            assert chart_edits(initials, faults) == plain_edits(initials, faults)
    draw = random.Random(5)
    for _ in range(60):
        turns = draw.choices(kinds, k=draw.randrange(4, 14))
        initials, faults = [t[0] for t in turns], [t[1] for t in turns]
        assert chart_edits(initials, faults) == plain_edits(initials, faults)


def test_every_split_of_a_span_gives_the_same_cells():
    draw = random.Random(6)
    for _ in range(15):
        leaves = [repair.turn_cells(draw.choice("suax"), draw.choice([None, "blank", "truncated"])) for _ in range(7)]
        cells = {(i, i + 1): c for i, c in enumerate(leaves)}
        for length in range(2, 8):
            for i in range(8 - length):
                options = [repair.joined_cells(cells[i, k], cells[k, i + length]) for k in range(i + 1, i + length)]
                assert all(x == options[0] for x in options)
                cells[i, i + length] = options[0]


def plain_report(rows):
    """Report and repaired text of one conversation's rows (turn, role, text), read in order."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(repair.BLANKS)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in repair.LEGAL for a, b in itertools.pairwise(initials))
    cost, audit = plain_edits(initials, faults)
    lines, at = [], 0
    odd = sum(c != "D" for c in audit) % 2
    for c in audit:
        role, text = (None, "") if c == "I" else rows[at][1:]
        at += c != "I"
        if c != "D":
            new = "assistant" if (len(lines) - odd) % 2 else "user"
            lines.append(f"{role if c == 'K' else new}:{text}")
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.mark.parametrize("segment", [repair.SEGMENT_ROWS, 2])
def test_repair_equals_a_plain_version(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT_ROWS", segment)
    draw = random.Random(9)
    texts = ["Yes.", "No", "", " \t", None, "ok!", "x" * 300, "x" * 299 + "?", "é。", "two\nlines."]
    roles = ["user", "user", "assistant", "assistant", "system", "tool", "", None, "User"]
    rows = []
    for conv in [None, *range(25)]:
        rows += [(conv, draw.choice([None, *range(9)]) if conv and conv % 5 == 0 else k, draw.choice(roles), draw.choice(texts), 0) for k in range(draw.randrange(1, 12))]
    rows += [(99, k, "user" if k % 2 == 0 else "assistant", f"turn {k}.", 0) for k in range(300)]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, at int")
    turns, report = repair.repair(table.repartition(7))
    digest = {r.conv_id: r.sha256 for r in repair.digests(turns).collect()}
    got = {r.conv_id: (*r[1:], digest.get(r.conv_id, hashlib.sha256(b"").hexdigest())) for r in report.collect()}
    want = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        want[conv].append((turn, role, text))
    assert got == {conv: plain_report(x) for conv, x in want.items()}
    turns, report = repair.repair(table.limit(0))
    assert turns.collect() == [] and report.collect() == [] and repair.digests(turns).collect() == []


def test_damage_follows_the_checksum(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(40) for t in range(3)] + [(None, None, None, None)]
    got = Counter(tuple(r) for r in repair.damaged(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect())
    want = Counter()
    for c, t, role, text in rows:
        deal = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if deal == 1 else re.sub("[.!?]", "", text) if deal == 2 else text
        want[c, t, "user" if deal == 4 else role, text] += 0 if deal == 0 else 2 if deal == 3 else 1
    assert got == +want
