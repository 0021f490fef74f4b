"""Secrets in texts, found by regular expressions behind a trigram index."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.llm.common import text_or_empty

_parser = re._parser


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and the least length of one of its groups (0: the match)."""

    kind: str
    pattern: str
    group: int
    length: int


# The base kinds, in the order that breaks ties of equal begins.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    Rule("code_host", r"gh[opsur]_[A-Za-z0-9]{36,}", 0, 1),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}", 0, 1),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}", 0, 1),
)
RULES = BASE + MORE
#: Strings that one part of a pattern may stand for before it is taken as unknown.
MOST_STRINGS = 64


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """Trigrams that a match must hold, in lower case: all of the clauses, in each any alternative, in it all trigrams.

    Runs of the pattern that stand for few strings are written out; a run with a string of less than three
    characters demands nothing. No clauses: every text must be scanned.
    """
    clauses: list[list[list[str]]] = []

    def close(strings: set[str]) -> None:
        if strings and all(len(x) >= 3 for x in strings):
            clauses.append(sorted([sorted({x[i : i + 3] for i in range(len(x) - 2)}) for x in strings]))

    def strings_of(node) -> set[str] | None:
        """All strings a part stands for, None if they are many."""
        kind, value = str(node[0]), node[1]
        if kind == "LITERAL":
            return {chr(value).lower()}
        if kind == "IN":
            parts = [strings_of(x) for x in value]
            return set().union(*parts) if all(p is not None for p in parts) and len(parts) <= MOST_STRINGS else None
        if kind == "SUBPATTERN":
            return sequence_of(value[-1])
        if kind == "BRANCH":
            parts = [sequence_of(x) for x in value[1]]
            return set().union(*parts) if all(p is not None for p in parts) else None
        if kind == "MAX_REPEAT" and value[1] is not _parser.MAXREPEAT and value[1] <= 5:
            inner = sequence_of(value[2])
            if inner is None:
                return None
            out, now = set(), {""}
            for n in range(int(value[1]) + 1):
                if n >= value[0]:
                    out |= now
                now = {a + b for a in now for b in inner}
                if len(now) > MOST_STRINGS:
                    return None
            return out
        return None

    def sequence_of(nodes) -> set[str] | None:
        out = {""}
        for node in nodes:
            own = strings_of(node)
            if own is None or len(out) * len(own) > MOST_STRINGS:
                return None
            out = {a + b for a in out for b in own}
        return out

    def walk(nodes) -> None:
        run: set[str] = {""}
        for node in nodes:
            own = strings_of(node)
            if own is not None and len(run) * len(own) <= MOST_STRINGS and not ("" in own and all(len(x) >= 3 for x in run)):
                run = {a + b for a in run for b in own}
                continue
            close(run)
            run = own if own is not None else {""}
            if own is None and str(node[0]) == "SUBPATTERN":
                walk(node[1][-1])
        close(run)

    walk(_parser.parse(pattern))
    return clauses


def postings(docs: DataFrame, trigrams: list[str], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Inverted index rows (trigram, id) over whole texts in lower case, for the trigrams that rules ask for."""
    low = F.lower(F.col(text_column))
    held = F.filter(F.array(*[F.when(low.contains(t), F.lit(t)) for t in trigrams]), lambda x: x.isNotNull())
    return docs.select(F.col(id_column), F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules=RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, kinds array<string>): the rules whose trigram query a text fulfils; rules without clauses are left out.

    Postings are intersected by counting, for each text, the trigrams of every alternative that it holds.
    """
    spark = docs.sparkSession
    wanted = [(r.kind, c, a, len(alt), len(clauses), t) for r in rules for clauses in [trigram_query(r.pattern)] for c, clause in enumerate(clauses) for a, alt in enumerate(clause) for t in alt]
    index = postings(docs, sorted({x[-1] for x in wanted}), id_column, text_column)
    # As many rows as the rules have trigrams, whatever the input.
    query = F.broadcast(spark.createDataFrame(wanted, "kind string, clause int, alternative int, size int, clauses int, trigram string"))
    whole = index.join(query, "trigram").groupBy(id_column, "kind", "clause", "alternative", "size", "clauses").agg(F.countDistinct("trigram").alias("held")).where("held = size")
    kinds = whole.groupBy(id_column, "kind", "clauses").agg(F.countDistinct("clause").alias("held")).where("held = clauses")
    return kinds.groupBy(id_column).agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def _bound(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once; named inside lambdas it would be computed for every entry."""
    return F.transform(F.array(value), then)[0]


def _before(values: Column, fold, zero: Column) -> Column:
    """For each entry the fold of all entries before it, by blocks of 256 so that long arrays stay cheap."""
    over = lambda part: F.aggregate(part, zero, fold)
    block = lambda i: F.floor(i / 256).cast("int")

    def whole(v: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), block(F.size(v))), lambda b: over(F.slice(v, b * 256 + 1, F.lit(256))))
        starts = lambda blocks: F.transform(blocks, lambda _, b: over(F.slice(blocks, F.lit(1), b)))
        each = lambda before: F.transform(v, lambda _, i: fold(F.get(before, block(i)), over(F.slice(v, block(i) * 256 + 1, i % 256))))
        return _bound(sums, lambda blocks: _bound(starts(blocks), each))

    return _bound(values, whole)


def _lengths_before(lengths: Column) -> Column:
    """Sum of the entries before each one."""
    return _before(lengths, lambda a, x: a + x, F.lit(0).cast("long"))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, kind, end) of a rule's matches in code points, end exclusive; failing matches are left out."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    held = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    sizes = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.coalesce(F.length(g), F.lit(0)).cast("long") + F.length(m))
    rows = F.arrays_zip(_lengths_before(sizes).alias("before"), gaps.alias("gap"), matches.alias("found"), held.alias("held"))
    rows = F.filter(rows, lambda x: x["found"].isNotNull() & (F.length(x["held"]) >= rule.length))
    return F.transform(rows, lambda x: F.struct(
        (x["before"] + F.length(x["gap"])).alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"),
        (x["before"] + F.length(x["gap"]) + F.length(x["found"])).alias("end"),
    ))


NO_SPANS = "array<struct<start:bigint,order:int,kind:string,end:bigint>>"


def scan(docs: DataFrame, rules=RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with ``secret_spans``: array of (start, order, kind, end), by start and then the order of the rules.

    Rules with mandatory trigrams run only over the texts that the index offers; rules without run over all.
    A null or empty text has no spans. Rows whose id is null or repeated are each scanned: the index may then
    offer a text more rules than needed, never fewer. Further columns stay, whatever their names; an empty
    table gives none.
    """
    key = "__secret_id"
    keyed = docs.withColumn(key, F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    offered = candidates(keyed.select(key, F.col(text_column).alias("__secret_text")), rules, key, "__secret_text").withColumnRenamed("kinds", "__secret_kinds")
    text, none = text_or_empty(text_column), F.array().cast(NO_SPANS)
    found = []
    for order, rule in enumerate(rules):
        runs = F.array_contains("__secret_kinds", rule.kind) if trigram_query(rule.pattern) else F.lit(True)
        found.append(F.when(runs & text.rlike(rule.pattern), spans_of(text, rule, order)).otherwise(none))
    return keyed.join(offered, key, "left").withColumn("secret_spans", F.array_sort(F.concat(*found))).select(*docs.columns, "secret_spans")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def masked(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """The text with every run of touching or overlapping spans replaced by ``mark``."""
    none = F.lit(-1).cast("long")
    reached = _before(F.transform(spans, lambda x: x["end"]), lambda a, x: F.greatest(a, x), none)
    # A run begins where no span before reaches; it ends where the one before the next run does.
    begins = F.filter(F.zip_with(spans, reached, lambda x, r: F.struct(x["start"].alias("start"), r.alias("reached"))), lambda x: x["start"] > x["reached"])
    last = F.aggregate(spans, none, lambda a, x: F.greatest(a, x["end"]))

    def cut(runs: Column) -> Column:
        ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.slice(runs, F.lit(2), F.greatest(F.size(runs) - 1, F.lit(0))), lambda x: x["reached"]), F.array(last))
        stops = F.concat(F.transform(runs, lambda x: x["start"]), F.array(F.length(text).cast("long")))
        pairs = F.zip_with(ends, stops, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        part = lambda body, first, stop: F.substring(body, (first + 1).cast("int"), (stop - first).cast("int"))

        def block(own: Column) -> Column:
            first = own[0]["a"]
            return _bound(part(text, first, F.element_at(own, -1)["b"]), lambda body: F.transform(own, lambda x: part(body, x["a"] - first, x["b"] - first)))

        # A substring walks its text from the begin, so 256 pieces are cut out together first.
        blocks = lambda p: F.filter(F.transform(F.sequence(F.lit(0), F.floor(F.size(p) / 256).cast("int")), lambda k: F.slice(p, k * 256 + 1, F.lit(256))), lambda own: F.size(own) > 0)
        return _bound(pairs, lambda p: F.flatten(F.transform(blocks(p), block)))

    pieces = _bound(begins, cut)
    return F.when(F.size(spans) > 0, F.array_join(pieces, mark)).otherwise(text)
