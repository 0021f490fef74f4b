"""Registered queries of this folder, each over its whole table, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.llm import (
    best_fit_packing, conversation_repair, document_fingerprints, exact_dedup, exact_search, language_id, ngram_join, phrase_collocations,
    secret_scans, sentencepiece_nbest, suffix_dedup, token_counts, url_filters,
)
from airgrid.llm.common import table, written

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Three best segmentations of every document, decoded again."""
    docs = table(spark, folder, "documents")
    return sentencepiece_nbest.encode_nbest(docs, decoded="decoded").withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


@query
def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes that each document loses to passages of 400 bytes found elsewhere."""
    found = suffix_dedup.dedup(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op3_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Shingle set size and component of every document."""
    return ngram_join.jaccard_components(table(spark, folder, "documents"))


@query
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token count and score of every document."""
    return token_counts.token_counts(table(spark, folder, "documents"))


@query
def op5_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document: counts of the base kinds, digest of their spans, all spans."""
    found = secret_scans.scan(table(spark, folder, "documents").select("doc_id", "text"))
    base = [r.kind for r in secret_scans.BASE]
    count = lambda kind: F.size(F.filter("secret_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, base),
        F.sha2(secret_scans.joined(F.filter("secret_spans", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"),
        secret_scans.joined(F.col("secret_spans")).alias("spans"),
    )


@query
def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Token pieces of every document and their places in sequences of 4096."""
    return best_fit_packing.pack(written(best_fit_packing.token_pieces(table(spark, folder, "documents"))))


@query
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    docs = table(spark, folder, "documents")
    found = language_id.predict(docs.select("doc_id", "text"), language_id.learned(docs))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "lang_set", "no_lang")


@query
def op8_exact_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best inner products of every twentieth vector."""
    return exact_search.top_k(exact_search.integer_vectors(table(spark, folder, "embeddings")))


@query
def op9_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return url_filters.judge_urls(table(spark, folder, "pages"), table(spark, folder, "labels"))


@query
def op10_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and its edited text, with likenesses."""
    return document_fingerprints.fingerprints(table(spark, folder, "documents"))


@query
def op11_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The 2000 best collocations of each language."""
    return phrase_collocations.collocations(table(spark, folder, "documents"))


@query
def op12_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Group of equal texts of every document, and which of them stays."""
    found = exact_dedup.dedup(table(spark, folder, "documents"), columns=["doc_id"])
    return found.withColumnRenamed("sha256", "text_sha256")


@query
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of every damaged conversation, its cheapest repair and the digest of what it gives."""
    rows = table(spark, folder, "conversations")
    turns, report = conversation_repair.repair(conversation_repair.damaged(rows))
    zero = F.lit(0).cast("long")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    parts = [
        rows.select("conv_id").distinct(), report.select("conv_id", *counts, "audit"),
        conversation_repair.digests(turns).withColumnRenamed("sha256", "repaired_sha256"),
    ]
    every = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    known = every.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in [*counts, "audit", "repaired_sha256"]])
    return known.select("conv_id", *[F.coalesce(c, zero).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


ORACLES["op8_exact_search"] = """
WITH sound AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM sound q JOIN sound c ON q.r <> c.r WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

ORACLES["op11_phrase_collocations"] = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^ \t]+') AS w FROM docs),
suffixes AS (SELECT lang, unnest(list_transform(range(1, len(w) + 1), lambda i: w[i:i+2])) AS s FROM pieces WHERE len(w) > 0),
phrases AS (
  SELECT lang, 1 AS size, s[1] AS p, count(*) AS c FROM suffixes GROUP BY 1, 3
  UNION ALL SELECT lang, 2, s[1] || ' ' || s[2], count(*) FROM suffixes WHERE len(s) >= 2 GROUP BY 1, 3
  UNION ALL SELECT lang, 3, s[1] || ' ' || s[2] || ' ' || s[3], count(*) FROM suffixes WHERE len(s) = 3 GROUP BY 1, 3),
sizes AS (SELECT lang, sum(c)::BIGINT AS n FROM phrases WHERE size = 1 GROUP BY lang),
found AS (SELECT lang, size, p, c, string_split(p, ' ') AS w FROM phrases WHERE size > 1 AND c >= 10),
cuts AS (
  SELECT lang, size, p, c, w, unnest(range(1, size)) AS k FROM found),
scored AS (
  SELECT x.lang, x.size, x.p, x.c, x.w, x.k, f.c AS l, g.c AS r, ((1000000::HUGEINT * x.c * x.c) // (f.c::HUGEINT * g.c))::BIGINT AS score
  FROM cuts x JOIN phrases f ON f.lang = x.lang AND f.p = array_to_string(x.w[1:x.k], ' ') JOIN phrases g ON g.lang = x.lang AND g.p = array_to_string(x.w[x.k+1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
longer AS (SELECT lang, q, max(c) AS most FROM (SELECT lang, c, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS q FROM found WHERE size = 3) GROUP BY lang, q),
kept AS (SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.q = b.p AND b.size = 2 WHERE o.most IS NULL OR 100 * o.most < 50 * b.c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, c DESC, p) AS rank FROM kept)
SELECT x.lang, x.rank, x.p AS phrase, x.c AS a, x.l, x.r, s.n, x.score FROM ranked x JOIN sizes s ON s.lang = x.lang WHERE x.rank <= 2000
"""

ORACLES["op12_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

#: Turn by turn, with the least (cost, audit) of each of the four states; insertions are applied three times behind each turn.
_PRUNED = "list_filter(list_sort({0}), lambda x, i: i = 1 OR list_sort({0})[i - 1].s <> x.s)"
_INSERTED = "list_concat({0}, list_transform(list_filter({0}, lambda x: true), lambda x: {{'s': CASE WHEN x.s = 2 THEN 3 ELSE 2 END, 'cost': x.cost + 2, 'audit': x.audit || 'I'}}))"
ORACLES["op13_conversation_repair"] = """
WITH RECURSIVE dealt AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
summed AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT)),
    lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384))), 4294967295) % 20 AS deal FROM dealt),
hurt AS (
  SELECT conv_id, turn, CASE WHEN deal = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN deal = 1 THEN '' WHEN deal = 2 THEN replace(replace(replace(text, '.', ''), '!', ''), '?', '') ELSE text END AS text,
    unnest(CASE WHEN deal = 3 THEN [0, 1] ELSE [0] END) AS copy FROM summed WHERE deal <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), copy) AS pos, rtrim(text, e' \t\n\x0b\x0c\r') AS body FROM hurt),
faulty AS (
  SELECT *, CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS two FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1, 0) - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
parse AS (
  SELECT conv_id, 0::BIGINT AS pos, [{'s': 0, 'cost': 0, 'audit': ''}, {'s': 2, 'cost': 2, 'audit': 'I'}, {'s': 3, 'cost': 4, 'audit': 'II'}] AS cells FROM counts
  UNION ALL
  SELECT conv_id, pos, """ + _PRUNED.format(_INSERTED.format("three")) + """ FROM (
  SELECT conv_id, pos, """ + _PRUNED.format(_INSERTED.format("two")) + """ AS three FROM (
  SELECT conv_id, pos, """ + _PRUNED.format(_INSERTED.format("one")) + """ AS two FROM (
  SELECT f.conv_id, f.pos, """ + _PRUNED.format("own") + """ AS one FROM (
  SELECT f.conv_id, f.pos, list_concat(
      list_transform(p.cells, lambda x: {'s': x.s, 'cost': x.cost + 3, 'audit': x.audit || 'D'}),
      CASE WHEN f.fault IN ('b', 'd') THEN [] ELSE list_transform(p.cells, lambda x: {'s': CASE WHEN x.s = 2 THEN 3 ELSE 2 END, 'cost': x.cost + 2 + (f.fault = 't')::INTEGER, 'audit': x.audit || 'R'}) END,
      CASE WHEN f.fault IN ('b', 'd') THEN [] ELSE list_transform(
        list_filter(p.cells, lambda x: (x.s = 0 AND left(f.role, 1) = 's') OR (x.s <> 2 AND left(f.role, 1) = 'u') OR (x.s = 2 AND left(f.role, 1) = 'a')),
        lambda x: {'s': CASE left(f.role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, 'cost': x.cost + (f.fault = 't')::INTEGER, 'audit': x.audit || 'K'}) END) AS own
    FROM parse p JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.pos = p.pos + 1) f))) ),
ended AS (
  SELECT conv_id, list_sort(list_transform(list_filter(cells, lambda x: x.s IN (0, 3)), lambda x: {'cost': x.cost, 'audit': x.audit}))[1] AS best
  FROM parse QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1),
letters AS (SELECT conv_id, best.audit AS audit, generate_subscripts(string_split(best.audit, ''), 1) AS k, unnest(string_split(best.audit, '')) AS e FROM ended WHERE best.audit <> ''),
edits AS (
  SELECT conv_id, k, e, sum((e <> 'I')::INTEGER) OVER (PARTITION BY conv_id ORDER BY k) AS pos, sum((e <> 'D')::INTEGER) OVER (PARTITION BY conv_id ORDER BY k) - 1
    - sum((e <> 'D')::INTEGER) OVER (PARTITION BY conv_id) % 2 AS line FROM letters),
turns AS (
  SELECT e.conv_id, e.k, CASE WHEN e.e = 'K' THEN f.role WHEN abs(e.line) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e.e = 'I' THEN '' ELSE f.text END AS line
  FROM edits e LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.pos = e.pos WHERE e.e <> 'D'),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY k) AS body FROM turns GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""
