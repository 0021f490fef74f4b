"""URL verdicts: stated host rules first, else rules mined from labelled URLs."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.llm.common import written
from airgrid.session import broadcast_if_small

# Fixed values: (verdict, host, path) of the stated rules.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCKED = "label:block"
#: Share of the labelled pages in which a mined rule and its label come together, and of a rule's pages those with the label.
MIN_SUPPORT, MIN_CONFIDENCE = 0.005, 0.5


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, in lower case; empty without it."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def stated(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest stated rule that fits, null where none does."""
    text = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, words of the host, path parts with digits as ``#``, parameter names."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)

    def each(prefix: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(prefix), x))

    return F.array_distinct(F.coalesce(F.concat(
        F.array(F.concat(F.lit("scheme:"), F.regexp_extract(url, r"(?s)^(.*?)://", 1))),
        each("word:", F.split(host, r"[.\-]")),
        each("path:", F.split(F.regexp_replace(path, "[0-9]+", "#"), r"[/.]")),
        each("key:", F.transform(F.split(query, "&"), lambda x: F.split(x, "=")[0])),
    ), F.array().cast("array<string>")))


def mine_rules(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (rule_id, tokens, support, confidence) that say "block", mined by FP-growth.

    A label says "block" for quality 0 or toxic 1; labels and pages meet on page_id = doc_id, and a page with
    several labels is blocked by any. A rule's tokens and the label must come together in ``min_support`` of the labelled
    pages, at every size of the table. Rows without label or URL take no part; without labels there are no rules.
    """
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(bad).alias("__bad"))
    found = pages.where("url is not null").select("page_id", url_tokens(F.col("url")).alias("__tokens")).join(marks, F.col("page_id") == F.col("doc_id"))
    baskets = written(found.select(F.when(F.col("__bad"), F.array_append("__tokens", F.lit(BLOCKED))).otherwise(F.col("__tokens")).alias("items")))
    sets = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets).freqItemsets
    sets = written(sets.select(F.array_sort("items").alias("items"), "freq"))
    rules = sets.where(F.array_contains("items", BLOCKED) & (F.size("items") > 1)).select(F.array_remove("items", BLOCKED).alias("items"), F.col("freq").alias("__both"))
    confidence = F.col("__both") / F.col("freq")
    rules = rules.join(sets, "items").where(confidence >= min_confidence)
    return written(rules.select(F.xxhash64("items").alias("rule_id"), F.col("items").alias("tokens"), F.col("__both").alias("support"), confidence.alias("confidence")))


def mined_matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (url, confidence) of the URLs that hold all tokens of a rule; the highest confidence counts.

    The rules are indexed by token. The index is broadcast only when it is small.
    """
    index = broadcast_if_small(rules.select("rule_id", "confidence", F.size("tokens").alias("n"), F.explode("tokens").alias("token")))
    held = urls.select("url", F.explode(url_tokens(F.col("url"))).alias("token"))
    hits = held.join(index, "token").groupBy("url", "rule_id", "n", "confidence").agg(F.count("*").alias("hit"))
    return hits.where("hit = n").groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, confidence), one for each row of ``pages``.

    The longest stated rule that fits decides; else a URL that matches a mined rule is blocked, and any other
    allowed. ``confidence`` is that of the best mined rule, null without one. A null URL, or one without
    ``://``, has an empty host and path, no rule, and is allowed unless mined tokens match. Equal URLs get equal verdicts; repeated rows
    stay; other columns are not read; an empty table gives no rows.
    """
    pages = pages.select("page_id", "url")
    mined = mine_rules(pages, labels.select("doc_id", "quality", "toxic"), min_support, min_confidence)
    found = mined_matches(pages.where("url is not null").select("url").distinct(), mined)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = stated(host, path, rules)
    return pages.join(found, "url", "left").select(
        "page_id", host.alias("host"), path.alias("path"), rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), "confidence",
    )
