"""Repair of identifiers that lost zeros, and joins on parts of keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.functions.keys import normalize_station
from airgrid.operators.ordered import running_sum
from airgrid.session import broadcast_if_small


#: What may have become of an id: zeros lost in front, zeros left out at the end, zeros that the census lost in front.
REPAIR_RULES = ("left", "right", "strip")


def reconcile_ids(geo: DataFrame, census: DataFrame, key: str = "geo_id", rules: Sequence[str] = REPAIR_RULES) -> DataFrame:
    """Map of distinct ids to census ids: (original, repaired, rule).

    An unmatched id is zero-padded left and right to every wider census width, or loses its leading
    zeros; it is changed only when exactly one census id results. Where it is known how a table lost its
    zeros, ``rules`` names that alone: candidates of the others would be ids of other units.
    """
    unknown = set(rules) - set(REPAIR_RULES)
    if unknown:
        raise ValueError(f"unknown repair rules: {', '.join(sorted(unknown))}")
    ids = geo.select(F.col(key).alias("original")).distinct().where(F.col("original").isNotNull())
    known = census.select(F.col(key).alias("candidate")).distinct()
    open_ids = ids.join(known, ids["original"] == known["candidate"], "left_anti")
    widths = known.select(F.length("candidate").alias("w")).distinct().agg(F.collect_set("w").alias("v"))
    o = F.col("original")
    wide = open_ids.withColumn("_w", F.explode(widths.scalar())).where(F.col("_w") > F.length(o))
    zeros = F.repeat(F.lit("0"), F.col("_w") - F.length(o))
    padded = wide.select(
        "original",
        F.explode(F.array(
            F.struct(F.lit("left").alias("rule"), F.concat(zeros, o).alias("candidate")),
            F.struct(F.lit("right").alias("rule"), F.concat(o, zeros).alias("candidate")),
        )).alias("c"),
    ).select("original", "c.rule", "c.candidate")
    bare = F.regexp_replace(o, "^0+", "")
    stripped = open_ids.select("original", F.lit("strip").alias("rule"), bare.alias("candidate")).where(
        (F.col("candidate") != "") & (F.col("candidate") != o)
    )
    tried = padded.unionByName(stripped).where(F.col("rule").isin(list(rules)))
    hits = tried.join(known, "candidate", "left_semi")
    unique = hits.groupBy("original").agg(
        F.count_distinct("candidate").alias("_n"), F.min("candidate").alias("repaired"), F.min("rule").alias("rule")
    )
    good = unique.where(F.col("_n") == 1).drop("_n")
    return ids.join(good, "original", "left").select(
        "original", F.coalesce("repaired", "original").alias("repaired"), "rule"
    )


def apply_repairs(df: DataFrame, repairs: DataFrame, key: str = "geo_id") -> DataFrame:
    """Rewrite the repaired ids and leave all others."""
    m = repairs.where(F.col("original") != F.col("repaired")).select(F.col("original").alias(key), "repaired")
    return df.join(broadcast_if_small(m), key, "left").withColumn(key, F.coalesce("repaired", key)).drop("repaired")


def repair_hierarchical(
    geo: DataFrame, census: DataFrame, key: str = "geo_id", width: int = 22, max_zero_suffix: int = 2, broad: bool = False
) -> DataFrame:
    """Repair of fixed-width hierarchical ids: exact, right pad, then ever longer zero tails.

    The first census hit in that order wins and names the method.
    """
    ids = geo.select(F.trim(F.col(key)).alias("geo_id_original")).distinct().where(F.col("geo_id_original") != "")
    known = census.select(F.trim(F.col(key)).alias("candidate")).distinct()
    o = F.col("geo_id_original")
    padded = F.substring(F.rpad(o, width, "0"), 1, width)
    last = width - 1 if broad else max_zero_suffix
    step = lambda p, method, suffix, c: F.struct(
        F.lit(p).alias("p"), F.lit(method).alias("method"), F.lit(suffix).alias("suffix"), c.alias("candidate")
    )
    tails = [
        step(k + 1, f"zero_suffix_{k}", k, F.concat(F.substring(padded, 1, width - k), F.lit("0" * k)))
        for k in range(1, last + 1)
    ]
    tried = ids.select("geo_id_original", F.explode(F.array(step(0, "exact", 0, o), step(1, "right_pad", 0, padded), *tails)).alias("c"))
    hits = tried.select("geo_id_original", "c.*").join(known, "candidate", "left_semi")
    best = hits.groupBy("geo_id_original").agg(F.min_by(F.struct("candidate", "method", "suffix"), "p").alias("b"))
    out = ids.join(best, "geo_id_original", "left")
    return out.select(
        "geo_id_original",
        F.col("b.candidate").alias("geo_id_repaired"),
        F.coalesce(F.col("b.method"), F.lit("unmatched")).alias("repair_method"),
        F.col("b.suffix").alias("zero_suffix_n"),
        F.col("b").isNotNull().alias("matched_repaired"),
        (o != F.col("b.candidate")).alias("changed_id"),
        F.coalesce(F.col("b.suffix") > max_zero_suffix, F.lit(False)).alias("broad_repair"),
    )


def repair_by_suffix(geo: DataFrame, census: DataFrame, key: str = "geo_id") -> DataFrame:
    """Pad to the commonest census width, else the only census id that ends in the given text.

    Suffixes are compared by an equi join: each census id is cut to every length in use.
    """
    ids = geo.select(F.col(key).alias("original")).distinct().where(F.col("original").isNotNull())
    known = census.select(F.col(key).alias("id")).distinct().where(F.col("id").isNotNull())
    widths = known.groupBy(F.length("id").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    modal = widths.agg(F.min_by("w", F.struct(-F.col("n"), F.col("w"))).alias("v")).scalar()
    o = F.col("original")
    exact = ids.join(known.withColumn("_e", F.lit(1)), o == F.col("id"), "left").drop("id")
    sized = exact.withColumn("_m", modal)
    padded = F.when(F.length(o) < F.col("_m"), F.concat(F.repeat(F.lit("0"), F.col("_m") - F.length(o)), o)).otherwise(o)
    with_pad = sized.withColumn("_pad", padded).join(known.withColumn("_p", F.lit(1)), F.col("_pad") == F.col("id"), "left").drop("id")
    todo = with_pad.where(F.col("_e").isNull() & F.col("_p").isNull()).select("original")
    lengths = todo.select(F.length("original").alias("l")).distinct().agg(F.collect_set("l").alias("v"))
    ends = known.withColumn("_l", F.explode(lengths.scalar())).where(F.length("id") >= F.col("_l"))
    ends = ends.select("id", F.substring(F.col("id"), F.length("id") - F.col("_l") + 1, F.col("_l")).alias("original"))
    single = todo.join(ends, "original").groupBy("original").agg(F.count_distinct("id").alias("_n"), F.min("id").alias("_suffix"))
    single = single.where(F.col("_n") == 1).drop("_n")
    out = with_pad.join(single, "original", "left")
    method = (
        F.when(F.col("_e").isNotNull(), "exact").when(F.col("_p").isNotNull(), "left_pad")
        .when(F.col("_suffix").isNotNull(), "unique_suffix").otherwise("unmatched")
    )
    fixed = F.when(F.col("_e").isNotNull(), o).when(F.col("_p").isNotNull(), F.col("_pad")).otherwise(F.coalesce("_suffix", o))
    return out.select("original", fixed.alias("repaired"), method.alias("method"))


def longest_key_match(files: DataFrame, keys: DataFrame, file_col: str, key_col: str) -> DataFrame:
    """Longest key contained in each file key; ties go to the smaller key.

    Every file key is cut into its substrings of the key lengths in use, which turns the containment
    test into an equi join. File keys are spread first and their substrings held nowhere: those that are
    no key leave at once, and what occurs twice in a file key does not change its longest.
    """
    k = keys.select(F.col(key_col).alias("_k")).where(F.col("_k") != "").distinct()
    k = broadcast_if_small(k)
    lengths = k.select(F.length("_k").alias("l")).distinct().agg(F.collect_set("l").alias("v"))
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    f = files.select(file_col).repartition(n, file_col).distinct()
    f = f.withColumn("_l", F.explode(lengths.scalar())).where(F.length(file_col) >= F.col("_l"))
    starts = F.sequence(F.lit(1), F.length(file_col) - F.col("_l") + 1)
    f = f.withColumn("_at", F.explode(starts))
    cut = f.select(file_col, F.substring(F.col(file_col), F.col("_at"), F.col("_l")).alias("_k"))
    hits = cut.join(k, "_k").groupBy(file_col).agg(
        F.min_by("_k", F.struct(-F.length("_k"), F.col("_k"))).alias(key_col)
    )
    return files.join(broadcast_if_small(hits), file_col, "left")


def prefix_fallback(units: DataFrame, scored: DataFrame, key: str, value: str, lengths: list[int]) -> DataFrame:
    """Integer score by exact key, else the rounded median of the same prefix, longest prefix first.

    Adds the key that decided. Scores are few distinct values (quintiles), so the frequency form of
    the median stays small however many rows share a prefix.
    """
    exact = scored.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).cast("int").alias("_exact"))
    out = units.join(broadcast_if_small(exact), key, "left")
    picks = [("_exact", F.col(key))]
    for n in sorted(lengths, reverse=True):
        rows = scored.where(F.col(value).isNotNull() & (F.length(key) >= n))
        counts = rows.groupBy(F.substring(key, 1, n).alias(f"_p{n}"), value).agg(F.count(F.lit(1)).alias("_f"))
        med = counts.groupBy(f"_p{n}").agg(F.bround(F.expr(f"percentile({value}, 0.5, _f)")).cast("int").alias(f"_m{n}"))
        out = out.withColumn(f"_p{n}", F.substring(key, 1, n)).join(broadcast_if_small(med), f"_p{n}", "left")
        picks.append((f"_m{n}", F.col(f"_p{n}")))
    used = F.coalesce(*[F.when(F.col(c).isNotNull(), k) for c, k in picks])
    out = out.withColumn(value, F.coalesce(*[c for c, _ in picks])).withColumn("key_used", used)
    return out.drop("_exact", *[f"_p{n}" for n in lengths], *[f"_m{n}" for n in lengths])


def unmapped_population(scored: DataFrame, mapped: DataFrame, key: str, pop: str, lengths: list[int]) -> DataFrame:
    """Total population and the part none of whose keys was used by :func:`prefix_fallback`."""
    used = mapped.where(F.col("key_used").isNotNull()).select(F.col("key_used").alias("_k")).distinct()
    tried = scored.select(key, pop, F.explode(F.array_distinct(
        F.array(F.col(key), *[F.substring(key, 1, n) for n in lengths]))).alias("_k"))
    seen = tried.join(broadcast_if_small(used), "_k", "left_semi").select(key).distinct().withColumn("_hit", F.lit(1))
    flagged = scored.join(seen, key, "left")
    return flagged.agg(
        F.sum(pop).alias("pop_total"),
        F.coalesce(F.sum(F.when(F.col("_hit").isNull(), F.col(pop))), F.lit(0.0)).alias("pop_unmapped"),
    )


#: Letters of a station label, what fills a short single word, and the label of a name without letters.
LABEL, FILL, NAMELESS = 3, "X", "STA"


def acronyms(df: DataFrame, name: str, out: str = "acronym") -> DataFrame:
    """Station labels of three letters, dealt over the first words as evenly as they go, earlier words first.

    Word i of m gives the next ceil((3 - i) / m) letters. Labels that occur more than once end in a number along the
    name instead of their last letter.
    """
    words = F.regexp_extract_all(normalize_station(name), F.lit("[A-Z]+"), F.lit(0))
    used = F.slice(words, 1, LABEL)
    given = lambda w, i: F.substring(w, F.lit(1), F.ceil((F.lit(LABEL) - i) / F.size(used)).cast("int"))
    dealt = F.array_join(F.transform(used, given), "")
    base = F.when(F.size(used) == 0, F.lit(NAMELESS)).when(F.size(used) == 1, F.rpad(dealt, LABEL, FILL)).otherwise(dealt)
    marked = df.withColumn("_base", base).withColumn("_one", F.lit(1).cast("long"))
    ranked = running_sum(marked, ["_base"], [name], "_one", "_i", "_n")
    label = F.when(F.col("_n") > 1, F.concat(F.substring("_base", 1, LABEL - 1), F.col("_i").cast("string"))).otherwise(F.col("_base"))
    return ranked.withColumn(out, label).drop("_base", "_one", "_i", "_n")
