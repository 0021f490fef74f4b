"""Queries: identifiers, names, numbers in text, census recodes and collapse."""

from __future__ import annotations

from pyspark.sql import functions as F

from airgrid.functions import coords, keys
from airgrid.functions import numbers as nb
from airgrid.functions import recode as rc
from airgrid.operators import identifiers as ids
from airgrid.operators import reshape
from airgrid.plans import census as cs
from checks import tables as t
from checks.registry import query

# SQL twins of the letter clean-up: every non-ASCII letter of the texts through the same fixed pairs.
PLAIN_SQL = f"replace(replace(replace(translate({{}}, '{keys.ACCENTED}', '{keys.PLAIN}'), 'Æ', 'AE'), 'Œ', 'OE'), 'ß', 'SS')"


def plain(x: str) -> str:
    return PLAIN_SQL.format(x.replace("text", "replace(text, 'ß', 'ss')"))


@query("H1_normalize_station", f"""SELECT doc_id, md5(replace({plain("upper(trim(text, ' ' || chr(9) || chr(10) || chr(13)))")}, '"', '')) AS station FROM documents""")
def _(s, d):
    return t.table(s, d, "documents").select("doc_id", F.md5(keys.normalize_station("text")).alias("station"))


@query("H2_normalize_key", f"SELECT doc_id, md5(regexp_replace({plain('upper(text)')}, '[^A-Z0-9]', '', 'g')) AS k FROM documents")
def _(s, d):
    return t.table(s, d, "documents").select("doc_id", F.md5(keys.normalize_key("text")).alias("k"))


@query("H3_slug", f"SELECT page_id, regexp_replace(regexp_replace({plain('upper(trim(url))')}, '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM pages")
def _(s, d):
    return t.table(s, d, "pages").select("page_id", keys.slug("url").alias("slug"))


@query("H4_variable_name", f"SELECT p_partkey, CASE v WHEN 'economy' THEN 'eco' WHEN 'standard' THEN 'std' ELSE v END AS v FROM (SELECT p_partkey, lower(regexp_replace(regexp_replace({plain('upper(trim(p_type))')}, '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS v FROM part)")
def _(s, d):
    return t.table(s, d, "part").select("p_partkey", keys.variable_name("p_type", {"economy": "eco", "standard": "std"}).alias("v"))


_RAW_NAMES = "CASE n_nationkey % 9 WHEN 0 THEN ' PM2.5 ' WHEN 1 THEN 'Pm-25' WHEN 2 THEN 'OZONO' WHEN 3 THEN 'Temp. (C)' WHEN 4 THEN 'Presión' WHEN 5 THEN 'HR' WHEN 6 THEN 'Rad [W/m2]' WHEN 7 THEN n_name ELSE 'temporal' END"


@query("H4_pattern_synonyms", f"""SELECT n_nationkey, CASE n_nationkey % 9 WHEN 0 THEN 'pm25' WHEN 1 THEN 'pm_25' WHEN 2 THEN 'ozone' WHEN 3 THEN 'temp' WHEN 4 THEN 'presion' WHEN 5 THEN 'rh' WHEN 6 THEN 'radiation' WHEN 7 THEN lower(n_name) ELSE 'other' END AS v
 FROM nation""")
def _(s, d):
    n = t.table(s, d, "nation").withColumn("raw", F.expr(_RAW_NAMES))
    return n.select("n_nationkey", keys.variable_name("raw", {"temporal": "other"}, keys.VARIABLE_PATTERNS).alias("v"))


@query("H5_station_synonyms", "SELECT n_nationkey, CASE WHEN regexp_matches(n_name, 'NATION_1.') THEN 'TEEN' WHEN n_name = 'NATION_3' THEN 'THREE' ELSE n_name END AS station FROM nation")
def _(s, d):
    from airgrid.plans.ingest import map_stations
    n = t.table(s, d, "nation").select("n_nationkey", F.col("n_name").alias("station"))
    return map_stations(n, {"NATION_3": "THREE"}, [("NATION_1.", "TEEN")])


@query("H6_parameter_patterns", "SELECT p_partkey, CASE WHEN regexp_matches(upper(p_name), 'RED|BLUE') THEN 'warm' WHEN regexp_matches(upper(p_name), '^SMALL') THEN 'small' END AS code FROM part")
def _(s, d):
    return t.table(s, d, "part").select("p_partkey", keys.recode_patterns(F.upper("p_name"), [("RED|BLUE", "warm"), ("^SMALL", "small")]).alias("code"))


@query("H7_code_and_name", "SELECT c_custkey, 'C' || c_nationkey AS code, c_name AS name FROM customer")
def _(s, d):
    c = t.table(s, d, "customer").withColumn("h", F.concat(F.lit("C"), F.col("c_nationkey").cast("string"), F.lit(" : "), F.col("c_name")))
    code, name = keys.split_code_name("h")
    return c.select("c_custkey", code.alias("code"), name.alias("name"))


@query("H8_numbers_in_text", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 2 THEN o_totalprice END AS v FROM orders")
def _(s, d):
    p = F.format_string("%.2f", F.col("o_totalprice"))
    comma = F.replace(p, F.lit("."), F.lit(","))
    point = F.format_number("o_totalprice", 2)
    k = F.col("o_orderkey") % 3
    v = F.when(k == 0, nb.parse_number(comma, ",")).when(k == 1, nb.parse_number(point)).otherwise(nb.parse_number(F.concat(p, F.lit(" n/a"))))
    return t.table(s, d, "orders").select("o_orderkey", v.alias("v"))


@query("H9_coordinates_in_text", t.ctes("units") + " SELECT geo_id, round(lat, 4) AS lat, round(lon, 4) AS lon, round(abs(lat) * 100, 1) AS alt FROM units")
def _(s, d):
    u = t.units(s, d)
    txt = F.format_string("%.4f N, %.4f O", "lat", F.abs("lon"))
    lat, lon = coords.text_lat_lon(txt)
    alt = coords.text_altitude(F.format_string("%.1f msnm", F.abs("lat") * 100))
    return u.select("geo_id", lat.alias("lat"), lon.alias("lon"), alt.alias("alt"))


@query("H10_shifted_utm", "SELECT o_orderkey, CAST(300000 + o_orderkey % 99999 AS DOUBLE) AS x, CAST(7000000 + o_custkey AS DOUBLE) AS y FROM orders")
def _(s, d):
    x = (F.lit(300000) + F.col("o_orderkey") % 99999).cast("string")
    y = (F.lit(7000000) + F.col("o_custkey")).cast("string")
    slipped = F.col("o_orderkey") % 2 == 1
    o = t.table(s, d, "orders").select("o_orderkey", F.when(slipped, "23k").otherwise(x).alias("a"), F.when(slipped, x).otherwise(y).alias("b"),
                                       F.when(slipped, y).otherwise("23k").alias("c"))
    ex, ny = coords.shifted_utm("a", "b", "c")
    return o.select("o_orderkey", ex.alias("x"), ny.alias("y"))


@query("H11_canonical_id", "SELECT o_orderkey, CASE WHEN length('09' || CAST(o_custkey AS VARCHAR)) < 7 THEN lpad('09' || CAST(o_custkey AS VARCHAR), 7, '0') ELSE '09' || CAST(o_custkey AS VARCHAR) END AS geo_id FROM orders")
def _(s, d):
    o = t.table(s, d, "orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("g"))
    return o.select("o_orderkey", keys.canonical_geo_id(keys.safe_text(o, "g"), 7, "09").alias("geo_id"))


@query("H15_composite_code", "SELECT l_orderkey, l_linenumber, l_partkey, lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || lpad(CAST(l_suppkey AS VARCHAR), 5, '0') || lpad(CAST(l_partkey AS VARCHAR), 7, '0') AS code FROM lineitem")
def _(s, d):
    return t.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", keys.compose_code([("l_linenumber", 2), ("l_suppkey", 5), ("l_partkey", 7)]).alias("code"))


@query("H16_acronyms", """, b AS (SELECT 1)""".replace(", b AS (SELECT 1)", "") + """WITH n AS (SELECT DISTINCT p_name FROM part), w AS (SELECT p_name, string_split(trim(regexp_replace(upper(p_name), '[^A-Z]+', ' ', 'g')), ' ') AS ws FROM n),
 b AS (SELECT p_name, CASE WHEN len(ws) >= 3 THEN ws[1][1:1] || ws[2][1:1] || ws[3][1:1] WHEN len(ws) = 2 THEN ws[1][1:2] || ws[2][1:1] ELSE left(ws[1] || 'XXX', 3) END AS base FROM w)
 SELECT p_name, CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN base[1:2] || CAST(row_number() OVER (PARTITION BY base ORDER BY p_name) AS VARCHAR) ELSE base END AS acronym FROM b""")
def _(s, d):
    return ids.acronyms(t.table(s, d, "part").select("p_name").distinct(), "p_name")


@query("H17_ordered_list", "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ';' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY 1")
def _(s, d):
    return t.table(s, d, "customer").groupBy("c_nationkey").agg(keys.ordered_list("c_mktsegment").alias("segments"))


@query("H18_glyph_repair", "SELECT doc_id, md5(translate(text, 'éèê', 'eee')) AS txt FROM documents")
def _(s, d):
    return t.table(s, d, "documents").select("doc_id", F.md5(keys.repair_glyphs("text", "éèê", "eee")).alias("txt"))


# Messy ids: customers as text against nine-digit supplier-like census ids.
IDS = """WITH census AS (SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN lpad(CAST(c_custkey AS VARCHAR), 6, '0') WHEN c_custkey % 3 = 1 THEN rpad(CAST(c_custkey AS VARCHAR), 8, '0') ELSE CAST(c_custkey AS VARCHAR) END AS geo_id FROM customer),
 geo AS (SELECT DISTINCT CASE WHEN o_custkey % 5 = 0 THEN '00' || CAST(o_custkey AS VARCHAR) ELSE CAST(o_custkey AS VARCHAR) END AS geo_id FROM orders)"""


def _id_tables(s, d):
    k = F.col("c_custkey").cast("string")
    census = t.table(s, d, "customer").select(F.when(F.col("c_custkey") % 3 == 0, keys.pad_left(k, 6)).when(F.col("c_custkey") % 3 == 1, keys.pad_right(k, 8)).otherwise(k).alias("geo_id"))
    o = F.col("o_custkey").cast("string")
    geo = t.table(s, d, "orders").select(F.when(F.col("o_custkey") % 5 == 0, F.concat(F.lit("00"), o)).otherwise(o).alias("geo_id"))
    return geo, census


REPAIRS = IDS + """, todo AS (SELECT geo_id FROM geo WHERE geo_id NOT IN (SELECT geo_id FROM census)), ws AS (SELECT DISTINCT length(geo_id) AS w FROM census),
 cand AS (SELECT t.geo_id, 'left' AS rule, repeat('0', w - length(t.geo_id)) || t.geo_id AS c FROM todo t, ws WHERE w > length(t.geo_id)
  UNION ALL SELECT t.geo_id, 'right', t.geo_id || repeat('0', w - length(t.geo_id)) FROM todo t, ws WHERE w > length(t.geo_id)
  UNION ALL SELECT geo_id, 'strip', regexp_replace(geo_id, '^0+', '') FROM todo WHERE regexp_replace(geo_id, '^0+', '') NOT IN ('', geo_id)),
 hit AS (SELECT geo_id, min(c) AS repaired, min(rule) AS rule FROM cand WHERE c IN (SELECT geo_id FROM census) GROUP BY 1 HAVING count(DISTINCT c) = 1)"""


@query("H12_reconcile_ids", REPAIRS + """
 SELECT g.geo_id AS original, coalesce(h.repaired, g.geo_id) AS repaired, h.rule FROM geo g LEFT JOIN hit h ON g.geo_id = h.geo_id""")
def _(s, d):
    return ids.reconcile_ids(*_id_tables(s, d))


@query("H12_apply_repairs", REPAIRS + """, raw AS (SELECT CASE WHEN o_custkey % 5 = 0 THEN '00' || CAST(o_custkey AS VARCHAR) ELSE CAST(o_custkey AS VARCHAR) END AS x FROM orders)
 SELECT coalesce(h.repaired, x) AS geo_id, count(*) AS n FROM raw LEFT JOIN hit h ON h.geo_id = x GROUP BY 1""")
def _(s, d):
    geo, census = _id_tables(s, d)
    fixed = ids.apply_repairs(geo, ids.reconcile_ids(geo, census))
    return fixed.groupBy("geo_id").agg(F.count(F.lit(1)).alias("n"))


@query("H13_hierarchical_repair", """WITH census AS (SELECT DISTINCT rpad(CAST(10 + c_custkey // 3 AS VARCHAR), 8, '0') AS c FROM customer),
 geo AS (SELECT DISTINCT CASE WHEN o_custkey % 2 = 0 THEN CAST(100 + o_custkey AS VARCHAR) ELSE rpad(CAST(100 + o_custkey AS VARCHAR), 6, '0') || '12' END AS g FROM orders),
 tried AS (SELECT g, 0 AS p, 'exact' AS m, 0 AS sfx, g AS cand FROM geo UNION ALL SELECT g, 1, 'right_pad', 0, left(rpad(g, 8, '0'), 8) FROM geo
  UNION ALL SELECT g, 2, 'zero_suffix_1', 1, left(rpad(g, 8, '0'), 7) || '0' FROM geo UNION ALL SELECT g, 3, 'zero_suffix_2', 2, left(rpad(g, 8, '0'), 6) || '00' FROM geo),
 best AS (SELECT g, min(p) AS p FROM tried WHERE cand IN (SELECT c FROM census) GROUP BY 1)
 SELECT geo.g AS geo_id_original, t.cand AS geo_id_repaired, coalesce(t.m, 'unmatched') AS repair_method, t.sfx AS zero_suffix_n, t.cand IS NOT NULL AS matched_repaired,
  geo.g <> t.cand AS changed_id, coalesce(t.sfx > 2, false) AS broad_repair FROM geo LEFT JOIN best ON best.g = geo.g LEFT JOIN tried t ON t.g = best.g AND t.p = best.p""")
def _(s, d):
    census = t.table(s, d, "customer").select(F.rpad(F.floor(F.col("c_custkey") / 3 + 10).cast("string"), 8, "0").alias("geo_id"))
    k = (F.col("o_custkey") + 100).cast("string")
    geo = t.table(s, d, "orders").select(F.when(F.col("o_custkey") % 2 == 0, k).otherwise(F.concat(F.rpad(k, 6, "0"), F.lit("12"))).alias("geo_id"))
    return ids.repair_hierarchical(geo, census, width=8)


@query("H14_suffix_repair", """WITH census AS (SELECT DISTINCT '9' || lpad(CAST(c_custkey AS VARCHAR), 4, '0') AS id FROM customer), geo AS (SELECT DISTINCT CASE WHEN o_custkey % 4 = 0 THEN '9' || lpad(CAST(o_custkey AS VARCHAR), 4, '0')
   WHEN o_custkey % 4 = 1 THEN lpad(CAST(o_custkey AS VARCHAR), 3, '0') ELSE right(lpad(CAST(o_custkey AS VARCHAR), 2, '0'), 2) END AS g FROM orders),
 x AS (SELECT g, g IN (SELECT id FROM census) AS e, CASE WHEN length(g) < 5 THEN lpad(g, 5, '0') ELSE g END AS pad FROM geo),
 sfx AS (SELECT x.g, min(id) AS id FROM x JOIN census ON ends_with(id, x.g) WHERE NOT e AND pad NOT IN (SELECT id FROM census) GROUP BY 1 HAVING count(*) = 1)
 SELECT x.g AS original, CASE WHEN e THEN x.g WHEN pad IN (SELECT id FROM census) THEN pad ELSE coalesce(sfx.id, x.g) END AS repaired,
  CASE WHEN e THEN 'exact' WHEN pad IN (SELECT id FROM census) THEN 'left_pad' WHEN sfx.id IS NOT NULL THEN 'unique_suffix' ELSE 'unmatched' END AS method FROM x LEFT JOIN sfx ON x.g = sfx.g""")
def _(s, d):
    census = t.table(s, d, "customer").select(F.concat(F.lit("9"), F.lpad(F.col("c_custkey").cast("string"), 4, "0")).alias("geo_id"))
    k, m = F.col("o_custkey").cast("string"), F.col("o_custkey") % 4
    # lpad to four digits cuts longer numbers in both engines.
    geo = t.table(s, d, "orders").select(F.when(m == 0, F.concat(F.lit("9"), F.lpad(k, 4, "0"))).when(m == 1, F.lpad(k, 3, "0")).otherwise(F.expr("right(lpad(cast(o_custkey as string), 2, '0'), 2)")).alias("geo_id"))
    return ids.repair_by_suffix(geo, census)


@query("C17_prefix_fallback", """WITH sc AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 5, '0') AS k, CAST(1 + o_orderkey % 5 AS INTEGER) AS q FROM orders), u AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS k FROM customer),
 ex AS (SELECT k, min(q) AS q FROM sc GROUP BY 1), p4 AS (SELECT left(k, 4) AS k, CAST(round_even(median(q), 0) AS INTEGER) AS q FROM sc GROUP BY 1), p3 AS (SELECT left(k, 3) AS k, CAST(round_even(median(q), 0) AS INTEGER) AS q FROM sc GROUP BY 1)
 SELECT u.k, coalesce(ex.q, p4.q, p3.q) AS q, CASE WHEN ex.q IS NOT NULL THEN u.k WHEN p4.q IS NOT NULL THEN left(u.k, 4) WHEN p3.q IS NOT NULL THEN left(u.k, 3) END AS key_used
 FROM u LEFT JOIN ex ON ex.k = u.k LEFT JOIN p4 ON p4.k = left(u.k, 4) LEFT JOIN p3 ON p3.k = left(u.k, 3)""")
def _(s, d):
    sc = t.table(s, d, "orders").select(F.lpad(F.col("o_custkey").cast("string"), 5, "0").alias("k"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("q"))
    u = t.table(s, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 5, "0").alias("k"))
    return ids.prefix_fallback(u, sc, "k", "q", [4, 3])


@query("C18_longest_key", """WITH f AS (SELECT DISTINCT upper(regexp_replace(url, '[^A-Za-z0-9]', '', 'g')) AS file_key FROM pages), k AS (SELECT DISTINCT upper(regexp_extract(url, '//([a-z]+)', 1)) AS station_key FROM pages UNION SELECT DISTINCT upper(left(regexp_extract(url, '//([a-z]+)', 1), 3)) FROM pages),
 h AS (SELECT file_key, station_key, row_number() OVER (PARTITION BY file_key ORDER BY length(station_key) DESC, station_key) AS r FROM f JOIN k ON contains(file_key, station_key) WHERE station_key <> '')
 SELECT f.file_key, h.station_key FROM f LEFT JOIN h ON h.file_key = f.file_key AND r = 1""")
def _(s, d):
    p = t.table(s, d, "pages")
    f = p.select(F.upper(F.regexp_replace("url", "[^A-Za-z0-9]", "")).alias("file_key")).distinct()
    host = F.regexp_extract("url", "//([a-z]+)", 1)
    k = p.select(F.upper(host).alias("station_key")).union(p.select(F.upper(F.substring(host, 1, 3))))
    return ids.longest_key_match(f, k, "file_key", "station_key")


# ---- census --------------------------------------------------------------------------------------

def people(s, d):
    p = t.people(s, d)
    return cs.education_bands(cs.indicators(p, "sex", employed="job", employed_codes=["1-URGENT", "2-HIGH"]))


BANDED = t.ctes("people") + """, b AS (SELECT *, CASE WHEN educ_years IS NOT NULL THEN CAST(educ_years BETWEEN 0 AND 0 AS INTEGER) END AS no_ed, CASE WHEN educ_years IS NOT NULL THEN CAST(educ_years BETWEEN 1 AND 11 AS INTEGER) END AS hs_inc,
 CASE WHEN educ_years IS NOT NULL THEN CAST(educ_years = 12 AS INTEGER) END AS hs_com, CASE WHEN educ_years IS NOT NULL THEN CAST(educ_years BETWEEN 13 AND 16 AS INTEGER) END AS col_inc,
 CASE WHEN educ_years IS NOT NULL THEN CAST(educ_years = 17 AS INTEGER) END AS col_com, CASE WHEN educ_years IS NOT NULL THEN CAST(educ_years >= 18 AS INTEGER) END AS grad,
 CAST(sex = 2 AS INTEGER) AS women, CAST(job IN ('1-URGENT', '2-HIGH') AS INTEGER) AS employed FROM people)"""
BAND_NAMES = list(cs.BANDS)


@query("J3_education_bands", BANDED + " SELECT row_key, no_ed, hs_inc, hs_com, col_inc, col_com, grad FROM b")
def _(s, d):
    return people(s, d).select("row_key", *BAND_NAMES)


@query("J4_indicators", BANDED + " SELECT row_key, women, employed, adult FROM b")
def _(s, d):
    return people(s, d).select("row_key", "women", "employed", "adult")


@query("J4_age_from_band", "SELECT o_orderkey, CAST((o_custkey % 20) * 5 + 2.5 AS DOUBLE) AS age FROM orders")
def _(s, d):
    return t.table(s, d, "orders").select("o_orderkey", cs.age_from_band(F.col("o_custkey") % 20 + 1).cast("double").alias("age"))


def _collapse_sql(known: bool) -> str:
    counts = ", ".join(f"coalesce(sum({b} * person_weight), 0) AS count_{b}" for b in [*BAND_NAMES, "women", "employed"])
    base = "pop_educ_known" if known else "pop_total"
    shares = ", ".join([f"round(count_{b} / nullif({base}, 0), 6) AS share_{b}_pop" for b in BAND_NAMES] + [f"round(count_{b} / nullif(pop_total, 0), 6) AS share_{b}_pop" for b in ("women", "employed")])
    return BANDED + f""", c AS (SELECT geo_id, sum(person_weight) AS pop_total, count(*) AS n_records, coalesce(sum(CASE WHEN educ_years IS NOT NULL THEN person_weight END), 0) AS pop_educ_known,
   sum(educ_years * person_weight) / nullif(sum(CASE WHEN educ_years IS NOT NULL THEN person_weight END), 0) AS em, sum(income * person_weight) / sum(person_weight) AS im, {counts} FROM b WHERE adult = 1 GROUP BY 1)
 SELECT geo_id, pop_total, n_records, pop_educ_known, round(em, 6) AS education_mean, round(im, 6) AS income_mean, {', '.join('count_' + b for b in [*BAND_NAMES, 'women', 'employed'])}, {shares} FROM c"""


@query("D18_census_collapse", _collapse_sql(True))
def _(s, d):
    return t.rnd(cs.collapse_census(people(s, d).where("adult = 1"), others=["women", "employed"], means=["income"]))


@query("D19_census_collapse_all", _collapse_sql(False))
def _(s, d):
    return t.rnd(cs.collapse_census(people(s, d).where("adult = 1"), others=["women", "employed"], means=["income"], denominator="all"))


def _map_sql(table: dict, expr: str) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {k} THEN CAST({v} AS DOUBLE)" for k, v in table.items()) + " END"


@query("J2_bogota_recodes", f"""SELECT o_orderkey, {_map_sql(rc.BOGOTA_2005_LONG, 'o_orderkey % 50')} AS long_form, {_map_sql(rc.BOGOTA_2005_SHORT, 'o_orderkey % 16')} AS short_form,
 {_map_sql(rc.BOGOTA_2018, 'o_orderkey % 13')} AS y2018 FROM orders""")
def _(s, d):
    k = F.col("o_orderkey")
    return t.table(s, d, "orders").select("o_orderkey", rc.years_from_code(k % 50, rc.BOGOTA_2005_LONG).alias("long_form"),
                                          rc.years_from_code(k % 16, rc.BOGOTA_2005_SHORT).alias("short_form"), rc.years_from_code(k % 13, rc.BOGOTA_2018).alias("y2018"))


_SP = " ".join(f"WHEN lv = '{a}' AND {'fin IS NULL' if b is None else f'fin = {chr(39)}{b}{chr(39)}'} THEN CAST({y} AS DOUBLE)" for (a, b), y in rc.SAO_PAULO_2010.items())


@query("J2_sao_paulo_recode", f"""SELECT o_orderkey, CASE WHEN lv = '01' THEN CAST(0 AS DOUBLE) {_SP} END AS years FROM (SELECT o_orderkey, lpad(CAST(o_orderkey % 16 AS VARCHAR), 2, '0') AS lv,
 CASE WHEN o_custkey % 3 > 0 THEN CAST(o_custkey % 3 AS VARCHAR) END AS fin FROM orders)""")
def _(s, d):
    lv = F.lpad((F.col("o_orderkey") % 16).cast("string"), 2, "0")
    fin = F.when(F.col("o_custkey") % 3 > 0, (F.col("o_custkey") % 3).cast("string"))
    return t.table(s, d, "orders").select("o_orderkey", rc.sao_paulo_years(lv, fin).alias("years"))


# The twin applies the published rules in their own order, each step overwriting the one before.
@query("J2_mexico_recode", """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 23 = 22 THEN 99 WHEN o_orderkey % 23 = 21 THEN NULL ELSE o_orderkey % 23 END AS ac, o_custkey % 15 AS na, CASE WHEN o_custkey % 17 = 16 THEN 99 ELSE o_custkey % 9 END AS es FROM orders),
 a AS (SELECT *, CASE WHEN ac BETWEEN 0 AND 12 THEN ac END AS v FROM r), b AS (SELECT * REPLACE (CASE WHEN na = 8 AND es BETWEEN 1 AND 4 THEN 12 + es ELSE v END AS v) FROM a),
 c AS (SELECT * REPLACE (CASE WHEN ac IS NULL THEN NULL WHEN ac BETWEEN 13 AND 19 THEN ac ELSE v END AS v) FROM b), e AS (SELECT * REPLACE (CASE WHEN na = 12 THEN 17 WHEN na = 13 AND es = 1 THEN 18 WHEN na = 13 AND es BETWEEN 2 AND 6 THEN 19
  WHEN na = 11 AND es BETWEEN 6 AND 8 THEN 17 WHEN na = 10 AND es = 6 THEN 17 WHEN na = 14 AND es BETWEEN 1 AND 3 THEN 19 + es WHEN na = 14 AND es >= 4 THEN 23 ELSE v END AS v) FROM c)
 SELECT o_orderkey, CAST(CASE WHEN ac = 0 THEN 0 WHEN es = 99 OR ac = 99 THEN NULL ELSE v END AS DOUBLE) AS years FROM e""")
def _(s, d):
    a, c = F.col("o_orderkey") % 23, F.col("o_custkey")
    o = t.table(s, d, "orders").select("o_orderkey", F.when(a == 22, 99).when(a != 21, a).alias("ac"), (c % 15).alias("na"), F.when(c % 17 == 16, 99).otherwise(c % 9).alias("es"))
    o = o.select("o_orderkey", *[F.col(x).cast("string").alias(x) for x in ("ac", "na", "es")])
    return o.select("o_orderkey", rc.mexico_years("ac", "na", "es").alias("years"))


@query("J2_santiago_recode", """SELECT o_orderkey, CAST(CASE WHEN n = 21 AND lv = 14 AND fin = 4 THEN 23 WHEN n = 21 AND lv = 14 AND fin = 3 THEN 22 WHEN n = 21 THEN 21 WHEN n = 20 AND lv = 13 THEN 19 WHEN n = 20 THEN 20 WHEN n BETWEEN 0 AND 19 THEN n END AS DOUBLE) AS years
 FROM (SELECT o_orderkey, o_orderkey % 24 AS n, 12 + o_custkey % 3 AS lv, 1 + o_custkey % 4 AS fin FROM orders)""")
def _(s, d):
    o = t.table(s, d, "orders").select("o_orderkey", *[x.cast("string").alias(n) for x, n in ((F.col("o_orderkey") % 24, "n"), (F.col("o_custkey") % 3 + 12, "lv"), (F.col("o_custkey") % 4 + 1, "fin"))])
    return o.select("o_orderkey", rc.santiago_years("n", "lv", "fin").alias("years"))


@query("B1_canonical_names", "SELECT c_custkey AS row_key, CASE WHEN length(CAST(c_nationkey AS VARCHAR)) < 5 THEN lpad(CAST(c_nationkey AS VARCHAR), 5, '0') END AS geo_id, c_acctbal AS raw_income, c_mktsegment AS raw_segment, 'zone' AS geo_level FROM customer")
def _(s, d):
    c = t.table(s, d, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("nk"), "c_acctbal", "c_mktsegment")
    m = {"c_custkey": "row_key", "nk": "geo_id", "c_acctbal": "raw_income", "c_mktsegment": "segment"}
    return reshape.canonical_names(c, m, "zone", ["raw_income", "segment"], 5)


@query("B2_column_resolver", "SELECT s_suppkey AS id, s_acctbal AS balance FROM supplier")
def _(s, d):
    sup = t.table(s, d, "supplier")
    return sup.select(F.col(reshape.resolve_column(sup, ["id", "S_SUPPKEY"])).alias("id"), F.col(reshape.resolve_column(sup, ["balance", "s_acctbal"])).alias("balance"))


@query("B3_alias_selection", "SELECT s_suppkey AS id, s_name AS name FROM supplier")
def _(s, d):
    return reshape.select_aliases(t.table(s, d, "supplier"), {"id": ["ID", "S_Suppkey"], "name": ["s_NAME"], "other": ["nope"]})


@query("B4_pattern_columns", "SELECT l_orderkey, l_linenumber, round(sum(l_discount), 6) AS l_discount, round(sum(l_tax), 6) AS l_tax FROM lineitem GROUP BY 1, 2")
def _(s, d):
    li = t.table(s, d, "lineitem")
    cols = reshape.columns_matching(li, "^l_(discount|tax|quantity)$", ["discount", "tax"])
    return t.rnd(li.groupBy("l_orderkey", "l_linenumber").agg(*[F.sum(c).alias(c) for c in cols]))


@query("C15_star_join", """SELECT l_orderkey, l_linenumber, l_partkey, n_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')""")
def _(s, d):
    li = t.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    o = t.table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = t.table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    n = t.table(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    keep = n.join(t.table(s, d, "region").where("r_name LIKE 'A%'").select(F.col("r_regionkey").alias("n_regionkey")), "n_regionkey", "left_semi")
    return cs.star_join(li, o, c, n, "l_orderkey", "o_custkey", "c_nationkey", keep).select("l_orderkey", "l_linenumber", "l_partkey", "n_name")


@query("C16_prefix_key_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE substr(c_name, 10, 7) = '0000001' OR substr(c_name, 10, 9) = '000000020'")
def _(s, d):
    j = t.table(s, d, "orders").join(t.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.where((F.substring("c_name", 10, 7) == "0000001") | (F.substring("c_name", 10, 9) == "000000020")).select("o_orderkey", "c_name")


@query("K17_harmonise_and_collapse", BANDED + """ SELECT geo_id, sum(person_weight) AS pop_total, count(*) AS n_records, round(sum(educ_years * person_weight) / nullif(sum(CASE WHEN educ_years IS NOT NULL THEN person_weight END), 0), 6) AS education_mean,
  round(sum(grad * person_weight) / nullif(sum(CASE WHEN educ_years IS NOT NULL THEN person_weight END), 0), 6) AS share_grad_pop, 'unit' AS geo_level FROM b WHERE adult = 1 GROUP BY 1""")
def _(s, d):
    raw = t.people(s, d).withColumnsRenamed({"geo_id": "ZONA", "educ_years": "ESC", "person_weight": "FE"}).drop("adult")
    spec = cs.CensusSpec({"ZONA": "geo_id", "ESC": "educ_years", "FE": "person_weight"}, "unit", sex="sex", employed="job", employed_codes=("1-URGENT", "2-HIGH"))
    micro = cs.harmonise_census(raw, spec)
    out = cs.collapse_census(micro.where("adult = 1")).withColumn("geo_level", F.lit(spec.geo_level))
    return t.rnd(out.select("geo_id", "pop_total", "n_records", "education_mean", "share_grad_pop", "geo_level"))
