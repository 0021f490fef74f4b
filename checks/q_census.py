"""Queries: six censuses harmonised from provider codes, one person for each order."""

from __future__ import annotations

from pyspark.sql import functions as F

from airgrid.functions import recode as rc
from airgrid.plans import harmonise as hm
from checks import tables as t
from checks.registry import query

# Provider tables over the orders, in SQL that both engines read: (column, expression). Codes are texts; some are missing or unlisted.
K, C = "o_orderkey", "o_custkey"


def text(e: str) -> str:
    return f"CAST({e} AS VARCHAR(20))"


RAW = {
    "bogota_2005_extended": {
        "REGION": f"CASE WHEN {C} % 3 = 0 THEN 'cundinamarca' ELSE 'bogota' END", "I0A_DPTO": f"CASE WHEN {C} % 3 = 0 THEN '25' ELSE '11' END", "I0B_MPIO": f"CASE WHEN {C} % 3 = 0 THEN {text(f'{K} % 7 * 100 + 1')} ELSE '1' END",
        "I0B1_LOCALIDAD": text(f"{C} % 19 + 1"), "PC09B_EDAD": f"CASE WHEN {K} % 29 > 0 THEN {text(f'{C} % 90')} ELSE 'NA' END", "FACT_EXP_CAL_P_N": text(f"{K} % 7 + 0.6"),
        "P25B_SEXO": text(f"{K} % 2 + 1"), "P44B3_NIVEL_ANOS": f"CASE WHEN {K} % 31 = 0 THEN ' ' WHEN {K} % 37 = 0 THEN '99' ELSE {text(f'{K} % 44')} END", "P47B_OCUPACION": f"CASE WHEN {K} % 11 > 0 THEN {text(f'{K} % 5')} ELSE '' END"},
    "bogota_2005_basic": {
        "I0A_DPTO": "'11'", "I0B_MPIO": f"CASE WHEN {K} % 13 = 0 THEN '' ELSE '1' END", "I0C_CLASE": text(f"{C} % 3 + 1"), "I0D_SECT_R": text(f"{C} % 2"), "I0D_SEC_R": "'3'", "I0D_CPOB": text(f"{C} % 4"), "I0D_SECT_U": text(f"{C} % 5"),
        "I0D_SEC_U": "'1'", "I0D_MZA": "''", "PC09B_EDADQ": f"CASE WHEN {K} % 29 > 0 THEN {text(f'{K} % 18 + 1')} ELSE '' END", "P25B_SEXO": text(f"{K} % 2 + 1"), "P44B1_TIP_ESTUD": f"CASE WHEN {K} % 31 = 0 THEN '99' ELSE {text(f'{K} % 15')} END"},
    "bogota_2018": {
        "COD_DANE_ANM": f"'11001' || {text(f'{C} % 40')}", "P_SEXO": f"CASE WHEN {K} % 41 > 0 THEN {text(f'{K} % 2 + 1')} ELSE '' END", "P_EDADR": f"CASE WHEN {K} % 29 > 0 THEN {text(f'{C} % 21 + 1')} ELSE '' END",
        "P_NIVEL_ANOSR": f"CASE WHEN {K} % 31 = 0 THEN '99' ELSE {text(f'{K} % 12')} END", "P_TRABAJO": f"CASE WHEN {K} % 5 = 0 THEN '' ELSE {text(f'{K} % 6')} END"},
    "cdmx_2020": {
        "ENT": "'9'", "MUN": text(f"{C} % 16 + 2"), "SEXO": f"CASE WHEN {K} % 41 > 0 THEN CASE WHEN {K} % 2 = 0 THEN '1' ELSE '3' END ELSE '' END", "PARENTESCO": text(f"{K} % 4 + 101"), "PERTE_INDIGENA": f"CASE WHEN {K} % 9 = 0 THEN '9' WHEN {K} % 9 = 1 THEN '' ELSE {text(f'{K} % 9')} END",
        "EDAD": f"CASE WHEN {K} % 29 > 0 THEN {text(f'{C} % 90')} ELSE '999' END", "CONACT": f"CASE WHEN {K} % 6 = 0 THEN '' ELSE {text(f'{C} % 25')} END", "INGTRMEN": f"CASE WHEN {K} % 5 = 0 THEN '0' WHEN {K} % 7 = 0 THEN '' ELSE {text(f'{K} * 7919 % 100003')} END", "FACTOR": text(f"{K} % 7 + 1"),
        "ESCOACUM": f"CASE WHEN {K} % 23 = 22 THEN '99' WHEN {K} % 23 = 21 THEN '' ELSE {text(f'{K} % 23')} END", "NIVACAD": f"CASE WHEN {C} % 19 = 0 THEN '' ELSE {text(f'{C} % 15')} END", "ESCOLARI": f"CASE WHEN {C} % 17 = 16 THEN '99' ELSE {text(f'{C} % 9')} END"},
    "santiago_2017": {
        "zona_id": f"'13101' || {text(f'{C} % 30 + 100')}", "escolaridad": f"{K} % 24", "p14": f"1 + {C} % 4", "p15": f"12 + {C} % 3", "p17": f"CASE WHEN {K} % 8 > 0 THEN {K} % 8 END", "p08": f"CASE WHEN {K} % 41 > 0 THEN {K} % 2 + 1 END", "p09": f"CASE WHEN {K} % 29 > 0 THEN {C} % 90 END",
        "p07": f"{K} % 5", "p16": f"CASE WHEN {K} % 9 = 0 THEN 99 WHEN {K} % 9 > 1 THEN {K} % 3 END"},
    "santiago_2024": {
        "comuna": text(f"13101 + {C} % 30"), "parentesco": text(f"{K} % 5"), "sexo": f"CASE WHEN {K} % 41 > 0 THEN {text(f'{K} % 2 + 1')} ELSE '99' END", "edad": f"CASE WHEN {K} % 29 > 0 THEN {text(f'{C} % 90')} ELSE '-66' END",
        "escolaridad": f"CASE WHEN {K} % 31 = 0 THEN '-99' ELSE {text(f'{K} % 24')} END", "sit_fuerza_trabajo": f"CASE WHEN {K} % 8 > 0 THEN {text(f'{K} % 4')} ELSE '' END", "p28_autoid_pueblo": f"CASE WHEN {K} % 9 = 0 THEN '99' ELSE {text(f'{K} % 3')} END"},
    "sao_paulo_2010": {
        "V0011": text(f"3550308005000 + {C} % 30"), "V0010": text(f"{K} % 7 + 0.25"), "V1004": f"CASE WHEN {K} % 10 = 0 THEN '21' ELSE '20' END", "V0601": f"CASE WHEN {K} % 41 > 0 THEN {text(f'{K} % 2 + 1')} ELSE '' END", "V0606": f"CASE WHEN {K} % 6 = 0 THEN '' ELSE {text(f'{K} % 6')} END",
        "V0633": f"CASE WHEN {K} % 16 = 0 THEN '' ELSE lpad({text(f'{K} % 16')}, 2, '0') END", "V0634": f"CASE WHEN {C} % 3 = 0 THEN '' ELSE {text(f'{C} % 3')} END", "V0648": f"CASE WHEN {K} % 4 = 0 THEN '' ELSE {text(f'{C} % 9')} END", "V6036": f"CASE WHEN {K} % 29 > 0 THEN {text(f'{C} % 90')} ELSE '' END",
        "V6400": text(f"{K} % 5"), "V6525": f"CASE WHEN {K} % 5 = 0 THEN '0' WHEN {K} % 7 = 0 THEN '' ELSE {text(f'{K} * 7919 % 100003')} END"},
}
ZONES = {"bogota_2005_extended": ["11001", "25001", "25101", "25201"], "bogota_2005_basic": ["11001"], "bogota_2018": ["11001"], "cdmx_2020": [f"09{k:03d}" for k in range(2, 16)], "santiago_2017": None, "santiago_2024": None, "sao_paulo_2010": None}


def provider(s, d, name):
    return t.table(s, d, "orders").select(*[F.expr(e.replace("VARCHAR(20)", "STRING")).alias(c) for c, e in RAW[name].items()])


def _provider_sql(name: str, missing: tuple[str, ...]) -> str:
    columns = ", ".join(f"{e} AS {c}" for c, e in RAW[name].items())
    lost = ", ".join(f"'{m}'" for m in missing)
    texts = ", ".join(f"CASE WHEN trim({c}) NOT IN ({lost}) THEN trim({c}) END AS {c}" if name != "santiago_2017" or c == "zona_id" else c for c in RAW[name])
    return f"WITH given AS (SELECT {columns} FROM orders), raw AS (SELECT {texts} FROM given)"


def _codes(column: str, table: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN {float(v)}" for k, v in table.items()) + " END"


BANDS = {"no_ed": "y = 0", "hs_inc": "y BETWEEN 1 AND 11", "hs_com": "y = 12", "col_inc": "y BETWEEN 13 AND 16", "col_com": "y = 17", "grad": "y >= 18"}


def _units(people: str, counted, level: str, bands=None, of_all=False, income=False) -> str:
    """Unit table over people(geo_id, w, y, adult, flags, inc, raw_inc)."""
    bands = BANDS if bands is None else bands
    n = lambda test: f"coalesce(sum(w * CAST(({test}) AS INTEGER)), 0)"
    sums = [f"{n(test)} AS count_{b}" for b, test in bands.items()] + [f"{n(c)} AS count_{c}" for c in counted]
    known = "sum(w)" if of_all else "nullif(sum(CASE WHEN y IS NOT NULL THEN w END), 0)"
    shares = [f"round({n(test)} / {known}, 6) AS share_{b}_pop" for b, test in bands.items()] + [f"round({n(c)} / sum(w), 6) AS share_{c}_pop" for c in counted]
    more = ", round(sum(inc * w) / nullif(sum(CASE WHEN inc IS NOT NULL THEN w END), 0), 6) AS income_mean, round(coalesce(sum(raw_inc * w), 0) / sum(w), 6) AS income_raw" if income else ""
    return f""", people AS ({people}) SELECT geo_id, '{level}' AS geo_level, sum(w) AS pop_total, count(*) AS n_records, coalesce(sum(CASE WHEN y IS NOT NULL THEN w END), 0) AS pop_educ_known,
  round(sum(y * w) / nullif(sum(CASE WHEN y IS NOT NULL THEN w END), 0), 6) AS education_mean, {', '.join(sums + shares)}{more} FROM people WHERE adult GROUP BY geo_id"""


def _drawn(source: str, column: str) -> str:
    """CTE ``drawn``: ``source`` with raw_inc and inc, positive values drawn to the 1st percentile of positive and the 99th of all values."""
    return f""", inc AS (SELECT *, TRY_CAST({column} AS DOUBLE) AS raw_inc FROM {source}), cap AS (SELECT (SELECT quantile_cont(raw_inc, 0.01) FROM inc WHERE raw_inc > 0) AS lo, (SELECT quantile_cont(raw_inc, 0.99) FROM inc) AS hi),
 drawn AS (SELECT inc.*, CASE WHEN raw_inc > 0 THEN least(greatest(raw_inc, lo), hi) ELSE raw_inc END AS inc FROM inc, cap)"""


def _zones(name: str) -> str:
    return "(" + ", ".join(f"'{z}'" for z in ZONES[name]) + ")"


_PAD = lambda c, n: f"lpad(coalesce({c}, '0'), {n}, '0')"
SQL = {}
SQL["bogota_2005_extended"] = _provider_sql("bogota_2005_extended", ("", "NA")) + _units(
    f"""SELECT *, TRY_CAST(PC09B_EDAD AS DOUBLE) >= 25 AS adult, CASE WHEN TRY_CAST(PC09B_EDAD AS DOUBLE) >= 25 THEN coalesce(P47B_OCUPACION IN ('1', '2'), false) END AS employed, round(TRY_CAST(FACT_EXP_CAL_P_N AS DOUBLE)) AS w,
  {_codes('TRY_CAST(P44B3_NIVEL_ANOS AS INTEGER)', rc.BOGOTA_2005_LONG)} AS y FROM (SELECT *, {_PAD('I0A_DPTO', 2)} || {_PAD('I0B_MPIO', 3)} || CASE WHEN REGION = 'bogota' THEN lpad(I0B1_LOCALIDAD, 2, '0') ELSE '' END AS geo_id FROM raw) WHERE left(geo_id, 5) IN {_zones('bogota_2005_extended')}""",
    ["employed"], "localidad", of_all=True)
_ID = " || ".join(_PAD(c, n) for c, n in hm.BLOCK_2005)
SQL["bogota_2005_basic"] = _provider_sql("bogota_2005_basic", ("", "NA")) + _units(
    f"""SELECT *, TRY_CAST(PC09B_EDADQ AS INTEGER) >= 6 AS adult, CAST(NULL AS BOOLEAN) AS employed, CAST(1 AS DOUBLE) AS w, {_codes('TRY_CAST(P44B1_TIP_ESTUD AS INTEGER)', rc.BOGOTA_2005_SHORT)} AS y
  FROM (SELECT *, CASE I0C_CLASE WHEN '2' THEN left({_ID}, 14) WHEN '3' THEN left({_ID}, 11) ELSE {_ID} END AS geo_id FROM raw) WHERE left(geo_id, 5) IN {_zones('bogota_2005_basic')}""",
    ["employed"], "manzana", {"no_ed": "y = 0", "hs_inc": "y IN (5, 9)", "hs_com": "y = 11", "col_inc": "CAST(NULL AS BOOLEAN)", "col_com": "y = 17", "grad": "y >= 18"}, True)
SQL["bogota_2018"] = _provider_sql("bogota_2018", ("", "NA")) + _units(
    f"""SELECT *, COD_DANE_ANM AS geo_id, TRY_CAST(P_EDADR AS INTEGER) >= 6 AS adult, CASE WHEN TRY_CAST(P_EDADR AS INTEGER) >= 6 THEN coalesce(P_TRABAJO IN ('1', '2'), false) END AS employed, P_SEXO = '2' AS women, CAST(1 AS DOUBLE) AS w,
  {_codes('TRY_CAST(P_NIVEL_ANOSR AS INTEGER)', rc.BOGOTA_2018)} AS y FROM raw WHERE left(COD_DANE_ANM, 5) IN {_zones('bogota_2018')}""",
    ["employed", "women"], "manzana", {**BANDS, "hs_inc": "y BETWEEN 1 AND 10", "hs_com": "y IN (11, 12)"})
SQL["cdmx_2020"] = _provider_sql("cdmx_2020", ("", "NA", "999")) + f""", z AS (SELECT *, lpad(ENT, 2, '0') || lpad(MUN, 3, '0') AS geo_id, TRY_CAST(ESCOACUM AS INTEGER) AS ac, TRY_CAST(NIVACAD AS INTEGER) AS na, TRY_CAST(ESCOLARI AS INTEGER) AS es FROM raw),
 a AS (SELECT *, CASE WHEN ac BETWEEN 0 AND 12 THEN ac END AS v FROM z WHERE geo_id IN {_zones('cdmx_2020')}), b AS (SELECT * REPLACE (CASE WHEN na = 8 AND es BETWEEN 1 AND 4 THEN 12 + es ELSE v END AS v) FROM a),
 c AS (SELECT * REPLACE (CASE WHEN ac IS NULL THEN NULL WHEN ac BETWEEN 13 AND 19 THEN ac ELSE v END AS v) FROM b),
 e AS (SELECT * REPLACE (CASE WHEN na = 12 THEN 17 WHEN na = 13 AND es = 1 THEN 18 WHEN na = 13 AND es BETWEEN 2 AND 6 THEN 19 WHEN na = 11 AND es BETWEEN 6 AND 8 THEN 17 WHEN na = 10 AND es = 6 THEN 17 WHEN na = 14 AND es BETWEEN 1 AND 3 THEN 19 + es
   WHEN na = 14 AND es >= 4 THEN 23 ELSE v END AS v) FROM c), f AS (SELECT *, CASE WHEN ac = 0 THEN 0 WHEN es = 99 OR ac = 99 THEN NULL ELSE v END AS y FROM e)""" + _drawn("f", "INGTRMEN") + _units(
    """SELECT *, TRY_CAST(FACTOR AS DOUBLE) AS w, TRY_CAST(EDAD AS INTEGER) >= 25 AS adult, coalesce(TRY_CAST(CONACT AS INTEGER) IN (10, 13, 14, 15, 16, 17, 18, 19, 20), false) AS employed, SEXO = '3' AS women,
  CASE WHEN PERTE_INDIGENA = '9' THEN NULL ELSE coalesce(PERTE_INDIGENA = '1', false) END AS indigena FROM drawn""", ["employed", "women", "indigena"], "municipio", income=True)
SQL["santiago_2017"] = _provider_sql("santiago_2017", ("", "NA")) + _units(
    """SELECT * FROM (SELECT *, zona_id AS geo_id, CAST(1 AS DOUBLE) AS w, p09 >= 25 AS adult, p17 IN (1, 3) AS employed, CASE WHEN escolaridad = 21 AND p15 = 14 AND p14 = 4 THEN 23 WHEN escolaridad = 21 AND p15 = 14 AND p14 = 3 THEN 22 WHEN escolaridad = 21 THEN 21
  WHEN escolaridad = 20 AND p15 = 13 THEN 19 WHEN escolaridad BETWEEN 0 AND 20 THEN escolaridad END AS y FROM raw) WHERE y IS NOT NULL""", ["employed"], "zona_censal")
SQL["santiago_2024"] = _provider_sql("santiago_2024", ("", "NA", "-99", "-66", "99", "999")) + _units(
    """SELECT *, comuna AS geo_id, CAST(1 AS DOUBLE) AS w, TRY_CAST(edad AS INTEGER) >= 25 AS adult, TRY_CAST(escolaridad AS DOUBLE) AS y, sit_fuerza_trabajo = '1' AS employed, sexo = '2' AS women, CASE p28_autoid_pueblo WHEN '1' THEN true WHEN '2' THEN false END AS indigena FROM raw""",
    ["employed", "women", "indigena"], "comuna")
_SP = " ".join(f"WHEN V0633 = '{a}' AND {'V0634 IS NULL' if b is None else f'V0634 = {b!r}'} THEN {float(y)}" for (a, b), y in rc.SAO_PAULO_2010.items())
SQL["sao_paulo_2010"] = _provider_sql("sao_paulo_2010", ("", "NA")) + ", twenty AS (SELECT * FROM raw WHERE V1004 = '20')" + _drawn("twenty", "V6525") + _units(
    f"""SELECT *, V0011 AS geo_id, TRY_CAST(V0010 AS DOUBLE) AS w, TRY_CAST(V6036 AS INTEGER) >= 25 AS adult, CASE WHEN V0633 = '01' THEN 0.0 {_SP} END AS y, V0601 = '2' AS women, V0606 = '1' AS white, coalesce(V0606 IN ('2', '4'), false) AS black_pardo,
  coalesce(V0648 IN ('1', '2', '3', '4', '5', '6'), false) AS employed, coalesce(V0648 IN ('1', '2', '3', '6'), false) AS formal, coalesce(V0648 IN ('4', '5'), false) AS informal FROM drawn""",
    ["employed", "formal", "informal", "women", "white", "black_pardo"], "area_ponderacao", income=True)


def _register(name: str) -> None:
    @query(f"K17_{name}", SQL[name])
    def _(s, d):
        census = hm.CENSUSES[name]
        return t.rnd(hm.collapse(hm.harmonise(provider(s, d, name), census, ZONES[name]), census))


for _name in hm.CENSUSES:
    _register(_name)


@query("J4_mexico_flags", _provider_sql("cdmx_2020", ("", "NA", "999")) + """ SELECT lpad(ENT, 2, '0') || lpad(MUN, 3, '0') AS geo_id, CAST(TRY_CAST(EDAD AS INTEGER) >= 25 AS INTEGER) AS adult, CAST(SEXO = '3' AS INTEGER) AS women, CAST(PARENTESCO = '101' AS INTEGER) AS hh_head,
 CAST(PARENTESCO = '101' AND SEXO = '3' AS INTEGER) AS hh_head_women, CASE WHEN PERTE_INDIGENA = '9' THEN NULL WHEN PERTE_INDIGENA = '1' THEN 1 ELSE 0 END AS indigena, CAST(coalesce(TRY_CAST(CONACT AS INTEGER) IN (10, 13, 14, 15, 16, 17, 18, 19, 20), false) AS INTEGER) AS employed FROM raw""")
def _(s, d):
    return hm.harmonise(provider(s, d, "cdmx_2020"), hm.MEXICO_2020).select("geo_id", "adult", "women", "hh_head", "hh_head_women", "indigena", "employed")
