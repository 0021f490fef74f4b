"""Station names, column-safe keys and geographic identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accented Latin letters and their plain forms, position by position.
ACCENTED = "ÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖØÚÙÛÜÝÇÑŸ"
PLAIN = "AAAAAAEEEEIIIIOOOOOOUUUUYCNY"
LIGATURES = (("Æ", "AE"), ("Œ", "OE"), ("ß", "SS"), ("ẞ", "SS"))
WHITESPACE = " \t\r\n"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_accents(c: str | Column) -> Column:
    """Upper-case Latin letters without accents; ligatures are spelled out."""
    text = F.translate(_col(c), ACCENTED, PLAIN)
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), LIGATURES, text)


def normalize_station(c: str | Column) -> Column:
    """Display key of a station: trimmed, upper case, no accents, no double quotes."""
    return F.replace(strip_accents(F.upper(F.btrim(_col(c).cast("string"), F.lit(WHITESPACE)))), F.lit('"'), F.lit(""))


def normalize_key(c: str | Column, drop_prefix: str | None = None) -> Column:
    """Match key: letters A-Z and digits only, optionally after removing a region prefix."""
    text = strip_accents(F.upper(_col(c).cast("string")))
    if drop_prefix:
        text = F.regexp_replace(text, "^" + drop_prefix, "")
    return F.regexp_replace(text, "[^A-Z0-9]", "")


def slug(c: str | Column) -> Column:
    """Column-safe key: runs of other characters become one underscore, none at the ends."""
    text = F.regexp_replace(strip_accents(F.upper(F.trim(_col(c)))), "[^A-Z0-9]+", "_")
    return F.regexp_replace(text, "^_+|_+$", "")


# Patterns on lower-case slugs and the names they stand for.
VARIABLE_PATTERNS = [
    ("^pm2_?5$", "pm25"), ("^ozono$", "ozone"), ("^temp(_.*)?$", "temp"), ("^pres(_.*)?$", "pressure"), ("^hr$", "rh"), ("^rad(_.*)?$", "radiation"),
]


def variable_name(c: str | Column, synonyms: dict[str, str] | None = None, patterns: list[tuple[str, str]] | None = None) -> Column:
    """Lower-case slug; the first pattern that fits, else a synonym of the whole name, replaces it."""
    name = F.lower(slug(c))
    options = [recode_patterns(name, patterns)] if patterns else []
    if synonyms:
        options.append(literal_map(synonyms)[name])
    return F.coalesce(*options, name)


def literal_map(pairs: dict[str, str]) -> Column:
    """Literal map column from a small dictionary."""
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def recode_exact(c: str | Column, pairs: dict[str, str]) -> Column:
    """Value of ``pairs`` for an exact match, the column itself otherwise."""
    return F.coalesce(literal_map(pairs)[_col(c)], _col(c))


def recode_patterns(c: str | Column, rules: list[tuple[str, str]]) -> Column:
    """First matching pattern decides; no match gives NULL."""
    out = None
    for pattern, code in rules:
        hit = _col(c).rlike(pattern)
        out = F.when(hit, F.lit(code)) if out is None else out.when(hit, F.lit(code))
    return out


def split_code_name(c: str | Column) -> tuple[Column, Column]:
    """``CODE : Name`` to (code, name); the code is NULL where there is no colon."""
    text = _col(c)
    has_colon = text.contains(":")
    code = F.when(has_colon, F.nullif(F.trim(F.substring_index(text, ":", 1)), F.lit("")))
    name = F.when(has_colon, F.nullif(F.trim(F.regexp_replace(text, "^[^:]*:", "")), F.lit("")))
    return code, F.coalesce(name, F.trim(text))


def safe_text(df: DataFrame, name: str) -> Column:
    """Identifier as text without scientific notation, whatever its stored type."""
    kind = dict(df.dtypes)[name]
    if kind in ("double", "float"):
        return F.when(F.col(name).isNotNull(), F.format_string("%.0f", F.col(name).cast("double")))
    return F.trim(F.col(name).cast("string"))


def pad_left(c: Column, width: int) -> Column:
    """Zero-pad on the left; longer text is kept whole."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def pad_right(c: Column, width: int) -> Column:
    """Zero-pad on the right; longer text is kept whole."""
    return F.when(F.length(c) < width, F.rpad(c, width, "0")).otherwise(c)


def canonical_geo_id(c: Column, width: int | None = None, state: str | None = None) -> Column:
    """State prefix first, then zero-padding to ``width``."""
    text = F.concat(F.lit(state), c) if state else c
    return pad_left(text, width) if width else text


def compose_code(parts: list[tuple[str, int]]) -> Column:
    """Concatenate zero-padded code parts, e.g. department, municipality, section."""
    return F.concat(*[pad_left(F.col(n).cast("string"), w) for n, w in parts])


def ordered_list(c: str | Column, sep: str = ";") -> Column:
    """Aggregate: distinct values, sorted, joined by ``sep``."""
    return F.array_join(F.array_sort(F.collect_set(_col(c))), sep)


def repair_glyphs(c: str | Column, broken: str, whole: str) -> Column:
    """Character-by-character repair of a broken encoding."""
    return F.translate(_col(c), broken, whole)
