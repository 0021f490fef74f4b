"""Readers for Parquet panels, CSV tables and station text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.functions.keys import recode_patterns, split_code_name, strip_accents
from airgrid.functions.numbers import mask_values, parse_number
from airgrid.functions.times import add_hours, clamp_hour, date_plus_hour, parse_compact, parse_first
from airgrid.session import broadcast_if_small, require_columns

# Text that stands for a missing cell.
NULL_TOKENS = ("", " ", "NA", "999")
NBSP = " "


def read_panel(spark: SparkSession, root: str, years: list[int] | None = None, columns: list[str] | None = None,
               leaf: str | None = None) -> DataFrame:
    """Year-partitioned Parquet panel; the year filter prunes folders and the column list the scan.

    ``leaf`` reads one partition folder and keeps ``year`` through the base path.
    """
    reader = spark.read.option("basePath", root) if leaf else spark.read
    df = reader.parquet(leaf or root)
    if years:
        df = df.where(F.col("year").isin(list(years)))
    return df.select(*columns) if columns else df


def read_text_csv(spark: SparkSession, path: str, sep: str = ",", nulls=NULL_TOKENS, upper: bool = True,
                  encoding: str = "UTF-8") -> DataFrame:
    """CSV with every column as trimmed text, null tokens masked, headers trimmed and upper-cased."""
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=False, encoding=encoding,
                        ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    names = [c.strip().upper() if upper else c.strip() for c in df.columns]
    df = df.toDF(*names)
    return df.select(*[F.when(~F.col(f"`{c}`").isin(list(nulls)), F.col(f"`{c}`")).alias(c) for c in names])


def read_numeric_csv(spark: SparkSession, path: str, columns: list[str], sep: str = ";", sentinels=(-99, -66, 99, 999)) -> DataFrame:
    """Chosen columns as numbers with sentinel codes masked."""
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=False)
    require_columns(df, columns, path)
    codes = [float(s) for s in sentinels]
    return df.select(*[mask_values(F.col(c).try_cast("double"), codes).alias(c) for c in columns])


def clean_cell(c: Column) -> Column:
    """Hard spaces to spaces, trimmed; empty and dash-only text becomes NULL."""
    text = F.trim(F.replace(c, F.lit(NBSP), F.lit(" ")))
    return F.when((text != "") & ~text.rlike(r"^[-\s]+$"), text)


def clean_text_columns(df: DataFrame) -> DataFrame:
    """Apply :func:`clean_cell` to every text column."""
    return df.select(*[clean_cell(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])


def _path_part(level: int) -> Column:
    part = F.element_at(F.split(F.col("_metadata.file_path"), "/"), level)
    return F.url_decode(F.replace(part, F.lit("+"), F.lit("%2B")))


def read_lines(spark: SparkSession, path: str, encoding: str = "ISO-8859-1", level: int = -1) -> DataFrame:
    """Lines of many files with their name; large files split over tasks.

    ``level`` is the path part that names a file: -1 is the file name, -2 its folder.
    """
    raw = spark.read.csv(path, sep="\u0001", quote="", encoding=encoding, schema="line string",
                         ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return raw.select("line", _path_part(level).alias("file"))


def read_files(spark: SparkSession, path: str, encoding: str = "ISO-8859-1", level: int = -1) -> DataFrame:
    """One row per file with its numbered lines as an array, for formats whose line order matters.

    Meant for station files, which hold at most some years of hours.
    """
    raw = spark.read.format("binaryFile").load(path)
    text = F.decode(F.col("content"), encoding)
    return raw.select(_path_part(level).alias("file"), F.split(text, "\r?\n").alias("lines"))


def placed_lines(spark: SparkSession, path: str, level: int = -1) -> DataFrame:
    """Lines of text files with ``file``, ``block`` (where the line's part of the file begins, in bytes) and ``at``, which grows along a part.

    Files are cut into parts like any text, so that a large one is read by many tasks.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), _path_part(level).alias("file"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    return lines.withColumn("at", F.monotonically_increasing_id())


def _after_preamble(spark: SparkSession, path: str, skip: int, schema: str, sep: str, level: int) -> DataFrame:
    lines = placed_lines(spark, path, level)
    # One row for each file. Only its first part can hold the preamble, which must not be longer than a part.
    begins = broadcast_if_small(lines.where(F.col("block") == 0).groupBy("path").agg(F.min("at").alias("first")))
    rows = lines.join(begins, "path").where((F.col("block") > 0) | (F.col("at") > F.col("first") + skip)).where(F.trim("line") != "")
    parsed = F.from_csv("line", f"{schema}, _lost string", {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_lost"})
    return rows.select("file", "line", parsed.alias("r"))


def read_after_preamble(spark: SparkSession, path: str, skip: int, schema: str, sep: str = ",") -> DataFrame:
    """CSV rows after ``skip`` preamble lines and one header line of each file.

    Large files are read in parts; lines that do not fit the schema are left to :func:`preamble_rejects`.
    """
    rows = _after_preamble(spark, path, skip, schema, sep, -1)
    return rows.where(F.col("r._lost").isNull()).select("r.*").drop("_lost")


REJECTS = ["file", "line", "cell", "reason"]


def preamble_rejects(spark: SparkSession, path: str, skip: int, schema: str, sep: str = ",", level: int = -1) -> DataFrame:
    """Lines that :func:`read_after_preamble` gives no row for: (file, line, cell, reason); ``line`` is the text, ``cell`` NULL."""
    rows = _after_preamble(spark, path, skip, schema, sep, level)
    return rows.where(F.col("r._lost").isNotNull()).select("file", "line", F.lit(None).cast("string").alias("cell"), F.lit("does not fit the schema").alias("reason"))


def _first_line(lines: Column, pattern: str) -> Column:
    """Position, from 1, of the first line that matches; 0 without one."""
    return F.array_position(F.transform(lines, lambda x: x.rlike(pattern)), True)


def _marked(spark: SparkSession, path: str, level: int) -> DataFrame:
    """Marker files with their lines and the first and last line of the data (``_s``, ``_e``), NULL without a mark."""
    f = read_files(spark, path, level=level)
    lines = F.col("lines")
    hash_at, eoh_at, eof_at = (_first_line(lines, p) for p in ("^#DATA", "^EOH", "^EOF"))
    start = F.when(hash_at > 0, hash_at).when(eoh_at > 0, eoh_at)
    return f.withColumns({"_s": start, "_e": F.when(eof_at > 0, eof_at).otherwise(F.size(lines) + 1)})


def _marked_rows(files: DataFrame) -> DataFrame:
    """Lines between the marks with cells, time and value, readable or not."""
    rows = files.where(F.col("_s").isNotNull()).select("file", "_s", "_e", F.posexplode("lines").alias("i", "line"))
    rows = rows.where((F.col("i") >= F.col("_s")) & (F.col("i") < F.col("_e") - 1) & (F.trim("line") != ""))
    rows = rows.withColumn("_c", F.transform(F.split("line", ","), lambda x: clean_cell(x)))
    values = F.filter(F.slice(F.col("_c"), 3, F.greatest(F.size("_c"), F.lit(1))), lambda x: x.isNotNull())
    return rows.select(
        "file", "line", F.size("_c").alias("_n"), parse_compact(F.get("_c", F.lit(0)), F.get("_c", F.lit(1))).alias("datetime"),
        F.get(values, F.lit(0)).alias("cell"), F.get(values, F.lit(0)).try_cast("double").alias("value"),
    )


def read_marker_files(spark: SparkSession, path: str, level: int = -1) -> DataFrame:
    """Files whose data lie between a ``#DATA`` or ``EOH`` line and an ``EOF`` line.

    Columns are day, clock and several versions of the value, of which the first present one counts.
    Gives (file, datetime, value); what gives no row is in :func:`marker_rejects`.
    """
    rows = _marked_rows(_marked(spark, path, level)).where(F.col("_n") >= 3)
    return rows.where(F.col("datetime").isNotNull() & F.col("value").isNotNull()).select("file", "datetime", "value")


def marker_rejects(spark: SparkSession, path: str, level: int = -1) -> DataFrame:
    """Files and lines that :func:`read_marker_files` gives no row for: (file, line, cell, reason), ``line`` the text.

    Rows and rejected lines together are all lines between the marks that are not empty.
    """
    files = _marked(spark, path, level)
    none = F.lit(None).cast("string")
    lost = files.where(F.col("_s").isNull()).select("file", none.alias("line"), none.alias("cell"), F.lit("no data mark").alias("reason"))
    reason = (
        F.when(F.col("_n") < 3, "no cells").when(F.col("datetime").isNull(), "unreadable time")
        .when(F.col("cell").isNull(), "no value").when(F.col("value").isNull(), "unreadable value")
    )
    rows = _marked_rows(files).withColumn("reason", reason).where(F.col("reason").isNotNull())
    return lost.unionByName(rows.select(*REJECTS))


#: Keys of report headers, without accents, and the first two cells of the line above the parameter names.
REPORT_CODE, REPORT_NAME, REPORT_HEAD = "CODIGO DA ESTACAO", "NOME DA ESTACAO", ("DATA", "HORA")


def _report_files(spark: SparkSession, path: str, level: int) -> DataFrame:
    """Report files with their header fields, the line of ``Data;Hora`` (``_h``), its delimiter and the parameter names.

    A header line is a key and a value parted by the first colon, semicolon or tab; keys are compared without accents.
    """
    f = read_files(spark, path, level=level)
    plain = lambda c: strip_accents(F.upper(F.trim(c)))
    pair = lambda x: F.split(x, "[:;\t]", 2)
    fields = F.transform(F.filter("lines", lambda x: x.rlike("[:;\t]")), lambda x: F.struct(plain(pair(x)[0]).alias("key"), F.trim(F.translate(pair(x)[1], ":;\t", "   ")).alias("value")))
    of = lambda key: F.get(F.filter("_fields", lambda x: x["key"] == key), F.lit(0))["value"]
    cells = lambda x: F.slice(F.transform(F.split(x, "[;\t]"), plain), 1, 2)
    f = f.withColumn("_fields", fields).withColumns({"station_code": of(REPORT_CODE), "station_name": of(REPORT_NAME)}).drop("_fields")
    f = f.withColumn("_h", F.array_position(F.transform("lines", lambda x: F.array_join(cells(x), ";")), ";".join(REPORT_HEAD)))
    head = F.get("lines", (F.col("_h") - 1).cast("int"))
    f = f.withColumn("_d", F.when(head.contains(";"), ";").otherwise("\t"))
    whole = F.col("station_code").isNotNull() & F.col("station_name").isNotNull() & (F.col("_h") > 0)
    return f.withColumn("_p", F.split(F.get("lines", F.col("_h").cast("int")), F.col("_d"))).withColumn("_whole", whole)


def _report_lines(files: DataFrame) -> DataFrame:
    rows = files.where("_whole").select("file", "station_name", "station_code", "_d", "_p", "_h", F.posexplode("lines").alias("i", "line"))
    rows = rows.where((F.col("i") > F.col("_h")) & (F.trim("line") != ""))
    return rows.withColumn("_c", F.split("line", F.col("_d"))).withColumn("line", F.col("i") + 1)


def _report_cells(lines: DataFrame, params: list[tuple[str, str]]) -> DataFrame:
    """Every cell behind day and clock, parsed or not."""
    long = lines.select(
        "file", "station_name", "station_code", "_p", "line",
        F.get("_c", F.lit(0)).alias("day"), F.get("_c", F.lit(1)).alias("clock"), F.posexplode("_c").alias("j", "cell"),
    ).where(F.col("j") >= 2)
    name = F.trim(F.get("_p", F.col("j")))
    hour = F.regexp_replace("clock", ":.*$", "").try_cast("int")
    return long.select(
        "file", "station_name", "station_code",
        date_plus_hour(parse_first("day", ["dd/MM/yyyy"]), hour).alias("datetime"),
        recode_patterns(F.when(name != "", F.upper(name)), params).alias("param"),
        parse_number("cell", ",").alias("value"),
        "line", F.col("j").alias("cell"),
    )


def read_station_reports(spark: SparkSession, path: str, params: list[tuple[str, str]], level: int = -1) -> DataFrame:
    """Report files with station name and code in header lines and parameter names under ``Data;Hora``.

    ``params`` are (pattern, code) rules tried in order on the upper-case parameter names. Gives (file,
    station_name, station_code, datetime, param, value); what gives no row is in :func:`station_report_rejects`.
    """
    cells = _report_cells(_report_lines(_report_files(spark, path, level)), params)
    return cells.drop("line", "cell").dropna(subset=["datetime", "param", "value"])


def station_report_rejects(spark: SparkSession, path: str, params: list[tuple[str, str]], level: int = -1) -> DataFrame:
    """Files, lines and cells that :func:`read_station_reports` gives no row for: (file, line, cell, reason).

    ``line`` counts from 1 and ``cell`` from 0; they are NULL where a whole file or line is meant. Rows and
    rejected cells together are all cells of all readable lines.
    """
    files = _report_files(spark, path, level)
    none = F.lit(None).cast("int")
    lost_files = files.where("not _whole").select(
        "file", none.alias("line"), none.alias("cell"),
        F.when(F.col("_h") > 0, F.lit("no station name or code")).otherwise(F.lit("no data block")).alias("reason"),
    )
    lines = _report_lines(files)
    lost_lines = lines.where(F.size("_c") < 3).select("file", "line", none.alias("cell"), F.lit("no cells").alias("reason"))
    reason = (
        F.when(F.col("param").isNull(), F.lit("unknown parameter"))
        .when(F.col("datetime").isNull(), F.lit("unreadable time"))
        .when(F.col("value").isNull(), F.lit("missing or unreadable value"))
    )
    cells = _report_cells(lines, params).select("file", "line", "cell", reason.alias("reason")).where(F.col("reason").isNotNull())
    return lost_files.union(lost_lines).union(cells)


QUOTED_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _wide_cells(spark: SparkSession, path: str, level: int) -> DataFrame:
    """Every station cell of wide files (file, line, head, cell, day, clock, param), with no header NULL in all but file and line."""
    bare = lambda c: F.trim(F.replace(F.replace(c, F.lit('"'), F.lit("")), F.lit(NBSP), F.lit(" ")))
    rows = read_lines(spark, path, level=level).withColumn("_c", F.transform(F.split("line", QUOTED_COMMA), bare))
    is_head = F.array_contains(F.col("_c"), "Fecha") & F.array_contains(F.col("_c"), "Hora")
    # One header line per file; the join is by file name.
    heads = broadcast_if_small(rows.where(is_head).groupBy("file").agg(F.min("_c").alias("_h")))
    data = rows.where(~is_head).join(heads, "file", "left")
    at = lambda name: F.get("_c", (F.array_position("_h", name) - 1).cast("int"))
    param_at = F.filter("_h", lambda x: x.rlike("(?i)^par.metro$"))
    from_column = F.get("_c", (F.array_position("_h", F.get(param_at, F.lit(0))) - 1).cast("int"))
    from_name = F.coalesce(F.get(F.split("file", "__"), F.lit(3)), F.lit("unknown"))
    stations = F.filter(F.transform("_h", lambda h, j: F.struct(h.alias("head"), j.alias("j"))), lambda x: x["head"].contains(":"))
    long = data.select(
        "file", "line", at("Fecha").alias("day"), at("Hora").alias("clock"), F.when(F.size(param_at) > 0, from_column).otherwise(from_name).alias("param"),
        F.col("_h").isNotNull().alias("_known"), F.size("_h").alias("_width"), F.explode_outer(stations).alias("_s"), "_c",
    )
    stamp = add_hours(parse_first("day", ["yyyy-MM-dd", "dd/MM/yyyy"]), clamp_hour(F.substring(F.trim("clock"), 1, 2)))
    text = clean_cell(F.get("_c", F.col("_s.j")))
    return long.select("file", "line", "_known", F.col("_s.head").alias("head"), F.col("_s.head").alias("cell"), text.alias("_text"), stamp.alias("datetime"), "param", parse_number(text).alias("value"))


def read_wide_stations(spark: SparkSession, path: str, codes: list[str] | None = None, level: int = -1) -> DataFrame:
    """Hourly CSV files with Fecha, Hora and one column per station named ``CODE : Name``.

    Files may list different stations: each file's header meets its lines by file name, so large files are read in
    parts. The parameter comes from a column of its own or from the fourth ``__`` part of the file name. The hour is
    clamped to 0..23. Missing readings stay as NULL rows; what gives no row is in :func:`wide_station_rejects`.
    """
    cells = _wide_cells(spark, path, level).where(F.col("head").isNotNull() & F.col("datetime").isNotNull())
    code, name = split_code_name("head")
    out = cells.select("file", "datetime", name.alias("station"), code.alias("station_code"), "param", "value")
    return out.where(F.col("station_code").isin(list(codes))) if codes else out


def wide_station_rejects(spark: SparkSession, path: str, level: int = -1) -> DataFrame:
    """Lines and cells that :func:`read_wide_stations` gives no row for, or no value though there is text: (file, line, cell, reason).

    ``line`` is the text, ``cell`` the station's heading; for a file without header or station ``cell`` is NULL.
    """
    reason = (
        F.when(~F.col("_known"), "no header").when(F.col("head").isNull(), "no station").when(F.col("datetime").isNull(), "unreadable time")
        .when(F.col("_text").isNotNull() & F.col("value").isNull(), "unreadable value")
    )
    cells = _wide_cells(spark, path, level).withColumn("reason", reason).where(F.col("reason").isNotNull())
    return cells.select(*REJECTS)


def read_many(spark: SparkSession, root: str, pattern: str, **options) -> DataFrame:
    """All Parquet files below ``root`` whose name matches, schemas merged by name."""
    return spark.read.options(pathGlobFilter=pattern, recursiveFileLookup=True, mergeSchema=True, **options).parquet(root)


def file_part(c: str | Column, sep: str, position: int) -> Column:
    """Part of a file name without its extension, counted from 0."""
    col = F.col(c) if isinstance(c, str) else c
    return F.get(F.split(F.regexp_replace(col, r"\.[A-Za-z0-9]+$", ""), sep), F.lit(position))


def file_date(c: str | Column) -> Column:
    """Date from eight digits in a file name."""
    col = F.col(c) if isinstance(c, str) else c
    return F.to_date(F.nullif(F.regexp_extract(col, r"(\d{8})", 1), F.lit("")), "yyyyMMdd")


def artifact_path(root: str, kind: str, name: str, buffer_km: float, year: int | None = None, suffix: str = "") -> str:
    """Folder of a result set, e.g. ``exposure_bogota_3km_2023``."""
    tail = f"_{year}" if year else ""
    return f"{root.rstrip('/')}/{kind}_{name}_{buffer_km:g}km{tail}{suffix}"


def read_artifact(spark: SparkSession, root: str, kind: str, name: str, buffer_km: float, year: int | None = None,
                  suffix: str = "") -> DataFrame:
    """Read a result set; an absent folder is Spark's own error."""
    return spark.read.parquet(artifact_path(root, kind, name, buffer_km, year, suffix))
