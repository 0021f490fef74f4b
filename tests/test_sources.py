import datetime as dt

import pytest
from pyspark.sql import functions as F

from airgrid.operators.reshape import canonical_names, split_outcome
from airgrid.plans import ingest as ig
from airgrid.sources import readers as rd
from airgrid.sources import sinks as sk


def test_canonical_names(spark):
    df = spark.createDataFrame([(9002.0, 142.7, 11.0, 8000.0, 34.0, 1.0), (15125.0, 51.0, 9.0, 5100.0, 27.0, 1.0), (3550308005001.0, 1.0, 1.0, 1.0, 1.0, 1.0)],
                               "CVE_MUN double, FACTOR double, escolaridad double, ingtrmen double, edad double, adult double")
    m = {"CVE_MUN": "geo_id", "FACTOR": "person_weight", "escolaridad": "educ_years", "ingtrmen": "income_raw"}
    out = canonical_names(df, m, "municipality", ["edad"])
    assert [r.geo_id for r in out.collect()] == ["9002", "15125", "3550308005001"]
    assert "raw_edad" in out.columns and out.first().geo_level == "municipality"
    again = canonical_names(out.drop("geo_level"), {}, "municipality", ["raw_edad"])
    assert "raw_edad" in again.columns
    with pytest.raises(ValueError):
        canonical_names(df, {"NOPE": "geo_id"}, "municipality")


def test_split_outcome():
    assert split_outcome("hrs_d_pm25_it1", ["pm2", "pm25"]) == ("hrs_d_it1", "pm25")
    assert split_outcome("avg_pm10", ["pm10"]) == ("avg", "pm10")


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode("latin-1"))


def test_marker_files(spark, tmp_path):
    put(tmp_path / "METROPOLITANA_DE_SANTIAGO__Cerro Navia I__PM10.txt", "junk\n#DATA\n230101,100,1.5,,\n230101,200,,2.5,9\n230101,300,,,\n50101,2300,,,4\nEOF\n230101,500,7,,\n")
    put(tmp_path / "Cerro__NO2.txt", "x\r\nEOH\r\n230101,0000,3.0\r\n")
    put(tmp_path / "none.txt", "nothing here\n")
    rows = {(r.file.split("__")[-1], r.datetime, r.value) for r in rd.read_marker_files(spark, str(tmp_path)).collect()}
    assert rows == {("PM10.txt", dt.datetime(2023, 1, 1, 1), 1.5), ("PM10.txt", dt.datetime(2023, 1, 1, 2), 2.5),
                    ("PM10.txt", dt.datetime(2005, 1, 1, 23), 4.0), ("NO2.txt", dt.datetime(2023, 1, 1), 3.0)}
    reg = spark.createDataFrame([("Cerro",), ("Cerro Navia",), ("Cerro Navía I",)], "station string")
    long = ig.read_santiago(spark, str(tmp_path), reg)
    assert {(r.station, r.param) for r in long.collect()} == {("Cerro Navía I", "pm10"), ("Cerro", "no2")}


def test_station_reports(spark, tmp_path):
    put(tmp_path / "a.csv", "Relatório;;\nCódigo da estação: 83;;\nNome da estação: São Caetano;;\n\nData;Hora;x;y\n;;MP10(µg/m3);UR(%)\n01/02/2023;01:00;10,5;---\n01/02/2023;24:00;11;80\n")
    put(tmp_path / "b.csv", "no header\n")
    reg = spark.createDataFrame([("SAO CAETANO",)], "station string")
    rows = {(r.station, r.station_code, r.datetime, r.param, r.value) for r in ig.read_sao_paulo(spark, str(tmp_path), reg).collect()}
    assert rows == {("SAO CAETANO", "83", dt.datetime(2023, 2, 1, 1), "pm10", 10.5), ("SAO CAETANO", "83", dt.datetime(2023, 2, 2), "pm10", 11.0),
                    ("SAO CAETANO", "83", dt.datetime(2023, 2, 2), "rh", 80.0)}


def test_station_report_rejects_and_long_headers(spark, tmp_path):
    head = "Código da estação: 83\nNome da estação: São Caetano\n" + "nota\n" * 30
    put(tmp_path / "a.csv", head + "Data;Hora;x;y\n;;MP10;???\n01/02/2023;01:00;10,5;1\n99/99/2023;02:00;3;1\n01/02/2023;03:00;---;1\nfim\n")
    put(tmp_path / "b.csv", "no header\n")
    put(tmp_path / "c.csv", "Data;Hora;x\n;;MP10\n01/02/2023;01:00;1\n")
    rows = rd.read_station_reports(spark, str(tmp_path), ig.SAO_PAULO_PARAMS).collect()
    assert [(r.file, r.param, r.value) for r in rows] == [("a.csv", "pm10", 10.5)]
    lost = {(r.file, r.line, r.cell, r.reason) for r in rd.station_report_rejects(spark, str(tmp_path), ig.SAO_PAULO_PARAMS).collect()}
    assert lost == {
        ("a.csv", 35, 3, "unknown parameter"), ("a.csv", 36, 3, "unknown parameter"), ("a.csv", 37, 3, "unknown parameter"),
        ("a.csv", 36, 2, "unreadable time"), ("a.csv", 37, 2, "missing or unreadable value"), ("a.csv", 38, None, "no cells"),
        ("b.csv", None, None, "no data block"), ("c.csv", None, None, "no station name or code"),
    }


def test_wide_station_files_with_different_headers(spark, tmp_path):
    put(tmp_path / "a__b__c__PM10__x.csv", 'Fecha,Hora,"A1 : Uno, Centro",B2 : Dos\n2023-01-01,01:00,"1,234.5",-\n02/01/2023,24,3,\xa04\n')
    put(tmp_path / "other.csv", "Fecha,Hora,Parámetro,C3 : Tres\n2023-01-01,05:30,Dióxido de nitrógeno,7\n")
    rows = {(r.station_code, r.station, r.datetime, r.param, r.value) for r in rd.read_wide_stations(spark, str(tmp_path)).collect()}
    assert rows == {("A1", "Uno, Centro", dt.datetime(2023, 1, 1, 1), "PM10", 1234.5), ("B2", "Dos", dt.datetime(2023, 1, 1, 1), "PM10", None),
                    ("A1", "Uno, Centro", dt.datetime(2023, 1, 2, 23), "PM10", 3.0), ("B2", "Dos", dt.datetime(2023, 1, 2, 23), "PM10", 4.0),
                    ("C3", "Tres", dt.datetime(2023, 1, 1, 5), "Dióxido de nitrógeno", 7.0)}
    assert {r.param for r in ig.read_mexico(spark, str(tmp_path), ["C3"]).collect()} == {"no2"}


def test_panel_sink_replaces_only_written_years(spark, tmp_path):
    root = str(tmp_path / "panel")
    df = spark.createDataFrame([("A", dt.datetime(2022, 1, 1), 1.0, 2022), ("A", dt.datetime(2023, 1, 1), 2.0, 2023)], "station string, datetime timestamp_ntz, pm10 double, year int")
    sk.write_panel(df, root, files_per_year=3)
    sk.write_panel(df.where("year = 2023").withColumn("pm10", F.lit(9.0)), root)
    assert {(r.year, r.pm10) for r in rd.read_panel(spark, root).collect()} == {(2022, 1.0), (2023, 9.0)}
    plan = rd.read_panel(spark, root, [2023], ["station", "pm10"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "datetime" not in plan.split("ReadSchema")[1]


def test_large_preamble_files_are_read_in_parts(spark, tmp_path):
    """Two files of many parts and a small one; the preamble goes from each, broken lines are rejects."""
    from airgrid.sources import readers as rd

    for name, n in (("a.csv", 20_000), ("b.csv", 12_000), ("c.csv", 3)):
        lines = ["# note, with, commas", ""] * 6 + ["# last", "day,v,n"] + [f"2024-01-{k % 28 + 1:02d},{k / 4},{k}" if k % 500 != 7 else f"broken {k}" for k in range(n)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    schema = "day date, v double, n bigint"
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32768")
    try:
        rows = rd.read_after_preamble(spark, str(tmp_path), 13, schema)
        assert rows.rdd.getNumPartitions() > 10
        got = sorted((r.n, r.v, r.day.day) for r in rows.collect())
        lost = rd.preamble_rejects(spark, str(tmp_path), 13, schema).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [k for n in (20_000, 12_000, 3) for k in range(n)]
    assert got == sorted((k, k / 4, k % 28 + 1) for k in want if k % 500 != 7)
    assert sorted((r.file, r.line) for r in lost) == sorted((f, f"broken {k}") for f, n in (("a.csv", 20_000), ("b.csv", 12_000)) for k in range(n) if k % 500 == 7)


def test_rejects_share_one_shape(spark, tmp_path):
    from airgrid.sources import readers as rd

    marked, wide = tmp_path / "m", tmp_path / "w"
    marked.mkdir()
    wide.mkdir()
    (marked / "x").write_text("h\n#DATA\n240101,0100,1.5,,\n240101,9999,2,,\n240101,0300,,,\n240101,0400,abc,,\nshort\nEOF\n240101,0500,3,,\n")
    (marked / "y").write_text("nothing\n")
    (wide / "p__q__r__PM10").write_text('Fecha,Hora,"A : a","B : b"\n2024-01-01,01:00,1,-\n2024-01-01,02:00,x,2\nnever,03:00,1,2\n')
    (wide / "none").write_text("2024-01-01,01:00,1\n")
    lost = rd.marker_rejects(spark, str(marked))
    assert lost.columns == rd.REJECTS == rd.wide_station_rejects(spark, str(wide)).columns
    assert sorted((r.file, r.line or "", r.reason) for r in lost.collect()) == [
        ("x", "240101,0300,,,", "no value"), ("x", "240101,0400,abc,,", "unreadable value"), ("x", "240101,9999,2,,", "unreadable time"), ("x", "short", "no cells"), ("y", "", "no data mark")]
    assert rd.read_marker_files(spark, str(marked)).count() == 1
    assert sorted((r.file, r.cell or "", r.reason) for r in rd.wide_station_rejects(spark, str(wide)).collect()) == [
        ("none", "", "no header"), ("p__q__r__PM10", "A : a", "unreadable time"), ("p__q__r__PM10", "A : a", "unreadable value"), ("p__q__r__PM10", "B : b", "unreadable time")]
    assert rd.read_wide_stations(spark, str(wide)).count() == 4


def test_registered_city_uses_its_hooks(spark):
    from pyspark.sql import functions as F

    from airgrid.plans import ingest as ig

    rows = spark.createDataFrame([(" alfa", "2024-03-01 01:00:00", "pm10", 4.0), ("Bêta", "2024-03-01 01:00:00", "pm10", 6.0)], "station string, datetime string, param string, value double").withColumn("datetime", F.to_timestamp_ntz("datetime"))
    ig.register_city(ig.CityConfig("here", [2024], ["pm10"], read=lambda spark, df: (df.limit(1), df), harmonise=ig.upper_stations))
    got = {(r.station, r.pm10) for r in ig.run_city(spark, "here", rows).collect()}
    assert got == {("ALFA", 4.0), ("BETA", 6.0)}
    assert {"bogota", "cdmx", "santiago", "sao_paulo"} <= set(ig.CITIES)
