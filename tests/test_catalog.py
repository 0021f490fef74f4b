import duckdb
import pytest

from checks import catalog
from checks.compare import check, connect

SAMPLE = ["K4_idw_exposure", "E5_equal_population_groups", "D18_census_collapse", "K1_precedence_merge", "D10_completeness", "H12_reconcile_ids",
          "K14_zonal_mean", "C22_containing_unit", "A12_partitioned_sink", "D34_difference_summary"]


def test_every_twin_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, sf_dir, name):
    result = check(spark, connect(sf_dir), sf_dir, catalog.QUERIES[name], catalog.ORACLES[name])
    assert result.startswith("ok") and "types" not in result


@pytest.fixture(scope="module")
def six_digit_ids(tmp_path_factory):
    """Tables of more than 100,000 units: 1, 101 or 1002 without its zeros is another unit's id once zeros follow it."""
    folder, con = str(tmp_path_factory.mktemp("ids")), duckdb.connect()
    near = "vec_id < 40 OR vec_id BETWEEN 1000 AND 1039 OR vec_id >= 100000"
    tables = {
        "embeddings": f"""SELECT vec_id, CAST([vec_id % 7 / 1e3, vec_id % 11 / 1e3, CASE WHEN {near} THEN vec_id % 13 / 1e3 ELSE 20 END, vec_id % 17 / 1e3] AS FLOAT[]) AS embedding,
          0 AS label FROM (SELECT range AS vec_id FROM range(100300))""",
        "nation": "SELECT CAST(range AS INTEGER) AS n_nationkey, 'N' || range AS n_name FROM range(25)",
        "events": """SELECT range AS event_id, TIMESTAMP '2024-01-01' + to_hours(CAST(range % 3 AS INTEGER)) AS ts, ['view', 'purchase'][range % 2 + 1] AS event_type,
          range % 97 / 3.0 AS value, range % 25 AS user_id FROM range(600)""",
        # Units 13 and 1001 have no census row; 100100 has.
        "orders": """SELECT range AS o_orderkey, range AS o_custkey, 'F' AS o_orderstatus, range % 89 / 1.0 AS o_totalprice, TIMESTAMP '1995-01-01' AS o_orderdate,
          '1-URGENT' AS o_orderpriority FROM range(100300) WHERE range NOT IN (13, 1001)""",
    }
    for name, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return folder, con


@pytest.mark.parametrize("name", ["K5_repaired_run", "K5_repaired_exposure"])
def test_lost_zeros_beyond_a_hundred_thousand_units(spark, six_digit_ids, name):
    folder, con = six_digit_ids
    result = check(spark, con, folder, catalog.QUERIES[name], catalog.ORACLES[name])
    assert result.startswith("ok") and "types" not in result


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
