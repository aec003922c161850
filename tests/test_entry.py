"""The engine's registered queries against DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from treelight import queries

SF = "/root/testdata/sf0.001"
NAMES = sorted(queries.QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders events documents pages".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    rows = con.sql(f"select {quoted} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(repr, rows))


def test_entry(spark):
    assert entry.entry(spark).count() >= 0


def test_filters_reach_the_scan(spark):
    """Stored folded names: what a search asks of names and drives stands in the scan's filters."""
    for name, filters in (("substr_ascii", ["StringContains(name_fold,widget)"]), ("wildcard_suffix", ["StringEndsWith(name_fold,.txt)"]), ("wildcard_prefix", ["StringStartsWith(name_fold,doc_00001)"]), ("drive_filter", ["StringEndsWith(name_fold,.p)", "PartitionFilters"])):
        query = entry.queries()[name](spark, SF)._jdf.queryExecution()
        plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(query, "formatted")
        assert all(f in plan for f in filters), (name, plan)
        assert "Exchange" not in plan
