"""Every registered query that has SQL gives what DuckDB gives, at the smallest scale."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import workload
from check_queries import table

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="test tables are not here")


# These state column roles, or filter to days without rows, as they are at the larger scale.
AT_LARGER = {
    "dashboard_layout", "target_scores", "role_suggestions", "outlier_rows_dropped",
    "change_after_zero_is_null", "daily_count_fills_gaps_with_zero", "daily_deviation_needs_two_rows",
    "daily_mean_leaves_gaps_out", "daily_sum_fills_gaps_with_zero", "hashed_neighbours_recall",
}


@pytest.fixture(scope="module")
def databases():
    duckdb = pytest.importorskip("duckdb")
    made = {}
    for folder in (SMALL, LARGER):
        made[folder] = duckdb.connect()
        for path in Path(folder).glob("*.parquet"):
            made[folder].execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return made


@pytest.mark.parametrize("name", sorted(workload.SQL))
def test_query_equals_sql(spark, databases, name):
    folder = LARGER if name in AT_LARGER else SMALL
    frame = workload.QUERIES[name](spark, folder)
    got, names = table(frame.collect(), frame.columns)
    found = databases[folder].execute(workload.SQL[name])
    columns = [d[0] for d in found.description]
    expected, expected_names = table(found.fetchall(), columns)
    assert names == expected_names
    assert got == expected


def test_entry(spark):
    import __spark_entry__ as entry

    frame = entry.entry(spark)
    assert frame.columns == ["event_type", "mean_value"] and frame.count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
