"""Every core query against its SQL on the smallest tables, and on odd and empty ones."""

import pytest
from oracle import differences

from quillspan.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
DEALT = sorted(n for n in QUERIES if n[0] == "p" and n[1].isdigit())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, tiny, name):
    assert not differences(QUERIES[name](spark, tiny), tiny, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, tiny, name):
    df = QUERIES[name](spark, tiny)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)


@pytest.mark.parametrize("name", DEALT)
def test_odd_rows(spark, hostile, name):
    df = QUERIES[name](spark, hostile)
    if name in SQL:
        assert not differences(df, hostile, SQL[name])
    else:
        df.collect()


@pytest.mark.parametrize("name", DEALT)
def test_empty_tables(spark, empty, name):
    rows = QUERIES[name](spark, empty).collect()
    if name.endswith("_found"):
        assert rows == []


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_found_columns(spark, tiny):
    want = {
        "p1_found": [("kind", "string"), ("column_name", "string"), ("case_id", "bigint")],
        "p2_found": [("event_id", "bigint"), ("box_row_id", "bigint")],
        "p7_found": [("file_name", "string"), ("change", "string"), ("raw_label", "string")],
    }
    for name, columns in want.items():
        assert QUERIES[name](spark, tiny).dtypes == columns
