"""Queries of the training-data problems: against SQL, on odd rows and on empty tables."""

import pytest
from oracle import differences

from quillspan.llm import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, tiny, name):
    assert not differences(QUERIES[name](spark, tiny), tiny, SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, hostile, name):
    df = QUERIES[name](spark, hostile)
    if name in SQL:
        assert not differences(df, hostile, SQL[name])
    else:
        df.collect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


def test_found_columns(spark, tiny):
    want = {
        "p3_found": [("group_event_id", "bigint"), ("event_id", "bigint")],
        "p4_found": [("nba_player_id", "string"), ("athlete_id", "string")],
        "p5_found": [("nba_player_id", "string"), ("draft_year", "int"), ("field", "string"), ("anthro_row_id", "bigint")],
        "p6_found": [("name_id_a", "bigint"), ("name_id_b", "bigint")],
        "p9_found": [("doc_id", "bigint"), ("item_id", "bigint")],
        "p10_found": [("doc_id", "bigint")],
    }
    for name, columns in want.items():
        df = QUERIES[name](spark, tiny)
        assert df.dtypes == columns, name
        assert df.count() == df.distinct().count() > 0, name
