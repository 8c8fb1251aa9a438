"""Every registered query against its SQL equivalent, values unrounded."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return connection


def comparable(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return repr(value)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    result = entry.queries()[name](spark, sf)
    columns = sorted(result.columns)
    ours = sorted(tuple(comparable(r[c]) for c in columns) for r in result.collect())
    answer = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = sorted(tuple(comparable(r[i]) for i in order) for r in answer.fetchall())
    assert ours == theirs


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    rows = entry.entry(spark).limit(3).collect()
    assert rows and set(rows[0].asDict()) == {"item_id", "rank", "doc_id", "score", "matched"}
