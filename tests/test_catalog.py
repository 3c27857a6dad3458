import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracles import compare, duck, rows_of
from signalgraph.catalog import QUERIES, forget

FOLDER = "/root/testdata/sf0.001"
MAY_BE_EMPTY = {"focus_incident", "incident_subgraph"}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_entry(spark):
    df = entry(spark)
    assert df.columns[:3] == ["tick_no", "tick", "service"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))  # with the training-data queries, where they are there
def test_query_equals_its_sql(spark, con, name):
    rows, differs = compare(spark, con, FOLDER, name)
    assert differs == ""


WITHOUT_SQL = sorted(set(QUERIES) - set(oracle_sql()))


@pytest.fixture(scope="module")
def twice(spark):
    """Rows of the queries without SQL, from two replays that share nothing."""

    def rows(name):
        df = queries()[name](spark, FOLDER)
        assert df.columns and len(set(df.columns)) == len(df.columns)
        return rows_of(df.columns, [tuple(r) for r in df.collect()])

    passes = []
    for _ in range(2):
        forget()
        passes.append({name: rows(name) for name in WITHOUT_SQL})
    return passes


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_query_repeats_itself(twice, name):
    first, second = (p[name] for p in twice)
    assert first[1] or name in MAY_BE_EMPTY
    assert first == second
