"""Every query with SQL gives the SQL's rows."""

import duckdb
import pytest

import __spark_entry__ as entry_point

ORACLES = {k: v for k, v in entry_point.oracle_sql().items() if k.startswith("q_")}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in "conversations documents embeddings events labels pages".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows(frame, columns):
    return sorted((tuple(None if v != v else v for v in r) for r in frame[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, sf_dir, name):
    ours, theirs = entry_point.queries()[name](spark, sf_dir).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(ours) == sorted(theirs)
    assert rows(ours, sorted(ours)) == rows(theirs, sorted(ours))


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["role", "n", "mean_score", "mean_confidence", "n_perfect"] and df.count() > 0
