"""Every query against its SQL in DuckDB."""

import duckdb
import pytest

from quillspark.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def normal(row):
    return tuple(f"{float(x):.5f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name in ORACLES:
        want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in df.columns)} FROM ({ORACLES[name]})").fetchall()
        assert sorted(map(normal, rows)) == sorted(map(normal, want))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["id", "parent", "score"]
    assert set(e.oracle_sql()) <= set(e.queries())
