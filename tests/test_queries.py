"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from cladeflow.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([round(r[i], 6) + 0.0 if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equal(spark, duck, name):
    found = registry.QUERIES[name](spark, SF)
    result = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(found.columns)
    assert normal(found.columns, map(tuple, found.collect())) == normal(columns, result.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
