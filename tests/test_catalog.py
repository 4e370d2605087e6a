"""Every registered query against its oracle on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from sievework.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    want = sorted(duck.sql(f"SELECT {quoted} FROM ({catalog.ORACLES[name]})").fetchall(), key=key)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=key) == want


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "company", "d", "quality", "risk", "group_size", "status"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
