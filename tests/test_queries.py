"""Every query outside the text pipeline runs at the smallest scale and equals its SQL."""

import math

import duckdb
import pytest
from loamline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(rows):
    clean = lambda v: "-" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(clean(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sql, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*cols).collect()]
    if name in registry.ORACLES:
        want = sql.sql(registry.ORACLES[name])
        assert sorted(want.columns) == cols
        assert _plain(rows) == _plain(want.select(", ".join(cols)).fetchall())
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
