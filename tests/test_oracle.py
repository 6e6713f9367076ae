"""Every registered query with SQL beside it, on the smallest tables, against DuckDB."""

from decimal import Decimal

import duckdb
import pytest

from cellweave.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "supplier", "customer", "events", "nation", "region")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    rows = [[float(v) if isinstance(v, Decimal) else v for v in r] for r in rows]
    return sorted(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = plain(map(tuple, df.select(*names).collect()))
    quoted = ", ".join(f'"{n}"' for n in names)
    want = plain(duck.execute(f"select {quoted} from ({plans.SQL[name]})").fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=2e-6)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
