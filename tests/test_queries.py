"""Every registered query over statistical files gives the rows that its SQL gives from the tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from statloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    say = lambda v: "null" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(say(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(entry.oracle_sql()[name])
    assert got == canonical([c[0] for c in found.description], found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
