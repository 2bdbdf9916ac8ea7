"""Every engine query with SQL against that SQL, on the smallest tables."""

import duckdb
import pytest

from sparkloom.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, other, name):
    mine, theirs = QUERIES[name](spark, DIR).toPandas(), other.sql(SQL[name]).df()
    columns = sorted(theirs.columns)
    assert sorted(mine.columns) == columns and len(mine) == len(theirs)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (mine, theirs))
    for c in columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


@pytest.mark.parametrize("name", ["snippets", "hash_embeddings", "harmonic_intents", "intent_scan", "shard_rerank", "bloom_coverage", "compression_gain"])
def test_has_rows(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0
