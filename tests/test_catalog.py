import duckdb
import pytest

import __spark_entry__ as entry
from tamis.plans import catalog, index_catalog

#: Queries that build an index and have counterparts in test_engine.py.
INDEXED = ("index_", "merge_preserves", "merge_then", "block_index", "file_index", "streaming")


def values(rows):
    return sorted(tuple("" if x is None else f"{x}" for x in r) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", [n for n in catalog.ORACLES if not n.startswith(INDEXED)] + ["index_field_token", "merge_preserves_rows", "file_index_counts", "streaming_ingest"])
def test_query_agrees_with_sql(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert values(got.select(*columns).collect()) == values(want)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "event_id" and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(index_catalog.STATS) == {"all", "hit", "miss", "region", "regex"} and set(catalog.QUERIES) == set(catalog.ORACLES)
