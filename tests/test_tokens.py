import duckdb
import pytest

from tamis.operators import tokens
from tamis.plans import catalog

TEXTS = [(1, "the cat The"), (2, "the dog"), (2, "the\tdog  CAT"), (2, None), (3, ""), (3, "   "), (4, None), (None, "cat owl"), (None, "the owl owl"), (5, "ΑΣ İX the"), (6, "dog")]


@pytest.mark.parametrize("most", [0, 1, 10_000])
def test_token_counts_agree_with_sql(spark, tmp_path, monkeypatch, most):
    """Ids that are missing or come again, texts that are null or empty; with all, some and none of the ids told apart."""
    monkeypatch.setattr(tokens, "LISTED_IDS", most)
    spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = catalog.QUERIES["tokens"](spark, str(tmp_path)).select("token", "n", "docs")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT token, n, docs FROM ({catalog.ORACLES['tokens']})").fetchall())


def test_pairs_of_token_and_document_are_not_shuffled(spark, sf):
    """Only sums by token are, where ids are distinct."""
    plan = catalog.QUERIES["tokens"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan
