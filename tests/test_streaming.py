import shutil

import pytest
from pyspark.sql import functions as F

from tamis.operators.engine import Config, Engine
from tamis.plans.query import query
from tamis.streaming.ingest import ingest_stream

NOW = {"availableNow": True}


def found(engine, asked=None):
    return sorted(r["id"] for r in engine.query(asked))


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/index", Config(partition=lambda df: F.col("kind"), minmax=("id",)))
    source, schema = f"{tmp_path}/in", "id long, kind string"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        ingest_stream(stream, engine, f"file://{tmp_path}/checkpoint", trigger=NOW).awaitTermination()

    for k in range(2):
        spark.createDataFrame([(2 * k, "a"), (2 * k + 1, "b")], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    assert found(engine) == [0, 1, 2, 3] and len(engine.store.state().segments) == 2
    spark.createDataFrame([(9, "b")], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    assert found(engine) == [0, 1, 2, 3, 9] and found(engine, query().field_token("kind", "b").build()) == [1, 3, 9]
    # Spark forgets that it was done: the batches come again under the same names, and nothing is stored twice.
    shutil.rmtree(f"{tmp_path}/checkpoint")
    run()
    assert found(engine) == [0, 1, 2, 3, 9]


def test_a_stream_of_json_with_a_bad_row_stops(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/index", Config())
    spark.createDataFrame([('{"id":1}',), ("oops",)], "j string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("j string").parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="Rejected|JSON|Expecting"):
        ingest_stream(stream, engine, f"file://{tmp_path}/checkpoint", json_column="j", trigger=NOW).awaitTermination()
    assert found(engine) == []
