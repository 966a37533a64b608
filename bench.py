"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
SEARCHES = (
    "field_token_events", "field_token_lineitem", "nested_field_token", "token_documents", "token_any_field", "bool_tree", "regex_and_or", "bloom_plus_regex", "field_token_number",
    "partition_eq", "minmax_between", "prefilter_or_bloom", "tokens", "leaves",
)


def run(df: DataFrame) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    folder = tempfile.mkdtemp(prefix="tamis-bench-")
    conf = {
        "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC",
        "spark.checkpoint.dir": f"file://{folder}", "spark.sql.warehouse.dir": f"{folder}/warehouse",
    }
    spark = SparkSession.builder.master(f"local[{CPUS}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    from tamis.operators.engine import Config, Engine
    from tamis.plans import catalog
    from tamis.plans.query import query

    times: dict[str, float] = {}
    counts: dict[str, float] = {}
    catalog.table(spark, SF_DIR, "region").count()
    for name in SEARCHES:
        # The second run counts: the first compiles code and fills the page cache.
        times[name] = min(run(catalog.QUERIES[name](spark, SF_DIR)) for _ in range(2))
    events = catalog.table(spark, SF_DIR, "events").drop("ts")
    n = events.count()
    config = Config(partition=lambda df: F.col("event_type"), minmax=("event_id", "value"))
    ingests = []
    for k in range(2):
        began = time.perf_counter()
        Engine(spark, f"file://{folder}/whole{k}", config).ingest(events)
        ingests.append(time.perf_counter() - began)
    times["index_ingest"] = min(ingests)
    engine = Engine(spark, f"file://{folder}/halves", config)
    for k in range(2):
        engine.ingest(events.where(F.pmod("event_id", F.lit(2)) == k))
    for name, asked in (("index_hit", query().field_token("event_type", "error")), ("index_miss", query().token("nonexistent")), ("index_regex", query().field_token("event_type", "error").field_regex("props", "1}|2}"))):
        for _ in range(2):
            began = time.perf_counter()
            results = engine.query(asked.build())
            stats = results.stats()
            run(results.rows)
            times[name] = time.perf_counter() - began
        counts |= {f"{name}_blocks_skipped": stats.blocks_skipped, f"{name}_rows_scanned": stats.rows_scanned}
    began = time.perf_counter()
    counts["merged_blocks"] = engine.merge().blocks
    times["index_merge"] = time.perf_counter() - began
    counts |= {"ingest_rows_per_sec": round(n / times["index_ingest"]), "search_rows_per_sec": round(n / times["field_token_events"])}
    counts["lineitem_search_rows_per_sec"] = round(catalog.table(spark, SF_DIR, "lineitem").count() / times["field_token_lineitem"])
    spark.stop()
    shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "keyword search, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": {k: round(v, 3) for k, v in times.items()}, "counts": counts, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
