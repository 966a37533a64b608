"""Registered queries about the life of an index: ingest, files and filters, statistics, merging, failure. With SQL for DuckDB.

Each builds an index of a whole table and returns what can be seen of the operator in question.
"""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.bloom import sound
from tamis.operators.engine import BatchRejected, Config, Engine, EngineStopped, InvalidConfigError
from tamis.operators.search import partition_blocks, search
from tamis.plans.catalog import register, sql_has, sql_tokens, table
from tamis.plans.prefilter import to_sql
from tamis.plans.query import FieldRegex, FieldToken, MinMax, Partition, Query, Token, all_of, any_of, between, eq, gte, lt, ne, query
from tamis.plans.regex import InvalidRegexError, java_pattern
from tamis.sources.memory import MemoryStore
from tamis.sources.scratch import scratch
from tamis.sources.store import HadoopStore

NATION = "n_nationkey int, n_name string, n_regionkey int"
NATION_JSON = """'{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}'"""
NATION_TOKENS = " UNION ALL ".join(f"SELECT n_regionkey AS r, '{c}' AS path, unnest({sql_tokens(f'CAST({c} AS VARCHAR)')}) AS token FROM nation" for c in ("n_nationkey", "n_name", "n_regionkey"))


def by_region(config: Config | None = None) -> Config:
    return replace(config or Config(), partition=lambda df: F.col("n_regionkey"), minmax=("n_nationkey",))


def nations(spark: SparkSession, sf_dir: str, batches: int = 1, config: Config | None = None, store=None) -> Engine:
    """An index of nation in blocks by region, in so many batches by nation key."""
    engine = Engine(spark, store or scratch(spark), by_region(config))
    df = table(spark, sf_dir, "nation")
    for k in range(batches):
        engine.ingest(df.where(F.pmod("n_nationkey", F.lit(batches)) == k))
    return engine


def row_dicts(df: DataFrame) -> list[dict]:
    """Rows for the interface that takes dicts, from a table whose size doesn't depend on the scale."""
    return [r.asDict() for r in df.orderBy(df.columns[0]).collect()]


# ---- ingest, flushing, lifecycle ----


def _row_flushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, rows = Engine(spark, scratch(spark), Config(max_buffered_rows=10, max_buffered_seconds=1e6)), row_dicts(table(spark, sf_dir, "nation"))
    for k in range(0, len(rows), 5):
        engine.ingest_rows(rows[k : k + 5])
    engine.flush()
    return engine.files().groupBy("rows").agg(F.count("*").alias("files"))


register("ingest_rows_flushes", _row_flushes, "SELECT rows, count(*) AS files FROM (SELECT count(*) AS rows FROM (SELECT CAST(floor((row_number() OVER (ORDER BY n_nationkey) - 1) / 10) AS BIGINT) AS b FROM nation) GROUP BY b) GROUP BY rows")


def _byte_flushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Each row is 11 bytes of JSON and 4 more, so the fourth one fills 60 bytes.
    engine = Engine(spark, scratch(spark), Config(max_buffered_bytes=60, max_buffered_seconds=1e6))
    for r in row_dicts(table(spark, sf_dir, "nation")):
        engine.ingest_rows([{"k": f"{r['n_nationkey']:03d}"}])
    engine.stop()
    return engine.files().groupBy("rows").agg(F.count("*").alias("files"))


register("ingest_bytes_flushes", _byte_flushes, "SELECT rows, count(*) AS files FROM (SELECT count(*) AS rows FROM (SELECT CAST(floor((row_number() OVER (ORDER BY n_nationkey) - 1) / 4) AS BIGINT) AS b FROM nation) GROUP BY b) GROUP BY rows")


def _rows_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, scratch(spark), Config(max_buffered_seconds=1e6))
    engine.ingest_rows(row_dicts(table(spark, sf_dir, "nation")))
    before = engine.query().rows.count()
    engine.flush()
    return engine.query().typed(NATION).withColumn("stored_before_flush", F.lit(before))


register("ingest_rows_flush", _rows_ingested, "SELECT *, CAST(0 AS INT) AS stored_before_flush FROM nation")


def _rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, refused = Engine(spark, scratch(spark)), False
    texts = table(spark, sf_dir, "nation").select(F.to_json(F.struct("*")).alias("j"))
    try:
        engine.ingest_json(texts.unionByName(spark.createDataFrame([("[1]",)], "j string")), "j")
    except BatchRejected:
        refused = True
    stored = engine.query().rows.count()
    engine.ingest_json(texts, "j")
    return spark.createDataFrame([(refused, stored, engine.query().rows.count())], "refused boolean, stored_of_bad long, stored_of_good long")


register("ingest_batch_atomic", _rejected, "SELECT true AS refused, CAST(0 AS BIGINT) AS stored_of_bad, count(*) AS stored_of_good FROM nation")


def _block_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, scratch(spark), Config(partition=lambda df: F.col("o_orderpriority"), max_block_rows=100))
    engine.ingest(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"))
    return engine.blocks().groupBy("partition_id").agg(F.sum("rows").alias("rows"), (F.max("rows") <= 100).alias("within"), (F.count("*") >= F.ceil(F.sum("rows") / 100)).alias("enough"))


register("block_row_limit", _block_limit, "SELECT o_orderpriority AS partition_id, count(*) AS rows, true AS within, true AS enough FROM orders GROUP BY o_orderpriority")


def _lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, told = Engine(spark, scratch(spark), Config(max_buffered_seconds=1e6)), []
    engine.ingest_rows(row_dicts(table(spark, sf_dir, "region")), told.append)
    engine.stop(600.0)
    try:
        engine.ingest_rows([{"late": 1}])
        refused = False
    except EngineStopped:
        refused = True
    return spark.createDataFrame([(engine.query().rows.count(), told == [None], refused)], "rows long, told boolean, refused boolean")


register("engine_lifecycle", _lifecycle, "SELECT count(*) AS rows, true AS told, true AS refused FROM region")


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = [("max_block_rows", 0), ("max_block_bytes", 0), ("max_file_bytes", -1), ("max_merged_files", 1), ("max_buffered_rows", 0), ("max_buffered_bytes", 0), ("max_buffered_seconds", 0), ("ingest_buffer_size", 0), ("max_query_concurrency", 0), ("false_positives", 1.0), ("compression", "gzip"), ("compression", ""), ("max_merged_files", 2), ("false_positives", 0.5)]
    out = []
    for name, value in cases:
        try:
            Config(**{name: value})
            out.append((name, str(value), False))
        except InvalidConfigError:
            out.append((name, str(value), True))
    return spark.createDataFrame(out, "setting string, value string, refused boolean")


register("config_refused", _settings, """SELECT * FROM (VALUES ('max_block_rows', '0', true), ('max_block_bytes', '0', true), ('max_file_bytes', '-1', true), ('max_merged_files', '1', true), ('max_buffered_rows', '0', true),
('max_buffered_bytes', '0', true), ('max_buffered_seconds', '0', true), ('ingest_buffer_size', '0', true), ('max_query_concurrency', '0', true), ('false_positives', '1.0', true), ('compression', 'gzip', true),
('compression', '', false), ('max_merged_files', '2', false), ('false_positives', '0.5', false)) AS t(setting, value, refused)""")  # fmt: skip

# ---- files, filters, stores ----


def _codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = []
    for codec in ("none", "snappy", "zstd"):
        engine = Engine(spark, scratch(spark), Config(compression=codec))
        engine.ingest(table(spark, sf_dir, "customer"))
        rows = engine.query(query().field_token("c_mktsegment", "building").build()).typed("c_custkey long, c_nationkey int")
        found.append(rows.withColumn("codec", F.lit(engine.blocks().select("compression").distinct().first()[0])))
    return found[0].unionByName(found[1]).unionByName(found[2])


register("block_compression", _codecs, f"SELECT c_custkey, c_nationkey, codec FROM customer, (SELECT unnest(['none', 'snappy', 'zstd']) AS codec) WHERE {sql_has('c_mktsegment', 'building')}")


def _row_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = nations(spark, sf_dir, batches=2)
    files = spark.read.parquet(*[engine.store.path("rows", s) for s in engine.store.state().segments])
    return files.groupBy("partition_id").agg(F.count("*").alias("rows"), F.sum(F.octet_length("row_json") + 4).alias("bytes"), F.countDistinct("_metadata.file_path").alias("files"))


register("row_files", _row_files, f"SELECT CAST(n_regionkey AS VARCHAR) AS partition_id, count(*) AS rows, CAST(sum(strlen({NATION_JSON}) + 4) AS BIGINT) AS bytes, count(DISTINCT n_nationkey % 2) AS files FROM nation GROUP BY n_regionkey")


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = nations(spark, sf_dir).blocks()
    flipped = F.col("tokens").withField("words", F.transform("tokens.words", lambda w: w.bitwiseXOR(F.lit(1).cast("long"))))
    return blocks.select("partition_id", *[sound(F.col(f)).alias(f) for f in ("fields", "tokens", "pairs")], sound(flipped).alias("flipped"))


register("filter_checksums", _checks, "SELECT DISTINCT CAST(n_regionkey AS VARCHAR) AS partition_id, true AS fields, true AS tokens, true AS pairs, false AS flipped FROM nation")


def _filter_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, out = nations(spark, sf_dir), None
    for r in engine.blocks().select("file", "partition_id", "block").collect():  # a block a region
        one = engine.block_filters(r.file, r.partition_id, r.block).select(F.lit(r.partition_id).alias("partition_id"), *[F.col(f"{f}.{c}").alias(f"{f}_{c}") for f in ("fields", "tokens", "pairs") for c in ("n", "size", "hashes")])
        out = one if out is None else out.unionByName(one)
    return out


_SIZES = ", ".join(f"{f}_n, CAST(ceil(-{f}_n * ln(0.001) / ln(2) ^ 2) AS BIGINT) AS {f}_size, CAST(ceil(ceil(-{f}_n * ln(0.001) / ln(2) ^ 2) / {f}_n * ln(2)) AS INT) AS {f}_hashes" for f in ("fields", "tokens", "pairs"))
register("block_filter_sizes", _filter_sizes, f"SELECT CAST(r AS VARCHAR) AS partition_id, {_SIZES} FROM (SELECT r, count(DISTINCT path) AS fields_n, count(DISTINCT token) AS tokens_n, count(DISTINCT (path, token)) AS pairs_n FROM ({NATION_TOKENS}) GROUP BY r)")
register(
    "file_entry_unions",
    lambda spark, sf_dir: nations(spark, sf_dir).files().select("rows", "blocks", F.col("fields.n").alias("fields"), F.col("tokens.n").alias("tokens"), F.col("pairs.n").alias("pairs")),
    f"SELECT (SELECT count(*) FROM nation) AS rows, count(DISTINCT r) AS blocks, count(DISTINCT path) AS fields, count(DISTINCT token) AS tokens, count(DISTINCT (path, token)) AS pairs FROM ({NATION_TOKENS})",
)


def _in_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = nations(spark, sf_dir, batches=2, store=MemoryStore(spark, scratch(spark)))
    return engine.query(query().field_token("n_regionkey", "3").build()).typed(NATION)


register("store_in_memory", _in_memory, "SELECT * FROM nation WHERE n_regionkey = 3")


class _Named(HadoopStore):
    """A store of one's own, whose segments have names."""

    def new_segment(self) -> str:
        self.made = getattr(self, "made", 0) + 1
        return f"own{self.made}"


def _own_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = nations(spark, sf_dir, batches=3, store=_Named(spark, scratch(spark)))
    return engine.files().groupBy(F.substring_index("file", "/", 1).alias("segment")).agg(F.sum("rows").alias("rows"))


register("store_of_ones_own", _own_store, "SELECT 'own' || (n_nationkey % 3 + 1) AS segment, count(*) AS rows FROM nation GROUP BY n_nationkey % 3")


def _cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = nations(spark, sf_dir, batches=2, config=Config(cache_metadata=True))
    found = [engine.query(query().field_token("n_nationkey", str(k)).build()).rows.count() for k in (3, 4, 99)]
    return spark.createDataFrame([(k, n) for k, n in zip((3, 4, 99), found)], "key int, rows long")


register("metadata_cache", _cached, "SELECT key, count(n_nationkey) AS rows FROM (SELECT unnest([3, 4, 99]) AS key) LEFT JOIN nation ON n_nationkey = key GROUP BY key")

# ---- results ----


def _cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    with nations(spark, sf_dir, batches=2).query(query().match_prefilter(Partition(ne("0"))).build()) as results:
        rows = list(results)
    return spark.createDataFrame([(r["n_nationkey"], r["n_name"], r["n_regionkey"], len(list(results))) for r in rows], f"{NATION}, after_close int")


register("result_cursor", _cursor, "SELECT *, CAST(0 AS INT) AS after_close FROM nation WHERE n_regionkey <> 0")

STATS = {"all": Query(), "hit": query().field_token("n_nationkey", "7").build(), "miss": query().token("nonexistent").build(), "region": query().match_prefilter(Partition(eq("1"))).build(), "regex": query().field_regex("n_name", "_1[0-4]$").build()}


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, rows = nations(spark, sf_dir, batches=2), []
    for name, asked in STATS.items():
        s = engine.query(asked).stats(matched=True)
        rows.append((name, s.blocks_processed, s.blocks_skipped, s.rows_scanned, s.bytes_scanned, s.rows_matched))
    return spark.createDataFrame(rows, "query string, blocks_processed long, blocks_skipped long, rows_scanned long, bytes_scanned long, rows_matched long")


register("query_stats", _stats, f"""WITH b AS (SELECT n_nationkey % 2 AS f, n_regionkey AS r, count(*) AS rows, CAST(sum(strlen({NATION_JSON}) + 4) AS BIGINT) AS bytes,
  bool_or(n_nationkey = 7) AS hit, CAST(count(*) FILTER (regexp_matches(n_name, '_1[0-4]$')) AS BIGINT) AS regex FROM nation GROUP BY ALL),
q AS (SELECT 'all' AS query, *, true AS kept, rows AS matched FROM b UNION ALL SELECT 'hit', *, hit, CAST(hit AS BIGINT) FROM b WHERE f IN (SELECT f FROM b WHERE hit)
  UNION ALL SELECT 'region', *, true, rows FROM b WHERE r = 1 UNION ALL SELECT 'regex', *, true, regex FROM b)
SELECT query, count(*) FILTER (kept) AS blocks_processed, count(*) FILTER (NOT kept) AS blocks_skipped, CAST(sum(CASE WHEN kept THEN rows ELSE 0 END) AS BIGINT) AS rows_scanned,
  CAST(sum(CASE WHEN kept THEN bytes ELSE 0 END) AS BIGINT) AS bytes_scanned, CAST(sum(matched) AS BIGINT) AS rows_matched FROM q GROUP BY query
UNION ALL SELECT 'miss', 0, 0, 0, 0, 0""")  # fmt: skip


def _guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, scratch(spark))
    engine.ingest(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")))
    engine.ingest(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")))
    s = engine.query(query().field_regex("name", "A$").build()).stats(matched=True)
    return spark.createDataFrame([(s.blocks_processed, s.blocks_skipped, s.rows_scanned, s.rows_matched)], "blocks_processed long, blocks_skipped long, rows_scanned long, rows_matched long")


register("regex_guard", _guarded, "SELECT CAST(1 AS BIGINT) AS blocks_processed, CAST(0 AS BIGINT) AS blocks_skipped, count(*) AS rows_scanned, count(*) FILTER (regexp_matches(r_name, 'A$')) AS rows_matched FROM region")

PATTERNS = {"a(b": True, "(?=x)": True, r"\1": True, "a{2,1}": True, "[z-a]": True, "(?i)x|y+": False, r"\pL+\b": False, "[[:alpha:]]{2,3}": False}


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for p in PATTERNS:
        try:
            java_pattern(p)
            out.append((p, False))
        except InvalidRegexError:
            out.append((p, True))
    return spark.createDataFrame(out, "pattern string, refused boolean")


register("regex_refused", _patterns, "SELECT * FROM (VALUES " + ", ".join(f"('{p}', {str(bad).lower()})" for p, bad in PATTERNS.items()) + ") AS t(pattern, refused)")

ASKED = query().match(all_of(Token("small"), any_of(FieldToken("p_brand", "brand#13"), FieldToken("p_size", "7")))).match_regex(FieldRegex("p_type", "^[A-M]")).build()
register(
    "query_json_round_trip",
    lambda spark, sf_dir: search(table(spark, sf_dir, "part"), Query.from_json(json.dumps(json.loads(ASKED.to_json())))),
    f"SELECT * FROM part WHERE ({' OR '.join(sql_has(c, 'small') for c in ('p_name', 'p_brand', 'p_type'))}) AND ({sql_has('p_brand', 'brand#13')} OR p_size = 7) AND regexp_matches(p_type, '^[A-M]')",
)

PREFILTER = any_of(all_of(Partition(gte("5")), MinMax("value", between(281, 285))), MinMax("value", lt(0)), Partition(eq("12")))


def _translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = partition_blocks(table(spark, sf_dir, "events"), F.col("user_id"), ("value",))
    return blocks.select("partition_id", "rows", F.col("ranges")["value"]["min"].alias("min_value"), F.col("ranges")["value"]["max"].alias("max_value")).where(to_sql(PREFILTER))


register("prefilter_as_sql", _translated, "SELECT * FROM (SELECT CAST(user_id AS VARCHAR) AS partition_id, count(*) AS rows, CAST(floor(min(value)) AS BIGINT) AS min_value, CAST(ceil(max(value)) AS BIGINT) AS max_value FROM events GROUP BY user_id) WHERE (partition_id >= '5' AND min_value <= 285 AND max_value >= 281) OR min_value < 0 OR partition_id = '12'")


class _Damaged(HadoopStore):
    """Region 3's field filters don't fit their checksum."""

    def table(self, kind, state, schema):
        df = super().table(kind, state, schema)
        broken = F.col("fields").withField("check", F.col("fields.check") + 1)
        return df.withColumn("fields", F.when(F.col("partition_id") == "3", broken).otherwise(F.col("fields"))) if kind == "blocks" and state.segments else df


def _damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = nations(spark, sf_dir, store=_Damaged(spark, scratch(spark))).query(query().field("n_name").build())
    return results.typed(NATION).withColumn("errors", F.lit(len(results.errors)))


register("damaged_block", _damage, "SELECT *, CAST(1 AS INT) AS errors FROM nation WHERE n_regionkey <> 3")

# ---- merging ----

MERGED = "files long, blocks long, rows long, bytes long, files_after long, blocks_after long"


def _merge_stats(batches: int, **config):
    """What one merge of so many batches of nation says, and how many files and blocks are live then."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = nations(spark, sf_dir, batches=batches, config=Config(**config))
        s = engine.merge()
        return spark.createDataFrame([(s.files, s.blocks, s.rows, s.bytes, engine.files().count(), engine.blocks().count())], MERGED)

    return run


# Five batches are one region each, so no two files have blocks of one partition.
register("merge_other_partitions", _merge_stats(5), "SELECT CAST(0 AS BIGINT) AS files, CAST(0 AS BIGINT) AS blocks, CAST(0 AS BIGINT) AS rows, CAST(0 AS BIGINT) AS bytes, CAST(5 AS BIGINT) AS files_after, count(DISTINCT (n_nationkey % 5, n_regionkey)) AS blocks_after FROM nation")
register("merge_stats", _merge_stats(4), f"SELECT count(DISTINCT n_nationkey % 4) AS files, count(DISTINCT (n_nationkey % 4, n_regionkey)) AS blocks, count(*) AS rows, CAST(sum(strlen({NATION_JSON}) + 4) AS BIGINT) AS bytes, CAST(1 AS BIGINT) AS files_after, count(DISTINCT n_regionkey) AS blocks_after FROM nation")
register("merge_row_limit", _merge_stats(4, max_block_rows=1), "SELECT CAST(0 AS BIGINT) AS files, CAST(0 AS BIGINT) AS blocks, CAST(0 AS BIGINT) AS rows, CAST(0 AS BIGINT) AS bytes, CAST(4 AS BIGINT) AS files_after, count(*) AS blocks_after FROM nation")


def _file_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = nations(spark, sf_dir, batches=4, config=Config(max_merged_files=2))
    out = []
    for k in range(4):
        s = engine.merge()
        out.append((k, s.files, engine.files().count()))
    return spark.createDataFrame(out, "round int, files long, files_after long")


register("merge_file_limit", _file_limit, "SELECT * FROM (VALUES (0, CAST(2 AS BIGINT), CAST(3 AS BIGINT)), (1, 2, 2), (2, 2, 1), (3, 0, 1)) AS t(round, files, files_after)")


def _merge_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, scratch(spark), Config(partition=lambda df: F.col("p"), minmax=("ts",)))
    engine.ingest(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("p"), F.col("r_regionkey").alias("ts")))
    for k in range(2):
        engine.ingest(table(spark, sf_dir, "nation").where(F.col("n_nationkey") % 2 == k).select(F.col("n_regionkey").alias("p"), F.col("n_name").alias("name")))
    engine.merge()
    return engine.blocks().select("partition_id", "rows", F.map_contains_key("ranges", "ts").alias("has_ts"))


register("merge_keys", _merge_keys, "SELECT CAST(r_regionkey AS VARCHAR) AS partition_id, count(*) AS rows, true AS has_ts FROM region GROUP BY r_regionkey UNION ALL SELECT CAST(n_regionkey AS VARCHAR), count(*), false FROM nation GROUP BY n_regionkey")


def _merge_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Region 2 is in both batches; the blocks of the others have no partner and are copied.
    engine = Engine(spark, scratch(spark), by_region())
    df = table(spark, sf_dir, "nation")
    first = (F.col("n_regionkey") < 2) | (F.col("n_regionkey") == 2) & (F.col("n_nationkey") % 2 == 0)
    engine.ingest(df.where(first))
    engine.ingest(df.where(~first))
    stats = engine.merge()
    return engine.blocks().select("partition_id", "rows", F.lit(stats.blocks).alias("merged"), F.col("ranges")["n_nationkey"]["min"].alias("low"), F.col("ranges")["n_nationkey"]["max"].alias("high"))


register("merge_copies_blocks", _merge_copies, "SELECT CAST(n_regionkey AS VARCHAR) AS partition_id, count(*) AS rows, (SELECT CAST(count(DISTINCT (n_regionkey, n_regionkey = 2 AND n_nationkey % 2 = 0)) AS INT) FROM nation) AS merged, CAST(min(n_nationkey) AS BIGINT) AS low, CAST(max(n_nationkey) AS BIGINT) AS high FROM nation GROUP BY n_regionkey")


class _Refusing(HadoopStore):
    """A store that takes no merges."""

    def commit(self, add=(), remove=frozenset(), batch=None, emptied=()):
        if remove:
            raise OSError("no merges here")
        return super().commit(add, remove, batch, emptied)


def _failed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, failed = nations(spark, sf_dir, batches=2, store=_Refusing(spark, scratch(spark))), False
    try:
        engine.merge()
    except OSError:
        failed = True
    return spark.createDataFrame([(failed, engine.query().rows.count(), engine.files().count())], "failed boolean, rows long, files long")


register("merge_failure", _failed_merge, "SELECT true AS failed, count(*) AS rows, count(DISTINCT n_nationkey % 2) AS files FROM nation")


def _open_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = nations(spark, sf_dir, batches=2)
    results = engine.query(query().match_prefilter(Partition(ne("4"))).build())
    results.rows.count()
    engine.merge()
    engine.ingest(table(spark, sf_dir, "nation"))
    return results.typed(NATION)


register("results_outlive_merge", _open_results, "SELECT * FROM nation WHERE n_regionkey <> 4")


def _vacuumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = nations(spark, sf_dir, batches=2)
    engine.merge()
    kept, gone = engine.vacuum(3600.0), engine.vacuum(0.0)
    return engine.query().typed(NATION).select("*", F.lit(len(kept)).alias("kept"), F.lit(sum("/rows/" in g for g in gone)).alias("gone"))


register("vacuum", _vacuumed, "SELECT *, CAST(0 AS INT) AS kept, CAST(2 AS INT) AS gone FROM nation")


def _once(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, df = Engine(spark, scratch(spark)), table(spark, sf_dir, "nation")
    for batch in ("load", "load", ("stream", 4), ("stream", 4), ("stream", 3), ("stream", 5)):
        engine.ingest(df, batch)
    return engine.query().typed(NATION).groupBy("n_nationkey").agg(F.count("*").alias("times"))


register("batches_stored_once", _once, "SELECT n_nationkey, CAST(3 AS BIGINT) AS times FROM nation")
