"""The registered queries, each over whole tables, and the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.numeric import range_columns, rounded_column
from tamis.functions.rows import TypedRows
from tamis.functions.text import leaf_text
from tamis.operators.engine import Config, Engine
from tamis.operators.search import partition_blocks, search, search_json
from tamis.operators.tokens import token_counts
from tamis.plans.query import (
    Field, FieldRegex, FieldToken, MinMax, Node, Partition, Query, Test, Token, all_of, any_of, between, eq, gt, gte, isin, lt, lte, ne, notbetween, notin, query,
)
from tamis.sources.scratch import scratch
from tamis.streaming.ingest import ingest_stream

QueryFunction = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFunction] = {}
ORACLES: dict[str, str] = {}

#: White space of the default tokenizer in RE2, and the tokens of a text.
SPACES = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def sql_tokens(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '{SPACES}'), lambda t: t <> '')"


def sql_has(text: str, token: str) -> str:
    return f"coalesce(list_contains({sql_tokens(text)}, '{token}'), false)"


def sql_double(x: str) -> str:
    """Canonical text of a double that is whole and small, or has an ordinary fraction."""
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, run: QueryFunction, sql: str | None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


def on(name: str, source: str, asked: Query, sql: str, **options) -> None:
    """A search over one table."""
    register(name, lambda spark, sf_dir: search(table(spark, sf_dir, source), asked, **options), sql)


# ---- fields, tokens and regexes ----

on("field_token_events", "events", query().field_token("event_type", "error").build(), f"SELECT * FROM events WHERE {sql_has('event_type', 'error')}")
on("field_token_number", "lineitem", query().field_token("l_partkey", "42").build(), "SELECT * FROM lineitem WHERE l_partkey = 42")
on("field_token_lineitem", "lineitem", query().field_token("l_returnflag", "r").build(), f"SELECT * FROM lineitem WHERE {sql_has('l_returnflag', 'r')}")
on("field_token_double", "lineitem", query().field_token("l_quantity", "17").field_token("l_tax", "0.05").build(), f"SELECT * FROM lineitem WHERE {sql_double('l_quantity')} = '17' AND {sql_double('l_tax')} = '0.05'")
on("nested_field_token", "events", query().field_token("props.k", "42").build(), "SELECT * FROM events WHERE json_extract_string(props, '$.k') = '42'", json_columns=("props",))
on("field_exists", "events", query().field("props.k").build(), "SELECT * FROM events WHERE json_exists(props, '$.k')", json_columns=("props",))
on("field_container", "events", query().field("props").build(), "SELECT * FROM events")
on("field_absent", "events", query().field("props.other").build(), "SELECT * FROM events WHERE json_exists(props, '$.other')", json_columns=("props",))
on("field_of_nulls_dropped", "documents", query().field("lang").build(), "SELECT * FROM documents WHERE lang IS NOT NULL", null_fields="drop")
on("token_documents", "documents", query().token("the").build(), "SELECT * FROM documents WHERE " + " OR ".join(sql_has(c, "the") for c in ("text", "lang", "source")))
on("token_field_documents", "documents", query().field_token("text", "license.").build(), f"SELECT * FROM documents WHERE {sql_has('text', 'license.')}")
on("token_any_field", "events", query().token("error").build(), f"SELECT * FROM events WHERE {sql_has('event_type', 'error')} OR {sql_has('props', 'error')}")
on("token_never", "events", query().token("Error").build(), "SELECT * FROM events WHERE false")
on("token_parts", "part", query().match(all_of(Token("small"), any_of(FieldToken("p_brand", "brand#13"), FieldToken("p_size", "7")))).build(),
   f"SELECT * FROM part WHERE ({' OR '.join(sql_has(c, 'small') for c in ('p_name', 'p_brand', 'p_type'))}) AND ({sql_has('p_brand', 'brand#13')} OR p_size = 7)")
on("bool_tree", "events", query().match(any_of(all_of(Field("props"), FieldToken("event_type", "purchase"), Token("7")), FieldToken("event_type", "signup"))).build(),
   f"""SELECT * FROM events WHERE ({sql_has('event_type', 'purchase')} AND (event_id = 7 OR user_id = 7 OR {sql_double('value')} = '7' OR {sql_has('props', '7')})) OR {sql_has('event_type', 'signup')}""")
on("empty_and", "region", query().match(all_of()).build(), "SELECT * FROM region")
on("empty_or", "region", query().match(any_of()).build(), "SELECT * FROM region WHERE false")
on("match_all", "nation", Query(), "SELECT * FROM nation")
on("regex_and_or", "pages", query().match_regex(all_of(any_of(FieldRegex("url", "^https?://[a-z.]+/(en|de)/"), FieldRegex("url", r"\.html?$")), FieldRegex("html", "(?i)<title>"))).build(),
   r"SELECT * FROM pages WHERE (regexp_matches(url, '^https?://[a-z.]+/(en|de)/') OR regexp_matches(url, '\.html?$')) AND regexp_matches(html, '(?i)<title>')")
on("regex_documents", "documents", query().field_regex("text", r"(?i)\b[a-z0-9.]+@[a-z0-9.]+\.(com|org)\b").build(), r"SELECT * FROM documents WHERE regexp_matches(text, '(?i)\b[a-z0-9.]+@[a-z0-9.]+\.(com|org)\b')")
on("regex_number", "orders", query().field_regex("o_totalprice", r"^1\d{5}(\.\d)?$").build(), rf"SELECT * FROM orders WHERE regexp_matches({sql_double('o_totalprice')}, '^1\d{{5}}(\.\d)?$')")
on("regex_beneath", "events", query().field_regex("props", "^4.$").build(), "SELECT * FROM events WHERE regexp_matches(json_extract_string(props, '$.k'), '^4.$')", json_columns=("props",))
on("bloom_plus_regex", "events", query().field_token("event_type", "error").field_regex("props", '"k": 1[0-9]}').build(), f"SELECT * FROM events WHERE {sql_has('event_type', 'error')} AND regexp_matches(props, '\"k\": 1[0-9]}}')")
register("array_tokens", lambda spark, sf_dir: search(table(spark, sf_dir, "embeddings"), query().field("embedding").field_token("label", "3").build()).select("vec_id", "label"), "SELECT vec_id, label FROM embeddings WHERE label = 3")


def _split_on_bars(text):
    return F.filter(F.split(text, "[#|]"), lambda t: t != "")


on("custom_tokenizer", "part", query().field_token("p_brand", "13").build(), "SELECT * FROM part WHERE list_contains(string_split_regex(p_brand, '[#|]'), '13')", tokenizer=_split_on_bars)
register("json_rows", lambda spark, sf_dir: search_json(table(spark, sf_dir, "events"), "props", query().field_token("k", "7").build()), "SELECT * FROM events WHERE json_extract_string(props, '$.k') = '7'")

# ---- prefilters ----

TESTS: dict[str, tuple[Test, Test, str, str]] = {
    # name: on a partition, on a range, the partition's SQL, the range's SQL over lo and hi
    "eq": (eq("error"), eq(150), "p = 'error'", "lo <= 150 AND hi >= 150"),
    "ne": (ne("error"), ne(150), "p <> 'error'", "lo <> 150 OR hi <> 150"),
    "gt": (gt("error"), gt(260), "p > 'error'", "hi > 260"),
    "gte": (gte("purchase"), gte(260), "p >= 'purchase'", "hi >= 260"),
    "lt": (lt("purchase"), lt(1), "p < 'purchase'", "lo < 1"),
    "lte": (lte("error"), lte(1), "p <= 'error'", "lo <= 1"),
    "in": (isin("click", "view", "none"), isin(240, 310, 9999), "p IN ('click', 'view', 'none')", "(lo <= 240 AND hi >= 240) OR (lo <= 310 AND hi >= 310)"),
    "not_in": (notin("click", "view"), notin(1, 2), "p NOT IN ('click', 'view')", "true"),
    "between": (between("d", "q"), between(250, 270), "p BETWEEN 'd' AND 'q'", "lo <= 270 AND hi >= 250"),
    "not_between": (notbetween("d", "q"), notbetween(1, 260), "p NOT BETWEEN 'd' AND 'q'", "lo < 1 OR hi > 260"),
}
USERS = """WITH b AS (SELECT user_id AS u, CAST(floor(min(value)) AS BIGINT) AS lo, CAST(ceil(max(value)) AS BIGINT) AS hi FROM events GROUP BY user_id)
SELECT events.* FROM events JOIN b ON user_id = u WHERE """


def _blocks_of(column: str, minmax: tuple[str, ...]) -> Callable[[Node, str, str], None]:
    """Registers searches of events whose blocks are the values of a column."""

    def add(name: str, asked: Node, sql: str, **options) -> None:
        # Columns need a session, so they are made when the query runs.
        register(name, lambda spark, sf_dir: search(table(spark, sf_dir, "events"), Query(prefilter=asked), partition=F.col(column), minmax=minmax, **options), sql)

    return add


by_type, by_user = _blocks_of("event_type", ("value",)), _blocks_of("user_id", ("value",))
for _name, (_on_name, _on_range, _name_sql, _range_sql) in TESTS.items():
    by_type(f"partition_{_name}", Partition(_on_name), f"SELECT * FROM events WHERE {_name_sql.replace('p ', 'event_type ', 1)}")
    by_user(f"minmax_{_name}", MinMax("value", _on_range), USERS + _range_sql)
by_type("partition_in_nothing", Partition(isin()), "SELECT * FROM events WHERE false")
by_type("minmax_missing", MinMax("user_id", ne(-1)), "SELECT * FROM events WHERE false")
by_type("minmax_rows", all_of(Partition(ne("view")), MinMax("value", between(20, 30))), "SELECT * FROM events WHERE event_type <> 'view' AND CASE WHEN value = floor(value) THEN value BETWEEN 20 AND 30 ELSE floor(value) <= 30 AND ceil(value) >= 20 END", mode="row")
by_user("prefilter_tree", any_of(all_of(Partition(gte("5")), MinMax("value", gt(280))), MinMax("value", gte(330))), USERS + "(CAST(u AS VARCHAR) >= '5' AND hi > 280) OR hi >= 330")
register(
    "prefilter_or_bloom",
    lambda spark, sf_dir: search(table(spark, sf_dir, "events"), query().match_prefilter(any_of(Partition(eq("7")), MinMax("value", gte(300)))).field_token("event_type", "purchase").build(), partition=F.col("user_id"), minmax=("value",)),
    USERS + f"(CAST(u AS VARCHAR) = '7' OR hi >= 300) AND {sql_has('event_type', 'purchase')}",
)
register(
    "minmax_floor_ceil",
    lambda spark, sf_dir: partition_blocks(table(spark, sf_dir, "orders"), F.col("o_orderpriority"), ("o_totalprice", "o_custkey")).select(
        "partition_id", "rows", *[F.col("ranges")[f][e].alias(f"{e}_{f}") for f in ("o_totalprice", "o_custkey") for e in ("min", "max")]),
    """SELECT o_orderpriority AS partition_id, count(*) AS rows, CAST(floor(min(o_totalprice)) AS BIGINT) AS min_o_totalprice, CAST(ceil(max(o_totalprice)) AS BIGINT) AS max_o_totalprice,
min(o_custkey) AS min_o_custkey, max(o_custkey) AS max_o_custkey FROM orders GROUP BY o_orderpriority""",
)

# ---- scalar functions ----


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    kind = df.schema["c_acctbal"].dataType
    low, high = range_columns(F.col("c_acctbal"), kind)
    return df.select("c_custkey", low.alias("low"), high.alias("high"), rounded_column(F.col("c_acctbal"), kind).alias("nearest"), leaf_text(F.col("c_acctbal"), kind).alias("number_text"))


register("number_forms", _numbers, f"""SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS low, CAST(ceil(c_acctbal) AS BIGINT) AS high,
CAST(sign(c_acctbal) * floor(abs(c_acctbal) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS nearest, {sql_double('c_acctbal')} AS number_text FROM customer""")  # fmt: skip
register("tokens", lambda spark, sf_dir: token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"),
         f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({sql_tokens('text')}) AS token FROM documents) GROUP BY token")


def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").drop("o_orderdate")
    return df.select("o_orderkey", F.inline(TypedRows(df.schema).leaves()))


register("leaves", _leaves, "\nUNION ALL ".join(f"SELECT o_orderkey, '{c}' AS path, {x} AS text FROM orders WHERE {c} IS NOT NULL" for c, x in (
    ("o_orderkey", "CAST(o_orderkey AS VARCHAR)"), ("o_custkey", "CAST(o_custkey AS VARCHAR)"), ("o_orderstatus", "o_orderstatus"), ("o_totalprice", sql_double("o_totalprice")), ("o_orderpriority", "o_orderpriority"))))
register("paths", lambda spark, sf_dir: (df := table(spark, sf_dir, "nation")).select("n_nationkey", F.explode(TypedRows(df.schema).paths()).alias("path")),
         "\nUNION ALL ".join(f"SELECT n_nationkey, '{c}' AS path FROM nation" for c in ("n_nationkey", "n_name", "n_regionkey")))

# ---- the index ----

EVENT = "event_id bigint, user_id bigint, event_type string, value double, props string"


def event_index(spark: SparkSession, sf_dir: str, batches: int = 1, **config) -> Engine:
    """An index of events with event_type as partition, written in so many batches by ranges of event_id."""
    engine = Engine(spark, scratch(spark), Config(partition=lambda df: F.col("event_type"), minmax=("event_id", "value"), **config))
    events = table(spark, sf_dir, "events").drop("ts")
    # Every row goes to exactly one batch.
    for k in range(batches):
        engine.ingest(events.where(F.pmod("event_id", F.lit(batches)) == k) if batches > 1 else events)
    return engine


EVENTS = "SELECT event_id, user_id, event_type, value, props FROM events"


def over_index(name: str, asked: Query, sql: str, batches: int = 1, merged: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = event_index(spark, sf_dir, batches)
        if merged:
            engine.merge()
        return engine.query(asked).typed(EVENT)

    register(name, run, sql)


over_index("index_match_all", Query(), EVENTS)
over_index("index_field_token", query().field_token("event_type", "error").build(), f"{EVENTS} WHERE event_type = 'error'")
over_index("index_token", query().token("17").build(), f"{EVENTS} WHERE event_id = 17 OR user_id = 17 OR {sql_double('value')} = '17'")
over_index("index_token_miss", query().token("nonexistent").build(), f"{EVENTS} WHERE false")
over_index("index_regex", query().field_token("event_type", "error").field_regex("props", "1}|2}").build(), f"{EVENTS} WHERE event_type = 'error' AND regexp_matches(props, '1}}|2}}')")
over_index("index_prefilter", query().match_prefilter(all_of(Partition(isin("error", "view")), MinMax("value", gte(0)))).build(), f"{EVENTS} WHERE event_type IN ('error', 'view')")
over_index("merge_preserves_rows", Query(), EVENTS, batches=3, merged=True)
over_index("merge_then_token", query().field_token("event_type", "purchase").build(), f"{EVENTS} WHERE event_type = 'purchase'", batches=3, merged=True)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = event_index(spark, sf_dir, max_block_rows=2**31 - 1, max_block_bytes=2**50).blocks()
    return blocks.groupBy("partition_id").agg(F.sum("rows").alias("rows"), F.min(F.col("ranges")["event_id"]["min"]).alias("first_event"), F.max(F.col("ranges")["event_id"]["max"]).alias("last_event"), F.max("fields.n").alias("fields"))


register("block_index_counts", _counts, "SELECT event_type AS partition_id, count(*) AS rows, min(event_id) AS first_event, max(event_id) AS last_event, CAST(5 AS BIGINT) AS fields FROM events GROUP BY event_type")


def _file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, scratch(spark), Config())
    engine.ingest(table(spark, sf_dir, "nation").coalesce(1))
    return engine.files().select("rows", F.col("fields.n").alias("fields"), F.col("tokens.n").alias("tokens"), F.col("pairs.n").alias("pairs"))


_NATION = " UNION ALL ".join(f"SELECT '{c}' AS path, unnest({sql_tokens(f'CAST({c} AS VARCHAR)')}) AS token FROM nation" for c in ("n_nationkey", "n_name", "n_regionkey"))
register("file_index_counts", _file_counts, f"SELECT (SELECT count(*) FROM nation) AS rows, CAST(3 AS BIGINT) AS fields, count(DISTINCT token) AS tokens, count(DISTINCT (path, token)) AS pairs FROM ({_NATION})")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, scratch(spark), Config(partition=lambda df: F.col("event_type")))
    schema = table(spark, sf_dir, "events").drop("ts").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*events.parquet").parquet(sf_dir) if not _is_folder(spark, f"{sf_dir}/events.parquet") else spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet")
    run = ingest_stream(stream, engine, f"{engine.store.root}-checkpoint", trigger={"availableNow": True})
    run.awaitTermination()
    return engine.query(query().field_token("event_type", "signup").build()).typed(EVENT)


def _is_folder(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()


register("streaming_ingest", _streamed, f"{EVENTS} WHERE event_type = 'signup'")
