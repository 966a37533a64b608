import json
import math
import random
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from tamis.functions.numeric import LEAST, MOST, int_range, range_columns, rounded, rounded_column
from tamis.functions.rows import TypedRows, WalkedRows, parse, walk, walked_json
from tamis.functions.text import leaf_text, number_text, whitespace_lower, whitespace_lower_text
from tamis.plans import catalog
from tamis.plans.match import row_filter
from tamis.plans.query import Field, FieldToken, Query, Token, all_of, any_of, query
from tamis.operators.search import search, search_json

TOKENS = {
    "hello world 123": ["hello", "world", "123"], "hello@world.com!test": ["hello@world.com!test"], "hello-world_test": ["hello-world_test"], "hello 😊 world 🎉": ["hello", "😊", "world", "🎉"],
    "user@domain.com, password123!": ["user@domain.com,", "password123!"], "42": ["42"], "": [], "hello   world": ["hello", "world"], "!@#$%^&*()": ["!@#$%^&*()"], "hello\tworld\ntest": ["hello", "world", "test"],
    "user-name_123@example.com (active)": ["user-name_123@example.com", "(active)"], "İX ΑΣ K": ["ix", "ασ", "k"], "a b　c d\u0085e": ["a", "b", "c", "d", "e"], "a​b\x1cc": ["a​b\x1cc"],
}


def test_default_tokenizer(spark):
    rows = spark.createDataFrame([(t,) for t in TOKENS], "t string").select("t", whitespace_lower(F.col("t")).alias("got")).collect()
    assert {r.t: r.got for r in rows} == TOKENS
    assert {t: whitespace_lower_text(t) for t in TOKENS} == TOKENS


def test_number_text(spark):
    want = {1e21: "1e+21", 1e-7: "1e-7", 1.5: "1.5", 100.0: "100", 12345678.25: "12345678.25", 1e20: "100000000000000000000", 0.000123: "0.000123", 2.0**60: "1152921504606847000", 1.5e-7: "1.5e-7", 0.1: "0.1", -50.0: "-50", 1234567890123.5: "1234567890123.5", 0.0: "0", 123456.7890123456: "123456.7890123456", -1234567.0: "-1234567", 9999999.0: "9999999", 1e-3: "0.001", 1e-6: "0.000001", 9007199254740993.0: "9007199254740992", 2.0**70: "1.1805916207174113e+21", 2.0**-44: "5.684341886080802e-14", 2e-3: "0.002", 1 / 3: "0.3333333333333333"}
    rows = spark.createDataFrame([(v,) for v in want], "v double").select("v", number_text(F.col("v")).alias("t")).collect()
    assert {r.v: r.t for r in rows} == want
    assert spark.createDataFrame([(math.nan,), (math.inf,), (None,)], "v double").where(number_text(F.col("v")).isNotNull()).count() == 0


def test_negative_zero_reads_as_zero(spark, tmp_path):
    """As the SQL of number_forms has it; a balance of -0.0 is rare enough to turn up in large tables only."""
    spark.createDataFrame([(1, -0.0), (2, 0.0), (3, -0.01), (4, None)], "c_custkey long, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    got = catalog.QUERIES["number_forms"](spark, str(tmp_path)).orderBy("c_custkey").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    assert [tuple(r) for r in got] == con.execute(f"{catalog.ORACLES['number_forms']} ORDER BY c_custkey").fetchall()
    assert got[0].number_text == "0"


def test_other_leaf_texts(spark):
    df = spark.sql("SELECT true AS b, timestamp_ntz'2024-01-02 03:04:05.120' AS t, timestamp_ntz'2024-01-02 03:04:00' AS u, X'6869' AS x, date'2024-01-02' AS d, CAST(1.5 AS FLOAT) AS f, CAST(null AS string) AS n, timestamp'2024-01-02 03:04:05' AS z")
    row = df.select(*[leaf_text(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]).first()
    assert tuple(row) == ("true", "2024-01-02T03:04:05.12Z", "2024-01-02T03:04:00Z", "aGk=", "2024-01-02", "1.5", None, "2024-01-02T03:04:05Z")


def test_int_ranges(spark):
    values = [0.0, 1.2, -1.2, 2.5, -2.5, 1e19, -1e19, 2.0**63, -(2.0**63), 0.49999999999999994, 4503599627370497.5, math.inf, -math.inf, math.nan, None]
    kind = spark.createDataFrame([], "v double").schema["v"].dataType
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    low, high = range_columns(F.col("v"), kind)
    for r in df.select("k", low.alias("low"), high.alias("high"), rounded_column(F.col("v"), kind).alias("near")).collect():
        v = values[r.k]
        assert ((r.low, r.high) if r.low is not None else None) == int_range(v), v
        assert r.near == rounded(v), v
    assert int_range(2**64) == (MOST, MOST) and int_range("7") is None and int_range(True) is None and int_range(Decimal("1.5")) == (1, 2) and int_range(-(2**70)) == (LEAST, LEAST)


def walked(text):
    found = list(walk(parse(text)))
    return {p for p, _, leaf in found if not leaf}, {(p, t) for p, t, leaf in found if leaf}


@pytest.mark.parametrize("text, paths, leaves", [
    ('{"a.b":"hello"}', {"a", "a.b"}, {("a.b", "hello")}),
    ('{"a":{"b":"world"}}', {"a", "a.b"}, {("a.b", "world")}),
    ('{".a":"xyz"}', {".a"}, {(".a", "xyz")}),
    ('{"":1,"x":{"":2}}', {"x", "x."}, {("x.", "2")}),
    ('{"":{"k":3}}', {"k"}, {("k", "3")}),
    ('{"n":9007199254740993,"f":50.00,"e":1e3,"t":true,"z":null,"o":{},"l":[]}', {"n", "f", "e", "t", "z", "o", "l"}, {("n", "9007199254740993"), ("f", "50.00"), ("e", "1e3"), ("t", "true")}),
    ('{"l":[{"a":1},[2,{"b":[3]}]]}', {"l", "l.a", "l.b"}, {("l.a", "1"), ("l", "2"), ("l.b", "3")}),
    ('{"a*":1,"q?x":2,"back\\\\slash":3}', {"a*", "q?x", "back\\slash"}, {("a*", "1"), ("q?x", "2"), ("back\\slash", "3")}),
])
def test_json_paths_and_leaves(spark, text, paths, leaves):
    assert walked(text) == (paths, leaves)
    row = spark.createDataFrame([(text,)], "j string").select(walked_json(F.col("j")).alias("w")).first().w
    assert set(row.paths) == paths and {tuple(x) for x in row.leaves} == leaves and row.error is None and parse(row.json) == parse(text)


def test_texts_that_are_no_objects(spark):
    bad = ["[1]", "1", "null", "{", '{"a":NaN}', "", None]
    rows = spark.createDataFrame([(t,) for t in bad], "j string").select(walked_json(F.col("j")).alias("w")).collect()
    assert all(r.w.error for r in rows)


TYPED = "struct<id: bigint, name: string, `a.b`: string, user: struct<name: string, tags: array<string>>, items: array<struct<n: int, ok: boolean>>, m: map<string, string>, mm: map<string, struct<z: int>>, empty: string>"
ROWS = [
    '{"id":1,"name":"Alice Ünal","a.b":"hello","user":{"name":"Bob","tags":["Red Green","blue"]},"items":[{"n":1,"ok":true},{"n":42,"ok":false}],"m":{"k.l":"Deep","x":"y"},"mm":{"p.q":{"z":7}},"empty":""}',
    '{"id":2,"name":null,"a.b":"x","user":null,"items":[],"m":{},"mm":{},"empty":"null"}',
    '{"id":42,"name":"error","a.b":null,"user":{"name":"error","tags":[]},"items":[{"n":7,"ok":null}],"m":{"k":"42"},"mm":{"z":{"z":-1}},"empty":"a"}',
]


def conditions():
    paths = ["id", "name", "a", "a.b", "user", "user.name", "user.tags", "items", "items.n", "items.ok", "m", "m.k", "m.k.l", "m.x", "mm.p", "mm.p.q", "mm.p.q.z", "mm.z.z", "empty", "nope", "user.nope", "", "m.", "use"]
    tokens = ["1", "42", "-1", "7", "alice", "ünal", "bob", "red", "red green", "true", "false", "deep", "y", "error", "Error", "null", "", "hello", "042"]
    pairs = [("id", "1"), ("id", "042"), ("name", "ünal"), ("name", "error"), ("a.b", "hello"), ("a", "hello"), ("user.tags", "red"), ("user.tags", "red green"), ("user.name", "bob"), ("items.n", "42"), ("items.ok", "false"), ("m.k.l", "deep"), ("m.k", "42"), ("mm.p.q.z", "7"), ("mm.z.z", "-1"), ("empty", "null"), ("", "x"), ("user", "bob")]
    out = [Field(p) for p in paths] + [Token(t) for t in tokens] + [FieldToken(p, t) for p, t in pairs]
    return [Query(keywords=c) for c in out] + [query().field_regex(p, r).build() for p, r in (("user", "^Bob$"), ("user.name", "r|e"), ("items", "^4"), ("items", "true"), ("m", "^4"), ("id", "^4"), ("a", "^h"), ("mm.p", "7"), ("", "e"))]


def test_typed_rows_and_json_rows_agree(spark):
    asked = conditions()
    df = spark.createDataFrame([(t,) for t in ROWS], "j string")
    typed = df.select(F.from_json("j", TYPED).alias("r")).select("r.*")
    # An absent field of a typed row is a null, so both forms hold the same keys.
    by_type = TypedRows(typed.schema)
    left = typed.select(F.col("id").alias("row_id"), *[row_filter(q, by_type).alias(f"q{k}") for k, q in enumerate(asked)]).collect()
    stored = typed.select(F.col("id").alias("row_id"), by_type.paths().alias("paths"), by_type.leaves().alias("leaves"))
    kept = WalkedRows(F.col("paths"), F.col("leaves"))
    middle = stored.select("row_id", *[row_filter(q, kept).alias(f"q{k}") for k, q in enumerate(asked)]).collect()
    spread = df.select(F.get_json_object("j", "$.id").cast("long").alias("row_id"), walked_json(F.col("j")).alias("w")).select("row_id", "w.*")
    right = spread.select("row_id", *[row_filter(q, kept).alias(f"q{k}") for k, q in enumerate(asked)]).collect()
    for k, q in enumerate(asked):
        verdicts = [{r.row_id: bool(r[f"q{k}"]) for r in rows} for rows in (left, middle, right)]
        assert verdicts[0] == verdicts[1] == verdicts[2], (q, verdicts)


def test_random_rows_find_themselves(spark):
    """No false negatives: every path, token and pair of a row is found in it."""
    rng = random.Random(7)
    keys = ["plain", "a.b", "a", "b.c.d", "q?x", "ünï", "with space", "x*", ".lead", "n", "deep", "z"]
    scalars = [0, 1, -5, 2**53 + 1, 2**64 - 1, 1.5, 1e-9, "", "Hello World", "tab\tx", "İstanbul ΑΣ", "Kelvin K", "true", True, False, None]

    def value(depth):
        pick = rng.random()
        if depth and pick < 0.2:
            return {rng.choice(keys): value(depth - 1) for _ in range(rng.randrange(3))}
        return [value(depth - 1) for _ in range(rng.randrange(3))] if depth and pick < 0.35 else rng.choice(scalars)

    texts = [json.dumps({"row_id": k} | {rng.choice(keys): value(2) for _ in range(rng.randrange(3, 6))}, ensure_ascii=False) for k in range(12)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, j string").coalesce(1)
    asked = []
    for k, t in enumerate(texts):
        paths, leaves = walked(t)
        asked += [(k, Query(keywords=Field(p))) for p in sorted(paths)[:3]] + [(k, Query(keywords=all_of(Token(x), FieldToken(p, x)))) for p, text in sorted(leaves)[:3] for x in whitespace_lower_text(text)[:2]]
    rows = df.select("k", walked_json(F.col("j")).alias("w")).select("k", "w.*")
    kept = WalkedRows(F.col("paths"), F.col("leaves"))
    found = {r.k: r for r in rows.select("k", *[row_filter(q, kept).alias(f"q{i}") for i, (_, q) in enumerate(asked)]).collect()}
    for i, (k, q) in enumerate(asked):
        assert found[k][f"q{i}"], (texts[k], q)


def test_pairs_are_compared_as_pairs(spark):
    df = spark.createDataFrame([('{"a::b":"c"}',)], "j string")
    assert search_json(df, "j", query().field_token("a::b", "c").build()).count() == 1
    assert search_json(df, "j", query().field_token("a", "b::c").build()).count() == 0


def test_null_fields(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, s string")
    assert search(df, query().field("s").build()).count() == 2
    assert search(df, query().field("s").build(), null_fields="drop").count() == 1
    assert search(df, Query(keywords=any_of())).count() == 0


def test_search_reads_only_what_it_needs(spark, sf):
    df = search(spark.read.parquet(f"{sf}/lineitem.parquet"), query().field_token("l_partkey", "42").build()).select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_partkey,42)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in plan
