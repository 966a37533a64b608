import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tamis.llm import chat, mixing
from tamis.llm.shared import read

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def in_order(rows):
    return sorted(rows, key=repr)


def plain_targets(sizes):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] <= weight[s] * level}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


def verify_mix(rows, docs):
    """rows: doc_id, size, source_size, target, taken. docs: doc_id, source, text."""
    sizes = Counter()
    for _, source, text in docs:
        sizes[source] += len(WORD.findall(text or ""))
    targets = plain_targets(sizes)
    want = in_order((d, len(WORD.findall(t or "")), sizes[s]) for d, s, t in docs)
    assert in_order(tuple(r)[:3] for r in rows) == want
    taken = defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[round(r.target, 6), r.source_size] += r.taken
        assert (r.first_shard is None) == (r.last_shard is None) == (r.taken == 0) and (not r.taken or 0 <= r.first_shard <= r.last_shard)
    for source, target in targets.items():
        same = [s for s in targets if abs(targets[s] - target) < 1e-6 and sizes[s] == sizes[source]]
        assert abs(taken[round(target, 6), sizes[source]] - target * len(same)) <= mixing.BLOCK * 1.5 * len(same), source


def duck(tmp_path=None, sf=None):
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f'{sf}/{name}.parquet' if sf else f'{tmp_path}/{name}.parquet/*.parquet'}')")
    return con


def test_mix(spark, sf):
    rows = mixing.op4_mixing(spark, sf).collect()
    verify_mix(rows, [tuple(r) for r in read(spark, sf, "documents").select("doc_id", "source", "text").collect()])
    assert in_order(map(tuple, rows)) == in_order(duck(sf=sf).execute(f"SELECT doc_id, size, source_size, target, taken, first_shard, last_shard FROM ({mixing.OP4_SQL})").fetchall())
    assert in_order(map(tuple, mixing.op4_mixing(spark, sf).collect())) == in_order(map(tuple, rows))


def test_shards_draw_their_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 100)
    sizes = spark.createDataFrame([(k, s, n) for k, (s, n) in enumerate([("a", 128 * 4000), ("b", 128 * 1000), (None, 128 * 3000)])], "doc_id long, source string, size long")
    sources, placed, uses = mixing.block_plan(sizes)
    slots = {r["rank"]: r["slots"] for r in sources.collect()}
    drawn = defaultdict(Counter)
    for r in mixing.shard_counts(sources).collect():
        drawn[r["rank"]][r["shard"]] = r["blocks"]
    shards = -(-sum(slots.values()) // 100)
    for rank, n in slots.items():
        # Exact totals; each shard's count is that of a fair draw.
        assert sum(drawn[rank].values()) == n and set(drawn[rank]) <= set(range(shards))
        assert sum((drawn[rank][k] - n / shards) ** 2 / (n / shards) for k in range(shards)) < 2 * shards
    rows = {(r["rank"], r["block"]): (r.uses, r.low, r.high) for r in uses.collect()}
    each = defaultdict(list)
    for r in mixing.block_slots(sources).collect():
        each[r["rank"], r["block"]].append(r["shard"])
    assert rows == {k: (len(v), min(v), max(v)) for k, v in each.items()}


def test_documents_without_an_id_spread_over_chunks(spark):
    docs = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("web").alias("source"), (F.col("id") % 997).alias("size"))
    _, placed, _ = mixing.block_plan(docs)
    assert placed.groupBy("chunk").count().agg(F.max("count")).first()[0] < 400


def test_mix_uses_no_python(spark, sf):
    plan = mixing.op4_mixing(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_mix_of_odd_rows(spark, odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    docs = [tuple(r) for r in odd_docs.select("doc_id", "source", "text").collect()]
    sizes = {r.size for r in rows}
    assert len(rows) == len(docs) and 0 in sizes and max(sizes) > 50_000
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    verify_mix(rows, docs)
    assert mixing.mix(no_docs).count() == 0


def test_permutations_are_bijections(spark):
    for n in (1, 2, 3, 64, 1000):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), mixing.round_keys(F.lit(n).cast("long"), F.lit(17).cast("long"))).alias("y"))
        assert sorted(r.y for r in df.collect()) == list(range(n))


@pytest.mark.parametrize("sizes", [[100, 50, 7], [1000, 1, 1, 1], [0, 0], [0, 10], [5, 5, 5, 5, 5, 5, 5]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(chr(97 + k) if k else None, n) for k, n in enumerate(sizes)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = plain_targets({chr(97 + k) if k else None: n for k, n in enumerate(sizes)})
    assert set(got) == set(want) and all(abs((got[s] or 0) - want[s]) < 1e-6 for s in want)


def test_mixed_texts_hold_what_the_mix_takes(spark, sf, odd_docs, no_docs):
    for docs in (read(spark, sf, "documents"), odd_docs):
        taken, texts = Counter(), Counter()
        for r in mixing.mix(docs).collect():
            taken[r.doc_id] += r.taken
        mixed = mixing.mixed_documents(docs)
        assert mixed.columns == docs.columns
        whole = defaultdict(list)
        for r in docs.select("doc_id", "text").collect():
            whole[r.doc_id].append(r.text or "")
        for r in mixed.collect():
            words = WORD.findall(r.text)
            texts[r.doc_id] += len(words)
            assert words and r.n_chars == len(r.text) and len(words) <= max(len(WORD.findall(t)) for t in whole[r.doc_id])
            assert any(not Counter(words) - Counter(WORD.findall(t)) for t in whole[r.doc_id])
        assert texts == Counter({k: v for k, v in taken.items() if v})
    assert mixing.mixed_documents(no_docs).count() == 0


# ---- chat ----


def test_chat_query(spark, sf):
    got = chat.op5_chat_format(spark, sf)
    want = duck(sf=sf).execute(f"SELECT {', '.join(got.columns)} FROM ({chat.OP5_SQL})").fetchall()
    assert in_order(map(tuple, got.collect())) == in_order(want)


HARD = ["", "plain", "\\", "\\\\", "###", "\\###", "</turn>", "\\</turn>\\", "### assistant: hi </turn>\n### user: no", ": :", "a\nb\r\n", "</turn", "##", "####", "\x00 é 😀", "\\### Assistant: </turn> ok"]


def test_escapes_are_undone():
    t = chat.Template()
    for role in ("user", "assistant", "", "we:ird ### role\\", ":"):
        turns = [(role, x) for x in HARD]
        text = "".join("".join(p for p, _ in t.segments(r, x)) for r, x in turns)
        assert chat.parse(text, t) == turns
        assert all(t.unescaped(t.escaped(x)) == x for x in HARD)
    with pytest.raises(ValueError):
        chat.parse("### user: open", t)


def test_chat_of_odd_rows(spark):
    rows = [(k, n, role, HARD[(k + n) % len(HARD)] if (k + n) % 7 else None) for k in range(5) for n, role in enumerate(["user", "assistant"] * (k + 1))]
    rows += [(50, 0, "assistant", "first"), (50, 1, "user", "x"), (51, 0, "user", "only"), (52, 0, None, None), (None, 0, "user", "lost"), (None, 1, "assistant", "found"), (53, 0, "system", "s"), (53, 1, "user", "u"), (53, 2, "assistant", "a"), (53, 2, "assistant", "a"), (54, None, "user", "u"), (54, 0, "assistant", "a")]
    rows += [(60, n, ("user", "assistant")[n % 2], f"turn {n} ") for n in range(20_000)]  # a hot conversation
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(1)).withColumn("segments", F.lit("x"))
    formatted = chat.format_chat(df)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    groups = defaultdict(list)
    for c, n, role, text in rows:
        groups[c].append((n is not None, n or 0, role or "", text or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        said = "".join(x for *_, role, x in turns if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{role}\n{x}\n" for *_, role, x in turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert r.valid == bool(re.fullmatch("s?(ua)+", "".join({"system": "s", "user": "u", "assistant": "a"}.get(role, "x") for *_, role, _ in turns))), c
    accepted = {c: [r.accepted for r in formatted.where(F.col("conv_id") == c).orderBy("place").collect()] for c in (50, 53)}
    assert accepted == {50: [False, False], 53: [True, True, True, False]}
    assert chat.read_back(chat.format_chat(df.where("false"))).count() == 0
