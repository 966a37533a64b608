"""Mixing sources to target weights, with DataFrame functions only.

The words of a source form one stream, document after document, packed into blocks of BLOCK words. A source of S words
in n blocks and target T takes J = round(n T / S) blocks, at most 2 n. Each of its J slots draws an output shard at
random, so a shard's source counts are multinomial draws given exact source totals; shard_counts() tells them, and mix()
tells the shards that each document's words go to. Slot j stands for the block at
position j mod n of the source's pseudorandom permutation of epoch j div n (a swap-or-not shuffle, a bijection on any
range), so a block serves once an epoch. Slots and blocks meet in an equi-join on (source, block).

Nothing is gathered: streams are numbered in two levels (CHUNKS hashed chunks of a source, then the rows of a chunk),
slots are made from (source, piece) rows, and the only single-task steps go over one row a source or chunk.

Cases: a null text has size 0, and documents without words are taken 0 times. A null source is a source of its own,
the last in order. Null ids sort first. Repeated rows are separate documents; rows alike in id and size may swap
places, which no result shows. A source without words has target 0. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamis.llm.shared import WORD, partitions, read, staged

BLOCK, PIECE, ROUNDS, SHARD_BLOCKS = 128, 4096, 16, 1024
#: Documents a chunk holds at most on average; never fewer than LEAST_CHUNKS chunks, so that a hot source spreads.
CHUNK_ROWS, LEAST_CHUNKS = 20_000, 64
P = 2147483647


def scramble(x: Column, r: Column | int) -> Column:
    """A pseudorandom number below P; multiplications stay below 2**63."""
    y = (F.pmod(x, F.lit(P)) * 1103515245 + (F.lit(r) if isinstance(r, int) else r) * 69069 + 12345) % P
    y = (y * y + 1013904223) % P
    return (y * 48271 + 11) % P


def round_keys(n: Column, key: Column) -> Column:
    """What every round of permuted() mirrors at: an array for a key below 2**20, made once for many places."""
    rounds = F.sequence(F.lit(0).cast("long"), F.lit(ROUNDS - 1).cast("long"))
    return F.transform(rounds, lambda r: F.struct(((key * ROUNDS + r) % 1048573).alias("key"), (scramble(key * ROUNDS + r, 1) % n).alias("mirror")))


def permuted(x: Column, n: Column, rounds: Column) -> Column:
    """The place of x under a bijection of 0..n-1, with the rounds of round_keys()."""

    def step(at: Column, r: Column) -> Column:
        mirror = (r["mirror"] + n - at) % n
        return F.when(scramble(F.greatest(at, mirror), r["key"]) % 2 == 1, mirror).otherwise(at)

    return F.aggregate(rounds, x, step)


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row a source: source, rank, source_size, weight, target. sizes: source and size, a row a document.

    Sources in the order of the target per weight at which they stop: those that stop come first, and the rest
    share what these leave by weight.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = totals.withColumn("rank", F.row_number().over(order).cast("long"))
    w = w.withColumn("weight", F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("double"))
    w = w.withColumn("cap", F.col("source_size") * F.lit(most))
    by = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (total - before) / F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    w = w.withColumn("level", level)
    full = F.col("cap") <= F.col("weight") * F.col("level")
    w = w.withColumn("open", F.first(F.when(~full, F.col("level")), True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return w.select("source", "rank", "source_size", "weight", F.when(full, F.col("cap")).otherwise(F.col("weight") * F.col("open")).alias("target"))


def block_plan(docs: DataFrame, **targets) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs: doc_id, source, size and any further columns. Returns sources, documents with their place, and block uses."""
    n = docs.count()
    chunks = max(LEAST_CHUNKS, -(-n // CHUNK_ROWS))
    sources = staged(source_targets(docs, **targets), "sources")
    sources = sources.withColumn("blocks", F.ceil(F.col("source_size") / BLOCK).cast("long"))
    taken = F.least(F.col("blocks") * 2, F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + F.lit(0.5))).cast("long")
    sources = sources.withColumn("slots", F.when(F.col("source_size") > 0, taken).otherwise(0))
    # With the size, documents without an id or of one id spread over chunks too.
    docs = docs.withColumn("chunk", scramble(F.coalesce("doc_id", F.lit(0)) + F.col("size") * 7919, 7) % chunks)
    joined = docs.join(sources.select(F.col("source").alias("s"), "rank", "source_size", "target"), docs["source"].eqNullSafe(F.col("s"))).drop("s")
    totals = joined.groupBy("rank", "chunk").agg(F.sum("size").alias("in_chunk"))
    totals = totals.withColumn("before", F.coalesce(F.sum("in_chunk").over(Window.partitionBy("rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("in_chunk")
    inside = Window.partitionBy("rank", "chunk").orderBy("doc_id", "size")
    placed = joined.withColumn("at", F.row_number().over(inside)).withColumn("inner", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.join(totals, ["rank", "chunk"]).withColumn("start", F.col("before") + F.col("inner")).drop("before", "inner")
    return sources, placed, block_uses(sources)


def block_slots(sources: DataFrame) -> DataFrame:
    """One row a slot: rank, slot, shard, epoch, block."""
    shards = F.greatest(F.lit(1), F.ceil(F.col("all") / SHARD_BLOCKS)).cast("long")
    rows = sources.withColumn("all", F.sum("slots").over(Window.partitionBy())).where("slots > 0")
    rows = rows.select("rank", "blocks", "slots", shards.alias("shards"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / PIECE))).alias("piece"))
    # A few rows make many: a number of tasks of its own, which adaptive execution leaves alone.
    rows = rows.repartition(partitions(sources.sparkSession), "rank", "piece")
    rows = rows.withColumn("keys", F.array(*[round_keys(F.col("blocks"), (F.col("rank") * 2 + e) % 1048576) for e in (0, 1)]))
    rows = rows.withColumn("slot", F.explode(F.sequence(F.col("piece") * PIECE, F.least(F.col("slots"), (F.col("piece") + 1) * PIECE) - 1)))
    rows = rows.withColumn("epoch", F.floor(F.col("slot") / F.col("blocks"))).withColumn("x", F.col("slot") % F.col("blocks"))
    rows = rows.withColumn("block", permuted(F.col("x"), F.col("blocks"), F.col("keys")[F.col("epoch").cast("int")]))
    return rows.select("rank", "slot", (scramble(F.col("slot"), F.col("rank") % 1048573) % F.col("shards")).alias("shard"), "epoch", "block")


def block_uses(sources: DataFrame) -> DataFrame:
    """rank, block, uses: how many slots stand for each block (1 or 2), and the least and the greatest of their shards."""
    return block_slots(sources).groupBy("rank", "block").agg(F.count("*").alias("uses"), F.min("shard").alias("low"), F.max("shard").alias("high"))


def shard_counts(sources: DataFrame) -> DataFrame:
    """rank, shard, blocks: how many blocks of each source every output shard takes."""
    return block_slots(sources).groupBy("rank", "shard").agg(F.count("*").alias("blocks"))


def segments(placed: DataFrame, uses: DataFrame) -> DataFrame:
    """One row for each used block that a document has words in: rank, chunk, at, first, words (its own), uses, low, high."""
    parts = placed.where("size > 0").select("rank", "chunk", "at", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK))).alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * BLOCK)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK)
    # Block uses grow with the data and are never broadcast.
    return parts.join(uses.hint("merge"), ["rank", "block"]).select("rank", "chunk", "at", (low - F.col("start")).alias("first"), (high - low).alias("words"), "uses", "low", "high")


def mix(docs: DataFrame, **targets) -> DataFrame:
    """doc_id, size, source_size, target, taken for docs with doc_id, source and text.

    first_shard and last_shard: the least and the greatest output shard that takes words of the document; null for none.
    """
    sizes = staged(docs.select("doc_id", "source", word_count("text").alias("size")), "sizes")
    _, placed, uses = block_plan(sizes, **targets)
    placed = staged(placed, "placed")
    taken = segments(placed, uses).groupBy("rank", "chunk", "at").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"), F.min("low").alias("first_shard"), F.max("high").alias("last_shard"))
    out = placed.join(taken.hint("merge"), ["rank", "chunk", "at"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard", "last_shard")


def mixed_documents(docs: DataFrame, **targets) -> DataFrame:
    """The mix itself: docs' columns, one row for each copy of a document, its text the words that the mix takes.

    White space behind a taken word stays. The first copy has what is taken at all, a second what is taken twice.
    n_chars, where docs has it, follows the text.
    """
    columns = docs.columns
    keyed = docs.withColumn("__h", F.xxhash64("text"))
    keyed = keyed.withColumn("__dup", F.row_number().over(Window.partitionBy("doc_id", "source", "__h").orderBy("doc_id")))
    sizes = docs.select("doc_id", "source", word_count("text").alias("size"), F.xxhash64("text").alias("__h"))
    sizes = staged(sizes.withColumn("__dup", F.row_number().over(Window.partitionBy("doc_id", "source", "__h").orderBy("doc_id"))), "sizes")
    _, placed, uses = block_plan(sizes, **targets)
    placed = staged(placed, "placed")
    # A document's own segments: bounded by its length.
    parts = segments(placed, uses).groupBy("rank", "chunk", "at").agg(F.sort_array(F.collect_list(F.struct("first", "words", "uses"))).alias("__parts"))
    parts = placed.join(parts, ["rank", "chunk", "at"]).select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("__h").alias("__k"), F.col("__dup").alias("__n"), F.col("size").alias("__size"), "__parts")
    on = keyed["doc_id"].eqNullSafe(parts["__id"]) & keyed["source"].eqNullSafe(parts["__source"]) & (keyed["__h"] == parts["__k"]) & (keyed["__dup"] == parts["__n"])
    out = keyed.join(parts, on).withColumn("__copy", F.explode(F.array(F.lit(0), F.lit(1))))
    out = out.withColumn("__parts", F.filter("__parts", lambda p: p["uses"] > F.col("__copy"))).where(F.size("__parts") > 0)
    whole = F.aggregate("__parts", F.lit(0).cast("long"), lambda a, p: a + p["words"]) == F.col("__size")
    words = F.regexp_extract_all("text", F.lit(WORD + "[\\x20\\x09-\\x0D]*"), F.lit(0))
    cut = F.aggregate(
        F.transform("__parts", lambda p: F.array_join(F.slice(F.col("__words"), (p["first"] + 1).cast("int"), p["words"].cast("int")), "")),
        F.lit(""), lambda a, t: F.concat(a, t))
    out = out.withColumn("__words", F.when(~whole, words)).withColumn("text", F.when(whole, F.col("text")).otherwise(cut))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


def _sql_scramble(x: str, r: str) -> str:
    y = f"((((({x}) % {P}) + {P}) % {P}) * 1103515245 + ({r}) * 69069 + 12345) % {P}"
    return f"(((({y}) * ({y}) + 1013904223) % {P}) * 48271 + 11) % {P}"


def _sql() -> str:
    def step(inner: str, r: int) -> str:
        p = f"(({_sql_scramble(f'key * {ROUNDS} + {r}', '1')}) % blocks + blocks - x) % blocks"
        bit = _sql_scramble("greatest(x, p)", f"(key * {ROUNDS} + {r}) % 1048573")
        return f"SELECT rank, blocks, key, CASE WHEN ({bit}) % 2 = 1 THEN p ELSE x END AS x FROM (SELECT *, {p} AS p FROM ({inner}))"

    def step_keeping(inner: str, r: int) -> str:
        return step(inner, r).replace("SELECT rank,", "SELECT rank, shard,", 1)

    walk = reduce(step_keeping, range(ROUNDS), "SELECT rank, shard, blocks, (rank * 2 + slot // blocks) % 1048576 AS key, slot % blocks AS x FROM slots")
    return f"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank, source_size * CAST(2 AS DOUBLE) AS cap FROM totals),
weighed AS (SELECT *, CAST([3, 1, 2][(rank - 1) % 3 + 1] AS DOUBLE) AS weight FROM ranked),
leveled AS (
  SELECT *, ((SELECT sum(source_size) FROM totals) * CAST(1.5 AS DOUBLE)
    - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
opened AS (SELECT arg_min(level, (cap / weight, rank)) AS level FROM leveled WHERE cap > weight * level),
targets AS (
  SELECT source, rank, source_size, CASE WHEN cap <= weight * level THEN cap ELSE weight * (SELECT level FROM opened) END AS target FROM leveled),
sources AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(least(2 * blocks, floor(target * blocks / source_size + CAST(0.5 AS DOUBLE))) AS BIGINT) END AS slots
  FROM (SELECT *, (source_size + {BLOCK - 1}) // {BLOCK} AS blocks FROM targets)),
docs AS (
  SELECT d.*, s.rank, s.source_size, s.target,
    ({_sql_scramble('coalesce(d.doc_id, 0) + d.size * 7919', '7')}) % greatest({LEAST_CHUNKS}, ((SELECT count(*) FROM sizes) + {CHUNK_ROWS - 1}) // {CHUNK_ROWS}) AS chunk
  FROM sizes d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source),
placed AS (
  SELECT *, row_number() OVER w AS at, CAST(sum(size) OVER w AS BIGINT) - size AS start FROM docs
  WINDOW w AS (PARTITION BY rank ORDER BY chunk, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)),
numbered AS (SELECT rank, blocks, unnest(range(slots)) AS slot FROM sources),
slots AS (
  SELECT *, ({_sql_scramble('slot', 'rank % 1048573')}) % greatest(1, ((SELECT sum(slots) FROM sources) + {SHARD_BLOCKS - 1}) // {SHARD_BLOCKS}) AS shard FROM numbered),
walked AS ({walk}),
uses AS (SELECT rank, x AS block, count(*) AS uses, min(shard) AS low, max(shard) AS high FROM walked GROUP BY rank, x),
parts AS (SELECT *, unnest(range(start // {BLOCK}, (start + size - 1) // {BLOCK} + 1)) AS block FROM placed WHERE size > 0),
taken AS (
  SELECT p.rank, p.at, sum((least(start + size, (p.block + 1) * {BLOCK}) - greatest(start, p.block * {BLOCK})) * uses) AS taken, min(low) AS first_shard, max(high) AS last_shard
  FROM parts p JOIN uses u ON p.rank = u.rank AND p.block = u.block GROUP BY p.rank, p.at)
SELECT p.doc_id, p.size, p.source_size, p.target, CAST(coalesce(t.taken, 0) AS BIGINT) AS taken,
  CAST(t.first_shard AS BIGINT) AS first_shard, CAST(t.last_shard AS BIGINT) AS last_shard
FROM placed p LEFT JOIN taken t ON p.rank = t.rank AND p.at = t.at"""


OP4_SQL = _sql()
