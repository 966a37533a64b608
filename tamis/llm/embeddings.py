"""Embedding near-duplicates by random-hyperplane sign hashing in several tables.

Equal vectors of a label are one class with a weight. Every class hashes into each table by the signs of its products
with fixed random hyperplanes, once, and carries these; classes that meet in a bucket are compared by exact cosine in double precision, block
by block, and a pair counts in the first table where it meets. The number of tables follows from the wanted recall of
a pair exactly at the threshold. Buckets above CELL are cut into slices, and every pair of slices is a task of its
own. A task returns, for each class, the weight it links to and at most one link that ties it to its class leader:
never all pairs. Components come from components().

Cases: vectors that are null, of length zero, all zero, or hold a null or non-finite component link with nothing, as
do rows with a null label; vectors of different lengths never link. Repeated rows count as vectors of their own. A row
with a null vec_id takes part and gets the least non-null id of its component. Labels of any type are compared as they are, but
for whole numbers by 64-bit hashes while vectors meet. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.llm.components import components
from tamis.llm.shared import partitions, read, staged
from tamis.llm.simhash import Classes

CELL = 4_096


def tables_for(cosine: float, bits: int, recall: float) -> int:
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((tables * bits, dim))


def signatures(x: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """(rows, tables) bucket numbers."""
    signs = x @ planes(x.shape[1], bits, tables, seed).T > 0
    return (signs.reshape(len(x), tables, bits).astype(np.int64) << np.arange(bits)).sum(2)


def by_length(vectors: pa.Array):
    """(rows, their vectors as an array) for each length, from a column of lists without nulls."""
    ends = vectors.offsets.to_numpy()
    flat, sizes = vectors.values.to_numpy(zero_copy_only=False), np.diff(ends)
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield at, flat[ends[at][:, None] + np.arange(dim)].astype(np.float64)


def near_vectors(vectors: DataFrame, cosine: float = 0.98, recall: float = 0.999, cell: int = CELL, seed: int = 7) -> DataFrame:
    """vectors: vec_id, embedding, label. Rows vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    vectors = vectors.select("vec_id", "embedding", "label")
    fit = F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    # -0.0 and 0.0 are one value, so that equal vectors are equal by key.
    sound = vectors.where(F.coalesce(fit, F.lit(False))).withColumn("embedding", F.transform("embedding", lambda x: F.when(x == 0, x * 0 + F.lit(0).cast("float")).otherwise(x).cast("double")))
    sound = sound.withColumn("key", F.xxhash64("label", "embedding"))
    classes = sound.groupBy("key", "label", "embedding").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    whole = isinstance(vectors.schema["label"].dataType, T.IntegralType)
    classes = classes.withColumn("label_key", F.col("label").cast("long") if whole else F.xxhash64("label"))
    classes = staged(classes.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    n = classes.count()
    bits = min(24, max(8, math.ceil(math.log2(max(1, n / 1024)))))
    tables = tables_for(cosine, bits, recall)

    def hashed(batches):
        for batch in batches:
            for at, x in by_length(batch["embedding"]):
                sigs = signatures(x, bits, tables, seed)
                each = {"rep": batch["rep"].take(pa.array(at)), "label": batch["label_key"].take(pa.array(at)), "dim": np.full(len(at), x.shape[1], np.int32), "sigs": pa.array([r.tobytes() for r in sigs.astype("<i4")], pa.binary())}
                for t in range(tables):
                    yield pa.RecordBatch.from_pydict(each | {"t": np.full(len(at), t, np.int32), "sig": sigs[:, t]})

    key = ["label", "dim", "t", "sig"]
    met = classes.select("rep", "label_key", "embedding").mapInArrow(hashed, "rep long, label long, dim int, sigs binary, t int, sig long")
    met = staged(met, "buckets")
    sizes = met.groupBy(*key).agg(F.count("*").alias("members")).where("members > 1")
    sizes = sizes.select(*key, F.when(F.col("members") > cell, F.ceil(F.col("members") / (cell // 2))).otherwise(1).cast("int").alias("slices"))
    met = met.join(sizes, key)  # lone members end here
    own = F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int")
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    met = met.select(*key, "rep", "sigs", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    met = met.join(classes.select("rep", "embedding", "weight"), "rep")
    cells = met.repartition(partitions(spark), *key, "i", "j").sortWithinPartitions(*key, "i", "j")

    def compare(batches):
        held, last = [], None

        def close():
            whole = pa.concat_tables(held).combine_chunks()
            x = np.concatenate([v for _, v in by_length(whole["embedding"].chunk(0))])  # of one length, so in order
            rep, own, weight = (whole[c].to_numpy() for c in ("rep", "own", "weight"))
            t, (i, j) = last[2], last[4:]
            x /= np.abs(x).max(1, keepdims=True)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            sigs = np.frombuffer(b"".join(whole["sigs"].to_pylist()), "<i4").reshape(len(x), -1)
            groups, linked = Classes(len(x)), np.zeros(len(x), np.int64)
            a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
            for s in range(0, len(a), 512):
                rows = a[s : s + 512]
                near = x[rows] @ x[b].T >= cosine
                for before in range(t):  # met already
                    near &= sigs[rows, before][:, None] != sigs[b, before][None, :]
                if i == j:
                    near[np.arange(len(rows)), np.arange(s, s + len(rows))] = False
                linked[rows] += near @ weight[b]
                if i != j:
                    linked[b] += weight[rows] @ near
                p, q = np.nonzero(near)
                groups.join(rows[p], b[q])
            at = np.flatnonzero(linked)
            return pa.RecordBatch.from_pydict({"rep": rep[at], "links": linked[at], "leader": rep[groups.label[at]]}) if len(at) else None

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            keys = np.stack([batch[c].to_numpy().astype(np.int64) for c in (*key, "i", "j")], 1)
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])).tolist()
            for s, e in zip(starts, [*starts[1:], len(keys)]):
                now = tuple(keys[s].tolist())
                if last is not None and now != last:
                    if sum(h.num_rows for h in held) > 1 and (got := close()) is not None:
                        yield got
                    held = []
                last = now
                held.append(table.slice(s, e - s))
        if sum(h.num_rows for h in held) > 1 and (got := close()) is not None:
            yield got

    # The same pair of a slice with itself is met once; a class in several cells adds up.
    found = staged(cells.select(*key, "i", "j", "rep", "sigs", "own", "embedding", "weight").mapInArrow(compare, "rep long, links long, leader long"), "near")
    groups = components(found, "rep", "leader").withColumnsRenamed({"node": "rep"})
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    reps = classes.select("rep", "key", "label", "embedding", "weight", "least").join(counts, "rep", "left").join(groups, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = reps.groupBy("component").agg(F.min("least").alias("component_id"))
    reps = reps.join(least, "component").select("key", F.col("label").alias("l"), F.col("embedding").alias("e"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    linked = sound.join(reps, (sound["key"] == reps["key"]) & (sound["label"] == reps["l"]) & (sound["embedding"] == reps["e"])).select("vec_id", "n_links", "component_id")
    alone = vectors.where(~F.coalesce(fit, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


#: All pairs of a label, and reachability over their links.
OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER () AS k FROM embeddings),
sound AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.k AS a, b.k AS b FROM sound a JOIN sound b ON a.label = b.label AND a.k <> b.k
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.98 ELSE false END),
reach AS (SELECT a AS k, b AS r FROM links UNION SELECT reach.k, links.b FROM reach JOIN links ON reach.r = links.a),
least AS (SELECT reach.k, min(v.vec_id) AS component_id FROM reach JOIN v ON reach.r = v.k GROUP BY reach.k),
degree AS (SELECT a AS k, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(vec_id = coalesce(component_id, vec_id), false) AS kept
FROM v LEFT JOIN degree ON v.k = degree.k LEFT JOIN least ON v.k = least.k"""
