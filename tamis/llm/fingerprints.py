"""Canonical exact fingerprints of documents.

The canonical form is Unicode NFKC, case-folded, NFKC again, with every run of white space as one space and none at
the ends. Its fingerprint is the 128-bit XXH3 of the UTF-8 bytes, in hex. Rows are grouped by fingerprint, and inside a
group with several rows bytes are compared: rows whose canonical bytes differ get different groups even if their hashes
are equal.

Cases: a null text is empty. The next document of a row is the next in order of id (nulls first), then text; the
last one's is the first; a single document is its own next one. Repeated rows are documents of their own. An empty
table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_hexdigest

from tamis.llm.shared import kept, partitions, read, staged

#: Rows of up to 40 bytes that are broadcast at most; beyond it they are joined by sorting.
LISTED = 200_000


def canonical(text: str) -> str:
    text = " ".join(text.split())
    if text.isascii():
        return text.lower()
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split())


def fingerprint(text: str) -> str:
    return xxh3_128_hexdigest(canonical(text).encode("utf-8", "surrogatepass"))


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns in keep, fingerprint, and the canonical text."""
    keep = kept(keep, ("fingerprint", "canonical"))
    docs = docs.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("fingerprint", T.StringType()), T.StructField("canonical", T.StringType())])

    def run(batches):
        for batch in batches:
            forms = [canonical(t or "") for t in batch["__text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({c: batch[c] for c in keep} | {"fingerprint": [xxh3_128_hexdigest(f.encode()) for f in forms], "canonical": forms})

    return docs.mapInArrow(run, schema)


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint, group_id: the least id among the rows whose canonical texts are equal byte for byte."""
    numbered = docs.select(F.col(doc_id).alias("__id"), F.xxhash64(text).alias("__hash"), F.col(text).alias("__text"))
    prints = staged(fingerprints(numbered, ["__id", "__hash"], "__text").drop("canonical"), "prints")
    return group_ids(numbered, prints).select(F.col("__id").alias(doc_id), "fingerprint", "group_id")


def group_ids(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """prints with group_id, the least __id among rows whose canonical texts are equal byte for byte.

    docs: __id, __hash (of the raw text), __text. prints: __id, __hash, fingerprint and any further columns, staged.
    Buckets of one row need no comparison. Of the others all canonical texts are compared: each task hands on one copy of
    each text, so a hot bucket moves little; a bucket in which all bytes are equal is one group, and one that holds
    different texts, which 128 bits hardly ever allow, is parted by text.
    """
    counted = prints.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("__id").alias("least"))
    shared = staged(counted.where("n > 1"), "buckets")
    few = shared.count() <= LISTED
    side = shared.select("fingerprint")
    members = prints.join(F.broadcast(side) if few else side.hint("merge"), "fingerprint").select("__id", "__hash").distinct()
    members = staged(members.withColumnsRenamed({"__id": "__i", "__hash": "__h"}), "members")
    side = F.broadcast(members) if members.count() <= LISTED else members.hint("merge")
    texts = docs.join(side, docs["__id"].eqNullSafe(F.col("__i")) & (docs["__hash"] == F.col("__h")), "left_semi")
    variants = fingerprints(texts, ["__id", "__hash"], "__text").groupBy("fingerprint", "canonical").agg(F.min("__id").alias("own"), F.collect_set("__hash").alias("hashes"))
    variants = staged(variants.select("fingerprint", "own", "hashes"), "variants")
    # A row of a bucket with several texts belongs to the one that its raw text's hash stands in.
    several = variants.groupBy("fingerprint").agg(F.count("*").alias("v")).where("v > 1").select("fingerprint")
    parted = variants.join(several, "fingerprint").select(F.col("fingerprint").alias("__f"), F.explode("hashes").alias("__k"), F.col("own").alias("__own")).distinct()
    least = shared.select(F.col("fingerprint").alias("__p"), "least")
    out = prints.join(F.broadcast(least) if few else least.hint("merge"), F.col("fingerprint") == F.col("__p"), "left")
    out = out.join(parted, (F.col("fingerprint") == F.col("__f")) & (F.col("__hash") == F.col("__k")), "left")
    return out.withColumn("group_id", F.coalesce("__own", F.when(F.col("__p").isNull(), F.col("__id")).otherwise(F.col("least")))).drop("__p", "least", "__f", "__k", "__own")


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame, n: int) -> tuple[DataFrame, int]:
    """docs with __range, the number of its range of ids, and __head: a copy of the first row of the next range that has rows.

    The ranges are cut at quantiles of the ids. Only one id a range comes to the driver.
    """
    cuts = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000).alias("q")).first().q if n > 1 else []
    cuts = sorted(set(cuts or []))
    number = F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("doc_id"))), F.lit(0)) if cuts else F.lit(0)
    number = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(number)
    firsts = docs.select("doc_id", number.alias("r")).groupBy("r").agg(F.min("doc_id").alias("first")).orderBy("r").collect()
    if not firsts:
        return docs.withColumn("__range", F.lit(0)).withColumn("__head", F.lit(False)), 0
    before = {row.r: firsts[k - 1].r for k, row in enumerate(firsts)}
    to = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    firsts_map = F.array(*[F.lit(row.first).cast("long") for row in firsts])
    is_head = F.col("doc_id").isNull() | F.coalesce(F.array_contains(firsts_map, F.col("doc_id").cast("long")), F.lit(False))
    docs = docs.withColumn("__own", number)
    docs = docs.withColumn("__copies", F.when(is_head, F.array(F.struct(F.col("__own").alias("r"), F.lit(False).alias("h")), F.struct(to[F.col("__own")].alias("r"), F.lit(True).alias("h")))).otherwise(F.array(F.struct(F.col("__own").alias("r"), F.lit(False).alias("h")))))
    docs = docs.withColumn("__c", F.explode("__copies")).withColumn("__range", F.col("__c.r")).withColumn("__head", F.col("__c.h"))
    return docs.drop("__own", "__copies", "__c"), len(firsts)


def followed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """For every row of docs (doc_id, text, keep): the columns in keep, doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint and next_fingerprint, with the text edited by that of the next row in order of id."""
    n = partitions(docs.sparkSession)
    ranged, _ = in_order(docs, 2 * n)
    ranged = ranged.repartitionByRange(n, "__range").sortWithinPartitions("__range", "__head", "doc_id", "text")

    def run(batches):
        # Rows of a range in order, and after them the first row of the next range, as the last row's next one.
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for k, r, head, doc, text in zip(range(part.num_rows), *(part[c].to_pylist() for c in ("__range", "__head", "doc_id", "text"))):
                    own = fingerprint(text)
                    if held is not None and held[0] == r:
                        _, doc_, text_, own_, kept_ = held
                        e = edited(text_, text)
                        out.append((doc_, len(text_), hashlib.sha256(e.encode()).hexdigest(), own_, fingerprint(e), own, *kept_))
                    held = None if head else (r, doc, text, own, [part[c][k].as_py() for c in keep])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [*kinds, *(part.schema.field(c).type for c in keep)])], names=[*names, *keep])

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 4]
    schema = T.StructType([*T._parse_datatype_string("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string").fields, *docs.select(*keep).schema.fields])
    return ranged.mapInArrow(run, schema)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("__hash", F.xxhash64("text"))
    prints = staged(followed(docs, ["__hash"]).withColumnRenamed("doc_id", "__id"), "prints")
    rows = group_ids(docs.select(F.col("doc_id").alias("__id"), "__hash", F.col("text").alias("__text")), prints)
    same = [(F.col("fingerprint") == F.col(f"{x}_fingerprint")).cast("double").alias(f"near_{x}") for x in ("edited", "next")]
    return rows.select(F.col("__id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *same, "group_id")
