"""How often each token occurs in the texts of a table, and in how many documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions.text import Tokenizer, whitespace_lower

#: Ids with several rows that are told apart by a broadcast.
LISTED_IDS = 10_000
COUNTS = pa.schema([("token", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def token_counts(docs: DataFrame, key: str, text: str, tokenizer: Tokenizer | None = None) -> DataFrame:
    """token, n (occurrences) and docs (distinct keys that aren't null).

    A key of one row has all its tokens there, so rows are counted where they are read and only sums are shuffled. Rows
    whose keys come again are grouped by token and key.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    again = rows.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key")
    several = again.limit(LISTED_IDS + 1).count()
    split = tokenizer or whitespace_lower
    if several > LISTED_IDS:
        return _summed(_by_key(rows, split))
    if not several:
        return _summed(_by_row(rows, split))
    listed = F.broadcast(again)  # LISTED_IDS rows at most
    return _summed(_by_row(rows.join(listed, "key", "left_anti"), split).unionByName(_by_key(rows.join(listed, "key", "left_semi"), split)))


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("token").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _by_key(rows: DataFrame, split: Tokenizer) -> DataFrame:
    pairs = rows.select("key", F.explode(split(F.col("text"))).alias("token")).groupBy("token", "key").agg(F.count("*").alias("n"))
    return pairs.groupBy("token").agg(F.sum("n").alias("n"), F.count("key").alias("docs"))


def _by_row(rows: DataFrame, split: Tokenizer) -> DataFrame:
    def counted(batches):
        for batch in batches:
            words = batch["words"]
            found = words.flatten().dictionary_encode()
            k, size = len(found.dictionary), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
            code = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            n = np.bincount(code, minlength=k)
            keyed = np.repeat(batch["keyed"].to_numpy(zero_copy_only=False), size)
            pairs = (np.repeat(np.arange(len(size), dtype=np.int64), size) * k + code)[keyed]
            pairs.sort()
            first = np.ones(len(pairs), bool)
            first[1:] = pairs[1:] != pairs[:-1]
            docs = np.bincount(pairs[first] % max(k, 1), minlength=k)
            yield pa.record_batch([found.dictionary, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], schema=COUNTS)

    words = rows.where("text IS NOT NULL").select(F.col("key").isNotNull().alias("keyed"), split(F.col("text")).alias("words"))
    return words.mapInArrow(counted, "token string, n long, docs long")
