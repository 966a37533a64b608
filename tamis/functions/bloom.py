"""Bloom filters sized by exact counts: built with numpy, probed by Spark expressions.

An entry is a 64-bit hash; bit j of it is (low + j * high) mod size, from its two halves. A filter is
struct<n, size, hashes, words, check>: entries, bits, hash functions, the bits in longs (low bit first) and their XXH64.
A probe reads a long by its place and tests one bit of it. check is made by Spark from what it stores, and compared for
every filter that a query asks: a damaged filter that says no would hide rows, so none is trusted unchecked.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILTER = T.StructType([T.StructField("n", T.LongType()), T.StructField("size", T.LongType()), T.StructField("hashes", T.IntegerType()), T.StructField("words", T.ArrayType(T.LongType())), T.StructField("check", T.LongType())])
FILTER_ARROW = pa.struct([("n", pa.int64()), ("size", pa.int64()), ("hashes", pa.int32()), ("words", pa.list_(pa.int64())), ("check", pa.int64())])
HALF = 0x7FFFFFFF


def shape(n: int, false_positives: float) -> tuple[int, int]:
    """Bits and hash functions for n entries; an empty filter has room for one."""
    n = max(n, 1)
    size = math.ceil(-n * math.log(false_positives) / math.log(2) ** 2)
    return max(size, 1), max(1, math.ceil(size / n * math.log(2)))


def build(entries: np.ndarray, false_positives: float) -> dict:
    """The filter of distinct int64 hashes, not yet checked()."""
    size, hashes = shape(len(entries), false_positives)
    low, high = entries & HALF, (entries >> 32) & HALF | 1
    marks = np.zeros(-(-size // 64) * 64, np.uint8)
    for j in range(hashes):
        marks[(low + j * high) % size] = 1
    return {"n": len(entries), "size": size, "hashes": hashes, "words": np.packbits(marks, bitorder="little").view("<i8"), "check": None}


def checked(bloom: Column) -> Column:
    """The filter with the checksum of its bits."""
    return bloom.withField("check", F.xxhash64(bloom["words"]))


def may_hold(bloom: Column, entry: Column, most_hashes: int) -> Column:
    """Whether the filter may hold the entry (a long). most_hashes: of any filter that is probed."""
    low, high = entry.bitwiseAND(HALF), F.shiftright(entry, 32).bitwiseAND(HALF).bitwiseOR(F.lit(1).cast("long"))

    def bit(j: Column) -> Column:
        at = F.pmod(low + j * high, bloom["size"])
        return F.getbit(F.get(bloom["words"], F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")) == 1

    return F.forall(F.sequence(F.lit(0).cast("long"), F.least(bloom["hashes"], F.lit(most_hashes)).cast("long") - 1), bit)


def sound(bloom: Column) -> Column:
    return F.coalesce(F.xxhash64(bloom["words"]) == bloom["check"], F.lit(False))
