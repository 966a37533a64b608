"""What several operators share: staging, word splitting on Arrow buffers, ordered ranges."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: `[^\x20\x09-\x0D]+`, the words of most contracts, for Spark's and DuckDB's regex engines.
WORD = "[^\\x20\\x09-\\x0D]+"
_SPACE = b" \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_table(keep) -> bytes:
    """A table for bytes.translate: A-Z in lower case, bytes that keep() refuses as spaces."""
    return bytes((c + 32 if 65 <= c <= 90 else c) if keep(c) else 32 for c in range(256))


LOWER = byte_table(lambda c: c not in _SPACE)
SPLIT_ONLY = bytes(32 if c in _SPACE else c for c in range(256))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one on one machine; on a cluster that is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not base:
        base = getattr(spark, "_tamis_shared", None)
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="tamis-")
            spark._tamis_shared = base
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tamis-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: a lineage cut that outlives executors."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(keep: list[str], made: tuple[str, ...]) -> list[str]:
    """The columns to hand on: one that is named like a column that the operator makes gives way to it."""
    return [c for c in keep if c not in made]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of an id's decimal text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def release() -> None:
    """Gives freed memory back to the system: Python workers outlive their tasks, and what they held once would count on."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def strings(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """One string array without offset or nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    return pa.concat_arrays([column]) if column.offset else column


def translated(texts: pa.Array, table: bytes) -> pa.Array:
    """texts (large strings) with every byte mapped; bytes from 0x80 on must map to themselves."""
    _, offsets, data = texts.buffers()
    if data is None or not len(texts):
        return texts
    return pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer(data.to_pybytes().translate(table)))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words between ASCII white space, in order, and the number of words of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    empty = pc.equal(flat, "")
    if pc.any(empty).as_py():
        full = pc.invert(empty).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(counts)), counts)[full]
        counts = np.bincount(owner, minlength=len(counts)).astype(np.int64)
        flat = flat.filter(pa.array(full))
    return flat, counts


def sums_by_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths; 0 for an empty run."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.float64), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def chunked(batches, most_bytes: int):
    """Groups Arrow batches into tables of about most_bytes; a longer text stays whole."""
    held, size = [], 0
    for batch in batches:
        step = max(1, int(batch.num_rows * most_bytes / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            piece = batch.slice(at, step)
            held.append(piece)
            size += piece.nbytes
            if size >= most_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


class Runs:
    """Runs of token ids of words that were encoded before; starts anew once it holds `most` words."""

    def __init__(self, most: int = 700_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.flat, self.first, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of(self, words: pa.Array, encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all ids, begin, size): where the run of each of the distinct words is. encode(list) gives flat ids and sizes."""
        words = words.cast(pa.large_string())
        if len(self.words) + len(words) > self.most:
            self.clear()
        new = words.filter(pc.is_null(pc.index_in(words, value_set=self.words))) if len(self.words) else words
        if len(new):
            ids, sizes = encode(new.to_pylist())
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
            self.words = pa.concat_arrays([self.words, new])
        at = pc.index_in(words, value_set=self.words).to_numpy(zero_copy_only=False).astype(np.int64) if len(words) else np.zeros(0, np.int64)
        return self.flat, self.first[at], self.size[at]
