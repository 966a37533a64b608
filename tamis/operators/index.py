"""Block and file metadata of stored rows: counts, int64 ranges and bloom filters.

Hashes of a row's paths, tokens and (path, token) pairs are made by Spark expressions; Python workers see arrays of
longs, keep the distinct ones of each block, and a grouped step merges what several tasks saw of a block. Counts are of
distinct 64-bit hashes. A group is one block, which has a bounded size, or the distinct hashes of one file.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.functions.bloom import FILTER, FILTER_ARROW, build, checked, may_hold, sound
from tamis.functions.rows import LEAVES
from tamis.functions.text import Tokenizer, whitespace_lower
from tamis.plans.query import Field, FieldToken, Node, Token, fold, leaves
from tamis.functions.logic import any_true, every_true

RANGES = T.MapType(T.StringType(), T.StructType([T.StructField("min", T.LongType()), T.StructField("max", T.LongType())]))
ROWS = T.StructType([
    T.StructField("partition_id", T.StringType()), T.StructField("block", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("row_json", T.StringType()),
    T.StructField("paths", T.ArrayType(T.StringType())), T.StructField("leaves", LEAVES), T.StructField("ranges", RANGES)])
FILTERS = ("fields", "tokens", "pairs")
_SIZES = [T.StructField("rows", T.LongType()), T.StructField("bytes", T.LongType())]
BLOCKS = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("partition_id", T.StringType()), T.StructField("block", T.LongType()), *_SIZES, T.StructField("ranges", RANGES),
    T.StructField("false_positives", T.DoubleType()), T.StructField("compression", T.StringType()), *[T.StructField(f, FILTER) for f in FILTERS]])
FILES = T.StructType([T.StructField("file", T.StringType()), *_SIZES, T.StructField("blocks", T.LongType()), *[T.StructField(f, FILTER) for f in FILTERS]])
KEY = ["file", "partition_id", "block"]
MOST_HASHES = 64


def file_name() -> Column:
    """segment/name of the Parquet file that a row comes from."""
    return F.substring_index(F.col("_metadata.file_path"), "/", -2)


def words(tokenizer: Tokenizer | None) -> Column:
    """The tokens of every leaf of a row, with its path."""
    split = tokenizer or whitespace_lower
    return F.transform("leaves", lambda leaf: F.struct(leaf["path"].alias("path"), split(leaf["text"]).alias("tokens")))


def entries() -> list[Column]:
    """Hashes of a row with a column `words`, for each of FILTERS; workers keep the distinct ones."""
    tokens = F.flatten(F.transform("words", lambda w: F.transform(w["tokens"], lambda t: F.xxhash64(t))))
    pairs = F.flatten(F.transform("words", lambda w: F.transform(w["tokens"], lambda t: F.xxhash64(w["path"], t))))
    return [F.transform("paths", lambda p: F.xxhash64(p)).alias("fields"), tokens.alias("tokens"), pairs.alias("pairs")]


def _distinct(column: pa.Array) -> np.ndarray:
    return np.unique(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64))


def block_index(rows: DataFrame, tokenizer: Tokenizer | None, ranges: list[str], false_positives: float, compression: str) -> DataFrame:
    """One row a block: BLOCKS, and the distinct hashes as binaries fields_seen, tokens_seen and pairs_seen.

    rows: stored rows as read from their files. ranges: the fields whose ranges blocks keep.
    """
    ends = [F.col("ranges").getItem(f)[end].alias(f"{end}{k}") for k, f in enumerate(ranges) for end in ("min", "max")]
    # Two steps, so that each text is split once.
    split = rows.select(file_name().alias("file"), "partition_id", "block", "bytes", "ranges", "paths", words(tokenizer).alias("words"))
    keyed = split.select(*KEY, "bytes", *ends, *entries())
    names = [f"{end}{k}" for k in range(len(ranges)) for end in ("min", "max")]
    part_kind = pa.schema([("file", pa.string()), ("partition_id", pa.string()), ("block", pa.int64()), ("rows", pa.int64()), ("bytes", pa.int64()), *[(n, pa.int64()) for n in names], *[(f, pa.binary()) for f in FILTERS]])

    def partial(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            runs = np.zeros(batch.num_rows, bool)
            runs[0] = True
            for c in KEY:
                code = batch[c].dictionary_encode().indices.to_numpy(zero_copy_only=False)
                runs[1:] |= code[1:] != code[:-1]
            starts = np.flatnonzero(runs).tolist()
            out = {n: [] for n in part_kind.names}
            for s, e in zip(starts, [*starts[1:], batch.num_rows]):
                part = table.slice(s, e - s).combine_chunks()
                for c in KEY:
                    out[c].append(part[c][0].as_py())
                out["rows"].append(e - s)
                out["bytes"].append(pc.sum(part["bytes"]).as_py())
                for n in names:
                    out[n].append((pc.min if n.startswith("min") else pc.max)(part[n]).as_py())
                for f in FILTERS:
                    out[f].append(_distinct(part[f].combine_chunks() if part[f].num_chunks != 1 else part[f].chunk(0)).tobytes())
            yield pa.RecordBatch.from_pydict(out, part_kind)

    def whole(key, table):
        out = {"file": [key[0].as_py()], "partition_id": [key[1].as_py()], "block": [key[2].as_py()], "rows": [pc.sum(table["rows"]).as_py()], "bytes": [pc.sum(table["bytes"]).as_py()]}
        found = [(f, {"min": low, "max": pc.max(table[f"max{k}"]).as_py()}) for k, f in enumerate(ranges) if (low := pc.min(table[f"min{k}"]).as_py()) is not None]
        out["ranges"] = pa.array([found], pa.map_(pa.string(), pa.struct([("min", pa.int64()), ("max", pa.int64())])))
        out |= {"false_positives": [false_positives], "compression": [compression]}
        for f in FILTERS:
            seen = np.unique(np.concatenate([np.frombuffer(b, np.int64) for b in table[f].to_pylist()]))
            out[f] = pa.array([build(seen, false_positives)], FILTER_ARROW)
            out[f"{f}_seen"] = pa.array([seen.tobytes()], pa.binary())
        return pa.table(out)

    part_schema = ", ".join(f"{n} {'string' if t == pa.string() else 'binary' if t == pa.binary() else 'long'}" for n, t in zip(part_kind.names, part_kind.types))
    schema = T.StructType([*BLOCKS.fields, *[T.StructField(f"{f}_seen", T.BinaryType()) for f in FILTERS]])
    ordered = [f.name for f in schema.fields]
    built = keyed.mapInArrow(partial, part_schema).groupBy(*KEY).applyInArrow(lambda key, t: whole(key, t).select(ordered), schema)
    return built.withColumns({f: checked(F.col(f)) for f in FILTERS})


def file_index(blocks: DataFrame, false_positives: float) -> DataFrame:
    """One row a file, from block_index(): distinct entries of a file aren't the sum of its blocks' entries."""

    def whole(key, table):
        out = {"file": [key[0].as_py()], "rows": [pc.sum(table["rows"]).as_py()], "bytes": [pc.sum(table["bytes"]).as_py()], "blocks": [table.num_rows]}
        for f in FILTERS:
            seen = np.unique(np.concatenate([np.frombuffer(b, np.int64) for b in table[f"{f}_seen"].to_pylist()]))
            out[f] = pa.array([build(seen, false_positives)], FILTER_ARROW)
        return pa.table(out)

    built = blocks.select("file", "rows", "bytes", *[f"{f}_seen" for f in FILTERS]).groupBy("file").applyInArrow(whole, FILES)
    return built.withColumns({f: checked(F.col(f)) for f in FILTERS})


def filters_used(node: Node | None) -> set[str]:
    return {{Field: "fields", Token: "tokens", FieldToken: "pairs"}[type(x)] for x in leaves(node) if isinstance(x, Field | Token | FieldToken)}


def filters_sound(node: Node | None) -> Column:
    """Whether the filters that the tree asks are undamaged."""
    return every_true([F.col(f).isNull() | sound(F.col(f)) for f in sorted(filters_used(node))])


def filters_may_match(node: Node | None) -> Column:
    """The keyword tree over filters; a missing filter rules nothing out."""

    def leaf(x: Node) -> Column:
        if isinstance(x, Field):
            name, entry = "fields", F.xxhash64(F.lit(x.path))
        elif isinstance(x, Token):
            name, entry = "tokens", F.xxhash64(F.lit(x.token))
        elif isinstance(x, FieldToken):
            name, entry = "pairs", F.xxhash64(F.lit(x.path), F.lit(x.token))
        else:
            return F.lit(False)
        return F.col(name).isNull() | may_hold(F.col(name), entry, MOST_HASHES)

    return fold(node, leaf, every_true, any_true, F.lit(True))
