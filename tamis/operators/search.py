"""Search over any DataFrame: its rows are matched in place, without an index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.numeric import range_columns
from tamis.functions.rows import TypedRows, WalkedRows, walked_json
from tamis.functions.text import Tokenizer
from tamis.plans.match import row_filter
from tamis.plans.prefilter import block_column, only_partitions, row_column
from tamis.plans.query import MinMax, Query, leaves


def search(
    df: DataFrame, query: Query, partition: Column | None = None, minmax: Sequence[str] = (), mode: str = "block",
    tokenizer: Tokenizer | None = None, null_fields: str = "keep", json_columns: Sequence[str] = (),
) -> DataFrame:
    """The whole rows of df that the query accepts, in no order.

    partition: names each row's block; without it no row has a partition. minmax: top-level columns whose ranges blocks
    keep. mode: "block" applies the prefilter to blocks, so rows outside a range come along with their block; "row"
    applies it to every row alone. json_columns: string columns that hold JSON objects.
    """
    verdict = row_filter(query, TypedRows(df.schema, null_fields, tuple(json_columns)), tokenizer)
    return prefiltered(df, query, partition, minmax, mode).where(verdict)


def search_json(df: DataFrame, column: str, query: Query, tokenizer: Tokenizer | None = None) -> DataFrame:
    """The rows of df whose JSON object in `column` the query's keywords and regexes accept."""
    walked = df.withColumn("__walked", walked_json(F.col(column)))
    rows = WalkedRows(F.col("__walked.paths"), F.col("__walked.leaves"))
    return walked.where(row_filter(query, rows, tokenizer)).drop("__walked")


def column_ranges(df: DataFrame, minmax: Sequence[str]) -> dict[str, tuple[Column, Column]]:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return {f: ends for f in minmax if f in kinds and (ends := range_columns(F.col(f"`{f}`"), kinds[f])) is not None}


def range_map(ranges: dict[str, tuple[Column, Column]]) -> Column:
    """A map of field to struct<min, max>, without the fields whose value is null."""
    entries = [F.struct(F.lit(f).alias("key"), F.struct(low.alias("min"), high.alias("max")).alias("value")) for f, (low, high) in ranges.items()]
    if not entries:
        return F.map_from_entries(F.array().cast("array<struct<key: string, value: struct<min: bigint, max: bigint>>>"))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"]["min"].isNotNull()))


def partition_blocks(df: DataFrame, partition: Column, minmax: Sequence[str]) -> DataFrame:
    """One block for each partition: partition_id, rows, ranges."""
    ranges = column_ranges(df, minmax)
    ends = [a for f, (low, high) in ranges.items() for a in (F.min(low).alias(f"min {f}"), F.max(high).alias(f"max {f}"))]
    named = df.withColumn("partition_id", F.coalesce(partition.cast("string"), F.lit("")))
    blocks = named.groupBy("partition_id").agg(F.count("*").alias("rows"), *ends)
    own = {f: (F.col(f"`min {f}`"), F.col(f"`max {f}`")) for f in ranges}
    return blocks.select("partition_id", "rows", range_map(own).alias("ranges"))


def prefiltered(df: DataFrame, query: Query, partition: Column | None, minmax: Sequence[str], mode: str) -> DataFrame:
    if query.prefilter is None:
        return df
    if mode not in ("block", "row"):
        raise ValueError("mode is block or row")
    name = None if partition is None else F.coalesce(partition.cast("string"), F.lit(""))
    if mode == "row" or only_partitions(query.prefilter):
        return df.where(row_column(name, column_ranges(df, minmax), query.prefilter))
    wanted = [f for f in minmax if f in {x.field for x in leaves(query.prefilter) if isinstance(x, MinMax)}]
    own = F.lit("") if name is None else name
    blocks = partition_blocks(df, own, wanted)
    live = blocks.where(block_column(F.col("partition_id"), F.col("ranges"), query.prefilter)).select("partition_id")
    return df.withColumn("__partition", own).join(live, F.col("__partition") == F.col("partition_id"), "left_semi").drop("__partition")
