"""An index of JSON rows: batch ingest, pruned queries with statistics, compaction.

Ingest writes rows in blocks of one partition each, computes block and file metadata from what it wrote, and commits
both at once. A query drops files and then blocks by metadata, in Spark, and returns a lazy DataFrame over the rest.
"""

from __future__ import annotations

import base64
import json
import logging
import threading
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from datetime import UTC, date, datetime
from decimal import Decimal
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.functions.rows import TypedRows, WalkedRows, json_ranges, walked_json
from tamis.functions.text import Tokenizer
from tamis.operators.index import BLOCKS, FILES, KEY, ROWS, block_index, file_index, file_name, filters_may_match, filters_sound, filters_used
from tamis.operators.search import column_ranges, range_map
from tamis.plans.match import row_filter
from tamis.plans.prefilter import block_column
from tamis.plans.query import Query, both, regex_guard
from tamis.sources.store import Batch, HadoopStore, State, Store

log = logging.getLogger("tamis")
log.addHandler(logging.NullHandler())


class InvalidConfigError(ValueError):
    pass


class EngineStopped(RuntimeError):
    pass


class BatchRejected(ValueError):
    """A row of the batch isn't a JSON object; nothing of the batch was stored."""


@dataclass(frozen=True)
class Config:
    """Limits are soft: blocks are cut by rows, at the number that max_block_bytes allows for rows of average size.

    partition: gives the partition column of an ingested DataFrame. minmax: top-level fields whose ranges blocks keep.
    The buffer limits hold for ingest_rows(); ingest_buffer_size of its callers may wait at once. max_query_concurrency:
    results that this engine iterates over at once. vacuum_seconds: merges then also delete what no state of so many
    seconds needs. compression: none, snappy or zstd. cache_metadata: keeps the metadata of
    the current state in Spark's cache, for many queries over one state.
    """

    tokenizer: Tokenizer | None = None
    partition: Callable[[DataFrame], Column] | None = None
    minmax: tuple[str, ...] = ()
    max_block_bytes: int = 10 << 20
    max_block_rows: int = 10_000
    max_file_bytes: int = 10 << 30
    max_merged_files: int = 10
    max_buffered_rows: int = 1_000
    max_buffered_bytes: int = 1 << 20
    max_buffered_seconds: float = 10.0
    false_positives: float = 0.001
    compression: str = "snappy"
    zstd_level: int = 3
    null_fields: str = "keep"
    cache_metadata: bool = False
    ingest_buffer_size: int = 1_000
    max_query_concurrency: int = 1_000
    vacuum_seconds: float | None = None

    def __post_init__(self) -> None:
        for name in ("max_block_bytes", "max_block_rows", "max_file_bytes", "max_buffered_rows", "max_buffered_bytes", "max_buffered_seconds", "ingest_buffer_size", "max_query_concurrency"):
            if getattr(self, name) <= 0:
                raise InvalidConfigError(f"{name} must be greater than 0")
        if self.vacuum_seconds is not None and self.vacuum_seconds < 0:
            raise InvalidConfigError("vacuum_seconds must not be negative")
        if self.max_merged_files < 2:
            raise InvalidConfigError("max_merged_files must be at least 2")
        if not 0 < self.false_positives < 1:
            raise InvalidConfigError("false_positives must lie between 0 and 1")
        if self.compression not in ("", "none", "snappy", "zstd"):
            raise InvalidConfigError(f"unknown compression {self.compression!r}")
        if self.compression == "zstd" and not 1 <= self.zstd_level <= 22:
            raise InvalidConfigError("zstd_level must lie between 1 and 22")
        if self.compression == "":
            object.__setattr__(self, "compression", "none")


@dataclass(frozen=True)
class QueryStats:
    """Blocks of files that metadata ruled out are in none of the numbers; a damaged block counts as processed."""

    blocks_processed: int
    blocks_skipped: int
    rows_scanned: int
    bytes_scanned: int
    rows_matched: int | None = None


def json_value(x):
    """What json.dumps() doesn't know: times as RFC 3339 in UTC, bytes as base64, decimals and sets as numbers and lists."""
    if isinstance(x, datetime):
        moment = x.astimezone(UTC) if x.tzinfo else x
        return moment.strftime("%Y-%m-%dT%H:%M:%S") + (f".{moment.microsecond:06d}".rstrip("0") if moment.microsecond else "") + "Z"
    if isinstance(x, date):
        return x.isoformat()
    if isinstance(x, bytes | bytearray):
        return base64.b64encode(x).decode()
    if isinstance(x, Decimal) and x.is_finite():
        return int(x) if x == x.to_integral_value() else float(x)
    if isinstance(x, set | frozenset | tuple):
        return list(x)
    raise TypeError(f"{type(x).__name__} can't be JSON")


class Engine:
    #: Rows that the average row size is taken from, and blocks that a query lists on the driver at most.
    SIZED_ROWS, LISTED_BLOCKS = 1_000, 10_000
    #: Blocks' worth of rows in a piece of a large partition, and partitions of a batch that are cut at most (the largest).
    PIECE_BLOCKS, CUT_PARTITIONS = 4, 10_000
    #: Bytes of metadata that a block has at least.
    BLOCK_METADATA = 400

    def __init__(self, spark: SparkSession, root: str | Store, config: Config | None = None):
        """root: where the index is, in any of Hadoop's file systems, or a store of one's own."""
        self.spark, self.config = spark, config or Config()
        self.store = root if isinstance(root, Store) else HadoopStore(spark, root, self.config.cache_metadata)
        self._buffer: list[tuple[str, Callable | None]] = []
        self._buffered_bytes, self._since, self._stopped = 0, 0.0, False
        self._lock, self._timer, self._merging = threading.RLock(), None, threading.Lock()
        self._waiting, self._reading = threading.BoundedSemaphore(self.config.ingest_buffer_size), threading.BoundedSemaphore(self.config.max_query_concurrency)

    # ---- ingest ----

    def ingest(self, df: DataFrame, batch: Batch | None = None) -> str | None:
        """Stores the rows of typed columns. batch: a name, or a stream and its rising number, under which a repeated batch is stored once only.

        Returns the name of the new segment, None if there is nothing new.
        """
        self._running()
        rows = TypedRows(df.schema, self.config.null_fields)
        text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": str(self.config.null_fields == "drop").lower()}) if df.columns else F.lit("{}")
        ends = column_ranges(df, self.config.minmax)
        return self._ingest(df, text, rows.paths(), rows.leaves(), range_map(ends), batch, next((low for low, _ in ends.values()), None))

    def ingest_json(self, df: DataFrame, column: str, batch: Batch | None = None) -> str | None:
        """Stores JSON objects; any text that isn't one rejects the whole batch. Other columns only serve the partition."""
        self._running()
        return self._ingest_texts(df, column, batch)

    def _ingest_texts(self, df: DataFrame, column: str, batch: Batch | None) -> str | None:
        walked = df.withColumn("__walked", walked_json(F.col(column)))
        refused = F.when(F.col("__walked.error").isNotNull(), F.raise_error(F.concat(F.lit("REFUSED "), F.col("__walked.error"))))
        text = F.coalesce(refused, F.col("__walked.json"))
        return self._ingest(walked, text, F.col("__walked.paths"), F.col("__walked.leaves"), json_ranges(list(self.config.minmax))(F.col(column)), batch)

    def _ingest(self, df: DataFrame, text: Column, paths: Column, leaves: Column, ranges: Column, batch: Batch | None, along: Column | None = None) -> str | None:
        """along: a number by which large partitions are cut into pieces."""
        if batch is not None and self.store.state().has(batch):
            return None
        partition = F.lit("") if self.config.partition is None else F.coalesce(self.config.partition(df).cast("string"), F.lit(""))
        segment = self.store.new_segment()
        try:
            size, sized = df.limit(self.SIZED_ROWS).agg(F.avg(F.octet_length(text).cast("long") + 4), F.count("*")).first()
            if size is None:
                if batch is not None:
                    self.store.commit(batch=batch)
                return None
            per_block = max(1, min(self.config.max_block_rows, int(self.config.max_block_bytes / size)))
            # Adaptive execution deals pieces out by size and gathers the small ones. Rows move as they came in; what is
            # several times their size is made where they end up.
            pieces = df.withColumns({"__partition": partition, "__piece": F.lit(0).cast("long")}) if sized < self.SIZED_ROWS else self._in_pieces(df, partition, per_block, along)
            dealt = pieces.hint("rebalance", "__partition", "__piece").sortWithinPartitions("__partition", "__piece")
            place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
            rows = dealt.select(F.col("__partition").alias("partition_id"), F.floor(place / per_block).alias("block"), text.alias("row_json"), paths.alias("paths"), leaves.alias("leaves"), ranges.alias("ranges"))
            return self._publish(segment, rows.withColumn("bytes", F.octet_length("row_json").cast("long") + 4), list(self.config.minmax), batch=batch)
        except Exception as e:
            self.store.drop_segment(segment)
            if "REFUSED " in str(e):
                raise BatchRejected(str(e).split("REFUSED ")[1].split("\n")[0][:300]) from None
            raise

    def _in_pieces(self, df: DataFrame, partition: Column, per_block: int, along: Column | None) -> DataFrame:
        """df with __partition and __piece: a large partition is cut, so that a few of them, or one, keep all cores busy.

        Adaptive execution alone splits by bytes that are shuffled, which say little of the work behind the shuffle. Pieces
        are ranges of `along`, so blocks keep narrow ranges, or else shares by hash; both depend on nothing but the row.
        """
        named, most = df.withColumns({"__partition": partition, "__along": F.lit(None).cast("double") if along is None else along.cast("double")}), self.PIECE_BLOCKS * per_block
        # Reads what the partition and `along` come from.
        sizes = named.groupBy("__partition").agg(F.count("*").alias("n"), F.min("__along").alias("low"), F.max("__along").alias("high")).where(F.col("n") > most)
        large = [(r[0], -(-r.n // most), r.low, r.high) for r in sizes.orderBy(F.desc("n")).limit(self.CUT_PARTITIONS).collect()]
        if not large:
            return df.withColumns({"__partition": partition, "__piece": F.lit(0).cast("long")})
        listed = F.from_json(F.lit(json.dumps([dict(zip("pklh", x)) for x in large])), "array<struct<p: string, k: bigint, l: double, h: double>>")
        plan = F.broadcast(self.spark.range(0, 1, 1, 1).select(F.inline(listed)))  # CUT_PARTITIONS rows at most
        plain = [F.col("`" + f.name.replace("`", "``") + "`") for f in df.schema.fields if not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType | T.VariantType)]
        share = F.pmod(F.xxhash64(*plain), F.col("k")) if plain else F.lit(0).cast("long")
        part = F.floor((F.col("__along") - F.col("l")) / (F.col("h") - F.col("l")) * F.col("k"))
        piece = F.when(F.col("k").isNull(), 0).when(F.col("__along").isNotNull() & (F.col("h") > F.col("l")), F.greatest(F.lit(0), F.least(part, F.col("k") - 1))).otherwise(share)
        return named.join(plan, F.col("__partition") == F.col("p"), "left").withColumn("__piece", piece.cast("long")).drop("__along", *"pklh")

    def _publish(self, segment: str, rows: DataFrame, ranges: list[str], batch: Batch | None = None, remove: frozenset = frozenset(), emptied: tuple[str, ...] = ()) -> str:
        """Writes rows and their metadata, and commits. rows are in order within each task, a file a task."""
        config, store = self.config, self.store
        write = rows.select(*ROWS.fieldNames()).write.option("compression", config.compression)
        if config.compression == "zstd":
            write = write.option("parquet.compression.codec.zstd.level", config.zstd_level)
        write.parquet(store.path("rows", segment))
        stored = self.spark.read.schema(ROWS).parquet(store.path("rows", segment))
        seen = store.path("_building", segment)
        block_index(stored, config.tokenizer, ranges, config.false_positives, config.compression).write.parquet(seen)
        indexed = self.spark.read.parquet(seen)
        indexed.select(*BLOCKS.fieldNames()).write.parquet(store.path("blocks", segment))
        file_index(indexed, config.false_positives).write.parquet(store.path("files", segment))
        store.delete(seen)
        store.commit((segment,), remove, batch, emptied)
        return segment

    def ingest_rows(self, rows: Sequence[dict], done: Callable[[Exception | None], None] | None = None) -> None:
        """Takes rows into the buffer, which is stored when it is large or old enough, or on flush().

        A row that can't be JSON rejects these rows at once. done is called when they are stored, or with what failed.
        """
        self._running()
        try:
            texts = [json.dumps(r, allow_nan=False, ensure_ascii=False, default=json_value) for r in rows]
        except (TypeError, ValueError) as e:
            raise BatchRejected(str(e)) from None
        if not texts:
            if done is not None:
                done(None)
            return
        with self._waiting, self._lock:
            if not self._buffer:
                self._since = time.monotonic()
                self._timer = threading.Timer(self.config.max_buffered_seconds, self._aged)
                self._timer.daemon = True
                self._timer.start()
            self._buffer += [*((t, None) for t in texts[:-1]), (texts[-1], done)]
            self._buffered_bytes += sum(len(t.encode()) + 4 for t in texts)
            self.tick()

    def _aged(self) -> None:
        try:
            self.tick()
        except Exception:
            log.exception("the buffer couldn't be stored")  # its callbacks know

    def tick(self) -> None:
        """Stores the buffer if it is due."""
        with self._lock:
            config, n = self.config, len(self._buffer)
            due = n and (n >= min(config.max_buffered_rows, config.max_block_rows) or self._buffered_bytes >= min(config.max_buffered_bytes, config.max_block_bytes) or time.monotonic() - self._since >= config.max_buffered_seconds)
            if due:
                self.flush()

    def flush(self) -> None:
        """Returns when all rows taken before are stored. If that fails, they are dropped and all callbacks get the error."""
        with self._lock:
            held, self._buffer, self._buffered_bytes = self._buffer, [], 0
            if self._timer is not None:
                self._timer.cancel()
            if not held:
                return
            failed: Exception | None = None
            try:
                self._ingest_texts(self.spark.createDataFrame([(t,) for t, _ in held], "row string"), "row", None)
            except Exception as e:
                failed = e
        for _, done in held:
            if done is not None:
                done(failed)
        if failed is not None:
            raise failed

    def stop(self, timeout: float | None = None) -> None:
        """Stores what is buffered; nothing can be ingested afterwards. After timeout seconds TimeoutError says that storing goes on."""
        if self._stopped:
            return
        self._stopped = True
        if timeout is None:
            return self.flush()
        failed: list[Exception] = []

        def last() -> None:
            try:
                self.flush()
            except Exception as e:
                failed.append(e)

        storing = threading.Thread(target=last, daemon=True)
        storing.start()
        storing.join(timeout)
        if storing.is_alive():
            raise TimeoutError(f"rows are still being stored after {timeout} seconds")
        if failed:
            raise failed[0]

    def _running(self) -> None:
        if self._stopped:
            raise EngineStopped("the engine was stopped")

    # ---- metadata ----

    def blocks(self) -> DataFrame:
        return self.store.table("blocks", self.store.state(), BLOCKS)

    def files(self) -> DataFrame:
        return self.store.table("files", self.store.state(), FILES)

    def blocks_bytes(self, state: State) -> int:
        """Size of the stored block metadata, from the listing that a query of it makes anyway."""
        return int(str(self.store.table("blocks", state, BLOCKS)._jdf.queryExecution().analyzed().stats().sizeInBytes())) if state.segments else 0

    def block_filters(self, file: str, partition: str, block: int) -> DataFrame:
        """The filters of one block, for tools."""
        return self.blocks().where((F.col("file") == file) & (F.col("partition_id") == partition) & (F.col("block") == block)).select("fields", "tokens", "pairs")

    # ---- queries ----

    def query(self, query: Query | None = None) -> Results:
        """Bad patterns raise here. Statistics and rows are computed when asked for."""
        return Results(self, query or Query())

    def merge(self):
        """One round of compaction; see operators.merge."""
        from tamis.operators.merge import MergeInProgress, merge

        if not self._merging.acquire(blocking=False):
            raise MergeInProgress("this engine is merging")
        try:
            return merge(self)
        finally:
            self._merging.release()

    def vacuum(self, older_than: float = 7 * 86_400.0) -> list[str]:
        """Deletes files that no state of the last older_than seconds needs. Results that are older than that can't be read any more."""
        return self.store.vacuum(older_than)


class Results:
    """Rows that a query accepts, and what it cost. The state of the index is that of the query's start."""

    def __init__(self, engine: Engine, query: Query):
        self.engine, self.query, self.state = engine, query, engine.store.state()
        self._filter = row_filter(query, WalkedRows(F.col("paths"), F.col("leaves")), engine.config.tokenizer)
        self._guard = both(query.keywords, regex_guard(query.regex))
        self._failures: list[str] = []
        self._closed, self._tag = False, f"tamis-{uuid.uuid4().hex}"

    def candidates(self) -> DataFrame:
        """Blocks of files that metadata doesn't rule out: their KEY, rows, bytes, kept and damaged."""
        store, filters = self.engine.store, sorted(filters_used(self._guard))
        blocks = store.table("blocks", self.state, BLOCKS).where(block_column(F.col("partition_id"), F.col("ranges"), self.query.prefilter))
        if self._guard is None:
            return blocks.select(*KEY, "rows", "bytes", F.lit(True).alias("kept"), F.lit(False).alias("damaged"))
        # A file whose own filters are damaged is passed over.
        files = store.table("files", self.state, FILES).select("file", *filters)
        files = files.where(filters_sound(self._guard) & filters_may_match(self._guard)).select("file")
        blocks = blocks.join(files, "file", "left_semi")
        damaged = ~filters_sound(self._guard)
        return blocks.select(*KEY, "rows", "bytes", (damaged | filters_may_match(self._guard)).alias("kept"), damaged.alias("damaged"))

    def block_stats(self) -> DataFrame:
        """One row for each candidate block: file, partition_id, block, total_rows, total_bytes, skipped, rows_scanned, bytes_scanned."""
        scanned = F.col("kept") & ~F.col("damaged")
        numbers = [F.when(scanned, F.col(c)).otherwise(0).alias(f"{c}_scanned") for c in ("rows", "bytes")]
        return self.candidates().select(*KEY, F.col("rows").alias("total_rows"), F.col("bytes").alias("total_bytes"), (~F.col("kept")).alias("skipped"), *numbers)

    @cached_property
    def _plan(self) -> tuple[QueryStats, list | None, list]:
        """Statistics, the kept blocks if they are few, the damaged ones."""
        most, found = self.engine.LISTED_BLOCKS, self.candidates().select(*KEY, "rows", "bytes", "kept", "damaged")
        if self.engine.blocks_bytes(self.state) <= most * self.engine.BLOCK_METADATA:
            # So little metadata has no more blocks than may be listed: one job answers all.
            rows = found.collect()
            live = [r for r in rows if r.kept and not r.damaged]
            stats = QueryStats(sum(r.kept for r in rows), sum(not r.kept for r in rows), sum(r.rows for r in live), sum(r.bytes for r in live))
            return stats, [tuple(r)[:3] for r in live], [tuple(r)[:3] for r in rows if r.damaged]
        live = F.col("kept") & ~F.col("damaged")
        totals = found.agg(F.count_if("kept"), F.count_if(~F.col("kept")), F.sum(F.when(live, F.col("rows"))), F.sum(F.when(live, F.col("bytes"))), F.count_if("damaged")).first()
        stats = QueryStats(totals[0], totals[1], totals[2] or 0, totals[3] or 0)
        damaged = [tuple(r) for r in self.damaged_blocks().collect()] if totals[4] else []
        return stats, [tuple(r)[:3] for r in found.where(live).collect()] if totals[0] <= most else None, damaged

    def damaged_blocks(self) -> DataFrame:
        """The blocks whose filters can't be trusted, by KEY."""
        return self.candidates().where("damaged").select(*KEY)

    @property
    def errors(self) -> list[str]:
        """All blocks that couldn't be used, and what broke an iteration; the rows of all other blocks are there."""
        return [*(f"damaged filters of block {block} of {file}" for file, _, block in self._plan[2]), *self._failures]

    def _stored(self) -> DataFrame:
        spark, store = self.engine.spark, self.engine.store
        listed = self._plan[1]
        if listed is not None:
            if not listed:
                return spark.createDataFrame([], ROWS)
            rows = spark.read.schema(ROWS).parquet(*sorted({store.path("rows", f) for f, _, _ in listed}))
            parts = sorted({p for _, p, _ in listed})
            if len(parts) <= 200:
                rows = rows.where(F.coalesce("partition_id", F.lit("")).isin(parts))
            wanted = F.broadcast(spark.createDataFrame(listed, "f string, p string, b long"))  # LISTED_BLOCKS rows at most
        else:
            rows = spark.read.schema(ROWS).parquet(*[store.path("rows", s) for s in self.state.segments])
            wanted = self.candidates().where("kept and not damaged").select(F.col("file").alias("f"), F.col("partition_id").alias("p"), F.col("block").alias("b"))
        return rows.withColumn("__file", file_name()).join(wanted, (F.col("__file") == F.col("f")) & (F.col("partition_id") == F.col("p")) & (F.col("block") == F.col("b")), "left_semi")

    @cached_property
    def rows(self) -> DataFrame:
        """partition_id and row_json of every accepted row, in no order."""
        return self._stored().where(self._filter).select("partition_id", "row_json")

    def typed(self, schema: T.StructType | str) -> DataFrame:
        """The accepted rows in columns."""
        return self.rows.select(F.from_json("row_json", schema).alias("r")).select("r.*")

    def __iter__(self):
        """Each accepted row as a dict, as it comes in. Ends early once the results are closed."""
        spark = self.engine.spark
        with self.engine._reading:
            spark.addTag(self._tag)
            try:
                for r in [] if self._closed else self.rows.select("row_json").toLocalIterator(prefetchPartitions=True):
                    if self._closed:
                        return
                    yield json.loads(r.row_json)
            except Exception as e:
                if self._closed:
                    return
                self._failures.append(str(e).splitlines()[0][:200])
                raise
            finally:
                spark.removeTag(self._tag)

    def close(self) -> None:
        """Stops iterations over these results and the jobs that serve them. Other uses of `rows` go on."""
        self._closed = True
        self.engine.spark.interruptTag(self._tag)

    def __enter__(self) -> Results:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def partial(self) -> tuple[list[dict], list[str]]:
        """All rows that can be read, and what couldn't: if a file is broken, files are read one by one."""
        try:
            return list(self), self.errors
        except Exception:
            log.warning("a query failed and reads its files one by one")
            self._failures.pop()
        out, failed = [], self.errors
        stats, listed, _ = self._plan
        live = self.candidates().where(F.col("kept") & ~F.col("damaged")).select(*KEY)
        for file in sorted({f for f, _, _ in listed} if listed is not None else {r.file for r in live.select("file").distinct().collect()}):
            one = Results(self.engine, self.query)
            one.__dict__["_plan"] = (stats, [b for b in listed if b[0] == file] if listed is not None else [tuple(r) for r in live.where(F.col("file") == file).collect()], [])
            try:
                out += list(one)
            except Exception as e:
                failed.append(f"{file}: {str(e).splitlines()[0][:200]}")
        return out, failed

    def stats(self, matched: bool = False) -> QueryStats:
        """matched: also counts the accepted rows, which runs the query."""
        stats = self._plan[0]
        return replace(stats, rows_matched=self.rows.count()) if matched else stats
