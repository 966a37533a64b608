"""Token ids in sorted-string-table shards.

A shard holds documents in order of their key (the id, big-endian with the sign bit flipped, so that bytes sort like
numbers; null ids first). Entries are packed into blocks: the length of the prefix shared with the key before, the rest
of the key, the ids. Every block is compressed and carries a checksum. Behind the blocks stand a sparse index (first key
and place of every block), a Bloom filter over the keys, and a footer with the places of both, so that a lookup reads
the footer once and then one block, found by binary search.

write_tokens() deals documents into ranges of ids, one shard a task, written under a temporary name and renamed when
whole: a task that runs again replaces its shard by an equal one. Texts are encoded with the tokenizers library; words
behind single spaces are encoded once a batch, as the byte-level pattern never joins across these.

Cases: null and empty texts have the end id alone. Repeated rows are entries of their own under one key, in order of
their texts; lookup() returns all of them. An empty table gives no rows. Special tokens' strings are ordinary text.
"""

from __future__ import annotations

import os
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tamis.llm.shared import Runs, chunked, new_folder, partitions, read, staged, strings

MAGIC, BLOCK_BYTES, BLOOM_BITS, BLOOM_HASHES = b"TAMSST01", 1 << 16, 10, 7
#: Ids that a shard takes about; a document stays whole.
SHARD_TOKENS = 1 << 25
#: Texts where white space meets a space, or one stands at an end: these are encoded whole.
SPACED = r" [\s\pZ\x{85}\x0b]|[\s\pZ\x{85}\x0b] |^ | $"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def tokenizer(model: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(model)
    t.encode_special_tokens = True
    n = t.get_vocab_size()
    spaced = np.array([(t.id_to_token(i) or "").startswith("Ġ") for i in range(n)])
    return t, spaced, Runs()


def encode_texts(model: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of texts (large strings) and how many each has."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t, spaced, known = tokenizer(model)
    odd = pc.or_(pc.match_substring_regex(texts, SPACED), pc.equal(texts, "")).to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    # The first word of a text has no space before it and is encoded for itself.
    first = np.zeros(len(flat), bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    coded = flat.filter(pa.array(~first)).dictionary_encode()

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        many = [" " + " ".join(words[k : k + 4096]) for k in range(0, len(words), 4096)]
        ids = np.concatenate([np.array(e.ids, np.int32) for e in t.encode_batch_fast(many, add_special_tokens=False)])
        sizes = np.diff(np.append(np.flatnonzero(spaced[ids]), len(ids)))
        if len(sizes) != len(words):
            # The model parts words at other places than spaces: each word for itself.
            each = [np.array(e.ids, np.int32) for e in t.encode_batch_fast([" " + w for w in words], add_special_tokens=False)]
            return np.concatenate(each), np.array([len(x) for x in each], np.int64)
        return ids, sizes

    ids, word_first, sizes = known.of(coded.dictionary, encode)
    starts = flat.filter(pa.array(first)).to_pylist()
    whole = texts.filter(pa.array(odd)).to_pylist()
    lone = t.encode_batch_fast([*whole, *[s for s, o in zip(starts, odd) if not o]], add_special_tokens=False)
    lone = [np.array(e.ids, np.int32) for e in lone]
    odd_at, even_at = np.flatnonzero(odd), np.flatnonzero(~odd)
    # One run of ids for every lone piece and every later word, then all runs in the order of texts.
    runs = np.concatenate([ids, *lone]) if lone else ids
    lone_sizes = np.array([len(x) for x in lone], np.int64)
    lone_first = len(ids) + np.cumsum(lone_sizes) - lone_sizes
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.concatenate([odd_at, even_at, np.repeat(np.arange(len(texts)), np.where(odd, 0, np.maximum(counts - 1, 0)))])
    keep = np.repeat(~odd, np.maximum(counts - 1, 0))
    begin, size = np.concatenate([lone_first, word_first[index[keep]]]), np.concatenate([lone_sizes, sizes[index[keep]]])
    by = np.argsort(owner, kind="stable")
    begin, size = begin[by], size[by]
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return runs[at], np.bincount(owner[by], size, len(texts)).astype(np.int64)


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


class Bloom:
    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(hashes: np.ndarray, size: int) -> np.ndarray:
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        return (hashes[:, None] + step[:, None] * np.arange(BLOOM_HASHES, dtype=np.uint64)) % np.uint64(size)

    @classmethod
    def build(cls, hashes: list[int]) -> Bloom:
        size = max(64, -(-len(hashes) * BLOOM_BITS // 8) * 8)
        bits = np.zeros(size, np.uint8)
        bits[cls.places(np.array(hashes, np.uint64), size).ravel()] = 1
        return cls(np.packbits(bits))

    def may_hold(self, key: bytes) -> bool:
        at = self.places(np.array([xxh3_64_intdigest(key)], np.uint64), len(self.bits) * 8)[0].astype(np.int64)
        return bool((self.bits[at >> 3] >> (7 - (at & 7)) & 1).all())


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            return n, at


class Writer:
    def __init__(self, stream, width: int):
        self.stream, self.width, self.at = stream, width, 0
        self.block, self.last, self.first = bytearray(), b"", None
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes: list[int] = []
        self.docs = self.tokens = 0
        self.packer = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if key < self.last and self.docs:
            raise ValueError("keys must ascend")
        if self.first is None:
            self.first, shared = key, 0
        else:
            shared = len(os.path.commonprefix([self.last, key]))
        rest = key[shared:]
        self.block += varint(shared) + varint(len(rest)) + rest + varint(len(ids)) + ids.astype(f"<u{self.width}").tobytes()
        if not self.docs or key != self.last:
            self.hashes.append(xxh3_64_intdigest(key))
        self.last = key
        self.docs += 1
        self.tokens += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.first is None:
            return
        packed = self.packer.compress(bytes(self.block))
        packed += struct.pack("<I", zlib.crc32(packed))
        self.index.append((self.first, self.at, len(packed)))
        self.stream.write(packed)
        self.at += len(packed)
        self.block, self.first = bytearray(), None

    def close(self) -> None:
        self.flush()
        index = b"".join(varint(len(k)) + k + varint(o) + varint(n) for k, o, n in self.index)
        bloom = Bloom.build(self.hashes).bits.tobytes()
        self.stream.write(index + bloom)
        self.stream.write(struct.pack("<QQQQQB", self.at, len(index), len(bloom), self.docs, self.tokens, self.width) + MAGIC)
        self.stream.close()


class Reader:
    """Reads a shard from a random-access file; lookups hold the index and the filter, scans one block at a time."""

    FOOTER = struct.calcsize("<QQQQQB") + len(MAGIC)

    def __init__(self, file):
        self.file = file
        size = file.size()
        foot = file.read_at(self.FOOTER, size - self.FOOTER)
        if foot[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a token shard")
        at, n, bloom, self.docs, self.tokens, self.width = struct.unpack("<QQQQQB", foot[: -len(MAGIC)])
        data, self.index, p = file.read_at(n + bloom, at), [], 0
        while p < n:
            k, p = read_varint(data, p)
            key = data[p : p + k]
            offset, p = read_varint(data, p + k)
            length, p = read_varint(data, p)
            self.index.append((key, offset, length))
        self.bloom = Bloom(np.frombuffer(data[n:], np.uint8))

    def block(self, k: int):
        _, offset, length = self.index[k]
        packed = self.file.read_at(length, offset)
        if zlib.crc32(packed[:-4]) != struct.unpack("<I", packed[-4:])[0]:
            raise ValueError(f"block {k} is damaged")
        data, at, key = zstandard.ZstdDecompressor().decompress(packed[:-4]), 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            n, at = read_varint(data, at)
            key, at = key[:shared] + data[at : at + n], at + n
            n, at = read_varint(data, at)
            yield key, np.frombuffer(data, f"<u{self.width}", n, at)
            at += n * self.width

    def __iter__(self):
        for k in range(len(self.index)):
            yield from self.block(k)

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry under doc_id."""
        key = key_of(doc_id)
        if not self.index or not self.bloom.may_hold(key):
            return []
        low, high = 0, len(self.index)  # the last block that starts before the key, or the first that starts with it
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.index[mid][0] < key else (low, mid)
        out = []
        for k in range(max(0, low - 1), len(self.index)):
            if self.index[k][0] > key:
                break
            out += [ids for found, ids in self.block(k) if found == key]
        return out


def place(uri: str):
    """The file system of a URI, and the path in it."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_tokens(docs: DataFrame, folder: str, model: str | None = None, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes shards into folder (a URI that all executors reach). One row a shard: shard, path, n_docs, n_tokens.

    A task starts a new shard once one has shard_tokens ids, so that index and filter of a shard stay small.
    """
    spark = docs.sparkSession
    with open(model or vocabulary_path(), encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())  # a megabyte and a half
    system, path = place(folder)
    system.create_dir(path, recursive=True)
    n = partitions(spark)
    dealt = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        model, writer, task = sent.value, None, TaskContext.get()
        t, *_ = tokenizer(model)
        system, top = place(folder)
        part = 0

        def name() -> str:
            return f"shard-{task.partitionId():06d}-{part:06d}.sst"

        def closed() -> pa.RecordBatch:
            writer.close()
            system.move(f"{top}/{name()}.{task.taskAttemptId()}.tmp", f"{top}/{name()}")
            return pa.RecordBatch.from_pydict({"shard": np.array([task.partitionId() << 32 | part]), "path": [f"{folder}/{name()}"], "n_docs": np.array([writer.docs]), "n_tokens": np.array([writer.tokens])})

        for table in chunked(batches, 20 << 20):
            ids, sizes = encode_texts(model, strings(table["text"]))
            at = 0
            for doc, size in zip(table["doc_id"].to_pylist(), sizes.tolist()):
                if writer is None:
                    writer = Writer(system.open_output_stream(f"{top}/{name()}.{task.taskAttemptId()}.tmp"), 2 if t.get_vocab_size() <= 1 << 16 else 4)
                writer.add(key_of(doc), np.append(ids[at : at + size], end_id))
                at += size
                if writer.tokens >= shard_tokens:
                    yield closed()
                    writer, part = None, part + 1
        if writer is not None:
            yield closed()

    return staged(dealt.mapInArrow(run, "shard long, path string, n_docs long, n_tokens long"), "shards")


def read_tokens(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids of every entry of the shards, in their order."""
    # One row a shard: as many as tasks wrote.
    starts = shards.withColumn("before", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def run(batches):
        for batch in batches:
            for path, before in zip(batch["path"].to_pylist(), batch["before"].to_pylist()):
                system, name = place(path)
                with system.open_input_file(name) as file:
                    held, size = [], 0
                    for key, ids in Reader(file):
                        held.append((id_of(key), before, ids.astype("<u4")))
                        before += len(ids)
                        size += len(ids)
                        if size > 1 << 20:
                            yield entries(held)
                            held, size = [], 0
                    if held:
                        yield entries(held)

    def entries(rows):
        return pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "start": pa.array([r[1] for r in rows], pa.int64()), "ids": pa.array([r[2].tobytes() for r in rows], pa.binary())})

    n = partitions(shards.sparkSession)
    return starts.repartition(n, "shard").mapInArrow(run, "doc_id long, start long, ids binary")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write_tokens(read(spark, sf_dir, "documents"), new_folder(spark, "tokens"))
    entries = read_tokens(shards)
    return entries.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
