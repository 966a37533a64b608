"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints that differ in few bits agree on some masked bit patterns: the 64 bits are cut into k + r blocks, and two
fingerprints at distance <= k share the bits of at least r whole blocks. Each choice of r blocks is one mask. Under a
mask, the shared pattern is the root of a tree over all its fingerprints, be they two or thousands: they are sorted by
Gray rank, so that neighbours share further bits, and every FAN neighbours have a node that factors these out as a mask
and a pattern. A walk from the root over pairs of nodes counts the differing shared bits, which only grow further down,
and drops two whole groups as soon as they exceed k; at the leaves the count is the distance.

Only distinct fingerprints are compared, so copies cost nothing. A class is told by links to its least fingerprint, never
by all pairs, and pairs of groups within one class are skipped. A pattern with more than CELL fingerprints is cut into
slices, and every pair of slices is a task of its own, so nothing is left out and no task holds an unbounded group.

Cases: a null, empty or blank text has fingerprint zero, and such rows link like any others. Texts with fewer words
than a shingle are one shingle. Rows with a null id take part and get the least non-null id of their component
(null if there is none). Repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_digest

from tamis.llm.components import components
from tamis.llm.shared import LOWER, chunked, kept, partitions, read, staged, strings

#: Fingerprints of one pattern that one task compares at most.
CELL = 16_384
#: Children of a node; pairs of nodes that are walked at once; rows that a task walks at once.
FAN, PAIRS, BATCH = 8, 1 << 15, 1 << 16
#: Rows of large patterns that are broadcast at most; beyond it they are joined by sorting.
LISTED = 10_000


def shingle_hashes(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """(shingles, 8) bytes: the hash of every shingle in order, none for a text without words."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros((0, 8), np.uint8)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = max(0, len(words) - shingle)
    spans = zip(starts[: k + 1].tolist(), ends[len(words) - 1 - k :].tolist())
    return np.frombuffer(b"".join([xxh64_digest(joined[s:e], seed) for s, e in spans]), np.uint8).reshape(-1, 8)


def fingerprint(text: bytes, shingle: int, seed: int = 42) -> int:
    hashes = shingle_hashes(text, shingle, seed)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = 4) -> DataFrame:
    """The columns in keep and fp, the fingerprint as a signed long."""
    docs = docs.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("fp", T.LongType())])

    def run(batches):
        for table in chunked(batches, 16 << 20):
            texts = strings(table["__text"])
            offsets, data = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1], texts.buffers()[2]
            data = data.to_pybytes() if data is not None else b""
            fps = [fingerprint(data[s:e], shingle) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield from pa.table({c: table[c] for c in keep} | {"fp": np.array(fps, np.uint64).view(np.int64)}).to_batches()

    return docs.mapInArrow(run, schema)


def masks(bits: int, blocks: int) -> list[int]:
    """All choices of blocks - bits of the blocks that 64 bits are cut into: pairs at distance <= bits agree under one."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [sum(c) for c in combinations(parts, blocks - bits)]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class Classes:
    """Union-find over positions, with the labels of all positions at hand as an array."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.label[a], self.label[b]
        if not (apart := a != b).any():
            return
        pairs = np.unique(np.stack([np.minimum(a, b)[apart], np.maximum(a, b)[apart]], 1), axis=0)
        up: dict[int, int] = {}

        def top(x):
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for x, y in pairs.tolist():
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        to = np.arange(len(self.label))
        for x in up:
            to[x] = top(x)
        self.label = to[self.label]


def levels_of(group: np.ndarray, fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The trees of all groups, leaves first: (pattern, mask, first child, behind last child) of the nodes of each level.

    group and fps are in order of group and Gray rank. A node holds FAN children of one group; mask has the bits in which
    all below it agree, pattern their values. The last level has one node a group.
    """
    ones, zeros = fps, ~fps
    out = [(ones, ones | zeros, np.arange(len(fps)), np.arange(1, len(fps) + 1))]
    while True:
        new = np.concatenate([[True], group[1:] != group[:-1]])
        if len(out) > 1 and new.all():
            return out
        place = np.arange(len(group)) - np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))
        at = np.flatnonzero(place % FAN == 0)
        ends = np.append(at[1:], len(group))
        ones, zeros, group = np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at), group[at]
        out.append((ones, ones | zeros, at, ends))


def link_groups(group: np.ndarray, fps: np.ndarray, bits: int, seen: Counter | None = None) -> np.ndarray:
    """Class label (the position of a member) of each fingerprint: members of a group link at distance <= bits.

    group and fps are in order of group and Gray rank. seen: counts pairs of nodes met and dropped at each level.
    """
    levels, classes = levels_of(group, fps), Classes(len(fps))
    roots = np.arange(len(levels[-1][0]))
    stack = [(len(levels) - 1, np.stack([roots, roots], 1))]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > PAIRS:
            stack += [(depth, pairs[PAIRS:]), (depth, pairs[:PAIRS])]
            continue
        _, _, first, last = levels[depth]
        if depth == 1 and len(pairs) > 1:
            # Groups that are one class already have nothing to add.
            low, high = np.minimum.reduceat(classes.label, first), np.maximum.reduceat(classes.label, first)
            pairs = pairs[~((low[pairs] == high[pairs]).all(1) & (low[pairs[:, 0]] == low[pairs[:, 1]]))]
            if not len(pairs):
                continue
        left, right = pairs.T
        n_left, n_right = last[left] - first[left], last[right] - first[right]
        n = n_left * n_right
        owner = np.repeat(np.arange(len(pairs)), n)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        i, j = first[left][owner] + within // n_right[owner], first[right][owner] + within % n_right[owner]
        apart = i < j if depth == 1 else i <= j
        i, j = i[apart], j[apart]
        pattern, mask, _, _ = levels[depth - 1]
        near = np.bitwise_count((pattern[i] ^ pattern[j]) & mask[i] & mask[j]) <= bits
        if seen is not None:
            seen.update({("met", depth - 1): len(i), ("dropped", depth - 1): int((~near).sum())})
        i, j = i[near], j[near]
        if depth == 1:
            classes.join(i, j)
        elif len(i):
            stack.append((depth - 1, np.stack([i, j], 1)))
    return classes.label


def link_fingerprints(distinct: DataFrame, fp: str = "fp", bits: int = 4, cell: int = CELL) -> DataFrame:
    """Links (a, b) that span every class of fingerprints at distance <= bits under one of the masks.

    distinct: one row a fingerprint. The number of blocks follows the number of fingerprints, so that a pattern has
    few of them at any size; every choice is exact.
    """
    spark, n = distinct.sparkSession, distinct.count()
    blocks = next(b for b in range(bits + 1, 65) if b == 64 or 2 ** (64 * (b - bits) // b) >= n / 2048)
    table = masks(bits, blocks)
    signed = [m - (1 << 64) if m >> 63 else m for m in table]
    rows = distinct.select(F.col(fp).alias("fp"), F.posexplode(F.array(*[F.lit(m) for m in signed])).alias("mask", "m")).select("fp", "mask", F.col("fp").bitwiseAND(F.col("m")).alias("pattern"))
    # Patterns above the cell size, which only an adversary or an enormous family of variants makes, are cut up.
    # Counts are summed before they move, so a hot pattern gathers nowhere; in most data no pattern is large.
    large = rows.groupBy("mask", "pattern").agg(F.count("*").alias("members")).where(F.col("members") > cell)
    large = staged(large.select("mask", "pattern", F.ceil(F.col("members") / (cell // 2)).cast("int").alias("slices")), "patterns")
    n_large = large.count()
    if n_large:
        rows = rows.join(F.broadcast(large) if n_large <= LISTED else large.hint("merge"), ["mask", "pattern"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
        # A slice is drawn by hash; each pair of slices meets in one cell.
        own = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
        rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        rows = rows.select("fp", "mask", "pattern", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    else:
        rows = rows.select("fp", "mask", "pattern", F.lit(0).alias("i"), F.lit(0).alias("j"))
    cells = rows.repartition(partitions(spark), "mask", "pattern", "i", "j").sortWithinPartitions("mask", "pattern", "i", "j", "fp")

    def close(rows: np.ndarray) -> pa.RecordBatch | None:
        """Links of whole cells, each from a member to the least of its class."""
        rows = rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])]
        group, fps = np.cumsum(np.concatenate([[0], (rows[1:, :4] != rows[:-1, :4]).any(1)])), rows[:, 4].view(np.uint64)
        size = np.bincount(group)
        more = size[group] > 1
        group, fps = group[more], fps[more]
        if not len(fps):
            return None
        by = np.lexsort((gray_rank(fps), group))
        group, fps = group[by], fps[by]
        label = link_groups(group, fps, bits)
        least = fps.view(np.int64).copy()
        np.minimum.at(least, label, fps.view(np.int64))
        least, own = least[label], fps.view(np.int64)
        far = least != own
        return pa.RecordBatch.from_pydict({"a": own[far], "b": least[far]}) if far.any() else None

    def run(batches):
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([batch[c].to_numpy().astype(np.int64) for c in ("mask", "pattern", "i", "j", "fp")], 1))
            size += batch.num_rows
            # The last cell may go on in the next batch.
            if size < BATCH or (held[0][0, :4] == held[-1][-1, :4]).all():
                continue
            rows = np.concatenate(held)
            cut = int(np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(1))[-1]) + 1
            held, size = [rows[cut:]], len(rows) - cut
            if (got := close(rows[:cut])) is not None:
                yield got
        if held and (got := close(np.concatenate(held))) is not None:
            yield got

    return cells.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, shingle: int = 4, bits: int = 4) -> DataFrame:
    """One row a document: the columns in keep, fp, fingerprint (hex) and component_id, the least id of its component."""
    keep = kept(keep if keep is not None else [doc_id], ("fp", "fingerprint", "component_id", "__fp"))
    prints = staged(fingerprints(docs, keep, text, shingle), "fingerprints")
    distinct = staged(prints.groupBy("fp").agg(F.min(doc_id).alias("least")), "distinct")
    found = components(link_fingerprints(distinct), "a", "b")
    classes = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", F.coalesce("component", "fp").alias("class"), "least")
    least = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    ids = classes.join(least, "class").select(F.col("fp").alias("__fp"), "component_id")
    return prints.join(ids, prints["fp"] == ids["__fp"]).select(*keep, "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
