"""Near-duplicates by exact Jaccard similarity of word shingles, found through wide SimHash fingerprints.

At Jaccard 0.8 some 10 of 64 SimHash bits differ, too many for a radius of 4 bits. Here a set of shingles has WIDE sign
bits, and each mask of some bits out of them, MASK or more as the number of sets grows, is a table: sets that agree under a mask and differ in at
most RADIUS of their first 128 bits are candidates. The sets of a pattern are searched as in simhash: sorted by Gray rank,
every FAN neighbours have a node that factors out the bits they share, and a walk over pairs of nodes drops two whole
groups as soon as the shared bits differ too often. Candidates only decide which texts are compared: components of
candidates are searched for all pairs whose sets of shingles have Jaccard similarity of at least the threshold, from
the shingles themselves. So no other pair is linked, and a pair is lost only where no mask and no chain of candidates
brings it together; masks_for() gives the masks that find a pair exactly at the threshold with the wanted chance.

Patterns with more than CELL sets and components with more than TEXTS (or SHINGLES shingles) are cut into slices, and every pair of slices is a
task of its own. Tasks return links that span each class, never all pairs.

Cases: texts with equal sets of shingles are one set; texts without words, null ones too, are a set that is like no
other. Texts with fewer words than a shingle are one shingle. Ids must not be null. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from tamis.llm.components import components
from tamis.llm.shared import chunked, partitions, release, staged, strings
from tamis.llm.simhash import FAN, LISTED, Classes, gray_rank, levels_of, shingle_hashes

WIDE, MASK, RADIUS, FIRST = 256, 12, 33, 21
#: Sets of one pattern, sets and shingles of one component that a task compares at most; pairs of nodes that are few enough to be walked at once.
CELL, TEXTS, SHINGLES, SMALL = 4_096, 512, 1_000_000, 1 << 13
#: Sets in a pattern that the number of bits of a mask aims at.
PATTERN = 2_048
#: Rows of 40 bytes that are broadcast at most to fetch the texts to compare; beyond it texts are shuffled.
MEMBERS = 500_000
SALT = np.random.default_rng(5).integers(0, 2**64, WIDE // 8, np.uint64)


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle).view(np.uint64).ravel())


def node_of(own: np.ndarray) -> int:
    """The number of a set of shingles, as a signed long."""
    x = xxh64_intdigest(own.tobytes(), 7) if len(own) else 0
    return x - (1 << 64) if x >> 63 else x


def wide_fingerprint(own: np.ndarray) -> bytes:
    """Signs of the sums, over the set, of WIDE pseudorandom numbers a shingle, uniform in steps of a byte."""
    total = np.zeros(WIDE, np.int64)
    for at in range(0, len(own), 1 << 12):
        x = own[at : at + (1 << 12), None] ^ SALT
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        total += x.view(np.uint8).sum(0, dtype=np.int64)
    return np.packbits(2 * total > 255 * len(own)).tobytes()


def mask_bits(n: int) -> int:
    """Bits of a mask for n sets, so that few sets share a pattern by chance."""
    return max(MASK, math.ceil(math.log2(max(n, 1) / PATTERN)))


def masks_for(jaccard: float, recall: float, size: int = MASK) -> int:
    """How many masks of size bits find a pair of this similarity with this chance, over the spread of its differing bits."""
    differ = math.acos(2 * jaccard / (1 + jaccard)) / math.pi
    d = np.arange(WIDE - size + 1)
    logs = np.array([math.lgamma(WIDE + 1) - math.lgamma(k + 1) - math.lgamma(WIDE - k + 1) for k in d])
    chance = np.exp(logs + d * math.log(differ) + (WIDE - d) * math.log(1 - differ))
    agree = np.prod([(WIDE - d - i) / (WIDE - i) for i in range(size)], axis=0)
    return next(n for n in range(1, 10_000) if (chance * (1 - (1 - agree) ** n)).sum() >= recall)


def gray_order(group: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of the rows of x (n, words) in order of group and of their place in the Gray sequence of all bits."""
    ranks, odd = [], np.zeros(len(x), bool)
    for word in x.T:
        # A word behind an odd number of ones runs through its own sequence backwards.
        ranks.append(gray_rank(word) ^ np.where(odd, ~np.uint64(0), np.uint64(0)))
        odd = (ranks[-1] & np.uint64(1)).astype(bool)
    return np.lexsort((*ranks[::-1], group))


def children(first: np.ndarray, last: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of a child of the left and one of the right node of pairs, in this order; first and last: of each node's children."""
    left, right = pairs.T
    n_right = last[right] - first[right]
    n = (last[left] - first[left]) * n_right
    owner = np.repeat(np.arange(len(pairs)), n)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    i, j = first[left][owner] + within // n_right[owner], first[right][owner] + within % n_right[owner]
    return i[i <= j], j[i <= j]


def linked_prints(group: np.ndarray, x: np.ndarray, seen: Counter | None = None) -> np.ndarray:
    """Class label (a row) of each row of fingerprints (n, 2 words): rows of one group link within RADIUS. Rows of a group are consecutive.

    Each group is a tree over its fingerprints in Gray order, as in simhash: a walk over pairs of nodes counts the
    differing bits that nodes share, and drops both whole as soon as these exceed the radius. seen: counts pairs of nodes
    met and dropped at each level.
    """
    out = np.arange(len(x))
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(starts, len(group)))
    rows = np.flatnonzero(np.repeat(sizes > 1, sizes))
    if not len(rows):
        return out
    rows = rows[gray_order(group[rows], x[rows])]
    group, x = group[rows], x[rows]
    levels, classes = levels_of(group, x), Classes(len(x))
    words, heads, tails = list(map(np.ascontiguousarray, x.T)), levels[1][2], levels[1][3]
    leaves = words[0][np.minimum(heads[:, None] + np.arange(FAN), len(x) - 1)]
    roots = np.arange(len(levels[-1][0]))
    stack = [(len(levels) - 1, np.stack([roots, roots], 1))]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > SMALL:
            stack += [(depth, pairs[SMALL:]), (depth, pairs[:SMALL])]
            continue
        if depth > 1:
            i, j = children(*levels[depth][2:], pairs)
            pattern, mask, _, _ = levels[depth - 1]
            differ = np.bitwise_count((pattern[i] ^ pattern[j]) & mask[i] & mask[j])
            near = (differ[:, 0] <= FIRST) & (differ.sum(1) <= RADIUS)
            if seen is not None:
                seen.update({("met", depth - 1): len(i), ("dropped", depth - 1): int((~near).sum())})
            if near.any():
                stack.append((depth - 1, np.stack([i[near], j[near]], 1)))
            continue
        # Groups that are one class already have nothing to add.
        low, high = np.minimum.reduceat(classes.label, heads), np.maximum.reduceat(classes.label, heads)
        left, right = pairs[~((low[pairs] == high[pairs]).all(1) & (low[pairs[:, 0]] == low[pairs[:, 1]]))].T
        if not len(left):
            continue
        at = np.flatnonzero(np.bitwise_count(leaves[left][:, :, None] ^ leaves[right][:, None, :]) <= FIRST)
        at, i, j = at // FAN**2, at // FAN % FAN, at % FAN
        left_, right_ = left[at], right[at]
        i, j = heads[left_] + i, heads[right_] + j
        real = (i < j) & (i < tails[left_]) & (j < tails[right_])
        i, j = i[real], j[real]
        near = sum(np.bitwise_count(w[i] ^ w[j]) for w in words) <= RADIUS
        if seen is not None:
            seen.update({("met", 0): int(((tails - heads)[left] * (tails - heads)[right]).sum())})
        if near.any():
            classes.join(i[near], j[near])
    least = np.full(len(rows), len(out))
    np.minimum.at(least, classes.label, rows)
    out[rows] = least[classes.label]
    return out


def linked_sets(sets: list[np.ndarray], least: float) -> np.ndarray:
    """Class label of each of the sets (none empty): components of all pairs with Jaccard similarity >= least."""
    size = np.array([len(x) for x in sets])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    label, open_ = np.full(len(sets), -1), np.arange(len(sets))
    left = flat  # shingles of the sets in open_
    mark = np.zeros(len(names), bool)
    frontier: list[int] = []
    while len(open_) or frontier:
        if not frontier:
            frontier = [int(open_[0])]
            label[open_[0]] = open_[0]
            left, open_ = left[size[open_[0]] :], open_[1:]
        probe = frontier.pop()
        if not len(open_):
            continue
        own = flat[ends[probe] - size[probe] : ends[probe]]
        mark[own] = True
        n = size[open_]
        both = np.add.reduceat(mark[left], np.cumsum(n) - n, dtype=np.int64)
        mark[own] = False
        near = both >= least * (size[probe] + n - both) - 1e-9
        if near.any():
            label[open_[near]] = label[probe]
            frontier += open_[near].tolist()
            left, open_ = left[np.repeat(~near, n)], open_[~near]
    return label


def groups_of(batches, key: list[str]):
    """Tables of the rows of one key after the other, from batches sorted by key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch[c].to_numpy().astype(np.int64) for c in key], 1)
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])).tolist()
        for s, e in zip(starts, [*starts[1:], len(keys)]):
            now = tuple(keys[s].tolist())
            if last is not None and now != last:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def ties(label: np.ndarray, sides: list[np.ndarray], sets: list[np.ndarray], least: float) -> np.ndarray:
    """Labels that differ from the place itself only at the first of each class within a side, which has its whole class's."""
    out = np.arange(len(label))
    for at in sides:
        within = linked_sets([sets[k] for k in at], least)
        heads = at[np.unique(within)]
        out[heads] = label[heads]
    return out


def in_cells(rows: DataFrame, key: str, large: DataFrame, own: str, columns: list[str], keep_slice: bool = False) -> DataFrame:
    """rows in order of key, i, j; those of a key in large (key, slices) stand in a cell for each pair of slices. keep_slice: with the slice of each row, own."""
    n_large = large.count()
    if n_large:
        rows = rows.join(F.broadcast(large) if n_large <= LISTED else large.hint("merge"), key, "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
        # A slice is drawn by hash; each pair of slices meets in one cell.
        slice_ = F.pmod(F.xxhash64(own), F.col("slices")).cast("int")
        rows = rows.withColumn("own", slice_).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        rows = rows.select(key, *columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *["own"] * keep_slice)
    else:
        rows = rows.select(key, *columns, F.lit(0).alias("i"), F.lit(0).alias("j"), *[F.lit(0).alias("own")] * keep_slice)
    # In order of own, so that links go to the least of a class whichever pattern tells it.
    return rows.repartition(partitions(rows.sparkSession), key, "i", "j").sortWithinPartitions(key, "i", "j", own)


def links(nodes: np.ndarray, label: np.ndarray) -> pa.RecordBatch | None:
    at = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_pydict({"a": nodes[at], "b": nodes[label[at]]}) if len(at) else None


def candidates(sets: DataFrame, masks: int, size: int = MASK) -> DataFrame:
    """sets: node, wide. Links (a, b) that span the sets near one another under any of the masks of size bits."""
    bits = np.stack([np.random.default_rng([11, t]).choice(WIDE, size, replace=False) for t in range(masks)])

    def hashed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                data = np.frombuffer(b"".join(part["wide"].to_pylist()), np.uint8).reshape(-1, WIDE // 8)
                signs, words = np.unpackbits(data, axis=1), np.ascontiguousarray(data).view(np.int64)
                keys = (signs[:, bits].astype(np.int64) << np.arange(size)).sum(2) | np.arange(masks) << 32
                yield pa.RecordBatch.from_pydict({"key": keys.ravel(), "node": np.repeat(part["node"].to_numpy(), masks), "x": np.repeat(words[:, 0], masks), "y": np.repeat(words[:, 1], masks)})

    rows = sets.select("node", "wide").mapInArrow(hashed, "key long, node long, x long, y long")
    large = rows.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > CELL)
    large = staged(large.select("key", F.ceil(F.col("members") / (CELL // 2)).cast("int").alias("slices")), "patterns")

    def near(batches):
        held: list[np.ndarray] = []

        def close(rows):
            group = np.cumsum(np.concatenate([[0], (rows[1:, :3] != rows[:-1, :3]).any(1)]))
            return links(rows[:, 3], linked_prints(group, rows[:, 4:].view(np.uint64)))

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([batch[c].to_numpy().astype(np.int64) for c in ("key", "i", "j", "node", "x", "y")], 1))
            # What is complete is compared; the last group may go on in the next batch.
            if (held[0][0, :3] == held[-1][-1, :3]).all():
                continue
            rows = np.concatenate(held)
            cut = int(np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(1))[-1]) + 1
            held = [rows[cut:]]
            if (got := close(rows[:cut])) is not None:
                yield got
        if held and (got := close(np.concatenate(held))) is not None:
            yield got
        del held
        release()

    return in_cells(rows, "key", large, "node", ["node", "x", "y"]).mapInArrow(near, "a long, b long").distinct()


def similar_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8, recall: float = 0.999) -> DataFrame:
    """One row a document: doc_id, text_hash (xxhash64 of the text), component_id, the least id of its component, and
    component, the number of the component: other texts of one id may belong to others."""
    docs = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))

    def prints(batches):
        for table in chunked(batches, 4 << 20):
            sets = [shingle_set(t.encode("utf-8", "surrogatepass"), shingle) for t in strings(table["__text"]).to_pylist()]
            yield from pa.table({"id": table["__id"], "hash": table["__hash"], "node": np.array([node_of(x) for x in sets], np.int64), "size": np.array([len(x) for x in sets], np.int64), "wide": pa.array([wide_fingerprint(x) for x in sets], pa.binary())}).to_batches()
            del sets
            release()

    kind = docs.schema["__id"].dataType
    numbered = docs.select("*", F.xxhash64("__text").alias("__hash"))
    found = staged(numbered.mapInArrow(prints, T.StructType([T.StructField("id", kind), *T._parse_datatype_string("hash long, node long, size long, wide binary").fields])), "prints")
    sets = staged(found.groupBy("node", "size", "wide").agg(F.min("id").alias("least")), "sets")
    size = mask_bits(sets.count())
    near = components(candidates(sets.where("size > 0"), masks_for(least, recall, size), size), "a", "b")
    # One text a set goes to the comparison; other texts of the same id are dropped there by their number.
    members = staged(sets.join(near, "node").select("node", "size", F.col("component").alias("group"), "least"), "members")
    large = members.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("s")).where((F.col("n") > TEXTS) | (F.col("s") > SHINGLES))
    large = staged(large.select("group", F.greatest(F.ceil(F.col("n") / (TEXTS // 2)), F.ceil(F.col("s") / (SHINGLES // 2))).cast("int").alias("slices")), "groups")
    few = members.count() <= MEMBERS
    texts = docs.join(F.broadcast(members) if few else members.hint("shuffle_hash"), docs["__id"] == members["least"]).select("group", "node", "__text")

    def compare(batches):
        for table in groups_of(batches, ["group", "i", "j"]):
            sets, side = {}, {}
            for node, own_slice, t in zip(table["node"].to_pylist(), table["own"].to_pylist(), table["__text"]):
                own = shingle_set((t.as_py() or "").encode("utf-8", "surrogatepass"), shingle)
                if node_of(own) == node:
                    sets[node], side[node] = own, own_slice
            nodes = sorted(sets)
            if len(nodes) < 2:
                continue
            label = linked_sets([sets[k] for k in nodes], least)
            if table["i"][0].as_py() != table["j"][0].as_py():
                # A slice's own classes are told where it meets itself; here only what ties them together.
                label = ties(label, [np.array([k for k, x in enumerate(nodes) if side[x] == s]) for s in set(side.values())], [sets[k] for k in nodes], least)
            if (got := links(np.array(nodes), label)) is not None:
                yield got
        release()

    linked = components(in_cells(texts, "group", large, "node", ["node", "__text"], keep_slice=True).mapInArrow(compare, "a long, b long"), "a", "b")
    classes = sets.join(linked.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("node", F.coalesce("component", "node").alias("class"), "least")
    ids = classes.join(classes.groupBy("class").agg(F.min("least").alias("component_id")), "class").select(F.col("node").alias("n"), F.col("class").alias("component"), "component_id")
    return found.join(ids, F.col("node") == F.col("n")).select(F.col("id").alias(doc_id), F.col("hash").alias("text_hash"), "component", "component_id")
