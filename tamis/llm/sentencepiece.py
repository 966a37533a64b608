"""SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct chunks (a run of space marks and what follows it, which no piece crosses) are concatenated, in
slices of bounded size, and indexed by a suffix array, sorted as deep as the longest piece. Every piece of the vocabulary finds its occurrences as
one range of the array by binary search; the ranges' members, sorted by position, are the edges of a lattice. A pass
over end positions then relaxes the edges: for a unigram model by the best score, for a BPE model by the one edge whose
piece may follow the piece before it (a greedy merge of the two would give back exactly these two). Characters that no
piece covers fall back to bytes. The model file is read as it is and never trained.

Decoding joins the pieces, turns byte pieces into bytes and space marks into spaces.

Cases: null and empty texts have no pieces. Repeated rows are encoded again. A text that holds a space mark itself, or
anything that the model's normaliser changes, decodes to its normal form. An empty table gives no rows. Other columns
of the input stay.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.llm.shared import Runs, chunked, kept, read, release, strings

MARK = "▁"
SLOTS = 21
#: Characters that one suffix array covers: it bounds memory, whatever the batch.
SLICE = 250_000
MODEL = os.environ.get("TAMIS_TOKENIZERS", "/opt/tokenizers") + "/piece_bpe_32k.model"


def fields(data: bytes):
    """(number, value) of a protocol buffer message's fields; the value is an int or bytes."""
    at = 0

    def varint():
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if tag & 7 == 2 else 8 if tag & 7 == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size


def model_kind(model: bytes) -> tuple[bool, int]:
    """Whether it is a BPE model, and how many user-defined pieces it has."""
    bpe, user = False, 0
    for number, value in fields(model):
        if number == 1:
            user += any(n == 3 and x == 4 for n, x in fields(value))
        elif number == 2:
            bpe = any(n == 3 and x == 2 for n, x in fields(value))
    return bpe, user


class Vocabulary:
    """Pieces, scores and kinds of a model file, and the matching tables."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = np.array([sp.get_score(i) for i in range(n)])
        self.bytes = {self.pieces[i]: i for i in range(n) if sp.is_byte(i)}
        self.byte_ids = [self.bytes.get(f"<0x{b:02X}>", sp.unk_id()) for b in range(256)]
        self.of_byte = {i: b for b, i in enumerate(self.byte_ids)} if self.bytes else {}
        self.deep = max(len(self.pieces[i]) for i in plain)
        self.crossing = any(MARK in self.pieces[i].lstrip(MARK) for i in plain)
        self.alphabet = np.array(sorted({ord(c) for i in plain for c in self.pieces[i]}), np.int64)
        # Pieces in the order of their codes, each padded: searched all at once.
        self.order = np.array(sorted(plain, key=lambda i: self.pieces[i]), np.int32)
        self.lengths = np.array([len(self.pieces[i]) for i in self.order])
        codes = np.zeros((len(plain), self.deep), np.int64)
        for k, i in enumerate(self.order):
            codes[k, : self.lengths[k]] = self.code(np.array([ord(c) for c in self.pieces[i]], np.int64))
        self.codes = codes
        self.bpe, user = model_kind(model)
        if user:
            raise ValueError("models with user-defined pieces are not supported")
        self.follows: dict[int, bool] = {}
        self.slot_keys, self.slot_values = np.full(1 << SLOTS, -1, np.int64), np.zeros(1 << SLOTS, bool)
        self.sizes = np.array([len(p) for p in self.pieces], np.int32)
        self.runs = Runs(400_000)

    def single(self) -> np.ndarray:
        """Characters that are pieces."""
        return np.array([ord(p) for p in self.ids if len(p) == 1])

    def code(self, points: np.ndarray) -> np.ndarray:
        """1, 2, ... for characters of the alphabet, in order; its size + 1 for all others; 0 ends a chunk."""
        at = np.searchsorted(self.alphabet, points)
        known = self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == points
        return np.where(known, at + 1, len(self.alphabet) + 1)

    def merged(self, text: str) -> list[str]:
        """The greedy merges of a short text: best score first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.scores[i], -k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def may_follow(self, left: int, right: int) -> bool:
        """Whether left and right stay apart when their joined text is merged on its own; left < 0: right at a start."""
        a, b = self.pieces[left] if left >= 0 else "", self.pieces[right]
        return self.merged(a + b) == ([a, b] if a else [b])

    def all_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """may_follow() for arrays, by way of a direct-mapped table of earlier answers with a dictionary behind it."""
        keys = (np.maximum(left, -1) + 1) << 32 | right.astype(np.int64)
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)
        out = self.slot_values[at]
        missed = np.flatnonzero(self.slot_keys[at] != keys)
        if len(missed):
            if len(self.follows) > 600_000:
                self.follows.clear()
            found = []
            for key in keys[missed].tolist():
                got = self.follows.get(key)
                if got is None:
                    got = self.follows[key] = self.may_follow((key >> 32) - 1, key & 0xFFFFFFFF)
                found.append(got)
            out[missed] = found
            self.slot_keys[at[missed]], self.slot_values[at[missed]] = keys[missed], out[missed]
        return out


@lru_cache(maxsize=4)
def vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the codes that follow them, at least depth deep, by doubling ranks."""
    n, bits = len(codes), max(1, int(codes.max(initial=1)).bit_length())
    width = max(1, 62 // bits)
    width = 1 << (width.bit_length() - 1)
    padded = np.concatenate([codes, np.zeros(width, np.int64)])
    key = padded[:n].copy()
    for d in range(1, width):  # as many codes as one number holds make the first key
        key = key << bits | padded[d : n + d]
    while True:
        order = np.argsort(key)
        if width >= depth:
            return order
        rank = np.zeros(n, np.int64)
        rank[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1
        width *= 2


def edges(v: Vocabulary, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, piece) of every occurrence of every piece in codes."""
    order = suffix_array(codes, v.deep)
    padded = np.concatenate([codes, np.zeros(v.deep, np.int64)])
    low, high = np.zeros(len(v.order), np.int64), np.full(len(v.order), len(order))
    for d in range(v.deep):
        # Narrows every piece's range by its next character: two binary searches for all pieces together.
        live = np.flatnonzero((d < v.lengths) & (low < high))
        if not len(live):
            break
        want = v.codes[live, d]
        low[live] = _search(padded, order, low[live], high[live], d, want, False)
        high[live] = _search(padded, order, low[live], high[live], d, want, True)
    counts = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(counts)), counts)
    starts = order[np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())]
    return starts.astype(np.int32), v.order[which]


def _search(padded, order, low, high, d, want, after: bool) -> np.ndarray:
    low, high = low.copy(), high.copy()
    while (live := low < high).any():
        mid = (low + high) // 2
        seen = padded[order[np.minimum(mid, len(order) - 1)] + d]
        right = live & ((seen <= want) if after else (seen < want))
        low = np.where(right, mid + 1, low)
        high = np.where(live & ~right, mid, high)
    return low


def relax(v: Vocabulary, points: np.ndarray, starts: np.ndarray, pieces: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat piece ids of all chunks, and how many each has. Chunk k is points[begins[k]:ends[k]].

    Relaxes the edges that end at the same distance from their chunk's start together, for all chunks.
    """
    sizes = ends - begins
    chunk = np.repeat(np.arange(len(begins)), sizes + 1)
    edge_ends = starts + v.sizes[pieces]
    away = (edge_ends - begins[chunk[starts]]).astype(np.int32)
    deepest = int(sizes.max()) if len(sizes) else 0
    by = np.argsort(away.astype(np.int16) if deepest < 32_000 else away, kind="stable")  # 16 bits: a radix sort
    starts, pieces, edge_ends = starts[by], pieces[by], edge_ends[by]
    cuts = np.searchsorted(away[by], np.arange(1, deepest + 2))
    single = v.single()
    foreign = np.flatnonzero(~np.isin(points, single))
    foreign = foreign[points[foreign] != 0] if not len(ends) else np.setdiff1d(foreign, ends)
    foreign = foreign[np.argsort(foreign - begins[chunk[foreign]], kind="stable")]
    foreign_cuts = np.searchsorted(foreign - begins[chunk[foreign]], np.arange(0, deepest + 1))
    # The last piece before each boundary: -1 none yet, -2 a character in bytes, -3 a start.
    back = np.full(len(points) + 1, -1, np.int64)
    back[begins] = -3
    best, worst = np.zeros(len(points) + 1), float(v.scores.min()) - 10
    for d in range(1, deepest + 1):
        lo, hi = cuts[d - 1], cuts[d]
        s, p, e = starts[lo:hi], pieces[lo:hi], edge_ends[lo:hi]
        last = back[s]
        ok = last != -1
        s, p, e, last = s[ok], p[ok], e[ok], last[ok]
        if v.bpe:
            ok = v.all_follow(last, p)
            back[e[ok]] = p[ok]
        else:
            value = best[s] + v.scores[p]
            up = np.argsort(value, kind="stable")
            back[e[up]], best[e[up]] = p[up], value[up]
        if d - 1 < len(foreign_cuts) - 1 or len(foreign):
            f = foreign[foreign_cuts[d - 1] : (foreign_cuts[d] if d < len(foreign_cuts) else len(foreign))]
            f = f[(back[f + 1] == -1) & (back[f] != -1)]
            back[f + 1], best[f + 1] = -2, best[f] + worst
    at, live, out_piece, out_chunk = ends.copy(), np.flatnonzero(sizes > 0), [], []
    while len(live):
        piece = back[at[live]]
        if (piece == -1).any() or (piece == -3).any():
            raise ValueError("no segmentation")
        plain = piece >= 0
        # A character in bytes is noted as minus its code point, and spelt out below.
        out_piece.append(np.where(plain, piece, -points[at[live] - 1] - 1))
        out_chunk.append(live)
        at[live] -= np.where(plain, v.sizes[np.maximum(piece, 0)], 1)
        live = live[at[live] > begins[live]]
    if not out_piece:
        return np.zeros(0, np.int32), np.zeros(len(begins), np.int64)
    rounds = np.repeat(-np.arange(len(out_piece)), [len(x) for x in out_piece])
    flat, owner = np.concatenate(out_piece), np.concatenate(out_chunk)
    by = np.lexsort((rounds, owner))
    flat, owner = flat[by], owner[by]
    if (flat < 0).any():
        spelt = [[x] if x >= 0 else [v.byte_ids[b] for b in chr(-x - 1).encode("utf-8", "surrogatepass")] for x in flat.tolist()]
        owner = np.repeat(owner, [len(x) for x in spelt])
        flat = np.array([i for x in spelt for i in x])
    return flat.astype(np.int32), np.bincount(owner, minlength=len(begins)).astype(np.int64)


def encode_chunks(v: Vocabulary, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Flat piece ids of normalised chunks and their numbers, through a suffix array over SLICE characters at a time."""
    if not chunks:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    ends = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1)
    if ends[-1] > SLICE and len(chunks) > 1:
        # A chunk stays whole, however long.
        cuts = [0, *(np.flatnonzero(np.diff(ends // SLICE)) + 1).tolist(), len(chunks)]
        parts = [_encode_slice(v, chunks[a:b]) for a, b in zip(cuts, cuts[1:]) if a < b]
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([sizes for _, sizes in parts])
    return _encode_slice(v, chunks)


def _encode_slice(v: Vocabulary, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(("\0".join(chunks) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ends = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1) - 1
    codes = v.code(points)
    codes[ends] = 0
    starts, pieces = edges(v, codes)
    return relax(v, points, starts, pieces, np.concatenate([[0], ends[:-1] + 1]), ends)


def chunks_of(text: str) -> list[str]:
    """Normalised text cut before each run of space marks."""
    out, marks = [], ""
    for k, p in enumerate(text.split(MARK)):
        if k:
            marks += MARK
        if p:
            out.append(marks + p)
            marks = ""
    return [*out, marks] if marks else out


def encode_batch(v: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Flat piece ids of texts, and how many each has. A distinct chunk is encoded once, as long as v.runs holds it."""
    normal = [v.sp.normalize(t) if t else "" for t in texts]
    if v.crossing:
        cut = pa.array([[n] if n else [] for n in normal], pa.list_(pa.string()))
    else:
        # Single spaces throughout, as in most texts: one split for all.
        cut = pa.array([n if n.startswith(MARK) and MARK * 2 not in n and n[-1] != MARK else "" for n in normal], pa.string())
        plain = pc.not_equal(cut, "").to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(pc.utf8_slice_codeunits(cut, 1, None), MARK)
        other = [k for k in np.flatnonzero(~plain).tolist() if normal[k]]
    flat, counts = cut.flatten(), pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
    if not v.crossing:
        if not plain.all():
            flat = flat.filter(pa.array(np.repeat(plain, counts)))
            counts = np.where(plain, counts, 0)
        extra = [chunks_of(normal[k]) for k in other]
    coded = flat.dictionary_encode()
    chunks = coded.dictionary.to_pylist() if v.crossing else [MARK + c for c in coded.dictionary.to_pylist()]
    index, owner = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(texts)), counts)
    if not v.crossing and other:
        place = {c: k for k, c in enumerate(chunks)}
        more = [place.setdefault(c, len(place)) for x in extra for c in x]
        chunks = list(place)
        owner = np.concatenate([owner, np.repeat(other, [len(x) for x in extra])])
        index = np.concatenate([index, np.array(more, np.int64)])
        by = np.argsort(owner, kind="stable")
        index, owner = index[by], owner[by]
    ids, first, n = v.runs.of(pa.array(chunks, pa.large_string()), lambda new: encode_chunks(v, new))
    per = n[index]
    at = np.repeat(first[index] - (np.cumsum(per) - per), per) + np.arange(per.sum())
    return ids[at], np.bincount(owner, per, len(texts)).astype(np.int64)


def decode(v: Vocabulary, ids: list[int]) -> str:
    if v.of_byte:
        out, held = [], bytearray()
        for i in ids:
            if (b := v.of_byte.get(i)) is not None:
                held.append(b)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            out.append(v.pieces[i])
        out.append(held.decode("utf-8", "replace"))
    else:
        out = [v.pieces[i] for i in ids]
    text = "".join(out).replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, keep: list[str], text: str = "text", model: str = MODEL) -> DataFrame:
    """The columns in keep, ids (array<int>), n_pieces, and decoded_equal: whether decoding ids gives back the text."""
    spark = docs.sparkSession
    with open(model, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())  # half a megabyte
    keep = kept(keep, ("ids", "n_pieces", "decoded_equal"))
    docs = docs.select(*keep, F.col(text).alias("__text"))
    more = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("decoded_equal", T.BooleanType())]
    schema = T.StructType([*docs.select(*keep).schema.fields, *more])

    def run(batches):
        v = vocabulary(sent.value)
        for table in chunked(batches, 2 << 20):
            texts = strings(table["__text"]).to_pylist()
            ids, sizes = encode_batch(v, texts)
            ends = np.cumsum(sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
            equal = [decode(v, ids[e - n : e].tolist()) == t for e, n, t in zip(ends.tolist(), sizes.tolist(), texts)]
            yield from pa.table({c: table[c] for c in keep} | {"ids": lists, "n_pieces": sizes, "decoded_equal": equal}).to_batches(max_chunksize=512)
            del table, texts, ids, sizes, ends, lists, equal
            release()

    return docs.mapInArrow(run, schema)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), ["doc_id"])
