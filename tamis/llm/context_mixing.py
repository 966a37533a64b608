"""Language-model scores by online logistic context mixing.

A text is a row of tokens: words and one end. Every token is told by binary decisions, each predicted by several
predictors whose log odds are combined by weights that a gate picks; the weights start alike in every text and learn
from each block of its tokens after that block was predicted. What they give is refined by a scale for each decision,
learnt the same way.

- At every word, where training texts hold the three words before, the first decision is whether the word is the
  one that follows them there most often, gated by how often and how surely it does.
- If not, the next decision is whether training texts have the word.
- Then come CODE bits of a code that all words have: CODE / 2 from their first two bytes, as many from their last two.
  Predictors look up hashed contexts with the place in the code: none, the word before, the last short word (which
  mostly tells the language), and what this text itself held so far. Among words of one code a word has its share of
  their occurrences.
- A word that training texts don't have is spelt bit by bit in the same manner, by predictors that hash the last 1 to
  5 bytes of the word so far with the place in a fixed prefix code of bytes, gated by the longest context seen before
  and refined by a table of gates and predicted odds. These weights learn from words that training texts hold once.

A training text is scored by counts that leave out the occurrence at hand: a word that occurs once is told as a new one.
So training texts and held-out ones are scored alike, and a text that occurs twice is cheaper than one that doesn't.
Scores don't depend on how rows are dealt out: counts are sums over the whole corpus, weights belong to one text, or to
one bucket of words, whose number follows the size of the corpus.

Word counts, and those of rows of four words, are exact at any size but for equal hashes (of 27 bits and the bucket for
three words, 13 bits for the fourth): each task lists the distinct ones of its chunk of texts, in buckets by hash; a
bucket's task sums them, and sends back to the chunks that asked each word's count and spelling, and what follows three
words. Rows of four words are read off the staged texts and go straight into the shuffle. Buckets hold BUCKET_BYTES of text each, up to MOST_BUCKETS of them, beyond which (12 TB) they grow. The bit
tables are summed on the executors in slices and go by way of the driver: 2**TABLE_BITS slots for each order of
spelling, and 2**16 to 2**MOST_BITS slots, by the size of the corpus, for each context of codes. Only their size is
bounded; they count every training token.

Cases: a null text is empty and has the end alone. Without training texts every base probability is one, all words are
new ones under untrained tables, and an end has probability one half. Null ids count as the empty string in the fold
rule. Repeated rows count as often as they stand there; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm.shared import LOWER, chunked, crc_mod, partitions, read, release, split_words, staged, strings, sums_by_text, translated

ORDERS, TABLE_BITS, SLICES = 5, 20, 64
GATES, BLOCK_BYTES, RATE = 3 * (ORDERS + 1), 8192, 0.4
LEVELS = 33
#: Bits of a word's code and decisions a token, contexts of codes, inputs of the mixer (with the text's own and a constant).
CODE, DECISIONS, CONTEXTS, INPUTS = 6, 8, 2, 5
#: Words before that a following one is looked up by; log odds that it does follow: seen once, twice or thrice, more often, among others.
LONG, FOLLOWS = 3, (-1.0, 0.5, 1.5, -2.0)
#: Bits of a pair of context and follower, and of the follower among them; pairs of a bucket that are told at once.
PAIR, FOLLOWER, TOLD = 40, 13, 1 << 18
#: Weight sets of a decision.
SETS = 4
MOST_BITS, SLICE_SLOTS = 20, 1 << 16
#: Bytes of text for each bucket of words; tokens that are mixed at once; the largest block after which weights learn.
BUCKET_BYTES, LANES, MOST_BLOCK = 12 << 20, 16_384, 2_048
#: A number of a bucket has 20 of the 24 bits that a pair leaves.
MOST_BUCKETS = 1 << 20
SCALE = 12.0
#: What the weights of all sets start with, the constant input, how far a block moves them, and how many bits make a block count in full.
START, ALWAYS, STEP, STEADY = (0.2, 0.35, 0.45, 0.25, 0.0), np.float32(0.3), 0.5, 12


def prefix_code() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, size, nodes, bits): a fixed Huffman code of bytes, the space as the end of a word.

    It follows a fixed order of how common bytes are in Latin texts, never the data; it only decides how many
    binary decisions spell a byte.
    """
    common = " etaonirshdlucmpgbvfyw.,kq-xzj0123456789\xc3;:!?'\"()_/*#&@\xa9\xa8\xa0\xb3\xb1\xa1\xad\xbc\xa4\xb6\x9f".encode("latin-1")
    order = [*common, *(b for b in range(256) if b not in common)]
    heap = [(1 / (k + 2) ** (1.0 if k < 40 else 1.6), k, b) for k, b in enumerate(order)]
    heapq.heapify(heap)
    kids: dict[int, tuple[int, int]] = {}
    n = 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        kids[n] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], n, n))
        n += 1
    paths: dict[int, list[tuple[int, int]]] = {}
    stack: list[tuple[int, list[tuple[int, int]]]] = [(heap[0][2], [])]
    while stack:
        node, path = stack.pop()
        if node < 256:
            paths[node] = path
        else:
            stack += [(kids[node][bit], [*path, (node - 256, bit)]) for bit in (0, 1)]
    size = np.array([len(paths[b]) for b in range(256)])
    return np.cumsum(size) - size, size, np.array([x for b in range(256) for x, _ in paths[b]], np.uint32), np.array([x for b in range(256) for _, x in paths[b]], np.int64)


FIRST, SIZE, NODES, BITS = prefix_code()


def packed(a: np.ndarray) -> bytes:
    """Numbers in byte planes, compressed."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def bit_events(data: np.ndarray, place: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Slots of every bit for each order, the bits, and bits a byte. place: of each byte in its word."""
    size = SIZE[data]
    which = np.repeat(FIRST[data] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    node = NODES[which] * np.uint32(0x9E3779B1)
    slots, context = [], np.zeros(len(data), np.uint32)
    for k in range(1, ORDERS + 1):
        before = np.zeros(len(data), np.uint32)
        before[k:] = data[:-k] if k < len(data) else data[:0]
        context = (context + np.where(place >= k, before + 1, 0).astype(np.uint32)) * np.uint32(0x01000193) ^ (context >> np.uint32(15))
        mixed = (np.repeat(context * np.uint32(0x85EBCA6B) + np.uint32(k), size) ^ node) * np.uint32(0xC2B2AE35)
        slots.append((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - TABLE_BITS))
    return slots, BITS[which], size


def word_blocks(words: list[bytes]):
    """(bytes with a space behind each word, place of each in its word, words) for blocks of whole words."""
    held, size = [], 0
    for k, w in enumerate(words):
        held.append(w)
        size += len(w) + 1
        if size >= BLOCK_BYTES or k == len(words) - 1:
            data = np.frombuffer(b" ".join(held) + b" ", np.uint8)
            lengths = np.fromiter(map(len, held), np.int64, len(held)) + 1
            yield data, np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths), lengths
            held, size = [], 0


def bit_counts(words: list[bytes]) -> np.ndarray:
    """(orders, slots, 2): how often each bit follows in each slot when every word is spelt once."""
    out = np.zeros((ORDERS, 2 << TABLE_BITS), np.uint32)
    held: list[list[np.ndarray]] = [[] for _ in range(ORDERS)]
    n = 0
    for data, place, _ in word_blocks(words):
        slots, bits, _ = bit_events(data, place)
        for k in range(ORDERS):
            held[k].append(slots[k].astype(np.int64) << 1 | bits)
        n += len(bits)
        if n > 1_000_000:
            for k in range(ORDERS):
                out[k] += np.bincount(np.concatenate(held[k]), minlength=2 << TABLE_BITS).astype(np.uint32)
            held, n = [[] for _ in range(ORDERS)], 0
    for k in range(ORDERS):
        if held[k]:
            out[k] += np.bincount(np.concatenate(held[k]), minlength=2 << TABLE_BITS).astype(np.uint32)
    return out.reshape(ORDERS, -1, 2)


LOG_COUNT = np.log(np.arange(1 << 16, dtype=np.float64) + 0.4).astype(np.float32)


class Speller:
    """The mixing model over tables (orders, slots, 2) of counts below 2**16. learn() predicts words, then learns them."""

    def __init__(self, tables: np.ndarray):
        self.tables = tables
        self.weights = np.full((GATES, ORDERS + 1), 0.3, np.float32)
        self.weights[:, ORDERS] = 0
        centre = 1 / (1 + np.exp(-(np.arange(LEVELS) - LEVELS // 2) / 2.0))
        self.ones = np.tile(centre * 8, (GATES, 1))
        self.seen = np.full((GATES, LEVELS), 8.0)

    def learn(self, words: list[bytes], known: bool) -> np.ndarray:
        """log10 probability of the spelling of each word. known: the tables count these words, which is undone first."""
        out = []
        for data, place, lengths in word_blocks(words):
            slots, bits, size = bit_events(data, place)
            n = len(bits)
            odds = np.empty((ORDERS + 1, n), np.float32)
            odds[ORDERS] = 0.3
            longest, times = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for k in range(ORDERS):
                counts = self.tables[k][slots[k]].astype(np.int32)
                if known:
                    counts[np.arange(n), bits] -= 1
                    np.maximum(counts, 0, out=counts)
                odds[k] = LOG_COUNT[counts[:, 1]] - LOG_COUNT[counts[:, 0]]
                total = counts.sum(1)
                longest = np.where(total > 0, k + 1, longest)
                times = np.where(total > 0, total, times)
            gate = 3 * longest + (times > 1) + (times > 4)
            mixed = (self.weights[gate].T * odds).sum(0)
            p = 1 / (1 + np.exp(-np.clip(mixed, -16, 16).astype(np.float64)))
            level = np.clip(np.rint(mixed * 2).astype(np.int64) + LEVELS // 2, 0, LEVELS - 1)
            refined = self.ones[gate, level] / self.seen[gate, level]
            final = np.clip((p + refined) / 2, 1e-7, 1 - 1e-7)
            cost = np.log10(np.where(bits == 1, final, 1 - final))
            bits_a_word = np.add.reduceat(size, np.cumsum(lengths) - lengths)
            out.append(np.add.reduceat(cost, np.cumsum(bits_a_word) - bits_a_word))
            if known:
                error = bits - p
                each = np.maximum(np.bincount(gate, minlength=GATES), 64)[:, None]
                step = np.stack([np.bincount(gate, error * odds[k], GATES) for k in range(ORDERS + 1)], 1)
                self.weights += (RATE * step / each).astype(np.float32)
                cell = gate * LEVELS + level
                self.ones += np.bincount(cell, bits, GATES * LEVELS).reshape(GATES, LEVELS)
                self.seen += np.bincount(cell, minlength=GATES * LEVELS).reshape(GATES, LEVELS)
        return np.concatenate(out) if out else np.zeros(0)


def crcs(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words))


def chunk_tokens(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words by falling frequency, the number of every word among them, words a text."""
    words, counts = split_words(translated(texts, LOWER))
    coded = words.dictionary_encode()
    index, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
    by = np.argsort(-np.bincount(index, minlength=n), kind="stable")
    rank = np.empty(n, np.int64)
    rank[by] = np.arange(n)
    return coded.dictionary.take(pa.array(by)).cast(pa.large_binary()).to_pylist(), rank[index] if n else index, counts


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, code, whether short) of each word."""
    if not words:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, bool)
    size = np.fromiter(map(len, words), np.int64, len(words))
    data, ends = np.frombuffer(b"".join(words), np.uint8).astype(np.uint32), np.cumsum(size)
    first, last = ends - size, ends - 1
    head = data[first] << 8 | data[np.minimum(first + 1, last)]
    tail = data[last] << 8 | data[np.maximum(last - 1, first)]
    half = CODE // 2
    code = (head * np.uint32(0x9E3779B1) >> np.uint32(32 - half)) << np.uint32(half) | tail * np.uint32(0x85EBCA6B) >> np.uint32(32 - half)
    return crcs(words).astype(np.uint32), code.astype(np.int64), size <= 3


def context_bases(crc: np.ndarray, short: np.ndarray, counts: np.ndarray, bits: int) -> list[np.ndarray]:
    """First slot of the context of each token: by the word before, and by the last short word before. crc and short: of each token."""
    n = len(crc)
    begin = np.repeat(np.cumsum(counts) - counts, counts)
    at = np.arange(n)
    before = np.where(at > begin, np.concatenate([[0], crc[:-1]]), 0) if n else crc
    last = np.maximum.accumulate(np.where(short, at, -1)) if n else at
    last = np.concatenate([[-1], last[:-1]]) if n else at
    sparse = np.where(last >= begin, crc[last], 1) if n else crc
    return [((x.astype(np.uint32) * np.uint32(m)) >> np.uint32(32 - (bits - CODE))).astype(np.int64) << CODE for x, m in ((before, 0x9E3779B1), (sparse, 0xC2B2AE35))]


def long_contexts(crc: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(every token with LONG words before it in its text; its bucket, hash of these words and hash of the token in one
    number). crc: of each token."""
    place = np.arange(len(crc)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.flatnonzero(place >= LONG)
    x = np.zeros(len(at), np.uint64)
    for k in range(1, LONG + 1):
        x = (x ^ crc[at - k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    follows = (crc[at] * np.uint32(0x85EBCA6B) >> np.uint32(32 - FOLLOWER)).astype(np.uint64)
    return at, (x % np.uint64(buckets)) << np.uint64(PAIR) | (x >> np.uint64(64 - PAIR + FOLLOWER)) << np.uint64(FOLLOWER) | follows


def follow_codes(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What a text learns at each pair of context and follower. pairs: distinct, in order; counts: in training texts.

    0: nothing follows the context elsewhere; 1 to 4: this one does most often; 5 to 8: another one. The four stand for
    FOLLOWS. Low four bits: seen from an occurrence in a training text, which doesn't count itself; high four: from others.
    """
    context = pairs >> np.uint64(FOLLOWER)
    new = np.concatenate([[True], context[1:] != context[:-1]])
    group, first = np.cumsum(new) - 1, np.flatnonzero(new)
    by = np.lexsort((-counts, group))
    total, top, best = np.add.reduceat(counts, first), counts[by[first]], by[first]
    size = np.diff(np.append(first, len(pairs)))
    second = np.where(size > 1, counts[by[np.minimum(first + 1, len(by) - 1)]], 0)

    def code(all_, most, hit):
        surety = np.where(most < all_, 3, np.where(all_ > 3, 2, np.where(all_ > 1, 1, 0)))
        return np.where(all_ > 0, surety + np.where(hit, 1, 5), 0)

    is_best = best[group] == np.arange(len(pairs))
    others = np.where(is_best, second[group], top[group])
    less = counts - 1
    out = code(total[group], top[group], is_best) << 4
    return (out | np.where(counts > 0, code(total[group] - 1, np.maximum(others, less), less > others), 0)).astype(np.uint8)


def told(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """follow_codes() of some TOLD pairs at a time; pairs of one context stay together."""
    context = pairs >> np.uint64(FOLLOWER)
    cuts = np.unique(np.searchsorted(context, context[::TOLD])).tolist()
    return np.concatenate([follow_codes(pairs[s:e], counts[s:e]) for s, e in zip(cuts, [*cuts[1:], len(pairs)])])


def table_bits(size: int) -> int:
    """Bits of the slots of a context for a corpus of so many bytes."""
    return int(min(MOST_BITS, max(16, np.ceil(np.log2(max(size, 2))) - 5)))


class CodeCounts:
    """How often each code follows in each context, in one task's training texts."""

    def __init__(self, bits: int):
        self.n = np.zeros((CONTEXTS, 1 << bits), np.uint32)
        self.codes = np.zeros(1 << CODE, np.int64)

    def add(self, code: np.ndarray, bases: list[np.ndarray]) -> None:
        self.codes += np.bincount(code, minlength=1 << CODE)
        for k, base in enumerate(bases):
            self.n[k] += np.bincount(base + code, minlength=self.n.shape[1]).astype(np.uint32)

    def rows(self) -> list[tuple[int, bytes, bytes]]:
        """(slice, places, counts) of what isn't zero; slice -1 has the codes."""
        out = [(-1, b"", self.codes.astype("<i8").tobytes())]
        for s, part in enumerate(self.n.reshape(-1, SLICE_SLOTS)):
            at = np.flatnonzero(part)
            if len(at):
                out.append((s, packed(np.diff(at, prepend=0).astype("<u4")), packed(part[at].astype("<u4"))))
        return out


def place_counts(codes: np.ndarray) -> np.ndarray:
    """(contexts, 2**CODE, 2): how often each bit follows at each place in the code, from (contexts, 2**CODE) counts of codes."""
    out = np.zeros((*codes.shape, 2), np.int64)
    for depth in range(CODE):
        out[:, 1 << depth : 2 << depth] = codes.reshape(len(codes), 1 << depth, 2, -1).sum(3)
    return out


def odds_table(counts: np.ndarray) -> np.ndarray:
    """Log odds times SCALE for (slots, 2) counts: by 2 * slot + bit without that bit's own occurrence, then with all."""
    n0, n1 = counts[:, 0].astype(np.float64), counts[:, 1].astype(np.float64)

    def odds(zero, one):
        return np.clip(np.rint(SCALE * np.log((np.maximum(one, 0) + 0.4) / (np.maximum(zero, 0) + 0.4))), -127, 127).astype(np.int8)

    every = odds(n0, n1)
    return np.concatenate([np.stack([odds(n0 - 1, n1), odds(n0, n1 - 1)], 1).ravel(), np.stack([every, every], 1).ravel()])


class Mixer:
    """The code tables of a corpus, and the mixing of a text's decisions."""

    def __init__(self, contexts: np.ndarray, codes: np.ndarray, once: int, words: int):
        """contexts: (CONTEXTS, slots) counts of codes in contexts; codes: of each code; once: of words that occur once; words: all."""
        plain = place_counts(codes[None])[0]
        plain[0] = once, words - once
        contexts = [place_counts(x.reshape(-1, 1 << CODE)).reshape(-1, 2) for x in contexts]
        self.tables = [odds_table(plain), *map(odds_table, contexts)]
        total = contexts[0].sum(1)
        self.trust = (total > 2).astype(np.int8) + (total > 40)

    def costs(self, code: np.ndarray, known: np.ndarray, held: np.ndarray, follow: np.ndarray, bases: list[np.ndarray], counts: np.ndarray) -> np.ndarray:
        """log10 probability of each token's decisions. All but counts (tokens a text) by token."""
        out, ends = np.zeros(len(code)), np.cumsum(counts)
        groups = np.searchsorted(ends, np.arange(LANES, len(code) + LANES, LANES)) + 1 if len(code) else []
        low = 0
        for high in np.unique(np.minimum(groups, len(counts))).tolist():
            if high > low:
                s, e = int(ends[low] - counts[low]), int(ends[high - 1])
                out[s:e] = self._lanes(code[s:e], known[s:e], held[s:e], follow[s:e], [b[s:e] for b in bases], counts[low:high])
                low = high
        return out

    def _lanes(self, code, known, held, follow, bases, counts) -> np.ndarray:
        docs, starts = len(counts), np.cumsum(counts) - counts
        sets = docs * DECISIONS * SETS
        weights = np.repeat(np.array(START, np.float32)[:, None], sets, 1)
        scale = np.ones(docs * DECISIONS, np.float32)
        own = np.zeros((docs << CODE, 2), np.float32)
        out = np.zeros(len(code))
        begin, block = 0, 32
        while (live := np.flatnonzero(counts > begin)).size:
            n = np.minimum(counts[live], begin + block) - begin
            doc = np.repeat(live, n)
            t = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + begin + starts[doc]
            # Arrays (DECISIONS, tokens): a row about known words, CODE rows, and one about the word that follows.
            shape = DECISIONS, len(t)
            bits, counted, chosen = np.empty(shape, np.int64), np.empty(shape, bool), np.empty(shape, np.int64)
            nodes = np.zeros((CODE + 1, len(t)), np.int64)
            of, says = code[t], follow[t].astype(np.int64)
            hit = (says > 0) & (says < 5)
            bits[0], counted[0], counted[1:-1] = known[t], ~hit, (known[t] == 1) & ~hit
            bits[-1], counted[-1] = hit, says > 0
            for d in range(CODE):
                nodes[d + 1], bits[d + 1] = (1 << d) | (of >> (CODE - d)), (of >> (CODE - 1 - d)) & 1
            slot, which = nodes << 1 | bits[:-1], np.arange(DECISIONS)[:, None] + doc * DECISIONS
            inputs = np.zeros((INPUTS - 1, *shape), np.float32)
            inputs[0, :-1] = self.tables[0][slot + (held[t] << (CODE + 1))]
            for k, base in enumerate(bases):
                table = self.tables[k + 1]
                inputs[k + 1, 1:-1] = table[slot[1:] + (base[t] * 2 + held[t] * (len(table) // 2))]
            inputs[:-1] *= np.float32(1 / SCALE)
            inputs[-1, :-1] = np.log((own[:, 1] + np.float32(0.4)) / (own[:, 0] + np.float32(0.4)))[nodes + (doc << CODE)]
            surety = np.maximum(says - 1, 0) & 3
            inputs[0, -1] = (np.array(FOLLOWS, np.float32) / np.float32(START[0]))[surety]
            chosen[:] = which * SETS
            chosen[1:-1] += self.trust[nodes[1:] + bases[0][t]]
            chosen[-1] += surety
            mixed = weights[INPUTS - 1][chosen] * ALWAYS
            for k, x in enumerate(inputs):
                mixed += weights[k][chosen] * x
            np.clip(mixed, -12, 12, out=mixed)
            p = 1 / (1 + np.exp(-mixed))
            refined = scale[which] * mixed
            final = np.clip(1 / (1 + np.exp(-refined)), 1e-6, 1 - 1e-6)
            cost = np.log10(np.where(bits == 1, final, 1 - final))
            cost[~counted] = 0
            out[t] = cost.sum(0, dtype=np.float64)
            # Learning from the whole block: a step along the mean of its gradients, nearly whole once there are many.
            error = np.where(counted, bits - p, np.float32(0))
            flat, times = chosen.ravel(), np.bincount(chosen.ravel(), counted.ravel(), sets)
            for k in range(INPUTS):
                slope = error * (inputs[k] if k < INPUTS - 1 else ALWAYS)
                weights[k] += (STEP * np.bincount(flat, slope.ravel(), sets) / (times + STEADY)).astype(np.float32)
            slope = np.where(counted, bits - final, np.float32(0)) * mixed
            scale += (0.2 * np.bincount(which.ravel(), slope.ravel(), len(scale)) / (times.reshape(-1, SETS).sum(1) + 24)).astype(np.float32)
            own += np.bincount((slot + (doc << (CODE + 1))).ravel(), minlength=2 * len(own)).reshape(own.shape)
            begin, block = begin + block, min(block if not begin else 2 * block, MOST_BLOCK)
        return out


def bucket_runs(pairs: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of each bucket in sorted numbers of long_contexts()."""
    bucket = (pairs >> np.uint64(PAIR)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    return list(zip(bucket[starts].tolist(), starts.tolist(), np.append(starts[1:], len(bucket)).tolist()))


def chunk_words(docs: DataFrame, buckets: int, bits: int) -> DataFrame:
    """For every chunk of texts: a row with its texts as numbers of words, and a row of words and counts a bucket. For
    every task: rows of code counts.

    docs: doc_id, text, held_out. kind: 0 texts, 1 words of a bucket, 2 code counts of a slice (bucket). Words are numbered
    by falling frequency in the chunk; a row of words keeps that order. times: from training texts.
    """
    schema = "kind int, chunk long, bucket int, words binary, times binary, doc_id array<long>, held_out array<boolean>, n_bytes array<long>, n_words array<long>, names binary, tokens binary"
    kinds = {"kind": pa.int32(), "chunk": pa.int64(), "bucket": pa.int32(), "words": pa.binary(), "times": pa.binary(), "doc_id": pa.list_(pa.int64()), "held_out": pa.list_(pa.bool_()), "n_bytes": pa.list_(pa.int64()), "n_words": pa.list_(pa.int64()), "names": pa.binary(), "tokens": pa.binary()}

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in kinds.items()], names=list(kinds))

    def run(batches):
        codes = CodeCounts(bits)
        for k, table in enumerate(chunked(batches, 8 << 20)):
            chunk = TaskContext.get().partitionId() << 24 | k
            texts = strings(table["text"])
            names, index, counts = chunk_tokens(texts)
            crc, code, short = word_features(names)
            held = table["held_out"].to_numpy()
            learnt = np.repeat(~held, counts)
            times = np.bincount(index[learnt], minlength=len(names))
            codes.add(code[index[learnt]], [b[learnt] for b in context_bases(crc[index], short[index], counts, bits)])
            bucket = (crc % buckets).astype(np.int32)
            yield batch_of([{"kind": 0, "chunk": chunk, "words": packed(bucket), "doc_id": table["doc_id"].to_pylist(), "held_out": held.tolist(), "n_bytes": np.diff(np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]).tolist(), "n_words": counts.tolist(), "names": zstandard.ZstdCompressor(level=1).compress(b" ".join(names)), "tokens": packed(index.astype("<u4"))}])
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                at = order[cuts[b] : cuts[b + 1]]
                rows.append({"kind": 1, "chunk": chunk, "bucket": b, "words": zstandard.ZstdCompressor(level=1).compress(b" ".join([names[i] for i in at.tolist()])), "times": packed(times[at].astype("<u4"))})
            yield batch_of(rows)
            del rows, names, index, learnt, times, texts, table
            release()
        for s, at, n in codes.rows():
            yield batch_of([{"kind": 2, "bucket": s, "words": at, "times": n}])

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, schema)


def names_of(data: bytes) -> list[bytes]:
    """The distinct words of a chunk, from its row."""
    raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31)
    return raw.split(b" ") if raw else []


def chunk_pairs(texts: DataFrame, buckets: int) -> DataFrame:
    """For every chunk and bucket: the chunk's distinct rows of LONG words and the one that follows, and how often training
    texts have them. texts: rows of kind 0. They aren't staged, as reading them off the texts again costs less than disk."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch[c][k].as_py() for c in ("chunk", "names", "tokens", "n_words", "held_out")}
                index, n = unpacked(row["tokens"], "<u4"), np.array(row["n_words"], np.int64)
                if n.max(initial=0) <= LONG:
                    continue
                at, pairs = long_contexts(crcs(names_of(row["names"])).astype(np.uint32)[index], n, buckets)
                learnt = np.repeat(~np.array(row["held_out"], bool), n)[at]
                del row, index, at
                pairs, which = np.unique(pairs, return_inverse=True)
                times = np.bincount(which, learnt, len(pairs)).astype("<u4")
                del which, learnt
                rows = [(b, packed(np.diff(pairs[s:e] & np.uint64((1 << PAIR) - 1), prepend=np.uint64(0))), packed(times[s:e])) for b, s, e in bucket_runs(pairs)]
                b, words, times = zip(*rows)
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([batch["chunk"][k].as_py()] * len(rows), pa.int64()), "bucket": pa.array(b, pa.int32()), "words": pa.array(words, pa.binary()), "times": pa.array(times, pa.binary())})
                del rows, words, times, pairs
                release()

    return texts.select("chunk", "names", "tokens", "n_words", "held_out").mapInArrow(run, "chunk long, bucket int, words binary, times binary")


def summed(table: pa.Table) -> tuple[pa.Table, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's rows by chunk, its distinct words in order of hash, their counts, and where each row's words are."""
    table = table.sort_by("chunk")
    lists = [zstandard.ZstdDecompressor().decompress(w, max_output_size=1 << 31).split(b" ") for w in table["words"].to_pylist()]
    sizes = np.array([len(x) for x in lists])
    coded = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode()
    del lists
    index, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
    counts = np.bincount(index, np.concatenate([unpacked(t, "<u4") for t in table["times"].to_pylist()]), len(names)).astype(np.int64)
    crc = crcs(names)
    order = np.array(sorted(range(len(names)), key=lambda i: (crc[i], names[i])), np.int64)
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    return table, [names[i] for i in order.tolist()], counts[order], place[index], sizes


def summed_slices(rows: DataFrame, width: int) -> list:
    """Sums of rows (slice, at, n) of sparse counts, each slice in one task; slice -1 has plain longs."""

    def add(batches):
        # At most all slices at once, whatever the number of rows.
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, at, n in zip(*(batch[c].to_pylist() for c in ("slice", "at", "n"))):
                if s < 0:
                    sums[s] = sums.get(s, 0) + np.frombuffer(n, "<i8")
                else:
                    sums.setdefault(s, np.zeros(width, np.int64))[np.cumsum(unpacked(at, "<u4"), dtype=np.int64)] += unpacked(n, "<u4")
        for s, own in sums.items():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([s], pa.int32()), "n": pa.array([own.astype("<i8").tobytes() if s < 0 else packed(own.astype("<i8"))], pa.binary())})

    return rows.repartition(partitions(rows.sparkSession), "slice").mapInArrow(add, "slice int, n binary").collect()


def whole(rows: list, slices: int, width: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The table of all slices, and slice -1."""
    table, plain = np.zeros((slices, width), np.int64), None
    for row in rows:
        if row.slice < 0:
            plain = np.frombuffer(row.n, "<i8")
        else:
            table[row.slice] = unpacked(row.n, "<i8")
    return table, plain


def train(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The bit tables of spelling, and totals: words, kinds, kinds seen once."""
    width = 2 * (ORDERS << TABLE_BITS) // SLICES

    def count(key, table):
        release()
        _, names, counts, _, _ = summed(table)
        tables = bit_counts([names[i] for i in np.flatnonzero(counts).tolist()]).reshape(SLICES, width)
        totals = np.array([counts.sum(), (counts > 0).sum(), (counts == 1).sum()])
        rows = {"slice": [-1], "at": [b""], "n": [totals.astype("<i8").tobytes()]}
        for s, part in enumerate(tables):
            at = np.flatnonzero(part)
            if len(at):
                rows["slice"].append(s)
                rows["at"].append(packed(np.diff(at, prepend=0).astype("<u4")))
                rows["n"].append(packed(part[at].astype("<u4")))
        return pa.table({"slice": pa.array(rows["slice"], pa.int32()), "at": pa.array(rows["at"], pa.binary()), "n": pa.array(rows["n"], pa.binary())})

    tables, totals = whole(summed_slices(words.groupBy("bucket").applyInArrow(count, "slice int, at binary, n binary"), width), SLICES, width)
    # Counts above what 16 bits hold shrink slot by slot, so that no other slot loses by it.
    tables = tables.reshape(-1, 2)
    over = np.maximum(1, -(-tables.max(1, keepdims=True) // 65_000))
    return -(-tables // over).astype(np.uint16).reshape(ORDERS, -1, 2), totals if totals is not None else np.zeros(3, np.int64)


def score(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, held_out; texts that aren't held out train. Scores of all texts.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.
    """
    spark = docs.sparkSession
    size, ends = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(~F.col("held_out"))).first()
    bits, buckets = table_bits(size), min(MOST_BUCKETS, max(1, -(-size // BUCKET_BYTES)))
    corpus = staged(chunk_words(docs, buckets, bits), "corpus")
    words = corpus.where("kind = 1").select("chunk", "bucket", "words", "times")
    spelling, totals = train(words)
    n_words, kinds, once = (int(x) for x in totals)
    slices = corpus.where("kind = 2").select(F.col("bucket").alias("slice"), F.col("words").alias("at"), F.col("times").alias("n"))
    contexts, codes = whole(summed_slices(slices, SLICE_SLOTS), (CONTEXTS << bits) // SLICE_SLOTS, SLICE_SLOTS)
    codes = codes if codes is not None else np.zeros(1 << CODE, np.int64)
    mixer = Mixer(contexts.reshape(CONTEXTS, -1), codes, once, n_words)
    tokens, distinct = n_words + ends, kinds + (ends > 0)
    end_share = ends / tokens if ends and n_words else 0.5
    sent_spelling = spark.sparkContext.broadcast(spelling)  # ORDERS * 2**TABLE_BITS slots of four bytes: 20 MB
    sent_mixer = spark.sparkContext.broadcast(mixer)  # CONTEXTS * 2**bits slots of five bytes: 10 MB at most

    def answer(key, table):
        release()
        table, names, counts, index, sizes = summed(table)
        speller, value = Speller(sent_spelling.value), np.zeros(len(names), np.float32)
        # Only words that training texts hold once at most are ever spelt; the former teach the weights.
        for n in (1, 0):
            at = np.flatnonzero(counts == n)
            value[at] = speller.learn([names[i] for i in at.tolist()], n == 1)
        at = np.split(index, np.cumsum(sizes)[:-1])
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "times": pa.array([packed(np.minimum(counts[i], 2**32 - 1).astype("<u4")) for i in at], pa.binary()), "value": pa.array([packed(value[i].astype("<f4")) for i in at], pa.binary())})

    def followers(key, table):
        # One text a chunk is counted once for each of its distinct rows of words, so hot ones stay small.
        release()
        table = table.sort_by("chunk")
        lists = [np.cumsum(unpacked(w, "<u8")) for w in table["words"].to_pylist()]
        sizes = [len(x) for x in lists]
        lists = np.concatenate(lists)
        pairs, which = np.unique(lists, return_inverse=True)
        del lists
        counts = np.bincount(which, np.concatenate([unpacked(t, "<u4") for t in table["times"].to_pylist()]), len(pairs)).astype(np.int64)
        said = np.split(told(pairs, counts)[which], np.cumsum(sizes)[:-1])
        return pa.table({"chunk": table["chunk"], "bucket": pa.array([-1 - b for b in table["bucket"].to_pylist()], pa.int32()), "times": pa.array([packed(x) for x in said], pa.binary()), "value": pa.nulls(len(said), pa.binary())})

    reply = "chunk long, bucket int, times binary, value binary"
    answers = words.groupBy("bucket").applyInArrow(answer, reply)
    texts = corpus.where("kind = 0").select("chunk", "words", "doc_id", "held_out", "n_bytes", "n_words", "names", "tokens")
    answers = answers.unionByName(chunk_pairs(texts, buckets).groupBy("bucket").applyInArrow(followers, reply))

    def total(key, left_rows, right):
        release()
        rows, mixer = [], sent_mixer.value
        for row in left_rows.to_pylist():
            bucket = unpacked(row["words"], "<i4")
            by = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
            times, spelt, said = np.zeros(len(bucket), np.int64), np.zeros(len(bucket)), {}
            for b, t, v in zip(*(right[x].to_pylist() for x in ("bucket", "times", "value"))):
                if b < 0:
                    said[-1 - b] = unpacked(t, "u1")
                    continue
                at = by[cuts[b] : cuts[b + 1]]
                times[at], spelt[at] = unpacked(t, "<u4"), unpacked(v, "<f4")
            names = names_of(row["names"])
            index, n = unpacked(row["tokens"], "<u4").astype(np.int64), np.array(row["n_words"], np.int64)
            held = np.array(row["held_out"], bool)
            least = np.log10(tokens + distinct + 1)
            known, base = sums_by_text((times > 0).astype(np.int64)[index], n), sums_by_text((np.log10(times + 1) - least)[index], n)
            base = base + np.log10(ends + 1) - least
            own = token_costs(mixer, names, index, n, held, times, spelt, codes, bits, buckets, said)
            value = sums_by_text(own, n) + n * np.log10(1 - end_share) + np.log10(end_share)
            size = np.array(row["n_bytes"], np.int64)
            rows.append(pa.table({"doc_id": pa.array(row["doc_id"], pa.int64()), "held_out": pa.array(held), "n_tokens": n + 1, "n_known": known.astype(np.int64) + (ends > 0), "train_tokens": np.full(len(n), tokens, np.int64), "base_score": base, "score": value, "bits_per_byte": -value * np.log2(10) / np.maximum(size, 1)}))
        return pa.concat_tables(rows)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(total, schema)


def said_of(crc: np.ndarray, n: np.ndarray, buckets: int, said: dict[int, np.ndarray]) -> np.ndarray:
    """What follow_codes() says of each token, 0 where it has fewer than LONG words before it. crc: of each token."""
    at, pairs = long_contexts(crc, n, buckets)
    pairs, which = np.unique(pairs, return_inverse=True)
    follow = np.zeros(len(crc), np.uint8)
    if len(pairs):
        follow[at] = np.concatenate([said[b] for b, _, _ in bucket_runs(pairs)])[which]
    return follow


def token_costs(mixer: Mixer, names: list[bytes], index: np.ndarray, n: np.ndarray, held: np.ndarray, times: np.ndarray, spelt: np.ndarray, codes: np.ndarray, bits: int, buckets: int, said: dict[int, np.ndarray]) -> np.ndarray:
    """log10 probability of every token. names, times, spelt: of distinct words; index: of tokens; n, held: of texts;
    said: of each bucket, what follow_codes() says of this chunk's rows of words."""
    crc, code, short = word_features(names)
    held = np.repeat(held, n).astype(np.int64)
    follow = said_of(crc[index], n, buckets, said)
    follow = np.where(held == 1, follow >> 4, follow & 15)
    left = times[index] - 1 + held
    known = (left > 0).astype(np.int64)
    code = code[index]
    costs = mixer.costs(code, known, held, follow, context_bases(crc[index], short[index], n, bits), n)
    share = np.log10(np.maximum(left, 1)) - np.log10(np.maximum(codes[code] - 1 + held, 1))
    return costs + np.where((follow > 0) & (follow < 5), 0, np.where(known == 1, share, spelt[index]))


def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (crc_mod("doc_id", 7) == 2).alias("held_out"))
    return score(docs)
