"""Language identification as a mixture of languages.

Each language gets a character trigram model. A text is a bag of words; every word is drawn from one language of
the text's mixture with a likelihood from its n-grams. Expectation-maximisation estimates the proportions, and the
language set grows greedily from the best single language while twice the gain in log-likelihood pays a penalty
of log(words) for each language that joins (BIC).

Cases: a null text or one without a letter gives `und`, score 0 and an empty mixture. With no labelled row at all,
every text gives `und`. Repeated rows give repeated results; ties go to the language that sorts first.
Null ids count as the empty string in the fold rule. Other columns of the input are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm.shared import byte_table, chunked, crc_mod, kept, read, release, split_words, strings, sums_by_text, translated

#: Labelled texts that the n-gram model of one language is fitted on, about, and the languages that are learnt at most.
FIT_ROWS, MOST_LANGS = 10_000, 1_000
BITS = 16
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>, shares array<double>, n_words long"
#: Letters and bytes of longer code points; everything else parts words.
LETTERS = byte_table(lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128)


def word_grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the byte trigrams and of their first two bytes for all words, edges marked by spaces; grams a word."""
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words.cast(pa.string())), " ")[0].as_buffer() if len(words) else None
    if joined is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.concatenate([[32], np.frombuffer(joined, np.uint8), [32]]).astype(np.uint32)
    pair = data[:-1] << 8 | data[1:]
    # A gram ends at each byte after the first of a word, and at the space behind it.
    slots = (pair[:-1].astype(np.uint64) << np.uint64(8) | data[2:].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)
    inside = (pair[:-1] & 255) != 32
    counts = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    return slots[inside].astype(np.int64), pair[:-1][inside].astype(np.int64), counts


def prepared(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the index of every word, words a text."""
    words, counts = split_words(translated(pc.utf8_lower(strings(table["text"])), LETTERS))
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, most_langs: int = MOST_LANGS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probabilities of hashed trigrams given their first two bytes, for each of them.

    docs: columns text and lang. Each language learns from about fit_rows distinct texts, those with the least hashes,
    or all if it has fewer, so that neither a large language nor many copies of a text crowd out others. The most_langs
    languages with the most distinct texts are learnt. The counts are summed on the executors into one bounded table for each task.
    """
    docs = docs.where("text is not null and lang is not null").select("text", "lang")
    sizes = docs.select("lang", F.xxhash64("text")).distinct().groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs)
    shares = [(r.lang, int(min(1.0, fit_rows / r.n) * 2**32)) for r in sizes.collect()]
    if shares:
        share = docs.sparkSession.createDataFrame(shares, "l string, share long")
        docs = docs.join(F.broadcast(share), F.col("lang") == F.col("l")).where(F.xxhash64("text").bitwiseAND(2**32 - 1) < F.col("share")).select("text", "lang")
    docs = docs.distinct()
    size = 1 << BITS

    def counts(batches):
        seen: dict[str, np.ndarray] = {}
        for table in chunked(batches, 16 << 20):
            words, index, n_words = prepared(table)
            slots, pairs, lens = word_grams(words)
            langs = table["lang"].to_pylist()
            owner = np.repeat(np.arange(len(langs)), n_words)
            for lang in set(langs):
                mine = np.array([x == lang for x in langs])
                times = np.repeat(np.bincount(index[mine[owner]], minlength=len(words)), lens)
                both = seen.setdefault(lang, np.zeros(2 * size, np.int64))
                both[:size] += np.bincount(slots, times, size).astype(np.int64)
                both[size:] += np.bincount(pairs, times, size).astype(np.int64)
        for lang, both in seen.items():
            at = np.flatnonzero(both)
            yield pa.RecordBatch.from_pydict({"lang": [lang], "at": [at.astype("<i4").tobytes()], "n": [both[at].astype("<i8").tobytes()]})

    def summed(key, table):
        both = np.zeros(2 * size, np.int64)
        for at, n in zip(table["at"].to_pylist(), table["n"].to_pylist()):
            both[np.frombuffer(at, "<i4")] += np.frombuffer(n, "<i8")
        return pa.table({"lang": [key[0].as_py()], "n": [both.astype("<i8").tobytes()]})

    # One row of a megabyte for each language comes back: bounded by the number of languages.
    rows = docs.mapInArrow(counts, "lang string, at binary, n binary").groupBy("lang").applyInArrow(summed, "lang string, n binary").collect()
    rows = sorted((r.lang, np.frombuffer(r.n, "<i8")) for r in rows)
    logs = []
    for _, both in rows:
        tri, pair = both[:size].astype(np.float64), both[size:].astype(np.float64)
        logs.append((np.log(tri + 0.05), np.log(pair + 0.05 * 64)))
    langs = [x for x, _ in rows]
    return langs, np.array([np.concatenate(x) for x in logs], np.float32).T.copy() if langs else np.zeros((2 * size, 0), np.float32)


def ascend(like: np.ndarray, sets: np.ndarray, counts: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM over words: like (words, k) are likelihoods in the k languages of each text's set; shares and log-likelihood."""
    shares = sets / sets.sum(1, keepdims=True)
    owner = np.repeat(np.arange(len(counts)), counts)
    for _ in range(rounds):
        joint = shares[owner] * like
        joint /= joint.sum(1, keepdims=True)
        shares = sums_by_text(joint, counts) / np.maximum(counts, 1)[:, None]
    return shares, sums_by_text(np.log((shares[owner] * like).sum(1)), counts)


def mixtures(logp: np.ndarray, counts: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Shares (texts, languages) of each text from its words' log-likelihoods, by greedy growth of the set."""
    n, k = len(counts), logp.shape[1]
    total = sums_by_text(logp, counts)
    best = total.argmax(1)
    owner = np.repeat(np.arange(n), counts)
    shares = np.zeros((n, k))
    shares[np.arange(n), best] = 1
    ll = total[np.arange(n), best]
    live = np.flatnonzero((counts > 1) & (k > 1))
    while len(live):
        flag = np.zeros(n, bool)
        flag[live] = True
        at = np.flatnonzero(flag[owner])
        sub, c = logp[at], counts[live]
        who = np.repeat(np.arange(len(live)), c)
        top = sub.max(1, keepdims=True)
        like = np.exp(sub - top)
        now = (shares[live][who] * like).sum(1)
        gain = np.full((len(live), k), -np.inf)
        for lang in range(k):
            ratio = like[:, lang] / np.maximum(now, 1e-300)
            for step in (0.03, 0.3):
                gain[:, lang] = np.maximum(gain[:, lang], sums_by_text(np.log1p(step * (ratio - 1)), c))
        gain[shares[live] > 0] = -np.inf
        pick, price = gain.argmax(1), np.log(np.maximum(c, 2)) / 2
        # A step of at most 0.3 towards a language that belongs to the text gains most of what EM can reach.
        hopeful = gain.max(1) > 0.25 * price
        if not hopeful.any():
            break
        live, keep = live[hopeful], hopeful[who]
        like, c, top = like[keep], c[hopeful], top[keep, 0]
        sets = (shares[live] > 0).astype(float)
        sets[np.arange(len(live)), pick[hopeful]] = 1
        new, value = ascend(like, sets, c, rounds)
        value += sums_by_text(top, c)
        better = value - ll[live] > price[hopeful]
        shares[live[better]], ll[live[better]] = new[better], value[better]
        live = live[better & (sets.sum(1) < k)]
    return shares


MADE = ("lang_pred", "score", "languages", "shares", "n_words")


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Adds lang_pred, score (the share of lang_pred), languages and shares (all of the set, largest first), n_words.

    docs needs a text column; the columns in keep go along, but for any named like one of these. prefix: stands before
    the names of all five.
    """
    spark, (langs, logs) = docs.sparkSession, model
    made = [prefix + c for c in MADE]
    keep = kept(keep if keep is not None else docs.columns, tuple(made))
    sent = spark.sparkContext.broadcast((langs, logs))  # half a megabyte a language
    docs = docs.select(*keep, F.col("text").alias("__text"), F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("__letter"))
    fields = docs.select(*keep).schema

    def run(batches):
        langs, logs = sent.value
        for table in chunked(batches, 4 << 20):
            words, index, counts = prepared(table.select(["__text"]).rename_columns(["text"]))
            slots, pairs, lens = word_grams(words)
            letter = table["__letter"].to_numpy() & bool(langs)
            if langs:
                word_logp = sums_by_text(logs[slots] - logs[pairs + (1 << BITS)], lens).astype(np.float32)
                shares = mixtures(word_logp[index], counts)
                shares[counts == 0] = 0
            else:
                shares = np.zeros((len(counts), 1))
            order = np.argsort(-shares, axis=1, kind="stable")
            ranked = np.take_along_axis(shares, order, 1)
            found = letter & (counts > 0)
            pred = [langs[o[0]] if f else "und" for o, f in zip(order, found)]
            names = [[langs[i] for i, s in zip(o, r) if s > 0] if f else [] for o, r, f in zip(order, ranked, found)]
            parts = [[min(1.0, float(s)) for s in r if s > 0] if f else [] for r, f in zip(ranked, found)]
            out = {c: table[c] for c in keep} | dict(zip(made, (pa.array(pred, pa.string()), np.where(found, np.clip(ranked[:, 0], 0, 1), 0.0), pa.array(names, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64())), counts)))
            yield from pa.table(out).to_batches()
            release()

    return docs.mapInArrow(run, _with(fields, ", ".join(f"{c} {kind}" for c, kind in zip(made, ("string", "double", "array<string>", "array<double>", "long")))))


def _with(fields, more: str):
    from pyspark.sql.types import StructType, _parse_datatype_string

    return StructType([*fields.fields, *_parse_datatype_string(more).fields])


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", "lang", (crc_mod("doc_id", 5) == 0).alias("held_out"))
    model = fit(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score", "languages", "shares", "n_words")
