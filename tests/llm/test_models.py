import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tamis.llm import context_mixing as cm
from tamis.llm import language_id as li
from tamis.llm.shared import crc_mod, read

# ---- language ID ----


def held(doc, n, r):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % n == r


def test_held_out_languages(spark, sf):
    docs = {r.doc_id: r for r in read(spark, sf, "documents").collect()}
    rows = li.op1_language_id(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == held(r.doc_id, 5, 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in docs[r.doc_id].text or ""))
        assert r.languages == [] or (r.languages[0] == r.lang_pred and math.isclose(sum(r.shares), 1, abs_tol=1e-6) and r.shares == sorted(r.shares, reverse=True))
    judged = [r for r in rows if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in judged]) >= 0.9


ENGLISH = "the house stands near the river and the people of the village walk there every evening when the weather is good"
GERMAN = "das haus steht am fluss und die leute aus dem dorf gehen jeden abend dorthin wenn das wetter schön ist"
FRENCH = "la maison est près de la rivière et les gens du village y vont chaque soir quand il fait beau temps"


def model(spark):
    rows = [(t, lang) for t, lang in ((ENGLISH, "en"), (GERMAN, "de"), (FRENCH, "fr")) for _ in range(3)]
    return li.fit(spark.createDataFrame([*rows, ("ignored", None), (None, "xx")], "text string, lang string"))


def test_mixtures(spark):
    texts = [ENGLISH, f"{ENGLISH} {GERMAN} {ENGLISH} {GERMAN}", f"{ENGLISH} {GERMAN} {FRENCH}", f"{ENGLISH} {ENGLISH} {ENGLISH} {FRENCH}", "the", "12 34 !?", None, ""]
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], "doc_id long, text string, score_ string, languages_ string").coalesce(1)
    rows = {r.doc_id: r for r in li.identify(df, model(spark)).collect()}
    assert rows[0].languages == ["en"] and rows[0].score == 1
    assert set(rows[1].languages) == {"de", "en"} and abs(rows[1].shares[0] - 0.5) < 0.1
    assert set(rows[2].languages) == {"de", "en", "fr"}
    assert rows[3].languages == ["en", "fr"] and abs(rows[3].score - 0.75) < 0.1
    assert rows[4].lang_pred == "en"
    assert all((rows[k].lang_pred, rows[k].score, rows[k].languages) == ("und", 0, []) for k in (5, 6, 7))


def plain_mixture(like):
    """Shares over all languages by a long EM run, from the even start."""
    shares = np.full(like.shape[1], 1 / like.shape[1])
    for _ in range(3000):
        joint = shares * like
        shares = (joint / joint.sum(1, keepdims=True)).mean(0)
    return shares


def test_em_finds_the_likeliest_shares():
    rng = np.random.default_rng(4)
    logp = rng.normal(0, 3, (200, 3)) + np.repeat(np.eye(3) * 8, [120, 50, 30], axis=0)
    found = li.mixtures(logp, np.array([200]), rounds=400)[0]
    assert np.abs(found - plain_mixture(np.exp(logp - logp.max(1, keepdims=True)))).max() < 0.01


def test_languages_of_odd_rows(spark, odd_docs, no_docs):
    fitted = li.fit(odd_docs)
    rows = li.identify(odd_docs, fitted, ["doc_id", "text", "rank", "block"]).collect()
    assert len(rows) == odd_docs.count() and {r.lang_pred for r in rows} <= {"en", "de", "und"}
    assert li.identify(no_docs, fitted, ["doc_id"]).count() == 0
    nothing = li.fit(no_docs)
    assert {r.lang_pred for r in li.identify(odd_docs, nothing, ["doc_id"]).collect()} == {"und"}


def test_a_small_language_and_a_hot_text_are_learnt_alike(spark, sf):
    rows = [(r.text, r.lang) for r in read(spark, sf, "documents").where("lang is not null").collect()]
    rare = [("zzq xqz qqx zxq " * 5 + f"qz{k}", "rare") for k in range(3)]
    df = spark.createDataFrame(rows * 20 + [rows[0]] * 3000 + rare, "text string, lang string")
    langs, logs = li.fit(df, fit_rows=30)
    assert "rare" in langs
    got = li.identify(spark.createDataFrame([("zzq xqz qqx",), (rows[0][0],)], "text string"), (langs, logs)).collect()
    assert [r.lang_pred for r in got] == ["rare", rows[0][1]]
    assert li.fit(df, fit_rows=30, most_langs=2)[0] == sorted(x for x, _ in Counter(lang for _, lang in set(rows)).most_common(2))


# ---- context mixing ----


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_scores(docs):
    words = {k: words_of(t) for k, (_, t) in enumerate(docs)}
    out, counts, ends = [], Counter(), 0
    for k, (doc, _) in enumerate(docs):
        if not held(doc, 7, 2):
            counts.update(words[k])
            ends += 1
    n, kinds = sum(counts.values()) + ends, len(counts) + (ends > 0)
    for k, (doc, _) in enumerate(docs):
        terms = [counts[w] for w in words[k]] + [ends]
        base = sum(math.log10((c + 1) / (n + 1 * (kinds + 1))) for c in terms)
        out.append((doc, held(doc, 7, 2), len(terms), sum(c > 0 for c in terms), n, base))
    return out


def compare(rows, want):
    def key(r):
        return repr(tuple(r)[:5]), round(r[5], 6)

    rows, want = sorted(rows, key=key), sorted(want, key=key)
    assert [tuple(r)[:5] for r in rows] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in rows], [r[5] for r in want], rtol=1e-9)


def test_scores(spark, sf):
    docs = [tuple(r) for r in read(spark, sf, "documents").select("doc_id", "text").collect()]
    rows = cm.op7_context_mixing(spark, sf).collect()
    compare(rows, plain_scores(docs))
    unseen = [r for r in rows if r.held_out]
    # The base gives every unknown word the same share, so over all texts it sums to more than one. Spelling unknown
    # words byte by byte, each byte and the word's end as one of 257, makes it a distribution to compare with.
    texts, trained = dict(docs), {w for d, t in docs if not held(d, 7, 2) for w in words_of(t)}
    spelt = sum((len(w.encode()) + 1) * math.log10(257) for r in unseen for w in words_of(texts[r.doc_id]) if w not in trained)
    assert all(r.score < 0 for r in rows) and sum(r.score for r in unseen) > sum(r.base_score for r in unseen) - spelt
    # However rows are dealt out, scores are the same.
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        dealt = read(spark, sf, "documents").repartition(5).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (crc_mod("doc_id", 7) == 2).alias("held_out"))
        again = {r.doc_id: r.score for r in cm.score(dealt).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(math.isclose(again[r.doc_id], r.score, rel_tol=1e-9) for r in rows)
    for r in rows:
        assert math.isclose(r.bits_per_byte, -r.score * math.log2(10) / max(1, len((texts[r.doc_id] or "").encode())), rel_tol=1e-9)


def plain_model(docs, bits):
    """Scores of docs (id, text, held_out), one decision after the other; only spelling is the library's."""
    size = cm.CODE
    words = {d: [w.encode() for w in words_of(t)] for d, t, _ in docs}
    counts = Counter(w for d, _, h in docs if not h for w in words[d])

    def mix32(x, m):
        return (x * m) & 0xFFFFFFFF

    def code_of(w):
        head, tail = w[0] << 8 | w[min(1, len(w) - 1)], w[-1] << 8 | w[max(len(w) - 2, 0)]
        return (mix32(head, 0x9E3779B1) >> 32 - size // 2) << size // 2 | mix32(tail, 0x85EBCA6B) >> 32 - size // 2

    def contexts(ws):
        """For each word: the word before and the last short word, hashed."""
        last, short, out = 0, 1, []
        for w in ws:
            out.append((0, mix32(last, 0x9E3779B1) >> (32 - (bits - size)), mix32(short, 0xC2B2AE35) >> (32 - (bits - size))))
            last = zlib.crc32(w)
            short = last if len(w) <= 3 else short
        return out

    def context(before):
        """The hash of three words, as for a corpus of one bucket."""
        x = 0
        for w in reversed(before):
            x = (x ^ zlib.crc32(w)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
            x ^= x >> 29
        return x >> 64 - cm.PAIR + cm.FOLLOWER

    def follower(w):
        return mix32(zlib.crc32(w), 0x85EBCA6B) >> 32 - cm.FOLLOWER

    seen, codes = [Counter() for _ in range(3)], Counter()
    for d, _, h in docs:
        for w, at in zip(words[d], contexts(words[d])):
            if not h:
                codes[code_of(w)] += 1
                for k in range(3):
                    for depth in range(size):
                        seen[k][at[k], 1 << depth | code_of(w) >> (size - depth), code_of(w) >> (size - 1 - depth) & 1] += 1
    after = defaultdict(Counter)
    for d, _, h in docs:
        for k in range(3, len(words[d]), 2):
            after[context(words[d][k - 3 : k])][follower(words[d][k])] += not h
    n, once = sum(counts.values()), sum(c == 1 for c in counts.values())
    seen[0][0, 0, 0], seen[0][0, 0, 1] = once, n - once
    new = sorted({w for ws in words.values() for w in ws if counts[w] < 2}, key=lambda w: (zlib.crc32(w), w))
    speller, spelt = cm.Speller(np.minimum(cm.bit_counts(list(counts)), 65_000).astype(np.uint16)), {}
    for k in (1, 0):
        own = [w for w in new if counts[w] == k]
        spelt.update(zip(own, speller.learn(own, k == 1).tolist()))
    tokens = n + sum(not h for _, _, h in docs)
    end, out = sum(not h for _, _, h in docs) / tokens, {}
    for d, _, h in docs:
        weights, scale = defaultdict(lambda: list(cm.START)), defaultdict(lambda: 1.0)
        own, total, ws = Counter(), 0.0, words[d]
        places, begin, block = contexts(ws), 0, 32
        while begin < len(ws):
            slopes, times, turns, later = defaultdict(lambda: [0.0] * 5), Counter(), Counter(), []
            for place, (w, at) in enumerate(zip(ws[begin : begin + block], places[begin : begin + block]), begin):
                left = counts[w] - (not h)
                known, code = int(left > 0), code_of(w)
                others = Counter(after[context(ws[place - 3 : place])]) if place >= 3 and place % 2 else Counter()
                own_hash = follower(w)
                if others:
                    others[own_hash] -= not h
                most, hit = max(others.values(), default=0), 0
                if most > 0:
                    rivals = max((c for x, c in others.items() if x != own_hash), default=0)
                    hit = int(others[own_hash] > rivals or h and own_hash == min(x for x, c in others.items() if c == most))
                    all_ = sum(others.values())
                    surety = 3 if most < all_ else 2 if all_ > 3 else 1 if all_ > 1 else 0
                    chosen, odds = (size + 1, surety), cm.FOLLOWS[surety] / cm.START[0]
                    mixed = max(-12, min(12, weights[chosen][0] * odds + 0.3 * weights[chosen][4]))
                    p, final = (1 / (1 + math.exp(-y)) for y in (mixed, scale[size + 1] * mixed))
                    total += math.log10(final if hit else 1 - final)
                    slopes[chosen][0] += (hit - p) * odds
                    slopes[chosen][4] += (hit - p) * 0.3
                    times[chosen] += 1
                    turns[size + 1] += (hit - final) * mixed
                for step in range(1 + size):
                    later.append((0, known) if not step else (1 << (step - 1) | code >> (size + 1 - step), code >> (size - step) & 1))
                if hit:
                    continue
                for step in range(1 + size * known):
                    node, bit = (0, known) if not step else (1 << (step - 1) | code >> (size + 1 - step), code >> (size - step) & 1)
                    x = []
                    for k in range(3):
                        zero, one = (seen[k][at[k], node, b] - (not h and b == bit) for b in (0, 1))
                        x.append(0.0 if k and not step else max(-127, min(127, np.rint(12 * math.log((max(one, 0) + 0.4) / (max(zero, 0) + 0.4))))) / 12)
                    x += [math.log((own[node, 1] + 0.4) / (own[node, 0] + 0.4)), 0.3]
                    held_n = seen[1][at[1], node, 0] + seen[1][at[1], node, 1]
                    chosen = step, 0 if not step else (held_n > 2) + (held_n > 40)
                    mixed = max(-12, min(12, sum(a * b for a, b in zip(weights[chosen], x))))
                    p, final = (1 / (1 + math.exp(-y)) for y in (mixed, scale[step] * mixed))
                    total += math.log10(final if bit else 1 - final)
                    for k in range(5):
                        slopes[chosen][k] += (bit - p) * x[k]
                    times[chosen] += 1
                    turns[step] += (bit - final) * mixed
                total += math.log10(left / (codes[code] - (not h))) if known else spelt[w]
            for chosen in times:
                weights[chosen] = [a + cm.STEP * b / (times[chosen] + cm.STEADY) for a, b in zip(weights[chosen], slopes[chosen])]
            for step in turns:
                scale[step] += 0.2 * turns[step] / (sum(v for (s, _), v in times.items() if s == step) + 24)
            own.update(later)
            begin, block = begin + block, block if not begin else 2 * block
        out[d] = total + len(ws) * math.log10(1 - end) + math.log10(end)
    return out


def test_scores_agree_with_one_decision_after_the_other(spark, sf):
    texts = [r.text for r in read(spark, sf, "documents").orderBy("doc_id").limit(40).collect()]
    docs = [(k, t, k % 5 == 2) for k, t in enumerate([*texts, texts[3], "", None, "word word word new", "x"])]
    df = spark.createDataFrame([(k, t or "", h) for k, t, h in docs], "doc_id long, text string, held_out boolean")
    want = plain_model(docs, cm.table_bits(sum(len((t or "").encode()) for _, t, _ in docs)))
    for r in cm.score(df).collect():
        assert math.isclose(r.score, want[r.doc_id], rel_tol=2e-5), r


def test_a_text_that_occurs_twice_is_cheap(spark, sf):
    texts = [r.text for r in read(spark, sf, "documents").orderBy("doc_id").collect()]
    sole = [t for t, n in Counter(texts).items() if n == 1 and t and len(t) > 600]
    rows = [(k, t, False) for k, t in enumerate([*sole, sole[5], sole[9]])]
    got = {r.doc_id: r.bits_per_byte for r in cm.score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).collect()}
    assert max(got[k] for k in (5, 9, len(sole), len(sole) + 1)) < 0.75 * sorted(got.values())[len(got) // 2]


def test_what_follows(spark):
    def pairs(*rows):
        return np.array([a << cm.FOLLOWER | b for a, b, _ in rows], np.uint64), np.array([n for _, _, n in rows])

    # (context, follower, times): alone, twice, a tie, a majority, only in held-out texts, and several.
    codes = cm.follow_codes(*pairs((1, 1, 1), (2, 1, 2), (3, 1, 1), (3, 2, 1), (4, 1, 3), (4, 2, 1), (5, 1, 0), (6, 1, 9), (7, 1, 5), (7, 2, 0)))
    assert [int(c & 15) for c in codes] == [0, 1, 5, 5, 4, 6, 0, 3, 3, 0]
    assert [int(c >> 4) for c in codes] == [1, 2, 4, 8, 4, 8, 0, 3, 3, 7]


def test_every_word_behind_three_others_is_looked_up(spark):
    texts = ["a b c d e f g", "x y", "A b c d", "", "q a b c d e f g"]
    names, index, counts = cm.chunk_tokens(pa.array(texts, pa.large_string()))
    at, pairs = cm.long_contexts(cm.crcs(names).astype(np.uint32)[index], counts, 5)
    rows = [words_of(t) for t in texts]
    first = np.cumsum([0, *map(len, rows)])
    fours = {int(first[k]) + j: tuple(ws[j - 3 : j + 1]) for k, ws in enumerate(rows) for j in range(3, len(ws))}
    assert at.tolist() == list(fours)
    assert len({*zip(fours.values(), pairs.tolist())}) == len({*fours.values()}) == len({*pairs.tolist()})

    # So each word of a passage that training texts hold is told by what follows there, wherever in a text it stands.
    passage = [f"{chr(97 + k % 26)}{k * 7919 % 1009}{chr(97 + k * k % 26)}" for k in range(203)]
    rows = [(k, " ".join(passage), False) for k in range(3)] + [(k, f"{k}s " + " ".join(sorted(passage, key=lambda w: zlib.crc32(f"{k}{w}".encode()))), False) for k in range(3, 9)]
    rows += [(100, " ".join(passage), True), (101, "q " + " ".join(passage), True)]
    got = {r.doc_id: r.score for r in cm.score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).collect()}
    assert min(got[100], got[101]) > -60


def test_words_in_another_order_score_otherwise(spark, sf):
    texts = [r.text for r in read(spark, sf, "documents").orderBy("doc_id").limit(60).collect()]
    probe = max(texts, key=lambda t: len(t or "") if len(t or "") < 3000 else 0)
    other = " ".join(sorted(words_of(probe)))
    rows = [(k, t or "", False) for k, t in enumerate(texts)] + [(100, probe, True), (101, other, True)]
    got = {r.doc_id: r.score for r in cm.score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).collect()}
    assert got[100] > got[101] + 5


def test_scores_of_odd_rows(spark, odd_docs, no_docs):
    def asked(df):
        return df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (crc_mod("doc_id", 7) == 2).alias("held_out"))

    rows = cm.score(asked(odd_docs)).collect()
    compare(rows, plain_scores([tuple(r) for r in odd_docs.select("doc_id", "text").collect()]))
    assert all(np.isfinite(r.score) and r.score < 0 for r in rows)
    assert cm.score(asked(no_docs)).count() == 0
    # Nothing to learn from.
    lone = cm.score(asked(odd_docs).where("held_out")).collect()
    assert lone and all(r.train_tokens == 0 and r.n_known == 0 and np.isfinite(r.score) for r in lone)


def test_a_spelling_model_is_a_distribution(spark):
    """Under trained tables the probabilities of all one- and two-byte words sum to at most one, and to most of it with longer ones."""
    words = [w.encode() for w in "ab ba aa bb abba baab a b ab".split()]
    speller = cm.Speller(np.minimum(cm.bit_counts(words), 65_000).astype(np.uint16))
    speller.learn(words, True)
    letters = [bytes([b]) for b in range(256) if b != 32]
    total = sum(10.0 ** speller.learn(letters, False))
    pairs = [a + b for a in letters for b in (b"a", b"b", b"c")]
    assert 0 < total + sum(10.0 ** speller.learn(pairs, False)) <= 1 + 1e-6
    assert speller.learn([b"ab"], False)[0] > speller.learn([b"qz"], False)[0]


def test_prefix_code_is_complete():
    assert math.isclose(sum(2.0 ** -int(s) for s in cm.SIZE), 1)


def test_texts_that_all_words_of_a_vocabulary_make_stay_below_one(spark):
    """Scores of all one-word texts over a small vocabulary are probabilities: their sum is below one."""
    train = [(k, "red blue red green blue red") for k in range(40)]
    probes = [(1000 + k, w) for k, w in enumerate(["red", "blue", "green", "", "grey", "red red", "blue green"])]
    df = spark.createDataFrame([(k, t, False) for k, t in train] + [(k, t, True) for k, t in probes], "doc_id long, text string, held_out boolean")
    got = {r.doc_id: r.score for r in cm.score(df).where("held_out").collect()}
    assert sum(10.0**s for s in got.values()) < 1 and got[1000] > got[1002] > got[1004]
