import hashlib
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from xxhash import xxh3_128_hexdigest

from tamis.llm import fingerprints as fps
from tamis.llm import licenses, sentencepiece as sp, token_files as tf
from tamis.llm.shared import new_folder, read
from tests.llm.conftest import TEXTS


def in_order(rows):
    return sorted(rows, key=repr)


# ---- SentencePiece ----


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)


def test_pieces_agree_with_the_library(spark, sf, library):
    got = {r.doc_id: r for r in sp.op3_sentencepiece(spark, sf).collect()}
    docs = read(spark, sf, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        assert got[d.doc_id].ids == library.encode(d.text or ""), d.doc_id
        assert got[d.doc_id].n_pieces == len(got[d.doc_id].ids)


def test_pieces_of_odd_rows(spark, odd_docs, no_docs, library):
    got = sp.encode(odd_docs, ["doc_id", "text", "block"]).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert r.ids == library.encode(r.text or ""), r.text
        assert r.decoded_equal == (sp.decode(sp.vocabulary(open(sp.MODEL, "rb").read()), r.ids) == (r.text or ""))
    plain = [r for r in got if r.text and "▁" not in r.text and r.text.strip() == r.text and "  " not in r.text and unicodedata.normalize("NFKC", r.text) == r.text]
    assert plain and all(r.decoded_equal for r in plain)
    assert sp.encode(no_docs, ["doc_id"]).count() == 0


def test_slices_change_nothing(library, monkeypatch):
    v = sp.Vocabulary(open(sp.MODEL, "rb").read())
    texts = [t or "" for t in TEXTS]
    monkeypatch.setattr(sp, "SLICE", 50)
    ids, sizes = sp.encode_batch(v, texts)
    assert ids.tolist() == [i for t in texts for i in library.encode(t)] and sizes.tolist() == [len(library.encode(t)) for t in texts]


def test_suffix_array_and_edges():
    codes = np.array([1, 2, 1, 2, 1, 0, 2, 2, 1, 0])
    order = sp.suffix_array(codes, 10)
    assert order.tolist() == sorted(range(10), key=lambda i: codes[i:].tolist() + [0] * 10)


# ---- fingerprints ----


def plain_canonical(text):
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", " ".join(text.split())).casefold()).split())


def plain_rows(docs):
    docs = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [t or "" for _, t in docs]
    out = []
    for k, (doc, _) in enumerate(docs):
        text, following = texts[k], texts[(k + 1) % len(texts)]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        a, b, c = (xxh3_128_hexdigest(plain_canonical(t).encode()) for t in (text, changed, following))
        out.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), a, b, float(a == b), float(a == c)))
    least = {}
    for (doc, _), text in zip(docs, texts):
        if doc is not None:
            least[plain_canonical(text)] = min(least.get(plain_canonical(text), doc), doc)
    return [(*row, least.get(plain_canonical(t))) for row, t in zip(out, texts)]


def test_fingerprint_query(spark, sf):
    docs = [tuple(r) for r in read(spark, sf, "documents").select("doc_id", "text").collect()]
    assert in_order(map(tuple, fps.op8_fingerprints(spark, sf).collect())) == in_order(plain_rows(docs))


@pytest.mark.parametrize("keep", [None, 0, 1, 2])
def test_fingerprint_query_over_odd_tables(spark, odd_docs, tmp_path, keep):
    docs = odd_docs if keep is None else odd_docs.limit(keep)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text").collect()]
    assert in_order(map(tuple, fps.op8_fingerprints(spark, str(tmp_path)).collect())) == in_order(plain_rows(docs))


def test_canonical_forms_and_groups(spark):
    texts = ["Hello  World", "hello\tworld ", "ＨＥＬＬＯ world", "straße", "STRASSE", "ﬁne", "FINE", "é", "é", None, "", " \n", "other"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in fps.exact_groups(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 7, 9: 9, 10: 9, 11: 9, 12: 12}


def test_equal_hashes_with_other_bytes_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(fps, "fingerprints", lambda docs, keep, text="text": docs.select(*keep, F.lit("same").alias("fingerprint"), F.col(text).alias("canonical")))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    assert {r.doc_id: r.group_id for r in fps.exact_groups(docs).collect()} == {1: 1, 2: 2, 3: 1}


# ---- token files ----


def plain_tokens(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tf.vocabulary_path())
    t.encode_special_tokens = True
    start, out = 0, []
    for doc, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_file_query(spark, sf):
    docs = [tuple(r) for r in read(spark, sf, "documents").select("doc_id", "text").collect()]
    assert in_order(map(tuple, tf.op9_token_files(spark, sf).collect())) == in_order(plain_tokens(docs))


def test_token_files_of_odd_rows(spark, odd_docs, no_docs):
    # Rows of one id and text are alike, so only their order is open, and it shows nowhere.
    shards = tf.write_tokens(odd_docs, new_folder(spark, "odd"))
    got = tf.read_tokens(shards).select("doc_id", "start", (F.length("ids") / 4).cast("long"), F.crc32("ids")).collect()
    assert in_order(map(tuple, got)) == in_order(plain_tokens([tuple(r) for r in odd_docs.select("doc_id", "text").collect()]))
    assert tf.read_tokens(tf.write_tokens(no_docs, new_folder(spark, "none"))).count() == 0
    small = tf.write_tokens(odd_docs, new_folder(spark, "small"), shard_tokens=50)
    assert small.count() > shards.count()
    rolled = tf.read_tokens(small).select("doc_id", "start", (F.length("ids") / 4).cast("long"), F.crc32("ids")).collect()
    assert in_order(map(tuple, rolled)) == in_order(map(tuple, got))


def test_words_that_a_model_parts_elsewhere(monkeypatch):
    model = open(tf.vocabulary_path(), encoding="utf-8").read()
    texts = pa.array(["one two three", "four  five", ""], pa.large_string())
    want = tf.encode_texts(model, texts)
    t, spaced, _ = tf.tokenizer(model)
    monkeypatch.setattr(tf, "tokenizer", lambda m: (t, np.ones_like(spaced), tf.Runs()))  # every id seems to begin a word
    got = tf.encode_texts(model, texts)
    assert [x.tolist() for x in got] == [x.tolist() for x in want]


def test_shards_answer_lookups(spark, tmp_path):
    rng = np.random.default_rng(0)
    ids = sorted(int(x) for x in rng.integers(-(2**63), 2**63 - 1, 500))
    writer = tf.Writer(pa.OSFile(f"{tmp_path}/one.sst", "wb"), 2)
    held = {}
    for k in [None, *ids, ids[-1]]:
        run = rng.integers(0, 50_000, rng.integers(1, 400))
        held.setdefault(k, []).append(run.tolist())
        writer.add(tf.key_of(k), run)
    writer.close()
    reader = tf.Reader(pa.memory_map(f"{tmp_path}/one.sst"))
    assert len(reader.index) > 3 and reader.docs == 502
    for k, runs in held.items():
        assert [r.tolist() for r in reader.lookup(k)] == runs
    missing = [x + 1 for x in ids[:-1] if x + 1 not in held]
    assert all(reader.lookup(x) == [] for x in missing)
    assert sum(reader.bloom.may_hold(tf.key_of(x)) for x in missing) < 0.05 * len(missing)
    with pytest.raises(ValueError):
        writer.add(tf.key_of(ids[0]), rng.integers(0, 9, 3))


def test_a_damaged_block_is_found(tmp_path):
    writer = tf.Writer(pa.OSFile(f"{tmp_path}/one.sst", "wb"), 2)
    writer.add(tf.key_of(1), np.arange(100))
    writer.close()
    data = bytearray(open(f"{tmp_path}/one.sst", "rb").read())
    data[20] ^= 1
    open(f"{tmp_path}/bad.sst", "wb").write(data)
    with pytest.raises(ValueError):
        list(tf.Reader(pa.memory_map(f"{tmp_path}/bad.sst")))


# ---- licences ----


def plain_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_license_query(spark, sf):
    docs = {r.doc_id: r.text for r in read(spark, sf, "documents").collect()}
    rows = licenses.op10_license_scan(spark, sf).collect()
    assert len(rows) == len(docs) and any(r.n_base for r in rows)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(docs[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_licenses_of_odd_rows(spark, odd_docs, no_docs):
    rows = licenses.scan(odd_docs, ["doc_id", "text", "rank"]).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(r.text)
    assert licenses.scan(no_docs, ["doc_id"]).count() == 0


def test_templates_align_through_small_changes(spark):
    texts = [
        "// permission is hereby granted, free of charge, to any person obtaining a copy of this software and its documentation files the software to deal in the software without restriction",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "permission is hereby granted", "the licence of the house", "GNU General Public License GNU general public license", "software forms binary source use",
    ]
    rows = licenses.scan(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"), ["doc_id"]).orderBy("doc_id").collect()
    assert [r.labels for r in rows] == ["mit", "bsd", "", "", "gpl", ""]
    assert 0.75 <= rows[0].score < 1 and rows[1].score == 1 and rows[4].n_base == 2 and (rows[4].first_word, rows[4].last_word) == (0, 4)
    assert rows[0].matches[0].start == 0


def test_files_with_several_notices_keep_all_labels(spark):
    rng = np.random.default_rng(1)
    notices = [(label, words) for label, _, words in licenses.TEMPLATES]
    picks = [list(range(len(notices)))] + [sorted(rng.choice(len(notices), n, replace=False).tolist()) for n in (2, 3, 4) for _ in range(40)]
    texts = [" and then ".join(notices[i][1] for i in p) for p in picks]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"]).collect()
    for r in rows:
        assert {notices[i][0] for i in picks[r.doc_id]} <= set(r.labels.split(",")) and r.score == 1


def plain_labels(text):
    """Labels by trying every template at every place, with a full table of longest rows of words."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out = set(filter(None, plain_base(text)[4].split(",")))
    for label, phrases, t in licenses.TEMPLATES:
        t = t.split()
        if all(f" {p} " in f" {' '.join(words)} " for p in phrases):
            for start in range(-len(t), len(words)):
                low, high = max(0, start), min(len(words), start + len(t) + licenses.DRIFT)
                row = [0] * (len(t) + 1)
                for p in range(low, high):
                    new = row[:]
                    for q in range(len(t)):
                        hit = words[p] == t[q] and 0 <= p - q - start <= licenses.DRIFT
                        new[q + 1] = max(new[q], row[q + 1], row[q] + 1 if hit else 0)
                    row = new
                if row[-1] >= licenses.COVER * len(t):
                    out.add(label)
    return ",".join(sorted(out))


def test_labels_agree_with_every_template_at_every_place(spark):
    rng = np.random.default_rng(4)
    texts = []
    for label, _, t in licenses.TEMPLATES:
        for n in range(4):
            words = t.split()
            for _ in range(n * max(1, len(words) // 12)):
                k = int(rng.integers(0, len(words) + 1))
                words = words[:k] + ["inserted"] + words[k:] if rng.random() < 0.5 else words[:k] + words[k + 1 :]
            texts.append("code before " + " ".join(words) + " code behind")
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"]).collect()
    got = {r.doc_id: r.labels for r in rows}
    # A mandatory phrase may stand beside the stretch only in texts that this test doesn't make.
    assert got == {k: plain_labels(t) for k, t in enumerate(texts)}
    assert sum(1 for g in got.values() if g) > len(texts) // 2


def test_an_inserted_word_shifts_nothing(spark):
    notice = next(t for label, _, t in licenses.TEMPLATES if label == "bsd").split()
    texts = [" ".join([*notice[:12], "extra", "words", *notice[12:]]), " ".join(notice[:14] + notice[15:])]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"]).orderBy("doc_id").collect()
    assert [(r.labels, r.score) for r in rows] == [("bsd", 1.0), ("bsd", (len(notice) - 1) / len(notice))]


def test_document_frequencies(spark, odd_docs):
    index = licenses.Index()
    df, n = licenses.document_frequencies(odd_docs)
    want = [sum(w in set(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (r.text or "").lower())) for r in odd_docs.select("text").collect()) for w in ("license", "apache")]
    assert n == odd_docs.count() and [int(df[index.number[w]]) for w in ("license", "apache")] == want


def test_clashing_columns_give_way(spark, odd_docs):
    from tamis.llm import language_id, simhash

    named = odd_docs.select("doc_id", "text", *[F.lit("x").alias(c) for c in ("ids", "n_pieces", "labels", "score", "matches", "canonical", "fingerprint", "component_id", "fp", "lang_pred", "shares")])
    keep = [c for c in named.columns if c != "text"]
    n = odd_docs.count()
    model = language_id.fit(odd_docs)
    for df in (sp.encode(named, keep), licenses.scan(named, keep), fps.fingerprints(named, keep), simhash.near_duplicates(named, keep=keep), language_id.identify(named, model, keep), language_id.identify(named, model, keep, prefix="__")):
        assert len(set(df.columns)) == len(df.columns) and df.count() == n and df.where("doc_id = 3").count() == 1


def test_workers_give_freed_memory_back():
    import ctypes
    import os

    from tamis.llm.shared import release

    def held():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20

    if not os.path.exists("/proc/self/statm") or not hasattr(ctypes.CDLL(None), "malloc_trim"):
        return
    # Blocks too large for Python's own pools, freed but for the last, which keeps the heap from shrinking by itself.
    blocks = [bytes(2_000) for _ in range(60_000)]
    del blocks[:-1]
    before = held()
    release()
    assert held() < before - 60
