import random
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from tamis.llm import language_id, mixing, registry, sentencepiece as sp
from tamis.llm.shared import read
from tests.llm.conftest import union_find

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def text_rows(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def shingles(text):
    words = [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def kept_of_groups(rows):
    """Rows (doc_id, text) that stay: of each group the one of the least id. For tables without null or repeated ids."""
    sets = [shingles(t) for _, t in rows]
    where, links = {}, []
    for k, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    for k, s in enumerate(sets):
        if s:
            both = Counter(j for x in s for j in where[x] if j > k)
            links += [(k, j) for j, n in both.items() if n >= 0.8 * (len(s) + len(sets[j]) - n)]
    empty = [k for k, s in enumerate(sets) if not s]
    links += [(empty[0], k) for k in empty[1:]]
    group, best = union_find(range(len(rows)), links), {}
    for k, row in enumerate(rows):
        best[group[k]] = min(best.get(group[k], row), row)
    return Counter(best.values())


def test_stages_and_their_names():
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "simhash_dedup", "mixing", "sentencepiece"]
    assert pipeline.ORACLE_SQL is None
    names = entry.queries()
    assert "pipeline" in names and {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 11))
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_every_stage_against_brute_force(spark, sf):
    docs = read(spark, sf, "documents")
    columns = docs.columns
    known = pipeline.known_language(spark, docs, sf).cache()
    assert known.columns == columns
    found = {r.doc_id: r for r in language_id.identify(docs, language_id.fit(docs), ["doc_id"]).collect()}
    want = Counter(tuple(r) for r in docs.collect() if found[r.doc_id].lang_pred != "und")
    assert text_rows(known, *columns) == want
    lost = [r.text for r in docs.collect() if (r.doc_id, r.text) not in {(k[0], k[1]) for k in want}]
    assert all(not re.search("[^\\W\\d_]", t or "") for t in lost)  # whatever has letters stays

    unique = pipeline.one_of_each(spark, known, sf).cache()
    assert unique.columns == columns
    rows = [(r.doc_id, r.text) for r in known.select("doc_id", "text").collect()]
    assert text_rows(unique, "doc_id", "text") == kept_of_groups(rows)

    mixed = pipeline.mixed_sources(spark, unique, sf).cache()
    assert mixed.columns == columns
    taken, words = {r.doc_id: r.taken for r in mixing.mix(unique).collect()}, Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert words == Counter({k: v for k, v in taken.items() if v})

    library = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    out = pipeline.encoded(spark, mixed, sf).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in out) == Counter((r.doc_id, tuple(library.encode(r.text))) for r in mixed.collect())


def test_the_whole_run(spark, sf):
    df = pipeline.run(spark, sf)
    rows = df.collect()
    assert rows and {"doc_id", "ids", "n_pieces"} <= set(df.columns)
    again = Counter((r.doc_id, tuple(r.ids)) for r in pipeline.run(spark, sf).collect())
    assert again == Counter((r.doc_id, tuple(r.ids)) for r in rows)


@pytest.mark.parametrize("stage", range(4))
def test_stages_take_odd_rows(spark, odd_docs, no_docs, stage):
    name, function = pipeline.STAGES[stage]
    out = function(spark, odd_docs, "")
    empty = function(spark, no_docs, "")
    if stage < 3:
        assert out.columns == odd_docs.columns and empty.columns == odd_docs.columns
    n, before = out.count(), odd_docs.count()
    assert 0 < n <= (2 * before if name == "mixing" else before) and empty.count() == 0
    if name == "simhash_dedup":
        sets = [shingles(r.text) for r in out.collect()]
        assert not any(a and b and len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])


def test_repeated_ids_are_no_duplicates(spark, no_docs):
    long = [" ".join(f"{w}{k}" for k in range(30)) for w in "abc"]
    rows = [(1, long[0]), (1, long[1]), (1, long[1] + " z"), (1, long[0]), (2, long[0]), (2, long[2]), (None, long[2]), (None, "only this"), (None, "only this"), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "web", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = Counter((r.doc_id, r.text) for r in pipeline.one_of_each(spark, docs, "").collect())
    either = kept.pop((1, long[1]), 0) + kept.pop((1, long[1] + " z"), 0)
    assert either == 1 and kept == Counter([(1, long[0]), (2, long[2]), (None, "only this"), (3, None)])


def test_sets_of_a_pattern_are_searched_through_trees():
    from tamis.llm import similar

    # Groups of 1, 2, 9, 64 and 700 fingerprints in families of near copies, each row with its place as its number.
    rng = np.random.default_rng(4)
    sizes = [1, 2, 9, 64, 700]
    group, n = np.repeat(np.arange(5), sizes), sum(sizes)
    x = rng.integers(0, 2**64, (n // 16 + 1, 2), np.uint64)[rng.integers(0, n // 16 + 1, n)]
    for step in range(9):  # bits that rows of a family differ in: few in the largest group
        x[np.arange(n), rng.integers(0, 2, n)] ^= np.where((group < 4) | (step < 1), np.uint64(1), np.uint64(0)) << rng.integers(0, 64, n).astype(np.uint64)
    order = similar.gray_order(group, x)

    def rank(k):
        value, out = int(x[k, 0]) << 64 | int(x[k, 1]), 0
        while value:
            out, value = out ^ value, value >> 1
        return out

    assert order.tolist() == sorted(range(n), key=lambda k: (group[k], rank(k), k))
    apart = np.bitwise_count(x[:, None] ^ x[None])
    i, j = np.nonzero((apart[:, :, 0] <= similar.FIRST) & (apart.sum(2) <= similar.RADIUS) & (group[:, None] == group[None]))
    want, seen = union_find(range(n), list(zip(i.tolist(), j.tolist()))), Counter()
    label, least = similar.linked_prints(group, x, seen).tolist(), {}
    for k in range(n):
        least.setdefault(want[k], k)
    assert label == [least[want[k]] for k in range(n)] and 20 < len(least) < n // 2
    # Whole groups go before their members meet.
    assert seen["dropped", 1] > 0 and seen["met", 0] < 0.4 * sum(k * k for k in sizes)


def test_slices_of_a_large_component_tell_few_links(spark, monkeypatch):
    from tamis.llm import similar

    monkeypatch.setattr(similar, "TEXTS", 8)
    monkeypatch.setattr(similar, "CELL", 16)
    rng = random.Random(2)
    base = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(60):
        words = list(base)
        for _ in range(3):
            words[rng.randrange(400)] = f"x{rng.random()}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, " ".join(f"{k}y{n}" for n in range(50))) for k in range(5)]
    told, real = [], similar.components

    def counted(df, a, b):
        told.append(df.distinct().count())
        return real(df, a, b)

    monkeypatch.setattr(similar, "components", counted)
    got = {r.doc_id: r.component_id for r in similar.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kept = {d for d, _ in kept_of_groups(rows)}
    assert {d for d, c in got.items() if d == c} == kept and told[1] <= 60 + (60 // 4 + 1) ** 2
