from collections import Counter
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tamis.llm.components import components
from tamis.llm.embeddings import near_vectors, op6_embedding_dedup, tables_for
from tamis.llm.shared import read
from tamis.llm.simhash import gray_rank, fingerprints, levels_of, link_fingerprints, link_groups, masks, near_duplicates, op2_simhash
from tests.llm.conftest import union_find


def plain_fingerprint(text, shingle=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    counts = [0] * 64
    shingles = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_components(rows):
    """doc -> (fingerprint, component) by comparing all pairs."""
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    distinct = sorted({p for _, p in prints})
    x = np.array(distinct, np.uint64)
    links = [(i, int(j)) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 4) if j > i]
    group = union_find(range(len(x)), links)
    least = {}
    for d, p in prints:
        g = group[distinct.index(p)]
        if d is not None:
            least[g] = min(least.get(g, d), d)
    return [(d, f"{p:016x}", least.get(group[distinct.index(p)])) for d, p in prints]


def in_order(rows):
    return sorted(rows, key=repr)


def test_simhash_query_agrees_with_all_pairs(spark, sf):
    docs = [tuple(r) for r in read(spark, sf, "documents").select("doc_id", "text").collect()]
    got = op2_simhash(spark, sf)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert in_order(map(tuple, got.collect())) == in_order(plain_components(docs))


def test_simhash_of_odd_rows(spark, odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    got = near_duplicates(odd_docs.select("doc_id", "text", "block", "rank")).select("doc_id", "fingerprint", "component_id").collect()
    assert in_order(map(tuple, got)) == in_order(plain_components(rows))
    assert near_duplicates(no_docs).count() == 0


def test_masks_leave_no_pair_out():
    rng = random.Random(3)
    for blocks in (5, 6, 8):
        table = masks(4, blocks)
        for _ in range(300):
            flipped = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(m & flipped == 0 for m in table)


def test_gray_order_changes_one_bit_a_step():
    codes = np.arange(4096, dtype=np.uint64) ^ (np.arange(4096, dtype=np.uint64) >> np.uint64(1))
    assert (gray_rank(codes) == np.arange(4096)).all()


def near_family(rng, n, size, spread):
    """n families of `size` fingerprints around random centres."""
    out = set()
    for _ in range(n):
        centre = rng.getrandbits(64)
        for _ in range(size):
            out.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(spread))))
    return sorted(out)


def all_pairs(x):
    return union_find(range(len(x)), [(i, int(j)) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 4) if j > i])


def same_classes(want, got):
    n = len(set(zip(want, got)))
    return n == len(set(want)) == len(set(got))


def test_trees_agree_with_all_pairs():
    # Groups of 1, 2, 3, 9, 70 and 600 fingerprints, all of which go through trees.
    rng = random.Random(5)
    groups = [np.array(near_family(rng, k, n, 8), np.uint64) for k, n in ((1, 1), (1, 2), (1, 3), (3, 3), (7, 10), (30, 20))]
    groups = [x[np.argsort(gray_rank(x), kind="stable")] for x in groups]
    group, x, seen = np.repeat(np.arange(len(groups)), [len(g) for g in groups]), np.concatenate(groups), Counter()
    levels = levels_of(group, x)
    assert len(levels[-1][0]) == len(groups) and len(levels) == 5
    label = link_groups(group, x, 4, seen)
    for k, own in enumerate(groups):
        at = np.flatnonzero(group == k)
        want = all_pairs(own)
        assert same_classes([want[i] for i in range(len(own))], label[at].tolist()) and set(label[at].tolist()) <= set(at.tolist())
    assert seen["dropped", 1] > 0  # whole groups go before their members meet


def test_the_tree_finds_all_links_of_a_table(spark):
    docs = read(spark, "/root/testdata/sf0.1", "documents")
    x = np.array(sorted({r.fp for r in fingerprints(docs, ["doc_id"]).select("fp").collect()})).astype(np.int64).view(np.uint64)
    found = {r.node: r.component for r in components(link_fingerprints(spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")), "a", "b").collect()}
    want = all_pairs(x)
    assert same_classes([want[i] for i in range(len(x))], [found.get(int(v), int(v)) for v in x.view(np.int64)]) and len(found) > 10
    seen = Counter()
    x = x[np.argsort(gray_rank(x), kind="stable")]
    label = link_groups(np.zeros(len(x), np.int64), x, 4, seen)
    want = all_pairs(x)
    assert same_classes([want[i] for i in range(len(x))], label.tolist())
    # One tree over the whole table prunes as it goes down.
    assert seen["dropped", 1] > 0 and seen["met", 0] < len(x) * (len(x) - 1) // 2


@pytest.mark.parametrize("cell", [64, 16_384])
def test_large_patterns_are_cut_and_stay_whole(spark, cell):
    rng = random.Random(9)
    # One hot pattern: fingerprints that share their upper bits, far above the cell size.
    x = sorted(set(near_family(rng, 4, 30, 6)) | {0xABCDEF << 40 | rng.getrandbits(14) for _ in range(400)})
    df = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in x], "fp long")
    found = {r.node: r.component for r in components(link_fingerprints(df, cell=cell), "a", "b").collect()}
    u = np.array(x, np.uint64)
    links = [(i, int(j)) for i in range(len(u)) for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 4) if j > i]
    want = union_find(range(len(u)), links)
    got = [found.get(int(v), int(v)) for v in u.view(np.int64)]
    assert len({(want[i], got[i]) for i in range(len(u))}) == len(set(want.values())) == len(set(got))


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(k, k + 1) for k in range(60)]
    star = [(1000, k) for k in range(1001, 1300)]
    links = chain + star + [(5, 5), (None, 3), (2000, None), *chain[:5], (7001, 7000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "p long, q long"), "p", "q").collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 1000 for k in range(1000, 1300)}, 7000: 7000, 7001: 7000}
    assert components(spark.createDataFrame([], "p long, q long"), "p", "q").count() == 0


def plain_vectors(rows, cosine=0.98):
    def sound(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = [(k, i, np.array(v, np.float64), label) for k, (i, v, label) in enumerate(rows) if label is not None and sound(v)]
    links = []
    for n, (a, _, x, la) in enumerate(good):
        for b, _, y, lb in good[n + 1 :]:
            if la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links.append((a, b))
    group = union_find(range(len(rows)), links)
    degree, least = [0] * len(rows), {}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[group[k]] = min(least.get(group[k], i), i)
    return [(i, degree[k], least.get(group[k]), i is not None and i == least.get(group[k])) for k, (i, _, _) in enumerate(rows)]


def test_embedding_query_agrees_with_all_pairs(spark, sf):
    rows = [tuple(r) for r in read(spark, sf, "embeddings").select("vec_id", "embedding", "label").collect()]
    got = op6_embedding_dedup(spark, sf)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert in_order(map(tuple, got.collect())) == in_order(plain_vectors(rows))


@pytest.mark.parametrize("cell", [8, 4096])
def test_odd_vectors(spark, cell):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((12, 16))
    rows = [(k, (base[k % 12] + 0.02 * rng.standard_normal(16) * (k % 5)).astype(np.float32).tolist(), k % 2) for k in range(80)]
    rows += [(100 + k, base[3].astype(np.float32).tolist(), 1) for k in range(20)]  # a hot group of copies
    rows += [(200, None, 1), (201, [], 1), (202, [0.0] * 16, 1), (203, [float("nan")] * 16, 1), (204, [1.0, None], 1), (205, [float("inf")] + [0.0] * 15, 0), (206, base[0].tolist(), None), (None, base[3].astype(np.float32).tolist(), 1), (100, base[3].astype(np.float32).tolist(), 1), (207, [1.0, 1.0], 1), (208, [2.0, 2.0], 1), (209, [-0.0, 3.0], 1), (210, [0.0, 3.0], 1), (211, [1e-30, 1e-30], 1), (212, [1e30, 1e30], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1)).withColumn("key", F.lit("x")).repartition(3)
    exact = [tuple(r)[:3] for r in df.collect()]
    got = near_vectors(df, cell=cell).collect()
    assert in_order(map(tuple, got)) == in_order(plain_vectors(exact))
    assert near_vectors(df.where("false")).count() == 0


def test_tables_reach_the_recall():
    for bits in (8, 16, 24):
        same = (1 - np.arccos(0.98) / np.pi) ** bits
        assert 1 - (1 - same) ** tables_for(0.98, bits, 0.999) >= 0.999


# ---- similar texts ----


def plain_shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def plain_similar(rows):
    """doc -> component by exact Jaccard similarity of all pairs."""
    sets = [plain_shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or (both := len(sets[i] & sets[j])) and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9]
    group = union_find(range(len(rows)), links)
    least = {}
    for (d, _), g in zip(rows, group.values()):
        least[g] = min(least.get(g, d), d)
    return {d: least[g] for (d, _), g in zip(rows, group.values())}


def changed_texts(rng, n, words):
    """Texts of random words, each with a copy in which a few words differ, so that similarities lie on both sides of 0.8."""
    rows = []
    for k in range(n):
        text = [f"w{rng.randrange(5000)}" for _ in range(words)]
        copy = list(text)
        for at in rng.sample(range(words), max(1, words * (1 + k % 4) // 120)):
            copy[at] = "other"
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(copy))]
    return rows


def test_the_pipeline_drops_what_is_similar_by_jaccard(spark):
    import corpus_pipeline

    rng = random.Random(5)
    rows = changed_texts(rng, 60, 240) + [(1000 + d, t) for d, t in changed_texts(rng, 20, 60)] + [(2000, None), (2001, ""), (2002, "few words"), (2003, "Few  words")]
    want = plain_similar(rows)
    pairs = {d: plain_fingerprint(t, 5) for d, t in rows}
    lost = [d for d, c in want.items() if d != c and (pairs[d] ^ pairs[c]).bit_count() > 4]
    assert len(lost) >= 15 and sum(want[d] == d for d in want if d % 2 and d < 2000) >= 15
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, "").collect()}
    assert got == set(want.values())


def test_sets_and_prints_in_slices(spark, monkeypatch):
    from tamis.llm import similar

    monkeypatch.setattr(similar, "CELL", 8)
    monkeypatch.setattr(similar, "SMALL", 4)
    base = [f"w{k}" for k in range(150)]
    rows = [(k, " ".join(base[:k] + ["x"] + base[k + 1 :])) for k in range(40)] + [(k + 100, f"a{k} b{k} c{k} d{k} e{k} f{k}") for k in range(20)]
    got = {r.doc_id: r.component_id for r in similar.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_similar(rows)


def test_labels_may_be_texts(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.001], "a"), (3, [1.0, 0.0], "b"), (4, [1.0, 0.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    assert {tuple(r)[:3] for r in near_vectors(df).collect()} == {(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4)}
