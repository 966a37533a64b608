import pytest

LONG = " ".join(f"w{k % 977}" for k in range(60_000))
TEXTS = [
    "The quick brown fox jumps over the lazy dog and runs away.", "the quick brown fox jumps over the lazy dog and runs away.", None, "", "   \t\n", "one", "Ünïcode İstanbul ΑΣ straße — “quoted” …", "zero\x00byte and \x1c separator",
    "a b", "no end", " lead and trail ", "日本語 の テキスト です", "😀 emoji 🎉 text", "MIT License\nApache License, Version 2.0", LONG, LONG + " x", " nbsp words　wide", "\\ ### </turn> : escape", "▁ mark itself ▁▁", "tab\tseparated\tvalues  double  space",
]
CLASHES = ["fp", "component_id", "score", "size", "rank", "chunk", "block", "text_", "fingerprint", "__index"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts, each twice, null ids and sources, repeated rows, and columns named as operators name their own."""
    rows = [(k if k != 7 else None, TEXTS[k % len(TEXTS)], [None, "en", "de"][k % 3], [None, "web", "books", ""][k % 4], k) for k in range(2 * len(TEXTS))]
    rows.append(rows[0])
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame([(*r, *[f"x{c}" for c in CLASHES]) for r in rows], kinds + "".join(f", {c} string" for c in CLASHES)).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return spark.createDataFrame([], odd_docs.schema)


def union_find(nodes, links):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
