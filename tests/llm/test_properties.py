import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from tamis.llm.chat import Template, parse
from tamis.llm.fingerprints import canonical, edited
from tamis.llm.shared import sums_by_text
from tamis.llm.simhash import gray_rank
from tamis.llm.token_files import id_of, key_of, read_varint, varint

said = st.text(st.one_of(st.sampled_from(list("\\#:/<>turn \n")), st.characters()), max_size=30)


@given(st.lists(st.tuples(said, said), max_size=5))
def test_chat_round_trips(turns):
    t = Template()
    assert parse("".join(p for role, text in turns for p, _ in t.segments(role, text)), t) == turns


@given(st.integers(-(2**63), 2**63 - 1), st.integers(-(2**63), 2**63 - 1))
def test_keys_sort_like_ids(a, b):
    assert id_of(key_of(a)) == a and (key_of(a) < key_of(b)) == (a < b) and key_of(None) < key_of(a)


@given(st.lists(st.integers(0, 2**63)))
def test_varints(numbers):
    data, at, out = b"".join(map(varint, numbers)), 0, []
    while at < len(data):
        n, at = read_varint(data, at)
        out.append(n)
    assert out == numbers


@given(st.text())
def test_canonical_forms_are_stable(text):
    once = canonical(text)
    assert canonical(once) == once and canonical(text.upper().lower() if text.isascii() else text) == once and canonical(f"  {text}\n") == once


@given(st.text(), st.text())
def test_edits(a, b):
    out, half = edited(a, b), len(a) // 2
    assert out == a[: len(a) - half] + b[:half]


@given(st.lists(st.lists(st.floats(-100, 100), max_size=4)))
def test_sums_of_runs(runs):
    flat, sizes = np.array([x for r in runs for x in r], np.float64), np.array([len(r) for r in runs], np.int64)
    assert np.allclose(sums_by_text(flat, sizes), [sum(r) for r in runs])


@given(st.integers(0, 2**64 - 1))
def test_gray_rank_inverts_the_code(n):
    x = np.array([n], np.uint64)
    assert gray_rank(x ^ (x >> np.uint64(1)))[0] == x[0]
