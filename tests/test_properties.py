import json
import math

from hypothesis import given, settings
from hypothesis import strategies as st

from tamis.functions.numeric import LEAST, MOST, int_range, rounded
from tamis.functions.rows import dumped, parse, prefixes, walk
from tamis.plans.prefilter import range_may_hold
from tamis.plans.query import All, Field, FieldRegex, FieldToken, MinMax, Partition, Query, Some, Test, Token, all_of, any_of, regex_guard, truth

small = st.integers(-4, 4)
tests = st.one_of(
    st.builds(Test, st.sampled_from(["EQ", "NE", "GT", "GTE", "LT", "LTE"]), small), st.builds(lambda op, v: Test(op, values=tuple(v)), st.sampled_from(["IN", "NOT_IN"]), st.lists(small, max_size=3)),
    st.builds(lambda op, a, b: Test(op, low=min(a, b), high=max(a, b)), st.sampled_from(["BETWEEN", "NOT_BETWEEN"]), small, small),
)
leaves = st.one_of(st.builds(Field, st.text()), st.builds(Token, st.text()), st.builds(FieldToken, st.text(), st.text()))
trees = st.recursive(leaves, lambda t: st.one_of(st.builds(lambda x: All(tuple(x)), st.lists(t, max_size=3)), st.builds(lambda x: Some(tuple(x)), st.lists(t, max_size=3))), max_leaves=12)
values = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(), st.floats(allow_nan=False, allow_infinity=False), st.text()), lambda v: st.one_of(st.lists(v, max_size=3), st.dictionaries(st.text(), v, max_size=3)), max_leaves=10)
objects = st.dictionaries(st.text(), values, max_size=4)


@given(tests, st.lists(small, min_size=1, max_size=4))
def test_a_range_never_hides_a_value(test, held):
    if any(test.holds(v) for v in held):
        assert range_may_hold(min(held), max(held), test)


@given(tests, small)
def test_open_ends_stand_for_anything(test, other):
    if test.op in ("NE", "GT", "NOT_IN", "NOT_BETWEEN"):
        assert range_may_hold(other, MOST, test)
    if test.op in ("NE", "LT", "NOT_IN", "NOT_BETWEEN"):
        assert range_may_hold(LEAST, other, test)


@given(st.floats(allow_nan=False))
def test_number_ranges_enclose(x):
    low, high = int_range(x)
    assert LEAST <= low <= high <= MOST and low <= rounded(x) <= high
    if abs(x) < 2**62:
        assert low <= x <= high and high - low <= 1


@given(objects)
def test_json_keeps_its_numbers(row):
    text = json.dumps(row)
    assert parse(dumped(parse(text))) == parse(text)
    assert json.loads(dumped(parse(text))) == json.loads(text)


@given(objects)
def test_every_leaf_has_its_path(row):
    found = list(walk(parse(json.dumps(row))))
    paths = {p for p, _, leaf in found if not leaf}
    assert all(p for p, _, _ in found) and all(p in paths for p, _, leaf in found if leaf)


@given(st.text(".ab", max_size=6), st.text(".ab", max_size=6))
def test_prefixes_build_up_to_the_path(path, key):
    made = prefixes(path, key)
    assert all(made) and (not made or made[-1] == (f"{path}.{key}" if path else key))


@settings(max_examples=200)
@given(trees, st.sets(st.text(max_size=3)), st.data())
def test_trees_keep_their_meaning(tree, true_texts, data):
    def leaf(x):
        return (x.path if isinstance(x, Field) else x.token) in true_texts

    other = data.draw(trees)
    assert truth(all_of(tree, other), leaf) == (truth(tree, leaf) and truth(other, leaf))
    assert truth(any_of(tree, other), leaf) == (truth(tree, leaf) or truth(other, leaf))
    query = Query(all_of(Partition(Test("EQ", "p")), MinMax("x", Test("BETWEEN", low=1, high=2))), tree, None)
    assert Query.from_json(query.to_json()) == query


@given(st.lists(st.tuples(st.sampled_from("abc"), st.booleans()), max_size=6))
def test_the_guard_is_necessary(conditions):
    """A row that passes the regexes has the fields that the guard wants."""
    tree = any_of(*(all_of(FieldRegex(p, "x"), FieldRegex(p + p, "y")) if deep else FieldRegex(p, "x") for p, deep in conditions))
    for there in ({"a"}, {"a", "aa"}, {"b", "bb", "c"}, set()):
        passes = truth(tree, lambda r: r.path in there)
        assert not passes or truth(regex_guard(tree), lambda f: f.path in there)


def test_infinities():
    assert int_range(math.inf) == (MOST, MOST) and int_range(-math.inf) == (LEAST, LEAST) and int_range(math.nan) is None
