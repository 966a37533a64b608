"""Queries as plain data: three condition trees, a builder, and their JSON form.

A query has a prefilter tree over block metadata, a keyword tree over fields and tokens, and a regex tree that rows must
pass in the end. All trees share two inner nodes, All and Some; an empty All is true and an empty Some is false, and a
missing tree accepts everything. Nodes are frozen and compare by value.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, fields
from typing import Any

OPERATORS = ("EQ", "NE", "GT", "GTE", "LT", "LTE", "IN", "NOT_IN", "BETWEEN", "NOT_BETWEEN")


@dataclass(frozen=True)
class Test:
    """A comparison with value (EQ to LTE), values (IN, NOT_IN) or both ends low and high (BETWEEN, NOT_BETWEEN)."""

    op: str
    value: Any = None
    values: tuple = ()
    low: Any = None
    high: Any = None

    __test__ = False

    def holds(self, x: Any) -> bool:
        """Whether x, of the same type as the test's own values, passes. Strings compare by their UTF-8 bytes."""
        if isinstance(x, str):
            own = Test(self.op, *(None if v is None else v.encode() for v in (self.value,)), tuple(v.encode() for v in self.values), *(None if v is None else v.encode() for v in (self.low, self.high)))
            return own.holds(x.encode())
        match self.op:
            case "EQ":
                return x == self.value
            case "NE":
                return x != self.value
            case "GT":
                return x > self.value
            case "GTE":
                return x >= self.value
            case "LT":
                return x < self.value
            case "LTE":
                return x <= self.value
            case "IN":
                return x in self.values
            case "NOT_IN":
                return x not in self.values
            case "BETWEEN":
                return self.low <= x <= self.high
            case "NOT_BETWEEN":
                return x < self.low or x > self.high
        return False


def eq(value) -> Test:
    return Test("EQ", value)


def ne(value) -> Test:
    return Test("NE", value)


def gt(value) -> Test:
    return Test("GT", value)


def gte(value) -> Test:
    return Test("GTE", value)


def lt(value) -> Test:
    return Test("LT", value)


def lte(value) -> Test:
    return Test("LTE", value)


def isin(*values) -> Test:
    return Test("IN", values=values)


def notin(*values) -> Test:
    return Test("NOT_IN", values=values)


def between(low, high) -> Test:
    """Both ends belong to it."""
    return Test("BETWEEN", low=low, high=high)


def notbetween(low, high) -> Test:
    return Test("NOT_BETWEEN", low=low, high=high)


@dataclass(frozen=True)
class Partition:
    """A block's partition passes the test; a block without a partition never does."""

    test: Test | None


@dataclass(frozen=True)
class MinMax:
    """A block's range of a field may hold a value that passes the test; a block without such a range never does."""

    field: str
    test: Test | None


@dataclass(frozen=True)
class Field:
    """The path stands in the row, as a leaf, a container or a prefix of a dotted key."""

    path: str


@dataclass(frozen=True)
class Token:
    """Some leaf of the row has the token."""

    token: str


@dataclass(frozen=True)
class FieldToken:
    """A leaf exactly at the path has the token."""

    path: str
    token: str


@dataclass(frozen=True)
class FieldRegex:
    """The pattern, in RE2 syntax, is found in the text of a leaf at the path or beneath it."""

    path: str
    pattern: str


@dataclass(frozen=True)
class All:
    children: tuple = ()


@dataclass(frozen=True)
class Some:
    children: tuple = ()


Node = Any
LEAVES = {c.__name__: c for c in (Partition, MinMax, Field, Token, FieldToken, FieldRegex)}


def _flat(kind: type, nodes: Iterable[Node]) -> tuple:
    return tuple(x for n in nodes for x in (n.children if type(n) is kind else (n,)))


def all_of(*nodes: Node) -> All:
    """Children of the same kind take the place of their parent."""
    return All(_flat(All, nodes))


def any_of(*nodes: Node) -> Some:
    return Some(_flat(Some, nodes))


def leaves(node: Node | None) -> Iterable[Node]:
    if isinstance(node, All | Some):
        for child in node.children:
            yield from leaves(child)
    elif node is not None:
        yield node


def fold(node: Node | None, leaf: Callable[[Node], Any], every: Callable[[list], Any], some: Callable[[list], Any], yes: Any) -> Any:
    """The tree's value from its leaves' values; `yes` for a missing tree."""
    if node is None:
        return yes
    if isinstance(node, All | Some):
        return (every if isinstance(node, All) else some)([fold(c, leaf, every, some, yes) for c in node.children])
    return leaf(node)


def truth(node: Node | None, leaf: Callable[[Node], bool]) -> bool:
    return fold(node, leaf, all, any, True)


def regex_guard(node: Node | None) -> Node | None:
    """The keyword tree of the same shape that a row must satisfy for the regex tree to have a chance: its fields exist."""
    return fold(node, lambda r: Field(r.path), lambda c: All(tuple(c)), lambda c: Some(tuple(c)), None)


def both(left: Node | None, right: Node | None) -> Node | None:
    """The conjunction of two trees, either of which may be missing."""
    return right if left is None else left if right is None else all_of(left, right)


def to_data(node: Node | None) -> Any:
    if node is None:
        return None
    if isinstance(node, All | Some):
        return {"kind": type(node).__name__, "children": [to_data(c) for c in node.children]}
    out: dict = {"kind": type(node).__name__}
    for f in fields(node):
        x = getattr(node, f.name)
        out[f.name] = {k: list(v) if isinstance(v, tuple) else v for k, v in vars(x).items() if v not in (None, ())} if isinstance(x, Test) else x
    return out


def from_data(data: Any) -> Node | None:
    if data is None:
        return None
    kind, rest = data["kind"], {k: v for k, v in data.items() if k != "kind"}
    if kind in ("All", "Some"):
        return (All if kind == "All" else Some)(tuple(from_data(c) for c in rest["children"]))
    if isinstance(rest.get("test"), dict):
        test = rest["test"]
        rest["test"] = Test(**(test | {"values": tuple(test.get("values", ()))}))
    return LEAVES[kind](**rest)


@dataclass(frozen=True)
class Query:
    prefilter: Node | None = None
    keywords: Node | None = None
    regex: Node | None = None

    def to_json(self) -> str:
        return json.dumps({"prefilter": to_data(self.prefilter), "keywords": to_data(self.keywords), "regex": to_data(self.regex)}, ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> Query:
        data = json.loads(text)
        return Query(*(from_data(data.get(k)) for k in ("prefilter", "keywords", "regex")))


class QueryBuilder:
    """Chained calls. Single conditions join by AND; match(), match_regex() and match_prefilter() replace a whole tree."""

    def __init__(self) -> None:
        self._prefilter: Node | None = None
        self._keywords: Node | None = None
        self._regex: Node | None = None

    def _keyword(self, leaf: Node) -> QueryBuilder:
        self._keywords = all_of(*([] if self._keywords is None else [self._keywords]), leaf)
        return self

    def field(self, path: str) -> QueryBuilder:
        return self._keyword(Field(path))

    def token(self, token: str) -> QueryBuilder:
        return self._keyword(Token(token))

    def field_token(self, path: str, token: str) -> QueryBuilder:
        return self._keyword(FieldToken(path, token))

    def match(self, expression: Node) -> QueryBuilder:
        self._keywords = expression
        return self

    def field_regex(self, path: str, pattern: str) -> QueryBuilder:
        self._regex = all_of(*([] if self._regex is None else [self._regex]), FieldRegex(path, pattern))
        return self

    def match_regex(self, expression: Node) -> QueryBuilder:
        self._regex = expression
        return self

    def match_prefilter(self, expression: Node) -> QueryBuilder:
        self._prefilter = expression
        return self

    def build(self) -> Query:
        return Query(self._prefilter, self._keywords, self._regex)


def query() -> QueryBuilder:
    return QueryBuilder()
