"""Keyword and regex trees as one Column over rows.

Conditions that no row can meet fold to literals here, and Catalyst then drops the scan. A token on a whole-number or
boolean column becomes a comparison with the number itself, which Parquet scans can push down.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.functions.logic import Verdict, all_verdicts, any_verdict, as_column
from tamis.functions.numeric import WHOLE
from tamis.functions.rows import Anywhere, At, AtOrBelow, TypedRows, WalkedRows
from tamis.functions.text import Tokenizer, has_token, leaf_text
from tamis.plans.query import Field, FieldRegex, FieldToken, Node, Query, Token, fold
from tamis.plans.regex import java_pattern

BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def token_test(token: str, tokenizer: Tokenizer | None):
    def test(x: Column, kind: T.DataType | None) -> Verdict:
        if kind is None or tokenizer is not None:
            return has_token(x if kind is None else leaf_text(x, kind), token, tokenizer)
        if isinstance(kind, WHOLE):
            digits = token.removeprefix("-")
            whole = digits.isascii() and digits.isdigit() and str(int(token)) == token and abs(int(token)) < 2 ** (BITS[type(kind)] - 1)
            return x == F.lit(int(token)).cast(kind) if whole else False
        if isinstance(kind, T.BooleanType):
            return x == F.lit(token == "true") if token in ("true", "false") else False
        return has_token(leaf_text(x, kind), token)

    return test


def regex_test(pattern: str):
    translated = java_pattern(pattern)

    def test(x: Column, kind: T.DataType | None) -> Column:
        return (x if kind is None else leaf_text(x, kind)).rlike(translated)

    return test


def keyword_verdict(node: Node | None, rows: TypedRows | WalkedRows, tokenizer: Tokenizer | None = None) -> Verdict:
    def leaf(x: Node) -> Verdict:
        if isinstance(x, Field):
            return rows.has_path(x.path) if x.path else False
        if isinstance(x, Token):
            return rows.has_leaf(Anywhere(), token_test(x.token, tokenizer))
        if isinstance(x, FieldToken):
            return rows.has_leaf(At(x.path), token_test(x.token, tokenizer)) if x.path else False
        return False

    return fold(node, leaf, all_verdicts, any_verdict, True)


def regex_verdict(node: Node | None, rows: TypedRows | WalkedRows) -> Verdict:
    def leaf(x: Node) -> Verdict:
        test = regex_test(x.pattern)  # a bad pattern is an error even where no row can have the field
        return rows.has_leaf(AtOrBelow(x.path), test) if isinstance(x, FieldRegex) and x.path else False

    return fold(node, leaf, all_verdicts, any_verdict, True)


def row_filter(query: Query, rows: TypedRows | WalkedRows, tokenizer: Tokenizer | None = None) -> Column:
    """Keywords first: the regex tree only sees rows that pass them. Null, as false, means that the row isn't accepted."""
    return as_column(all_verdicts([keyword_verdict(query.keywords, rows, tokenizer), regex_verdict(query.regex, rows)]))
