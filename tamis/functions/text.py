"""Canonical text of leaf values, and the tokens of a text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The members of Unicode White_Space, as a class for Java's and Python's regex engines.
SPACES = "[\\t\\n\\x0B\\f\\r \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
Tokenizer = Callable[[Column], Column]


def simple_lower(text: Column) -> Column:
    """Every character in lower case by itself: no final sigma, and a dotted capital I becomes a plain i."""
    by_letter = F.array_join(F.transform(F.split(F.translate(text, "İ", "i"), ""), F.lower), "")
    return F.when(text.rlike("[İΣ]"), by_letter).otherwise(F.lower(text))


def whitespace_lower(text: Column) -> Column:
    """The default tokenizer: words between white space in lower case, punctuation and all."""
    return F.filter(F.split(simple_lower(text), f"{SPACES}+"), lambda t: t != "")


def lower_one(c: str) -> str:
    if c == "İ":
        return "i"
    low = c.lower()
    return low if len(low) == 1 else c


def whitespace_lower_text(text: str) -> list[str]:
    """whitespace_lower() on the driver."""
    import re

    return [t for t in re.split(f"{SPACES}+", "".join(map(lower_one, text))) if t]


def number_text(x: Column) -> Column:
    """A float or double as JSON writes it: the shortest digits, no trailing zeros, an exponent below 1e-6 or from 1e21.

    NaN and infinities have no text (null); both zeros are 0.
    """
    d, digits = x.cast("double"), x.cast("string")
    # The JVM may write a digit more than it takes to tell a double from all others.
    shorter = F.format_string("%.15e", d)
    long = F.length(F.regexp_replace(digits, "E.*|[-.]", "")) >= 17
    digits = F.when(long & (shorter.try_cast("double") == d), shorter).otherwise(digits)
    size = F.abs(d)
    scale = F.when(size >= 1e7, digits.try_cast("decimal(38,10)").cast("string")).when((size < 1e-3) & (size > 0), digits.try_cast("decimal(38,30)").cast("string"))
    plain = scale.otherwise(F.when(F.contains(digits, F.lit("e")), digits.try_cast("decimal(38,20)").cast("string")).otherwise(digits))
    plain = F.when(F.contains(plain, F.lit(".")), F.regexp_replace(plain, "\\.?0+$", "")).otherwise(plain)
    power = F.regexp_replace(F.regexp_replace(F.lower(digits), "\\.?0*e\\+?(-?)0*", "e$1"), "e(?=\\d)", "e+")
    sparse = (size >= 1e21) | ((size < 1e-6) & (size > 0))
    slow = F.when(F.isnan(d) | (size == float("inf")), F.lit(None).cast("string")).when(sparse, power).otherwise(plain)
    # Most numbers are written out in at most 16 digits already.
    text = x.cast("string")
    common = (size >= 1e-3) & (size < 1e7) & (F.length(text) <= 17)
    return F.when(size == 0, F.lit("0")).when(common, F.when(F.endswith(text, F.lit(".0")), F.substring(text, F.lit(1), F.length(text) - 2)).otherwise(text)).otherwise(slow)


def timestamp_text(x: Column, zoned: bool) -> Column:
    """RFC 3339 in UTC, the fraction without trailing zeros."""
    if zoned:
        x = F.to_utc_timestamp(x, F.current_timezone())
    return F.concat(F.regexp_replace(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "(\\.0+|(?<=[1-9])0+)$", ""), F.lit("Z"))


def leaf_text(x: Column, kind: T.DataType) -> Column:
    """Canonical text of a scalar; null for null."""
    if isinstance(kind, T.StringType | T.CharType | T.VarcharType):
        return x
    if isinstance(kind, T.FloatType | T.DoubleType):
        return number_text(x)
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return timestamp_text(x, isinstance(kind, T.TimestampType))
    if isinstance(kind, T.BinaryType):
        return F.base64(x)
    if isinstance(kind, T.NullType):
        return F.lit(None).cast("string")
    return x.cast("string")


def has_token(text: Column, token: str, tokenizer: Tokenizer | None = None) -> Column | bool:
    """Whether the text yields exactly this token; null for a null text. Tokens that the default tokenizer can't make are never there."""
    if tokenizer is not None:
        return F.array_contains(tokenizer(text), token)
    if whitespace_lower_text(token) != [token]:
        return False
    # The cheap search comes first; words are only split where it hits.
    return F.contains(simple_lower(text), F.lit(token)) & F.array_contains(whitespace_lower(text), token)
