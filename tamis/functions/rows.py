"""Field paths and leaf texts of rows: of typed columns by Column expressions, of JSON text by a literal-keeping walker.

A path is the keys from the root joined by a dot. Containers have paths too, and a key with dots counts like the nested
keys it spells, so each of its prefixes is a path. Array elements stand under the path of their array. Paths that would
be empty don't exist; what lies under an empty top-level key has its own key as path. A null has a path but no text.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.functions.logic import Verdict, all_verdicts, any_verdict, as_column
from tamis.functions.numeric import int_range
from tamis.functions.text import leaf_text

DOT = "."
LEAF = T.StructType([T.StructField("path", T.StringType()), T.StructField("text", T.StringType())])
LEAVES = T.ArrayType(LEAF)
WALKED = T.StructType([T.StructField("paths", T.ArrayType(T.StringType())), T.StructField("leaves", LEAVES), T.StructField("json", T.StringType()), T.StructField("error", T.StringType())])


def below(path: str, key: str) -> str:
    return f"{path}{DOT}{key}" if path else key


def prefixes(path: str, key: str) -> list[str]:
    """The paths that a key under a path makes: itself and, if it holds dots, its prefixes."""
    parts = key.split(DOT)
    return [below(path, p) for k in range(1, len(parts) + 1) if (p := DOT.join(parts[:k]))] if len(parts) > 1 else [p for p in [below(path, key)] if key or path]


# ---- JSON text ----


class Literal(str):
    """A number as it stands in JSON text."""


class Refused(ValueError):
    """The text isn't a JSON object."""


def _refuse(x):
    raise Refused(f"{x} isn't JSON")


def parse(text: str) -> dict:
    """A JSON object with its numbers as literals; the last of equal keys counts."""
    try:
        row = json.loads(text, parse_float=Literal, parse_int=Literal, parse_constant=_refuse)
    except RecursionError as e:
        raise Refused("nested too deep") from e
    except ValueError as e:
        raise Refused(str(e)) from e
    if not isinstance(row, dict):
        raise Refused("not a JSON object")
    return row


def walk(value: Any, path: str = "") -> Iterator[tuple[str, str | None, bool]]:
    """(path, text, is a leaf) for all that a parsed value holds; repeats may occur."""
    if isinstance(value, dict):
        for key, child in value.items():
            for p in prefixes(path, key):
                yield p, None, False
            yield from walk(child, below(path, key))
    elif isinstance(value, list):
        for child in value:
            yield from walk(child, path)
    elif path and value is not None:
        yield path, ("true" if value else "false") if isinstance(value, bool) else str(value), True


def dumped(value: Any) -> str:
    """A parsed value as compact JSON, its number literals kept."""
    if isinstance(value, Literal):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dumped(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(dumped, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def number(literal: Any) -> int | float | None:
    """The number that a literal stands for; None for anything else."""
    if not isinstance(literal, Literal):
        return None
    return int(literal) if literal.lstrip("-").isdigit() else float(literal)


@F.arrow_udf(WALKED)
def walked_json(texts: pa.Array) -> pa.Array:
    """Paths, leaves and compact form of JSON objects; error says why a text isn't one (null: it's null)."""
    out = []
    for text in texts.to_pylist():
        try:
            row = parse(text) if text is not None else _refuse("null")
        except Refused as e:
            out.append({"paths": None, "leaves": None, "json": None, "error": str(e)})
            continue
        paths, leaves = {}, {}
        for path, leaf, is_leaf in walk(row):
            if is_leaf:
                leaves[path, leaf] = None
            else:
                paths[path] = None
        out.append({"paths": list(paths), "leaves": [{"path": p, "text": t} for p, t in leaves], "json": dumped(row), "error": None})
    kind = pa.struct([("paths", pa.list_(pa.string())), ("leaves", pa.list_(pa.struct([("path", pa.string()), ("text", pa.string())]))), ("json", pa.string()), ("error", pa.string())])
    return pa.array(out, kind)


def json_ranges(fields: list[str]) -> Callable[[Column], Column]:
    """For JSON objects: a map of each top-level field that is a number to its struct<min, max>."""

    @F.arrow_udf("map<string, struct<min: bigint, max: bigint>>")
    def ranges(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            row = parse(text) if text is not None else {}
            found = {f: ends for f in fields if (ends := int_range(number(row.get(f)))) is not None}
            out.append([(f, {"min": low, "max": high}) for f, (low, high) in found.items()])
        return pa.array(out, pa.map_(pa.string(), pa.struct([("min", pa.int64()), ("max", pa.int64())])))

    return ranges


# ---- what queries ask of a row ----


@dataclass(frozen=True)
class At:
    """Leaves exactly at a path."""

    path: str

    def fits(self, path: str) -> bool:
        return path == self.path

    def may_lie_below(self, path: str) -> bool:
        return not path or self.path.startswith(path)

    def column(self, path: Column) -> Column:
        return path == self.path


@dataclass(frozen=True)
class AtOrBelow:
    path: str

    def fits(self, path: str) -> bool:
        return path == self.path or path.startswith(self.path + DOT)

    def may_lie_below(self, path: str) -> bool:
        return not path or self.path.startswith(path) or path.startswith(self.path + DOT)

    def column(self, path: Column) -> Column:
        return (path == self.path) | path.startswith(self.path + DOT)


@dataclass(frozen=True)
class Anywhere:
    def fits(self, path: str) -> bool:
        return True

    def may_lie_below(self, path: str) -> bool:
        return True

    def column(self, path: Column) -> Verdict:
        return True


TextTest = Callable[[Column, T.DataType | None], Verdict]


class WalkedRows:
    """Rows whose paths and leaves are at hand as columns."""

    def __init__(self, paths: Column, leaves: Column):
        self.paths, self.leaves = paths, leaves

    def has_path(self, path: str) -> Verdict:
        return F.coalesce(F.array_contains(self.paths, path), F.lit(False))

    def has_leaf(self, where: At | AtOrBelow | Anywhere, test: TextTest) -> Verdict:
        if test(F.lit(""), None) is False:
            return False

        def fits(leaf: Column) -> Column:
            return as_column(all_verdicts([where.column(leaf["path"]), test(leaf["text"], None)]))

        return F.coalesce(F.exists(self.leaves, fits), F.lit(False))


class TypedRows:
    """Rows of typed columns. A condition touches only the columns that can satisfy it, so scans read no others.

    null_fields: whether a null column is a field with a null ("keep") or an absent one ("drop").
    json_columns: string columns that hold JSON objects, whose fields stand below the column's own path.
    """

    def __init__(self, schema: T.StructType, null_fields: str = "keep", json_columns: tuple[str, ...] = ()):
        if null_fields not in ("keep", "drop"):
            raise ValueError("null_fields is keep or drop")
        self.schema, self.keep, self.json_columns = schema, null_fields == "keep", frozenset(json_columns)

    def _columns(self) -> Iterator[tuple[T.StructField, Column]]:
        for f in self.schema.fields:
            yield f, F.col("`" + f.name.replace("`", "``") + "`")

    def has_path(self, path: str) -> Verdict:
        return any_verdict([self._member(f.name, f.dataType, c, "", path, f.name in self.json_columns) for f, c in self._columns()])

    def _member(self, key: str, kind: T.DataType, x: Column, path: str, want: str, as_json: bool = False) -> Verdict:
        """Whether `want` is a path that the member makes or that lies in it."""
        there = True if self.keep else x.isNotNull()
        if want in prefixes(path, key):
            return there
        own = below(path, key)
        if own and not want.startswith(own + DOT):
            return False
        if as_json:
            inner = want[len(own) + 1 :]
            return F.coalesce(F.array_contains(walked_json(x)["paths"], inner), F.lit(False))
        return self._inside(kind, x, own, want)

    def _inside(self, kind: T.DataType, x: Column, path: str, want: str) -> Verdict:
        if isinstance(kind, T.StructType):
            found = any_verdict([self._member(f.name, f.dataType, x.getField(f.name), path, want) for f in kind.fields])
            return x.isNotNull() if found is True else found
        if isinstance(kind, T.ArrayType):
            probe = self._inside(kind.elementType, F.lit(None).cast(kind.elementType), path, want)
            if probe is False:
                return False
            return F.coalesce(F.exists(x, lambda e: as_column(self._inside(kind.elementType, e, path, want))), F.lit(False))
        if isinstance(kind, T.MapType):
            # A key of the map, or a prefix of one, spells the rest of the path; or the rest goes on below a key.
            rest = want[len(path) + 1 :] if path else want

            def fits(entry: Column) -> Column:
                key = entry["key"].cast("string")
                deeper = self._below_key(kind.valueType, entry["value"], key, rest)
                return as_column(any_verdict([key == rest, F.startswith(key, F.lit(rest + DOT)), deeper]))

            return F.coalesce(F.exists(F.map_entries(x), fits), F.lit(False))
        return False

    def _below_key(self, kind: T.DataType, x: Column, key: Column, rest: str) -> Verdict:
        parts = rest.split(DOT)
        found = []
        for k in range(1, len(parts)):
            inner = self._inside(kind, x, "", DOT.join(parts[k:]))
            found.append(all_verdicts([key == DOT.join(parts[:k]), inner]))
        return any_verdict(found)

    def has_leaf(self, where: At | AtOrBelow | Anywhere, test: TextTest) -> Verdict:
        found = []
        for f, c in self._columns():
            if not where.may_lie_below(f.name):
                continue
            if f.name in self.json_columns:
                leaves = _moved(walked_json(c)["leaves"], f.name + DOT)
                found.append(WalkedRows(F.array(), leaves).has_leaf(where, test))
            else:
                found.append(self._leaf(f.dataType, c, f.name, where, test))
        return any_verdict(found)

    def _leaf(self, kind: T.DataType, x: Column, path: str, where, test: TextTest) -> Verdict:
        """The path is known on the driver here."""
        if isinstance(kind, T.StructType):
            return any_verdict([self._leaf(f.dataType, x.getField(f.name), below(path, f.name), where, test) for f in kind.fields if where.may_lie_below(below(path, f.name))])
        if isinstance(kind, T.ArrayType):
            probe = self._leaf(kind.elementType, F.lit(None).cast(kind.elementType), path, where, test)
            return False if probe is False else F.coalesce(F.exists(x, lambda e: as_column(self._leaf(kind.elementType, e, path, where, test))), F.lit(False))
        if isinstance(kind, T.MapType):
            return WalkedRows(F.array(), leaf_array(kind, x, F.lit(path))).has_leaf(where, test)
        if not path or not where.fits(path):
            return False
        return test(x, kind)  # null for a null, so that a plain comparison can be pushed into the scan

    def paths(self) -> Column:
        """All paths of a row, for storing."""
        parts = [self._paths(f.name, f.dataType, c, "") for f, c in self._columns()]
        return F.array_distinct(F.flatten(F.array(*parts))) if parts else F.array().cast("array<string>")

    def _paths(self, key: str, kind: T.DataType, x: Column, path: str | Column) -> Column:
        """path is a Column only below a map's key."""
        if isinstance(path, str):
            own, head = below(path, key), F.array(*map(F.lit, prefixes(path, key))).cast("array<string>")
        else:
            own = _below(path, F.lit(key))
            head = F.filter(F.array(*[_below(path, F.lit(p)) for k in range(1, key.count(DOT) + 2) if (p := DOT.join(key.split(DOT)[:k])) or not key]), lambda p: p != "")
        whole = F.concat(head, path_array(kind, x, own, self._paths)) if isinstance(kind, T.StructType | T.ArrayType | T.MapType) else head
        return whole if self.keep else F.when(x.isNotNull(), whole).otherwise(F.array().cast("array<string>"))

    def leaves(self) -> Column:
        parts = [leaf_array(f.dataType, c, F.lit(f.name)) for f, c in self._columns()]
        return F.filter(F.flatten(F.array(*parts)), lambda leaf: (leaf["path"] != "") & leaf["text"].isNotNull()) if parts else F.array().cast(LEAVES)


def _moved(leaves: Column, prefix: str) -> Column:
    return F.transform(leaves, lambda leaf: F.struct(F.concat(F.lit(prefix), leaf["path"]).alias("path"), leaf["text"].alias("text")))


def _below(path: str | Column, key: Column) -> Column:
    if isinstance(path, str):
        return F.concat(F.lit(path + DOT), key) if path else key
    return F.when(path == "", key).otherwise(F.concat(path, F.lit(DOT), key))


def path_array(kind: T.DataType, x: Column, path: str | Column, member) -> Column:
    """Paths inside a value."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StructType):
        inner = [member(f.name, f.dataType, x.getField(f.name), path) for f in kind.fields]
        return F.when(x.isNotNull(), F.flatten(F.array(*inner))).otherwise(none) if inner else none
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(x, lambda e: path_array(kind.elementType, e, path, member))), none)
    if isinstance(kind, T.MapType):

        def entry(e: Column) -> Column:
            key = e["key"].cast("string")
            parts = F.split(key, "\\.")
            heads = F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), DOT)), lambda p: p != "")
            return F.concat(F.transform(heads, lambda p: _below(path, p)), path_array(kind.valueType, e["value"], _below(path, key), member))

        return F.coalesce(F.flatten(F.transform(F.map_entries(x), entry)), none)
    return none


def leaf_array(kind: T.DataType, x: Column, path: Column) -> Column:
    """Leaves inside a value, as an array of struct<path, text>."""
    none = F.array().cast(LEAVES)
    if isinstance(kind, T.StructType):
        inner = [leaf_array(f.dataType, x.getField(f.name), _below(path, F.lit(f.name))) for f in kind.fields]
        return F.flatten(F.array(*inner)) if inner else none
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(x, lambda e: leaf_array(kind.elementType, e, path))), none)
    if isinstance(kind, T.MapType):
        return F.coalesce(F.flatten(F.transform(F.map_entries(x), lambda e: leaf_array(kind.valueType, e["value"], _below(path, e["key"].cast("string"))))), none)
    return F.array(F.struct(path.alias("path"), leaf_text(x, kind).alias("text")))
