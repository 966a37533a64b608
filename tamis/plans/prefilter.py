"""Prefilters over block metadata: partition names and int64 ranges.

A prefilter drops whole blocks and never looks at rows: rows outside a range come back with a block whose range meets
it. Missing metadata fails every test, negated ones too. A range end at the limits of int64 stands for anything beyond.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamis.functions.logic import any_true, every_true
from tamis.plans.query import MinMax, Node, Partition, Test, fold, leaves, truth

LEAST, MOST = -(2**63), 2**63 - 1


def range_may_hold(low: int, high: int, test: Test) -> bool:
    """Whether a block with values in low..high may hold one that passes."""
    open_ended = low == LEAST or high == MOST
    match test.op:
        case "EQ":
            return low <= test.value <= high
        case "NE":
            return open_ended or not low == high == test.value
        case "GT":
            return high > test.value or high == MOST
        case "GTE":
            return high >= test.value
        case "LT":
            return low < test.value or low == LEAST
        case "LTE":
            return low <= test.value
        case "IN":
            return any(low <= v <= high for v in test.values)
        case "NOT_IN":
            return True
        case "BETWEEN":
            return low <= test.high and high >= test.low
        case "NOT_BETWEEN":
            return open_ended or low < test.low or high > test.high
    return False


def block_passes(partition: str, ranges: Mapping[str, tuple[int, int]], prefilter: Node | None) -> bool:
    """The prefilter's verdict on one block, on the driver."""

    def leaf(node: Node) -> bool:
        if isinstance(node, Partition):
            return node.test is None or (partition != "" and node.test.holds(partition))
        if isinstance(node, MinMax):
            return node.test is None or (node.field in ranges and range_may_hold(*ranges[node.field], node.test))
        return False

    return truth(prefilter, leaf)


def test_column(x: Column, test: Test) -> Column:
    """test.holds() as a column expression; null for a null x."""
    match test.op:
        case "EQ":
            return x == F.lit(test.value)
        case "NE":
            return x != F.lit(test.value)
        case "GT":
            return x > F.lit(test.value)
        case "GTE":
            return x >= F.lit(test.value)
        case "LT":
            return x < F.lit(test.value)
        case "LTE":
            return x <= F.lit(test.value)
        case "IN":
            return x.isin(list(test.values)) if test.values else F.lit(False)
        case "NOT_IN":
            return ~x.isin(list(test.values)) if test.values else F.lit(True)
        case "BETWEEN":
            return x.between(F.lit(test.low), F.lit(test.high))
        case "NOT_BETWEEN":
            return (x < F.lit(test.low)) | (x > F.lit(test.high))
    return F.lit(False)


def range_column(low: Column, high: Column, test: Test) -> Column:
    """range_may_hold() as a column expression."""
    open_ended = (low == LEAST) | (high == MOST)
    match test.op:
        case "EQ":
            return (low <= test.value) & (high >= test.value)
        case "NE":
            return open_ended | (low != test.value) | (high != test.value)
        case "GT":
            return (high > test.value) | (high == MOST)
        case "GTE":
            return high >= test.value
        case "LT":
            return (low < test.value) | (low == LEAST)
        case "LTE":
            return low <= test.value
        case "IN":
            return any_true([(low <= v) & (high >= v) for v in test.values])
        case "NOT_IN":
            return F.lit(True)
        case "BETWEEN":
            return (low <= test.high) & (high >= test.low)
        case "NOT_BETWEEN":
            return open_ended | (low < test.low) | (high > test.high)
    return F.lit(False)


def block_column(partition: Column, ranges: Column, prefilter: Node | None) -> Column:
    """The prefilter over a table of blocks: partition is a string, ranges a map of field to struct<min, max>."""

    def leaf(node: Node) -> Column:
        if isinstance(node, Partition):
            if node.test is None:
                return F.lit(True)
            return F.coalesce((partition != "") & test_column(partition, node.test), F.lit(False))
        if isinstance(node, MinMax):
            if node.test is None:
                return F.lit(True)
            own = F.try_element_at(ranges, F.lit(node.field))
            return F.coalesce(own["min"].isNotNull() & range_column(own["min"], own["max"], node.test), F.lit(False))
        return F.lit(False)

    return fold(prefilter, leaf, every_true, any_true, F.lit(True))


def row_column(partition: Column | None, values: Mapping[str, tuple[Column, Column]], prefilter: Node | None) -> Column:
    """The prefilter on each row as a block of its own. values: field to the (floor, ceiling) of its number."""

    def leaf(node: Node) -> Column:
        if isinstance(node, Partition):
            return F.lit(True) if node.test is None else F.lit(False) if partition is None else F.coalesce((partition != "") & test_column(partition, node.test), F.lit(False))
        if isinstance(node, MinMax):
            if node.test is None:
                return F.lit(True)
            if node.field not in values:
                return F.lit(False)
            low, high = values[node.field]
            # A whole number is compared itself, and may fail a NOT_IN; a fraction lies between its neighbours.
            exact = test_column(low, node.test)
            return F.coalesce(F.when(low == high, exact).otherwise(range_column(low, high, node.test)), F.lit(False))
        return F.lit(False)

    return fold(prefilter, leaf, every_true, any_true, F.lit(True))


def only_partitions(prefilter: Node | None) -> bool:
    return all(isinstance(x, Partition) for x in leaves(prefilter))


def _quoted(x) -> str:
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def to_sql(prefilter: Node) -> str:
    """A WHERE clause for a catalog with columns partition_id, min_<field> and max_<field>."""
    plain = {"EQ": "=", "NE": "<>", "GT": ">", "GTE": ">=", "LT": "<", "LTE": "<="}

    def leaf(node: Node) -> str:
        test = node.test
        if test is None:
            return "TRUE"
        if isinstance(node, Partition):
            x = "partition_id"
            match test.op:
                case "IN" | "NOT_IN":
                    if not test.values:
                        return "FALSE" if test.op == "IN" else "partition_id <> ''"
                    text = f"{x} {test.op.replace('_', ' ')} ({', '.join(map(_quoted, test.values))})"
                case "BETWEEN":
                    text = f"{x} BETWEEN {_quoted(test.low)} AND {_quoted(test.high)}"
                case "NOT_BETWEEN":
                    text = f"({x} < {_quoted(test.low)} OR {x} > {_quoted(test.high)})"
                case _:
                    text = f"{x} {plain[test.op]} {_quoted(test.value)}"
            # A block without a partition fails every test.
            could_be_empty = Partition(test).test.holds("")
            return f"(partition_id <> '' AND {text})" if could_be_empty else text
        low, high = f"min_{node.field}", f"max_{node.field}"
        ends = f"{low} = {LEAST} OR {high} = {MOST}"
        match test.op:
            case "EQ":
                return f"({low} <= {test.value} AND {high} >= {test.value})"
            case "NE":
                return f"({low} <> {test.value} OR {high} <> {test.value} OR {ends})"
            case "GT":
                return f"({high} > {test.value} OR {high} = {MOST})"
            case "GTE":
                return f"{high} >= {test.value}"
            case "LT":
                return f"({low} < {test.value} OR {low} = {LEAST})"
            case "LTE":
                return f"{low} <= {test.value}"
            case "IN":
                return "(" + " OR ".join(f"({low} <= {v} AND {high} >= {v})" for v in test.values) + ")" if test.values else "FALSE"
            case "NOT_IN":
                return f"{low} IS NOT NULL"
            case "BETWEEN":
                return f"({low} <= {test.high} AND {high} >= {test.low})"
            case "NOT_BETWEEN":
                return f"({low} < {test.low} OR {high} > {test.high} OR {ends})"
        return "FALSE"

    return fold(prefilter, leaf, lambda c: "(" + " AND ".join(c) + ")" if c else "TRUE", lambda c: "(" + " OR ".join(c) + ")" if c else "FALSE", "TRUE")
