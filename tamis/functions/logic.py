"""Boolean columns that fold literals on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

Verdict = Column | bool


def _joined(parts: Sequence[Verdict], neutral: bool, join) -> Verdict:
    open_ = [p for p in parts if isinstance(p, Column)]
    if any(p is not neutral for p in parts if isinstance(p, bool)):
        return not neutral
    return reduce(join, open_) if open_ else neutral


def all_verdicts(parts: Sequence[Verdict]) -> Verdict:
    return _joined(parts, True, and_)


def any_verdict(parts: Sequence[Verdict]) -> Verdict:
    return _joined(parts, False, or_)


def as_column(verdict: Verdict) -> Column:
    return F.lit(verdict) if isinstance(verdict, bool) else verdict


def every_true(parts: Sequence[Verdict]) -> Column:
    return as_column(all_verdicts(parts))


def any_true(parts: Sequence[Verdict]) -> Column:
    return as_column(any_verdict(parts))
