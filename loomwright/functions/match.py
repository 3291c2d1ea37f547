"""Tolerant equality of program outputs."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_TOLERANCE = "1e-4"

_ITEM = re.compile(r"[ \t\r\f\v]*(?:(-?\d+(?:\.\d+)?)|(\S+))")


def _items(line: str) -> list[Decimal | str] | None:
    """Numbers and words of a line; None if it holds white space that separates nothing."""
    out: list[Decimal | str] = []
    at, end = 0, len(line.rstrip(" \t\r\f\v"))
    while at < end:
        m = _ITEM.match(line, at)
        if m is None:
            return None
        out.append(Decimal(m[1]) if m[1] is not None else m[2])
        at = m.end()
    return out


def _trimmed(text: str) -> str:
    return re.sub(r"(?:\r\n|\n|\r)\Z", "", text, count=1)


def outputs_match(expected: str | None, actual: str | None, tolerance: str | None = None) -> bool:
    """Same lines, and on each line the same words in order, spaces aside; two numbers match up to the tolerance.

    One line end at the end of a text doesn't count. A missing text matches nothing.
    """
    if expected is None or actual is None:
        return False
    a, b = _trimmed(expected), _trimmed(actual)
    if a == b:
        return True
    near = Decimal(tolerance or DEFAULT_TOLERANCE)
    left, right = ([_items(x) for x in t.split("\n")] if t else [] for t in (a, b))
    if len(left) != len(right) or None in left or None in right:
        return False
    for x, y in zip(left, right, strict=True):
        if len(x) != len(y):
            return False
        for p, q in zip(x, y, strict=True):
            if isinstance(p, Decimal) and isinstance(q, Decimal):
                if abs(p - q) > near:
                    return False
            elif type(p) is not type(q) or p != q:
                return False
    return True


outputs_match_udf = F.udf(outputs_match, T.BooleanType(), useArrow=True)


def outputs_match_column(expected: Column, actual: Column, tolerance: Column | None = None) -> Column:
    """``outputs_match`` of two columns. Equal and missing texts are settled in the JVM; only texts that differ go to the
    Python function, which gets nulls in the place of the others."""
    same = expected == actual
    differ = F.coalesce(~same, F.lit(False))
    asked = outputs_match_udf(F.when(differ, expected), F.when(differ, actual), tolerance if tolerance is not None else F.lit(None).cast("string"))
    return F.coalesce(F.when(differ, asked).otherwise(same), F.lit(False))
