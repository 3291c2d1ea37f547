"""Lines, code spans and names in texts. Column expressions where SQL functions can say it, Arrow functions else."""

from __future__ import annotations

import ast
import json
import re
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The line ends of Unicode, CR LF first.
_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85  ]"

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def lines(c: Column) -> Column:
    """Lines without their ends, at every Unicode line end; no empty line after the last end; none of an empty text."""
    body = F.regexp_replace(c, f"(?:{_BREAK})\\z", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(body, _BREAK))


def line_total(c: Column) -> Column:
    return F.size(lines(c))


def with_final_newline(c: Column) -> Column:
    """(text, added): one LF at the end of a text that has none; an empty text stays empty."""
    lacks = (c != "") & ~c.endswith("\n")
    return F.struct(F.when(lacks, F.concat(c, F.lit("\n"))).otherwise(c).alias("text"), lacks.alias("added"))


def brace_spans(code: str | None) -> list[tuple[int, int]] | None:
    """(first, last) line of each pair of matching braces that opens after line 1, in the order of closing.

    The depth of a brace is a running sum that starts anew at each closing brace without an open one. Among the braces
    of one depth, opening and closing ones take turns, so a stable sort by depth puts each pair side by side.
    """
    if code is None:
        return None
    points = np.frombuffer(code.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero((points == ord("{")) | (points == ord("}")))
    if not len(at):
        return []
    opens = points[at] == ord("{")
    run = np.cumsum(np.where(opens, 1, -1))
    floor = np.minimum.accumulate(np.minimum(run, 0))
    depth = run - floor + ~opens
    stray = ~opens & (floor < np.concatenate([[0], floor[:-1]]))
    at, opens, depth = at[~stray], opens[~stray], depth[~stray]
    order = np.argsort(depth, kind="stable")
    first, second = order[:-1], order[1:]
    pair = opens[first] & ~opens[second] & (depth[first] == depth[second])
    ends = np.cumsum([len(x) for x in code.splitlines(True)])
    line = np.searchsorted(ends, at, side="right") + 1
    begin, close = first[pair], second[pair]
    begin = begin[np.argsort(close)]
    spans = zip(line[begin].tolist(), line[np.sort(close)].tolist(), strict=True)
    return [x for x in spans if x[0] > 1]


def level(spans: Column, changed: Column, exactly_one: bool = True) -> Column:
    """``function`` if the changed lines lie all in one span (in some span, if more than one will do), else ``file_window``."""
    around = F.filter(spans, lambda s: F.forall(changed, lambda x: x.between(s["start"], s["end"])))
    n = F.when(F.size(changed) > 0, F.size(around)).otherwise(0)
    return F.when((n == 1) if exactly_one else (n >= 1), "function").otherwise("file_window")


def innermost_span(spans: Column, anchors: Column) -> Column:
    """The shortest of the distinct spans that hold all anchors; null if there is none, or more than one of that size."""
    around = F.filter(F.array_distinct(spans), lambda s: F.forall(anchors, lambda x: x.between(s["start"], s["end"])))
    sized = F.transform(around, lambda s: F.struct((s["end"] - s["start"]).alias("size"), s["start"].alias("start"), s["end"].alias("end")))
    least = F.array_min(sized)
    same = F.size(F.filter(sized, lambda s: s["size"] == least["size"]))
    return F.when((F.size(anchors) > 0) & (same == 1), F.struct(least["start"].alias("start"), least["end"].alias("end")))


def window_around(total: Column, first: Column, last: Column, most: int = 256, side: int = 96) -> Column:
    """(start, end) of the largest window of at most ``most`` lines around a core, ``side`` at most on either side.

    Room is shared evenly, an odd line goes before the core, and what one side can't use goes to the other. Null if
    the core is too large or outside the text.
    """
    core = last - first + 1
    before_cap, after_cap = F.least(F.lit(side), first - 1), F.least(F.lit(side), total - last)
    room = F.least(F.lit(most) - core, before_cap + after_cap)
    half_up = F.floor((room + 1) / 2)
    before = F.greatest(F.least(half_up, before_cap), room - after_cap)
    ok = (first >= 1) & (last <= total) & (core >= 1) & (core <= most)
    return F.when(ok, F.struct((first - before).cast("int").alias("start"), (last + room - before).cast("int").alias("end")))


def anchors_of_ranges(total: Column, ranges: Column) -> Column:
    """Sorted distinct old lines of diff ranges (start, count); an insertion (count 0) has both its neighbours."""
    one = lambda r: F.when(r["count"] > 0, F.sequence(r["start"], r["start"] + r["count"] - 1)).otherwise(
        F.when(total == 0, F.array(F.lit(1))).otherwise(F.filter(F.array(r["start"], r["start"] + 1), lambda x: (x >= 1) & (x <= total)))
    )
    return F.array_sort(F.array_distinct(F.flatten(F.transform(ranges, one))))


# Words before a parenthesis that are no function's name; ``return`` and ``sizeof`` stand before one too
# where a brace follows (``return (x) {...}`` of a compound literal), and name none either.
_CONTROL = ("catch", "for", "if", "return", "sizeof", "switch", "while")


def function_names(c: Column) -> Column:
    """Distinct names before a parenthesised list and an opening brace, but for control words."""
    found = F.regexp_extract_all(c, F.lit(r"\b([A-Za-z_]\w*)\s*\([^;{}()]*\)\s*(?:const\s*)?\{"), F.lit(1))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in _CONTROL]))


def edit_kind(old: Column, new: Column, changed: Column, small: int = 20) -> Column:
    """``add_helper`` if a function is new and also called, else by the number of changed lines."""
    calls = lambda name: F.size(F.regexp_extract_all(new, F.concat(F.lit(r"\b"), name, F.lit(r"\s*\(")), F.lit(0)))
    helper = F.exists(F.array_except(function_names(new), function_names(old)), lambda n: calls(n) >= 2)
    return F.when(helper, "add_helper").when(changed == 1, "single_line").when(changed <= small, "multi_line_local").otherwise("localized_refactor")


def harvest_paths(value: str | None) -> list[str] | None:
    """Sorted safe relative paths anywhere in JSON or a Python literal: strings, ``filename``/``path``/``file`` of an
    object, and its keys that hold a slash. Null if it can't be read or has none."""
    text = (value or "").strip()
    if not text:
        return None
    for read in (json.loads, ast.literal_eval):
        try:
            top = read(text)
            break
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            top = None
    found: set[str] = set()
    waiting = [top]
    while waiting:
        x = waiting.pop()
        if isinstance(x, str):
            found.add(x)
        elif isinstance(x, dict):
            named = next((x[k] for k in ("filename", "path", "file") if x.get(k)), None)
            if isinstance(named, str):
                found.add(named)
            else:
                found |= {k for k in x if isinstance(k, str) and "/" in k}
                waiting += x.values()
        elif isinstance(x, list | tuple | set):
            waiting += x
    safe = set()
    for f in found:
        p = PurePosixPath(f)
        if f and not ("\\" in f or "\0" in f or p.is_absolute() or ".." in p.parts or not p.parts):
            safe.add(str(p))
    return sorted(safe) or None


@F.pandas_udf(SPANS)
def brace_spans_udf(code: pd.Series) -> pd.Series:
    return code.map(brace_spans, na_action="ignore").where(code.notna(), None)


harvest_paths_udf = F.udf(harvest_paths, T.ArrayType(T.StringType()), useArrow=True)
