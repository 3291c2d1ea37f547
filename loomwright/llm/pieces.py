"""Oversized code, cut at natural boundaries by agglomerative merging.

A text starts as its lines. All boundaries between neighbours lie in a heap, weakest first (inside a line, deep in a
block, at a shallow indent, at the outer level, between functions); the two segments at the weakest one become one
segment while the two together, with the overlap that the segment will carry, fit the limits. What remains are the
strongest boundaries, one at the start of each piece.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """A piece has at most ``lines`` lines and ``(octets + base) div 4 <= tokens``."""

    lines: int = 200
    tokens: int = 2048
    base: int = 512
    overlap: int = 5

    @property
    def octets(self) -> int:
        return 4 * self.tokens + 3 - self.base


_LINE = re.compile(r"[^\n]*\n|[^\n]+")
_NOISE = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|//[^\n]*|/\*.*?\*/')


def line_count(text: Column) -> Column:
    """Lines ended by LF or CRLF; a last line without end counts; an empty text has none."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return ends + F.when((F.length(text) > 0) & ~text.endswith("\n"), 1).otherwise(0)


def _atoms(text: str, most: int) -> list[str]:
    """Lines with their ends; a line over ``most`` octets in parts under it, cut after a space or a separator where
    one stands in the last quarter, and never inside a character."""
    out = []
    for line in _LINE.findall(text):
        if len(line) * 4 <= most or len(line.encode()) <= most:
            out.append(line)
            continue
        while line:
            head = line.encode()[:most].decode(errors="ignore") if len(line) * 4 > most else line
            if len(head) < len(line):
                at = max(head.rfind(c) for c in " \t;,{}") + 1
                head = head[:at] if at > len(head) * 3 // 4 else head
            out.append(head)
            line = line[len(head) :]
    return out


def _strengths(atoms: list[str]) -> list[float]:
    """How good a cut the boundary after each atom is."""
    out, depth = [], 0
    closed = False  # the last line with text closed a block of the outer level
    for k, a in enumerate(atoms):
        plain = _NOISE.sub("", a)
        depth = max(0, depth + plain.count("{") - plain.count("}"))
        bare = a.strip()
        if bare:
            closed = depth == 0 and bare.startswith("}")
        following = atoms[k + 1].strip() if k + 1 < len(atoms) else ""
        if not a.endswith("\n"):
            out.append(0.0)
        elif depth == 0:
            out.append((5.0 if closed else 4.0) if following else 3.0)
        else:
            out.append(1.0 + 1.0 / depth + (0.5 if not bare else 0.0))
    return out


def cut(text: str, limits: Limits) -> list[tuple[str, int, int]]:
    """(piece, first own line from 1, octets of overlap it begins with); the pieces less overlap are the text."""
    atoms = _atoms(text, limits.octets)
    n = len(atoms)
    size = [len(a.encode()) for a in atoms]
    ends = [a.endswith("\n") for a in atoms]
    sized, ended = [0], [0]
    for s, e in zip(size, ends, strict=True):
        sized.append(sized[-1] + s)
        ended.append(ended[-1] + e)

    def lines(i: int, j: int) -> int:
        return ended[j] - ended[i] + (not ends[j - 1])

    def fits(i: int, j: int) -> bool:
        return sized[j] - sized[i] <= limits.octets and lines(i, j) <= limits.lines

    strength = _strengths(atoms)
    end = {i: i + 1 for i in range(n)}
    start = {i + 1: i for i in range(n)}
    heap = [(strength[i], size[i] + size[i + 1], i + 1, i, i + 2) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, _, at, i, j = heapq.heappop(heap)
        if start.get(at) != i or end.get(at) != j:
            continue
        if not fits(max(0, i - limits.overlap), j):
            continue
        del start[at], end[at]
        end[i], start[j] = j, i
        if i > 0:
            heapq.heappush(heap, (strength[i - 1], sized[j] - sized[start[i]], i, start[i], j))
        if j < n:
            heapq.heappush(heap, (strength[j - 1], sized[end[j]] - sized[i], j, i, end[j]))
    out, before = [], 0
    for i in sorted(end):
        j = end[i]
        k = i
        while k > before and i - k < limits.overlap and fits(k - 1, j):
            k -= 1
        out.append(("".join(atoms[k:j]), ended[i] + 1, sized[i] - sized[k]))
        before = k
    return out


def oversized(text: Column, limits: Limits) -> Column:
    return F.coalesce((line_count(text) > limits.lines) | (F.octet_length(text) > limits.octets), F.lit(False))


def split_oversized(df: DataFrame, key: str, text: str, limits: Limits = Limits()) -> DataFrame:
    """Rows (key, piece_no from 1, pieces, first_line, overlap_octets, lines, tokens, piece) of each oversized text.

    Only the text decides, never a stored size. Null, empty and small texts give no row. The test runs in the scan's
    stage, so only oversized texts reach Python; nothing is shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch["k"], batch["t"], strict=True):
                parts = cut(t, limits)
                for no, (piece, first, over) in enumerate(parts, 1):
                    n = piece.count("\n") + (not piece.endswith("\n"))
                    rows.append((k, no, len(parts), first, over, n, (len(piece.encode()) + limits.base) // 4, piece))
            yield pd.DataFrame(rows, columns=["k", "piece_no", "pieces", "first_line", "overlap_octets", "lines", "tokens", "piece"])

    kind = df.schema[key].dataType.simpleString()
    big = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where(oversized(F.col("t"), limits))
    return big.mapInPandas(run, f"k {kind}, piece_no int, pieces int, first_line int, overlap_octets int, lines int, tokens int, piece string").withColumnRenamed("k", key)
