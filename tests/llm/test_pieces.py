from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwright.llm.pieces import Limits, cut, split_oversized

SMALL = Limits(lines=12, tokens=60, base=40, overlap=3)


def size(t):
    return t.count("\n") + (t != "" and not t.endswith("\n"))


def check(text, limits):
    parts = cut(text, limits)
    whole, before = "", ""
    for piece, first, over in parts:
        raw = piece.encode()
        assert size(piece) <= limits.lines and len(raw) <= limits.octets and piece
        own = raw[over:].decode()
        kept = raw[:over].decode()
        assert before.endswith(kept)
        assert whole.count("\n") + 1 == first
        whole += own
        # the overlap is the last lines of the piece before, or the limits leave no room for one more
        lines = before.splitlines(keepends=True)
        have = size(kept)
        if before and have < min(limits.overlap, len(lines)):
            more = "".join(lines[-have - 1 :]) + own
            assert size(more) > limits.lines or len(more.encode()) > limits.octets or not lines[-1].endswith("\n")
        before = piece
    assert whole == text
    return parts


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["a;", "if (x) {", "}", "", "x" * 30, "long = " + "é" * 200 + ";", "void f() {", "\tq\r"]), max_size=80), st.booleans())
def test_pieces_are_the_text(lines, end):
    check("\n".join(lines) + ("\n" if end else ""), SMALL)


def test_cuts_between_functions():
    f = "void f{}() {{\n" + "  a();\n" * 7 + "}}\n\n"
    text = "".join(f.format(i) for i in range(4))
    parts = check(text, Limits(lines=16, tokens=10_000, overlap=3))
    owns = [p.encode()[o:].decode() for p, _, o in parts]
    assert all(x.startswith("void f") for x in owns)


def test_one_huge_line_and_long_text():
    parts = check("é" * 40_000, Limits())
    assert len(parts) == -(-80_000 // Limits().octets) or len(parts) >= 10
    check("x = 1;\n" * 20_000, Limits())


def test_only_the_text_decides(spark):
    rnd = random.Random(1)
    rows = [(1, None, 999, 9999), (2, "", 1, 1), (3, "a\n" * 200, 1000, 1), (4, "a\n" * 200 + "b", 0, 0), (5, "a\r\n" * 201, None, None), (6, "x" * 7683, 0, 0), (7, "x" * 7684, 0, 0), (8, "日" * 2562, 0, 0), (8, "日" * 2562, 0, 0)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, buggy_code string, code_lines int, prompt_tokens int").withColumn("k", F.lit(1)).withColumn("piece", F.lit("clash"))
    got = split_oversized(df, "id", "buggy_code").collect()
    assert sorted({r["id"] for r in got}) == [4, 5, 7, 8]
    assert all(r["lines"] <= 200 and r["tokens"] <= 2048 for r in got)
    assert split_oversized(df.where("false"), "id", "buggy_code").count() == 0


@pytest.mark.parametrize("text", ["", "a", "a\n"])
def test_small_texts_stay_whole(text):
    assert [p for p, _, _ in cut(text, SMALL)] == ([text] if text else [])
