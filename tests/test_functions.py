from __future__ import annotations

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwright.functions import diff, keys, text
from loomwright.functions.match import outputs_match


@pytest.mark.parametrize(
    ("a", "b", "eps", "same"),
    [
        ("answer  1\n", "answer\t1", None, True),
        ("1\n2\n", "1 2\n", None, False),
        ("1.00000", "1.00009", None, True),
        ("1.00000", "1.00011", None, False),
        ("0.9920625", "0.992062500000", "1e-9", True),
        ("1.0", "1.000000002", "1e-9", False),
        ("1", "one", None, False),
        ("", "\n", None, True),
        ("1.0001", "1.0000", "1e-4", True),
        ("12abc", "12.00001abc", None, True),
        (None, "1", None, False),
        ("1", None, None, False),
    ],
)
def test_outputs_match(a, b, eps, same):
    assert outputs_match(a, b, eps) is same


BODY = "--- a/x.c\n+++ b/x.c\n@@ -1,2 +1,2 @@\n a\n-b\n+c\n"


@pytest.mark.parametrize(
    ("patch", "error", "files"),
    [
        (BODY, None, 1),
        ("diff --git a/x.c b/x.c\nindex 12..34 100644\n" + BODY, None, 1),
        (BODY + BODY.replace("x.c", "y.c"), None, 2),
        ("diff --git a/x b/x\nBinary files a/x and b/x differ\n", None, 1),
        ("", "empty", 0),
        (None, "empty", 0),
        ("a\0b", "nul", 0),
        ("```\n" + BODY, "fence", 0),
        ("Here you are:\n" + BODY, "start", 0),
        (BODY + "trailing words\n", "section", 0),
        ("diff --git x y\n" + BODY, "header", 0),
        ("diff --git a/y.c b/y.c\n" + BODY, "mismatch", 0),
        ("--- a/x y\n+++ b/x y\n@@ -1 +1 @@\n-a\n+b\n", "path", 0),
        ("--- a/x\n+++ b/x\n@@ -1 +1 @@\n a\n", "unchanged", 0),
        ("--- a/x\n+++ b/x\n@@ one @@\n-a\n", "hunk", 0),
        ("--- a/x\n+++ b/x\n@@ -1 +1 @@\n\\ No newline at end of file\n-a\n", "section", 0),
    ],
)
def test_parse_patch(patch, error, files):
    ok, got, found = diff.parse_patch(patch)
    assert (got, len(found)) == (error, files)
    assert ok is (error is None)


def test_parse_zero_context():
    head = "diff --git a/x b/x\nindex 1..2\n--- a/x\n+++ b/x\n"
    assert diff.parse_zero_context(head + "@@ -1 +1,2 @@\n-a\n+b\n+c\n@@ -5,0 +7 @@ f\n+z\n") == (True, None, [(1, 1), (5, 0)], [(1, 2), (7, 1)], 3, 1)
    assert diff.parse_zero_context(head + "@@ -1 +1,2 @@\n-a\n+b\n")[1] == "counts"
    assert diff.parse_zero_context(head + "@@ -1 +1 @@\n-a\n+b\n c\n")[1] == "structure"
    assert diff.parse_zero_context(head + "@@ -9 +9 @@\n-a\n+b\n@@ -2 +2 @@\n-a\n+b\n")[1] == "order"
    assert diff.parse_zero_context(head.replace("--- a/x", "--- /dev/null") + "@@ -0,0 +1 @@\n+b\n")[1] == "new_or_deleted"
    assert diff.parse_zero_context("")[1] == "empty"


def test_parse_zero_context_takes_16_mib():
    head = "diff --git a/x b/x\nindex 1..2\n--- a/x\n+++ b/x\n"
    for lines in (20_000, 160_000):
        text = head + f"@@ -0,0 +1,{lines} @@\n" + ("+" + "x" * 99 + "\n") * lines
        assert 1 << 20 < len(text) < 16 << 20
        assert diff.parse_zero_context(text) == (True, None, [(0, 0)], [(1, lines)], lines, 0)
    assert diff.parse_zero_context(head + "@@ -0,0 +1 @@\n+" + "x" * (16 << 20) + "\n")[1] == "empty"


def test_changed_lines():
    assert diff.changed_blocks("a\nb\nc", "a\nx\ny\nc")[:2] == (2, [2])
    assert diff.changed_deletions("a\nb\nc", "a\nx\ny\nc") == (2, [2])
    assert diff.changed_both("a\nb\n", "a\nb\nc\n") == (1, [3])
    # body lines that look like markers don't count by the diff, and do by blocks
    assert diff.changed_deletions("--i;\n", "++i;\n")[0] == 0
    assert diff.changed_blocks("--i;\n", "++i;\n")[0] == 1
    assert diff.changed_deletions(None, "a") is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "int f() {", "}", ""]), max_size=12), st.lists(st.sampled_from(["a", "b", "c", "}"]), max_size=12))
def test_made_diffs_parse(old, new):
    a, b = "".join(x + "\n" for x in old), "".join(x + "\n" for x in new)
    patch = diff.unified(a, b, "m.c")
    assert (patch == "") is (a == b)
    if patch:
        assert diff.parse_patch(patch)[0]


def test_text_functions(spark):
    rows = [(1, "a\r\nb\rc\n"), (2, ""), (3, "x y\x0cz"), (4, None), (5, "one\n\n")]
    df = spark.createDataFrame(rows, "id int, t string")
    got = {r["id"]: r["n"] for r in df.select("id", text.line_total(F.col("t")).alias("n")).collect()}
    assert got == {i: (None if t is None else len(t.splitlines())) for i, t in rows}
    assert text.brace_spans("x\nf() {\n if {\n }\n}\n") == [(3, 4), (2, 5)]
    assert text.brace_spans(None) is None
    assert text.harvest_paths('[{"filename":"a/b.c"},"x/../y",{"src/m.c":{}}]') == ["a/b.c", "src/m.c"]
    assert text.harvest_paths("{'path': 'q/w'}") == ["q/w"]
    assert text.harvest_paths("not json") is None


def test_windows_and_spans(spark):
    df = spark.sql("select 10 as total, 5 as a, 5 as b union all select 300, 1, 1 union all select 300, 150, 151 union all select 300, 1, 290 union all select 5, 4, 9")
    got = [tuple(r["w"]) if r["w"] else None for r in df.select(text.window_around(F.col("total"), F.col("a"), F.col("b"), 256, 96).alias("w")).collect()]
    assert sorted(got, key=str) == sorted([(1, 10), (1, 97), (54, 247), None, None], key=str)
    s = spark.sql("select array(named_struct('start', 2, 'end', 9), named_struct('start', 4, 'end', 6)) as spans, array(5) as at, array(3, 5) as wide, array() as none")
    row = s.select(text.innermost_span(F.col("spans"), F.col("at")).alias("i"), text.level(F.col("spans"), F.col("at")).alias("l"), text.level(F.col("spans"), F.col("at"), exactly_one=False).alias("any"), text.level(F.col("spans"), F.col("wide")).alias("w")).first()
    assert tuple(row["i"]) == (4, 6)
    assert (row["l"], row["any"], row["w"]) == ("file_window", "function", "function")
    r = spark.sql("select 5 as total, array(named_struct('start', 2, 'count', 2), named_struct('start', 5, 'count', 0), named_struct('start', 0, 'count', 0)) as r")
    assert r.select(text.anchors_of_ranges(F.col("total"), F.col("r"))).first()[0] == [1, 2, 3, 5]


def test_edit_kind(spark):
    df = spark.createDataFrame([("int main() { }", "int h() { }\nint main() { h(); }", 1), ("a", "b", 1), ("a", "b", 5), ("a", "b", 30)], "o string, n string, c int")
    got = [r[0] for r in df.select(text.edit_kind(F.col("o"), F.col("n"), F.col("c"))).collect()]
    assert got == ["add_helper", "single_line", "multi_line_local", "localized_refactor"]


def test_keys(spark):
    names = ["Owner/Repo", "https://github.com/Owner/Repo.git", "git@github.com:Owner/Repo.git", "a, b", None]
    df = spark.createDataFrame([(n,) for n in names], "r string")
    got = [r[0] for r in df.select(keys.single_repository(F.col("r"), "github.com")).collect()]
    assert got == ["github.com/owner/repo"] * 3 + [None, None]
    t = spark.createDataFrame([("Fixes #12, closes other/x#9 and resolves o/r#3. Fixed #12",)], "t string")
    assert t.select(keys.closing_references(F.col("t"), F.lit("o/r"))).first()[0] == [3, 12]
    import hashlib

    want = int(hashlib.sha256(b"seed\0grp").hexdigest()[:8], 16) % 100
    assert t.select(keys.bucket_nul("seed", F.lit("grp"))).first()[0] == want
    want = int(hashlib.sha256('[7,"gräp"]'.encode()).hexdigest()[:8], 16) % 100
    assert t.select(keys.bucket_json(7, F.lit("gräp"))).first()[0] == want


def test_name_status(spark):
    df = spark.createDataFrame([("M\0b.c\0A\0a.c\0",), ("M\0x\0M\0x\0",), ("M\0",), ("X\0a\0",)], "t string")
    got = [r[0] for r in df.select(diff.name_status(F.col("t"))).collect()]
    assert [tuple(x) for x in got[0]] == [("a.c", "A"), ("b.c", "M")]
    assert got[1:] == [None, None, None]
    n = spark.createDataFrame([("3\t1\tb.c\x000\t2\ta.c\0",), ("-\t-\tx\0",)], "t string")
    got = [r[0] for r in n.select(diff.numstat(F.col("t"))).collect()]
    assert [tuple(x) for x in got[0]] == [("a.c", 0, 2), ("b.c", 3, 1)] and got[1] is None


def test_long_listings_are_split_once(spark):
    """The time is in proportion to the entries: these took minutes when each entry split the listing again."""
    names = [f"src/p{i:05}.c" for i in range(10000)]
    df = spark.createDataFrame([("".join(f"{'AMD'[i % 3]}\0{x}\0" for i, x in enumerate(reversed(names))),)], "t string")
    began = time.monotonic()
    got = df.select(diff.name_status(F.col("t"))).first()[0]
    assert time.monotonic() - began < 30
    assert [r.path for r in got] == names and [r.status for r in got[-3:]] == ["D", "M", "A"]
