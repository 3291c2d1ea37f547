from __future__ import annotations

import numpy as np
import pytest

from loomwright.llm import sources as s

LEX = "int f(int s) {\nswitch (s) {\n" + "\n".join(f"case {i}: yy = {i * 7}; if (c <= {i}) goto yy{i + 3}; goto yy{i};" for i in range(40)) + "\n}\n}\n"
DATA = "const double t[] = {\n" + "\n".join(f"  {i}.125, -{i}.5, {i}.25, 0.75," for i in range(60)) + "\n};\n"
MIN = "".join(f"function f{i}(a,b){{for(var c=0;b<a.length;b++)if(k[b]==={i})return e(a,{i});return!0}}" for i in range(30))
HAND = "#include <map>\n\nnamespace {ns} {{\n\n" + "\n".join(f"int work_{i}(int a) {{\n    total_{i} += compute_{{k}}_{i}(a, {i * 3});\n    if (a < {i}) return clamp_value_{i}(a);\n    log_line(\"state of {{k}} {i}\");\n    return a - remote_{{k}}_{i};\n}}" for i in range(6)).replace("{", "{{").replace("}", "}}").replace("{{{{k}}}}", "{k}") + "\n\n}}\n"


def hand(ns, k="x"):
    return HAND.format(ns=ns, k=k)


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("// Code generated by gen. DO NOT EDIT.\n" + hand("a"), "generated"),
        (hand("a") + "\n// end of generated code\n", "generated"),
        (hand("a"), None),
        (hand("a").replace("log_line(", 'out << "// Code generated by x. DO NOT EDIT.";\n log_line('), None),
        (hand("a").replace("    if", "    // do not edit the order of these by hand\n    if").replace("    return", "    // the list is generated by the caller\n    return"), None),
        (LEX, "generated"),
        (DATA, "data"),
        (MIN, "minified"),
        ("static const int t[] = {1, 2, 3, 4, 5};\n" + hand("a"), None),
        ("", None),
        ("// only a comment\n", None),
        ("x" * 100_000, "minified"),
    ],
)
def test_composition(text, kind):
    assert s.composition(text) == kind


def test_claims_and_lines():
    names, owners = s.claims("// Part of big-lib (1.2.3)\n// Copyright (c) 2019 the big-lib contributors\nnamespace big_lib {\n")
    assert owners == ["biglib"] and names == ["biglib"]
    assert s.claims("int x; // Part of other (1.2)\n") == ([], [])
    a = s.line_hashes(b"  int the_first_long_line = 1;\r\nshort\n}\n\n  { }\n")
    assert list(a) == sorted([*s.line_hashes(b"\tint the_first_long_line = 1;\n"), *s.line_hashes(b"short")])
    assert sorted((a & np.uint64(4095)).tolist()) == [1, 3]
    assert len(s.line_hashes(b"")) == 0 and len(s.line_hashes(b"}\n{\n\n")) == 0
    assert (s.line_hashes(b"w " * 10_000) & np.uint64(4095)).tolist() == [4095]


def test_verdicts(spark):
    lib, lib2 = hand("big_lib", "q"), hand("big_lib", "q").replace("a < 3", "a < 9")
    rows = [
        (1, "h/o/big-lib", "src/q.cc", lib), (2, "h/p/app", "third_party/q.cc", lib2), (3, "h/fork/big-lib", "src/q.cc", lib2), (4, "h/z/tool", "src/q.cc", "// big-lib v1.2.0, home: https://h/o/big-lib\n" + lib),
        (5, "h/p/app", "src/own.cc", hand("app", "own")), (6, "h/p/app", "src/gen.cc", LEX), (7, "h/p/app", "a/b.js", MIN), (8, "h/p/app", "a/b.h", DATA),
        (9, None, None, None), (10, "h/p/app", "src/e.cc", ""), (11, "h/p/app", "src/own.cc", hand("app", "own")), (12, "h/p/app", "external/x.c", None),
        (13, None, "src/q.cc", lib), (14, "h/p/app", "external/own2.cc", hand("app", "mine")),
    ]
    df = spark.createDataFrame(rows, "pair_id long, repository string, new_file string, new_contents string").selectExpr("*", "new_file as old_file", "timestamp'2020-01-01' as committed_at", "1 as line", "2 as names", "3 as other", "4 as n")
    repos = spark.createDataFrame([("h/o/big-lib", False, None), ("h/fork/big-lib", True, "O/big-lib"), ("h/p/app", False, None)], "repository string, fork boolean, parent_full_name string")
    got = {r["pair_id"]: r["verdict"] for r in s.judge_files(df, repos).collect()}
    want = {1: "handwritten", 2: "vendored", 3: "handwritten", 4: "vendored", 5: "handwritten", 6: "generated", 7: "minified", 8: "data", 9: "handwritten", 10: "handwritten", 11: "handwritten", 12: "vendored", 13: "handwritten", 14: "handwritten"}
    assert got == want
    assert s.judge_files(df.where("false"), repos.where("false")).count() == 0


def test_forks_of_forks(spark):
    rows = [("h/a/x", False, None), ("h/b/x", True, "a/x"), ("h/c/x", True, "b/x"), ("h/d/x", True, "C/X"), ("h/e/y", True, None)]
    got = {r["repository"]: r["root"] for r in s.roots(spark.createDataFrame(rows, "repository string, fork boolean, parent_full_name string")).collect()}
    assert got == {"h/a/x": "h/a/x", "h/b/x": "h/a/x", "h/c/x": "h/a/x", "h/d/x": "h/a/x", "h/e/y": "h/e/y"}


def _copies(n=10, size=60, changed=24):
    """Copies of one library, each with other lines replaced, and its plain source; no name tells them apart."""
    lib = [f"static int library_function_number_{i}(int a, int b);" for i in range(size)]
    out = []
    for c in range(n):
        own = {(c * 7 + k * 5) % size for k in range(changed)}
        out.append("\n".join(f"static int edited_{c}_function_number_{i}(long x);" if i in own else x for i, x in enumerate(lib)))
    return out, "\n".join(lib)


def _rows(spark, rows):
    return spark.createDataFrame(rows, "pair_id long, repository string, new_file string, new_contents string, committed_at string").selectExpr("*", "new_file as old_file")


NO_REPOSITORIES = "repository string, fork boolean, parent_full_name string"


def test_every_holder_is_compared(spark):
    # the target holds lines that ten differently edited copies hold too; only one file holds half of the target's lines
    rows, repository = [], 0
    for seed in range(12):
        copies, lib = _copies()
        copies, lib = ([t.replace("function_number", f"function_of_{seed}_number") for t in x] for x in (copies, [lib]))
        lines = lib[0].split("\n")
        target = lines[:32] + [f"int only_in_the_target_{seed}_{i}(char c);" for i in range(28)]
        # each decoy holds 6 of the target's lines besides its own
        decoys = ["\n".join(lines[(d * 3) % 27 : (d * 3) % 27 + 6] + [f"int only_in_decoy_{seed}_{d}_{i}(char c);" for i in range(20)]) for d in range(20)]
        for t in [*decoys, lib[0], "\n".join(target), *copies[:4]]:
            repository += 1
            rows.append((repository, f"h/o{repository}/r{repository}", "src/a.c", t, f"2020-01-01 {repository // 60:02d}:{repository % 60:02d}"))
    got = {r["pair_id"]: (r["verdict"], r["of_pair"]) for r in s.judge_files(_rows(spark, rows), spark.createDataFrame([], NO_REPOSITORIES)).collect()}
    sets = {r[0]: set(s.line_hashes(r[3].encode()).tolist()) for r in rows}
    for p, lines in sets.items():
        words = lambda x: sum(h & 4095 for h in x)
        able = {q for q, x in sets.items() if q < p and words(lines & x) >= max(0.5 * words(lines), 16)}
        assert (got[p][0] == "vendored") == bool(able), p
        assert got[p][1] in able if able else got[p][1] is None, p
    assert sum(v == "vendored" for v, _ in got.values()) >= 12


def test_hot_lines_are_salted(spark, monkeypatch):
    monkeypatch.setattr(s, "SALTED", 2)
    monkeypatch.setattr(s, "POINTED", 2.0)
    copies, lib = _copies()
    rows = [(i, f"h/o{i}/r{i}", "src/a.c", t, f"2020-01-{i:02d}") for i, t in enumerate([lib, *copies, lib], 1)]
    got = {r["pair_id"]: r["verdict"] for r in s.judge_files(_rows(spark, rows), spark.createDataFrame([], NO_REPOSITORIES)).collect()}
    assert {p for p, v in got.items() if v == "vendored"} == set(range(2, 13))


@pytest.mark.parametrize("pointed", [0.2, 2.0])
def test_all_edited_copies_are_found(spark, monkeypatch, pointed):
    monkeypatch.setattr(s, "POINTED", pointed)
    # copies hold 55 to 65 of 100 lines of their source, each another part, and stand in k projects
    rows, want = [], set()
    for k in (3, 5, 10, 20):
        lib = [f"static int library_{k}_function_number_{i}(int a, int b);" for i in range(100)]
        rows.append((len(rows) + 1, "h/o/source", "src/a.c", "\n".join(lib), "2019-01-01"))
        for c in range(k):
            own = {(c * 13 + j * 7) % 100 for j in range(35 + c % 11)}
            rows.append((len(rows) + 1, f"h/p{k}_{c}/r{c}", "src/a.c", "\n".join(f"static int edited_{c}_of_{k}_function_number_{i}(long x);" if i in own else x for i, x in enumerate(lib)), f"2020-01-{c + 1:02d}"))
            want.add(len(rows))
    got = {r["pair_id"]: r["verdict"] for r in s.judge_files(_rows(spark, rows), spark.createDataFrame([], NO_REPOSITORIES)).collect()}
    assert {p for p, v in got.items() if v == "vendored"} == want


def test_headers_and_short_files(spark):
    header = "/*\n" + "".join(f" * The users of this file may do so under the rule number {i} of the house of this project.\n" for i in range(12)) + " */\n"
    own = lambda i: header + "".join(f"int function_{i}_of_its_own_{j}(int a, char *b);\n" for j in range(8))
    lines = "".join(f"#define K{i} {i}\n" for i in range(9))
    one = "var a=" + "+".join(f"f{i}(x{i})" for i in range(80))
    rows = [(1, "h/a/a", "a.h", lines, "2020-01-01"), (2, "h/b/b", "b.h", lines, "2020-01-02"), (3, "h/a/a", "a.js", one, "2020-01-01"), (4, "h/b/b", "b.js", one, "2020-01-02"), (5, "h/c/c", "c.h", "int x;\n", "2020-01-01"), (6, "h/d/d", "d.h", "int x;\n", "2020-01-02")]
    rows += [(7, "h/e/e", "src/a.c", own(7), "2020-01-01"), (8, "h/f/f", "src/a.c", own(8), "2020-01-02")]
    got = {r["pair_id"]: (r["verdict"], r["of_pair"]) for r in s.judge_files(_rows(spark, rows), spark.createDataFrame([], NO_REPOSITORIES)).collect()}
    assert {p: x for p, (_, x) in got.items()} == {1: None, 2: 1, 3: None, 4: 3, 5: None, 6: None, 7: None, 8: None}
    # a common header makes no copy
    assert got[7][0] == got[8][0] == "handwritten"


@pytest.mark.parametrize("text", ["{\n" + "1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12,\n" * 3 + "}\n", "x" * 400])
def test_few_lines_can_tell(text):
    assert s.composition(text) == ("data" if "1," in text else "minified")


@pytest.mark.parametrize("line", ["0x4f,", "255,", "    7,", "        0x4f,"])
def test_one_short_literal_a_line_is_data(line):
    assert s.composition("const unsigned char blob[] = {\n" + (line + "\n") * 300 + "};\n") == "data"
    assert s.composition(hand("a").replace("    if", "    {\n    }\n    if")) is None


@pytest.mark.parametrize("size", [10, 3_000, 200_000])
def test_closing_comment_of_any_length(size):
    words = "rule is term or term then rule\n" * (size // 31 + 1)
    block = "\n/* Generated by gen from a grammar:\n" + words + "*/\n\n"
    run = "\n// Generated by gen from a grammar:\n" + "".join(f"// {x}\n" for x in words.splitlines())
    for end in (block, run, block + run.replace("Generated by gen", "Taken"), block.replace("\n", "\r\n")):
        assert s.composition(hand("a") + end) == "generated"
        assert s.composition(hand("a") + end.replace("Generated by gen", "Taken")) is None
        text = "int x;" + end
        assert text[: s.closing(text, 0)] == "int x;"
    # code behind the comment, or in front of it on its line: not a closing one
    assert s.closing(block + "int last_one_of_all;\n", 0) == len(block + "int last_one_of_all;")
    assert s.closing("int x; /* a */\n", 0) == len("int x; /* a */")
    assert s.closing("int x;\n/*/ a */\n/* b */", 0) == len("int x;")
