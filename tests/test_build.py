from __future__ import annotations

import json

import pytest

from loomwright.functions import build
from loomwright.plans import registry


def test_tree_spans():
    src = "int a;\nint f() {\n  return 1;\n}\n"
    node = lambda **x: {"kind": "FunctionDecl", "name": "f", "inner": [{"kind": "CompoundStmt"}], "range": {"begin": {"line": 2, "offset": 7}, "end": {"offset": 30, "tokLen": 1}}} | x
    got = build.tree_spans(json.dumps({"inner": [node(), node(), node(isImplicit=True), {"kind": "LambdaExpr", "inner": [node(name="g")]}]}), src, "m.cc")
    assert got == [(2, 4, "FunctionDecl", "f")]
    assert build.tree_spans(json.dumps(node(range={"begin": {"spellingLoc": {}}, "end": {"line": 4}})), src, "m.cc") == []
    assert build.tree_spans(json.dumps(node(loc={"file": "/other.h", "line": 1})), src, "m.cc") == []
    assert build.tree_spans(json.dumps(node(inner=[])), src, "m.cc") == []
    assert build.tree_spans("{", src, "m.cc") is None and build.tree_spans(None, src, "m.cc") is None


def test_catalogue_is_the_same_in_any_checkout():
    doc = lambda root: json.dumps({"kind": "ctestInfo", "version": {"major": 1}, "tests": [{"name": "t", "command": [f"{root}/bin/t", "-x"], "properties": [{"name": "W", "value": f"{root}/w"}]}]})
    a, b = (build.test_catalogue(doc(r), {r: "$B"}) for r in ("/tmp/one", "/home/x/two"))
    assert a == b and a[0][2] == ["$B/bin/t", "-x"]
    twice = json.loads(doc("/r"))
    twice["tests"] *= 2
    assert build.test_catalogue(json.dumps(twice)) is None and build.test_catalogue("[]") is None and build.test_catalogue(None) is None


def test_results():
    one = lambda name, status, completion: f'<Test Status="{status}"><Name>{name}</Name><Results><NamedMeasurement name="Completion Status"><Value>{completion}</Value></NamedMeasurement><Measurement><Value>out</Value></Measurement></Results></Test>'
    xml = lambda *t: f"<Site><Testing>{''.join(t)}</Testing></Site>"
    got = build.test_results(xml(one("a", "passed", "Completed"), one("b", "failed", "Completed"), one("c", "failed", "Timeout"), one("d", "notrun", "")))
    assert [(r[0], r[1]) for r in got] == [("a", "pass"), ("b", "fail"), ("c", "timeout"), ("d", "infrastructure_error")]
    assert build.test_results(xml(one("a", "passed", "Completed"), one("a", "passed", "Completed"))) is None
    assert build.test_results("<x") is None


ROOTS = ("/r/s", "/r/b", "/bin/cc")


def _database(*args, **more):
    return json.dumps([{"directory": "/r/b", "file": "../s/m.cc", "arguments": ["c++", *args]} | more])


def test_syntax_command():
    error, directory, arguments, key = build.syntax_command(_database("-Iinc", "-c", "../s/m.cc", "-o", "m.o", "-MD", "-MF", "d", "-MFx.d", "-Werror=all", "-Wp,-MD,x.d", "-dependency-file", "d", "-MJ", "x.json"), "m.cc", *ROOTS)
    assert (error, directory) == (None, "/r/b")
    assert arguments == ["/bin/cc", "-Iinc", "-fsyntax-only", "-Xclang", "-ast-dump=json", "/r/s/m.cc"]
    other = json.loads(_database("-Iinc", "/else/s/m.cc"))
    other[0] |= {"directory": "/else/b", "file": "/else/s/m.cc"}
    assert build.syntax_command(json.dumps(other), "m.cc", "/else/s", "/else/b", "/bin/cc")[3] == key
    line = [{"directory": "/r/b", "file": "../s/m.cc", "command": 'ccache x86_64-linux-gnu-g++-13 "-Ia b" -c ../s/m.cc'}]
    assert build.syntax_command(json.dumps(line), "/r/s/m.cc", *ROOTS)[2][1] == "-Ia b"


@pytest.mark.parametrize("bad", ["-march=native", "-cc1", "-mllvm", "-plugin", "-ftime-trace", "-ftime-trace=x", "-save-temps", "-save-temps=obj", "-Xclang", "-load", "-fplugin=x.so", "-fpass-plugin=x", "@args", "-om.o", "-Ia;b", "-DX=$(id)", "-DX=${Y}", "`id`", "--", "--config", "--config=x", "-Btools", "-specs=x", "-wrapper", "-add-plugin", "a&&b", "-Da\nb"])
def test_dangerous_arguments_are_refused(bad):
    assert build.syntax_command(_database(bad, "../s/m.cc"), "m.cc", *ROOTS) == ("argument", None, None, None)


@pytest.mark.parametrize(
    ("database", "source", "code"),
    [
        (None, "m.cc", "size"), ("{", "m.cc", "json"), ("[]", "m.cc", "json"), ("[1]", "m.cc", "json"), (_database("../s/m.cc"), None, "path"), (_database("../s/m.cc", directory="b"), "m.cc", "path"),
        (_database("../s/m.cc", directory="/else"), "m.cc", "root"), (_database("../s/m.cc", file="/else/m.cc"), "m.cc", "root"), (_database("../s/m.cc"), "../m.cc", "root"), (_database("../s/m.cc"), "other.cc", "entry"),
        (json.dumps(json.loads(_database("../s/m.cc")) * 2), "m.cc", "entry"), (_database("../s/m.cc", command="c++ x"), "m.cc", "form"), (_database("../s/m.cc", arguments=["python", "../s/m.cc"]), "m.cc", "compiler"),
        (_database("../s/m.cc", arguments=["ccache"]), "m.cc", "compiler"), (_database("../s/m.cc", "-o"), "m.cc", "value"), (_database("../s/m.cc", "../s/m.cc"), "m.cc", "source"), (_database("-c"), "m.cc", "source"), (_database("", "../s/m.cc"), "m.cc", "form"),
    ],
)
def test_databases_that_are_not_taken(database, source, code):
    assert build.syntax_command(database, source, *ROOTS) == (code, None, None, None)


def test_change_listings_gather_no_source_in_one_row(spark, tmp_path):
    row = lambda source, *files, old="x", subject="fix", lang="c": [(source, f, old, subject, lang) for f in files]
    rows = row("good", "a", "b\n", "ü") + row("good", "new", old=None, subject=None, lang="c++") + row("twice", "a", "b", "a") + row("empty", "a", "") + row("rooted", "a", "/b")
    rows += row("left out", "a", None, "a\tb") + row("nothing", None) + row(None, "a", "b", old="", lang=None)
    spark.createDataFrame(rows, "source_dataset string, new_file string, old_contents string, subject string, lang string").write.parquet(f"{tmp_path}/pair_source_a.parquet")
    df = registry.queries()["change_listings"](spark, str(tmp_path))
    none = (None, None, None, None)
    assert {r[0]: tuple(r)[1:] for r in df.collect()} == {"good": (4, 3, 9, 6), "twice": none, "empty": none, "rooted": none, "left out": (1, 1, 3, 1), None: (2, 0, 6, 0)}
    assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()
