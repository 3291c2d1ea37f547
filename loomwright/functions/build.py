"""Outputs of build tools as rows: syntax trees, test catalogues and results, compile commands.

Each parser gives a struct or an array of structs; what can't be trusted is left out or null, never guessed.
"""

from __future__ import annotations

import hashlib
import json
import os.path
import posixpath
import re
import shlex
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I = T.StringType(), T.IntegerType()
SPAN = T.StructType([T.StructField("start", _I), T.StructField("end", _I), T.StructField("kind", _S), T.StructField("name", _S)])
TEST = T.StructType([T.StructField("name", _S), T.StructField("test_id", _S), T.StructField("command", T.ArrayType(_S))])
RESULT = T.StructType([T.StructField("name", _S), T.StructField("status", _S), T.StructField("completion", _S), T.StructField("exit_code", _S), T.StructField("output_sha256", _S)])

# Node kinds of function definitions.
FUNCTIONS = frozenset({"CXXConstructorDecl", "CXXConversionDecl", "CXXDestructorDecl", "CXXMethodDecl", "FunctionDecl"})


def _line(at: object, source: bytes, paths: frozenset[str], end: bool) -> int | None:
    """The source line of a location that lies in the file itself; None for macros, includes and other files."""
    if not isinstance(at, dict) or at.keys() & {"spellingLoc", "expansionLoc", "includedFrom"}:
        return None
    if "file" in at and os.path.normpath(str(at["file"])) not in paths:
        return None
    size = at.get("tokLen") if isinstance(at.get("tokLen"), int) else 0
    offset, line = at.get("offset"), at.get("line")
    by_offset = isinstance(offset, int) and 0 <= offset <= len(source)
    if isinstance(line, int) and line > 0 and not (end and by_offset and size > 1):
        return line
    return source.count(b"\n", 0, offset + max(0, size - 1) * end) + 1 if by_offset else None


def _nodes(tree: object) -> Iterator[dict]:
    """All nodes outside lambdas, without recursion, so that a deep tree is no danger."""
    waiting = [tree]
    while waiting:
        n = waiting.pop()
        if isinstance(n, dict) and n.get("kind") != "LambdaExpr":
            yield n
            inner = n.get("inner")
            waiting += inner if isinstance(inner, list) else []


def tree_spans(tree: str | None, source: str | None, path: str | None) -> list[tuple[int, int, str, str]] | None:
    """Sorted distinct (start, end, kind, name) of the function definitions that a syntax tree (JSON) has in the file."""
    if tree is None or source is None or not path:
        return None
    try:
        top = json.loads(tree)
    except (ValueError, RecursionError):
        return None
    raw, paths, last = source.encode("utf-8", "surrogatepass"), frozenset({os.path.normpath(path)}), max(1, len(source.splitlines()))
    out = set()
    for n in _nodes(top):
        if n.get("kind") in FUNCTIONS and n.get("isImplicit") is not True and any(isinstance(x, dict) and x.get("kind") == "CompoundStmt" for x in n.get("inner") or []):
            where = n.get("range") or {}
            a, b = _line(where.get("begin"), raw, paths, False), _line(where.get("end"), raw, paths, True)
            own = "loc" not in n or _line(n["loc"], raw, paths, False) is not None
            if own and a and b and a <= b <= last:
                out.add((a, b, n["kind"], str(n.get("name", ""))))
    return sorted(out)


def _rooted(text: str, roots: dict[str, str]) -> str:
    """Absolute root folders (the longest first) as their tokens."""
    for folder in sorted(roots, key=len, reverse=True):
        text = re.sub(re.escape(folder.rstrip("/")) + r"(?=/|$|[^\w.-])", lambda _, t=roots[folder]: t, text)
    return text


def test_catalogue(text: str | None, roots: dict[str, str] | None = None) -> list[tuple[str, str, list[str]]] | None:
    """Sorted (name, id, command) of a JSON test listing; null if it is malformed or a name repeats.

    The id is a hash of name, command and properties with the roots replaced, so it is the same in any checkout.
    """
    try:
        doc = json.loads(text or "")
        if doc["kind"] != "ctestInfo" or doc["version"]["major"] != 1 or not doc["tests"]:
            return None
        out = {}
        for t in doc["tests"]:
            command = [_rooted(c, roots or {}) for c in t["command"]]
            props = sorted((p["name"], _rooted(json.dumps(p["value"], sort_keys=True), roots or {})) for p in t.get("properties", []))
            if not t["name"] or t["name"] in out or not command or len({k for k, _ in props}) < len(props):
                return None
            ident = json.dumps([t["name"], command, props], ensure_ascii=False, separators=(",", ":"))
            out[t["name"]] = (t["name"], hashlib.sha256(ident.encode()).hexdigest(), command)
    except (ValueError, KeyError, TypeError, AttributeError):
        return None
    return sorted(out.values(), key=lambda x: (x[1], x[0]))


def test_results(text: str | None, roots: dict[str, str] | None = None) -> list[tuple] | None:
    """Sorted (name, status, completion, exit_code, output_sha256) of an XML result file; null if it is malformed."""
    try:
        top = ET.fromstring(text or "")
    except ET.ParseError:
        return None
    out = {}
    for t in top.iterfind("./Testing/Test") if top.tag == "Site" else ():
        name = t.findtext("Name")
        named = {m.get("name"): (m.findtext("Value") or "") for m in t.iterfind("./Results/NamedMeasurement")}
        completion, code = named.get("Completion Status", ""), named.get("Exit Code")
        said = (t.get("Status") or "").lower()
        late = "timeout" in completion.lower() or "timeout" in (code or "").lower()
        status = "timeout" if late else "pass" if said == "passed" and completion == "Completed" else "fail" if said == "failed" else "infrastructure_error"
        output = t.findall("./Results/Measurement/Value")
        if not name or name in out or len(output) != 1 or output[0].attrib:
            return None
        out[name] = (name, status, completion, code, hashlib.sha256(_rooted(output[0].text or "", roots or {}).encode()).hexdigest())
    return sorted(out.values()) or None


# Compile arguments. Those that load or run something, read arguments from elsewhere, write extra files or
# depend on the machine are refused; outputs, dependency files and the like are left out, some with a value after them.
_REFUSED = ("--", "--config", "-B", "-Xclang", "-add-plugin", "-cc1", "-ftime-trace", "-load", "-mllvm", "-plugin", "-save-temps", "-wrapper")
_REFUSED_BEGINNINGS = ("--config=", "-B", "-fpass-plugin", "-fplugin", "-ftime-trace=", "-march=native", "-mcpu=native", "-mtune=native", "-save-temps=", "-specs=", "@")
_LEFT_OUT = ("-E", "-M", "-MD", "-MG", "-MM", "-MMD", "-MP", "-S", "-c", "-fsyntax-only", "-pipe")
_LEFT_OUT_BEGINNINGS = ("--serialize-diagnostics=", "-MF", "-MJ", "-MQ", "-MT", "-Werror", "-Wp,-M", "-dependency-file=")
_LEFT_OUT_WITH_VALUE = ("--serialize-diagnostics", "-MF", "-MJ", "-MQ", "-MT", "-dependency-file", "-o")
_SHELL = re.compile(r"[\0\n\r|;&<>`]|\$[({]")
_COMPILERS = re.compile(r"(?:[a-z0-9_.+-]+-)?(?:c\+\+|g\+\+|clang\+\+|gcc|clang)(?:-[0-9.]+)?", re.I)
_LAUNCHERS = ("ccache", "sccache")
#: Octets of the largest compile database that is read.
MOST_OCTETS = 16 << 20

INVOCATION = T.StructType([T.StructField("error", _S), T.StructField("directory", _S), T.StructField("arguments", T.ArrayType(_S)), T.StructField("sha256", _S)])


class _Refused(Exception):
    """Carries the error code of an input that isn't taken."""


def _at(path: object, base: str | None = None) -> str:
    if not isinstance(path, str) or not path or re.search(r"[\0\n\r]", path):
        raise _Refused("path")
    path = path.replace("\\", "/")
    if not path.startswith("/") and base is None:
        raise _Refused("path")
    return posixpath.normpath(posixpath.join(base or "/", path))


def _inside(path: str, *roots: str) -> bool:
    return any(path == r or path.startswith(r.rstrip("/") + "/") for r in roots)


def _words(entry: dict) -> list[str]:
    """The argument list of an entry, which gives either a list or one command line."""
    if ("arguments" in entry) == ("command" in entry):
        raise _Refused("form")
    try:
        words = entry["arguments"] if "arguments" in entry else shlex.split(entry["command"])
    except (ValueError, TypeError, AttributeError):
        raise _Refused("form") from None
    if not isinstance(words, list) or not words or not all(isinstance(w, str) and w for w in words):
        raise _Refused("form")
    return words


def _kind(word: str, source: str, directory: str) -> str:
    """``refused``, ``value`` (left out with the word after it), ``out``, ``source`` or ``kept``."""
    if _SHELL.search(word):
        return "refused"
    if word[0] != "-":
        if word[0] == "@":
            return "refused"
        return "source" if _at(word, directory) == source else "kept"
    if word in _REFUSED or word.startswith(_REFUSED_BEGINNINGS) or (word.startswith("-o") and word != "-o"):
        return "refused"
    if word in _LEFT_OUT_WITH_VALUE:
        return "value"
    return "out" if word in _LEFT_OUT or word.startswith(_LEFT_OUT_BEGINNINGS) else "kept"


def syntax_command(database: str | None, source: str | None, checkout: str, build: str, compiler: str) -> tuple[str | None, str | None, list[str] | None, str | None]:
    """(error, directory, arguments, sha256): how to have one source of a compile database parsed, and nothing else.

    Every entry's folder lies in the checkout or the build folder and its source in the checkout; the source has exactly
    one entry, which names it once, for a known compiler and with no argument that is refused. The hash is over folder,
    source and arguments with the two roots replaced, so it is the same in any checkout. Error codes: size, json, path,
    root, entry (none or several), form, compiler, argument, value, source.
    """
    try:
        if database is None or len(database.encode("utf-8", "surrogatepass")) > MOST_OCTETS:
            raise _Refused("size")
        try:
            entries = json.loads(database)
        except (ValueError, RecursionError):
            raise _Refused("json") from None
        if not isinstance(entries, list) or not entries or not all(isinstance(e, dict) for e in entries):
            raise _Refused("json")
        roots = {_at(build): "$BUILD", _at(checkout): "$CHECKOUT"}
        target, compiler = _at(source, _at(checkout)), _at(compiler)
        places = [(_at(e.get("directory")), e) for e in entries]
        files = [(_at(e.get("file"), d), d, e) for d, e in places]
        if not _inside(target, _at(checkout)) or not all(_inside(d, *roots) and _inside(f, _at(checkout)) for f, d, _ in files):
            raise _Refused("root")
        mine = [(d, e) for f, d, e in files if f == target]
        if len(mine) != 1:
            raise _Refused("entry")
        directory, words = mine[0][0], _words(mine[0][1])
        skip = 2 if posixpath.basename(words[0]) in _LAUNCHERS else 1
        if len(words) < skip or not _COMPILERS.fullmatch(posixpath.basename(words[skip - 1])):
            raise _Refused("compiler")
        words, kept, named = iter(words[skip:]), [], 0
        for w in words:
            kind = _kind(w, target, directory)
            if kind == "refused":
                raise _Refused("argument")
            if kind == "value" and next(words, None) is None:
                raise _Refused("value")
            if kind == "kept":
                kept.append(w)
            named += kind == "source"
        if named != 1:
            raise _Refused("source")
    except _Refused as e:
        return str(e), None, None, None
    arguments = [compiler, *kept, "-fsyntax-only", "-Xclang", "-ast-dump=json", target]
    payload = {"argv": [_rooted(a.replace("\\", "/"), roots) for a in arguments], "directory": _rooted(directory, roots), "source_file": _rooted(target, roots)}
    return None, directory, arguments, "sha256:" + hashlib.sha256(json.dumps(payload, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass")).hexdigest()


tree_spans_udf = F.udf(tree_spans, T.ArrayType(SPAN), useArrow=True)
test_catalogue_udf = F.udf(test_catalogue, T.ArrayType(TEST), useArrow=True)
test_results_udf = F.udf(test_results, T.ArrayType(RESULT), useArrow=True)


def syntax_command_udf(checkout: str, build: str, compiler: str) -> object:
    """A function of (database, source) columns for one checkout."""
    return F.udf(lambda database, source: syntax_command(database, source, checkout, build, compiler), INVOCATION, useArrow=True)
