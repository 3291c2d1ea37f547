"""Generated, minified, vendored and data files among hand-written source.

Vendored files are found by an inverted index of line hashes. Lines are counted over distinct projects; those of one
project alone have no holder elsewhere and leave at once, through a bit map. A file's rarest lines, as many as the
containment makes necessary, are looked up in the index, so that no holder of enough of its lines is left out, and
containment is counted exactly over all lines, each weighing as many words as it has. Before that a line's few telling
holders (its own project's, if one says so) are tried, which settles the copies of a library that stands everywhere at
a cost linear in its lines. The opening comment is no part of the lines: headers are common to unrelated files.
Which side is the original follows from the names that the files give themselves (namespace, header, copyright) and
their projects. The other kinds are told by the composition of the file: a generator's mark in its opening or closing
comment (never in code or strings), lines of few shapes repeated over and over, long lines without spaces, or a body
that is mostly literals.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm import textvec as tv
from loomwright.llm.components import canonical_repository
from loomwright.llm.fixed_tables import bit_map, is_marked, map_bits
from loomwright.session import staged, unstage

#: A file is a copy if this share of its words, and at least this many, stand in whole lines in one file of another project.
CONTAINED, CONTAINED_WORDS = 0.5, 16
#: Low bits of a line's hash that hold its number of words (a longer line weighs the most that they can say).
WEIGHT_BITS = 12
#: A file is first compared with files that this share of its words points to; what that leaves open is searched in full.
POINTED = 0.2
#: The fewest literals that make a body a table, and the fewest lines of the same shapes that make it a generator's.
VALUES, ALIKE = 24, 12
#: Holders of a line that one key of the search has at most, about; a line with more is spread over several.
SALTED = 1000

# Folders in which projects keep other projects' code.
VENDOR_FOLDERS = ("3rdparty", "3rd_party", "bower_components", "bundled", "contrib", "deps", "extern", "external", "externals", "node_modules", "subprojects", "submodules", "third-party", "third_party", "thirdparty", "vendor", "vendored", "vendors")

_OPENING = re.compile(r"﻿?(?:\s+|//[^\n]*(?:\n|\Z)|/\*.*?(?:\*/|\Z)|#![^\n]*\n)*", re.S)
_LINE_BLOCK = re.compile(r"\n[ \t]*/\*")
_MARK = re.compile(
    r"@generated\b|\bauto-?generated\b|\b(?:automatically|machine)[ -](?:generated|created|written|produced|made)\b|\b(?:was|is|been) (?:produced|generated|created) automatically\b"
    r"|\bgenerated (?:by|from|on|with|using|at|code)\b|\*\* *generated *\*\*|\bdo not (?:hand-?)?(?:edit|modify|change)\b(?! the\b)|\bedits? (?:are|is|will be) (?:overwritten|lost|discarded)\b"
    r"|\b(?:manual )?changes will be (?:lost|overwritten)\b|\bgenerated code\b|\berzeugt von\b|\bautomatisch (?:erzeugt|generiert)\b|\bnicht (?:von hand )?(?:bearbeiten|ändern)\b|\b(?:output of|created by|written by) \S+[;,].*(?:edit|overwrit)",
    re.I,
)
_STRING = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'')
_NUMBER = re.compile(r"\b0[xX][0-9a-fA-F]+\w*|\b\d[\d.]*(?:[eE][-+]?\d+)?\w*")
_LITERAL = re.compile(f"{_STRING.pattern}|{_NUMBER.pattern}")
_NAME = re.compile(r"[A-Za-z_]\w*")
_SAYS = re.compile(r"[\w\"']")
_SPACES = re.compile(r"namespace\s+([A-Za-z_]\w*)")
_HOLDER = re.compile(r"\b[Cc]opyright\b[^\n]*?\d{4}(?:\s*-\s*\d{4})?,?\s+(?:[Tt]he\s+)?([\w.-]+?)\s+(?:contributors|authors|developers|project|team)\b")
_BELONGS = re.compile(
    r"\b[Pp]art of (?:the )?([\w.-]+)(?: project)? \(v?\d|\b(?:belongs to|is part of|taken from|imported from|copied from) (?:the )?([\w.-]+?) (?:project|library)\b"
    r"|^\W*([\w.-]+) v?\d+\.\d+(?:\.\d+)? - [^\n]*\blibrary\b|^\W*([\w.-]+) v\d+\.\d+(?:\.\d+)?, (?:home|see|from|url)\b",
    re.M,
)


def _plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def closing(text: str, start: int) -> int:
    """Where the comments and blanks at the end of ``text`` begin, not before ``start``; each comment begins its line."""
    end = len(text)
    while True:
        while end > start and text[end - 1].isspace():
            end -= 1
        at = -1
        if text.endswith("*/", start, end):
            # the first comment that opens a line after the one closed before
            before = text.rfind("*/", start, end - 2)
            block = _LINE_BLOCK.search(text, start if before < 0 else max(text.rfind("\n", start, before), start), end - 2)
            while block and block.end() <= before:
                block = _LINE_BLOCK.search(text, block.end(), end - 2)
            at = block.start() if block else -1
        if at < 0:
            line = text.rfind("\n", start, end)
            if line < 0 or not text[line + 1 : end].lstrip(" \t").startswith("//"):
                return end
            at = line
        end = at


def composition(text: str) -> str | None:
    """``generated``, ``minified``, ``data`` or none of them, by the file's own text."""
    opening = _OPENING.match(text).end()
    tail = closing(text, opening)
    if _MARK.search(text, 0, opening) or _MARK.search(text, tail):
        return "generated"
    body = text[opening:tail]
    if not body.strip():
        return None
    lines = body.split("\n")
    code = [x for x in lines if x.strip()]
    size = len(body)
    # long lines with hardly any white space
    long_part = sum(len(x) for x in code if len(x) > 300)
    if long_part > 0.5 * size:
        white = body.count(" ") + body.count("\n") + body.count("\t")
        literal = sum(len(m) for m in _STRING.findall(body)) + sum(len(m) for m in _NUMBER.findall(body))
        if literal > 0.6 * size:
            return "data"
        return "minified" if white < 0.12 * size else None
    shapes: Counter[str] = Counter()
    table = literals = values = counted = 0
    for x in code:
        x = x.strip()
        if not _SAYS.search(x) or x.startswith(("#include", "//", "*", "/*")):
            continue
        shape = _NAME.sub("w", _NUMBER.sub("0", _STRING.sub("s", x)))
        shape = re.sub(r"//.*$", "//", shape)
        counted += 1
        shapes[shape] += 1
        if "w" not in shape.partition("//")[0]:
            table += 1
            literals += len(x)
            values += len(_LITERAL.findall(x))
    if values >= VALUES and table > 0.6 * counted and literals > 0.5 * sum(len(x.strip()) for x in code):
        # numbers with a remark on each line are a generator's tables, bare ones are data
        remarked = sum(n for s, n in shapes.items() if s.endswith("//") and "w" not in s)
        return "generated" if remarked > 0.5 * table else "data"
    if sum(n for _, n in shapes.most_common(2)) > max(0.55 * counted, ALIKE - 1):
        return "generated"
    return None


def claims(text: str) -> tuple[list[str], list[str]]:
    """(names, owners): all projects that a file's namespaces and opening name, and those its header says it is of."""
    opening = text[: _OPENING.match(text).end()]
    owners = {_plain(x) for m in _BELONGS.findall(opening) for x in m if x}
    names = owners | {_plain(x) for x in _HOLDER.findall(opening)} | {_plain(x) for x in _SPACES.findall(text)}
    return sorted(names - {""}), sorted(owners - {""})


def line_hashes(text: bytes) -> np.ndarray:
    """Distinct hashes of the lines with a word, without indent and line end; the low bits are their number of words."""
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    ends = np.append(np.flatnonzero(data == 10), len(data))
    starts = np.concatenate([[0], ends[:-1] + 1])
    solid = np.flatnonzero(data > 32)
    if not len(solid):
        return np.zeros(0, np.uint64)
    a = np.searchsorted(solid, starts)
    b = np.searchsorted(solid, ends) - 1
    has = b >= a
    first, last = solid[a[has]], solid[b[has]]
    wordy = tv.is_word(data)
    begun = np.cumsum(wordy & ~np.concatenate([[False], wordy[:-1]]))
    # no word runs over a line's beginning, so those begun up to its end but not before it are its own
    words = begun[last] - np.where(first > 0, begun[first - 1], 0)
    first, last, words = first[words > 0], last[words > 0], words[words > 0]
    up, down = tv.powers(len(data))
    total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
    most = (1 << WEIGHT_BITS) - 1
    h = tv.mix((total[last + 1] - total[first]) * down[first])
    return np.unique((h & ~np.uint64(most)) | np.minimum(words, most).astype(np.uint64))


def _body(text: str) -> bytes:
    return text[_OPENING.match(text).end() :].encode("utf-8", "surrogatepass")


def _weight(line: F.Column) -> F.Column:
    return line.bitwiseAND(F.lit((1 << WEIGHT_BITS) - 1))


def roots(repositories: DataFrame) -> DataFrame:
    """(repository, root): the repository that a fork goes back to; itself for one that is no fork.

    Parents are followed by doubling: after k rounds 2**k of them. A cycle ends at its least name.
    """
    base = repositories.select(
        canonical_repository(F.col("repository")).alias("repository"),
        F.when(F.col("fork") & F.col("parent_full_name").isNotNull(), F.lower(F.trim("parent_full_name"))).alias("parent"),
    ).where("repository is not null").groupBy("repository").agg(F.min("parent").alias("parent"))
    host = F.split("repository", "/")[0]
    up = F.when(F.size(F.split("parent", "/")) == 2, F.concat_ws("/", host, "parent")).when(F.size(F.split("parent", "/")) == 3, F.col("parent"))
    hop = staged(base.select("repository", F.coalesce(up, F.col("repository")).alias("root")), "roots")
    for _ in range(16):
        above = hop.select(F.col("repository").alias("root"), F.col("root").alias("next"))
        further = hop.join(above, "root", "left").select("repository", F.coalesce("next", "root").alias("next"), "root")
        if further.where("next <> root").isEmpty():
            break
        hop = staged(further.select("repository", F.col("next").alias("root")), "roots")
    return hop


def judge_files(pairs: DataFrame, repositories: DataFrame) -> DataFrame:
    """(pair_id, verdict, of_pair) of every row: ``handwritten``, ``generated``, ``minified``, ``data`` or ``vendored``.

    ``of_pair`` is a row of another project that holds a vendored file's lines, if there is one. A row without
    contents is judged by its path alone. Rows of one project and of its forks are never another project's.
    """
    picked = pairs.select(
        F.col("pair_id").cast("long").alias("pair_id"),
        canonical_repository(F.col("repository")).alias("repository"),
        F.coalesce(F.col("new_file"), F.col("old_file"), F.lit("")).alias("path"),
        F.coalesce("new_contents", F.lit("")).alias("text"),
        F.col("committed_at").cast("string").alias("at"),
    )

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["text"]:
                names, owners = claims(t)
                rows.append((composition(t), names, owners, line_hashes(_body(t)).view(np.int64)))
            out = b[["pair_id", "repository", "path", "at"]].copy()
            out["kind"], out["names"], out["owners"], out["lines"] = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield out

    seen = picked.mapInPandas(look, "pair_id long, repository string, path string, at string, kind string, names array<string>, owners array<string>, lines array<long>")
    seen = staged(seen, "looked")
    words = F.aggregate("lines", F.lit(0).cast("long"), lambda sum_, x: sum_ + _weight(x))
    sets = words.alias("n"), F.xxhash64("lines").alias("k1"), F.xxhash64(F.lit("lines"), "lines").alias("k2")
    rooted = seen.select("*", *sets).drop("lines").join(roots(repositories), "repository", "left").withColumn("root", F.coalesce("root", "repository", F.lit("")))
    short = F.regexp_replace(F.element_at(F.split("root", "/"), -1), "[^a-z0-9]", "")
    parts = F.split(F.lower("path"), "/")
    facts = rooted.withColumn("rh", F.xxhash64("root")).withColumn("own", F.array_contains("names", short) & (short != ""))
    facts = facts.withColumn("kept", F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), F.array(*[F.lit(v) for v in VENDOR_FOLDERS])) & (F.size(parts) > 1))
    facts = staged(facts, "facts")
    best = staged(holders(seen.select("pair_id", "lines"), facts), "holders")
    unstage(seen)
    full = facts.join(best, "pair_id", "left")
    placed = ~F.col("own") & ((F.size("owners") > 0) | F.col("kept"))
    verdict = F.when(F.col("other").isNotNull() | placed, "vendored").when(F.col("kind").isNotNull(), F.col("kind")).otherwise("handwritten")
    return full.select("pair_id", verdict.alias("verdict"), F.when(verdict == "vendored", F.col("other")).alias("of_pair"))


def _marked_lines(lines: DataFrame, ends: DataFrame) -> DataFrame:
    """``lines`` (pair_id, lines) with only those lines that stand in ``ends``, but for a few let through by chance."""
    bits = map_bits(ends.count())
    seen_cast = lines.sparkSession.sparkContext.broadcast(bit_map(ends.select(F.array("line").alias("hashes")), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(seen_cast.value, np.uint8)
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
            keep = is_marked(seen, flat.view(np.uint64), bits) if len(flat) else np.zeros(0, bool)
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            cut = np.concatenate([[0], np.cumsum(lengths)])
            offsets = np.concatenate([[0], np.cumsum(keep)])[cut].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[keep], pa.int64()))], names=["pair_id", "lines"])

    return lines.mapInArrow(run, "pair_id long, lines array<long>")


def holders(lines: DataFrame, facts: DataFrame) -> DataFrame:
    """(pair_id, other): of each file that is a copy a file of another project that holds its lines and is the original.

    A file is a copy if some file of another project holds enough of its lines, it doesn't bear its own project's name,
    and it says that it is foreign, or the other file bears its project's name or is older. Files with the same lines
    are one class. A class is first compared with two of its lines' holders, those that bear their project's name
    first, which settles most copies at a cost linear in the lines; what that leaves open is compared with all classes
    that share one of its rarest lines.
    """
    foreign = F.col("kept") | (F.size("owners") > 0) | (~F.col("own") & (F.size("names") > 0))
    # a row that names no repository is in nobody's; only its own words can tell that it is another project's
    somewhere = (F.col("root") != "") | F.col("kept") | (F.size("owners") > 0)
    picked = facts.where(F.col("n") >= 1).select("pair_id", "k1", "k2", "n", "rh", "own", F.struct("at", "pair_id").alias("age"), foreign.alias("foreign"), (~F.col("own") & somewhere & (F.col("n") >= CONTAINED_WORDS)).alias("open"))
    ids = picked.groupBy("k1", "k2").agg(F.min("pair_id").alias("cid"))
    members = staged(picked.join(ids, ["k1", "k2"]).drop("k1", "k2"), "members")

    # of each class the ends of its projects, the oldest file and the oldest of another project, two with their project's name
    per_root = members.groupBy("cid", "rh").agg(F.min("age").alias("age"), F.min(F.when(F.col("own"), F.col("pair_id"))).alias("named"), F.first("n").alias("n"))
    named = F.when(F.col("named").isNotNull(), F.struct("rh", F.col("named").alias("pair_id")))
    first = per_root.groupBy("cid").agg(F.first("n").alias("n"), F.min("rh").alias("lo"), F.max("rh").alias("hi"), F.min(F.struct("age", "rh")).alias("old"), F.min(named).alias("named"), F.max(named).alias("named2"))
    second = per_root.join(first.select("cid", "old"), "cid").where(F.col("rh") != F.col("old.rh")).groupBy("cid").agg(F.min(F.struct("age", "rh")).alias("old2"))
    classes = staged(first.join(second, "cid", "left"), "classes")
    known = classes.select("cid", "n", "lo", "hi", F.col("named").isNotNull().alias("said"))

    # the index: every line with the ends of its projects, its number of holders and two of them
    each = lines.join(known.withColumnRenamed("cid", "pair_id"), "pair_id").select(F.col("pair_id").alias("cid"), "lo", "hi", "said", F.explode("lines").alias("line"))
    least, most = F.min(F.struct(~F.col("said"), "lo", "cid")), F.max(F.struct("said", "hi", "cid"))
    ends = each.groupBy("line").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), least["cid"].alias("a"), most["cid"].alias("b"), F.count(F.lit(1)).alias("files"))
    # lines of one project alone have no holder elsewhere; they only add to a file's words
    ends = staged(ends.where("lo <> hi").select("line", "files", "a", "b"), "index")
    common = _marked_lines(lines, ends).where(F.size("lines") > 0).join(known.select(F.col("cid").alias("pair_id"), "n"), "pair_id").select(F.col("pair_id").alias("cid"), "n", F.explode("lines").alias("line")).join(ends, "line").withColumn("w", _weight(F.col("line")))
    # the words of the lines that are not rarer: as long as they may be enough, a holder need not have any of the rarer ones
    left = F.sum("w").over(Window.partitionBy("cid").orderBy(F.desc("files"), F.desc("line")))
    need = F.greatest(F.ceil(F.col("n") * CONTAINED), F.lit(CONTAINED_WORDS)).cast("long")
    common = staged(common.withColumn("left", left).withColumn("need", need), "common")

    sides = [classes.select(*[F.col(c).alias(f"{c}_{x}") for c in classes.columns]) for x in "st"]
    mine, theirs = (lines.select(F.col("pair_id").alias(f"cid_{x}"), F.col("lines").alias(f"lines_{x}")) for x in "st")

    def settle(pairs: DataFrame, files: DataFrame) -> DataFrame:
        """(pair_id, other) of those ``files`` of class ``cid_s`` that are copies by one of the pairs of classes."""
        held = pairs.join(mine, "cid_s").join(theirs, "cid_t")
        held = held.select("cid_s", "cid_t", F.aggregate(F.array_intersect("lines_s", "lines_t"), F.lit(0).cast("long"), lambda sum_, x: sum_ + _weight(x)).alias("shared"))
        both = held.join(sides[1], "cid_t").join(files.withColumnRenamed("cid", "cid_s"), "cid_s").where((F.col("shared") >= CONTAINED * F.col("n")) & (F.col("shared") >= CONTAINED_WORDS))
        apart = lambda c: F.col(f"{c}_t.rh") != F.col("rh")
        old = F.when(apart("old"), F.col("old_t.age")).when(apart("old2"), F.col("old2_t.age"))
        name = F.when(apart("named"), F.col("named_t.pair_id")).when(apart("named2"), F.col("named2_t.pair_id"))
        other = F.coalesce(name, F.when(F.col("foreign") | (old < F.col("age")), old["pair_id"]))
        return both.select("pair_id", "shared", other.alias("other")).where("other is not null").groupBy("pair_id").agg(F.max(F.struct("shared", "other")).alias("b")).select("pair_id", F.col("b.other").alias("other"))

    opened = members.where("open").select("cid", "n", "pair_id", "rh", "age", "foreign")
    pointed = common.select(F.col("cid").alias("cid_s"), "n", "w", F.explode(F.array_distinct(F.array("a", "b"))).alias("cid_t"))
    pointed = pointed.groupBy("cid_s", "cid_t").agg(F.sum("w").alias("k"), F.first("n").alias("n")).where(F.col("k") >= POINTED * F.col("n")).select("cid_s", "cid_t")
    near = staged(settle(pointed, opened), "settled")

    # A holder of ``need`` words of a file has one of the lines without which the others have fewer: the rarest ones.
    rest = staged(opened.join(near, "pair_id", "left_anti"), "left")
    wanted = rest.groupBy(F.col("cid").alias("cid_s")).agg(F.max("foreign").alias("foreign_s"), F.max("age").alias("age_s"))
    salts = F.ceil(F.col("files") / SALTED).cast("int")
    rare = common.where("left >= need").join(rest.select("cid").distinct(), "cid", "left_semi")
    rare = rare.select(F.col("cid").alias("cid_s"), "need", "line", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    posts = common.select(F.col("cid").alias("cid_t"), F.col("n").alias("n_t"), "line", F.pmod(F.xxhash64("cid"), salts).cast("int").alias("salt"))
    pairs = posts.join(rare, ["line", "salt"]).where("n_t >= need").select("cid_s", "cid_t").distinct()
    # pairs that no verdict can come from: of one project only, or neither foreign, nor named, nor older
    pairs = pairs.join(sides[0].select("cid_s", "lo_s", "hi_s"), "cid_s").join(wanted, "cid_s").join(sides[1].select("cid_t", "lo_t", "hi_t", "named_t", "old_t"), "cid_t")
    pairs = pairs.where(F.least("lo_s", "lo_t") != F.greatest("hi_s", "hi_t")).where(F.col("foreign_s") | F.col("named_t").isNotNull() | (F.col("old_t.age") < F.col("age_s")))
    pairs = staged(pairs.select("cid_s", "cid_t"), "rare")
    return near.unionByName(settle(pairs, rest))
