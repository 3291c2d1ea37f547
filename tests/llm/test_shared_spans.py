from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from loomwright.llm import shared_spans as s


def brute(rows, length):
    where: dict = {}
    for i, t in rows:
        for p in range(len(t or "") - length + 1):
            where.setdefault(t[p : p + length], set()).add(i)
    out = set()
    for i, t in rows:
        cur = None
        for p in range(len(t or "") - length + 1):
            if len(where[t[p : p + length]]) > 1:
                if cur and p <= cur[1]:
                    cur[1] = p + length
                else:
                    if cur:
                        out.add((i, *cur))
                    cur = [p, p + length]
        if cur:
            out.add((i, *cur))
    return out


def corpus(seed, length):
    rnd = random.Random(seed)
    alphabet = "abcdefgh  .\né日🙂"
    draw = lambda n: "".join(rnd.choice(alphabet) for _ in range(n))
    shared = [draw(rnd.randint(length - 5, 3 * length)) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = [draw(rnd.randint(0, 2 * length))]
        for _ in range(rnd.randint(0, 3)):
            x = rnd.choice(shared)
            a = rnd.randint(0, len(x) // 3)
            parts += [x[a : len(x) - rnd.randint(0, len(x) // 3)], draw(rnd.choice([0, 1, 30]))]
        rows.append((i, "".join(parts)))
    rows += [(50, None), (51, ""), (52, "x"), (53, rows[0][1]), (54, rows[0][1]), (55, "=" * 5 * length), (56, "=" * 2 * length + "a"), (57, "ab" * 3 * length), (58, "z" * (length - 1)), (59, "z" * (length - 1)), (60, shared[0][:length] * 2)]
    return rows


@pytest.mark.parametrize(("seed", "length", "contexts"), [(1, 40, 2000), (2, 41, 1), (3, 200, 2000), (4, 200, 2)])
def test_spans_equal_brute_force(spark, monkeypatch, seed, length, contexts):
    monkeypatch.setattr(s, "GROUP_CONTEXTS", contexts)
    rows = corpus(seed, length)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("h", F.lit(1)).withColumn("start", F.lit(1))
    got = s.shared_spans(df, "doc_id", "text", length)
    assert {tuple(r) for r in got.collect()} == brute(rows, length)
    share = {r["id"]: r for r in s.shared_share(df, "doc_id", "text", got).collect()}
    assert sorted(share) == sorted(i for i, _ in rows)
    assert share[53]["shared_chars"] == share[53]["chars"] == len(rows[0][1]) or len(rows[0][1]) < length
    assert (share[50]["chars"], share[50]["spans"]) == (0, 0)


def test_nothing_shared(spark):
    df = spark.createDataFrame([(1, "a" * 300), (2, "b" * 300)], "doc_id long, text string")
    assert s.shared_spans(df, "doc_id", "text", 200).count() == 0
    assert s.shared_spans(df.where("false"), "doc_id", "text", 200).count() == 0


def sentences(t):
    return re.findall(r"(?s).*?(?:\n|[.!?] |。)|.+$", t or "")


def cleaned(rows, least):
    """By comparing all runs of sentences as texts."""
    at, out = {}, {}
    for i, t in rows:
        x = sentences(t)
        for k in range(len(x)):
            for m in range(k + 2, len(x) + 1):
                if sum(map(len, x[k:m])) >= least:
                    at.setdefault("".join(x[k:m]), []).append((i, k, m))
                    break
    gone = {(i, j) for runs in at.values() for i, k, m in sorted(runs)[1:] for j in range(k, m)}
    for i, t in rows:
        x = sentences(t)
        out[i] = (None if t is None else "".join(s for j, s in enumerate(x) if (i, j) not in gone), sum((i, j) in gone for j in range(len(x))))
    return out


@pytest.mark.parametrize(("seed", "least"), [(5, 50), (6, 20)])
def test_repeated_sentences_go_but_for_the_first(spark, seed, least):
    rnd = random.Random(seed)
    pool = ["A sentence of some length. ", "Short. ", "日本語の文章です。", "x\n", "\n", "Was it a question? ", "no end", "Another one that is a good deal longer than the rest of them! ", "e.g. "]
    pool += ["".join(rnd.choice("abc .") for _ in range(rnd.randint(1, 40))) + rnd.choice(["\n", ". ", "! "]) for _ in range(20)]
    rows = [(i, "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 12)))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, "x"), (73, "a\n"), (74, rows[1][1]), (75, rows[2][1] * 3), (76, "\n" * 200), (77, "word. " * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("h", F.lit(1))
    got = {r["id"]: (r["text"], r["removed"]) for r in s.without_repeats(df, "doc_id", "text", least).collect()}
    assert got == cleaned(rows, least)
    assert s.without_repeats(df.where("false"), "doc_id", "text").count() == 0


def test_windows_are_looked_up_by_sentence_runs():
    text = "".join(f"This is sentence number {i} of the text. " for i in range(40))
    points, offsets = s._points([text, "z" * 500])
    window, at, h = s.anchors(points, offsets, 200)
    inside = window < len(text)
    assert (at[inside] % 2 == 0).all() and (at[~inside] % 2 == 1).all()
    # the run lies in the window, its beginning's look-back included
    assert (at[inside] // 2 >= window[inside] + 2).all() and (at[inside] // 2 + 50 <= window[inside] + 200).all()


def test_a_hot_run_is_counted_over_all_tasks(spark, monkeypatch):
    # one run of sentences in many different contexts, some of which share windows
    monkeypatch.setattr(s, "GROUP_CONTEXTS", 5)
    hot = "The very same two sentences stand in here. They stand in there as well. "
    rows = [(i, f"{i}x" * 60 + ". " + ("y" * 70 if i % 3 else f"{i}y" * 40) + hot + ("z" * 90 if i % 2 else f"{i}z" * 50)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in s.shared_spans(df, "doc_id", "text", 200).collect()} == brute(rows, 200)
