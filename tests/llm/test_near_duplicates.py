from __future__ import annotations

import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomwright.llm import cross_split, near_duplicates as nd
from loomwright.llm import textvec as tv

WORDS = [f"w{i}" for i in range(400)]


def phrases(*texts):
    out = set()
    for t in texts:
        w = re.findall(r"[A-Za-z0-9_]+", t or "")
        out |= {tuple(w[i : i + 4]) for i in range(len(w) - 3)}
    return out


def likeness(a, b):
    return Fraction(len(a & b), len(a | b)) if a | b else Fraction(0)


def corpus(seed, n=40):
    rnd = random.Random(seed)
    base = [[rnd.choice(WORDS) for _ in range(rnd.randint(20, 120))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        a, b = list(rnd.choice(base)), list(rnd.choice(base))
        for x in (a, b):
            for _ in range(rnd.choice([0, 0, 1, 2, 6])):
                at = rnd.randrange(len(x))
                x[at : at + 1] = rnd.choice([[], [rnd.choice(WORDS)], [x[at], rnd.choice(WORDS)]])
        rows.append((i, " ".join(a), rnd.choice([None, "", ";\n".join(b), "ü " + "\t".join(b)])))
    return [*rows, (n, None, None), (n + 1, "", ""), (n + 2, "one two three", None), (n + 3, "x y z q " * 3000, ""), (n + 4, "x y z q " * 3000, "")]


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_equal_brute_force(spark, seed):
    rows = corpus(seed)
    sets = {i: phrases(a, b) for i, a, b in rows}
    want = {(i, j) for i in sets for j in sets if i < j and sets[i] and likeness(sets[i], sets[j]) >= Fraction(7, 10)}
    df = spark.createDataFrame(rows, "pair_id long, old_contents string, new_contents string").withColumn("id", F.lit("clash")).withColumn("n", F.lit(0)).withColumn("bands", F.lit(None).cast("string"))
    members, links = nd.classes_and_links(df, "pair_id", ["old_contents", "new_contents"])
    assert {tuple(r) for r in nd.expand_pairs(members, links).collect()} == want
    assert sorted(r["id"] for r in members.collect()) == sorted(sets)
    # copies are one class, and their class is named after the least
    got = {r["id"]: r["class_id"] for r in members.collect()}
    for i in sets:
        same = [j for j in sets if sets[i] and sets[j] == sets[i]]
        assert got[i] == (min(same) if same else i)


@pytest.mark.parametrize("seed", [5])
def test_groups_equal_brute_force(spark, seed):
    rows = corpus(seed)
    sets = {i: phrases(a, b) for i, a, b in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and likeness(sets[i], sets[j]) >= Fraction(7, 10):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    df = spark.createDataFrame(rows, "pair_id long, old_contents string, new_contents string").withColumn("band", F.lit("clash")).withColumn("g", F.lit(0))
    got = {r["id"]: (r["class_id"], r["group_id"]) for r in nd.groups(df, "pair_id", ["old_contents", "new_contents"]).collect()}
    assert {i: g for i, (_, g) in got.items()} == {i: top(i) for i in sets}
    assert all(c == min([j for j in sets if sets[i] and sets[j] == sets[i]], default=i) for i, (c, _) in got.items())


def test_many_revisions_make_few_links(spark, monkeypatch):
    # each revision differs from the others in a few words: all pairs are alike, and links stay in proportion to the rows
    rnd = random.Random(9)
    base = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(400):
        x = list(base)
        for _ in range(3):
            x[rnd.randrange(300)] = f"edit{i}_{rnd.randrange(99)}"
        rows.append((i, " ".join(x), None))
    seen, plain = [], nd.likeness_at_least

    def counted(pairs, sets, threshold):
        seen.append(pairs.count())
        return plain(pairs, sets, threshold)

    monkeypatch.setattr(nd, "likeness_at_least", counted)
    df = spark.createDataFrame(rows, "pair_id long, old_contents string, new_contents string")
    got = nd.groups(df, "pair_id", ["old_contents", "new_contents"]).collect()
    assert {r["group_id"] for r in got} == {0}
    assert sum(seen) < 45 * 400  # a link a band and row at most, where all pairs would be 79,800


def test_empty_table(spark):
    df = spark.createDataFrame([], "pair_id long, old_contents string, new_contents string")
    members, links = nd.classes_and_links(df, "pair_id", ["old_contents", "new_contents"])
    assert members.count() == 0 and links.count() == 0
    assert nd.groups(df, "pair_id", ["old_contents", "new_contents"]).count() == 0


def test_min_max_signature_estimates_likeness():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    a, b = x[:700], x[200:]
    va, vb = (s[:, None] * nd._MULT[:400] + nd._ADD[:400] for s in (a, b))
    agree = np.mean(np.concatenate([va.min(0) == vb.min(0), va.max(0) == vb.max(0)]))
    assert abs(agree - 500 / 900) < 0.06


def test_words_and_slices_do_not_touch():
    texts = ["ab cd", "ef_1 g", "", "été x1", "z" * 50]
    one = [list(s) for s in tv.phrase_sets(pa.array(texts), 1)]
    assert [len(s) for s in one] == [len(set(re.findall(r"[A-Za-z0-9_]+", t))) for t in texts]
    limit = tv.SLICE_BYTES
    tv.SLICE_BYTES = 4
    try:
        data, offsets = tv.buffers(pa.array(texts))
        assert [b - a for a, b in tv.slices(offsets, 4)] == [1, 1, 2, 1] or sum(b - a for a, b in tv.slices(offsets, 4)) == 5
    finally:
        tv.SLICE_BYTES = limit
    sliced = pa.array(["pad", *texts, None])[1:]
    assert [list(s) for s in tv.phrase_sets(sliced, 1)] == [*one, []]


@pytest.mark.parametrize("seed", [3, 4])
def test_crossing_pairs_equal_brute_force(spark, seed):
    rows = corpus(seed, 36)
    train, held = [r for r in rows if r[0] % 3], [r for r in rows if r[0] % 3 == 0]
    want = set()
    for i, *a in train:
        for j, *b in held:
            if any(phrases(x) and likeness(phrases(x), phrases(y)) >= Fraction(17, 20) for x in a for y in b):
                want.add((i, j))
    frames = [spark.createDataFrame(x, "id long, o string, n string") for x in (train, held)]
    got = cross_split.overlaps(*frames, ["o", "n"])
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    # containment of the evaluation record: of the contents that are like enough the greatest share
    every = frames[0].selectExpr("*", "false as held").unionByName(frames[1].selectExpr("*", "true as held")).unionByName(frames[1].selectExpr("id + 1000 as id", "o", "n", "cast(null as boolean) as held"))
    for r in cross_split.crossing(every, ["o", "n"]).collect():
        a, b = rows[r["train_id"]][1:], rows[r["eval_id"]][1:]
        shares = [Fraction(len(phrases(x) & phrases(y)), len(phrases(y))) for x in a for y in b if phrases(x) and likeness(phrases(x), phrases(y)) >= Fraction(17, 20)]
        assert Fraction(r["shared"], r["phrases"]) == max(shares)
    empty = frames[1].where("false")
    assert cross_split.overlaps(frames[0], empty, ["o", "n"]).count() == 0


def test_prefixes_share_an_ngram():
    rnd = random.Random(0)
    rank = np.array([rnd.randrange(256) for _ in range(1 << 12)], np.uint8)
    t = Fraction(17, 20)
    for _ in range(200):
        base = np.unique(np.array([rnd.getrandbits(64) for _ in range(rnd.randint(1, 60))], np.uint64))
        other = np.unique(np.concatenate([base[: rnd.randint(0, len(base))], np.array([rnd.getrandbits(64) for _ in range(rnd.randint(0, 5))], np.uint64)]))
        if len(other) and likeness(set(base.tolist()), set(other.tolist())) >= t:
            assert set(cross_split.prefix(base, rank, t).tolist()) & set(cross_split.prefix(other, rank, t).tolist())


def test_tables_are_merged_over_many_tasks(spark, monkeypatch):
    from loomwright.llm import fixed_tables as ft

    monkeypatch.setattr(ft, "FAN_IN", 3)
    monkeypatch.setattr(ft, "CHUNK", 1 << 10)
    df = spark.range(0, 5000, 1, 20).selectExpr("array(id * 7919, id) as h")
    seen = np.frombuffer(ft.bit_map(df, 16), np.uint8)
    held = np.array([x for i in range(5000) for x in (i * 7919, i)], np.uint64)
    assert ft.is_marked(seen, held, 16).all()
    assert ft.is_marked(seen, np.arange(10**9, 10**9 + 1000, dtype=np.uint64), 16).mean() < 0.25
    texts = spark.createDataFrame([("a b c d e",)] * 30, "t string").repartition(10)
    monkeypatch.setattr(ft, "TASKS", 4)
    sketch = cross_split.frequency_sketch(texts, ["t"], 4, 10)
    assert sorted(sketch[sketch > 0].tolist()) == [round(8 * np.log2(31))] * 2
