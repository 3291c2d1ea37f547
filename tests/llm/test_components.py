from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomwright.llm import components as c


def parts(edges):
    up: dict = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    out: dict = {}
    for x in up:
        out.setdefault(find(x), set()).add(x)
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize("edges_in_a_task", [500_000, 0])
@pytest.mark.parametrize("shape", ["random", "chain", "star", "loops"])
def test_components_equal_union_find(spark, monkeypatch, shape, edges_in_a_task):
    monkeypatch.setattr(c, "ONE_TASK_EDGES", edges_in_a_task)
    rnd = random.Random(7)
    edges = {
        "random": [(f"n{rnd.randrange(70)}", f"n{rnd.randrange(70)}") for _ in range(60)],
        "chain": [(f"n{i}", f"n{i + 1}") for i in range(40)],
        "star": [("hub", f"n{i}") for i in range(50)] + [("x", "y")],
        "loops": [("a", "a"), ("b", "b"), ("b", "c"), ("c", "b"), ("b", "c")],
    }[shape]
    got: dict = {}
    for r in c.components(spark.createDataFrame(edges, "u string, v string")).collect():
        got.setdefault(r["component"], []).append(r["node"])
    assert all(len(v) == len(set(v)) for v in got.values())
    assert {frozenset(v) for v in got.values()} == parts(edges)
    assert all(k in v for k, v in got.items())


def test_no_edges(spark):
    assert c.components(spark.createDataFrame([], "u string, v string")).count() == 0


def test_canonical_keys(spark):
    same = ["forge.example/a/b", " Forge.Example/A/B ", "https://forge.example/a/b.git", "git@forge.example:a/b.git", "http://forge.example/a/b/", "/forge.example/a/b/"]
    none = [None, "", "  ", "unknown", "a/b", "-", "n/a", "a/b/c/d"]
    df = spark.createDataFrame([(x,) for x in same + none], "r string")
    assert [r[0] for r in df.select(c.canonical_repository(F.col("r"))).collect()] == ["forge.example/a/b"] * len(same) + [None] * len(none)
    p = spark.createDataFrame([(x,) for x in [" P01 ", "p01", None, "", " N/A", "Unknown", "-"]], "p string")
    assert [r[0] for r in p.select(c.problem_key(F.col("p"))).collect()] == ["p01", "p01", None, None, None, None, None]


def test_related_sets_and_splits(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([None, *[f"h/o/r{k}" for k in range(60)]]), rnd.choice([None, None, *[f"p{k}" for k in range(300)]])) for i in range(400)]
    rows += [(1000 + i, "h/o/hot", None) for i in range(150)]
    df = spark.createDataFrame(rows, "candidate_seq long, repo string, problem string").withColumn("id", F.lit("x")).withColumn("component", F.lit("y"))
    sets = c.related_sets(df, "candidate_seq", {"r": F.col("repo"), "p": F.col("problem")})
    got = {r["id"]: r["component"] for r in sets.collect()}
    edges = [(f"row{i}", f"{k}{v}") for i, a, b in rows for k, v in (("r:", a), ("p:", b)) if v is not None] + [(f"row{i}", f"row{i}") for i, _, _ in rows]
    want = parts(edges)
    by: dict = {}
    for i, comp in got.items():
        by.setdefault(comp, set()).add(f"row{i}")
    assert {frozenset(v) for v in by.values()} == {frozenset(x for x in v if x.startswith("row")) for v in want}
    splits = {r["component"]: r["split"] for r in c.assign_splits(sets, [("train", 0.8), ("validation", 0.1), ("test", 0.1)]).collect()}
    assert set(splits) == set(got.values())
    again = {r["component"]: r["split"] for r in c.assign_splits(sets.repartition(5), [("train", 0.8), ("validation", 0.1), ("test", 0.1)]).collect()}
    assert splits == again


def test_splits_get_their_shares(spark):
    sets = spark.range(6000).select("id", F.concat(F.lit("c"), (F.col("id") / 3).cast("int").cast("string")).alias("component"))
    n = {r["split"]: r["n"] for r in sets.join(c.assign_splits(sets, [("train", 0.8), ("validation", 0.1), ("test", 0.1)]), "component").groupBy("split").agg(F.count("id").alias("n")).collect()}
    assert abs(n["train"] - 4800) < 10 and abs(n["validation"] - 600) < 10 and abs(n["test"] - 600) < 10
    assert c.assign_splits(sets.where("false"), [("train", 1.0)]).count() == 0
