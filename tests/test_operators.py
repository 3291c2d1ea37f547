from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomwright.operators import assertions, dedup, gates, joins, metrics, select
from loomwright.operators.rules import RuleSet, reject_histogram, stage_chain


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_rules(spark):
    df = spark.createDataFrame([(1, "s", 5), (2, "s", None), (3, "t", 50)], "id int, src string, x int")
    r = RuleSet.of(("missing", F.col("x").isNull()), ("big", F.col("x") > 9), ("odd", F.col("id") % 2 == 1))
    assert rows(r.first_counts(df, "src")) == [("s", "missing", 1), ("s", "odd", 1), ("t", "big", 1)]
    assert rows(r.all_counts(df)) == [("big", 1), ("missing", 1), ("odd", 2)]
    kept, lost = r.split(df)
    assert kept.count() == 0 and lost.count() == 3


def test_stage_chain(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, "bad"), (1, 2, "late"), (2, 0, None), (3, 0, None), (3, 1, None), (3, 2, None)], "k int, o int, r string")
    assert rows(stage_chain(df, ["k"], "o", "r", 3)) == sorted([(1, 1, "bad", "rejected"), (2, None, None, "incomplete"), (3, None, None, "complete")], key=str)
    assert rows(reject_histogram(stage_chain(df, ["k"], "o", "r", 3))) == [("1:bad", 1), ("complete", 1), ("incomplete", 1)]


@pytest.mark.parametrize("seed", range(3))
def test_greedy_dedup_is_the_scan(spark, seed):
    rnd = random.Random(seed)
    data = [(i, rnd.choice([None, *"abcdefgh"]), rnd.choice([None, *"uvwxyz"])) for i in range(60)]
    seen: tuple[set, set] = (set(), set())
    want = {}
    for i, p, c in data:
        ok = not (p in seen[0] or c in seen[1])
        want[i] = ok
        if ok:
            seen[0].update({p} - {None})
            seen[1].update({c} - {None})
    rnd.shuffle(data)
    got = dedup.greedy(spark.createDataFrame(data, "i int, p string, c string"), "i", "i", ["p", "c"])
    assert {r["i"]: r["accepted"] for r in got.collect()} == want


def test_greedy_example_and_empty(spark):
    df = spark.createDataFrame([(1, "p1", "c1"), (2, "p1", "c2"), (3, "p2", "c2")], "i int, p string, c string")
    assert rows(dedup.greedy(df, "i", "i", ["p", "c"])) == [(1, True), (2, False), (3, True)]
    assert dedup.greedy(df.where("false"), "i", "i", ["p", "c"]).count() == 0


def test_selection_does_not_depend_on_partitions(spark):
    rnd = random.Random(5)
    data = [(i, rnd.choice("abc"), rnd.randint(0, 3)) for i in range(90)]
    a = spark.createDataFrame(data, "i int, g string, v int")
    b = a.repartition(7)
    for f in (
        lambda d: select.top_k(d, ["g"], [F.desc("v"), F.col("i")], 4),
        lambda d: select.round_robin(d, "g", select.hash_order("s", F.col("g")), [F.col("i")], 11),
        lambda d: select.hash_sample(d, "s", F.col("i"), 30),
        lambda d: select.best_and_worst(d, ["g"], ["v"], "i"),
    ):
        assert rows(f(a)) == rows(f(b))
    got = [r["g"] for r in select.round_robin(a, "g", F.col("g"), [F.col("i")], 6).collect()]
    assert sorted(got) == ["a", "a", "b", "b", "c", "c"]


def test_quota_fill_is_exclusive(spark):
    data = [(i, f"f{i % 5}", "x" if i % 2 else "y") for i in range(20)]
    got = rows(select.quota_fill(spark.createDataFrame(data, "i int, f string, c string"), "i", "f", [F.col("i")], [("one", F.col("c") == "x", 3), ("two", F.col("c") == "y", 9)]))
    assert [c for _, c in got].count("one") == 3 and [c for _, c in got].count("two") == 2
    assert len({i % 5 for i, _ in got}) == 5


def test_distances(spark):
    a = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("y", 2.0), ("y", 3.0)], "s string, v double")
    assert metrics.ks_distance(a, "v", "s", "x", "y").first()["ks"] == 0.5
    b = spark.createDataFrame([("x", "a"), ("x", "a"), ("y", "a"), ("y", "b")], "s string, l string")
    assert metrics.total_variation(b, "l", "s", "x", "y").first()["tv"] == 0.5
    assert metrics.ks_distance(a.where("s = 'x'"), "v", "s", "x", "y").first()["ks"] is None
    n = spark.createDataFrame([(50,), (0,), (None,)], "v int")
    assert [r[0] for r in n.select(metrics.binned(F.col("v"), [0, 50, 100])).collect()] == ["[50,100)", "[0,50)", None]
    with pytest.raises(Exception, match="out of bins"):
        spark.range(100, 101).select(metrics.binned(F.col("id"), [0, 50, 100])).collect()


def test_funnel(spark):
    ranks = {"parse": 1, "apply": 2, "build": 3, "public": 4, "hidden": 5, "regression": 7, "success": 8}
    df = spark.createDataFrame([("apply",), ("hidden",), ("regression",), ("success",)], "t string")
    got = metrics.funnel(df, F.col("t"), ranks, [("all", 0), ("parsed", 2), ("applied", 3), ("built", 4), ("public", 5), ("hidden", 7), ("all_passed", 8)]).orderBy("ord").collect()
    assert [r["n"] for r in got] == [4, 4, 3, 3, 3, 2, 1]
    with pytest.raises(Exception, match="unknown state"):
        metrics.funnel(spark.createDataFrame([("odd",)], "t string"), F.col("t"), ranks, [("all", 0)]).collect()


def test_suite_partition(spark):
    data = [(1, i, 5 <= i, True) for i in range(10)]
    got = metrics.test_partition(spark.createDataFrame(data, "c int, i int, f boolean, p boolean"), "c", [F.col("i")], F.col("f"), F.col("p"))
    by = {r["i"]: r["suite"] for r in got.collect()}
    assert [by[i] for i in range(10)] == ["regression"] * 5 + ["public"] + ["hidden"] * 4


def test_bootstrap(spark):
    data = [(i, i % 10 == 0, i % 10 == 0 or i % 25 == 3) for i in range(400)]
    df = spark.createDataFrame(data, "i int, a boolean, b boolean")
    one, two = (metrics.bootstrap(d, [], "a", "b", "i", 2000, seed=3).first() for d in (df, df.repartition(5)))
    assert tuple(one) == tuple(two)
    assert one["n"] == 400 and abs(one["observed"] - 0.04) < 1e-9
    assert 0.02 <= one["low"] <= 0.04 <= one["high"] <= 0.06


def test_gates(spark):
    row = spark.createDataFrame([(0.02, 1.0)], "gain double, valid double")
    checks = [("gain", gates.below(F.col("gain"), 0.02)), ("valid", gates.below(F.col("valid"), 0.999)), ("unknown", F.lit(None).cast("boolean"))]
    got = gates.gate(row, checks).first()
    assert got["reasons"] == ["unknown"] and not got["passed"]
    t = spark.createDataFrame([("a", 2), ("b", 1)], "k string, target long")
    rep = gates.minimums(spark.createDataFrame([("a", 3)], "k string, actual long"), t, "k")
    assert tuple(gates.all_met(rep).first()) == (False, 1)
    assert tuple(gates.all_met(rep.where("false")).first()) == (False, 0)


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(2, None), (3, "q"), (4, "n")], "k int, v string")
    assert rows(joins.row_differences(a, b, ["k"], ["v"])) == [(1, "missing"), (3, "changed"), (4, "extra")]
    assert tuple(joins.key_coverage(a, b, "k").first()) == (2, 1, 1)
    assert rows(joins.merge_caches(a, b, "k", "v").select("k", "conflict")) == [(1, False), (2, False), (3, True), (4, False)]
    got = joins.flagged(a, {"first": (b, "k", "k")}).select("k", "reason")
    assert rows(got.fillna("kept")) == [(1, "kept"), (2, "first"), (3, "first")]


def test_assertions(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 0), ("b", 5)], "c string, i int")
    assert rows(assertions.expect_indices(df, "c", "i", 2)) == [("b", 1, 1, 1)]
    assert rows(assertions.expect_unique(df, ["c", "i"])) == [("b", 0, 2)]
    assert assertions.expect_absent(df, ["i", "secret"]) == ["i"]


def test_fingerprints(spark):
    import hashlib

    df = spark.createDataFrame([("b",), ("a",), ("b",)], "x string")
    assert df.agg(metrics.fingerprint(F.col("x"))).first()[0] == hashlib.sha256(b"a\nb\n").hexdigest()
    assert df.where("false").agg(metrics.fingerprint(F.col("x"))).first()[0] == hashlib.sha256(b"").hexdigest()
    assert tuple(metrics.fingerprint_sums(df, "x").first()) == tuple(metrics.fingerprint_sums(df.repartition(3).distinct(), "x").first())


def test_alternate_takes_turns(spark):
    from loomwright.operators import nested

    data = [(1, "a", "r1"), (2, "a", "r2"), (3, "b", "r1"), (4, "b", "r3"), (5, "c", "r2"), (6, "c", "r4"), (7, "a", "r5")]
    df = spark.createDataFrame(data, "i int, s string, u string")
    got = [r["i"] for r in nested.alternate(df, "s", "u", "i", "i", 5).orderBy("place").collect()]
    assert got == [1, 4, 5, 7, 6]
    assert nested.alternate(df.where("false"), "s", "u", "i", "i", 5).count() == 0


def test_compact_and_accepted(spark):
    from loomwright.operators import nested

    df = spark.sql("select array(named_struct('status', 'pass', 'matched', true, 'timed_out', false), named_struct('status', 'tle', 'matched', null, 'timed_out', true)) as o")
    assert tuple(df.select(nested.compact(F.col("o"), ["pass", "re"])).first()[0]) == (2, 1, 1, 1, 0)
    rows_ = spark.createDataFrame([("x", "p", True), ("x", "h", True), ("y", "p", True), ("z", "p", True), ("z", "h", None)], "c string, s string, ok boolean")
    got = nested.accepted(rows_, "c", {"p": F.col("s") == "p", "h": F.col("s") == "h"}, F.col("ok"))
    assert sorted((r["c"], r["accepted"]) for r in got.collect()) == [("x", True), ("y", False), ("z", False)]
