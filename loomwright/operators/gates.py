"""Threshold gates: rows of reasons, never an exception, so that a report holds all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.operators.totals import with_totals

SLACK = 1e-12


def minimums(actual: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """(key, actual, target, met) for each target; a key without an actual value has 0."""
    j = targets.select(key, "target").join(actual.select(key, "actual"), key, "left")
    return j.select(key, F.coalesce("actual", F.lit(0)).alias("actual"), "target", (F.coalesce("actual", F.lit(0)) >= F.col("target")).alias("met"))


def all_met(report: DataFrame) -> DataFrame:
    """One row (met, failed): all targets met at once; nothing to meet isn't met."""
    return report.agg((F.count(F.lit(1)) > 0).alias("any"), F.coalesce(F.bool_and("met"), F.lit(False)).alias("ok"), F.count_if(~F.col("met")).alias("failed")).select((F.col("any") & F.col("ok")).alias("met"), "failed")


def gate(row: DataFrame, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """``row`` (one) with ``passed`` and its sorted, distinct ``reasons`` (of conditions that veto)."""
    reasons = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(n)) for n, bad in checks]))))
    return row.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


def below(value: Column, limit: float) -> Column:
    """Under a lower limit, with slack, so that a value exactly on it passes."""
    return value < F.lit(limit) - SLACK


def above(value: Column, limit: float) -> Column:
    return value > F.lit(limit) + SLACK


def reachable(rows: DataFrame, part: str, group: str, qualified: Column, remaining: Column, least_rows: int, least_groups: int) -> DataFrame:
    """(part, reachable, best_rows, best_groups): whether the minimums could still be met if all that remains qualified."""
    could = qualified | remaining
    g = rows.groupBy(part).agg(F.count_if(could).alias("best_rows"), F.count_distinct(F.when(could, F.col(group))).alias("best_groups"))
    return g.select(part, ((F.col("best_rows") >= least_rows) & (F.col("best_groups") >= least_groups)).alias("reachable"), "best_rows", "best_groups")


def share_limits(df: DataFrame, group: str, most: float) -> DataFrame:
    """(group, n, share, over): groups' shares of all rows against a limit."""
    counts = with_totals(df.groupBy(group).agg(F.count(F.lit(1)).alias("n")), [], {"_all": F.sum("n")})
    share = F.col("n") / F.col("_all")
    return counts.select(group, "n", share.alias("share"), above(share, most).alias("over"))


def comparison_gate(pairs: DataFrame, slices: dict[str, Column], denominators: dict[str, int], primary: str, least_gain: float, least_low: float, drops: dict[str, float], rises: dict[str, float], valid: Column, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """One row (passed, reasons, n..., gain, low, high): whether a second run of the same cases may take the first's place.

    ``pairs`` has a row per case with booleans ``<x>_before`` and ``<x>_after`` for ``success`` and each rate of ``drops``
    (may fall by at most so much) and ``rises`` (may rise by at most so much). ``slices`` are conditions whose number of
    cases must be as in ``denominators``; in the primary slice success must gain ``least_gain`` and the paired bootstrap's
    interval begin at ``least_low`` or above; in the others it is bounded by ``drops`` under the slice's name. A case that
    isn't ``valid`` vetoes. Limits have a slack of 1e-12. Everything but the interval is one aggregation.
    """
    from loomwright.operators.metrics import bootstrap

    one = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    delta = lambda c, where: F.sum(F.when(where, one(F.col(f"{c}_after")) - one(F.col(f"{c}_before")))) / F.count_if(where)
    every = F.lit(True)
    aggs = [F.count_if(c).alias(f"n_{n}") for n, c in slices.items()] + [F.count_if(~F.coalesce(valid, F.lit(False))).alias("invalid")]
    aggs += [delta("success", c).alias(f"d_{n}") for n, c in slices.items()] + [delta(r, every).alias(f"d_{r}") for r in [*drops, *rises] if r not in slices]
    row = pairs.agg(*aggs)
    interval = bootstrap(pairs.where(slices[primary]).select(one(F.col("success_before")).alias("b"), one(F.col("success_after")).alias("a"), F.lit(primary).alias("slice")), ["slice"], "b", "a", "a", resamples, seed)
    row = row.withColumn("slice", F.lit(primary)).join(interval.select("slice", "low", "high"), "slice", "left").drop("slice")
    checks = [(f"{n}_denominator", F.col(f"n_{n}") != k) for n, k in denominators.items()]
    checks += [("validity", F.col("invalid") > 0), ("interval_missing", F.col("low").isNull()), ("gain", F.coalesce(below(F.col(f"d_{primary}"), least_gain), F.lit(False))), ("interval", F.coalesce(below(F.col("low"), least_low), F.lit(False)))]
    checks += [(f"{n}_fell", F.coalesce(below(F.col(f"d_{n}"), -most), F.lit(False))) for n, most in drops.items()]
    checks += [(f"{n}_rose", F.coalesce(above(F.col(f"d_{n}"), most), F.lit(False))) for n, most in rises.items()]
    return gate(row, checks).select("passed", "reasons", *[f"n_{n}" for n in slices], F.col(f"d_{primary}").alias("gain"), "low", "high", *[f"d_{n}" for n in [*drops, *rises]])


def supply(counts: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """(key, safe, usable, still_missing): what is there plus what may be added up to a cap, against a target.

    ``counts`` has key, safe, available; ``targets`` key, cap, target.
    """
    j = targets.join(counts, key, "left")
    usable = F.coalesce("safe", F.lit(0)) + F.least(F.coalesce("available", F.lit(0)), F.col("cap"))
    return j.select(key, F.coalesce("safe", F.lit(0)).alias("safe"), usable.alias("usable"), F.greatest(F.lit(0), F.col("target") - usable).alias("still_missing"))


def feasible(contract: DataFrame, key: str) -> DataFrame:
    """(key, reasons) of contract rows (groups, cap, total, least, most): whether they can be met at all."""
    checks = [("capacity", F.col("groups") * F.col("cap") < F.col("total")), ("order", F.col("least") > F.col("most")), ("negative", F.least("groups", "cap", "total", "least") < 0)]
    reasons = F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(n)) for n, bad in checks])))
    return contract.select(key, reasons.alias("reasons"))
