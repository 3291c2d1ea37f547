"""Records with nested outcomes: compacted, re-partitioned, compared."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compact(outcomes: Column, statuses: Sequence[str]) -> Column:
    """(total, matched, timeouts, one count per status) of an array of outcomes (status, matched, timed_out)."""
    n = lambda f: F.size(F.filter(outcomes, f)).cast("int")
    return F.struct(
        F.size(outcomes).alias("total"),
        n(lambda o: F.coalesce(o["matched"], F.lit(False))).alias("matched"),
        n(lambda o: F.coalesce(o["timed_out"], F.lit(False))).alias("timeouts"),
        *[n(_has_status(s)).alias(f"status_{s}") for s in statuses],
    )


def _has_status(status: str):
    return lambda o: o["status"] == status


def stable_projection(outcomes: Column, drop: Sequence[str], key: str) -> Column:
    """Outcomes without the fields that vary from run to run, ordered by their key as text, then by what they hold."""
    slim = F.transform(outcomes, lambda o: F.struct(o[key].cast("string").alias("_k"), o.dropFields(*drop).alias("o")))
    return F.transform(F.array_sort(slim), lambda x: x["o"])


def replay_differences(first: DataFrame, second: DataFrame, key: Sequence[str], ignore: Sequence[str]) -> DataFrame:
    """(key..., status) of outcomes that aren't the same in two runs, times and the like aside."""
    from loomwright.operators.joins import row_differences

    columns = [c for c in first.columns if c not in key and c not in ignore]
    return row_differences(first, second, key, columns)


def accepted(df: DataFrame, case: str, suites: dict[str, Column], ok: Column) -> DataFrame:
    """(case, one flag per suite, accepted): a suite holds if it has rows and all of them are ok."""
    flags = [(F.count_if(cond) > 0) & (F.count_if(cond & ~F.coalesce(ok, F.lit(False))) == 0) for cond in suites.values()]
    out = df.groupBy(case).agg(*[f.alias(n) for f, n in zip(flags, suites, strict=True)])
    all_of = F.lit(True)
    for n in suites:
        all_of = all_of & F.col(n)
    return out.withColumn("accepted", all_of)


def score_deltas(before: DataFrame, after: DataFrame, key: str, flags: Sequence[str]) -> DataFrame:
    """(flag, before, after, delta, changed) over the keys of both editions of a score."""
    b = before.select(key, *[F.col(f).cast("int").alias(f"b_{f}") for f in flags])
    a = after.select(key, *[F.col(f).cast("int").alias(f"a_{f}") for f in flags])
    j = b.join(a, key)
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f"b_{f}").alias("b"), F.col(f"a_{f}").alias("a")) for f in flags]))
    x = j.select(rows.alias("x")).select("x.*").groupBy("flag").agg(F.sum("b").alias("before"), F.sum("a").alias("after"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))
    return x.select("flag", "before", "after", (F.col("after") - F.col("before")).alias("delta"), "changed")


def comparable(runs: DataFrame, run: str, fields: Sequence[str]) -> DataFrame:
    """(field, values, same) over the manifests of several runs: fields that must be equal for a comparison."""
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields]))
    g = runs.select(rows.alias("x")).select("x.*").groupBy("field").agg((F.count_distinct("v") + F.max(F.col("v").isNull().cast("int"))).alias("values"))
    return g.select("field", "values", (F.col("values") == 1).alias("same"))


def alternate(df: DataFrame, stratum: str, unique: str, ident: str, order: str, target: int) -> DataFrame:
    """(ident, place from 0): strata in turn give their next row whose ``unique`` value no earlier pick has.

    A pick can be blocked by at most ``target`` earlier ones, so target + 1 rows with different values of each
    stratum are enough; only those come to the one task that takes turns. Strata go round in the order of their names.
    """
    one = df.withColumn("_u", F.row_number().over(Window.partitionBy(stratum, unique).orderBy(order, ident))).where("_u = 1")
    pool = one.withColumn("_n", F.row_number().over(Window.partitionBy(stratum).orderBy(order, ident))).where(F.col("_n") <= target + 1)

    def turns(rows: pd.DataFrame) -> pd.DataFrame:
        queues = [g.sort_values("_n")[["i", "u"]].values.tolist() for _, g in sorted(rows.groupby("s"), key=lambda x: x[0])]
        taken, out, at, idle = set(), [], 0, 0
        while len(out) < target and idle < len(queues):
            q = queues[at % len(queues)]
            at += 1
            while q and q[0][1] in taken:
                q.pop(0)
            if not q:
                idle += 1
                continue
            idle = 0
            i, u = q.pop(0)
            taken.add(u)
            out.append(i)
        return pd.DataFrame({"i": out, "place": range(len(out))}).astype({"i": rows["i"].dtype, "place": "int32"})

    kind = df.schema[ident].dataType.simpleString()
    slim = pool.select(F.lit(1).alias("one"), F.col(stratum).alias("s"), F.col(unique).alias("u"), F.col(ident).alias("i"), "_n")
    return slim.groupBy("one").applyInPandas(turns, f"i {kind}, place int").withColumnRenamed("i", ident)


def first_of_groups(df: DataFrame, group: str, order: Sequence[Column], most_groups: int) -> DataFrame:
    """The first row of each group, in order, until so many groups are reached: a capped search, without its loop."""
    first = df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_n = 1").drop("_n")
    return first.orderBy(*order).limit(most_groups)


def tags(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that a text matches, in their order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in patterns.items()]))


def prompt(parts: Sequence[tuple[str, Column]]) -> Column:
    """Titled sections one after the other; trailing line ends of each part are dropped, null parts are left out."""
    return F.concat_ws("\n\n", *[F.concat(F.lit(f"### {title}\n"), F.regexp_replace(c, "\n+$", "")) for title, c in parts])
