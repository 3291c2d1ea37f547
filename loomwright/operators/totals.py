"""Totals and running totals without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.session import staged, unstage


def join_nulls(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join in which a null key is equal to a null key; with no key, ``right`` has one row."""
    names = {c: f"_r_{c}" for c in on}
    renamed = right.select(*[F.col(c).alias(names.get(c, c)) for c in right.columns])
    if not on:
        return left.withColumn("_one", F.lit(1)).join(renamed.withColumn("_one", F.lit(1)), "_one", how).drop("_one")
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(names[c]))
    return left.join(renamed, same, how).drop(*names.values())


def with_totals(df: DataFrame, by: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """``df`` with aggregates over its groups: aggregated in parts and joined back, not gathered in a window."""
    return join_nulls(df, df.groupBy(*by).agg(*[c.alias(n) for n, c in totals.items()]), by)


#: A group table of at most so many rows is summed in one sorted task, which costs less than cutting it into ranges.
ONE_TASK_ROWS = 200_000


def with_running(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """``df`` with running sums (name -> column) up to and with each row, in a total order within each group.

    Rows are range-partitioned by group and order; each partition sums its own, and the sums of the partitions before
    it (as many rows as there are partitions) are added. A table that is small, by its count, is summed as it is; the
    result is the same.
    """
    rows = staged(df, "rows")
    running = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if rows.count() <= ONE_TASK_ROWS:
        return rows.select(*df.columns, *[F.sum(c).over(running).alias(n) for n, c in sums.items()])
    parts = staged(rows.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    unstage(rows)
    own = parts.groupBy(*by, "_p").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = own.select(*by, "_p", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    w = Window.partitionBy("_p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = join_nulls(parts, base, [*by, "_p"])
    return full.select(*df.columns, *[(F.sum(c).over(w) + F.col(f"_b_{n}")).alias(n) for n, c in sums.items()])
