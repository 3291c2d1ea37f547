"""Checks on relations. Each returns the violations (none: the check holds), and never raises."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expect_counts(df: DataFrame, by: Sequence[str], expected: DataFrame) -> DataFrame:
    """(by..., n, expected) where the number of rows differs; missing groups have 0 on their side."""
    have = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    j = have.join(expected.select(*by, "expected"), list(by), "full")
    return j.select(*by, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("expected", F.lit(0)).alias("expected")).where("n <> expected")


def expect_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def expect_indices(df: DataFrame, case: str, index: str, size: int) -> DataFrame:
    """(case, missing, extra, repeated) of the cases whose indices aren't exactly 0 .. size-1."""
    want = F.sequence(F.lit(0), F.lit(size - 1))
    one = df.select(case, F.col(index).cast("int").alias("_i")).groupBy(case, "_i").agg(F.count(F.lit(1)).alias("_c"))
    inside = F.col("_i").between(0, size - 1)
    g = one.groupBy(case).agg(F.count_if(inside).alias("have"), F.count_if(~F.coalesce(inside, F.lit(False))).alias("extra"), F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("repeated"))
    return g.select(case, (F.size(want) - F.col("have")).alias("missing"), "extra", "repeated").where("missing > 0 or extra > 0 or repeated > 0")


def expect_hash(df: DataFrame, key: Sequence[str], text: Column, stored: Column) -> DataFrame:
    """Keys whose stored hash isn't the text's (null texts have none)."""
    return df.where(~F.sha2(text, 256).eqNullSafe(stored)).select(*key)


def expect_disjoint(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys in both relations: leakage."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_semi")


def expect_one_value(df: DataFrame, group: str, value: str, cap: int | None = None) -> DataFrame:
    """(group, values, n) of the groups with more than one value, or with more rows than the cap."""
    g = df.groupBy(group).agg(F.count_distinct(value).alias("values"), F.count(F.lit(1)).alias("n"))
    return g.where((F.col("values") > 1) | (F.lit(cap is not None) & (F.col("n") > (cap or 0))))


def expect_same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, rows...) of the rows that one relation has more often than the other."""
    a = left.exceptAll(right).withColumn("side", F.lit("left"))
    return a.unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def expect_order(df: DataFrame, order: str, key: str, other: DataFrame) -> DataFrame:
    """(order, left, right) where two sequences, each with its order column, differ."""
    j = df.select(order, F.col(key).alias("left")).join(other.select(order, F.col(key).alias("right")), order, "full")
    return j.where(~F.col("left").eqNullSafe(F.col("right")))


def expect_absent(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Forbidden columns that a projection has."""
    return sorted(set(columns) & set(df.columns))
