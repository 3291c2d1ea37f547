"""Ordered rules over rows: the first that fails, all that fail, and how often each does."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RuleSet:
    """Named conditions, each true for a row that breaks the rule; null counts as not broken."""

    rules: tuple[tuple[str, Column], ...] = field(default_factory=tuple)

    @classmethod
    def of(cls, *rules: tuple[str, Column]) -> RuleSet:
        return cls(tuple(rules))

    def first_reason(self) -> Column:
        """The first broken rule's name; null for a row that keeps all. Rules after it aren't looked at."""
        out = F.lit(None).cast("string")
        for name, broken in reversed(self.rules):
            out = F.when(F.coalesce(broken, F.lit(False)), F.lit(name)).otherwise(out)
        return out

    def all_reasons(self) -> Column:
        """The names of all broken rules in their order."""
        return F.array_compact(F.array(*[F.when(F.coalesce(b, F.lit(False)), F.lit(n)) for n, b in self.rules]))

    def split(self, df: DataFrame, column: str = "reason") -> tuple[DataFrame, DataFrame]:
        """(kept, rejected with its first reason). Use it before a stage with Python functions, so that only rows
        that the cheap rules keep reach them."""
        marked = df.withColumn(column, self.first_reason())
        return marked.where(F.col(column).isNull()).drop(column), marked.where(F.col(column).isNotNull())

    def first_counts(self, df: DataFrame, *by: str) -> DataFrame:
        """(by..., reason, n): rejected rows under their first reason; kept rows aren't counted."""
        return df.withColumn("reason", self.first_reason()).where("reason is not null").groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n"))

    def all_counts(self, df: DataFrame, *by: str) -> DataFrame:
        """(by..., reason, n): rejected rows under each of their reasons."""
        return df.select(*by, F.explode(self.all_reasons()).alias("reason")).groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n"))


def stage_chain(stages: DataFrame, key: Sequence[str], order: str, reason: str, expected: int) -> DataFrame:
    """(key..., terminal_stage, terminal_reason, state) of chains of stages that stop at the first rejection.

    ``stages`` is long: one row per key and stage that ran, in ``order`` from 0, ``reason`` null if it passed. A
    rejection ends the chain whatever comes after it; a chain that passed all ``expected`` stages is complete, one
    with a stage missing is incomplete.
    """
    failed = F.when(F.col(reason).isNotNull(), F.struct(F.col(order).alias("o"), F.col(reason).alias("r")))
    seen = stages.groupBy(*key).agg(F.min(failed).alias("f"), F.count_distinct(order).alias("ran"))
    state = F.when(F.col("f").isNotNull(), "rejected").when(F.col("ran") >= expected, "complete").otherwise("incomplete")
    return seen.select(*key, F.col("f.o").alias("terminal_stage"), F.col("f.r").alias("terminal_reason"), state.alias("state"))


def reject_histogram(chains: DataFrame) -> DataFrame:
    """(label, n): ``stage:reason`` of the rejected chains, the other states under their own names."""
    label = F.when(F.col("state") == "rejected", F.concat_ws(":", F.col("terminal_stage").cast("string"), "terminal_reason")).otherwise(F.col("state"))
    return chains.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def violations(checks: dict[str, Column]) -> Column:
    """Codes of a row's broken constraints (conditions that must hold; null breaks them), in the order given."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in checks.items()]))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
