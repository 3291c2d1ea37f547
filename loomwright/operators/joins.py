"""Joins that say what they lost: complete, flagged, reconciling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key..., n) of the keys that occur more than once."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def key_coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(both, only_left, only_right): how far a join on the key is complete on both sides."""
    a = left.select(key, F.lit(1).alias("_a")).distinct()
    b = right.select(key, F.lit(1).alias("_b")).distinct()
    j = a.join(b, key, "full")
    return j.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"), F.count_if(F.col("_b").isNull()).alias("only_left"), F.count_if(F.col("_a").isNull()).alias("only_right"))


def flagged(df: DataFrame, others: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """``df`` with ``reason``: the first of the named key sets that holds the row (name -> (set, its key, df's key)).

    An anti-join drops rows silently; this keeps them under their reason, so that they can be counted.
    """
    reason = F.lit(None).cast("string")
    out = df
    for name, (keys, theirs, mine) in others.items():
        marks = keys.select(F.col(theirs).alias(f"_k_{name}")).distinct().withColumn(f"_in_{name}", F.lit(True))
        out = out.join(marks, F.col(mine) == F.col(f"_k_{name}"), "left").drop(f"_k_{name}")
        reason = F.coalesce(reason, F.when(F.col(f"_in_{name}"), name))
    return out.withColumn("reason", reason).drop(*[f"_in_{n}" for n in others])


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: object) -> DataFrame:
    """Left lookup of a unique key with a default where it is missing."""
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def row_differences(left: DataFrame, right: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(key..., status): ``missing``, ``extra`` or ``changed``; equal rows give none. Nulls are equal to nulls."""
    a = left.select(*key, F.struct(*columns).alias("_a"), F.lit(1).alias("_ia"))
    b = right.select(*key, F.struct(*columns).alias("_b"), F.lit(1).alias("_ib"))
    status = F.when(F.col("_ib").isNull(), "missing").when(F.col("_ia").isNull(), "extra").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, list(key), "full").select(*key, status.alias("status")).where("status is not null")


def merge_caches(own: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, conflict): own value first; ``conflict`` where both have the key with different values."""
    a = own.select(key, F.col(value).alias("_a"), F.lit(1).alias("_ia"))
    b = other.select(key, F.col(value).alias("_b"), F.lit(1).alias("_ib"))
    both = F.col("_ia").isNotNull() & F.col("_ib").isNotNull()
    j = a.join(b, key, "full")
    return j.select(key, F.when(F.col("_ia").isNotNull(), F.col("_a")).otherwise(F.col("_b")).alias(value), (both & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("conflict"))


def pending(work: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Work not yet in the log of what is done."""
    return work.join(done.select(*key).distinct(), list(key), "left_anti")


def reconcile(named: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """(key, agree, present) over several key -> value maps that should be equal."""
    out: DataFrame | None = None
    for name, df in named.items():
        one = df.select(key, F.lit(name).alias("src"), F.col(value).cast("string").alias("v"))
        out = one if out is None else out.unionByName(one)
    n = len(named)
    g = out.groupBy(key).agg(F.count_distinct("src").alias("present"), F.count_distinct("v").alias("values"))
    return g.select(key, ((F.col("present") == n) & (F.col("values") <= 1)).alias("agree"), "present")


def denied_by(names: Column, tokens_of: Column, exact: Sequence[str], aliases: Sequence[str], tokens: Sequence[str]) -> Column:
    """Reason of the first list that matches a canonical name: ``exact``, ``alias`` (bare name is equal), ``token``."""
    from loomwright.functions.keys import bare_name

    last = bare_name(F.element_at(F.split(names, "/"), -1))
    hit_token = F.arrays_overlap(tokens_of, F.array(*[F.lit(t) for t in tokens])) if tokens else F.lit(False)
    return F.when(names.isin(*exact), "exact").when(last.isin(*aliases), "alias").when(hit_token, "token")


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    """Whether a text holds one of a fixed list of needles."""
    return F.exists(F.array(*[F.lit(n) for n in needles]), lambda n: text.contains(n))


def fetch_each_once(source: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of ``source`` whose key is wanted, (key, found) of the wanted keys that aren't there exactly once)."""
    ids = wanted.select(key).distinct()
    got = source.join(ids, key, "left_semi")
    counts = ids.join(source.groupBy(key).agg(F.count(F.lit(1)).alias("found")), key, "left")
    return got, counts.select(key, F.coalesce("found", F.lit(0)).alias("found")).where("found <> 1")


def consistent(base: DataFrame, parts: dict[str, tuple[DataFrame, Sequence[str]]], key: str) -> DataFrame:
    """(key, problems) of the rows of ``base`` joined with several tables by key: sorted ``<part>:missing``, and
    ``<part>:<field>`` where a field that both have differs (null equals null). Keys are unique in each part."""
    out, problems = base, []
    for name, (part, fields) in parts.items():
        out = out.join(part.select(F.col(key), F.lit(True).alias(f"_{name}"), *[F.col(f).alias(f"_{name}_{f}") for f in fields]), key, "left")
        problems.append(F.when(F.col(f"_{name}").isNull(), F.lit(f"{name}:missing")))
        problems += [F.when(F.col(f"_{name}").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"_{name}_{f}")), F.lit(f"{name}:{f}")) for f in fields]
    return out.select(key, F.array_sort(F.array_compact(F.array(*problems))).alias("problems"))


def unexpected(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, status) of what a folder's listing and the entries expected in it don't have in common: ``missing`` or ``unexpected``."""
    a, b = expected.select(key).distinct().withColumn("_e", F.lit(True)), found.select(key).distinct().withColumn("_f", F.lit(True))
    return a.join(b, key, "full").where("_e is null or _f is null").select(key, F.when(F.col("_f").isNull(), "missing").otherwise("unexpected").alias("status"))
