"""Assignment of groups to splits by hash, priority and earlier assignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.keys import bucket_json, bucket_nul


def by_bucket(bucket: Column, bounds: Sequence[tuple[str, int]], rest: str) -> Column:
    """The first split whose upper bound lies above the bucket; ``rest`` beyond all of them."""
    out = F.lit(rest)
    for name, upper in reversed(bounds):
        out = F.when(bucket < upper, name).otherwise(out)
    return out


def hash_split(seed: str, group: Column, bounds: Sequence[tuple[str, int]], rest: str) -> Column:
    return by_bucket(bucket_nul(seed, group), bounds, rest)


def hash_split_json(seed: int, group: Column, bounds: Sequence[tuple[str, int]], rest: str) -> Column:
    return by_bucket(bucket_json(seed, group), bounds, rest)


def prior_split(df: DataFrame, group: str, prior: DataFrame, upstream: Column, fallback: Column) -> DataFrame:
    """``split``: what the group had before, else what the row came with, else the hash's."""
    have = prior.select(F.col(group), F.col("split").alias("_prior")).distinct()
    return df.join(have, group, "left").withColumn("split", F.coalesce("_prior", upstream, fallback)).drop("_prior")
