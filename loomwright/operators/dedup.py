"""Deduplication: exact, first eligible, merging, and greedy over several keys."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.operators.totals import join_nulls
from loomwright.session import staged, unstage


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column], flag: str | None = None) -> DataFrame:
    """The first row of each key in a total order; or all rows with a boolean column, if ``flag`` names one."""
    w = Window.partitionBy(*key).orderBy(*order)
    marked = df.withColumn("_n", F.row_number().over(w))
    if flag:
        return marked.withColumn(flag, F.col("_n") == 1).drop("_n")
    return marked.where("_n = 1").drop("_n")


def first_eligible(df: DataFrame, key: Sequence[str], order: Sequence[Column], reason: Column) -> DataFrame:
    """The first row of each key among those without a reason; rows with one don't claim the key."""
    return first_per_key(df.where(reason.isNull()), key, order)


def rejects_before_accepted(df: DataFrame, key: Sequence[str], order: Sequence[Column], reason: Column) -> DataFrame:
    """(reason, n) of the rows that a scan in order looks at before it accepts their key; later ones go unseen.

    The place of each key's first accepted row is a minimum, taken in parts and joined back; ``order`` are ascending
    values.
    """
    rows = df.select(*key, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("_o"), reason.alias("_r"))
    accepted = rows.groupBy(*key).agg(F.min(F.when(F.col("_r").isNull(), F.col("_o"))).alias("_first"))
    seen = join_nulls(rows.where("_r is not null"), accepted, list(key)).where("_first is null or _o < _first")
    return seen.groupBy(F.col("_r").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def merge_rows(df: DataFrame, key: Sequence[str], order: Column, keep: Sequence[str], union: Sequence[str]) -> DataFrame:
    """One row per key: ``keep`` of the first row in a total order, ``union`` (arrays) as sorted sets over all rows.

    Arrays are unnested first and counted once per key and value, so no group is gathered before it is distinct.
    """
    first = df.groupBy(*key).agg(F.min_by(F.struct(*keep), order).alias("_f")).select(*key, "_f.*")
    for c in union:
        values = df.select(*key, F.explode_outer(c).alias("_v")).distinct()
        first = first.join(values.groupBy(*key).agg(F.array_sort(F.collect_set("_v")).alias(c)), list(key), "left")
    return first


#: Open rows that one task can finish in order: some 100 bytes each. The result is the same as by further rounds.
FINISH_ROWS = 200_000


def greedy(df: DataFrame, ident: str, order: str, keys: Sequence[str]) -> DataFrame:
    """(ident, accepted) of every row: a row is accepted if no earlier accepted row shares any of its key values.

    That is a scan with a set of seen values per key, recorded only on acceptance. Rows whose values nobody else has are
    accepted at once. The others go in rounds: of the rows still open, those that are first for all their values are
    accepted, and those that share a value with an accepted row are rejected. What a bounded task can hold is finished
    there in order, so that a long chain of conflicts doesn't need as many rounds. The order must be total. A null key
    value is shared with none.
    """
    names = [f"k{n}" for n in range(len(keys))]
    rows = staged(df.select(F.col(ident).alias("i"), F.col(order).alias("o"), *[F.col(k).cast("string").alias(n) for n, k in zip(names, keys, strict=True)]), "open")
    done: list[DataFrame] = []
    form = T.StructType([T.StructField("i", rows.schema["i"].dataType), T.StructField("accepted", T.BooleanType())])

    def finish(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("o")
        seen: list[set] = [set() for _ in names]
        verdicts = []
        for values in part[names].itertuples(index=False, name=None):
            ok = not any(v is not None and v in s for v, s in zip(values, seen, strict=True))
            if ok:
                for v, s in zip(values, seen, strict=True):
                    s.add(v)
            verdicts.append(ok)
        return pd.DataFrame({"i": part["i"], "accepted": verdicts})

    while True:
        look, lead, free = rows, F.lit(True), F.lit(True)
        for k in names:
            # groupBy with a map-side minimum, so a hot value costs one row per task
            firsts = rows.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("o").alias(f"{k}_o"), F.count(F.lit(1)).alias(f"{k}_n"))
            look = look.join(firsts, k, "left")
            lead = lead & (F.col(f"{k}_o").isNull() | (F.col("o") == F.col(f"{k}_o")))
            free = free & (F.coalesce(F.col(f"{k}_n"), F.lit(1)) == 1)
        look = staged(look.withColumn("lead", lead).withColumn("free", free).select("i", "o", *names, "lead", "free"), "round")
        done.append(look.where("free").select("i", F.lit(True).alias("accepted")))
        open_rows = look.where("not free")
        left = open_rows.count()
        if left <= FINISH_ROWS:
            if left:
                done.append(open_rows.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(finish, form))
            break
        won, rest, lost = open_rows.where("lead"), open_rows.where("not lead"), F.lit(False)
        for k in names:
            taken = won.where(F.col(k).isNotNull()).select(k, F.lit(True).alias(f"{k}_t")).distinct()
            rest = rest.join(taken, k, "left")
            lost = lost | F.coalesce(F.col(f"{k}_t"), F.lit(False))
        rest = staged(rest.withColumn("lost", lost).select("i", "o", *names, "lost"), "rest")
        done += [won.select("i", F.lit(True).alias("accepted")), rest.where("lost").select("i", F.lit(False).alias("accepted"))]
        unstage(rows)
        rows = staged(rest.where("not lost").select("i", "o", *names), "open")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumnRenamed("i", ident)
