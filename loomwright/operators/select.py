"""Ranking, caps and sampling. Every order ends in a unique key, so that results don't depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.keys import nul_joined
from loomwright.operators.totals import join_nulls, with_running, with_totals
from loomwright.session import staged, unstage


def hash_order(seed: str, key: Column) -> Column:
    """A stable pseudo-random place: SHA-256 of seed NUL key."""
    return F.sha2(nul_joined(seed, key), 256)


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each group; the plan prunes to k rows per group and task before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    out = df.withColumn(rank or "_rank", F.row_number().over(w)).where(F.col(rank or "_rank") <= k)
    return out if rank else out.drop("_rank")


def capped(df: DataFrame, group: Sequence[str], order: Sequence[Column], cap: Column) -> tuple[DataFrame, DataFrame]:
    """(rows within their group's cap, (group..., n, overflow)); the cap may depend on the row's group.

    Rows are cut to the greatest cap first, which the plan can do in each task before groups are sorted.
    """
    capped_rows = df.withColumn("_cap", cap)
    counts = capped_rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.max("_cap").alias("_cap"))
    most = capped_rows.agg(F.max("_cap")).first()[0] or 0
    ranked = capped_rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rank") <= int(most))
    return ranked.where("_rank <= _cap").drop("_rank", "_cap"), counts.select(*group, "n", F.greatest(F.lit(0), F.col("n") - F.col("_cap")).cast("long").alias("overflow"))


def hash_sample(df: DataFrame, seed: str, key: Column, percent: int) -> DataFrame:
    """Rows whose hash bucket lies under ``percent``: the same rows in every run and partitioning."""
    from loomwright.functions.keys import bucket_nul

    return df.where(bucket_nul(seed, key) < percent)


def round_robin(df: DataFrame, group: str, group_order: Column, row_order: Sequence[Column], target: int, within: str | None = None) -> DataFrame:
    """The first ``target`` rows if groups, in their order, give one row each, then each their second, and so on.

    Rows are cut to ``target`` per group first, and a group's r-th row can only be taken if r rounds fit, so what
    the last, total ranking sees is bounded by target rows a group. ``within`` runs it in each of its values.
    """
    parts = [within] if within else []
    r = F.row_number().over(Window.partitionBy(*parts, group).orderBy(*row_order))
    ranked = df.withColumn("_r", r).where(F.col("_r") <= target).withColumn("_g", group_order)
    if not parts:
        # global order by sort and limit: each task keeps its first ``target`` rows
        return ranked.orderBy("_r", "_g", group, *row_order).limit(target).drop("_r", "_g")
    place = F.row_number().over(Window.partitionBy(*parts).orderBy("_r", "_g", group, *row_order))
    return ranked.withColumn("_p", place).where(F.col("_p") <= target).drop("_r", "_g", "_p")


def stratum_prefix(df: DataFrame, stratum: str, order: Sequence[Column], quotas: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """(the first rows of each stratum up to its quota, (stratum, wanted, missing) of the strata that fall short)."""
    spark = df.sparkSession
    q = spark.createDataFrame(sorted(quotas.items()), "stratum string, wanted long")
    w = Window.partitionBy(stratum).orderBy(*order)
    ranked = df.withColumn("_n", F.row_number().over(w)).join(q, F.col(stratum) == F.col("stratum"))
    picked = ranked.where("_n <= wanted").drop("_n", "wanted", "stratum") if stratum != "stratum" else ranked.where("_n <= wanted").drop("_n", "wanted")
    have = df.groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    short = q.join(have, "stratum", "left").select("stratum", "wanted", (F.col("wanted") - F.coalesce("n", F.lit(0))).alias("missing")).where("missing > 0")
    return picked, short


def quota_fill(df: DataFrame, ident: str, family: str, order: Sequence[Column], cells: Sequence[tuple[str, Column, int]]) -> DataFrame:
    """(ident, cell): cells are filled in turn, each with its first rows in order, one row per family over all cells.

    The loop is over the cells, of which there are few; each turn is a distributed selection.
    """
    picked: DataFrame | None = None
    pool = df
    for name, belongs, quota in cells:
        mine = pool.where(belongs)
        if picked is not None:
            mine = mine.join(picked.select(family).distinct(), family, "left_anti")
        one = mine.withColumn("_n", F.row_number().over(Window.partitionBy(family).orderBy(*order))).where("_n = 1").drop("_n")
        got = staged(one.orderBy(*order).limit(quota).select(ident, family, F.lit(name).alias("cell")), "cell")
        picked = got if picked is None else picked.unionByName(got)
    return picked.select(ident, "cell")


def cumulative_split(df: DataFrame, order: Sequence[Column], size: str, phases: Sequence[tuple[str, int, float]], rest: str) -> DataFrame:
    """Rows in order go to the first phase until it has its least number of rows and its least share of ``size``
    (rounded up), then to the next; what is left goes to ``rest``. A phase counts from where the one before ended.

    The rows are groups (projects, repositories), already aggregated, and ordered as one sequence.
    """
    named = df.select(*df.columns, *[o.alias(f"_o{i}") for i, o in enumerate(order)], F.lit(1).alias("_1"))
    out = with_running(named, [], [f"_o{i}" for i in range(len(order))], {"_i": "_1", "_s": size})
    out = with_totals(out.withColumn("_i", F.col("_i") - 1).withColumn("_s", F.col("_s") - F.col(size)), [], {"_t": F.sum(size), "_n": F.count(F.lit(1))})
    split, start = F.lit(rest), (F.lit(0), F.lit(0))
    inside = []
    for n, (name, least, share) in enumerate(phases):
        enough = (F.col("_i") - start[0] >= least) & (F.col("_s") - start[1] >= F.ceil(F.col("_t") * share - 1e-9))
        # one row decides where a phase ends; if none is enough, it goes to the end
        end = out.agg(F.min(F.when((F.col("_i") >= start[0]) & enough, F.struct("_i", "_s"))).alias(f"_e{n}"))
        out = join_nulls(out, end, [])
        at = F.coalesce(F.col(f"_e{n}._i"), F.col("_n"))
        start = (at, F.coalesce(F.col(f"_e{n}._s"), F.col("_t")))
        inside.append((name, F.col("_i") < at))
    for name, condition in reversed(inside):
        split = F.when(condition, name).otherwise(split)
    return out.select(*df.columns, split.alias("split"))


def best_and_worst(df: DataFrame, group: Sequence[str], rank: Sequence[str], index: str) -> DataFrame:
    """(group..., best_index, worst_index) by rank columns (more is better); ties take the least index at both ends.

    Groups whose best and worst rank the same have no pair.
    """
    hi = F.max(F.struct(*rank, (-F.col(index)).alias("i"))).alias("hi")
    lo = F.min(F.struct(*rank, F.col(index).alias("i"))).alias("lo")
    both = df.groupBy(*group).agg(hi, lo)
    apart = F.struct(*[F.col(f"hi.{r}") for r in rank]) != F.struct(*[F.col(f"lo.{r}") for r in rank])
    return both.where(apart).select(*group, (-F.col("hi.i")).alias("best_index"), F.col("lo.i").alias("worst_index"))


def winner(df: DataFrame, eligible: Column, order: Sequence[Column], fallback: Sequence[Column]) -> DataFrame:
    """One row: the first eligible one in ``order``; if there is none, the first of all in ``fallback``."""
    marked = df.withColumn("_e", F.coalesce(eligible, F.lit(False)))
    first = marked.where("_e").orderBy(*order).limit(1).withColumn("_w", F.lit(0))
    other = marked.orderBy(*fallback).limit(1).withColumn("_w", F.lit(1))
    return first.unionByName(other).orderBy("_w").limit(1).drop("_e", "_w")


def completed_prefix(df: DataFrame, group: Sequence[str], order: str, done: Column) -> DataFrame:
    """(group..., prefix, after_gap): rows before the first one not done, and done rows after it (there should be none)."""
    gap = df.groupBy(*group).agg(F.min(F.when(~F.coalesce(done, F.lit(False)), F.col(order))).alias("_gap"))
    marked = df.join(gap, list(group))
    before = F.col("_gap").isNull() | (F.col(order) < F.col("_gap"))
    return marked.groupBy(*group).agg(F.count_if(before).alias("prefix"), F.count_if(~before & done).alias("after_gap"))


def fill_cells(df: DataFrame, ident: str, order: str, payload: str, family: str, cells: Sequence[tuple[str, str, Column, int]], per_family: int) -> DataFrame:
    """(ident, split, cell): cells (split, name, condition, quota) are filled in turn, each by a scan of its rows in order.

    A row is passed over if its payload is taken already, its family is in another split, or its family has ``per_family``
    rows in this split. The scan runs in rounds: a row is sure once it is the first of its payload among the open rows and
    no more rows of its family stand before it than the family has room for; rows of a taken payload or a full family
    leave. What is accepted depends on earlier rows only, so the quota cuts the accepted rows in order. The order is total.
    """
    taken: DataFrame | None = None
    for split, name, belongs, quota in cells:
        rows = df.where(belongs).select(F.col(ident).alias("i"), F.col(order).alias("o"), F.col(payload).alias("p"), F.col(family).alias("f"))
        room = F.lit(per_family)
        if taken is not None:
            rows = rows.join(taken.select("p").distinct(), "p", "left_anti")
            rows = rows.join(taken.where(F.col("split") != split).select("f").distinct(), "f", "left_anti")
            rows = rows.join(taken.where(F.col("split") == split).groupBy("f").agg(F.count(F.lit(1)).cast("int").alias("had")), "f", "left")
            room = F.lit(per_family) - F.coalesce("had", F.lit(0))
        rows = staged(rows.withColumn("room", room.cast("int")).where("room > 0").select("i", "o", "p", "f", "room"), "open")
        sure: list[DataFrame] = []
        while not rows.isEmpty():
            # rows beyond the room of a family can wait: only its first ones are looked at, cut in each task
            near = rows.withColumn("rank", F.row_number().over(Window.partitionBy("f").orderBy("o"))).where(F.col("rank") <= per_family).where("rank <= room")
            first = rows.groupBy("p").agg(F.min("o").alias("first"))
            won = staged(near.join(first, "p").where("o = first").select("i", "o", "p", "f"), "won")
            sure.append(won)
            used = won.groupBy("f").agg(F.count(F.lit(1)).cast("int").alias("used"))
            left = rows.join(won.select("p").distinct(), "p", "left_anti").join(used, "f", "left").withColumn("room", F.col("room") - F.coalesce("used", F.lit(0)))
            done, rows = rows, staged(left.where("room > 0").select("i", "o", "p", "f", "room"), "open")
            unstage(done)
        if sure:
            won = sure[0]
            for x in sure[1:]:
                won = won.unionByName(x)
            got = staged(won.orderBy("o").limit(quota).select("i", "p", "f", F.lit(split).alias("split"), F.lit(name).alias("cell")), "cell")
            taken = got if taken is None else taken.unionByName(got)
    if taken is None:
        return df.where("false").select(F.col(ident), F.lit("").alias("split"), F.lit("").alias("cell"))
    return taken.select(F.col("i").alias(ident), "split", "cell")
