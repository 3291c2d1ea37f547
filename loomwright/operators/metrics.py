"""Summaries, distributions, paired comparisons and resampling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.keys import rate
from loomwright.operators.totals import join_nulls, with_running, with_totals


def sliced(df: DataFrame, levels: Sequence[str], counts: dict[str, Column], rates: Sequence[str] = ()) -> DataFrame:
    """Counts over all rows and per value of each level: (slice_by, slice, total, counts..., <x>_rate...).

    One scan and one shuffle of partial counts (grouping sets), however many levels there are.
    """
    base = df.select(*[F.col(x).cast("string").alias(f"_l{i}") for i, x in enumerate(levels)], *[F.when(F.coalesce(c, F.lit(False)), 1).alias(k) for k, c in counts.items()])
    names = [f"_l{i}" for i in range(len(levels))]
    sets = [[], *[[F.col(n)] for n in names]]
    gid = F.grouping_id(*names).alias("_g")
    out = base.groupingSets(sets, *names).agg(F.count(F.lit(1)).alias("total"), *[F.count(k).alias(k) for k in counts], gid)
    full = (1 << len(names)) - 1
    by, value = F.lit("all"), F.lit("all")
    for i, n in enumerate(names):
        mine = F.col("_g") == full - (1 << (len(names) - 1 - i))
        by, value = F.when(mine, levels[i]).otherwise(by), F.when(mine, F.col(n)).otherwise(value)
    return out.select(by.alias("slice_by"), value.alias("slice"), "total", *counts, *[rate(F.col(k), F.col("total")).alias(f"{k}_rate") for k in rates])


def funnel(df: DataFrame, terminal: Column, ranks: dict[str, int], stages: Sequence[tuple[str, int]]) -> DataFrame:
    """(stage, n, share): rows whose terminal state ranks at least the stage's threshold; an unknown state is an error."""
    rank = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    known = F.coalesce(F.element_at(rank, terminal), F.raise_error(F.concat(F.lit("unknown state: "), F.coalesce(terminal, F.lit("null")))).cast("int"))
    one = df.select(known.alias("r")).agg(F.count("r").alias("total"), *[F.count_if(F.col("r") >= t).alias(f"s{i}") for i, (_, t) in enumerate(stages)])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(s).alias("stage"), F.col(f"s{i}").alias("n")) for i, (s, _) in enumerate(stages)]))
    return one.select("total", rows.alias("x")).select("x.ord", "x.stage", "x.n", rate(F.col("x.n"), F.col("total")).alias("share"))


def numeric_summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """count, min, p25, median, p75, max, mean; quantiles are interpolated linearly.

    Values are counted first, and a quantile is read off the running counts at the two places around it, so no group's
    values are held together. A group without values has a count of 0 and nulls.
    """
    plain = df.groupBy(*by).agg(F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    upto = with_totals(with_running(counts, by, ["_v"], {"_u": "_c"}), by, {"_n": F.sum("_c")})
    fractions = {"p25": 0.25, "median": 0.5, "p75": 0.75}
    found = []
    for name, f in fractions.items():
        place = (F.col("_n") - 1) * F.lit(f)
        for end, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            found.append(F.max(F.when((at < F.col("_u")) & (at >= F.col("_u") - F.col("_c")), F.col("_v").cast("double"))).alias(f"_{name}_{end}"))
    ends = upto.groupBy(*by).agg(*found)
    out = join_nulls(plain, ends, by, "left")
    between = lambda name, f: F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * (((F.col("count") - 1) * F.lit(f)) % 1)
    return out.select(*by, "count", "min", *[between(n, f).alias(n) for n, f in fractions.items()], "max", "mean")


def floor_percentile(df: DataFrame, value: str, fractions: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., fraction, value): of the sorted values the one at index int((n - 1) * fraction), no interpolation.

    Values are counted first and their running counts compared, so a group's rows aren't collected.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    upto = with_totals(with_running(counts, by, [value], {"_u": "_c"}), by, {"_n": F.sum("_c")})
    asked = upto.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    at = F.floor((F.col("_n") - 1) * F.col("fraction"))
    return asked.where((at < F.col("_u")) & (at >= F.col("_u") - F.col("_c"))).select(*by, "fraction", F.col(value).alias("value"))


def ks_distance(df: DataFrame, value: str, sample: str, first: str, second: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., ks): the greatest distance of two samples' distribution functions; null if a sample is empty."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count_if(F.col(sample) == first).alias("_a"), F.count_if(F.col(sample) == second).alias("_b"))
    run = with_totals(with_running(counts, by, [value], {"_ca": "_a", "_cb": "_b"}), by, {"_na": F.sum("_a"), "_nb": F.sum("_b")})
    gap = F.abs(F.try_divide("_ca", "_na") - F.try_divide("_cb", "_nb"))
    return run.groupBy(*by).agg(F.max(gap).alias("ks"))


def total_variation(df: DataFrame, label: str, sample: str, first: str, second: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., tv): half the sum of the differences of the labels' shares; a null label is a label."""
    counts = df.groupBy(*by, label).agg(F.count_if(F.col(sample) == first).alias("_a"), F.count_if(F.col(sample) == second).alias("_b"))
    run = with_totals(counts, by, {"_na": F.sum("_a"), "_nb": F.sum("_b")})
    return run.groupBy(*by).agg((F.sum(F.abs(F.try_divide("_a", "_na") - F.try_divide("_b", "_nb"))) / 2).alias("tv"))


def binned(value: Column, edges: Sequence[float]) -> Column:
    """``[a,b)`` of right-open bins; a value outside all of them is an error, null stays null."""
    name = lambda x: str(int(x)) if float(x).is_integer() else str(x)
    out = F.when(value.isNotNull(), F.raise_error(F.concat(F.lit("out of bins: "), value.cast("string"))).cast("string"))
    for a, b in reversed(list(zip(edges[:-1], edges[1:], strict=True))):
        out = F.when((value >= a) & (value < b), f"[{name(a)},{name(b)})").otherwise(out)
    return out


def group_success(df: DataFrame, dimensions: Sequence[str], success: Column) -> DataFrame:
    """(dimension, level, total, success, success_rate, share_of_successes) over several dimensions in one pass."""
    flat = df.select(F.when(F.coalesce(success, F.lit(False)), 1).alias("s"), F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("level")) for d in dimensions])).alias("d"))
    counts = flat.groupBy("d.dimension", "d.level").agg(F.count(F.lit(1)).alias("total"), F.count("s").alias("success"))
    counts = with_totals(counts, ["dimension"], {"_all": F.sum("success")})
    return counts.select("dimension", "level", "total", "success", rate(F.col("success"), F.col("total")).alias("success_rate"), rate(F.col("success"), F.col("_all")).alias("share_of_successes"))


def percentile_rank(df: DataFrame, value: str, key: Sequence[str]) -> DataFrame:
    """(key..., value, rank): the share of rows with at most the row's value.

    Taken over distinct values, whose running counts are few next to the rows, and joined back.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    run = with_totals(with_running(counts, [], [value], {"_u": "_c"}), [], {"_all": F.sum("_c")})
    ranks = run.select(value, (F.col("_u") / F.col("_all")).alias("rank"))
    return df.join(ranks, value).select(*key, value, "rank")


def transitions(before: DataFrame, after: DataFrame, key: str, state: str) -> DataFrame:
    """(transition, n): ``a->b`` over the keys of both runs; a key of one run only is ``absent`` in the other."""
    a = before.select(F.col(key), F.col(state).alias("a"))
    b = after.select(F.col(key), F.col(state).alias("b"))
    label = F.concat_ws("->", F.coalesce("a", F.lit("absent")), F.coalesce("b", F.lit("absent")))
    return a.join(b, key, "full").groupBy(label.alias("transition")).agg(F.count(F.lit(1)).alias("n"))


def membership_changes(before: DataFrame, after: DataFrame, key: str, flag: Column) -> DataFrame:
    """(key, change): ``introduced``, ``resolved`` or ``retained`` of the keys flagged before or after."""
    a = before.where(flag).select(F.col(key), F.lit(True).alias("a")).distinct()
    b = after.where(flag).select(F.col(key), F.lit(True).alias("b")).distinct()
    change = F.when(F.col("a").isNull(), "introduced").when(F.col("b").isNull(), "resolved").otherwise("retained")
    return a.join(b, key, "full").select(key, change.alias("change"))


def capacity_bound(df: DataFrame, part: str, group: str, per_row: int, caps: dict[str, int]) -> DataFrame:
    """(part, groups, rows, bound): the sum over groups of min(per_row * rows, the part's cap)."""
    cap = F.lit(0)
    for k, v in caps.items():
        cap = F.when(F.col(part) == k, v).otherwise(cap)
    counts = df.groupBy(part, group).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(part).agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows"), F.sum(F.least(F.col("n") * per_row, cap)).alias("bound"))


def test_partition(df: DataFrame, case: str, order: Sequence[Column], fails_before: Column, passes_after: Column) -> DataFrame:
    """Each row's suite: rows that pass on both sides are ``regression``; of the n that fail before and pass after the
    first min(n - 1, max(1, (n + 4) div 5)) in order are ``public`` if n >= 2, the rest ``hidden``; others are null."""
    target = fails_before & passes_after
    stable = ~fails_before & passes_after
    w = Window.partitionBy(case, target).orderBy(*order)
    n = F.count(F.lit(1)).over(Window.partitionBy(case, target))
    public = F.when(n >= 2, F.least(n - 1, F.greatest(F.lit(1), F.floor((n + 4) / 5)))).otherwise(0)
    suite = F.when(target, F.when(F.row_number().over(w) <= public, "public").otherwise("hidden")).when(stable, "regression")
    return df.withColumn("suite", suite)


def bootstrap(pairs: DataFrame, by: Sequence[str], before: str, after: str, order: str, resamples: int = 10_000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """(by..., n, observed, low, high): the mean difference of paired outcomes and its percentile interval.

    Pairs with the same difference are alike, so a slice comes to one task as counts per difference (a handful of
    rows), and each resample is one multinomial draw. Seeded per slice; the outcome doesn't depend on row order.
    """
    import numpy as np

    diff = (F.col(after).cast("double") - F.col(before).cast("double")).alias("_d")
    counts = pairs.select(*by, diff).where("_d is not null").groupBy(*by, "_d").agg(F.count(F.lit(1)).alias("_c"))
    tail = (1 - level) / 2

    def draw(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_d")
        d, c = part["_d"].to_numpy(), part["_c"].to_numpy()
        n = int(c.sum())
        name = "\x00".join(str(part[b].iloc[0]) for b in by)
        rng = np.random.Generator(np.random.PCG64([seed, *name.encode()]))
        means = rng.multinomial(n, c / n, size=resamples) @ d / n
        low, high = np.quantile(means, [tail, 1 - tail])
        row = {b: [part[b].iloc[0]] for b in by} | {"n": [n], "observed": [float(d @ c / n)], "low": [float(low)], "high": [float(high)]}
        return pd.DataFrame(row)

    kinds = ", ".join(f"{b} {pairs.schema[b].dataType.simpleString()}" for b in by)
    return counts.groupBy(*by).applyInPandas(draw, f"{kinds + ', ' if by else ''}n long, observed double, low double, high double")


def fingerprint(ids: Column) -> Column:
    """SHA-256 of the sorted distinct ids, each with LF after it; of none the hash of the empty text. As an aggregate it
    holds a group's set, so it is for groups of bounded size; ``set_fingerprint`` gives the same for any set."""
    s = F.array_sort(F.collect_set(ids))
    return F.sha2(F.when(F.size(s) > 0, F.concat(F.array_join(s, "\n"), F.lit("\n"))).otherwise(F.lit("")), 256)


def set_fingerprint(df: DataFrame, ident: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., hash): per group the SHA-256 of its sorted distinct ids, each with LF after it.

    The ids are made distinct in parts, sorted on disk where memory is short, and hashed as they stream by; nothing
    holds a set. A hash over all of a group is a chain, so a group is one task's stream of its distinct ids;
    ``fingerprint_sums`` is the one without such a chain. A group of null ids only has the hash of the empty text.
    """
    import hashlib

    names = [f"_b{i}" for i in range(len(by))]
    keyed = df.select(*[F.col(b).alias(n) for b, n in zip(by, names, strict=True)], F.col(ident).cast("string").alias("_i"))
    ids = keyed.distinct() if by else keyed.where("_i is not null").distinct()
    ids = ids.withColumn("_k", F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256) if by else F.lit(""))
    sorted_ids = (ids.repartition("_k") if by else ids.repartition(1)).sortWithinPartitions("_k", F.col("_i").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, hashlib.sha256()
        for batch in batches:
            for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key and key is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([h.hexdigest()])], names=["_k", "hash"])
                    h = hashlib.sha256()
                key = k
                if i is not None:
                    h.update(i.encode("utf-8", "surrogatepass") + b"\n")
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([h.hexdigest()])], names=["_k", "hash"])

    hashes = sorted_ids.select("_k", "_i").mapInArrow(run, "_k string, hash string")
    if not by:
        return hashes.agg(F.coalesce(F.max("hash"), F.sha2(F.lit(""), 256)).alias("hash"))
    return ids.select("_k", *names).distinct().join(hashes, "_k").select(*[F.col(n).alias(b) for b, n in zip(by, names, strict=True)], "hash")


def fingerprint_sums(df: DataFrame, ident: str) -> DataFrame:
    """(n, a, b, c, d): sums of the four words of the distinct ids' hashes. The same for equal sets, in any order;
    it aggregates in parts, where ``fingerprint`` has to hold the whole set."""
    h = F.sha2(F.col(ident).cast("string"), 256)
    words = [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)") for i in range(4)]
    one = df.select(ident).distinct().select(*[w.alias(x) for w, x in zip(words, "abcd", strict=True)])
    return one.agg(F.count("a").alias("n"), *[F.coalesce(F.sum(x), F.lit(0).cast("decimal(38,0)")).alias(x) for x in "abcd"])


def shift_report(df: DataFrame, sample: str, first: str, second: str, labels: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """(measure, column, value): the total variation of each label column and the KS distance of each number column.

    The columns are unpivoted, so all of one kind are measured in one pass.
    """
    pick = lambda cols, kind: df.select(F.col(sample).alias("_s"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("v")) for c in cols])).alias("x")).select("_s", "x.column", "x.v")
    out = total_variation(pick(labels, "string"), "v", "_s", first, second, ["column"]).select(F.lit("tv").alias("measure"), "column", F.col("tv").alias("value"))
    return out.unionByName(ks_distance(pick(numbers, "double"), "v", "_s", first, second, ["column"]).select(F.lit("ks").alias("measure"), "column", F.col("ks").alias("value")))


def counters(df: DataFrame, by: Sequence[str], flags: dict[str, Column]) -> DataFrame:
    """(by..., total, flags...): how many rows each condition holds for; one it is null for doesn't count."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()])
