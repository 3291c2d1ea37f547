"""Splits that keep related records together.

Records are related through shared keys. The keys and the records' key pairs form a graph, whose components are
found by frontier breadth-first search from many seeds at once: adjacency lists are hash-partitioned, every node
that has no neighbour of lesser hash is a seed (so each component has one), and all frontiers advance together.
Where two searches meet, the seeds' labels are joined by an edge of a label graph, which has at most half as many
nodes and is solved the same way, or within one task where it is small. No node list, link or component comes to
the driver, only counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.session import staged, unstage


#: A label graph of at most so many edges (some 100 MB) is solved within one task; a larger one like the graph itself.
ONE_TASK_EDGES = 500_000


def _union_find(edges: pd.DataFrame) -> pd.DataFrame:
    """(label, component): each label with the least label that it hangs together with."""
    up: dict[str, str] = {}

    def top(x: str) -> str:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for u, v in zip(edges["u"], edges["v"], strict=True):
        a, b = sorted((top(u), top(v)))
        up[b] = a
    labels = list(up)
    return pd.DataFrame({"label": labels, "component": [top(x) for x in labels]})


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (u, v: strings, null-free); component is the least of its seeds.

    The component's name doesn't depend on partitioning or row order. Loops and repeated edges do no harm.
    """
    both = edges.where("u <> v").select("u", "v").unionByName(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    adjacency = staged(both.withColumn("hu", F.xxhash64("u")).withColumn("hv", F.xxhash64("v")), "adjacency")
    alone = edges.where("u = v").select(F.col("u").alias("node")).distinct()
    if adjacency.isEmpty():
        return alone.select("node", F.col("node").alias("component"))

    # (hash, name) orders the nodes totally, so a component's least node is always a seed
    least = adjacency.groupBy("u").agg(F.min(F.struct("hv", "v")).alias("m"), F.first("hu").alias("hu"))
    seeds = least.where((F.col("hu") < F.col("m.hv")) | ((F.col("hu") == F.col("m.hv")) & (F.col("u") < F.col("m.v"))))
    frontier = staged(seeds.select(F.col("u").alias("node"), F.col("u").alias("label")), "frontier")
    labelled, parts, meetings, rounds = frontier, [frontier], [], 0
    links = adjacency.select("u", "v")
    while True:
        arrived = frontier.join(links, frontier["node"] == links["u"]).select(F.col("v").alias("node"), "label").distinct()
        first = arrived.groupBy("node").agg(F.min("label").alias("lo"))
        have = labelled.select("node", F.col("label").alias("old"))
        mine = first.join(have, "node", "left").select("node", F.coalesce("old", "lo").alias("mine"), F.col("old").isNull().alias("fresh"))
        step = staged(arrived.join(mine, "node"), "step")
        parts.append(step)
        # where another search's label comes to a node, the two labels meet
        meetings.append(step.where("label <> mine").select(F.least("label", "mine").alias("u"), F.greatest("label", "mine").alias("v")))
        frontier = step.where("fresh and label = mine").select("node", "label")
        if frontier.isEmpty():
            break
        labelled, rounds = labelled.unionByName(frontier), rounds + 1
        if rounds % 8 == 0:
            # one table again, so that a round's plan doesn't grow with the rounds before it
            labelled = staged(labelled, "labelled")
            parts.append(labelled)
    small = meetings[0]
    for m in meetings[1:]:
        small = small.unionByName(m)
    small = staged(small.distinct(), "labels")
    met = small.count()
    if not met:
        named = labelled.select("node", F.col("label").alias("component"))
    else:
        if met <= ONE_TASK_EDGES:
            upper = small.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(_union_find, "label string, component string")
        else:
            found = components(small)
            least = found.groupBy("component").agg(F.min("node").alias("least"))
            upper = found.join(least, "component").select(F.col("node").alias("label"), F.col("least").alias("component"))
        named = labelled.join(upper, "label", "left").select("node", F.coalesce("component", "label").alias("component"))
    named = staged(named, "components")
    for done in [*parts, small, adjacency]:
        unstage(done)
    return named.unionByName(alone.join(named, "node", "left_anti").select("node", F.col("node").alias("component")))


def canonical_repository(c: Column) -> Column:
    """``host/owner/repo``: trimmed, lower case, without http scheme, scp form, ``.git`` and outer slashes; else null.

    This is the form by which the tables say when two spellings are one repository. The core's function of this name
    reads more (other schemes, user names, deeper paths), which would make repositories here of values that name none.
    """
    x = F.lower(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")))
    x = F.regexp_replace(x, r"^https?://", "")
    x = F.regexp_replace(x, r"^git@([^:/]+):", "$1/")
    x = F.regexp_replace(x, r"^/+|/+$", "")
    x = F.regexp_replace(F.regexp_replace(x, r"\.git$", ""), r"/+$", "")
    return F.when(x.rlike(r"^[^/\s]+/[^/\s]+/[^/\s]+$"), x)


#: Words that stand for "no value" in a key column, compared trimmed and in lower case.
PLACEHOLDERS = ("", "-", "--", "?", "n/a", "na", "nan", "nil", "none", "null", "placeholder", "tbd", "todo", "unassigned", "undefined", "unknown", "unset", "missing")


def problem_key(c: Column) -> Column:
    x = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(~x.isin(*PLACEHOLDERS), x)


def related_sets(df: DataFrame, key: str, keys: dict[str, Column]) -> DataFrame:
    """(id, component) for each record; records with a common key value are together, directly or over others.

    A null key value relates nothing. A record without any key is a set of its own.
    """
    names = list(keys)
    # concat gives null for a null key, without a second look at it
    tagged = df.select(F.col(key).alias("id"), *[F.concat(F.lit(f"{n}:"), c).alias(f"key_{i}") for i, (n, c) in enumerate(keys.items())])
    # read three times below, so that the keys' patterns run once a row
    tagged = staged(tagged, "keys")
    cols = [f"key_{i}" for i in range(len(names))]
    first = F.coalesce(*cols)
    pairs = None
    for c in cols:
        p = tagged.where(F.col(c).isNotNull()).select(first.alias("u"), F.col(c).alias("v"))
        pairs = p if pairs is None else pairs.unionByName(p)
    comp = components(pairs.distinct()).select(F.col("node").alias("first"), "component")
    keyed = tagged.select("id", first.alias("first"))
    return keyed.join(comp, "first", "left").select("id", F.coalesce("component", F.concat(F.lit("row:"), F.col("id").cast("string"))).alias("component"))


#: Hash orders that are compared, and ranges of a hash order that totals are taken over (both bound what is collected).
ORDERS, RANGES = 16, 4096


def assign_splits(sets: DataFrame, shares: list[tuple[str, float]]) -> DataFrame:
    """(component, split): whole components, in the order of their hash, cut where the splits' shares are reached.

    A component goes to the split that the middle of its rows falls in, so each cut is off by half a component at
    most. Of a fixed number of hash orders the one is taken whose cuts come nearest to the shares, judged by totals
    over hash ranges; that alone reaches the driver. The rule is the same for components of any size. The running
    total is taken over the ranges first and then within each, so no task sees all components.
    """
    spark = sets.sparkSession
    sizes = staged(sets.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "sizes")
    step = RANGES.bit_length() - 1
    place = lambda order: F.xxhash64(F.lit("split"), order, "component")
    each = sizes.select("component", "n", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))).alias("o"))
    totals = np.zeros((ORDERS, RANGES), np.int64)
    for r in each.groupBy("o", F.shiftright(place(F.col("o")), 64 - step).alias("r")).agg(F.sum("n").alias("n")).collect():
        totals[r["o"], r["r"] + RANGES // 2] = r["n"]
    total = int(totals[0].sum()) or 1
    upto = np.cumsum([share for _, share in shares])
    upto = upto / (upto[-1] or 1)
    middles = (np.cumsum(totals, axis=1) - totals / 2) / total
    which = np.minimum(np.searchsorted(upto, middles, side="right"), len(shares) - 1)
    got = np.stack([(totals * (which == k)).sum(axis=1) / total for k in range(len(shares))], axis=1)
    order = int(np.abs(got - np.diff(upto, prepend=0)).sum(axis=1).argmin())
    before = np.cumsum(totals[order]) - totals[order]
    base = spark.createDataFrame([(k - RANGES // 2, int(b)) for k, b in enumerate(before)], "r int, base long")
    ranged = sizes.withColumn("h", place(F.lit(order))).withColumn("r", F.shiftright("h", 64 - step).cast("int"))
    w = Window.partitionBy("r").orderBy("h", "component")
    middle = (F.col("base") + F.sum("n").over(w) - F.col("n") / 2) / F.lit(float(total))
    split = F.lit(shares[-1][0])
    for (s, _), b in reversed(list(zip(shares[:-1], upto[:-1], strict=True))):
        split = F.when(middle < float(b), s).otherwise(split)
    return ranged.join(F.broadcast(base), "r").select("component", split.alias("split"))
