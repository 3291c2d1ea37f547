"""Filling containers of fixed capacity: bounded-space online best-fit.

A fixed number of bins is open; a bitset has one bit for each amount of free space that some open bin has, so the
tightest bin for an item is one shift and one lowest-bit away. If none fits, the fullest bin closes and a new one
opens. Items are spread over blocks of bounded size by a hash, and the blocks are filled independently, so the loss
is at most the open bins of each block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.session import staged

OPEN_BINS = 256
BLOCK_BINS = 8192


def best_fit(sizes: Iterable[int], capacity: int, open_bins: int = OPEN_BINS) -> Iterator[int]:
    """The bin number of each item in turn (0, 1, ...); sizes lie between 1 and the capacity."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits = opened = bins = 0
    for size in sizes:
        fitting = bits >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            mine = free[space].pop()
            if not free[space]:
                bits ^= 1 << space
            opened -= 1
        else:
            if opened == open_bins:
                fullest = (bits & -bits).bit_length() - 1
                free[fullest].pop()
                if not free[fullest]:
                    bits ^= 1 << fullest
                opened -= 1
            mine, space = bins, capacity
            bins += 1
        yield mine
        space -= size
        if space:
            free[space].append(mine)
            bits |= 1 << space
            opened += 1


def fill_containers(items: DataFrame, key: str, size: str, capacity: int, open_bins: int = OPEN_BINS, block_bins: int = BLOCK_BINS) -> DataFrame:
    """Rows (key, piece_no from 1, piece_start, piece_size, container) of all items.

    An item over the capacity fills whole containers, and its rest is packed like an item; no other item is divided.
    An item of size 0 or null has one row of size 0 without container. Keys must be unique. The result depends on
    keys and sizes only: blocks and the order in them come from a hash of the key.
    """
    kind = items.schema[key].dataType.simpleString()
    sized = staged(items.select(F.col(key).alias("k"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("n")), "sizes")
    total = sized.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // (capacity * block_bins)))
    keyed = sized.where("n > 0").withColumn("h", F.xxhash64("k")).withColumn("block", F.pmod("h", F.lit(blocks)).cast("int"))

    def pack(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["h", "k"], kind="stable")
        n = block["n"].to_numpy()
        whole, rest = n // capacity, n % capacity
        at = iter(best_fit(rest[rest > 0].tolist(), capacity, open_bins))
        rows, extra = [], 0
        # full containers get numbers below zero here, as the last number of a shared one isn't known yet
        for k, w, r in zip(block["k"], whole.tolist(), rest.tolist(), strict=True):
            for p in range(w):
                extra += 1
                rows.append((k, p + 1, p * capacity, capacity, -extra))
            if r:
                rows.append((k, w + 1, w * capacity, r, next(at)))
        out = pd.DataFrame(rows, columns=["k", "piece_no", "piece_start", "piece_size", "no"])
        last = int(out["no"].max()) + 1 if len(out) else 0
        out["no"] = out["no"].where(out["no"] >= 0, max(last, 0) - 1 - out["no"])
        out["container"] = (int(block["block"].iloc[0]) << 40) + out.pop("no")
        return out

    filled = keyed.groupBy("block").applyInPandas(pack, f"k {kind}, piece_no int, piece_start long, piece_size long, container long")
    none = sized.where("n = 0").select("k", F.lit(1).alias("piece_no"), F.lit(0).cast("long").alias("piece_start"), F.lit(0).cast("long").alias("piece_size"), F.lit(None).cast("long").alias("container"))
    return filled.unionByName(none).withColumnRenamed("k", key)
