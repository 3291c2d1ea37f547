"""Tables of a bounded size over all rows: counters and bit maps, built in the tasks and merged in chunks.

What reaches the driver has the table's size whatever the corpus has, so broadcasting it is bounded. A bit map that
is too small for the corpus only lets more through; whoever uses one checks exactly afterwards. Every task that builds
a table sends it once, so the tables are built in a bounded number of tasks and merged in two steps: what is shuffled
depends on neither the rows nor the number of the scan's splits, and no task merges more than some dozens of chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from loomwright.llm import textvec as tv

CHUNK = 1 << 16
#: Most tasks that build a table (splits beyond are read one after another in them), and chunks merged at once.
TASKS, FAN_IN = 4096, 64
#: Least and greatest size of a bit map, as a power of two of bits: 128 KB and 128 MB.
LEAST_BITS, MOST_BITS = 20, 30


def map_bits(hashes: int) -> int:
    """Bits for a map of so many hashes: 16 to 32 of them a hash, within the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, (16 * hashes).bit_length()))


def _merge(how: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def merge(chunks: pd.DataFrame) -> pd.DataFrame:
        kind, add = (np.uint8, np.bitwise_or) if how == "or" else (np.int64, np.add)
        total = np.frombuffer(chunks["data"].iloc[0], kind).copy()
        for b in chunks["data"].iloc[1:]:
            add(total, np.frombuffer(b, kind), out=total)
        return pd.DataFrame({"no": [chunks["no"].iloc[0]], "part": [chunks["part"].iloc[0] // FAN_IN], "data": [total.tobytes()]})

    return merge


def merged(lists: DataFrame, size: int, kind: type, build: Callable[[Iterator[pa.RecordBatch]], np.ndarray], how: str) -> np.ndarray:
    """The table of ``size`` entries that ``build`` makes of each task's rows of ``lists``, merged by ``sum`` or ``or``."""
    step = min(CHUNK // np.dtype(kind).itemsize, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = build(batches)
        part = TaskContext.get().partitionId()
        for k in range(size // step):
            chunk = mine[k * step : (k + 1) * step]
            if chunk.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part // FAN_IN], pa.int32()), pa.array([chunk.tobytes()], pa.binary())], names=["no", "part", "data"])

    form = "no int, part int, data binary"
    rows = lists.coalesce(TASKS).mapInArrow(run, form).groupBy("no", "part").applyInPandas(_merge(how), form)
    rows = rows.groupBy("no").applyInPandas(_merge(how), form).collect()
    out = np.zeros(size, kind)
    for r in rows:
        out[r["no"] * step : (r["no"] + 1) * step] = np.frombuffer(bytes(r["data"]), kind)
    return out


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (tv.mix(hashes) >> np.uint64(64 - bits)).astype(np.int64)


def bit_map(lists: DataFrame, bits: int) -> bytes:
    """A bit map of 2**bits bits with those of all hashes in the only column (arrays of longs) of ``lists``."""
    size = (1 << bits) >> 3

    def mark(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        mine = np.zeros(size, np.uint8)
        for batch in batches:
            at = _places(batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), bits)
            np.bitwise_or.at(mine, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return mine

    return merged(lists, size, np.uint8, mark, "or").tobytes()


def is_marked(seen: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes have their bit set in a map made by ``bit_map``."""
    at = _places(hashes, bits)
    return (seen[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
