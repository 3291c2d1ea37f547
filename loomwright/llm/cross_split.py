"""Overlaps between splits: word n-grams of the evaluation records, looked up from the training records.

A content of an evaluation record and one of a training record are like enough only if they share an n-gram among
the rarest few of each (the prefix): with likeness of at least t, of n n-grams the n - ceil(t n) + 1 first ones of
any fixed order must have one in common. The order is rarest first, by a count of bounded size over all contents, so
phrases that stand everywhere don't make candidates. The evaluation side is partitioned by n-gram and marked in a bit
map of bounded size; training n-grams outside the bit map go no further than their task. Candidates are then checked
on the full sets, which gives the containment of each evaluation record in each training record that it overlaps.
Nothing is sampled: the order and the bit map only decide how much work is done. The input is read three times: for
the count, for the prefixes of both sides, and for the contents of candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm import textvec as tv
from loomwright.llm.fixed_tables import bit_map, is_marked, map_bits, merged
from loomwright.llm.near_duplicates import as_lists, likeness_at_least, phrase_arrays
from loomwright.session import staged, unstage

#: Least and greatest number of the count's counters, as a power of two. Beyond what the greatest tells apart the
#: order of rare phrases is by hash; those that stand everywhere still come last, which is what the order is for.
LEAST_SKETCH, MOST_SKETCH = 20, 22


def frequency_sketch(contents: DataFrame, columns: list[str], words: int, bits: int) -> np.ndarray:
    """For each of 2**bits counters the (logarithmic) number of contents with an n-gram in it, over all records."""

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for c in columns:
                for s in tv.phrase_sets(batch.column(c), words):
                    np.add.at(total, (s >> np.uint64(64 - bits)).astype(np.int64), 1)
        return total

    total = merged(contents.select(*columns), 1 << bits, np.int64, count, "sum")
    # a logarithmic scale is enough for an order: eighths of an octave, up to 2**31
    return np.minimum(np.round(8 * np.log2(total + 1.0)), 255).astype(np.uint8)


def prefix(s: np.ndarray, rank: np.ndarray, threshold: Fraction) -> np.ndarray:
    """The n-grams of ``s`` of which one must be shared for a likeness of ``threshold``: its rarest ones."""
    n = len(s)
    take = n - -(-n * threshold.numerator // threshold.denominator) + 1
    bits = int(len(rank)).bit_length() - 1
    r = rank[(s >> np.uint64(64 - bits)).astype(np.int64)]
    # s is sorted, so a stable sort by rank orders by (rank, hash), the same everywhere
    return s[np.argsort(r, kind="stable")[:take]]


def content_index(contents: DataFrame, columns: list[str], words: int, threshold: Fraction, rank_cast: object) -> DataFrame:
    """Rows (id, held, side, n, k1, k2, grams) of all contents with n-grams; grams are those of the prefix."""
    t = Fraction(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.frombuffer(rank_cast.value, np.uint8)
        for batch in batches:
            ids, held = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[list] = [[] for _ in range(6)]
            grams = []
            for side, c in enumerate(columns):
                for i, s in enumerate(tv.phrase_sets(batch.column(c), words)):
                    if len(s):
                        for x, v in zip(out, (ids[i], held[i], side, len(s), *tv.set_key(s)), strict=True):
                            x.append(v)
                        grams.append(prefix(s, rank, t))
            kinds = (pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(out, kinds, strict=True)), as_lists(grams)], names=["id", "held", "side", "n", "k1", "k2", "grams"])

    return contents.select("id", "held", *columns).mapInArrow(run, "id long, held boolean, side int, n int, k1 long, k2 long, grams array<long>")


def _hits(index: DataFrame, seen_cast: object, bits: int) -> DataFrame:
    """The rows of ``index`` (n, k1, k2, grams) with only those grams that are marked, less the rows without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(seen_cast.value, np.uint8)
        for batch in batches:
            lists = batch.column(3)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)
            keep = is_marked(seen, flat, bits)
            cut = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            offsets = np.concatenate([[0], np.cumsum(keep)])[cut].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[keep].view(np.int64)))], names=["n", "k1", "k2", "grams"])

    return index.select("n", "k1", "k2", "grams").mapInArrow(run, "n int, k1 long, k2 long, grams array<long>").where(F.size("grams") > 0)


def crossing(records: DataFrame, columns: list[str], words: int = 4, threshold: Fraction = Fraction(17, 20)) -> DataFrame:
    """(train_id, eval_id, shared, phrases) of the records (id, held, columns) of which some contents are like enough.

    ``held`` tells evaluation records from training records; rows where it is null are in neither. ``shared`` of the
    ``phrases`` of the evaluation record's content stand in the training record's (its containment), of the two
    contents for which that share is greatest. Ids must be unique. Contents without n-grams (null, empty, fewer words
    than ``words``) match nothing. Copies are compared once, through the key of their n-gram set.
    """
    spark, t = records.sparkSession, Fraction(threshold)
    picked = records.where(F.col("held").isNotNull()).select(F.col("id").cast("long").alias("id"), "held", *[F.col(c).cast("string").alias(c) for c in columns])
    sketch_bits = min(MOST_SKETCH, max(LEAST_SKETCH, (16 * records.count()).bit_length()))
    rank = spark.sparkContext.broadcast(frequency_sketch(picked, columns, words, sketch_bits).tobytes())
    index = staged(content_index(picked, columns, words, t, rank), "prefixes")
    ev, tr = index.where("held"), index.where("not held")
    marks = ev.select("grams")
    bits = map_bits(marks.agg(F.coalesce(F.sum(F.size("grams")), F.lit(0))).first()[0])
    seen = spark.sparkContext.broadcast(bit_map(marks, bits))

    def posts(d: DataFrame, who: str) -> DataFrame:
        # copies are one class before their n-grams are unnested, so that each of these is shuffled once
        classes = d.groupBy("k1", "k2").agg(F.first("n").alias("n"), F.first("grams").alias("grams"))
        return classes.select(F.explode("grams").alias("gram"), F.struct("k1", "k2").alias(who), F.col("n").alias(f"n_{who}"))

    hits = posts(ev, "e").join(posts(_hits(tr, seen, bits), "t"), "gram")
    hits = hits.where((F.least("n_e", "n_t") * t.denominator >= F.greatest("n_e", "n_t") * t.numerator))
    sets = staged(hits.select("e", "t").distinct(), "candidates")
    # one content stands for all with the same n-gram set
    where = (
        index.select("id", "side", "k1", "k2")
        .join(sets.select(F.explode(F.array("e", "t")).alias("k")).select("k.*").distinct(), ["k1", "k2"], "left_semi")
        .groupBy("k1", "k2").agg(F.min(F.struct("id", "side")).alias("at"))
        .select(F.struct("k1", "k2").alias("k"), (F.col("at.id") * len(columns) + F.col("at.side")).alias("cid"))
    )
    where = staged(where, "contents")
    pairs = sets.join(where.select(F.col("k").alias("e"), F.col("cid").alias("a")), "e").join(where.select(F.col("k").alias("t"), F.col("cid").alias("b")), "t")
    phrases = staged(phrase_arrays(picked, columns, words, where.select(F.col("cid").alias("id")), apart=True), "phrases")
    like = staged(likeness_at_least(pairs, phrases, t).select("e", "t", "shared", F.col("na").alias("phrases")), "like")
    for done in (phrases, where, sets):
        unstage(done)
    who = lambda d, x, name: d.select(F.struct("k1", "k2").alias(x), F.col("id").alias(name)).distinct()
    both = like.join(who(ev, "e", "eval_id"), "e").join(who(tr, "t", "train_id"), "t")
    best = F.max(F.struct((F.col("shared") / F.col("phrases")).alias("share"), "shared", "phrases")).alias("b")
    found = staged(both.groupBy("train_id", "eval_id").agg(best).select("train_id", "eval_id", "b.shared", "b.phrases"), "overlaps")
    unstage(like)
    unstage(index)
    return found


def overlaps(train: DataFrame, evaluation: DataFrame, columns: list[str], words: int = 4, threshold: Fraction = Fraction(17, 20)) -> DataFrame:
    """Pairs (train_id, eval_id) of records of two tables (id, columns) such that some contents are like enough."""
    sides = [d.select("id", F.lit(held).alias("held"), *columns) for d, held in ((train, False), (evaluation, True))]
    return crossing(sides[0].unionByName(sides[1]), columns, words, threshold).select("train_id", "eval_id")
