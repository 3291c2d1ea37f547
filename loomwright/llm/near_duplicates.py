"""Near-duplicate records: min-max hashing, banding and an exact likeness check.

Every record's phrase set is hashed with half as many permutations as the signature has values, because both the
minimum and the maximum under a permutation are kept; the two are estimates of the same likeness and practically
independent. Bands of four values give the candidates, and each candidate pair is checked on the full phrase sets,
so the result holds no pair below the threshold.

With 80 permutations (160 values, 40 bands of 4), a pair of likeness 0.7 is missed with a chance of 1.7e-5, one of
0.8 with 5e-10; a pair of likeness 0.05 becomes a candidate with a chance of 2.5e-4.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm import textvec as tv
from loomwright.llm.components import components
from loomwright.llm.fixed_tables import bit_map, is_marked, map_bits
from loomwright.session import staged, unstage

PERMUTATIONS = 80
BAND_ROWS = 4

_rng = np.random.Generator(np.random.PCG64(20260906))
_MULT = _rng.integers(1, 1 << 63, size=512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, size=512, dtype=np.uint64)


def minmax_bands(hashes: np.ndarray, permutations: int = PERMUTATIONS, rows: int = BAND_ROWS) -> np.ndarray:
    """Band keys of one set: under each permutation the least and the greatest value, ``rows`` values to a band."""
    x = hashes[:, None] * _MULT[:permutations] + _ADD[:permutations]
    values = np.empty(2 * permutations, dtype=np.uint64)
    values[0::2] = x.min(axis=0)
    values[1::2] = x.max(axis=0)
    values = tv.mix(values).reshape(-1, rows)
    key = values[:, 0] * tv._LANES[0]
    for k in range(1, rows):
        key += values[:, k] * tv._LANES[k]
    return tv.mix(key + np.arange(len(values), dtype=np.uint64))


def union_sets(batch: pa.RecordBatch, columns: list[str], words: int) -> Iterator[np.ndarray]:
    """Per row the phrases of all ``columns`` together; no phrase runs from one column into another."""
    for parts in zip(*(tv.phrase_sets(batch.column(c), words) for c in columns), strict=True):
        yield parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def as_lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def signatures(df: DataFrame, key: str, columns: list[str], words: int, permutations: int = PERMUTATIONS, rows: int = BAND_ROWS) -> DataFrame:
    """One row (id, n, k1, k2, bands) for each record: number of phrases, key of the phrase set, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k1, k2, bands = [], [], [], []
            for s in union_sets(batch, columns, words):
                a, b = tv.set_key(s)
                n.append(len(s))
                k1.append(a)
                k2.append(b)
                bands.append(minmax_bands(s, permutations, rows) if len(s) else np.zeros(0, np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), as_lists(bands)], names=["id", "n", "k1", "k2", "bands"])

    picked = df.select(F.col(key).cast("long").alias("id"), *[F.col(c).cast("string").alias(c) for c in columns])
    return picked.mapInArrow(run, "id long, n int, k1 long, k2 long, bands array<long>")


def phrase_arrays(df: DataFrame, columns: list[str], words: int, needed: DataFrame, apart: bool = False) -> DataFrame:
    """(id, phrases) of the rows of ``df`` (id, columns) whose id is in ``needed`` (id): the distinct phrase hashes.

    With ``apart`` each column is a content of its own, with the id ``id * columns + place``. The needed ids go to the
    scan as a bit map, so no text is shuffled; a few rows that aren't needed come along by chance, for a join to leave out.
    """
    bits = map_bits(needed.count())
    seen_cast = df.sparkSession.sparkContext.broadcast(bit_map(needed.select(F.array("id").alias("ids")), bits))
    width = len(columns) if apart else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(seen_cast.value, np.uint8)
        for batch in batches:
            own = batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False) * width
            for side in range(width):
                ids = own + side
                keep = is_marked(seen, ids.view(np.uint64), bits)
                if keep.any():
                    part = batch.filter(pa.array(keep))
                    sets = list(union_sets(part, [columns[side]] if apart else columns, words))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), as_lists(sets)], names=["id", "phrases"])

    return df.select("id", *columns).mapInArrow(run, "id long, phrases array<long>")


def likeness_at_least(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose sets (id, phrases) have likeness of at least ``threshold``, exactly.

    Shared and total phrases are compared as whole numbers, so no rounding decides a case on the threshold.
    """
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("phrases").alias("pa")), "a").join(sets.select(F.col("id").alias("b"), F.col("phrases").alias("pb")), "b")
    both = both.withColumn("na", F.size("pa").cast("long")).withColumn("nb", F.size("pb").cast("long"))
    t = Fraction(threshold)
    both = both.where((F.least("na", "nb") * t.denominator >= F.greatest("na", "nb") * t.numerator) & (F.col("na") > 0))
    both = both.withColumn("shared", F.size(F.array_intersect("pa", "pb")).cast("long")).drop("pa", "pb")
    return both.where(F.col("shared") * t.denominator >= (F.col("na") + F.col("nb") - F.col("shared")) * t.numerator)


def _classes(df: DataFrame, key: str, columns: list[str], words: int, permutations: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(members, posts): each record's class (id, class_id, n), and the band keys (id, band) of each class."""
    sig = staged(signatures(df, key, columns, words, permutations, rows), "signatures")
    named = sig.where("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("class_id"))
    members = staged(
        sig.where("n > 0").select("id", "n", "k1", "k2").join(named, ["k1", "k2"]).select("id", "class_id", "n").unionByName(sig.where("n = 0").select("id", F.col("id").alias("class_id"), "n")),
        "members",
    )
    first = members.where("id = class_id and n > 0").select("id")
    return members, sig.select("id", "bands").join(first, "id", "left_semi").select("id", F.explode("bands").alias("band"))


def _verified(df: DataFrame, key: str, columns: list[str], words: int, pairs: DataFrame, threshold: Fraction) -> DataFrame:
    """The candidate ``pairs`` (a, b; staged, and dropped here) that are like enough, with shared, na, nb."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = df.select(F.col(key).cast("long").alias("id"), *[F.col(c).cast("string").alias(c) for c in columns])
    phrases = staged(phrase_arrays(texts, columns, words, needed), "phrases")
    links = staged(likeness_at_least(pairs, phrases, threshold), "links")
    unstage(phrases)
    return links


def classes_and_links(df: DataFrame, key: str, columns: list[str], words: int = 4, threshold: Fraction = Fraction(7, 10), permutations: int = PERMUTATIONS, rows: int = BAND_ROWS) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the records of ``df``: all links, so as many as there are pairs of different, like records.

    ``members`` (id, class_id, n) has every record once; records with the same phrase set form a class, named after
    its least id, so copies meet no further work. ``links`` (a, b, shared, na, nb; a < b) holds each pair of classes
    of at least the threshold once. A record without phrases (null, empty, too few words) is a class of its own and
    has no link. Ids must be unique.
    """
    members, posts = _classes(df, key, columns, words, permutations, rows)
    pairs = staged(posts.alias("x").join(posts.alias("y"), "band").where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct(), "candidates")
    links = _verified(df, key, columns, words, pairs, threshold)
    unstage(pairs)
    return members, links


def groups(df: DataFrame, key: str, columns: list[str], words: int = 4, threshold: Fraction = Fraction(7, 10), permutations: int = PERMUTATIONS, rows: int = BAND_ROWS) -> DataFrame:
    """(id, class_id, group_id) of every record; the groups are what ``classes_and_links`` would hold together.

    Within a band only its least class is compared with the others at first, so many revisions of one record make
    links in proportion to their number. Classes of a band that this leaves in different groups are then compared
    across the groups, all of them; those within one group need no further link. A group is named after its least id.
    """
    members, posts = _classes(df, key, columns, words, permutations, rows)
    posts = staged(posts, "bands")
    lead = posts.groupBy("band").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    star = posts.join(lead, "band").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    star = staged(star, "stars")
    links = _verified(df, key, columns, words, star, threshold).select("a", "b")

    def joined(links: DataFrame) -> DataFrame:
        c = components(links.select(F.col("a").cast("string").alias("u"), F.col("b").cast("string").alias("v"))).select(F.col("node").cast("long").alias("id"), "component")
        return c.join(c.groupBy("component").agg(F.min("id").alias("g")), "component").select("id", "g")

    first = staged(joined(links), "groups")
    grouped = posts.join(first, "id", "left").select("id", "band", F.coalesce("g", "id").alias("g"))
    apart = grouped.groupBy("band").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("band")
    grouped = staged(grouped.join(apart, "band", "left_semi"), "apart")
    bands = grouped.select("band", "g").distinct()
    across = bands.alias("x").join(bands.alias("y"), "band").where("x.g < y.g").select("band", F.col("x.g").alias("gx"), F.col("y.g").alias("gy"))
    side = lambda x: grouped.select("band", F.col("g").alias(f"g{x}"), F.col("id").alias(x))
    left = across.join(side("x"), ["band", "gx"]).join(side("y"), ["band", "gy"]).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    # the stars' pairs have been compared
    left = staged(left.join(star, ["a", "b"], "left_anti"), "across")
    more = _verified(df, key, columns, words, left, threshold).select("a", "b")
    out = members.join(first.withColumnRenamed("id", "class_id"), "class_id", "left").select("id", "class_id", F.coalesce("g", "class_id").alias("group_id"))
    if not more.isEmpty():
        # only the groups that these links join are put together, not their members again
        of = lambda x: first.select(F.col("id").alias(x), F.col("g").alias(f"g{x}"))
        met = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ga", "a").alias("a"), F.coalesce("gb", "b").alias("b")).distinct()
        upper = joined(met).select(F.col("id").alias("group_id"), F.col("g").alias("top"))
        out = out.join(upper, "group_id", "left").select("id", "class_id", F.coalesce("top", "group_id").alias("group_id"))
    unstage(posts)
    unstage(left)
    return out


def expand_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs (a, b; a < b) of records that are linked: every member of one class with every one of the other,
    and the members of a class among themselves. As large as the number of such pairs is."""
    m = members.where("n > 0").select("id", "class_id")
    left = links.select("a", "b").join(m.select(F.col("class_id").alias("a"), F.col("id").alias("ia")), "a")
    across = left.join(m.select(F.col("class_id").alias("b"), F.col("id").alias("ib")), "b").select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))
    within = m.alias("x").join(m.alias("y"), "class_id").where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    return across.unionByName(within)
