"""Long exact spans shared between records.

The joined unit is the run of consecutive sentences (or lines): the fewest, at least two, that have a quarter of
``length`` characters together. Every window of ``length`` characters is looked up by one run, chosen by the window's
content alone: of the runs that lie in it the one with the least hash. Run hashes are joined globally; windows whose run
stands in one record only are done. The others are compared within their run's group, as the text around it (its
context): equal contexts of different records are shared as they stand, and different ones window by window. So a window
counts as shared exactly if it stands in another record, and the spans are the unions of shared windows.

A window that holds no whole run (within a long sentence) takes a stretch of half its length in the run's place, again
chosen by content. ``without_repeats`` removes the sentences covered by a repeated run that isn't its first occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm import textvec as tv
from loomwright.llm.fixed_tables import bit_map, is_marked, map_bits
from loomwright.session import staged, unstage

#: An anchor with more different contexts is compared through the windows' hashes, not within one task; the result is the same.
GROUP_CONTEXTS = 2000


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def _grams(points: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` code points from each place on."""
    n = len(points)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = tv.powers(n)
    total = np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)
    before = np.concatenate([[np.uint64(0)], total[: n - size]])
    return tv.mix((total[size - 1 :] - before) * down[: n - size + 1])


def sentence_starts(points: np.ndarray) -> np.ndarray:
    """Places at which a sentence or line begins, told by the two code points before; the first two places are none."""
    p1, p2 = points[1:-1], points[:-2]
    return np.flatnonzero((p1 == 0x0A) | (p1 == 0x3002) | ((p1 == 0x20) & ((p2 == 0x2E) | (p2 == 0x21) | (p2 == 0x3F)))) + 2


def sentence_runs(starts: np.ndarray, least: int) -> np.ndarray:
    """For each start the end of its run: of at least two sentences and ``least`` code points; only those with one."""
    j = np.maximum(np.arange(len(starts)) + 2, np.searchsorted(starts, starts + least))
    return starts[j[j < len(starts)]]


def _run_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = tv.powers(len(points))
    total = np.concatenate([[np.uint64(0)], np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
    return tv.mix((total[ends] - total[starts]) * down[starts] + np.uint64(0x51ED270B))


def _least_in(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Of each range (lo to hi, both within) the place of the least key, the first of equal ones."""
    rows = [np.arange(len(keys))]
    width = int((hi - lo).max()) + 1
    while (2 << (len(rows) - 1)) <= width:
        half, r = 1 << (len(rows) - 1), rows[-1]
        a, b = r[:-half], r[half:]
        rows.append(np.where(keys[b] < keys[a], b, a))
    out = np.empty(len(lo), np.int64)
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    for k, r in enumerate(rows):
        at = np.flatnonzero(level == k)
        a, b = r[lo[at]], r[hi[at] - (1 << k) + 1]
        out[at] = np.where(keys[b] < keys[a], b, a)
    return out


def anchors(points: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, anchor, hash): start of each window inside a text, its anchor and that one's hash.

    The anchor is the run of sentences with the least hash among those inside the window, their beginnings' look-back
    included, so that equal windows have equal anchors wherever they stand. An even number is a run's start doubled, an
    odd one that of a stretch, where the window holds no run.
    """
    sizes = np.diff(offsets)
    long = sizes >= length
    first, count = offsets[:-1][long], sizes[long] - length + 1
    skip = np.concatenate([[0], np.cumsum(count)])
    window = np.repeat(first - skip[:-1], count) + np.arange(skip[-1])
    if not len(window):
        return window, np.empty(0, np.int64), np.empty(0, np.uint64)
    starts = sentence_starts(points)
    ends = sentence_runs(starts, length // 4)
    starts = starts[: len(ends)]
    # the runs inside a window change only where a window begins to pass a run's start or to reach one's end
    turns = np.concatenate([starts - 1, ends - length])
    text = np.searchsorted(first, turns, side="right") - 1
    inside = (text >= 0) & (turns - first[text] < count[text])
    begin = np.unique(np.concatenate([skip[:-1], (skip[text] + turns - first[text])[inside]]))
    many = np.diff(np.append(begin, len(window)))
    lo = np.searchsorted(starts, window[begin] + 2)
    hi = np.searchsorted(ends, window[begin] + length, side="right") - 1
    held = hi >= lo
    at, h = np.empty(len(begin), np.int64), np.empty(len(begin), np.uint64)
    if held.any():
        keys = _run_hashes(points, starts, ends)
        best = _least_in(keys, lo[held], hi[held])
        at[held], h[held] = 2 * starts[best], keys[best]
    at, h = np.repeat(at, many), np.repeat(h, many)
    bare = np.flatnonzero(np.repeat(~held, many))
    if len(bare):
        where, stretch = _stretches(points, window[bare], length)
        at[bare], h[bare] = 2 * where + 1, stretch
    return window, at, h


def _stretches(points: np.ndarray, window: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each window's stretch: of half its length, first in a fixed order that prefers sentence starts.

    Only the parts of the text that lie under these windows are looked at: each row of windows with its characters.
    """
    size = length // 2
    reach = length - size - 1  # stretches that can be the anchor: those from 2 on, whose start's look-back is inside
    row = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1] + 1]))
    wide = np.diff(np.append(row, len(window))) + length - 1
    cut = np.concatenate([[0], np.cumsum(wide)])
    part = points[np.repeat(window[row] - cut[:-1], wide) + np.arange(cut[-1])]
    shift = np.repeat(window[row] - cut[:-1], wide - length + 1)
    own = window - shift
    h = _grams(part, size)
    opens = np.zeros(len(part) + 1, bool)
    opens[sentence_starts(part)] = True
    bits = max(24, int(len(h)).bit_length())
    key = (h >> np.uint64(1)) | np.where(opens[: len(h)], np.uint64(0), np.uint64(1 << 63))
    key = (key >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(h), dtype=np.uint64)
    pad = -len(key) % reach
    grid = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, reach)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(grid, axis=1).reshape(-1)
    least = np.minimum(ahead[: len(key) - reach + 1], behind[reach - 1 : len(key)])
    at = (least[own + 2] & np.uint64((1 << bits) - 1)).astype(np.int64)
    return at + shift, h[at]


def _portions(batch: pa.RecordBatch, limit: int = 1 << 19) -> Iterator[tuple[np.ndarray, list[str]]]:
    ids, part, size = [], [], 0
    for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        if t:
            ids.append(i)
            part.append(t)
            size += len(t)
            if size >= limit:
                yield np.array(ids), part
                ids, part, size = [], [], 0
    if ids:
        yield np.array(ids), part


def _anchor_lists(docs: DataFrame, length: int) -> DataFrame:
    """(id, hashes): the distinct anchor hashes of each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_ids, lists = [], []
            for ids, texts in _portions(batch):
                points, offsets = _points(texts)
                window, at, h = anchors(points, offsets, length)
                new = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)
                row = np.searchsorted(offsets, window[new], side="right") - 1
                h = h[new]
                cut = np.searchsorted(row, np.arange(len(ids) + 1))
                for k in range(len(ids)):
                    if cut[k + 1] > cut[k]:
                        out_ids.append(ids[k])
                        lists.append(np.unique(h[cut[k] : cut[k + 1]]))
            offs = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            flat = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(out_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat.view(np.int64)))], names=["id", "hashes"])

    return docs.mapInArrow(run, "id long, hashes array<long>")


def _contexts(docs: DataFrame, length: int, seen_cast: object, bits: int) -> DataFrame:
    """(h, id, start, windows, ctx): for each row of windows with the same marked anchor, the text they cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(seen_cast.value, np.uint8)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for ids, texts in _portions(batch):
                points, offsets = _points(texts)
                window, at, h = anchors(points, offsets, length)
                if not len(at):
                    continue
                # an anchor lies in its window, so windows of two texts never have the same
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                row = np.searchsorted(offsets, window[first], side="right") - 1
                last = np.append(first[1:], len(at)) - 1
                keep = is_marked(seen, h[first], bits)
                for f, e, r in zip(first[keep].tolist(), last[keep].tolist(), row[keep].tolist(), strict=True):
                    a, b = int(window[f] - offsets[r]), int(window[e] - offsets[r]) + length
                    out[0].append(int(h[f].view(np.int64)))
                    out[1].append(int(ids[r]))
                    out[2].append(a)
                    out[3].append(b - a - length + 1)
                    out[4].append(texts[r][a:b])
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["h", "id", "start", "windows", "ctx"])

    return docs.mapInArrow(run, "h long, id long, start long, windows long, ctx string")


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True))


def _window_hashes(texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, cut): those of all windows of the texts, one text after another, and where each text's begin."""
    points, offsets = _points(texts)
    count = np.diff(offsets) - length + 1
    cut = np.concatenate([[0], np.cumsum(count)])
    window = np.repeat(offsets[:-1] - cut[:-1], count) + np.arange(cut[-1])
    return _grams(points, length)[window], cut


def _compare(groups: DataFrame, length: int) -> DataFrame:
    """(h, c, a, b) of the contexts (h, c, lo, hi, ctx), sorted by h: the shared windows, from a up to b, of each one.

    Only contexts of one record come out; the others are shared whole. A group is held in one task, so it must be small.
    """

    def solve(rows: list[tuple], out: list[list]) -> None:
        wh, cut = _window_hashes([r[4] for r in rows], length)
        row = np.repeat(np.arange(len(rows)), np.diff(cut))
        anchor = np.array([r[0] for r in rows], np.int64)[row]
        lo, hi = np.array([r[2] for r in rows])[row], np.array([r[3] for r in rows])[row]
        order = np.lexsort((wh, anchor))
        s, g = wh[order], anchor[order]
        begin = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (g[1:] != g[:-1])]))
        shared = np.repeat(np.minimum.reduceat(lo[order], begin) != np.maximum.reduceat(hi[order], begin), np.diff(np.append(begin, len(s))))
        flags = np.zeros(len(wh), bool)
        flags[order] = shared
        for k, r in enumerate(rows):
            if r[2] == r[3]:
                for a, b in _runs(flags[cut[k] : cut[k + 1]]):
                    for x, v in zip(out, (r[0], r[1], a, b), strict=True):
                        x.append(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done(rows: list[tuple]) -> pa.RecordBatch:
            out: list[list] = [[], [], [], []]
            if rows:
                solve(rows, out)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["h", "c", "a", "b"])

        for batch in batches:
            held += zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)
            if len(held) > 2000:
                k = len(held)
                while k and held[k - 1][0] == held[-1][0]:
                    k -= 1
                if k:
                    yield done(held[:k])
                    held = held[k:]
        yield done(held)

    return groups.select("h", "c", "lo", "hi", "ctx").mapInArrow(run, "h long, c long, a long, b long")


def _compare_hot(groups: DataFrame, length: int) -> DataFrame:
    """The same for anchors with any number of contexts: all windows' hashes, grouped over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wh, cut = _window_hashes(batch.column(4).to_pylist(), length)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(wh.view(np.int64)))], names=["h", "c", "lo", "hi", "hashes"])

    each = groups.select("h", "c", "lo", "hi", "ctx").mapInArrow(run, "h long, c long, lo long, hi long, hashes array<long>").select("h", "c", "lo", "hi", F.posexplode("hashes").alias("a", "wh"))
    both = each.groupBy("h", "wh").agg(F.min("lo").alias("l"), F.max("hi").alias("u")).where("l <> u").select("h", "wh")
    single = each.where("lo = hi").join(both, ["h", "wh"], "left_semi")
    # a context has at most as many windows as ``length``, so neither window nor group is large
    run_no = F.col("a") - F.row_number().over(Window.partitionBy("h", "c").orderBy("a"))
    return single.select("h", "c", "a", run_no.alias("r")).groupBy("h", "c", "r").agg(F.min("a").cast("long").alias("a"), (F.max("a") + 1).cast("long").alias("b")).select("h", "c", "a", "b")


def shared_spans(df: DataFrame, key: str, text: str, length: int = 200) -> DataFrame:
    """(id, span_start, span_end): the longest runs of positions (code points from 0, end exclusive) that lie in some
    ``length`` characters also standing in a record with another id; runs that touch are one.

    Null texts and texts shorter than ``length`` share nothing. Copies are shared whole. Ids must be unique.
    """
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where(F.length("text") >= length)
    listed = _anchor_lists(docs, length).select(F.explode("hashes").alias("h"), "id")
    repeated = staged(listed.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("h"), "anchors")
    bits = map_bits(repeated.count())
    seen = spark.sparkContext.broadcast(bit_map(repeated.select(F.array("h").alias("hashes")), bits))
    found = staged(_contexts(docs, length, seen, bits).withColumn("c", F.xxhash64("ctx", F.lit(7))), "contexts")
    distinct = found.groupBy("h", "c").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.first("windows").alias("windows"), F.min(F.struct("id", "start")).alias("at"))
    # an anchor of one record only came through the bit map by chance, or is repeated within that record
    counts = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("lo").alias("l"), F.max("hi").alias("u"), F.max(F.expr("lo = hi")).alias("open")).where("l <> u").select("h", "n", "open")
    sides = staged(distinct.join(counts, "h"), "sides")
    whole = sides.where("lo <> hi").select("h", "c", F.lit(0).cast("long").alias("a"), F.col("windows").alias("b"))
    # only anchors with different contexts need their texts, of each context once
    asked = sides.where("open and n > 1").select("h", "c", "lo", "hi", "n", F.col("at.id").alias("id"), F.col("at.start").alias("start"))
    texts = staged(asked.join(found.select("h", "c", "id", "start", "ctx"), ["h", "c", "id", "start"]), "asked")
    runs = whole.unionByName(_compare(texts.where(F.col("n") <= GROUP_CONTEXTS).repartition("h").sortWithinPartitions("h"), length))
    runs = runs.unionByName(_compare_hot(texts.where(F.col("n") > GROUP_CONTEXTS), length))
    spans = found.select("h", "c", "id", "start").join(runs, ["h", "c"]).select("id", (F.col("start") + F.col("a")).alias("s"), (F.col("start") + F.col("b") - 1 + length).alias("e")).distinct()
    # a record's spans are fewer than its characters, which one task holds anyway
    w = Window.partitionBy("id").orderBy("s", "e")
    far = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    parted = spans.withColumn("new", F.when(far.isNull() | (F.col("s") > far), 1).otherwise(0)).withColumn("part", F.sum("new").over(w))
    out = staged(parted.groupBy("id", "part").agg(F.min("s").alias("span_start"), F.max("e").alias("span_end")).select("id", "span_start", "span_end"), "spans")
    for done in (repeated, found, sides, texts):
        unstage(done)
    return out


def shared_share(df: DataFrame, key: str, text: str, spans: DataFrame) -> DataFrame:
    """(id, chars, shared_chars, spans) of every record, also of those that share nothing; a null text has 0."""
    per = spans.groupBy("id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"), F.count(F.lit(1)).alias("spans"))
    base = df.select(F.col(key).cast("long").alias("id"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("chars"))
    return base.join(per, "id", "left").select("id", "chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.coalesce("spans", F.lit(0)).alias("spans"))


def _bounds(text: str) -> np.ndarray:
    """Where the sentences of a text begin, with its end as the last."""
    # two places in front, so that a sentence can begin at the text's second one
    inner = sentence_starts(np.concatenate([np.zeros(2, np.uint32), _points([text])[0]])) - 2
    return np.concatenate([[0], inner[(inner > 0) & (inner < len(text))], [len(text)]])


def _text_runs(text: str, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of all sentence runs of a text, its first and last sentence among them."""
    bounds = _bounds(text)
    ends = sentence_runs(bounds, least)
    starts = bounds[: len(ends)]
    return starts, ends, _run_hashes(_points([text])[0], starts, ends) if len(ends) else np.zeros(0, np.uint64)


def without_repeats(df: DataFrame, key: str, text: str, least: int = 50) -> DataFrame:
    """(id, text, removed): every record with its text less the sentences that a repeated run covers, and their number.

    A run (at least two sentences and ``least`` characters) that stands more than once, in other records or the same
    one, stays where it stands first, by (id, place); the sentences of all later occurrences go. A null text stays null
    and an empty one empty. Ids must be unique.
    """
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_text_runs(t, least)[2].view(np.int64) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64()))], names=["hashes"])

    hashes = docs.mapInArrow(lists, "hashes array<long>").select(F.explode("hashes").alias("h"))
    repeated = staged(hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "repeated")
    bits = map_bits(repeated.count())
    seen_cast = df.sparkSession.sparkContext.broadcast(bit_map(repeated.select(F.array("h").alias("hashes")), bits))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(seen_cast.value, np.uint8)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t:
                    s, e, h = _text_runs(t, least)
                    keep = is_marked(seen, h, bits)
                    for x, v in zip(out, (h[keep].view(np.int64), np.full(int(keep.sum()), i), s[keep], e[keep]), strict=True):
                        x.append(v)
            cols = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["h", "id", "s", "e"])

    at = staged(docs.mapInArrow(occurrences, "h long, id long, s long, e long"), "occurrences")
    first = at.groupBy("h").agg(F.min(F.struct("id", "s")).alias("first"))
    later = at.join(first, "h").where(F.struct("id", "s") > F.col("first")).groupBy("id").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("covered"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for t, covered in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not t or not covered:
                    texts.append(t)
                    removed.append(0)
                    continue
                bounds = _bounds(t)
                level = np.zeros(len(bounds), np.int64)
                for x, step in (("s", 1), ("e", -1)):
                    np.add.at(level, np.searchsorted(bounds, [r[x] for r in covered]), step)
                gone = np.cumsum(level)[:-1] > 0
                texts.append("".join(t[a:b] for a, b, g in zip(bounds[:-1].tolist(), bounds[1:].tolist(), gone.tolist(), strict=True) if not g))
                removed.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int64())], names=["id", "text", "removed"])

    return docs.join(later, "id", "left").select("id", "text", "covered").mapInArrow(cut, "id long, text string, removed long")
