"""Encoding with a public byte-level BPE vocabulary by a prefix-sharing trie traversal.

The distinct words of a batch are visited in sorted order, which is the depth-first order of their trie. Each trie
node (a prefix) has one state: the last token of its encoding. The state of a node is found among the tokens that
end there: the one that byte-pair merging leaves apart from the state of the prefix before it. A prefix shared by
many words is worked out once, and a word's encoding is read backwards from its states.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm import textvec as tv

TOKENIZERS = "/opt/tokenizers"

# The words of the vocabulary are, at each place the first of: an English clitic, a run of letters, of
# numbers or of other characters, each with one space before it if there is one, and white space.
_CLITICS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
_SPACES = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
_OTHER, _LETTER, _NUMBER, _SPACE, _UNKNOWN = range(5)
_kinds: list[np.ndarray] = []


def _kind_table() -> np.ndarray:
    """The kind of every code point; unknown is what this Python's Unicode tables don't have."""
    if not _kinds:
        t = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))
            if k[0] == "L":
                t[c] = _LETTER
            elif k[0] == "N":
                t[c] = _NUMBER
            elif k == "Cn":
                t[c] = _UNKNOWN
        for first, last in _SPACES:
            t[first : last + 1] = _SPACE
        _kinds.append(t)
    return _kinds[0]


def word_starts(points: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where words start in the code points of some texts, one after the other (``offsets`` of the texts, from 0)."""
    n = len(points)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    first = first[:n]
    change = first.copy()
    change[1:] |= kind[1:] != kind[:-1]
    last = np.ones(n, bool)  # of its run
    last[:-1] = change[1:]
    ends_text = np.zeros(n + 1, bool)
    ends_text[offsets] = True
    ends_text = ends_text[1:]
    white = kind == _SPACE
    lead = white & last & ~ends_text & (points == 0x20)  # the space that goes with the next run
    starts = change | (white & last & ~ends_text)
    follows = np.zeros(n, bool)
    follows[1:] = lead[:-1]
    starts &= ~follows
    for i in np.flatnonzero((points == 0x27) & change & ~follows):
        stop = offsets[np.searchsorted(offsets, i, side="right")]
        ahead = "".join(map(chr, points[i : min(i + 3, stop)]))
        for c in _CLITICS:
            if ahead.startswith(c):
                starts[i + 1] = False
                if i + len(c) < stop:
                    starts[i + len(c)] = True
                break
    return np.flatnonzero(starts)


#: Words whose encodings a worker keeps; beyond it they are dropped and worked out again when they come.
CACHE_WORDS = 1_000_000


class TrieEncoder:
    """Encodes texts with the vocabulary ``<folder>/<name>.tiktoken`` (ranks are ids, merges follow from them)."""

    def __init__(self, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> None:
        self.folder, self.name = folder, name
        with open(f"{folder}/{name}.tiktoken", "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.halves = {i: self._halves(b) for b, i in self.ids.items() if len(b) > 1}
        self.merged = {h: i for i, h in self.halves.items()}
        self._right: dict[int, list[tuple[int, float]]] = {}
        self._left: dict[int, list[tuple[int, float]]] = {}
        self._apart: dict[tuple[int, int], bool] = {}
        self._library = None
        self._forget()

    def _forget(self) -> None:
        self.words: dict[int, int] = {}  # hash of a word -> its number
        self.flat = np.zeros(0, np.int32)
        self.offsets = np.zeros(1, np.int64)

    def _halves(self, token: bytes) -> tuple[int, int]:
        """The two tokens that merge into ``token``: what its bytes come to by all merges of lesser rank."""
        rank = self.ids[token]
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda i: self.ids.get(parts[i] + parts[i + 1], rank))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ids[parts[0]], self.ids[parts[1]]

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """What has stood at one end of a token while it was merged, each with the rank at which it was merged on."""
        kept = self._left if side == 0 else self._right
        if token not in kept:
            out, until = [(token, float("inf"))], token
            while until in self.halves:
                part = self.halves[until][side]
                out.append((part, until))
                until = part
            kept[token] = out
        return kept[token]

    def apart(self, a: int, b: int) -> bool:
        """Whether merging leaves ``a`` and ``b``, side by side, as they are.

        They don't stay if something at the end of a and something at the start of b merge before either is merged
        on within its own token; on equal rank the pair further left goes first.
        """
        known = self._apart.get((a, b))
        if known is None:
            known = True
            for x, until_x in self._spine(a, 1):
                for y, until_y in self._spine(b, 0):
                    m = self.merged.get((x, y))
                    if m is not None and m < until_x and m <= until_y:
                        known = False
            self._apart[a, b] = known
        return known

    def learn(self, new: list[tuple[int, bytes]]) -> None:
        """Adds the encodings of words (hash, UTF-8), walking their trie once."""
        ids, bytes_of, longest, apart = self.ids, self.bytes_of, self.longest, self.apart
        before, state, found = b"", [], []
        for h, w in sorted(new, key=lambda x: x[1]):
            same = 0
            for x, y in zip(before, w):  # noqa: B905 - up to the shorter one
                if x != y:
                    break
                same += 1
            del state[same:]
            for d in range(same + 1, len(w) + 1):
                for size in range(min(d, longest), 0, -1):
                    t = ids.get(w[d - size : d])
                    if t is not None and (size == d or apart(state[d - size - 1], t)):
                        state.append(t)
                        break
            out, d = [], len(w)
            while d:
                t = state[d - 1]
                out.append(t)
                d -= len(bytes_of[t])
            self.words[h] = len(self.words)
            found.append(out[::-1])
            before = w
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.int32)])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum([len(f) for f in found])])

    def _library_starts(self, text: str) -> list[int]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(f"{self.folder}/{self.name}.json").pre_tokenizer
        return [a for _, (a, _) in self._library.pre_tokenize_str(text)]

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of all texts, one after the other. Texts are taken whole."""
        sizes = np.array([len(t) for t in texts], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        n = int(offsets[-1])
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _kind_table()[points]
        starts = word_starts(points, kind, offsets)
        if (kind == _UNKNOWN).any():  # newer than this Python: such texts are divided by the tokenizer's own library
            row = np.searchsorted(offsets, starts, side="right") - 1
            strange = np.unique(np.searchsorted(offsets, np.flatnonzero(kind == _UNKNOWN), side="right") - 1)
            own = [offsets[r] + np.array(self._library_starts(texts[r]), np.int64) for r in strange]
            starts = np.sort(np.concatenate([starts[~np.isin(row, strange)], *own]))
        ends = np.append(starts[1:], n)
        up, down = tv.powers(n)
        total = np.concatenate([[np.uint64(0)], np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
        h = tv.mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        distinct, at, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.words) > CACHE_WORDS:
            self._forget()
            self._apart.clear()
        known = self.words
        new = [(k, i) for k, i in zip(distinct.tolist(), at.tolist(), strict=True) if k not in known]
        if new:
            self.learn([(k, points[starts[i] : ends[i]].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")) for k, i in new])
        number = np.fromiter(map(known.__getitem__, distinct.tolist()), np.int64, count=len(distinct))[which]
        begin, size = self.offsets[number], self.offsets[number + 1] - self.offsets[number]
        done = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(begin - done[:-1], size) + np.arange(done[-1])]
        return ids, done[np.searchsorted(starts, offsets)]

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts of any number, worked on in portions; a null is an empty text."""
        ids, offsets = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for part in _portions(texts):
            i, o = self.encode_texts([t or "" for t in part])
            ids.append(i)
            offsets.append(o[1:] + offsets[-1][-1])
        return np.concatenate(ids), np.concatenate(offsets)


def _portions(texts: list[str | None], limit: int = 1 << 20) -> Iterator[list[str | None]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


_encoders: dict[tuple[str, str], TrieEncoder] = {}


def encoder(folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> TrieEncoder:
    """The worker's encoder; loaded once and kept over batches and tasks."""
    if (folder, name) not in _encoders:
        _encoders[folder, name] = TrieEncoder(folder, name)
    return _encoders[folder, name]


def token_ids(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(key, ids) of every row, without special tokens; a null or empty text has an empty list. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for batch in batches:
            ids, offsets = enc.encode_batch(batch.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["k", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def token_counts(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(key, tokens) of every row; a null or empty text has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for batch in batches:
            _, offsets = enc.encode_batch(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets))], names=["k", "tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"k {kind}, tokens long").withColumnRenamed("k", key)
