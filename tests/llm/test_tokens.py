from __future__ import annotations

import base64
import os
import random

import pytest
from pyspark.sql import functions as F

from loomwright.llm import containers, tokens

pytestmark = pytest.mark.skipif(not os.path.isdir(tokens.TOKENIZERS), reason="needs the public tokenizers")


@pytest.fixture(scope="module")
def enc():
    return tokens.encoder()


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def lists(enc, texts):
    ids, offsets = enc.encode_batch(texts)
    ids = ids.tolist()
    return [ids[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def test_same_ids_as_the_library(enc, reference):
    rnd = random.Random(4)
    alphabet = "aabbeet  hin's'll 'reve\n\n\té日本🙂👩‍💻​́ᲀ\U0001fae8zZ019__--==\x00\x1c\x85\xa0²Ⅷ一٣ʰ"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(4000)]
    texts += ["'s", " 's", "a's", "''s", "'sre", "\n's", "  x", "x  ", "   ", "don't we'll I'D", "<|endoftext|>", "a" * 20_000, " " * 5000, "ab" * 9000 + "é", "1234567890" * 300]
    assert lists(enc, texts) == [reference.encode_ordinary(t) for t in texts]


def test_forgetting_words_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    e = tokens.TrieEncoder()
    texts = ["one two three", "four five", "one six", ""] * 3
    for t in texts:
        assert lists(e, [t]) == [reference.encode_ordinary(t)]


def test_every_row_has_ids(spark, reference):
    rows = [(1, "Hello wörld"), (2, ""), (3, None), (4, "Hello wörld"), (5, "x" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("k", F.lit(2)).withColumn("t", F.lit(3))
    got = {r["doc_id"]: r["ids"] for r in tokens.token_ids(df, "doc_id", "text").collect()}
    assert got == {i: reference.encode_ordinary(t or "") for i, t in rows}
    counts = {r["doc_id"]: r["tokens"] for r in tokens.token_counts(df, "doc_id", "text").collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert tokens.token_ids(df.where("false"), "doc_id", "text").count() == 0


def test_best_fit_takes_the_tightest_bin():
    assert list(containers.best_fit([6, 5, 4, 3, 2, 5, 5], 10, 8)) == [0, 1, 0, 1, 1, 2, 2]
    # one open bin only: the fullest closes when nothing fits
    assert list(containers.best_fit([6, 6, 4], 10, 1)) == [0, 1, 1]
    assert list(containers.best_fit([10, 10], 10, 1)) == [0, 1]


@pytest.mark.parametrize("bins", [4, 64])
def test_best_fit_bounds(bins):
    rnd = random.Random(bins)
    sizes = [rnd.randint(1, 700) for _ in range(5000)]
    at = list(containers.best_fit(sizes, 2048, bins))
    load: dict[int, int] = {}
    for b, s in zip(at, sizes, strict=True):
        load[b] = load.get(b, 0) + s
    assert max(load.values()) <= 2048 and sorted(load) == list(range(len(load)))
    assert len(load) <= 1.12 * sum(sizes) / 2048 + bins


def test_containers(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.choice([0, None, 1, 5, 100, 900, 2047, 2048, 2049, 5000, 4096])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long").withColumn("block", F.lit("clash")).withColumn("h", F.lit(1)).withColumn("no", F.lit(1))
    out = containers.fill_containers(df, "doc_id", "tokens", 2048, open_bins=16, block_bins=50)
    got = out.collect()
    load: dict = {}
    per: dict = {}
    for r in got:
        per.setdefault(r["doc_id"], []).append((r["piece_no"], r["piece_start"], r["piece_size"]))
        if r["container"] is None:
            assert r["piece_size"] == 0
        else:
            load[r["container"]] = load.get(r["container"], 0) + r["piece_size"]
    assert max(load.values()) <= 2048
    for i, n in rows:
        p = sorted(per[i])
        assert sum(x[2] for x in p) == (n or 0) and [x[0] for x in p] == list(range(1, len(p) + 1))
        assert len(p) == 1 or (n > 2048 and all(x[2] == 2048 for x in p[:-1]))
        assert [x[1] for x in p] == [2048 * k for k in range(len(p))]
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, containers.fill_containers(df.repartition(7), "doc_id", "tokens", 2048, 16, 50).collect()), key=str)
    assert containers.fill_containers(df.where("false"), "doc_id", "tokens", 2048).count() == 0
