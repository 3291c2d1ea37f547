from __future__ import annotations

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from loomwright.sources import readers, writers
from loomwright.streaming import flows


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, "ü", None), (1, "a", 3)], "b int, a string, c int")
    out = str(tmp_path / "out")
    writers.write_jsonl(df, out, ["b"], one_file=True)
    lines = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == ['{"a":"a","b":1,"c":3}', '{"a":"ü","b":2,"c":null}']
    assert sorted(tuple(r) for r in readers.read_jsonl(spark, out, "b int, a string, c int").collect()) == sorted(tuple(r) for r in df.collect())
    with pytest.raises(Exception, match="(?i)exists"):
        writers.write_jsonl(df, out, ["b"])


def test_malformed_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a":1}\n[1]\n{"a":\n{"a":2,"z":0}\n')
    lines = readers.numbered_lines(spark, str(p))
    assert sorted(r["line_no"] for r in readers.malformed_lines(lines).collect()) == [2, 3]
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_jsonl(spark, str(p), "a int").collect()
    soft = readers.read_jsonl(spark, str(p), "a int", strict=False)
    assert [r["_corrupt"] for r in soft.collect()].count(None) == 2
    got = lines.where("line_no = 4").select(readers.unknown_fields(F.col("raw"), ["a"])).first()[0]
    assert got == ["z"]


def test_shards_and_manifest(spark, tmp_path):
    for name, v in (("cpp_train_0", 1), ("cpp_valid_0", 2)):
        with gzip.open(tmp_path / f"{name}.jsonl.gz", "wt") as f:
            f.write(json.dumps({"id": v}) + "\n")
    got = readers.read_shards(spark, str(tmp_path / "*.gz"), "id int", "s", {"valid": "validation", "train": "train"})
    assert sorted((r["id"], r["upstream_split"]) for r in got.collect()) == [(1, "train"), (2, "validation")]
    m = tmp_path / "m.json"
    m.write_text(json.dumps({"version": 1, "cases": [{"id": "b"}, {"id": "a"}]}, indent=1))
    doc = readers.read_manifest(spark, str(m), "version int, cases array<struct<id:string>>", "cases")
    assert sorted(tuple(r) for r in doc.collect()) == [(0, "b"), (1, "a")]


def test_verified_and_publish(spark, tmp_path):
    p = tmp_path / "f.txt"
    p.write_bytes(b"abc")
    digest = hashlib.sha256(b"abc").hexdigest()
    assert readers.verified(spark, str(p), digest, 3) == str(p)
    with pytest.raises(ValueError, match="not the file"):
        readers.verified(spark, str(p), digest, 4)
    df, other = spark.range(5), spark.range(6)
    target = str(tmp_path / "t")
    assert writers.publish(df, target) is True
    assert writers.publish(df, target) is False
    with pytest.raises(FileExistsError):
        writers.publish(other, target)
    assert spark.read.parquet(target).count() == 5


def test_read_parquet_columns(spark, tmp_path):
    spark.range(3).withColumn("x", F.lit(1)).write.parquet(str(tmp_path / "p"))
    assert readers.read_parquet(spark, str(tmp_path / "p"), ["x"]).columns == ["x"]
    with pytest.raises(ValueError, match="missing"):
        readers.read_parquet(spark, str(tmp_path / "p"), ["y"])
    with pytest.raises(ValueError, match="forbidden"):
        readers.read_parquet(spark, str(tmp_path / "p"), ["x"], forbidden=["x"])


def test_new_files_are_processed_once(spark, tmp_path):
    src, out, log = (str(tmp_path / x) for x in ("src", "out", "log"))
    spark.range(4).write.parquet(src)
    schema = spark.read.parquet(src).schema
    step = lambda s: s.where("id % 2 = 0")
    flows.process_new_files(spark, src, schema, step, out, log).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    spark.range(10, 14).write.mode("append").parquet(src)
    flows.process_new_files(spark, src, schema, step, out, log).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [0, 2, 10, 12]
