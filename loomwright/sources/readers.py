"""Typed readers: JSON lines (also gzip shards), manifests, Parquet, and inputs bound to a hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines under a schema. Strict: a malformed line ends the job. Else it comes as a row with ``_corrupt``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    s = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    full = T.StructType([*s.fields, T.StructField("_corrupt", T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no from 1, raw) of text files of any size, whose lines end in LF.

    A file is read in blocks, as any text is. A first pass counts each block's lines; the counts of the blocks before
    (a row for each) give a block's first number, and a line's place in its block the rest.
    """
    meta = F.col("_metadata")
    rows = spark.read.option("lineSep", "\n").text(path).select(meta["file_path"].alias("path"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    blocks = rows.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("path", "block", "first", F.coalesce(before, F.lit(0)).alias("base"))
    number = F.col("base") + F.col("id") - F.col("first") + 1
    return rows.join(starts, ["path", "block"]).select(F.element_at(F.split("path", "/"), -1).alias("file"), number.alias("line_no"), F.col("value").alias("raw"))


def strict_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """JSON lines under a schema; an error that names file and line of the first malformed ones before anything is read."""
    bad = malformed_lines(numbered_lines(spark, path)).orderBy("file", "line_no").limit(5).collect()
    if bad:
        raise ValueError("no JSON object: " + ", ".join(f"{r['file']}:{r['line_no']}" for r in bad))
    return read_jsonl(spark, path, schema)


def malformed_lines(lines: DataFrame) -> DataFrame:
    """(file, line_no) of numbered lines that are no JSON object."""
    good = F.col("raw").rlike(r"^\s*\{") & F.expr("try_parse_json(raw)").isNotNull()
    return lines.where(~F.coalesce(good, F.lit(False))).select("file", "line_no")


def unknown_fields(raw: Column, known: Sequence[str]) -> Column:
    """Sorted top-level fields of a JSON text that aren't known."""
    return F.array_sort(F.array_except(F.json_object_keys(raw), F.array(*[F.lit(k) for k in known])))


def read_shards(spark: SparkSession, path: str, schema: T.StructType | str, source: str, splits: dict[str, str]) -> DataFrame:
    """Gzip or plain shards with ``source``, ``shard`` and ``upstream_split`` (by what the file's name contains).

    Gzip can't be divided, so a shard is one task's read; where there are fewer files than cores, rows are spread again
    right after it, for what follows to run on all of them.
    """
    df = spark.read.schema(schema).json(path).withColumn("shard", F.col("_metadata.file_name")).withColumn("source", F.lit(source))
    cores = spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) < cores:
        df = df.repartition(cores)
    split = F.lit(None).cast("string")
    for part, name in reversed(list(splits.items())):
        split = F.when(F.col("shard").contains(part), name).otherwise(split)
    return df.withColumn("upstream_split", split)


def union_sources(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def read_manifest(spark: SparkSession, path: str, schema: T.StructType | str, rows: str) -> DataFrame:
    """The elements of an array field of one JSON document, with their place as ``ord``."""
    doc = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    return doc.select(F.posexplode(rows).alias("ord", "x")).select("ord", "x.*")


def file_hashes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, bytes, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verified(spark: SparkSession, path: str, sha256: str, size: int | None = None) -> str:
    """The path, if the file's hash (and size) is the one given; else an error."""
    got = file_hashes(spark, path).collect()
    if len(got) != 1 or got[0]["sha256"] != sha256 or (size is not None and got[0]["bytes"] != size):
        raise ValueError(f"{path} is not the file it should be")
    return path


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str], forbidden: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Only the columns asked for; missing or forbidden ones, or another number of rows than said, are an error before
    anything is read (the count comes from the files' footers)."""
    df = spark.read.parquet(path)
    missing, banned = sorted(set(columns) - set(df.columns)), sorted(set(columns) & set(forbidden))
    if missing or banned:
        raise ValueError(f"missing columns {missing}, forbidden columns {banned}")
    if rows is not None and (have := df.count()) != rows:
        raise ValueError(f"{have} rows, not {rows}")
    return df.select(*columns)


def select_assets(manifest: DataFrame, always: Sequence[str], kind: str, split: str, kinds: Sequence[str], splits: Sequence[str]) -> DataFrame:
    """The rows of a manifest (name, kind, split) that are needed: names that always are, and the kinds and splits asked for."""
    return manifest.where(F.col("name").isin(*always) | (F.col(kind).isin(*kinds) & F.col(split).isin(*splits)))


def month_windows(spark: SparkSession, first: str, last: str, months: int, orders: Sequence[str]) -> DataFrame:
    """(start, end, sort): windows of some months from ``first`` to ``last`` (both included), each with every order."""
    d = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr(f"interval {int(months)} month"))).alias("start"))
    d = d.withColumn("end", F.least(F.lit(last).cast("date"), F.date_sub(F.add_months("start", months), 1)))
    return d.select("start", "end", F.explode(F.array(*[F.lit(o) for o in orders])).alias("sort"))


def cached_responses(requests: DataFrame, caches: Sequence[DataFrame], key: Sequence[str], value: str) -> tuple[DataFrame, DataFrame]:
    """(requests with the first cache's value that has them, requests that no cache has)."""
    out = requests
    names = []
    for i, c in enumerate(caches):
        n = f"_c{i}"
        out = out.join(c.select(*key, F.col(value).alias(n)), list(key), "left")
        names.append(n)
    full = out.withColumn(value, F.coalesce(*names)).drop(*names)
    return full.where(F.col(value).isNotNull()), full.where(F.col(value).isNull()).drop(value)
