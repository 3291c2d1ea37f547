"""Sinks: deterministic JSON lines, atomic and write-once publication, inventories."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.sources.readers import file_hashes


def sorted_fields(c: Column, kind: T.DataType) -> Column:
    """A value with the fields of all its structs in the order of their names, at any depth; map keys too."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(c.isNotNull(), F.struct(*[sorted_fields(c[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: sorted_fields(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(c, lambda _, v: sorted_fields(v, kind.valueType)))))
    return c


def json_lines(df: DataFrame) -> DataFrame:
    """``value``: each row as JSON with sorted keys at every depth, nulls kept, characters above ASCII as they are."""
    columns = [sorted_fields(F.col(f.name), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str, order: Sequence[str], one_file: bool = False) -> None:
    """Sorted JSON lines, refusing to overwrite. The sort is global, over range partitions; one file only if asked."""
    lines = json_lines(df.orderBy(*order)) if not one_file else json_lines(df.orderBy(*order)).coalesce(1)
    lines.write.mode("errorifexists").text(path)


def _fs(spark: SparkSession, path: str) -> tuple[object, object]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def publish(df: DataFrame, path: str) -> bool:
    """Writes Parquet beside ``path`` and renames it there: readers see all of it or nothing.

    False, and nothing changed, if the same rows are there already (a job that is run again); an error if others are.
    """
    spark = df.sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target):
        have = spark.read.parquet(path)
        if have.schema.simpleString() != df.schema.simpleString() or not have.exceptAll(df).isEmpty() or not df.exceptAll(have).isEmpty():
            raise FileExistsError(f"{path} holds other rows")
        return False
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    df.write.parquet(beside)
    if not fs.rename(_fs(spark, beside)[1], target):
        fs.delete(_fs(spark, beside)[1], True)
        raise FileExistsError(f"{path} came into being meanwhile")
    return True


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(line): ``hash  file`` of each file under a folder, by name, as checksum tools print them."""
    rows = file_hashes(spark, path).select(F.concat_ws("  ", "sha256", F.element_at(F.split("file", "/"), -1)).alias("line"), "file")
    return rows.orderBy("file").select("line")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of the data files under a folder, by name."""
    rows = file_hashes(spark, path).select(F.element_at(F.split("file", "/"), -1).alias("file"), "bytes", "sha256")
    return rows.where(~F.col("file").startswith("_") & ~F.col("file").startswith(".")).orderBy("file")


def publish_with_manifest(df: DataFrame, path: str) -> DataFrame:
    """``publish`` and the manifest of what was published, written beside it as JSON lines; the manifest comes back."""
    spark = df.sparkSession
    if publish(df, path):
        write_jsonl(manifest(spark, path), f"{path.rstrip('/')}.manifest", ["file"], one_file=True)
    return spark.read.schema("file string, bytes long, sha256 string").json(f"{path.rstrip('/')}.manifest")


def changed_files(spark: SparkSession, path: str, said: DataFrame) -> DataFrame:
    """(file, status) of files that aren't as their manifest says: ``missing``, ``unexpected`` or ``changed``."""
    now = manifest(spark, path).select("file", F.struct("bytes", "sha256").alias("is"))
    j = said.select("file", F.struct("bytes", "sha256").alias("was")).join(now, "file", "full")
    status = F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "unexpected").when(F.col("is") != F.col("was"), "changed")
    return j.select("file", status.alias("status")).where("status is not null")


def freeze(df: DataFrame, parts: Sequence[str], ident: str) -> DataFrame:
    """(parts..., rows, hash): the composition of a set, with the hash of each part's ids. Equal locks mean equal sets."""
    from loomwright.operators.metrics import set_fingerprint
    from loomwright.operators.totals import join_nulls

    counts = df.groupBy(*parts).agg(F.count(F.lit(1)).alias("rows"))
    return join_nulls(counts, set_fingerprint(df, ident, parts), parts)
