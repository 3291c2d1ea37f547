"""Sources, sinks, streams and SQL access: rows written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright import catalog
from loomwright.operators import metrics
from loomwright.plans.registry import query
from loomwright.session import checkpoint_folder, keep_until_end, table
from loomwright.sources import readers, writers
from loomwright.streaming import flows


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which is deleted when the driver ends."""
    path = f"{checkpoint_folder(spark).rstrip('/')}/loomwright-{name}-{uuid.uuid4().hex}"
    keep_until_end(spark, path)
    return path


@query("jsonl_round_trip", "select doc_id, lang, kind, n_chars, sha256(text) as hash from documents")
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents as sorted JSON lines, and read back under a schema."""
    path = _folder(spark, "jsonl")
    writers.write_jsonl(table(spark, d, "documents").select("doc_id", "lang", "kind", "n_chars", "text"), path, ["doc_id"])
    rows = readers.read_jsonl(spark, path, "doc_id long, lang string, kind string, n_chars long, text string")
    return rows.select("doc_id", "lang", "kind", "n_chars", F.sha2("text", 256).alias("hash"))


@query("sorted_lines", """select event_id, '{"k":' || (props->>'k') || ',"nested":[{"a":' || user_id || ',"b":"x"}]}' as value from events""")
def sorted_lines(spark: SparkSession, d: str) -> DataFrame:
    """JSON with sorted fields at every depth."""
    inner = F.array(F.struct(F.lit("x").alias("b"), F.col("user_id").alias("a")))
    rows = table(spark, d, "events").select("event_id", inner.alias("nested"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    fields = {f.name: f.dataType for f in rows.schema.fields}
    value = F.to_json(F.struct(*[writers.sorted_fields(F.col(n), fields[n]).alias(n) for n in ("k", "nested")]), {"ignoreNullFields": "false"})
    return rows.select("event_id", value.alias("value"))


@query("malformed_line_numbers", "select row_number() over (order by doc_id) as line_no, doc_id from documents qualify doc_id % 13 = 0")
def malformed_line_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The numbers of the malformed lines of a file that is read in blocks; every thirteenth line has its number only."""
    path = _folder(spark, "lines")
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 13 == 0, F.col("doc_id").cast("string")).otherwise(F.to_json(F.struct("doc_id", "text"))).alias("value"))
    rows.repartition(1).sortWithinPartitions("doc_id").select("value").write.text(path)
    lines = readers.numbered_lines(spark, path)
    return readers.malformed_lines(lines).join(lines, ["file", "line_no"]).select("line_no", F.col("raw").cast("long").alias("doc_id"))


@query("published_rows", "select p_partkey, p_name, p_size from part")
def published_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows published once; publishing them again changes nothing."""
    path = _folder(spark, "published")
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    first, again = writers.publish(rows, path), writers.publish(rows, path)
    if not first or again:
        raise RuntimeError("published twice")
    return readers.read_parquet(spark, path, ["p_partkey", "p_name", "p_size"], rows=rows.count())


@query("manifest_check", "select 0 as changed, true as all_hashed")
def manifest_check(spark: SparkSession, d: str) -> DataFrame:
    """A manifest of published files against the files."""
    path = _folder(spark, "manifest")
    said = writers.publish_with_manifest(table(spark, d, "nation"), path)
    changed = writers.changed_files(spark, path, said)
    return said.agg(F.bool_and(F.col("sha256").rlike("^[0-9a-f]{64}$")).alias("all_hashed")).select(F.lit(1).alias("one"), "all_hashed").join(changed.agg(F.count(F.lit(1)).alias("changed"), F.lit(1).alias("one")), "one").select("changed", "all_hashed")


@query("freeze_lock", "select lang, kind, count(*) as rows, sha256(string_agg(doc_id::varchar, chr(10) order by doc_id::varchar) || chr(10)) as hash from documents group by 1, 2")
def freeze_lock(spark: SparkSession, d: str) -> DataFrame:
    """The composition of a set with a hash of each part's ids."""
    return writers.freeze(table(spark, d, "documents"), ["lang", "kind"], "doc_id")


@query("set_hash", "select sha256(string_agg(x, chr(10) order by x) || chr(10)) as hash from (select distinct o_orderkey::varchar as x from orders)")
def set_hash(spark: SparkSession, d: str) -> DataFrame:
    """The hash of a whole set, from a sorted stream."""
    return metrics.set_fingerprint(table(spark, d, "orders"), "o_orderkey")


@query("streamed_files", "select event_id, user_id, value from events where value > 50")
def streamed_files(spark: SparkSession, d: str) -> DataFrame:
    """A step over files as a stream, each file once: the second run has nothing left to do."""
    source, target, log = (_folder(spark, n) for n in ("stream-in", "stream-out", "stream-log"))
    events = table(spark, d, "events").select("event_id", "user_id", "value")
    events.write.parquet(source)
    for _ in range(2):
        flows.process_new_files(spark, source, events.schema, lambda x: x.where("value > 50"), target, log).awaitTermination()
    return spark.read.schema(events.schema).parquet(target)


@query("streamed_first_seen", "select distinct user_id from events")
def streamed_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Keys that a stream has not seen within its watermark."""
    source, target, log = (_folder(spark, n) for n in ("seen-in", "seen-out", "seen-log"))
    events = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    events.write.parquet(source)
    flows.process_new_files(spark, source, events.schema, lambda x: flows.first_seen(x, "user_id", "at", "3650 days").select("user_id"), target, log).awaitTermination()
    return spark.read.schema("user_id long").parquet(target)


@query("windowed_counts", "select time_bucket(interval 1 day, ts::timestamp) as window_start, event_type, count(*) as n from events group by 1, 2")
def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of tumbling windows; the flow is the same over rows that are all there."""
    rows = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return flows.windowed_counts(rows, "at", "1 day", "event_type").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("sql_access", """select o_orderkey, regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '', 'g') as bare, ('0x' || substr(sha256('s' || chr(0) || o_orderkey), 1, 8))::bigint % 100 as bucket from orders""")
def sql_access(spark: SparkSession, d: str) -> DataFrame:
    """The library's functions in plain SQL."""
    catalog.register_all(spark)
    catalog.register_views(spark, d, ["orders"])
    return spark.sql("select o_orderkey, bare_name(o_orderpriority) as bare, hash_bucket('s', cast(o_orderkey as string)) as bucket from orders")


@query("brace_rows", "select l_orderkey, l_linenumber, k::int as first, (2 * l_linenumber - k + 1)::int as last from lineitem, unnest(range(2, l_linenumber + 1)) r(k)")
def brace_rows(spark: SparkSession, d: str) -> DataFrame:
    """Brace spans as rows of a table function: nested blocks, a brace on each line."""
    catalog.register_all(spark)
    catalog.register_views(spark, d, ["lineitem"])
    return spark.sql("select l_orderkey, l_linenumber, s.first, s.last from lineitem, lateral brace_span_rows(concat(repeat('{\n', cast(l_linenumber as int)), repeat('}\n', cast(l_linenumber as int)))) s")


@query("needed_assets", "select repository as name, language as kind, case when archived then 'old' else 'new' end as split from repository_item where repository in ('x') or (language in ('C', 'C++') and case when archived then 'old' else 'new' end = 'new')")
def needed_assets(spark: SparkSession, d: str) -> DataFrame:
    """The rows of a manifest that are needed."""
    rows = table(spark, d, "repository_item").select(F.col("repository").alias("name"), F.col("language").alias("kind"), F.when(F.col("archived"), "old").otherwise("new").alias("split"))
    return readers.select_assets(rows, ["x"], "kind", "split", ["C", "C++"], ["new"])
