"""Data-quality checks: each result holds the violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import assertions as a
from loomwright.plans.registry import query
from loomwright.session import table


@query("expect_counts", """with h as (select projected_split as s, count(*) as n from pr_candidate group by 1), e(s, expected) as (values ('train', 1200), ('test', 150), ('none', 3))
    select coalesce(h.s, e.s) as projected_split, coalesce(n, 0) as n, coalesce(expected, 0)::bigint as expected from h full join e on h.s = e.s where coalesce(n, 0) <> coalesce(expected, 0)""")  # fmt: skip
def expect_counts(spark: SparkSession, d: str) -> DataFrame:
    want = spark.createDataFrame([("train", 1200), ("test", 150), ("none", 3)], "projected_split string, expected long")
    return a.expect_counts(table(spark, d, "pr_candidate"), ["projected_split"], want)


@query("expect_unique", "select buggy_submission_id, fixed_submission_id, count(*) as n from pair_source_b group by 1, 2 having count(*) > 1")
def expect_unique(spark: SparkSession, d: str) -> DataFrame:
    return a.expect_unique(table(spark, d, "pair_source_b"), ["buggy_submission_id", "fixed_submission_id"])


@query("expect_indices", """with i as (select l_orderkey, l_linenumber - 1 as i, count(*) as c from lineitem group by 1, 2), g as (select l_orderkey, 4 - count(*) filter (i between 0 and 3) as missing, count(*) filter (not i between 0 and 3) as extra, sum(c - 1)::bigint as repeated from i group by 1)
    select * from g where missing > 0 or extra > 0 or repeated > 0""")  # fmt: skip
def expect_indices(spark: SparkSession, d: str) -> DataFrame:
    return a.expect_indices(table(spark, d, "lineitem").withColumn("i", F.col("l_linenumber") - 1), "l_orderkey", "i", 4)


@query("expect_hash", "select doc_id from documents where sha256(text) is distinct from case when doc_id % 9 = 0 then sha256(coalesce(text, '') || 'x') else sha256(text) end")
def expect_hash(spark: SparkSession, d: str) -> DataFrame:
    stored = F.when(F.col("doc_id") % 9 == 0, F.sha2(F.concat(F.coalesce("text", F.lit("")), F.lit("x")), 256)).otherwise(F.sha2("text", 256))
    return a.expect_hash(table(spark, d, "documents").withColumn("stored", stored), ["doc_id"], F.col("text"), F.col("stored"))


@query("expect_disjoint", "select distinct problem_id from pr_candidate where projected_split = 'train' and problem_id in (select problem_id from pr_candidate where projected_split = 'test')")
def expect_disjoint(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "pr_candidate")
    return a.expect_disjoint(c.where("projected_split = 'train'"), c.where("projected_split = 'test'"), "problem_id")


@query("expect_one_value", "select problem_id, count(distinct projected_split) as values, count(*) as n from pr_candidate group by 1 having count(distinct projected_split) > 1 or count(*) > 50")
def expect_one_value(spark: SparkSession, d: str) -> DataFrame:
    return a.expect_one_value(table(spark, d, "pr_candidate"), "problem_id", "projected_split", 50)


@query("expect_same_rows", """with l as (select source, kind, count(*) as n from documents group by 1, 2), r as (select source, kind, count(text) as n from documents group by 1, 2)
    select *, 'left' as side from (select * from l except all select * from r) union all select *, 'right' from (select * from r except all select * from l)""")  # fmt: skip
def expect_same_rows(spark: SparkSession, d: str) -> DataFrame:
    """A stored summary against the one computed again."""
    docs = table(spark, d, "documents")
    return a.expect_same_rows(docs.groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n")), docs.groupBy("source", "kind").agg(F.count("text").alias("n")))


@query("expect_order", """with l as (select doc_id as o, kind as k from documents), r as (select doc_id as o, case when doc_id % 13 = 0 then 'moved' else kind end as k from documents where doc_id % 17 <> 0) select o, l.k as "left", r.k as "right" from l full join r using (o) where l.k is distinct from r.k""")
def expect_order(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("o"), F.col("kind").alias("k"))
    other = docs.where("o % 17 <> 0").withColumn("k", F.when(F.col("o") % 13 == 0, "moved").otherwise(F.col("k")))
    return a.expect_order(docs, "o", "k", other)


@query("prompt_leakage", "select id from pair_source_b where fixed_code is not null and fixed_code <> '' and contains(buggy_code, fixed_code)")
def prompt_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose target stands verbatim in what a prompt would show."""
    return table(spark, d, "pair_source_b").where((F.length("fixed_code") > 0) & F.col("buggy_code").contains(F.col("fixed_code"))).select("id")


@query("stored_sizes", """select id, case when code_lines is null then 'missing' else 'wrong' end as state from (select id, code_lines, length(buggy_code) - length(replace(buggy_code, chr(10), '')) + case when buggy_code <> '' and right(buggy_code, 1) <> chr(10) then 1 else 0 end as real from pair_source_b where buggy_code is not null) where code_lines is distinct from real""")
def stored_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Stored line counts that the text doesn't bear out."""
    t = F.col("buggy_code")
    real = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + F.when((F.length(t) > 0) & ~t.endswith("\n"), 1).otherwise(0)
    rows = table(spark, d, "pair_source_b").where("buggy_code is not null").where(~F.col("code_lines").eqNullSafe(real))
    return rows.select("id", F.when(F.col("code_lines").isNull(), "missing").otherwise("wrong").alias("state"))
