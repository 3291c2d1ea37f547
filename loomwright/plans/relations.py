"""Joins, set operations and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import keys as k
from loomwright.operators import joins
from loomwright.plans.registry import query
from loomwright.session import table
from loomwright.sources.readers import cached_responses, month_windows, union_sources


@query("key_coverage", "with a as (select distinct problem_id from pair_source_b where problem_id is not null), b as (select distinct lower(problem_id) as problem_id from tests where problem_id is not null) select count(*) filter (a.problem_id is not null and b.problem_id is not null) as both, count(*) filter (b.problem_id is null) as only_left, count(*) filter (a.problem_id is null) as only_right from a full join b on a.problem_id = b.problem_id")
def key_coverage(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "pair_source_b").where("problem_id is not null")
    t = table(spark, d, "tests").where("problem_id is not null").select(F.lower("problem_id").alias("problem_id"))
    return joins.key_coverage(b, t, "problem_id")


@query("duplicate_keys", "select candidate_id, count(*) as n from pr_candidate group by 1 having count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return joins.duplicate_keys(table(spark, d, "pr_candidate"), ["candidate_id"])


@query(
    "exclusion_reasons",
    """with t as (select distinct lower(problem_id) as p from tests), s as (select distinct problem_id as p from pr_candidate where projected_split = 'test'),
       x as (select b.id, case when s.p is not null then 'held_out' when t.p is null then 'no_tests' end as reason from pair_source_b b left join s on b.problem_id = s.p left join t on b.problem_id = t.p)
       select coalesce(reason, 'kept') as reason, count(*) as n from x group by 1""",
)
def exclusion_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Anti-joins whose losses are counted: held-out problems first, then problems without tests."""
    rows = table(spark, d, "pair_source_b").select("id", "problem_id")
    held = table(spark, d, "pr_candidate").where("projected_split = 'test'")
    tested = table(spark, d, "tests").select(F.lower("problem_id").alias("p"), F.lit(True).alias("tested")).distinct()
    marked = joins.flagged(rows, {"held_out": (held, "problem_id", "problem_id")}).join(tested, F.col("problem_id") == F.col("p"), "left")
    reason = F.coalesce("reason", F.when(F.col("tested").isNull(), "no_tests"), F.lit("kept"))
    return marked.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("lookup_default", "with t as (select lower(problem_id) as p, count(*) as tests from tests group by 1) select b.id, coalesce(t.tests, 0) as tests from pair_source_b b left join t on b.problem_id = t.p")
def lookup_default(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "tests").where("problem_id is not null").groupBy(F.lower("problem_id").alias("problem_id")).agg(F.count(F.lit(1)).alias("tests"))
    return joins.lookup(table(spark, d, "pair_source_b").select("id", "problem_id"), counts, "problem_id", "tests", 0).select("id", "tests")


@query("semi_testable", "select id from pair_source_b where problem_id in (select lower(problem_id) from tests where problem_id is not null and input is not null)")
def semi_testable(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tests").where("input is not null").select(F.lower("problem_id").alias("problem_id"))
    return table(spark, d, "pair_source_b").join(t, "problem_id", "left_semi").select("id")


@query("anti_contaminated", "select doc_id from documents where repository is null or repository not in (select repository from pr_candidate c join repository_item r on lower(c.repository_split_group) = r.repository where projected_split = 'test')")
def anti_contaminated(spark: SparkSession, d: str) -> DataFrame:
    test = table(spark, d, "pr_candidate").where("projected_split = 'test'").select(F.lower("repository_split_group").alias("repository"))
    known = test.join(table(spark, d, "repository_item").select("repository"), "repository", "left_semi").distinct()
    return table(spark, d, "documents").join(known, "repository", "left_anti").select("doc_id")


@query(
    "row_differences",
    """with a as (select id, code_lines, prompt_tokens from pair_source_b where id % 7 <> 0), b as (select id, case when id % 5 = 0 then 0 else code_lines end as code_lines, prompt_tokens from pair_source_b where id % 11 <> 0)
       select id, case when b.id is null then 'missing' when a.id is null then 'extra' else 'changed' end as status from a full join b using (id) where b.id is null or a.id is null or (a.code_lines, a.prompt_tokens) is distinct from (b.code_lines, b.prompt_tokens)""",
)
def row_differences(spark: SparkSession, d: str) -> DataFrame:
    """Two editions of a table, keyed: rows lost, new and changed. The second edition stands in for a rerun."""
    rows = table(spark, d, "pair_source_b").select("id", "code_lines", "prompt_tokens")
    second = rows.where("id % 11 <> 0").withColumn("code_lines", F.when(F.col("id") % 5 == 0, 0).otherwise(F.col("code_lines")))
    return joins.row_differences(rows.where("id % 7 <> 0"), second, ["id"], ["code_lines", "prompt_tokens"])


@query("merge_caches", """with a as (select o_orderkey as k, o_orderpriority as v from orders where o_orderkey % 3 <> 0), b as (select o_orderkey as k, case when o_orderkey % 10 = 1 then 'other' else o_orderpriority end as v from orders where o_orderkey % 4 <> 0)
    select k, case when a.k is not null then a.v else b.v end as v, a.k is not null and b.k is not null and a.v is distinct from b.v as conflict from a full join b using (k)""")  # fmt: skip
def merge_caches(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("v"))
    other = o.where("k % 4 <> 0").withColumn("v", F.when(F.col("k") % 10 == 1, "other").otherwise(F.col("v")))
    return joins.merge_caches(o.where("k % 3 <> 0"), other, "k", "v")


@query("pending_work", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def pending_work(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.pending(table(spark, d, "customer").select("c_custkey"), done, ["c_custkey"])


@query(
    "three_way_reconcile",
    """with x as (select 'a' as s, c_custkey as k, c_nationkey::varchar as v from customer union all select 'b', s_suppkey, s_nationkey::varchar from supplier union all select 'c', p_partkey, (p_partkey % 25)::varchar from part)
       select k as key, count(distinct s) = 3 and count(distinct v) <= 1 as agree, count(distinct s) as present from x group by 1""",
)
def three_way_reconcile(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("v"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("v"))
    c = table(spark, d, "part").select(F.col("p_partkey").alias("key"), (F.col("p_partkey") % 25).alias("v"))
    return joins.reconcile({"a": a, "b": b, "c": c}, "key", "v")


@query("denylist_reason", r"""with n as (select repository, regexp_replace(lower(split_part(repository, '/', 3)), '[^a-z0-9]+', '', 'g') as bare, regexp_extract_all(repository, '[a-z0-9]+') as t from repository_item)
    select repository, case when repository in ('forge.example/quillforge/lattice-core') then 'exact' when bare in ('minify', 'codegenkit') then 'alias' when list_has_any(t, ['lib', 'timer']) then 'token' end as reason from n""")  # fmt: skip
def denylist_reason(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("repository")
    words = F.regexp_extract_all(name, F.lit("([a-z0-9]+)"), F.lit(1))
    return table(spark, d, "repository_item").select(name, joins.denied_by(name, words, ["forge.example/quillforge/lattice-core"], ["minify", "codegenkit"], ["lib", "timer"]).alias("reason"))


@query("substring_denylist", "select doc_id from documents where contains(text, 'segmentation') or contains(text, 'undefined reference') or contains(text, 'FAILED')")
def substring_denylist(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(joins.contains_any(F.col("text"), ["segmentation", "undefined reference", "FAILED"])).select("doc_id")


@query("union_with_provenance", "select 'commits' as source, pair_id as id, repository as family, null as problem from pair_source_a union all select 'submissions', id, null, problem_id from pair_source_b")
def union_with_provenance(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "pair_source_a").select(F.lit("commits").alias("source"), F.col("pair_id").alias("id"), F.col("repository").alias("family"))
    b = table(spark, d, "pair_source_b").select(F.lit("submissions").alias("source"), "id", F.col("problem_id").alias("problem"))
    return union_sources(a, b).select("source", "id", "family", "problem")


@query("intersect_repositories", "select repository from documents where repository is not null intersect select repository from repository_item")
def intersect_repositories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("repository is not null").select("repository").intersect(table(spark, d, "repository_item").select("repository"))


@query("union_of_sets", "select lang from documents union select lang from pair_source_a")
def union_of_sets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("lang").union(table(spark, d, "pair_source_a").select("lang")).distinct()


@query("multiset_difference", "select problem_id from pair_source_b except all select lower(problem_id) from tests")
def multiset_difference(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pair_source_b").select("problem_id").exceptAll(table(spark, d, "tests").select(F.lower("problem_id").alias("problem_id")))


@query("cached_requests", """with c1 as (select c_custkey as k, c_name as v from customer where c_custkey % 2 = 0), c2 as (select c_custkey as k, 'old ' || c_name as v from customer where c_custkey % 3 = 0)
    select k, coalesce(c1.v, c2.v) as v from (select c_custkey as k from customer) r left join c1 using (k) left join c2 using (k) where coalesce(c1.v, c2.v) is not null""")  # fmt: skip
def cached_requests(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    return cached_responses(c.select("k"), [c.where("k % 2 = 0"), c.where("k % 3 = 0").withColumn("v", F.concat(F.lit("old "), "v"))], ["k"], "v")[0]


@query("month_windows", """with s as (select unnest(generate_series(date '2019-01-01', date '2021-05-20', interval 3 month))::date as a) select a as start, least(date '2021-05-20', (a + interval 3 month - interval 1 day)::date) as "end", sort from s, (values ('created'), ('updated')) o(sort)""")
def month_windows_q(spark: SparkSession, d: str) -> DataFrame:
    return month_windows(spark, "2019-01-01", "2021-05-20", 3, ["created", "updated"])


@query("canonical_names", r"""select pair_id, case when len(p) >= 3 then array_to_string(p[-3:], '/') end as name from (select pair_id, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(repository)), '^[a-z+]+://([^/@]*@)?', ''), '^git@([^:/]+):', '\1/'), '^/+|/+$', '', 'g'), '\.git$', ''), '/') as p from pair_source_a)""")
def canonical_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pair_source_a").select("pair_id", k.canonical_repository(F.col("repository")).alias("name"))
