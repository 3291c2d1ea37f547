"""Ranking, caps, sampling and splits by running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import metrics, select
from loomwright.plans.registry import query
from loomwright.session import table


@query("family_top_k", "select o_orderkey, rank from (select o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 3")
def family_top_k(spark: SparkSession, d: str) -> DataFrame:
    return select.top_k(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3, rank="rank").select("o_orderkey", "rank")


@query("repository_caps", "select repository_split_group, count(*) as n, greatest(0, count(*) - max(case when projected_split = 'train' then 40 else 20 end)) as overflow from pr_candidate group by 1")
def repository_caps(spark: SparkSession, d: str) -> DataFrame:
    cap = F.when(F.col("projected_split") == "train", 40).otherwise(20)
    return select.capped(table(spark, d, "pr_candidate"), ["repository_split_group"], [F.col("candidate_seq")], cap)[1]


@query("capped_rows", "select candidate_seq from (select candidate_seq, row_number() over (partition by repository_split_group order by sha256('cap' || chr(0) || candidate_seq), candidate_seq) as n from pr_candidate) where n <= 25")
def capped_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pr_candidate").select("candidate_seq", "repository_split_group")
    order = [select.hash_order("cap", F.col("candidate_seq")), F.col("candidate_seq")]
    return select.capped(rows, ["repository_split_group"], order, F.lit(25))[0].select("candidate_seq")


@query(
    "weighted_proposal",
    """with s as (select doc_id, kind, 6 * (repository is not null)::int + 4 * (lang is not null)::int + 4 * (length(text) between 200 and 4000)::int + 3 * (source is not null)::int + 2 * contains(text, 'error')::int as score from documents where text is not null)
       select kind, doc_id, score, n as place from (select *, row_number() over (partition by kind order by score desc, sha256('prop' || chr(0) || doc_id), doc_id) as n from s) where n <= 50""",
)
def weighted_proposal(spark: SparkSession, d: str) -> DataFrame:
    one = lambda c: c.cast("int")
    score = 6 * one(F.col("repository").isNotNull()) + 4 * one(F.col("lang").isNotNull()) + 4 * one(F.length("text").between(200, 4000)) + 3 * one(F.col("source").isNotNull()) + 2 * one(F.col("text").contains("error"))
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "kind", score.alias("score"))
    return select.top_k(docs, ["kind"], [F.desc("score"), select.hash_order("prop", F.col("doc_id")), F.col("doc_id")], 50, rank="place").select("kind", "doc_id", "score", "place")


@query("hash_sample", "select o_orderkey from orders where (('0x' || substr(sha256('sample' || chr(0) || o_orderkey), 1, 8))::bigint % 100) < 12")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return select.hash_sample(table(spark, d, "orders").select("o_orderkey"), "sample", F.col("o_orderkey"), 12)


@query(
    "round_robin_sample",
    """with r as (select o_orderkey, o_custkey, o_orderstatus, row_number() over (partition by o_orderstatus, o_custkey order by o_totalprice desc, o_orderkey) as r from orders),
       p as (select *, row_number() over (partition by o_orderstatus order by r, sha256('rr' || chr(0) || o_custkey), o_custkey) as p from r)
       select o_orderstatus, o_orderkey from p where p <= 400""",
)
def round_robin_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    out = select.round_robin(rows, "o_custkey", select.hash_order("rr", F.col("o_custkey")), [F.desc("o_totalprice"), F.col("o_orderkey")], 400, within="o_orderstatus")
    return out.select("o_orderstatus", "o_orderkey")


@query(
    "round_robin_global",
    """with r as (select id, problem_id, row_number() over (partition by problem_id order by id) as r from pair_source_b where problem_id is not null)
       select id from r order by r, sha256('rr' || chr(0) || problem_id), problem_id, id limit 250""",
)
def round_robin_global(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pair_source_b").where("problem_id is not null").select("id", "problem_id")
    return select.round_robin(rows, "problem_id", select.hash_order("rr", F.col("problem_id")), [F.col("id")], 250).select("id")


@query("stratum_prefix", "select c_custkey from (select c_custkey, c_mktsegment, row_number() over (partition by c_mktsegment order by sha256('st' || chr(0) || c_custkey), c_custkey) as n from customer) where n <= case c_mktsegment when 'BUILDING' then 40 when 'AUTOMOBILE' then 20 when 'MACHINERY' then 100000 else 0 end")
def stratum_prefix(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return select.stratum_prefix(rows, "c_mktsegment", [select.hash_order("st", F.col("c_custkey")), F.col("c_custkey")], {"BUILDING": 40, "AUTOMOBILE": 20, "MACHINERY": 100000})[0].select("c_custkey")


@query("stratum_shortfall", "with c as (select c_mktsegment as s, count(*) as n from customer group by 1), q(s, w) as (values ('BUILDING', 40), ('AUTOMOBILE', 20), ('MACHINERY', 100000)) select q.s as stratum, w::bigint as wanted, w - coalesce(n, 0) as missing from q left join c on c.s = q.s where w > coalesce(n, 0)")
def stratum_shortfall(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return select.stratum_prefix(rows, "c_mktsegment", [F.col("c_custkey")], {"BUILDING": 40, "AUTOMOBILE": 20, "MACHINERY": 100000})[1]


@query("quota_fill", """with a as (select * from (select *, row_number() over (partition by repository order by sha256('q' || chr(0) || doc_id), doc_id) as n from documents where kind = 'issue_report') where n = 1),
    c1 as (select doc_id, repository from a order by sha256('q' || chr(0) || doc_id), doc_id limit 30),
    b as (select * from (select *, row_number() over (partition by repository order by sha256('q' || chr(0) || doc_id), doc_id) as n from documents x where kind = 'diff' and not exists (select 1 from c1 where c1.repository = x.repository)) where n = 1),
    c2 as (select doc_id from b order by sha256('q' || chr(0) || doc_id), doc_id limit 20)
    select doc_id, 'issues' as cell from c1 union all select doc_id, 'diffs' from c2""")  # fmt: skip
def quota_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "repository", "kind")
    order = [select.hash_order("q", F.col("doc_id")), F.col("doc_id")]
    return select.quota_fill(rows, "doc_id", "repository", order, [("issues", F.col("kind") == "issue_report", 30), ("diffs", F.col("kind") == "diff", 20)])


@query(
    "cumulative_split",
    """with g as (select s_nationkey as g, count(*) as n from supplier group by 1),
       o as (select g, n, row_number() over (order by sha256('cum' || chr(0) || g), g) - 1 as i, coalesce(sum(n) over (order by sha256('cum' || chr(0) || g), g rows between unbounded preceding and 1 preceding), 0) as s, sum(n) over () as t from g),
       e0 as (select coalesce(min(i), (select max(i) + 1 from o)) as i from o where i >= 4 and s >= ceil(t * 0.2 - 1e-9)),
       s0 as (select coalesce((select s from o, e0 where o.i = e0.i), (select max(t) from o)) as s),
       e1 as (select coalesce(min(o.i), (select max(i) + 1 from o)) as i from o, e0, s0 where o.i >= e0.i and o.i - e0.i >= 3 and o.s - s0.s >= ceil(o.t * 0.15 - 1e-9))
       select g, n, case when o.i < e0.i then 'heldout' when o.i < e1.i then 'validation' else 'train' end as split from o, e0, e1""",
)
def cumulative_split(spark: SparkSession, d: str) -> DataFrame:
    groups = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    return select.cumulative_split(groups, [select.hash_order("cum", F.col("g")), F.col("g")], "n", [("heldout", 4, 0.2), ("validation", 3, 0.15)], "train").select("g", "n", "split")


@query(
    "best_worst_pair",
    """with r as (select l_orderkey, l_linenumber, l_returnflag as a, l_quantity as b, row_number() over (partition by l_orderkey order by l_returnflag desc, l_quantity desc, l_linenumber) as hi, row_number() over (partition by l_orderkey order by l_returnflag, l_quantity, l_linenumber) as lo from lineitem)
       select h.l_orderkey, h.l_linenumber as best_index, w.l_linenumber as worst_index from r h join r w on h.l_orderkey = w.l_orderkey and h.hi = 1 and w.lo = 1 where (h.a, h.b) <> (w.a, w.b)""",
)
def best_worst_pair(spark: SparkSession, d: str) -> DataFrame:
    return select.best_and_worst(table(spark, d, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_quantity"], "l_linenumber")


@query("constrained_winner", "select p_partkey, p_retailprice from part where p_size between 10 and 20 and p_retailprice < 1000 order by p_retailprice desc, p_partkey limit 1")
def constrained_winner(spark: SparkSession, d: str) -> DataFrame:
    eligible = F.col("p_size").between(10, 20) & (F.col("p_retailprice") < 1000)
    return select.winner(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), eligible, [F.desc("p_retailprice"), F.col("p_partkey")], [F.col("p_partkey")]).select("p_partkey", "p_retailprice")


@query(
    "completed_prefix",
    """with g as (select l_orderkey, min(case when not l_quantity > 5 then l_linenumber end) as gap from lineitem group by 1)
       select l.l_orderkey, count(*) filter (gap is null or l_linenumber < gap) as prefix, count(*) filter (not (gap is null or l_linenumber < gap) and l_quantity > 5) as after_gap from lineitem l join g using (l_orderkey) group by 1""",
)
def completed_prefix(spark: SparkSession, d: str) -> DataFrame:
    return select.completed_prefix(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", F.col("l_quantity") > 5)


@query("capacity_bound", """with g as (select projected_split as part, repository_split_group as g, count(*) as n from pr_candidate where projected_split is not null group by 1, 2)
    select part, count(*) as groups, sum(n)::bigint as rows, sum(least(2 * n, case part when 'train' then 40 when 'validation' then 20 else 10 end))::bigint as bound from g group by 1""")  # fmt: skip
def capacity_bound(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pr_candidate").where("projected_split is not null").select(F.col("projected_split").alias("part"), F.col("repository_split_group").alias("g"))
    return metrics.capacity_bound(rows, "part", "g", 2, {"train": 40, "validation": 20, "test": 10})


@query(
    "suite_partition",
    """with r as (select l_orderkey, l_linenumber, l_returnflag <> 'N' as fb, l_linestatus = 'F' as pa from lineitem),
       w as (select *, row_number() over (partition by l_orderkey, fb and pa order by l_linenumber) as i, count(*) over (partition by l_orderkey, fb and pa) as n from r)
       select l_orderkey, l_linenumber, case when fb and pa then case when i <= case when n >= 2 then least(n - 1, greatest(1, (n + 4) // 5)) else 0 end then 'public' else 'hidden' end when not fb and pa then 'regression' end as suite from w""",
)
def suite_partition(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return metrics.test_partition(rows, "l_orderkey", [F.col("l_linenumber")], F.col("l_returnflag") != "N", F.col("l_linestatus") == "F").select("l_orderkey", "l_linenumber", "suite")
