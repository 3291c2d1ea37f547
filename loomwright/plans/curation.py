"""Rules, deduplication, splits and the whole curation flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import keys as k
from loomwright.operators import dedup, select
from loomwright.operators.rules import RuleSet, reject_histogram, stage_chain, violations
from loomwright.operators.splits import hash_split, hash_split_json, prior_split
from loomwright.plans.registry import query
from loomwright.session import table


def doc_rules() -> RuleSet:
    return RuleSet.of(
        ("text_missing", F.col("text").isNull() | (F.col("text") == "")),
        ("language_missing", F.col("lang").isNull()),
        ("repository_missing", F.col("repository").isNull()),
        ("too_short", F.length("text") < 100),
        ("too_long", F.length("text") > 4000),
        ("token_limit", k.token_estimate(F.col("text")) > 1024),
    )


_REASON = """case when text is null or text = '' then 'text_missing' when lang is null then 'language_missing' when repository is null then 'repository_missing'
    when length(text) < 100 then 'too_short' when length(text) > 4000 then 'too_long' when (strlen(text) + 512) // 4 > 1024 then 'token_limit' end"""


@query("first_reasons", f"with r as (select source, {_REASON} as reason from documents) select source, reason, count(*) as n from r where reason is not null group by 1, 2")
def first_reasons(spark: SparkSession, d: str) -> DataFrame:
    return doc_rules().first_counts(table(spark, d, "documents"), "source")


@query(
    "all_reasons",
    """with r as (select kind, list_filter([case when text is null or text = '' then 'text_missing' end, case when lang is null then 'language_missing' end, case when repository is null then 'repository_missing' end,
        case when length(text) < 100 then 'too_short' end, case when length(text) > 4000 then 'too_long' end, case when (strlen(coalesce(text, '')) + 512) // 4 > 1024 then 'token_limit' end], lambda x: x is not null) as rs from documents)
       select kind, reason, count(*) as n from (select kind, unnest(rs) as reason from r) group by 1, 2""",
)
def all_reasons(spark: SparkSession, d: str) -> DataFrame:
    return doc_rules().all_counts(table(spark, d, "documents"), "kind")


@query(
    "row_violations",
    """select pair_id, array_to_string(list_filter([case when not coalesce(regexp_full_match("commit", '[0-9a-f]{40}'), false) then 'commit' end,
        case when new_file is null or new_file = '' then 'path' end, case when old_contents is null then 'old' end, case when new_contents is null then 'new' end,
        case when not coalesce(old_contents <> new_contents, false) then 'unchanged' end, case when not coalesce(committed_at <= ingested_at, false) then 'times' end], lambda x: x is not null), ',') as codes from pair_source_a""",
)
def row_violations(spark: SparkSession, d: str) -> DataFrame:
    checks = {
        "commit": F.col("commit").rlike("^[0-9a-f]{40}$"),
        "path": F.length("new_file") > 0,
        "old": F.col("old_contents").isNotNull(),
        "new": F.col("new_contents").isNotNull(),
        "unchanged": F.col("old_contents") != F.col("new_contents"),
        "times": F.col("committed_at") <= F.col("ingested_at"),
    }
    return table(spark, d, "pair_source_a").select("pair_id", F.array_join(violations(checks), ",").alias("codes"))


@query("exact_dedup_first", "select doc_id, kind from (select doc_id, kind, row_number() over (partition by sha256(text) order by doc_id) as n from documents where text is not null) where n = 1")
def exact_dedup_first(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "kind", F.sha2("text", 256).alias("h"))
    return dedup.first_per_key(docs, ["h"], [F.col("doc_id")]).select("doc_id", "kind")


@query("first_eligible", f"select doc_id, repository from (select doc_id, repository, row_number() over (partition by repository order by doc_id) as n from documents where ({_REASON}) is null) where n = 1")
def first_eligible(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    slim = docs.select("doc_id", "repository", doc_rules().first_reason().alias("r"))
    return dedup.first_eligible(slim, ["repository"], [F.col("doc_id")], F.col("r")).select("doc_id", "repository")


@query(
    "rejects_before_accepted",
    f"""with r as (select doc_id, repository, {_REASON} as reason from documents),
       s as (select *, coalesce(max(case when reason is null then 1 else 0 end) over (partition by repository order by doc_id rows between unbounded preceding and 1 preceding), 0) as done from r)
       select reason, count(*) as n from s where reason is not null and done = 0 group by 1""",
)
def rejects_before_accepted(spark: SparkSession, d: str) -> DataFrame:
    slim = table(spark, d, "documents").select("doc_id", "repository", doc_rules().first_reason().alias("r"))
    return dedup.rejects_before_accepted(slim, ["repository"], [F.col("doc_id")], F.col("r"))


@query(
    "merge_provenance",
    """with o as (select *, row_number() over (partition by candidate_id order by updated_at nulls first, candidate_seq) as n from pr_candidate),
       q as (select candidate_id, unnest(query_ids) as q from pr_candidate),
       u as (select candidate_id, array_to_string(list_sort(list_distinct(list(q))), ',') as queries from q group by 1)
       select o.candidate_id, o.candidate_seq, o.pr_number, coalesce(u.queries, '') as queries from o left join u using (candidate_id) where n = 1 and o.candidate_id is not null""",
)
def merge_provenance(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pr_candidate").where("candidate_id is not null")
    out = dedup.merge_rows(rows, ["candidate_id"], F.struct("updated_at", "candidate_seq"), ["candidate_seq", "pr_number"], ["query_ids"])
    return out.select("candidate_id", "candidate_seq", "pr_number", F.coalesce(F.array_join("query_ids", ","), F.lit("")).alias("queries"))


@query(
    "greedy_dedup",
    """with recursive k as (select row_number() over (order by pair_id) as n, pair_id, 'p' || sha256(old_contents || chr(0) || new_contents) as p, 'c' || "commit" as c from pair_source_a where old_contents is not null and new_contents is not null),
       g(n, pair_id, ok, seen) as (select 0::bigint, null::bigint, false, []::varchar[] union all
         select k.n, k.pair_id, not list_contains(seen, p) and not coalesce(list_contains(seen, c), false), case when not list_contains(seen, p) and not coalesce(list_contains(seen, c), false) then list_concat(seen, [p, coalesce(c, p)]) else seen end from g join k on k.n = g.n + 1)
       select pair_id, ok as accepted from g where n > 0""",
)
def greedy_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Commit pairs, each accepted unless an earlier accepted one has its payload or its commit."""
    rows = table(spark, d, "pair_source_a").where("old_contents is not null and new_contents is not null")
    keyed = rows.select("pair_id", F.sha2(k.nul_joined(F.col("old_contents"), F.col("new_contents")), 256).alias("payload"), F.col("commit").alias("commit_key"))
    return dedup.greedy(keyed, "pair_id", "pair_id", ["payload", "commit_key"])


_BUCKET = "(('0x' || substr(sha256({payload}), 1, 8))::bigint % 100)"


@query("hash_split_nul", f"""select c_custkey, case when {_BUCKET.format(payload="'seed-7' || chr(0) || c_mktsegment || '|' || c_nationkey")} < 10 then 'test' when {_BUCKET.format(payload="'seed-7' || chr(0) || c_mktsegment || '|' || c_nationkey")} < 20 then 'validation' else 'train' end as split from customer""")
def hash_split_nul(spark: SparkSession, d: str) -> DataFrame:
    group = F.concat_ws("|", "c_mktsegment", F.col("c_nationkey").cast("string"))
    return table(spark, d, "customer").select("c_custkey", hash_split("seed-7", group, [("test", 10), ("validation", 20)], "train").alias("split"))


@query("hash_split_json", """select repository, case when (('0x' || substr(sha256('[20260906,"' || repository || '"]'), 1, 8))::bigint % 100) < 15 then 'validation' else 'train' end as split from repository_item""")
def hash_split_json_q(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "repository_item").select("repository", hash_split_json(20260906, F.col("repository"), [("validation", 15)], "train").alias("split"))


@query(
    "prior_split",
    f"""with p as (select problem_id, min(case when upstream_split = 'valid' then 'validation' else upstream_split end) as prior from pair_source_b where id % 3 = 0 and problem_id is not null and upstream_split is not null group by 1)
       select b.id, coalesce(p.prior, b.upstream_split, case when {_BUCKET.format(payload="'s' || chr(0) || coalesce(b.problem_id, '?')")} < 20 then 'test' else 'train' end) as split from pair_source_b b left join p using (problem_id)""",
)
def prior_split_q(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pair_source_b")
    # earlier assignments: those of the problems that an earlier release held
    name = F.when(F.col("upstream_split") == "valid", "validation").otherwise(F.col("upstream_split"))
    prior = rows.where("id % 3 = 0 and problem_id is not null and upstream_split is not null").groupBy("problem_id").agg(F.min(name).alias("split"))
    fallback = hash_split("s", F.coalesce("problem_id", F.lit("?")), [("test", 20)], "train")
    return prior_split(rows, "problem_id", prior, F.col("upstream_split"), fallback).select("id", "split")


@query("candidate_seeds", """select candidate_seq, (('0x' || substr(sha256('pool' || chr(0) || candidate_id || chr(0) || pr_number), 1, 8))::bigint & 2147483647) as seed from pr_candidate""")
def candidate_seeds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pr_candidate").select("candidate_seq", k.seed31("pool", F.col("candidate_id"), F.col("pr_number")).alias("seed"))


@query(
    "stage_chains",
    """with s as (select l_orderkey as k, l_linenumber - 1 as o, case when l_returnflag = 'R' and l_discount > 0.05 then 'returned' when l_quantity > 48 then 'large' end as r from lineitem),
       g as (select k, min(case when r is not null then o end) as f, count(distinct o) as ran from s group by 1),
       c as (select g.k, f, ran, (select min(s.r) from s where s.k = g.k and s.o = g.f) as r from g)
       select case when f is not null then f || ':' || r when ran >= 4 then 'complete' else 'incomplete' end as label, count(*) as n from c group by 1""",
)
def stage_chains(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem")
    reason = F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.05), "returned").when(F.col("l_quantity") > 48, "large")
    stages = items.select("l_orderkey", (F.col("l_linenumber") - 1).alias("o"), reason.alias("r"))
    return reject_histogram(stage_chain(stages, ["l_orderkey"], "o", "r", 4))


@query(
    "curation_flow",
    f"""with r as (select doc_id, text, lang, kind, repository, {_REASON} as reason from documents),
       u as (select * from (select *, row_number() over (partition by sha256(text) order by doc_id) as n from r where reason is null) where n = 1),
       s as (select *, case when {_BUCKET.format(payload="'flow' || chr(0) || repository")} < 20 then 'validation' else 'train' end as split from u),
       f as (select * from (select *, row_number() over (partition by repository, kind order by length(text) desc, doc_id) as m from s) where m <= 2),
       c as (select * from (select *, row_number() over (partition by split, repository order by sha256('cap' || chr(0) || doc_id), doc_id) as m2 from f) where m2 <= 6)
       select split, lang, count(*) as docs, count(distinct repository) as repositories, sum(length(text)) as chars from c group by 1, 2""",
)
def curation_flow(spark: SparkSession, d: str) -> DataFrame:
    """Rules, exact dedup, hash split by repository, the two longest per repository and kind, a cap per repository."""
    kept, _ = doc_rules().split(table(spark, d, "documents"))
    # texts end at the scan: what moves on are their hash and length
    slim = kept.select("doc_id", "lang", "kind", "repository", F.length("text").alias("chars"), F.sha2("text", 256).alias("h"))
    unique = dedup.first_per_key(slim, ["h"], [F.col("doc_id")]).drop("h")
    split = unique.withColumn("split", hash_split("flow", F.col("repository"), [("validation", 20)], "train"))
    best = select.top_k(split, ["repository", "kind"], [F.desc("chars"), F.col("doc_id")], 2)
    capped, _ = select.capped(best, ["split", "repository"], [select.hash_order("cap", F.col("doc_id")), F.col("doc_id")], F.lit(6))
    return capped.groupBy("split", "lang").agg(F.count(F.lit(1)).alias("docs"), F.count_distinct("repository").alias("repositories"), F.sum("chars").alias("chars"))


@query("set_fingerprint", "select lang, sha256(coalesce(string_agg(distinct repository, chr(10) order by repository) || chr(10), '')) as hash from documents group by 1")
def set_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    from loomwright.operators import metrics

    return metrics.set_fingerprint(table(spark, d, "documents"), "repository", ["lang"])


@query("set_fingerprint_sums", "with h as (select sha256(x::varchar) as h from (select distinct c_custkey as x from customer)) select count(*) as n, sum(('0x' || substr(h, 1, 8))::bigint)::varchar as a, sum(('0x' || substr(h, 9, 8))::bigint)::varchar as b, sum(('0x' || substr(h, 17, 8))::bigint)::varchar as c, sum(('0x' || substr(h, 25, 8))::bigint)::varchar as d from h")
def set_fingerprint_sums(spark: SparkSession, d: str) -> DataFrame:
    from loomwright.operators.metrics import fingerprint_sums

    out = fingerprint_sums(table(spark, d, "customer"), "c_custkey")
    return out.select("n", *[F.col(x).cast("string").alias(x) for x in "abcd"])
