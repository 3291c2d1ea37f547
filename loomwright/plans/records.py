"""Nested records: compacted, compared, accepted; prompts and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import keys
from loomwright.operators import nested, select
from loomwright.operators.totals import with_running
from loomwright.plans.registry import query
from loomwright.session import table


@query("stage_compaction", "select l_orderkey, count(*) as total, count(*) filter (l_linestatus = 'F') as matched, count(*) filter (l_quantity > 45) as timeouts, count(*) filter (l_returnflag = 'R') as status_R, count(*) filter (l_returnflag = 'N') as status_N from lineitem group by 1")
def stage_compaction(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.struct(F.col("l_returnflag").alias("status"), (F.col("l_linestatus") == "F").alias("matched"), (F.col("l_quantity") > 45).alias("timed_out"))
    cases = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(outcome).alias("o"))
    return cases.select("l_orderkey", nested.compact(F.col("o"), ["R", "N"]).alias("c")).select("l_orderkey", "c.*")


@query("stable_projections", "select l_orderkey, string_agg(l_linenumber || ':' || l_returnflag, ',' order by l_linenumber::varchar, l_returnflag) as outcomes from lineitem group by 1")
def stable_projections(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.struct(F.col("l_linenumber").alias("test_id"), F.col("l_returnflag").alias("status"), F.col("l_extendedprice").alias("elapsed"))
    cases = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(outcome).alias("o"))
    slim = nested.stable_projection(F.col("o"), ["elapsed"], "test_id")
    return cases.select("l_orderkey", F.array_join(F.transform(slim, lambda o: F.concat_ws(":", o["test_id"].cast("string"), o["status"])), ",").alias("outcomes"))


@query(
    "replay_differences",
    """with a as (select l_orderkey, l_linenumber, l_returnflag, l_tax from lineitem where l_partkey % 31 <> 0), b as (select l_orderkey, l_linenumber, case when l_partkey % 37 = 0 then 'X' else l_returnflag end as l_returnflag, l_tax + 1 as l_tax from lineitem where l_partkey % 41 <> 0)
       select l_orderkey, l_linenumber, case when b.l_returnflag is null then 'missing' when a.l_returnflag is null then 'extra' else 'changed' end as status from a full join b using (l_orderkey, l_linenumber) where a.l_returnflag is distinct from b.l_returnflag""",
)
def replay_differences(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_tax")
    first = rows.where("l_partkey % 31 <> 0").drop("l_partkey")
    second = rows.where("l_partkey % 41 <> 0").withColumn("l_returnflag", F.when(F.col("l_partkey") % 37 == 0, "X").otherwise(F.col("l_returnflag"))).withColumn("l_tax", F.col("l_tax") + 1).drop("l_partkey")
    return nested.replay_differences(first, second, ["l_orderkey", "l_linenumber"], ["l_tax"])


@query(
    "acceptance",
    """with g as (select l_orderkey, count(*) filter (l_linenumber <= 2) > 0 and count(*) filter (l_linenumber <= 2 and l_quantity >= 47) = 0 as public, count(*) filter (l_linenumber > 2) > 0 and count(*) filter (l_linenumber > 2 and l_quantity >= 47) = 0 as hidden from lineitem group by 1)
       select *, public and hidden as accepted from g""",
)
def acceptance(spark: SparkSession, d: str) -> DataFrame:
    suites = {"public": F.col("l_linenumber") <= 2, "hidden": F.col("l_linenumber") > 2}
    return nested.accepted(table(spark, d, "lineitem"), "l_orderkey", suites, F.col("l_quantity") < 47)


@query(
    "score_deltas",
    """with j as (select event_id, (value > 30)::int as b1, (value > 20)::int as a1, (user_id % 2 = 0)::int as b2, (user_id % 3 = 0)::int as a2 from events),
       x as (select 'high' as flag, sum(b1) as before, sum(a1) as after, count(*) filter (a1 is distinct from b1) as changed from j union all select 'even', sum(b2), sum(a2), count(*) filter (a2 is distinct from b2) from j)
       select flag, before::bigint as before, after::bigint as after, (after - before)::bigint as delta, changed from x""",
)
def score_deltas(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    before = e.select("event_id", (F.col("value") > 30).alias("high"), (F.col("user_id") % 2 == 0).alias("even"))
    after = e.select("event_id", (F.col("value") > 20).alias("high"), (F.col("user_id") % 3 == 0).alias("even"))
    return nested.score_deltas(before, after, "event_id", ["high", "even"])


@query("comparable_runs", "select 'lang' as field, count(distinct lang) + max((lang is null)::int) as values, count(distinct lang) + max((lang is null)::int) = 1 as same from documents union all select 'kind', count(distinct kind) + max((kind is null)::int), count(distinct kind) + max((kind is null)::int) = 1 from documents")
def comparable_runs(spark: SparkSession, d: str) -> DataFrame:
    return nested.comparable(table(spark, d, "documents"), "source", ["lang", "kind"])


@query(
    "alternating_strata",
    """with recursive r as (select doc_id, kind, repository, sha256(doc_id::varchar) as h from documents where repository is not null and kind is not null),
       o as (select kind, repository, doc_id, row_number() over (partition by kind order by h, doc_id) as n from (select *, row_number() over (partition by kind, repository order by h, doc_id) as f from r) where f = 1),
       q as (select kind, row_number() over (order by kind) - 1 as ix, list(struct_pack(u := repository, i := doc_id) order by n) as q, count(*) over () as strata from o group by kind),
       t(step, place, id, taken) as (select 0::bigint, -1::bigint, null::bigint, []::varchar[] union all
         select step + 1, case when list_filter(q, lambda x: not list_contains(taken, x.u))[1] is null then place else place + 1 end, list_filter(q, lambda x: not list_contains(taken, x.u))[1].i,
           case when list_filter(q, lambda x: not list_contains(taken, x.u))[1] is null then taken else list_append(taken, list_filter(q, lambda x: not list_contains(taken, x.u))[1].u) end
         from t join q on q.ix = t.step % q.strata where place < 39 and step < 4000)
       select id as doc_id, place::int as place from t where id is not null""",
)
def alternating_strata(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("repository is not null and kind is not null").select("doc_id", "kind", "repository", F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    return nested.alternate(rows, "kind", "repository", "doc_id", "h", 40)


@query("capped_search", "select candidate_seq, repository_split_group from (select candidate_seq, repository_split_group, updated_at, row_number() over (partition by repository_split_group order by updated_at desc nulls last, candidate_seq) as n from pr_candidate) where n = 1 order by updated_at desc nulls last, candidate_seq limit 60")
def capped_search(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pr_candidate").select("candidate_seq", "repository_split_group", "updated_at")
    return nested.first_of_groups(rows, "repository_split_group", [F.col("updated_at").desc_nulls_last(), F.col("candidate_seq")], 60).select("candidate_seq", "repository_split_group")


@query("safety_tags", r"""select pair_id, array_to_string(list_filter([case when regexp_matches(new_contents, '\bassert\s*\(') then 'assert' end, case when regexp_matches(new_contents, '(^|[^:])\bnullptr\b') then 'null' end, case when regexp_matches(new_contents, '\.push_back\(') then 'container' end], lambda x: x is not null), ',') as tags from pair_source_a where new_contents is not null""")
def safety_tags(spark: SparkSession, d: str) -> DataFrame:
    patterns = {"assert": r"\bassert\s*\(", "null": r"(^|[^:])\bnullptr\b", "container": r"\.push_back\("}
    return table(spark, d, "pair_source_a").where("new_contents is not null").select("pair_id", F.array_join(nested.tags(F.col("new_contents"), patterns), ",").alias("tags"))


@query("prompts", r"""select id, sha256(concat_ws(chr(10) || chr(10), '### Problem' || chr(10) || regexp_replace(problem_id, '\n+$', ''), '### Code' || chr(10) || regexp_replace(buggy_code, '\n+$', ''))) as hash from pair_source_b""")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pair_source_b").select("id", F.sha2(nested.prompt([("Problem", F.col("problem_id")), ("Code", F.col("buggy_code"))]), 256).alias("hash"))


@query("first_last_revisions", "select candidate_id, min(updated_at) as first_seen, max(updated_at) as last_seen, count(*) as fetches from pr_candidate where candidate_id is not null group by 1")
def first_last_revisions(spark: SparkSession, d: str) -> DataFrame:
    """What re-fetching brought: first and last sight of each candidate."""
    return table(spark, d, "pr_candidate").where("candidate_id is not null").groupBy("candidate_id").agg(F.min("updated_at").alias("first_seen"), F.max("updated_at").alias("last_seen"), F.count(F.lit(1)).alias("fetches"))


@query("numbered_tests", "select id, lower(problem_id) as problem, row_number() over (partition by lower(problem_id) order by id) - 1 as ord, count(*) over (partition by lower(problem_id)) as tests from tests where problem_id is not null")
def numbered_tests(spark: SparkSession, d: str) -> DataFrame:
    """Tests per problem in a fixed order, numbered from 0."""
    from pyspark.sql import Window

    p = Window.partitionBy("problem")
    rows = table(spark, d, "tests").where("problem_id is not null").select("id", F.lower("problem_id").alias("problem"))
    return rows.select("id", "problem", (F.row_number().over(p.orderBy("id")) - 1).alias("ord"), F.count(F.lit(1)).over(p).alias("tests"))


@query("canonical_samples", """select 'b:' || lpad((row_number() over (order by id) - 1)::varchar, 6, '0') as sample_id, id, sha256('{"code":"' || sha256(buggy_code) || '","problem":"' || problem_id || '"}') as provenance from pair_source_b where problem_id is not null and buggy_code <> '' and fixed_code <> '' and buggy_code <> fixed_code""")
def canonical_samples(spark: SparkSession, d: str) -> DataFrame:
    """Records as samples with an ordinal in a fixed order and a hash of where they come from."""
    rows = table(spark, d, "pair_source_b").where("problem_id is not null and buggy_code <> '' and fixed_code <> '' and buggy_code <> fixed_code")
    slim = rows.select("id", F.sha2(keys.canonical_object({"problem": F.col("problem_id"), "code": F.sha2("buggy_code", 256)}), 256).alias("provenance"), F.lit(1).alias("one"))
    numbered = with_running(slim, [], ["id"], {"n": "one"})
    return numbered.select(F.concat(F.lit("b:"), F.lpad((F.col("n") - 1).cast("string"), 6, "0")).alias("sample_id"), "id", "provenance")


@query(
    "preference_rows",
    """with r as (select user_id, event_id, event_type, value, row_number() over (partition by user_id order by value desc, event_id) as b, row_number() over (partition by user_id order by value, event_id) as w from events where value is not null)
       select 'user ' || c.user_id as prompt, c.event_type || ':' || c.event_id as chosen, x.event_type || ':' || x.event_id as rejected from r c join r x on c.user_id = x.user_id and c.b = 1 and x.w = 1 and c.value <> x.value""",
)
def preference_rows(spark: SparkSession, d: str) -> DataFrame:
    """Prompt, chosen and rejected of each group's best and worst."""
    rows = table(spark, d, "events").where("value is not null")
    ends = select.best_and_worst(rows, ["user_id"], ["value"], "event_id")
    said = lambda x: rows.select(F.col("event_id").alias(f"{x}_index"), F.concat_ws(":", "event_type", F.col("event_id").cast("string")).alias(x))
    both = ends.join(said("best"), "best_index").join(said("worst"), "worst_index")
    return both.select(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("prompt"), F.col("best").alias("chosen"), F.col("worst").alias("rejected"))


@query("filled_cells")
def filled_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of splits and kinds filled in turn: a text once, a repository in one split and at most twice there."""
    rows = table(spark, d, "documents").where("text <> '' and repository is not null and kind is not null").select("doc_id", "kind", "repository", F.sha2("text", 256).alias("payload"))
    kinds = ("readme", "review_comment", "build_log")
    cells = [(split, kind, F.col("kind") == kind, quota) for split, quota in (("validation", 5), ("train", 40)) for kind in kinds]
    return select.fill_cells(rows, "doc_id", "doc_id", "payload", "repository", cells, 2)
