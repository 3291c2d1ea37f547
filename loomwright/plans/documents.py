"""Projections with reasons, keys of records, consistency over several tables, gates over two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import keys as k
from loomwright.operators import gates, joins, metrics, projection
from loomwright.plans.registry import query
from loomwright.session import table

_REPOSITORY_ITEM = """case when full_name is null then 'name' when coalesce(fork, true) then 'fork' when coalesce(archived, true) then 'archived'
    when coalesce(stargazers_count < 50, true) then 'stars' when coalesce(trim(spdx_id) in ('', 'NOASSERTION'), true) then 'licence' end"""


def _repository_items(spark: SparkSession, d: str) -> DataFrame:
    checks = [
        ("name", F.col("full_name").isNull()), ("fork", F.col("fork")), ("archived", F.col("archived")),
        ("stars", F.col("stargazers_count") < 50), ("licence", F.trim("spdx_id").isin("", "NOASSERTION")),
    ]
    fields = {"name": F.lower("full_name"), "stars": F.col("stargazers_count"), "licence": F.trim("spdx_id"), "bare": k.bare_name(F.col("full_name"))}
    return projection.project(table(spark, d, "repository_item"), ["repository"], checks, fields)


@query("repository_items", f"""with x as (select *, {_REPOSITORY_ITEM} as reason from repository_item)
    select repository, reason, case when reason is null then lower(full_name) end as name, case when reason is null then stargazers_count end as stars, case when reason is null then trim(spdx_id) end as licence,
    case when reason is null then regexp_replace(lower(full_name), '[^a-z0-9]+', '', 'g') end as bare from x""")  # fmt: skip
def repository_items(spark: SparkSession, d: str) -> DataFrame:
    """Repository records, or the first reason why one isn't taken."""
    return _repository_items(spark, d)


@query("repository_outcomes", f"select 'item:' || coalesce({_REPOSITORY_ITEM}, 'selected') as outcome, count(*) as n from repository_item group by 1")
def repository_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return projection.staged_outcomes(_repository_items(spark, d), "item")


@query("request_details", """with x as (select *, case when candidate_id is null then 'identity' when pr_number is null or pr_number <= 0 then 'number' when closed_at is null then 'open' when closed_at < created_at then 'times' when len(query_ids) = 0 then 'origin' end as reason from pr_candidate)
    select candidate_seq, reason, case when reason is null then pr_number end as number, case when reason is null then date_diff('day', created_at::date, closed_at::date) end as days, case when reason is null then array_to_string(list_sort(list_distinct(query_ids)), ',') end as origins from x""")  # fmt: skip
def request_details(spark: SparkSession, d: str) -> DataFrame:
    """Candidates' details with five ordered checks."""
    checks = [
        ("identity", F.col("candidate_id").isNull()), ("number", F.col("pr_number").isNull() | (F.col("pr_number") <= 0)), ("open", F.col("closed_at").isNull()),
        ("times", F.coalesce(F.col("closed_at") < F.col("created_at"), F.lit(False))), ("origin", F.coalesce(F.size("query_ids") == 0, F.lit(False))),
    ]
    fields = {"number": F.col("pr_number"), "days": F.datediff("closed_at", "created_at").cast("long"), "origins": F.array_join(F.array_sort(F.array_distinct("query_ids")), ",")}
    return projection.project(table(spark, d, "pr_candidate"), ["candidate_seq"], checks, fields)


@query("public_rows", "select lang, kind, n_chars, sha256(repository) as repository_hash, sha256(doc_id::varchar) as doc_hash from documents")
def public_rows(spark: SparkSession, d: str) -> DataFrame:
    """Allowed columns only, and hashes in the place of names."""
    return projection.public(table(spark, d, "documents"), ["lang", "kind", "n_chars"], {"repository_hash": F.col("repository"), "doc_hash": F.col("doc_id")})


@query("licence_documents", """with x as (select repository, base64(license_text::blob) as c from repository_item),
    y as (select repository, case when c is null then null when hash(repository) is null then null when length(repository) % 5 = 0 then c || '!' else c end as c from x)
    select repository, c is not null and right(c, 1) <> '!' as good, case when right(c, 1) <> '!' then sha256(from_base64(c)) end as hash from y""")  # fmt: skip
def licence_documents(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of base64 contents; one with other signs in it has none."""
    c = F.base64(F.col("license_text").cast("binary"))
    raw = table(spark, d, "repository_item").select("repository", F.when(F.length("repository") % 5 == 0, F.concat(c, F.lit("!"))).otherwise(c).alias("c"))
    octets = projection.decoded(F.col("c"))
    return raw.select("repository", octets.isNotNull().alias("good"), F.sha2(octets, 256).alias("hash"))


@query("merge_commits", """with x as (select pair_id, "commit" as head, case pair_id % 4 when 0 then [coalesce(source_dataset, '')] when 1 then [coalesce(source_dataset, ''), "commit"] when 2 then [coalesce(source_dataset, ''), 'other'] else [] end as parents from pair_source_a)
    select pair_id, case when len(parents) = 1 or (len(parents) = 2 and parents[2] = head) then parents[1] end as base, case when len(parents) = 1 then 'plain' when len(parents) = 2 and parents[2] = head then 'merge' end as kind from x""")  # fmt: skip
def merge_commits(spark: SparkSession, d: str) -> DataFrame:
    """The base of commits with one or two parents."""
    source, head, n = F.coalesce("source_dataset", F.lit("")), F.col("commit"), F.col("pair_id") % 4
    parents = F.when(n == 0, F.array(source)).when(n == 1, F.array(source, head)).when(n == 2, F.array(source, F.lit("other"))).otherwise(F.array().cast("array<string>"))
    m = projection.merge_commit(parents, head)
    return table(spark, d, "pair_source_a").select("pair_id", m.alias("m")).select("pair_id", "m.base", "m.kind")


_TESTS, _PRODUCTION, _MANIFESTS = ["test", "tests", "testing"], [".cc", ".cpp", ".c", ".h", ".hpp"], ["CMakeLists.txt", "Makefile"]
_SUFFIX = r"coalesce(regexp_extract(regexp_extract(p, '[^/]*$'), '.(\.[^./]+)$', 1), '')"
_IS_TEST = "len(list_filter(list_slice(list_filter(string_split(p, '/'), lambda x: x <> '' and x <> '.'), 1, -2), lambda x: lower(x) in ('test', 'tests', 'testing'))) > 0"


@query("path_predicates", f"""with x as (select pair_id, new_file as p from pair_source_a where new_file is not null)
    select pair_id, {_IS_TEST} as test, regexp_extract(p, '[^/]*$') in ('CMakeLists.txt', 'Makefile') or lower({_SUFFIX}) in ('.cmake', '.bazel') as manifest from x""")  # fmt: skip
def path_predicates(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("new_file")
    return table(spark, d, "pair_source_a").where(p.isNotNull()).select("pair_id", k.has_part(p, _TESTS).alias("test"), k.is_named(p, _MANIFESTS, [".cmake", ".bazel"]).alias("manifest"))


@query("admissible_changes", f"""with f as (select "commit" as c, new_file as p, case when old_contents is null or old_contents = '' then 'A' else 'M' end as status from pair_source_a where "commit" is not null and new_file is not null),
    m as (select c, p, status, {_IS_TEST} as test, regexp_extract(p, '[^/]*$') in ('CMakeLists.txt', 'Makefile') as manifest, lower({_SUFFIX}) in ('.cc', '.cpp', '.c', '.h', '.hpp') as production from f),
    g as (select c, count(*) as files, count(*) filter (not test and production) as targets, count(*) filter (test) as tests, count(*) filter (not test and production and status <> 'M') as fresh, count(*) filter (not test and manifest) as manifests from m group by 1)
    select c as change, files, case when targets <> 1 then 'target_count' when tests < 0 then 'no_test' when fresh > 0 then 'not_modified' when manifests > 0 then 'manifest' end as reason from g""")  # fmt: skip
def admissible_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes with one modified production file and no build manifest; the files of a commit are its change."""
    file = F.struct(F.col("new_file").alias("path"), F.when(F.coalesce(F.col("old_contents"), F.lit("")) == "", "A").otherwise("M").alias("status"))
    changes = table(spark, d, "pair_source_a").where("commit is not null and new_file is not null").groupBy(F.col("commit").alias("change")).agg(F.collect_list(file).alias("files"))
    reason = projection.admissible(F.col("files"), lambda p: k.has_part(p, _TESTS), lambda p: k.is_named(p, [""], _PRODUCTION), lambda p: k.is_named(p, _MANIFESTS, [""]) & (p.rlike(r"(?:^|/)(?:CMakeLists[.]txt|Makefile)$")), 1, 0)
    return changes.select("change", F.size("files").cast("long").alias("files"), reason.alias("reason"))


@query("file_lists", r"""with x as (select source_dataset as s, new_file as p, pair_id % 3 as k from pair_source_a),
    g as (select k, s, count(*) as n, count(distinct p) as d, count(*) filter (p is null) as nulls, count(*) filter (not coalesce(p <> '' and not starts_with(p, '/') and not contains(p, chr(92)) and not regexp_matches(p, '^[A-Za-z]:') and not list_contains(string_split(p, '/'), '..'), false)) as bad from x group by 1, 2)
    select s as source, k as page, n as files, case when n >= 1000 then 'ambiguous' when bad > 0 then 'unsafe' when d < n then 'repeated' end as reason from g""")  # fmt: skip
def file_lists(spark: SparkSession, d: str) -> DataFrame:
    """Pages of changed files."""
    rows = table(spark, d, "pair_source_a").select(F.col("source_dataset").alias("source"), (F.col("pair_id") % 3).alias("page"), F.struct(F.col("new_file").alias("path")).alias("f"))
    pages = rows.groupBy("source", "page").agg(F.collect_list("f").alias("files"))
    return pages.select("source", "page", F.size("files").cast("long").alias("files"), projection.file_list(F.col("files"), 1000, k.is_safe_path)["reason"].alias("reason"))


@query("ascii_payloads", "select doc_id, sha256(text) is not null as plain from documents where text is not null and strlen(text) = length(text) and not contains(text, chr(127))")
def ascii_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Texts of ASCII are the same in ASCII-escaped JSON; the escapes of the others have a test of their own."""
    rows = table(spark, d, "documents").where("text is not null and octet_length(text) = char_length(text) and not contains(text, char(127))")
    return rows.select("doc_id", (k.ascii_json(F.col("text")) == F.col("text")).alias("plain"))


@query("sampling_families", r"""with x as (select pair_id, source_dataset as g, lower(regexp_replace(replace(new_file, chr(92), '/'), '^/+|/+$', '', 'g')) as p, nullif(lower(trim(coalesce(lang, ''))), '') as s, 'sha256:' || sha256("commit") as a from pair_source_a)
    select pair_id, case when p <> '' and not list_contains(string_split(p, '/'), '..') and coalesce(s, a) is not null then concat_ws('|', g, p, coalesce(s, a)) end as family from x""")  # fmt: skip
def sampling_families(spark: SparkSession, d: str) -> DataFrame:
    family = k.sampling_family(F.col("source_dataset"), F.col("new_file"), F.col("lang"), k.sha_hex(F.col("commit"), prefix=True))
    return table(spark, d, "pair_source_a").select("pair_id", family.alias("family"))


@query("aliased_values", "select pair_id, case lower(trim(license)) when 'mit' then 'MIT' when 'expat' then 'MIT' when 'apache-2.0' then 'Apache-2.0' when 'asl 2.0' then 'Apache-2.0' when 'isc' then 'ISC' end as known from pair_source_a")
def aliased_values(spark: SparkSession, d: str) -> DataFrame:
    aliases = {"mit": "MIT", "expat": "MIT", "apache-2.0": "Apache-2.0", "asl 2.0": "Apache-2.0", "isc": "ISC"}
    return table(spark, d, "pair_source_a").select("pair_id", k.by_alias(F.col("license"), aliases).alias("known"))


@query("record_urls", r"""with x as (select candidate_seq, case candidate_seq % 4 when 0 then 'https://git.example/' || regexp_replace(candidate_id, '[^A-Za-z0-9]', '', 'g') || '/R/pull/' || pr_number when 1 then 'http://git.example/o/r/pull/1' when 2 then 'https://git.example/o/r/pull/0' else 'https://gitxexample/o/r/pull/' || pr_number end as u from pr_candidate)
    select candidate_seq, case when regexp_full_match(u, 'https://git[.]example/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+/pull/[1-9][0-9]*/?') then 'git.example/' || lower(regexp_extract(u, 'example/(.*)/pull/', 1)) end as repository,
    case when regexp_full_match(u, 'https://git[.]example/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+/pull/[1-9][0-9]*/?') then regexp_extract(u, '/pull/([0-9]+)', 1)::bigint end as number from x""")  # fmt: skip
def record_urls(spark: SparkSession, d: str) -> DataFrame:
    n, number = F.col("candidate_seq") % 4, F.col("pr_number").cast("string")
    name = F.regexp_replace("candidate_id", "[^A-Za-z0-9]", "")
    url = F.when(n == 0, F.concat(F.lit("https://git.example/"), name, F.lit("/R/pull/"), number)).when(n == 1, "http://git.example/o/r/pull/1").when(n == 2, "https://git.example/o/r/pull/0").otherwise(F.concat(F.lit("https://gitxexample/o/r/pull/"), number))
    found = k.record_url(url, "git.example", "pull")
    return table(spark, d, "pr_candidate").select("candidate_seq", found.alias("x")).select("candidate_seq", "x.repository", "x.number")


@query("request_fields", """select event_id, case when len(json_keys(props)) <> 1 or json_keys(props)[1] <> 'k' then 'fields' when json_type(props, '$.k') not in ('UBIGINT', 'BIGINT') then 'kinds' end as reason from events""")
def request_fields(spark: SparkSession, d: str) -> DataFrame:
    """JSON objects with exactly the fields asked for, of their kinds."""
    return table(spark, d, "events").select("event_id", k.exact_fields(F.col("props"), {"k": "BIGINT"}).alias("reason"))


@query("fetched_once", """with w as (select distinct lower(problem_id) as p from pair_source_b where problem_id is not null), c as (select lower(problem_id) as p, count(*) as n from tests group by 1)
    select w.p as problem, coalesce(n, 0) as found from w left join c using (p) where coalesce(n, 0) <> 1""")  # fmt: skip
def fetched_once(spark: SparkSession, d: str) -> DataFrame:
    """Problems whose tests aren't there exactly once."""
    wanted = table(spark, d, "pair_source_b").where("problem_id is not null").select(F.lower("problem_id").alias("problem"))
    return joins.fetch_each_once(table(spark, d, "tests").select("id", F.lower("problem_id").alias("problem")), wanted, "problem")[1]


@query("consistent_records", """with c as (select o_orderkey as k, o_custkey as cust, o_totalprice as price from orders), b as (select k, case when k % 13 = 0 then cust + 1 else cust end as cust, price from c where k % 11 <> 0), s as (select k, cust, case when k % 17 = 0 then null else price end as price from c where k % 7 <> 0)
    select c.k, array_to_string(list_sort(list_filter([case when b.k is null then 'audit:missing' end, case when b.k is not null and b.cust is distinct from c.cust then 'audit:cust' end, case when b.k is not null and b.price is distinct from c.price then 'audit:price' end, case when s.k is null then 'score:missing' end, case when s.k is not null and s.price is distinct from c.price then 'score:price' end], lambda x: x is not null)), ',') as problems
    from c left join b using (k) left join s using (k)""")  # fmt: skip
def consistent_records(spark: SparkSession, d: str) -> DataFrame:
    """Records against an audit and a score of the same keys."""
    base = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("price"))
    audit = base.where("k % 11 <> 0").withColumn("cust", F.when(F.col("k") % 13 == 0, F.col("cust") + 1).otherwise(F.col("cust")))
    score = base.where("k % 7 <> 0").withColumn("price", F.when(F.col("k") % 17 != 0, F.col("price")))
    return joins.consistent(base, {"audit": (audit, ["cust", "price"]), "score": (score, ["price"])}, "k").select("k", F.array_join("problems", ",").alias("problems"))


@query("unexpected_entries", """with e as (select distinct lower(repository) as p, 1 as e from repository_item where stargazers_count > 100), f as (select distinct lower(repository) as p, 1 as f from documents where repository is not null)
    select p as entry, case when f is null then 'missing' else 'unexpected' end as status from e full join f using (p) where e is null or f is null""")  # fmt: skip
def unexpected_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a listing that aren't expected, and expected ones that aren't there."""
    found = table(spark, d, "documents").where("repository is not null").select(F.lower("repository").alias("entry"))
    expected = table(spark, d, "repository_item").where("stargazers_count > 100").select(F.lower("repository").alias("entry"))
    return joins.unexpected(found, expected, "entry")


@query("supply_targets", """with c as (select l_returnflag as k, count(*) filter (l_linestatus = 'F') as safe, count(*) filter (l_linestatus = 'O') as available from lineitem group by 1), t as (select * from (values ('A', 100, 100000), ('N', 20, 30), ('Q', 5, 7)) v(k, cap, target))
    select t.k, coalesce(safe, 0) as safe, coalesce(safe, 0) + least(coalesce(available, 0), cap) as usable, greatest(0, target - (coalesce(safe, 0) + least(coalesce(available, 0), cap))) as still_missing from t left join c using (k)""")  # fmt: skip
def supply_targets(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(F.count_if(F.col("l_linestatus") == "F").alias("safe"), F.count_if(F.col("l_linestatus") == "O").alias("available"))
    return gates.supply(counts, spark.createDataFrame([("A", 100, 100000), ("N", 20, 30), ("Q", 5, 7)], "k string, cap long, target long"), "k")


@query("feasible_contracts", """with x as (select p_brand as k, count(distinct p_type) as groups, min(p_size) as cap, count(*) as total, min(p_size) as least, max(p_size) - 20 as most from part group by 1)
    select k, array_to_string(list_sort(list_filter([case when groups * cap < total then 'capacity' end, case when least > most then 'order' end, case when least(groups, cap, total, least) < 0 then 'negative' end], lambda x: x is not null)), ',') as reasons from x""")  # fmt: skip
def feasible_contracts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").groupBy(F.col("p_brand").alias("k")).agg(F.count_distinct("p_type").alias("groups"), F.min("p_size").cast("long").alias("cap"), F.count(F.lit(1)).alias("total"), F.min("p_size").cast("long").alias("least"), (F.max("p_size") - 20).cast("long").alias("most"))
    return gates.feasible(rows, "k").select("k", F.array_join("reasons", ",").alias("reasons"))


@query("shift_report", """with x as (select case when l_linestatus = 'F' then 'a' else 'b' end as s, l_shipmode_x as m, l_returnflag as f, l_quantity as q, l_discount as dis from (select *, l_returnflag || l_linenumber as l_shipmode_x from lineitem)),
    n as (select count(*) filter (s = 'a') as na, count(*) filter (s = 'b') as nb from x),
    l as (select 'mode' as c, m as v, s from x union all select 'flag', f, s from x),
    tv as (select c, sum(abs(a / na - b / nb)) / 2 as value from (select c, v, count(*) filter (s = 'a') as a, count(*) filter (s = 'b') as b from l group by 1, 2), n group by 1),
    v as (select 'quantity' as c, q::double as v, s from x union all select 'discount', dis::double, s from x),
    r as (select c, sum(a) over (partition by c order by v) as ca, sum(b) over (partition by c order by v) as cb from (select c, v, count(*) filter (s = 'a') as a, count(*) filter (s = 'b') as b from v group by 1, 2))
    select 'tv' as measure, c as "column", round(value, 9) as value from tv union all select 'ks', c, round(max(abs(ca / na - cb / nb)), 9) from r, n group by c""")  # fmt: skip
def shift_report(spark: SparkSession, d: str) -> DataFrame:
    """How far two samples' labels and numbers lie apart."""
    rows = table(spark, d, "lineitem").select(F.when(F.col("l_linestatus") == "F", "a").otherwise("b").alias("s"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("mode"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))
    return metrics.shift_report(rows, "s", "a", "b", ["mode", "flag"], ["quantity", "discount"]).withColumn("value", F.round("value", 9))


@query("selection_counters", "select event_type, count(*) as total, count(*) filter (value > 50) as high, count(*) filter (value > 90) as top, count(*) filter (user_id % 2 = 0) as even from events group by 1")
def selection_counters(spark: SparkSession, d: str) -> DataFrame:
    return metrics.counters(table(spark, d, "events"), ["event_type"], {"high": F.col("value") > 50, "top": F.col("value") > 90, "even": F.col("user_id") % 2 == 0})


@query("comparison_gate", """with p as (select event_id, (value > 30)::int as b, (value > 20)::int as a, (user_id % 5 > 0)::int as pb, (user_id % 7 > 0)::int as pa, (user_id % 11 = 0)::int as tb, (user_id % 3 = 0)::int as ta, event_id % 5 > 0 as f from events),
    r as (select count(*) filter (f) as nf, count(*) filter (not f) as nw, avg(a - b) filter (f) as df, avg(a - b) filter (not f) as dw, avg(pa - pb) as dp, avg(ta - tb) as dt from p)
    select false as passed, array_to_string(list_sort(list_filter([case when nf <> 7 then 'function_denominator' end, case when df < 0.05 - 1e-12 then 'gain' end, case when dp < -0.001 - 1e-12 then 'parsed_fell' end, case when dw < -0.5 - 1e-12 then 'window_fell' end, case when dt > 0.01 + 1e-12 then 'late_rose' end], lambda x: x is not null)), ',') as reasons,
    nf as n_function, nw as n_window, round(df, 9) as gain, true as within, round(dp, 9) as d_parsed, round(dw, 9) as d_window, round(dt, 9) as d_late from r""")  # fmt: skip
def comparison_gate(spark: SparkSession, d: str) -> DataFrame:
    """Two runs of the same cases: denominators, gain with its interval, rates that may not fall or rise."""
    e, u = table(spark, d, "events"), F.col("user_id")
    pairs = e.select((F.col("event_id") % 5 > 0).alias("f"), (F.col("value") > 30).alias("success_before"), (F.col("value") > 20).alias("success_after"), (u % 5 > 0).alias("parsed_before"), (u % 7 > 0).alias("parsed_after"), (u % 11 == 0).alias("late_before"), (u % 3 == 0).alias("late_after"))
    slices = {"function": F.col("f"), "window": ~F.col("f")}
    out = gates.comparison_gate(pairs, slices, {"function": 7}, "function", 0.05, 0.0, {"parsed": 0.001, "window": 0.5}, {"late": 0.01}, F.lit(True))
    within = (F.col("low") <= F.col("gain")) & (F.col("gain") <= F.col("high"))
    return out.select("passed", F.array_join("reasons", ",").alias("reasons"), "n_function", "n_window", F.round("gain", 9).alias("gain"), within.alias("within"), *[F.round(c, 9).alias(c) for c in ("d_parsed", "d_window", "d_late")])
