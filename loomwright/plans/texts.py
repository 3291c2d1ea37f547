"""Scalar functions over texts, paths, code and diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import diff, text
from loomwright.functions import keys as k
from loomwright.functions.match import outputs_match_column
from loomwright.plans.registry import query
from loomwright.session import table


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pair_source_b").where("buggy_code is not null and fixed_code is not null")
    return rows.select("id", F.col("buggy_code").alias("old"), F.col("fixed_code").alias("new"))


@query("path_features", r"""select pair_id, coalesce(regexp_extract(regexp_extract(new_file, '[^/]*$'), '.(\.[^./]+)$', 1), '') as suffix, len(list_filter(string_split(new_file, '/'), lambda p: p <> '' and p <> '.')) as parts,
    coalesce(new_file <> '' and not starts_with(new_file, '/') and not contains(new_file, chr(92)) and not regexp_matches(new_file, '^[A-Za-z]:') and not list_contains(string_split(new_file, '/'), '..'), false) as safe from pair_source_a""")  # fmt: skip
def path_features(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("new_file")
    return table(spark, d, "pair_source_a").select("pair_id", F.coalesce(k.file_suffix(p), F.lit("")).alias("suffix"), F.when(p.isNotNull(), F.size(k.path_parts(p))).alias("parts"), k.is_safe_path(p).alias("safe"))


@query("bug_keywords", r"""with w as (select pair_id, regexp_extract_all(lower(coalesce(subject, '')), '[a-z0-9_]+') as w from pair_source_a)
    select pair_id, list_has_any(w, ['leak', 'null', 'overflow']) or len(list_filter(w, lambda x: starts_with(x, 'fix') or starts_with(x, 'bug') or starts_with(x, 'crash'))) > 0 as hit from w""")  # fmt: skip
def bug_keywords(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pair_source_a").select("pair_id", k.keyword_hit(F.col("subject"), ["leak", "null", "overflow"], ["fix", "bug", "crash"]).alias("hit"))


@query("token_estimates", "select pair_id, (coalesce(strlen(old_contents), 0) + coalesce(strlen(subject), 0) + 512) // 4 as tokens from pair_source_a")
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pair_source_a").select("pair_id", k.token_estimate(F.col("old_contents"), F.col("subject")).alias("tokens"))


@query("payload_hashes", "select pair_id, 'sha256:' || sha256(old_contents || chr(0) || new_contents) as payload from pair_source_a")
def payload_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pair_source_a").select("pair_id", k.sha_hex(k.nul_joined(F.col("old_contents"), F.col("new_contents")), prefix=True).alias("payload"))


@query("bare_names", "select repository, regexp_replace(lower(full_name), '[^a-z0-9]+', '', 'g') as bare from repository_item")
def bare_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "repository_item").select("repository", k.bare_name(F.col("full_name")).alias("bare"))


@query(
    "closing_references",
    r"""with x as (select pair_id, coalesce(message, '') as m, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(repository)), '^[a-z+]+://(?:[^/@]*@)?', ''), '^git@([^:/]+):', '\1/'), '^/+|/+$', '', 'g'), '\.git$', '') as r,
       '(?i)\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\b\s*:?\s*(?:([\w.-]+/[\w.-]+))?#(\d+)\b' as q from pair_source_a),
       y as (select pair_id, case when len(string_split(r, '/')) >= 3 then array_to_string(list_slice(string_split(r, '/'), -2, -1), '/') else '' end as own, list_zip(regexp_extract_all(m, q, 1), regexp_extract_all(m, q, 2)) as z from x)
       select pair_id, list_sort(list_distinct(list_transform(list_filter(z, lambda v: v[1] = '' or lower(v[1]) = own), lambda v: v[2]::bigint))) as closes from y""",
)
def closing_references(spark: SparkSession, d: str) -> DataFrame:
    own = F.regexp_replace(k.canonical_repository(F.col("repository")), "^[^/]+/", "")
    return table(spark, d, "pair_source_a").select("pair_id", k.closing_references(F.coalesce("message", F.lit("")), F.coalesce(own, F.lit(""))).alias("closes"))


@query("text_lines", r"""select id, case when buggy_code = '' then 0 else len(string_split_regex(regexp_replace(buggy_code, '(\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}])\z', ''), '\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]')) end as lines from pair_source_b where buggy_code is not null""")
def text_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pair_source_b").where("buggy_code is not null").select("id", text.line_total(F.col("buggy_code")).alias("lines"))


@query("final_newlines", "select id, buggy_code <> '' and right(buggy_code, 1) <> chr(10) as added, sha256(case when buggy_code <> '' and right(buggy_code, 1) <> chr(10) then buggy_code || chr(10) else buggy_code end) as hash from pair_source_b where buggy_code is not null")
def final_newlines(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "pair_source_b").where("buggy_code is not null").select("id", text.with_final_newline(F.col("buggy_code")).alias("x"))
    return x.select("id", "x.added", F.sha2("x.text", 256).alias("hash"))


@query("edit_analysis")
def edit_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Changed lines, level and kind of each edit. Equal texts are settled before any Python function runs."""
    rows = _pairs(spark, d)
    same = rows.where("old = new").select("id", F.lit(0).alias("changed"), F.lit("file_window").alias("level"), F.lit("unchanged").alias("kind"))
    edits = rows.where("old <> new").withColumn("c", diff.changed_deletions_udf("old", "new")).withColumn("spans", text.brace_spans_udf("old"))
    level = text.level(F.col("spans"), F.col("c.old_lines"))
    kind = text.edit_kind(F.col("old"), F.col("new"), F.col("c.changed"))
    return same.unionByName(edits.select("id", F.col("c.changed").alias("changed"), level.alias("level"), kind.alias("kind")))


@query("edit_windows")
def edit_windows(spark: SparkSession, d: str) -> DataFrame:
    """The window around each edit's changed lines, of at most 64 lines."""
    edits = _pairs(spark, d).where("old <> new").withColumn("c", diff.changed_both_udf("old", "new")).withColumn("total", text.line_total(F.col("old")))
    at = F.col("c.old_lines")
    return edits.where(F.size(at) > 0).select("id", text.window_around(F.col("total"), F.array_min(at), F.array_max(at), 64, 24).alias("w")).select("id", "w.start", "w.end")


@query("diff_round_trip")
def diff_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Diffs made, parsed and held against the patch policy."""
    edits = _pairs(spark, d).where("old <> new").select("id", diff.unified_udf(text.with_final_newline(F.col("old"))["text"], text.with_final_newline(F.col("new"))["text"], F.lit("main.cpp")).alias("patch"))
    p = edits.where("patch <> ''").withColumn("p", diff.parse_patch_udf("patch"))
    return p.select("id", "p.ok", "p.error", F.size("p.files").alias("files"), diff.policy(F.col("p"), F.array(F.lit("main.cpp"))).alias("refused"), F.size(diff.body_lines(F.col("patch"), "+")).alias("added"))


@query("output_match")
def output_match(spark: SparkSession, d: str) -> DataFrame:
    """Each test's output against the next one's of its problem."""
    from pyspark.sql import Window

    t = table(spark, d, "tests").where("problem_id is not null").withColumn("other", F.lead("output").over(Window.partitionBy(F.lower("problem_id")).orderBy("id")))
    return t.select("id", outputs_match_column(F.col("output"), F.col("other")).alias("same"), outputs_match_column(F.col("output"), F.concat("output", F.lit("\n"))).alias("itself"))


@query("json_payloads", """select repository, sha256('{"a":"' || full_name || '","b":' || coalesce(stargazers_count::varchar, 'null') || '}') as hash from repository_item""")
def json_payloads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "repository_item").select("repository", F.sha2(k.canonical_object({"b": F.col("stargazers_count"), "a": F.col("full_name")}), 256).alias("hash"))


@query("json_properties", """select event_id, list_sort(json_keys(props))[1] as first_key, len(json_keys(props)) as n_keys from events""")
def json_properties(spark: SparkSession, d: str) -> DataFrame:
    names = F.array_sort(F.json_object_keys("props"))
    return table(spark, d, "events").select("event_id", F.get(names, 0).alias("first_key"), F.size(names).alias("n_keys"))
