"""The library for plain SQL: tables as views, functions under their names."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomwright.functions import build, diff, match, text

#: Functions of columns that SQL can say, as (name, parameters, result, expression).
SQL_FUNCTIONS = (
    ("sha_nul", "a string, b string", "string", "sha2(a || '\\u0000' || b, 256)"),
    ("hash_bucket", "seed string, k string", "bigint", "cast(conv(substring(sha2(seed || '\\u0000' || k, 256), 1, 8), 16, 10) as bigint) % 100"),
    ("bare_name", "x string", "string", "regexp_replace(lower(x), '[^a-z0-9]+', '')"),
    ("line_total", "x string", "int", "case when x = '' then 0 else size(split(regexp_replace(x, '(\\\\r\\\\n|[\\\\n\\\\r])\\\\z', ''), '\\\\r\\\\n|[\\\\n\\\\r]')) end"),
    ("share_of", "part bigint, whole bigint", "double", "case when whole > 0 then part / whole else 0.0 end"),
)


@F.udtf(returnType="first int, last int")
class BraceSpans:
    """The rows of ``brace_spans`` of a text."""

    def eval(self, code: str) -> Iterator[tuple[int, int]]:
        yield from text.brace_spans(code) or []


@F.udtf(returnType="old_path string, new_path string, hunks int, is_binary boolean, metadata boolean")
class PatchFiles:
    """The file sections of a patch; none of one that isn't a pure unified diff."""

    def eval(self, patch: str) -> Iterator[tuple]:
        yield from diff.parse_patch(patch)[2]


def register_views(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    """A temporary view for each table of a folder."""
    from loomwright.session import table

    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def register_all(spark: SparkSession) -> list[str]:
    """Makes all functions callable from SQL in this session, and returns their names."""
    from loomwright.session import ship

    ship(spark)
    for name, parameters, result, body in SQL_FUNCTIONS:
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {result} return {body}")
    scalar = {
        "unified_diff": diff.unified_udf, "changed_deletions": diff.changed_deletions_udf, "changed_both": diff.changed_both_udf, "changed_blocks": diff.changed_blocks_udf,
        "parse_patch": diff.parse_patch_udf, "parse_zero_context": diff.parse_zero_context_udf, "brace_spans": text.brace_spans_udf, "harvest_paths": text.harvest_paths_udf,
        "tree_spans": build.tree_spans_udf, "test_catalogue": build.test_catalogue_udf, "test_results": build.test_results_udf, "outputs_match": match.outputs_match_udf,
    }
    for name, f in scalar.items():
        spark.udf.register(name, f)
    spark.udtf.register("brace_span_rows", BraceSpans)
    spark.udtf.register("patch_files", PatchFiles)
    return sorted([*(f[0] for f in SQL_FUNCTIONS), *scalar, "brace_span_rows", "patch_files"])
