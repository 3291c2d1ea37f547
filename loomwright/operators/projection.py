"""Records out of documents: either a row of fields or the first reason why there is none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.operators.rules import RuleSet


def project(df: DataFrame, key: Sequence[str], checks: Sequence[tuple[str, Column]], fields: dict[str, Column]) -> DataFrame:
    """(key..., reason, fields...): the first failing check names the reason, and the fields of such a row are null.

    Checks are conditions that refuse, in the order in which they count; one that comes out null refuses. Everything is
    one projection, so the scan reads only the columns that checks and fields name.
    """
    refused = RuleSet.of(*[(name, F.coalesce(bad, F.lit(True))) for name, bad in checks]).first_reason()
    marked = df.select(*key, refused.alias("reason"), *[c.alias(f"_f_{n}") for n, c in fields.items()])
    return marked.select(*key, "reason", *[F.when(F.col("reason").isNull(), F.col(f"_f_{n}")).alias(n) for n in fields])


def staged_outcomes(projected: DataFrame, stage: str) -> DataFrame:
    """(outcome, n): ``stage:reason`` of the refused rows and ``stage:selected`` of the others."""
    return projected.groupBy(F.concat_ws(":", F.lit(stage), F.coalesce("reason", F.lit("selected"))).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def public(df: DataFrame, allowed: Sequence[str], hashed: dict[str, Column] | None = None) -> DataFrame:
    """Only the allowed columns, and hashes in the place of what identifies a row; a missing column is an error."""
    missing = sorted(set(allowed) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}")
    return df.select(*allowed, *[F.sha2(c.cast("string"), 256).alias(n) for n, c in (hashed or {}).items()])


def decoded(content: Column) -> Column:
    """The octets of a base64 text in lines, or null if it holds anything else (other signs, wrong length or padding)."""
    flat = F.regexp_replace(content, r"\s", "")
    good = flat.rlike(r"^[A-Za-z0-9+/]*={0,2}$") & (F.length(flat) % 4 == 0)
    return F.when(good, F.unbase64(flat))


def merge_commit(parents: Column, head: Column) -> Column:
    """(base, kind) of a commit: one parent is ``plain``; two are ``merge`` if the second is the head; else null."""
    n = F.size(parents)
    second = F.element_at(F.when(n == 2, parents), 2)
    kind = F.when(n == 1, "plain").when((n == 2) & (second == head), "merge")
    return F.when(kind.isNotNull(), F.struct(parents[0].alias("base"), kind.alias("kind")))


def file_list(files: Column, per_page: int, safe: object) -> Column:
    """(reason, files sorted by path) of a page of changed files: a full page may go on (``ambiguous``), paths are safe
    (``unsafe``) and no path is there twice (``repeated``)."""
    paths = F.transform(files, lambda f: f["path"])
    reason = (
        F.when(files.isNull() | (F.size(files) == 0), "empty")
        .when(F.size(files) >= per_page, "ambiguous")
        .when(~F.forall(paths, safe), "unsafe")
        .when(F.size(F.array_distinct(paths)) < F.size(paths), "repeated")
    )
    return F.struct(reason.alias("reason"), F.when(reason.isNull(), F.array_sort(files)).alias("files"))


def admissible(files: Column, is_test: object, is_production: object, is_manifest: object, targets: int, tests: int) -> Column:
    """Why a change (array of path, status) isn't taken, or null: a number of production files other than ``targets``,
    fewer tests than ``tests``, a production file that isn't modified, a build manifest outside the tests."""
    outside = F.filter(files, lambda f: ~is_test(f["path"]))
    production = F.filter(outside, lambda f: is_production(f["path"]))
    return (
        F.when(F.size(production) != targets, "target_count")
        .when(F.size(files) - F.size(outside) < tests, "no_test")
        .when(~F.forall(production, lambda f: f["status"] == "M"), "not_modified")
        .when(F.exists(outside, lambda f: is_manifest(f["path"])), "manifest")
    )
