"""The queries over the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import components as comp
from loomwright.llm.containers import fill_containers
from loomwright.llm.cross_split import crossing
from loomwright.llm.licences import along_paths, licences
from loomwright.llm.near_duplicates import classes_and_links, expand_pairs, groups
from loomwright.llm.pieces import Limits, split_oversized
from loomwright.llm.shared_spans import shared_share, shared_spans, without_repeats
from loomwright.llm.sources import judge_files
from loomwright.llm.tokens import token_counts, token_ids
from loomwright.session import staged, table

Query = Callable[[SparkSession, str], DataFrame]
CONTENTS = ["old_contents", "new_contents"]

# --- 1: source that isn't hand-written ---


def p1_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return judge_files(table(spark, d, "pair_source_a"), table(spark, d, "repository_item"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_verdicts(spark, d).where("verdict <> 'handwritten'").select("pair_id")


# --- 2: near-duplicate commit pairs ---


_LIKE = Fraction(7, 10)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = classes_and_links(table(spark, d, "pair_source_a"), "pair_id", CONTENTS, words=4, threshold=_LIKE)
    return expand_pairs(*found).select(F.col("a").alias("pair_id_a"), F.col("b").alias("pair_id_b"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every row once: its class of equal phrase sets, and the group that links between classes hold together."""
    return groups(table(spark, d, "pair_source_a"), "pair_id", CONTENTS, words=4, threshold=_LIKE).withColumnRenamed("id", "pair_id")


# --- 3: the same records on both sides of the split ---


def split_name(c: F.Column) -> F.Column:
    x = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(x == "train", "train").when(x == "test", "test").when(x.isin("validation", "valid", "val"), "validation")


def _crossing(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "pair_source_a").select(F.col("pair_id").alias("id"), split_name(F.col("split")).alias("part"), "source_dataset", *CONTENTS)
    return rows, crossing(rows.withColumn("held", F.col("part") != "train"), CONTENTS, words=4, threshold=Fraction(17, 20))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    _, pairs = _crossing(spark, d)
    return pairs.select(F.least("train_id", "eval_id").alias("pair_id_a"), F.greatest("train_id", "eval_id").alias("pair_id_b"))


def p3_containment(spark: SparkSession, d: str) -> DataFrame:
    """Each overlapping pair with the share of the evaluation record's phrases that the training record contains."""
    _, pairs = _crossing(spark, d)
    return pairs.select("train_id", "eval_id", "shared", "phrases", (F.col("shared") / F.col("phrases")).alias("containment"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation split and source: overlapping pairs, and how many of its records occur in training."""
    rows, pairs = _crossing(spark, d)
    own = rows.where("part in ('validation', 'test')").select(F.col("id").alias("eval_id"), "part", "source_dataset")
    hit = pairs.groupBy("eval_id").agg(F.count(F.lit(1)).alias("n"))
    joined = own.join(hit, "eval_id", "left")
    return joined.groupBy(F.col("part").alias("split"), "source_dataset").agg(F.count(F.lit(1)).alias("records"), F.count("n").alias("overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))


# --- 4: oversized code in pieces ---


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "pair_source_b"), "id", "buggy_code", Limits())


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The rows that came out in pieces; each has one first piece."""
    return p4_pieces(spark, d).where("piece_no = 1").select("id")


def p4_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """The exact round trip: pieces without their overlaps, put together again, and whether each is within the limits."""
    limits = Limits()
    own = F.decode(F.substring(F.encode("piece", "UTF-8"), F.col("overlap_octets") + 1, F.octet_length("piece")), "UTF-8")
    pieces = p4_pieces(spark, d).select("id", "piece_no", own.alias("own"), ((F.col("lines") <= limits.lines) & (F.octet_length("piece") <= limits.octets)).alias("fits"))
    # a text's pieces are no larger than the text, which one task held
    whole = pieces.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("piece_no", "own"))).alias("x"), F.bool_and("fits").alias("within"))
    return whole.select("id", F.md5(F.encode(F.array_join("x.own", ""), "UTF-8")).alias("digest"), "within")


# --- 5: licences of files and repositories ---


def p5_licences(spark: SparkSession, d: str) -> DataFrame:
    return licences(table(spark, d, "pair_source_a"), table(spark, d, "repository_item"), table(spark, d, "license_catalogue"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_licences(spark, d).where("finding is not null").select("scope", "item_key", "finding")


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    """The licence of each file along its folders and repository."""
    files = table(spark, d, "pair_source_a")
    found = along_paths(files, staged(p5_licences(spark, d), "licences"))
    return found.select(F.col("item_key").cast("long").alias("pair_id"), F.array_join("licences", " or ").alias("licences"), "level")


# --- 6: splits of related candidates ---


def _related(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pr_candidate")
    keys = {"repository": comp.canonical_repository(F.col("repository_split_group")), "problem": comp.problem_key(F.col("problem_id"))}
    return staged(comp.related_sets(rows, "candidate_seq", keys), "related")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    sets = _related(spark, d)
    rows = table(spark, d, "pr_candidate").select(F.col("candidate_seq").alias("id"), "projected_split")
    mixed = rows.join(sets, "id").groupBy("component").agg(F.min("projected_split").alias("lo"), F.max("projected_split").alias("hi")).where("lo <> hi").select("component")
    return sets.join(mixed, "component", "left_semi").select(F.col("id").alias("candidate_seq"))


def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    sets = _related(spark, d)
    order = {"train": 0, "validation": 1, "test": 2}
    shares = sorted(((r["split"], r["share"]) for r in table(spark, d, "split_target").collect()), key=lambda x: order.get(x[0], 9))
    splits = comp.assign_splits(sets, shares)
    return sets.join(splits, "component").select(F.col("id").alias("candidate_seq"), "component", "split")


def p6_balanced(spark: SparkSession, d: str) -> DataFrame:
    """Whether each row's set lies in one split, and the row's split has its share of all rows (within a fiftieth)."""
    rows = p6_splits(spark, d)
    whole = rows.groupBy("component").agg((F.min("split") == F.max("split")).alias("together"))
    total = rows.count()
    share = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")).join(table(spark, d, "split_target"), "split")
    share = share.select("split", (F.abs(F.col("n") / total - F.col("share")) < 0.02).alias("near"))
    return rows.join(whole, "component").join(share, "split").select("candidate_seq", "together", "near")


# --- 7, 8: tokens and containers of 2,048 ---


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(table(spark, d, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return fill_containers(token_counts(table(spark, d, "documents"), "doc_id", "text"), "doc_id", "tokens", 2048)


def p8_placed(spark: SparkSession, d: str) -> DataFrame:
    """Whether each document is placed, in containers that aren't overfull, and divided only if it is over 2,048 itself."""
    rows = staged(p8_containers(spark, d), "containers")
    fill = rows.where("container is not null").groupBy("container").agg(F.sum("piece_size").alias("fill"))
    each = rows.join(fill, "container", "left").groupBy("doc_id")
    out = each.agg(F.bool_and(F.col("container").isNotNull()).alias("placed"), F.coalesce(F.max("fill") <= 2048, F.lit(True)).alias("fits"), ((F.count(F.lit(1)) == 1) | (F.sum("piece_size") > 2048)).alias("undivided"))
    return out.select("doc_id", "placed", "fits", "undivided")


# --- 9: shared spans ---


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans(table(spark, d, "documents"), "doc_id", "text", 200).withColumnRenamed("id", "doc_id")


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return shared_share(docs, "doc_id", "text", shared_spans(docs, "doc_id", "text", 200)).withColumnRenamed("id", "doc_id")


def p9_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Each document's text less the sentences that a repeated run covers, as its length and digest."""
    kept = without_repeats(table(spark, d, "documents"), "doc_id", "text")
    return kept.select(F.col("id").alias("doc_id"), "removed", F.length("text").cast("long").alias("chars_kept"), F.md5(F.col("text").cast("binary")).alias("digest"))


_WORDS = "regexp_extract_all(coalesce({c}, ''), '[A-Za-z0-9_]+')"
_PHRASES = "list_transform(range(1, len({w}) - 2), lambda i: {w}[i] || ' ' || {w}[i + 1] || ' ' || {w}[i + 2] || ' ' || {w}[i + 3])"

_P2 = f"""
with w as (select pair_id, {_WORDS.format(c="old_contents")} as o, {_WORDS.format(c="new_contents")} as n from pair_source_a),
p as (select pair_id, unnest({_PHRASES.format(w="o")}) as ph from w union select pair_id, unnest({_PHRASES.format(w="n")}) from w),
c as (select pair_id, count(*) as n from p group by 1),
j as (select a.pair_id as x, b.pair_id as y, count(*) as s from p a join p b on a.ph = b.ph and a.pair_id < b.pair_id group by 1, 2)
select x as pair_id_a, y as pair_id_b from j join c ca on ca.pair_id = x join c cb on cb.pair_id = y where 10 * s >= 7 * (ca.n + cb.n - s)
"""

_SPLIT = "case lower(trim(split)) when 'train' then 'train' when 'test' then 'test' when 'validation' then 'validation' when 'valid' then 'validation' when 'val' then 'validation' end"
_P3 = f"""
with r as (select pair_id, source_dataset, {_SPLIT} as part, old_contents, new_contents from pair_source_a),
w as (select pair_id, 0 as side, part, {_WORDS.format(c="old_contents")} as o from r where part is not null
      union all select pair_id, 1, part, {_WORDS.format(c="new_contents")} from r where part is not null),
p as (select distinct pair_id, side, part, unnest({_PHRASES.format(w="o")}) as ph from w),
c as (select pair_id, side, count(*) as n from p group by 1, 2),
j as (select a.pair_id as x, a.side as sx, b.pair_id as y, b.side as sy, count(*) as s
      from p a join p b on a.ph = b.ph and a.part = 'train' and b.part <> 'train' group by all),
f as (select distinct x, y from j join c ca on ca.pair_id = x and ca.side = sx join c cb on cb.pair_id = y and cb.side = sy
      where 20 * s >= 17 * (ca.n + cb.n - s))
"""

_P6 = r"""
with recursive k as (select candidate_seq as id, projected_split,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(repository_split_group)), '^https?://', ''), '^git@([^:/]+):', '\1/'), '^/+|/+$', '', 'g'), '\.git$', '') as r,
    lower(trim(problem_id)) as q from pr_candidate),
n as (select id, projected_split, case when regexp_full_match(r, '[^/\s]+/[^/\s]+/[^/\s]+') then 'r' || r end as r,
    case when q not in ('', '-', '--', '?', 'n/a', 'na', 'nan', 'nil', 'none', 'null', 'placeholder', 'tbd', 'todo', 'unassigned', 'undefined', 'unknown', 'unset', 'missing') then 'p' || q end as q from k),
e as (select distinct r as u, q as v from n where r is not null and q is not null),
b as (select u, v from e union select v, u from e),
reach(u, v) as (select u, u from b union select reach.u, b.v from reach join b on reach.v = b.u),
c as (select u, min(v) as c from reach group by u),
s as (select n.id, n.projected_split, coalesce(c.c, n.r, n.q, 'row' || n.id) as c from n left join c on c.u = coalesce(n.r, n.q))
select id as candidate_seq from s where c in (select c from s group by c having count(distinct projected_split) > 1)
"""


_P2_GROUPS = f"""
with recursive pairs as ({_P2.strip().replace("with w as", "with w as", 1)}),
edges as (select pair_id_a as u, pair_id_b as v from pairs union all select pair_id_b, pair_id_a from pairs),
reach(u, v) as (select u, u from edges union select reach.u, edges.v from reach join edges on reach.v = edges.u),
g as (select u as pair_id, min(v) as group_id from reach group by 1),
w as (select pair_id, {_WORDS.format(c="old_contents")} as o, {_WORDS.format(c="new_contents")} as n from pair_source_a),
p as (select pair_id, unnest({_PHRASES.format(w="o")}) as ph from w union select pair_id, unnest({_PHRASES.format(w="n")}) from w),
k as (select pair_id, md5(string_agg(ph, chr(10) order by ph)) as k from p group by 1),
c as (select pair_id, min(pair_id) over (partition by k) as class_id from k)
select a.pair_id, coalesce(class_id, a.pair_id) as class_id, coalesce(group_id, a.pair_id) as group_id from pair_source_a a left join c using (pair_id) left join g using (pair_id)
"""

_P9 = """with w as (select doc_id, i, hash(substring(text, i, 200)) as h from documents, unnest(range(1, length(text) - 198)) r(i) where length(text) >= 200),
s as (select h from w group by h having min(doc_id) <> max(doc_id)),
m as (select doc_id, i from w semi join s using (h)),
g as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 200 then 0 else 1 end as new from m),
r as (select doc_id, i, sum(new) over (partition by doc_id order by i) as p from g),
spans as (select doc_id, min(i) - 1 as span_start, max(i) + 199 as span_end from r group by doc_id, p)
"""

_P9_CLEANED = r"""
with x as (select doc_id, text, regexp_extract_all(text, '(?s).*?(?:\n|[.!?] |。)|.+$') as s from documents where text <> ''),
s as (select doc_id, k, s[k] as sent from x, unnest(range(1, len(s) + 1)) r(k)),
p as (select doc_id, k, sent, sum(length(sent)) over (partition by doc_id order by k) - length(sent) as pos from s),
b as (select doc_id, k, pos from p union all select doc_id, max(k) + 1, sum(length(sent)) from p group by 1),
e as (select a.doc_id, a.k, min(c.k) as m, min(c.pos) as upto, any_value(a.pos) as pos from p a join b c on c.doc_id = a.doc_id and c.k between a.k + 2 and a.k + 52 and c.pos - a.pos >= 50 group by a.doc_id, a.k),
h as (select e.doc_id, k, m, md5(substring(text, (pos + 1)::bigint, (upto - pos)::bigint)) as h from e join x using (doc_id)),
f as (select h, min(struct_pack(d := doc_id, k := k)) as first from h group by h),
c as (select distinct h.doc_id, j from h join f using (h), unnest(range(h.k, h.m)) r(j) where struct_pack(d := h.doc_id, k := h.k) > f.first),
t as (select p.doc_id, count(c.j) as removed, coalesce(string_agg(sent, '' order by p.k) filter (c.j is null), '') as text from p left join c on c.doc_id = p.doc_id and c.j = p.k group by 1)
select doc_id, coalesce(removed, 0) as removed, length(coalesce(t.text, o.text)) as chars_kept, md5(coalesce(t.text, o.text)) as digest from documents o left join t using (doc_id)
"""


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p1_verdicts": p1_verdicts,
        "p2_found": p2_found,
        "p2_groups": p2_groups,
        "p3_found": p3_found,
        "p3_containment": p3_containment,
        "p3_counts": p3_counts,
        "p4_found": p4_found,
        "p4_pieces": p4_pieces,
        "p4_rejoined": p4_rejoined,
        "p5_found": p5_found,
        "p5_licences": p5_licences,
        "p5_paths": p5_paths,
        "p6_found": p6_found,
        "p6_splits": p6_splits,
        "p6_balanced": p6_balanced,
        "p7_ids": p7_ids,
        "p8_containers": p8_containers,
        "p8_placed": p8_placed,
        "p9_found": p9_found,
        "p9_shared": p9_shared,
        "p9_cleaned": p9_cleaned,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _P2,
        "p3_found": _P3 + "select least(x, y) as pair_id_a, greatest(x, y) as pair_id_b from f",
        "p3_counts": _P3 + """, h as (select y, count(*) as n from f group by 1)
            select part as split, source_dataset, count(*) as records, count(h.n) as overlapping, coalesce(sum(h.n), 0)::bigint as pairs
            from r left join h on h.y = r.pair_id where part in ('validation', 'test') group by 1, 2""",
        "p4_found": r"""select id from pair_source_b where (strlen(buggy_code) + 512) // 4 > 2048
            or length(buggy_code) - length(replace(buggy_code, chr(10), '')) + (case when buggy_code <> '' and right(buggy_code, 1) <> chr(10) then 1 else 0 end) > 200""",
        "p2_groups": _P2_GROUPS,
        "p3_containment": _P3.rstrip()[:-1].replace("select distinct x, y from", "select x, y, max(struct_pack(share := s / cb.n, s := s, n := cb.n)) as m from") + " group by 1, 2) select x as train_id, y as eval_id, m.s as shared, m.n as phrases, m.share as containment from f",
        "p4_rejoined": r"""select id, md5(buggy_code) as digest, true as within from pair_source_b where (strlen(buggy_code) + 512) // 4 > 2048
            or length(buggy_code) - length(replace(buggy_code, chr(10), '')) + (case when buggy_code <> '' and right(buggy_code, 1) <> chr(10) then 1 else 0 end) > 200""",
        "p6_balanced": "select candidate_seq, true as together, true as near from pr_candidate",
        "p6_found": _P6,
        "p8_placed": "select doc_id, coalesce(text <> '', false) as placed, true as fits, true as undivided from documents",
        "p9_found": _P9 + "select doc_id, span_start, span_end from spans",
        "p9_shared": _P9 + """select d.doc_id, coalesce(length(text), 0) as chars, coalesce(sum(span_end - span_start), 0)::bigint as shared_chars, count(span_end) as spans from documents d left join spans using (doc_id) group by 1, 2""",
        "p9_cleaned": _P9_CLEANED,
    }
