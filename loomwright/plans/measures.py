"""Summaries, distributions, comparisons and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import gates, metrics
from loomwright.plans.registry import query
from loomwright.session import table

_COUNTS = "count(*) as total, count(*) filter (l_linestatus = 'F') as finished, count(*) filter (l_returnflag = 'R') as returned, count(*) filter (l_quantity > 45) as large"


@query(
    "slice_summary",
    f"""with s as (select 'all' as slice_by, 'all' as slice, {_COUNTS} from lineitem union all select 'l_returnflag', l_returnflag, {_COUNTS} from lineitem group by 2 union all select 'l_linestatus', l_linestatus, {_COUNTS} from lineitem group by 2)
        select *, finished / total as finished_rate, returned / total as returned_rate from s""",
)
def slice_summary(spark: SparkSession, d: str) -> DataFrame:
    counts = {"finished": F.col("l_linestatus") == "F", "returned": F.col("l_returnflag") == "R", "large": F.col("l_quantity") > 45}
    return metrics.sliced(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], counts, rates=["finished", "returned"])


@query(
    "stage_funnel",
    """with r as (select case event_type when 'view' then 0 when 'click' then 1 when 'search' then 1 when 'signup' then 2 when 'purchase' then 3 else 0 end as r from events),
       s(ord, stage, t) as (values (0, 'seen', 0), (1, 'engaged', 1), (2, 'joined', 2), (3, 'bought', 3))
       select ord, stage, count(*) filter (r >= t) as n, count(*) filter (r >= t) / count(*) as share from r, s group by 1, 2""",
)
def stage_funnel(spark: SparkSession, d: str) -> DataFrame:
    ranks = {"view": 0, "click": 1, "search": 1, "signup": 2, "purchase": 3}
    state = F.when(F.col("event_type").isin(*ranks), F.col("event_type")).otherwise("view")
    return metrics.funnel(table(spark, d, "events"), state, ranks, [("seen", 0), ("engaged", 1), ("joined", 2), ("bought", 3)])


@query("numeric_summary", """select l_shipmode_free as flag, count(l_quantity) as count, min(l_quantity) as min, quantile_cont(l_quantity, 0.25) as p25, quantile_cont(l_quantity, 0.5) as median, quantile_cont(l_quantity, 0.75) as p75, max(l_quantity) as max, round(avg(l_quantity), 9) as mean
    from (select l_returnflag as l_shipmode_free, l_quantity from lineitem) group by 1""")  # fmt: skip
def numeric_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_quantity")
    return metrics.numeric_summary(rows, "l_quantity", ["flag"]).withColumn("mean", F.round("mean", 9))


@query("floor_percentile", """with s as (select kind, length(text) as v, row_number() over (partition by kind order by length(text)) - 1 as i, count(*) over (partition by kind) as n from documents where text is not null),
    f(fraction) as (values (0.5::double), (0.9::double), (0.95::double), (0.99::double)) select kind, fraction, v as value from s, f where i = floor((n - 1) * fraction)""")  # fmt: skip
def floor_percentile(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("kind", F.length("text").alias("v"))
    return metrics.floor_percentile(rows, "v", [0.5, 0.9, 0.95, 0.99], ["kind"])


@query(
    "ks_distance",
    """with c as (select l_linestatus as s, l_extendedprice as v, count(*) filter (l_returnflag = 'R') as a, count(*) filter (l_returnflag = 'A') as b from lineitem group by 1, 2),
       r as (select s, sum(a) over w as ca, sum(b) over w as cb, sum(a) over (partition by s) as na, sum(b) over (partition by s) as nb from c window w as (partition by s order by v))
       select s as l_linestatus, round(max(abs(ca / nullif(na, 0) - cb / nullif(nb, 0))), 9) as ks from r group by 1""",
)
def ks_distance(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ks_distance(table(spark, d, "lineitem"), "l_extendedprice", "l_returnflag", "R", "A", ["l_linestatus"]).withColumn("ks", F.round("ks", 9))


@query("total_variation", """with c as (select kind, count(*) filter (source = 'issue-tracker') as a, count(*) filter (source <> 'issue-tracker') as b from documents group by 1) select round(sum(abs(a / nullif((select sum(a) from c), 0) - b / nullif((select sum(b) from c), 0))) / 2, 9) as tv from c""")
def total_variation(spark: SparkSession, d: str) -> DataFrame:
    side = F.when(F.col("source") == "issue-tracker", "a").when(F.col("source").isNotNull(), "b")
    return metrics.total_variation(table(spark, d, "documents").withColumn("side", side), "kind", "side", "a", "b").withColumn("tv", F.round("tv", 9))


@query("binned_histogram", """select bin, count(*) as n from (select case when v >= 0 and v < 50 then '[0,50)' when v < 100 then '[50,100)' when v < 150 then '[100,150)' when v < 200 then '[150,200)' when v < 257 then '[200,257)' when v < 1000000 then '[257,1000000)' end as bin from
    (select length(buggy_code) - length(replace(buggy_code, chr(10), '')) as v from pair_source_b)) group by 1""")  # fmt: skip
def binned_histogram(spark: SparkSession, d: str) -> DataFrame:
    ends = F.length("buggy_code") - F.length(F.replace("buggy_code", F.lit("\n"), F.lit("")))
    bin_ = metrics.binned(ends, [0, 50, 100, 150, 200, 257, 1_000_000])
    return table(spark, d, "pair_source_b").groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


_DIMS = ("o_orderstatus", "o_orderpriority")


@query(
    "group_success",
    "with x as (" + " union all ".join(f"select '{c}' as dimension, {c} as level, count(*) as total, count(*) filter (o_totalprice > 200000) as success from orders group by 2" for c in _DIMS) + ") select *, success / total as success_rate, case when sum(success) over (partition by dimension) > 0 then success / sum(success) over (partition by dimension) else 0.0 end as share_of_successes from x",
)
def group_success(spark: SparkSession, d: str) -> DataFrame:
    return metrics.group_success(table(spark, d, "orders"), list(_DIMS), F.col("o_totalprice") > 200000)


@query("percentile_rank", "select p_partkey, p_retailprice, cume_dist() over (order by p_retailprice) as rank from part")
def percentile_rank(spark: SparkSession, d: str) -> DataFrame:
    return metrics.percentile_rank(table(spark, d, "part"), "p_retailprice", ["p_partkey"])


_RUNS = "a as (select user_id, arg_max(event_type, event_id) as t from events where event_id % 2 = 0 group by 1), b as (select user_id, arg_max(event_type, event_id) as t from events where event_id % 2 = 1 group by 1)"


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two runs over the same users: the last of their events of even and of odd number."""
    e = table(spark, d, "events")
    return tuple(e.where(F.col("event_id") % 2 == i).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("t")) for i in (0, 1))


@query("transition_matrix", f"with {_RUNS} select coalesce(a.t, 'absent') || '->' || coalesce(b.t, 'absent') as transition, count(*) as n from a full join b using (user_id) group by 1")
def transition_matrix(spark: SparkSession, d: str) -> DataFrame:
    return metrics.transitions(*_runs(spark, d), "user_id", "t")


@query("membership_changes", f"with {_RUNS}, x as (select user_id from a where t = 'click'), y as (select user_id from b where t = 'click') select coalesce(x.user_id, y.user_id) as user_id, case when x.user_id is null then 'introduced' when y.user_id is null then 'resolved' else 'retained' end as change from x full join y on x.user_id = y.user_id")
def membership_changes(spark: SparkSession, d: str) -> DataFrame:
    return metrics.membership_changes(*_runs(spark, d), "user_id", F.col("t") == "click")


def _paired(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select((F.col("user_id") % 3).alias("slice"), "event_id", (F.col("value") > 30).alias("before"), (F.col("value") * 1.1 > 32).alias("after"))


@query("paired_difference", "select user_id % 3 as slice, count(*) as n, round(avg((value * 1.1 > 32)::int - (value > 30)::int), 9) as observed from events where value is not null group by 1")
def paired_difference(spark: SparkSession, d: str) -> DataFrame:
    diff = F.col("after").cast("int") - F.col("before").cast("int")
    return _paired(spark, d).where("before is not null").groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(diff), 9).alias("observed"))


@query("bootstrap_interval")
def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    return metrics.bootstrap(_paired(spark, d), ["slice"], "before", "after", "event_id")


@query(
    "bootstrap_bounds",
    """with d as (select user_id % 3 as slice, (value * 1.1 > 32)::int - (value > 30)::int as d from events where value is not null)
       select slice, count(*) as n, round(avg(d), 9) as observed, true as around, true as as_wide from d group by 1""",
)
def bootstrap_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The interval lies around the observed difference, and is as wide as its standard error says (within a tenth)."""
    pairs = _paired(spark, d)
    diff = F.col("after").cast("double") - F.col("before").cast("double")
    spread = pairs.where(diff.isNotNull()).groupBy("slice").agg((F.stddev_pop(diff) / F.sqrt(F.count(F.lit(1)))).alias("error"))
    found = metrics.bootstrap(pairs, ["slice"], "before", "after", "event_id").join(spread, "slice")
    wide = F.abs((F.col("high") - F.col("low")) / (2 * 1.959964 * F.col("error")) - 1) < 0.1
    return found.select("slice", "n", F.round("observed", 9).alias("observed"), ((F.col("low") <= F.col("observed")) & (F.col("observed") <= F.col("high"))).alias("around"), wide.alias("as_wide"))


_SHIFT = "select x.*, case when l_returnflag = 'R' then 'b' else 'a' end as side from lineitem x"


@query(
    "distribution_shift",
    f"""with x as ({_SHIFT}), l as (select 'l_linestatus' as feature, l_linestatus as v, count(*) filter (side = 'a') as a, count(*) filter (side = 'b') as b from x group by 2 union all select 'l_shipmonth', month(l_shipdate)::varchar, count(*) filter (side = 'a'), count(*) filter (side = 'b') from x group by 2),
       t as (select feature, sum(a) as na, sum(b) as nb from l group by 1)
       select feature, round(sum(abs(a / na - b / nb)) / 2, 9) as tv from l join t using (feature) group by 1""",
)
def distribution_shift(spark: SparkSession, d: str) -> DataFrame:
    """Several categorical features at once: unpivoted, so one shuffle serves them all."""
    x = table(spark, d, "lineitem").withColumn("side", F.when(F.col("l_returnflag") == "R", "b").otherwise("a"))
    flat = x.select("side", F.explode(F.array(F.struct(F.lit("l_linestatus").alias("feature"), F.col("l_linestatus").alias("v")), F.struct(F.lit("l_shipmonth").alias("feature"), F.month("l_shipdate").cast("string").alias("v")))).alias("x")).select("side", "x.*")
    return metrics.total_variation(flat, "v", "side", "a", "b", ["feature"]).withColumn("tv", F.round("tv", 9))


@query("minimum_report", """with a as (select projected_split as s, count(*) as actual from pr_candidate where projected_split is not null group by 1), t(s, target) as (values ('train', 1000), ('validation', 1000), ('test', 10), ('extra', 1))
    select s as split, coalesce(actual, 0) as actual, target::bigint as target, coalesce(actual, 0) >= target as met from t left join a using (s)""")  # fmt: skip
def minimum_report(spark: SparkSession, d: str) -> DataFrame:
    actual = table(spark, d, "pr_candidate").where("projected_split is not null").groupBy(F.col("projected_split").alias("split")).agg(F.count(F.lit(1)).alias("actual"))
    targets = spark.createDataFrame([("train", 1000), ("validation", 1000), ("test", 10), ("extra", 1)], "split string, target long")
    return gates.minimums(actual, targets, "split")


@query(
    "gate_report",
    """with r as (select avg((l_linestatus = 'F')::int) as finished, avg((l_returnflag = 'R')::int) as returned, count(*) as n from lineitem)
       select round(finished, 9) as finished, round(returned, 9) as returned, n, array_to_string(list_sort(list_filter([case when finished < 0.6 - 1e-12 then 'finished_low' end, case when returned > 0.2 + 1e-12 then 'returned_high' end, case when n < 100 then 'too_few' end], lambda x: x is not null)), ',') as reasons,
       finished >= 0.6 - 1e-12 and returned <= 0.2 + 1e-12 and n >= 100 as passed from r""",
)
def gate_report(spark: SparkSession, d: str) -> DataFrame:
    row = table(spark, d, "lineitem").agg(F.avg((F.col("l_linestatus") == "F").cast("int")).alias("finished"), F.avg((F.col("l_returnflag") == "R").cast("int")).alias("returned"), F.count(F.lit(1)).alias("n"))
    out = gates.gate(row, [("finished_low", gates.below(F.col("finished"), 0.6)), ("returned_high", gates.above(F.col("returned"), 0.2)), ("too_few", F.col("n") < 100)])
    return out.select(F.round("finished", 9).alias("finished"), F.round("returned", 9).alias("returned"), "n", F.array_join("reasons", ",").alias("reasons"), "passed")


@query("reachability", """select projected_split as part, count(*) filter (closed_at is not null or pr_number % 2 = 0) >= 100 and count(distinct case when closed_at is not null or pr_number % 2 = 0 then repository_split_group end) >= 50 as reachable,
    count(*) filter (closed_at is not null or pr_number % 2 = 0) as best_rows, count(distinct case when closed_at is not null or pr_number % 2 = 0 then repository_split_group end) as best_groups from pr_candidate group by 1""")  # fmt: skip
def reachability(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pr_candidate").withColumnRenamed("projected_split", "part")
    return gates.reachable(rows, "part", "repository_split_group", F.col("closed_at").isNotNull(), F.coalesce(F.col("pr_number") % 2 == 0, F.lit(False)), 100, 50)


@query("share_limits", "with c as (select repository, count(*) as n from documents group by 1) select repository, n, n / sum(n) over () as share, n / sum(n) over () > 0.03 + 1e-12 as over from c")
def share_limits(spark: SparkSession, d: str) -> DataFrame:
    return gates.share_limits(table(spark, d, "documents"), "repository", 0.03)


@query("success_of_any", "select o_custkey, max((o_totalprice > 250000)::int) as any_success, count(*) as tries from orders group by 1")
def success_of_any(spark: SparkSession, d: str) -> DataFrame:
    """Whether a group has at least one success among its tries."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max((F.col("o_totalprice") > 250000).cast("int")).alias("any_success"), F.count(F.lit(1)).alias("tries"))


@query("zero_filled_status", """with s(event_type) as (values ('click'), ('purchase'), ('refund'), ('view')) select s.event_type, count(e.event_id) as n, coalesce(max(e.value), 0) as peak from s left join events e using (event_type) group by 1""")
def zero_filled_status(spark: SparkSession, d: str) -> DataFrame:
    """Counts over a fixed list of states; a state that doesn't occur keeps its row."""
    states = spark.createDataFrame([(x,) for x in ("click", "purchase", "refund", "view")], "event_type string")
    have = table(spark, d, "events").groupBy("event_type").agg(F.count("event_id").alias("n"), F.max("value").alias("peak"))
    return states.join(have, "event_type", "left").select("event_type", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("peak", F.lit(0.0)).alias("peak"))


@query("nested_suite_summary", """select l_orderkey % 5 as bucket, case when l_linenumber <= 2 then 'public' else 'hidden' end as suite, count(*) as total, count(*) filter (l_linestatus = 'F') as matched, bool_and(l_linestatus = 'F') as all_matched from lineitem group by 1, 2""")
def nested_suite_summary(spark: SparkSession, d: str) -> DataFrame:
    """Summary of nested outcomes: arrays of structs per case, unnested once, then counted."""
    outcome = F.struct(F.when(F.col("l_linenumber") <= 2, "public").otherwise("hidden").alias("suite"), (F.col("l_linestatus") == "F").alias("matched"))
    cases = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(outcome).alias("outcomes"))
    flat = cases.select((F.col("l_orderkey") % 5).alias("bucket"), F.explode("outcomes").alias("o")).select("bucket", "o.*")
    return flat.groupBy("bucket", "suite").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("matched")).alias("matched"), F.coalesce(F.bool_and("matched"), F.lit(False)).alias("all_matched"))


@query("timeout_any", """select l_orderkey, bool_or(l_quantity > 49) or bool_or(l_tax > 0.079) as timed_out from lineitem group by 1""")
def timeout_any(spark: SparkSession, d: str) -> DataFrame:
    """A flag of a case that any of its stages or any nested outcome sets."""
    stages = F.collect_list(F.struct((F.col("l_quantity") > 49).alias("late"), F.array(F.struct((F.col("l_tax") > 0.079).alias("late"))).alias("outcomes")))
    cases = table(spark, d, "lineitem").groupBy("l_orderkey").agg(stages.alias("stages"))
    return cases.select("l_orderkey", F.exists("stages", lambda s: s["late"] | F.exists(s["outcomes"], lambda o: o["late"])).alias("timed_out"))
