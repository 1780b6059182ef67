"""Usage and follow-up queries over the events, read as calls of a run and as its tool log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.operators import usage
from veritally.plans.views import table

GROUPINGS = ["agent", "tier", "model"]


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call an event: who made it, how long it took, and what it cost (unknown for some)."""
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("agent"),
        F.concat(F.lit("t"), (u % 3).cast("string")).alias("tier"),
        F.concat(F.lit("m"), (u % 7).cast("string")).alias("model"),
        F.col("value").alias("latency"),
        F.when(~((u % 7 == 3) & (e % 97 == 0)), e % 1000).alias("cost"),
        (e % 13 == 0).alias("failed"),
        (e % 7 == 0).alias("cached"),
    )


def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, failures, cost and mean latency by agent, tier, model and in all, in one pass."""
    measures = {"calls": F.count("*"), "cache_hits": F.count_if("cached"), "failures": F.count_if("failed"), "cost": usage.whole_sum(F.col("cost")), "mean_latency": F.round(F.avg("latency"), 6)}
    return usage.roll_up(attempts(spark, sf_dir), GROUPINGS, measures)


def usage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the parts of each grouping sum to the total."""
    measures = {"calls": F.count("*"), "failures": F.count_if("failed"), "cost": usage.whole_sum(F.col("cost"))}
    return usage.total_check(usage.roll_up(attempts(spark, sf_dir), GROUPINGS, measures), [*measures])


def latency_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95th percentile by index of each agent's latencies."""
    return usage.index_percentile(attempts(spark, sf_dir), ["agent"], "latency", 0.95, "p95")


def lead_follow_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed leads of each user's log, and whether an independent attempt came after."""
    events = table(spark, sf_dir, "events").withColumn("lead", F.when(F.col("event_type").isin("error", "purchase"), (F.col("event_id") % 17).cast("string")))
    query = F.when(F.col("event_type") == "view", F.floor("value").cast("string"))
    return usage.followed_up(events, "user_id", "event_id", "lead", F.col("lead").isNotNull(), F.col("event_type") == "error", query)


def success_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each agent that went well, failed, or came from the cache."""
    ok = ~F.col("failed") & ~F.col("cached")
    return attempts(spark, sf_dir).groupBy("agent").agg(F.count_if(ok).alias("n_ok"), F.count_if("failed").alias("n_failed"), F.count_if(F.col("cached") & ~F.col("failed")).alias("n_cached"))


QUERIES = {f.__name__: f for f in (usage_rollup, usage_check, latency_p95, lead_follow_up, success_stats)}

ATTEMPTS_SQL = """
a as (select event_type as agent, 't' || (user_id % 3) as tier, 'm' || (user_id % 7) as model, value as latency,
    case when not (user_id % 7 = 3 and event_id % 97 = 0) then event_id % 1000 end as cost, event_id % 13 = 0 as failed, event_id % 7 = 0 as cached from events),
g as (select unnest([{'grouping': 'agent', 'name': agent}, {'grouping': 'tier', 'name': tier}, {'grouping': 'model', 'name': model}, {'grouping': 'all', 'name': null}]) as u, a.* from a),
rolled as (select u.grouping as grouping, u.name as name, count(*) as calls, count(*) filter (cached) as cache_hits, count(*) filter (failed) as failures,
    case when count(*) = count(cost) then sum(cost)::bigint end as cost, round(avg(latency), 6) as mean_latency from g group by u.grouping, u.name)"""

ORACLE_SQL = {
    "usage_rollup": f"with {ATTEMPTS_SQL} select * from rolled",
    "usage_check": f"""with {ATTEMPTS_SQL}, m as (select grouping, unnest([{{'measure': 'calls', 'v': calls::double}}, {{'measure': 'failures', 'v': failures::double}}, {{'measure': 'cost', 'v': cost::double}}]) as u from rolled),
p as (select grouping, u.measure as measure, case when count(*) = count(u.v) then sum(u.v) end as v from m group by 1, 2)
select p.grouping as grouping, p.measure as measure, t.v as total, p.v as parts, abs(t.v - p.v) <= 1e-6 as agrees from p join p t using (measure) where p.grouping <> 'all' and t.grouping = 'all'""",
    "latency_p95": f"with {ATTEMPTS_SQL}, s as (select agent, latency, row_number() over (partition by agent order by latency) as nth, count(*) over (partition by agent) as n from a) select agent, latency as p95 from s where nth = floor(0.95 * (n - 1)) + 1",
    "lead_follow_up": """with e as (select user_id as run, event_id as seq, case when event_type in ('error', 'purchase') then (event_id % 17)::varchar end as lead, event_type = 'error' as bad, case when event_type = 'view' then floor(value)::bigint end as q from events),
f as (select run, lead, max(seq) as last_fail from e where lead is not null and bad group by run, lead), n as (select run, q, min(seq) as seq from e where q is not null group by run, q)
select f.run, f.lead, last_fail, exists (select 1 from n where n.run = f.run and n.seq > f.last_fail) or exists (select 1 from e where e.run = f.run and e.lead <> f.lead and e.seq > f.last_fail) as followed from f""",
    "success_stats": f"with {ATTEMPTS_SQL} select agent, count(*) filter (not failed and not cached) as n_ok, count(*) filter (failed) as n_failed, count(*) filter (cached and not failed) as n_cached from a group by agent",
}
