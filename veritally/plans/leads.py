"""Queries of lead accounting: a user's events are a run, its searches and fetches, and what its ledger says of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.operators import leads as operators
from veritally.plans.views import table
from veritally.shared import spread, written

DISPOSITIONS = ("opened", "not_opened_secondary", "not_opened_off_topic")


def _url(r: Column, v: Column) -> Column:
    """An address of record ``r``: two that share a PMID, one without a record, one with a DOI, none, a third by PMID."""
    n, r = (r + 100_000).cast("string"), r.cast("string")
    forms = [("https://pubmed.ncbi.nlm.nih.gov/", n, "/"), ("http://europepmc.org/article/med/", n, "?utm_source=x"), ("https://www.Site", r, ".org/en/p?b=2&a=1#top"), ("https://doi-host.org/10.1234/AB", r, "/full"), ("no address ", r, ""), ("https://www.ncbi.nlm.nih.gov/pubmed/", n, "")]
    return F.get(F.array(*(F.concat(F.lit(a), x, F.lit(b)) for a, x, b in forms)), v.cast("int"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, value = F.col("event_id"), F.floor(F.abs("value"))
    search = e % 3 == 0
    link = lambda r, v: F.concat(F.lit('{"title": "t", "url": "'), _url(r, v), F.lit('"}'))
    told = F.concat(F.lit("Seen.\nLinks: ["), link(e * 7 % 19, e % 4), F.lit(", "), link(e * 5 % 29, e % 7 % 4), F.lit("]\nMore"))
    return spread(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")).select(
        F.col("user_id").alias("run"),
        e.alias("seq"),
        F.when(search, "WebSearch").otherwise("WebFetch").alias("tool"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "wall").otherwise("request").alias("kind"),
        F.when(search, F.when(e % 11 == 0, " ").otherwise(F.concat(F.lit("Query  "), (value % 9).cast("string")))).alias("query"),
        F.when(~search, _url(e % 31, value % 5)).alias("url"),
        F.when(search, told).otherwise(F.when(value % 2 == 0, "page").otherwise("")).alias("returned"),
    )


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    said = F.get(F.array(*(F.lit(d) for d in DISPOSITIONS)), (e % 3).cast("int"))
    return spread(table(spark, sf_dir, "events").select("event_id", "user_id")).select(F.col("user_id").alias("run"), _url(e % 37, F.floor(e / 5) % 6).alias("address"), said.alias("disposition"))


def _accounts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    events, ledger = written(_events(spark, sf_dir), "events"), written(_ledger(spark, sf_dir), "ledger")
    runs = written(events.select("run").distinct().withColumn("inventory_empty", F.col("run") % 2 == 0), "runs")
    return events, ledger, runs, *operators.lead_accounts(events, ledger, runs)


def lead_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's leads: their first address, what came of them, and by which address."""
    return _accounts(spark, sf_dir)[3].drop("lead")


def lead_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's problems and warnings, by code and address."""
    return _accounts(spark, sf_dir)[4]


def lead_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's counts, and whether it followed all its leads."""
    return operators.lead_summary(*_accounts(spark, sf_dir))


def _url_sql(r: str, v: str) -> str:
    n = f"({r} + 100000)"
    return f"['https://pubmed.ncbi.nlm.nih.gov/' || {n} || '/', 'http://europepmc.org/article/med/' || {n} || '?utm_source=x', 'https://www.Site' || ({r}) || '.org/en/p?b=2&a=1#top', 'https://doi-host.org/10.1234/AB' || ({r}) || '/full', 'no address ' || ({r}), 'https://www.ncbi.nlm.nih.gov/pubmed/' || {n}][({v}) + 1]"


#: A lead is told by what its address is made from: a PMID, a site or a DOI.
_SQL = f"""
e as (select user_id as run, event_id as e, event_id % 3 = 0 as search, event_type = 'error' or event_type = 'purchase' as bad, floor(abs(value))::bigint as value from events),
runs as (select distinct run, run % 2 = 0 as inventory_empty from e),
named as (
  select run, e, 0 as place, e * 7 % 19 as r, e % 4 as v, true as found from e where search and not bad union all select run, e, 1, e * 5 % 29, e % 7 % 4, true from e where search and not bad
  union all select run, e, 0, e % 31, value % 5, false from e where not search and value % 5 < 4),
nodes as (select *, case when v < 2 then 'p' || r when v = 2 then 's' || r else 'd' || r end as lead, {_url_sql("r", "v")} as url from named),
keys as (select run, r, v, lead, bool_or(found) as listed from nodes group by all),
fetches as (select n.run, n.e, n.lead, not e.bad as content, k.listed from nodes n join e using (run, e) join keys k on k.run = n.run and k.r = n.r and k.v = n.v where not n.found),
tried as (select run, lead, count(*) as n, bool_or(content) as content, bool_or(content and listed) as listed, max(e) as last_e from fetches group by run, lead),
rows_ as (select user_id as run, event_id % 37 as r, (event_id // 5) % 6 as v, event_id % 3 as d from events),
row_leads as (
  select x.*, {_url_sql("x.r", "x.v")} as address, case when k.run is not null then k.lead when x.v in (0, 1, 5) then p.lead when x.v = 3 then null end as lead
  from rows_ x left join keys k on k.run = x.run and k.r = x.r and k.v = x.v left join (select distinct run, lead from nodes where v < 2) p on p.run = x.run and p.lead = 'p' || x.r),
said as (select run, lead, count(*) as n_rows, bool_or(d = 0) as opened, bool_or(d > 0) as not_opened from row_leads where lead is not null group by run, lead),
leads as (
  select f.run, f.lead, address, from_search, case left(f.lead, 1) when 'p' then 1 when 'd' then 2 else 0 end as ids, coalesce(t.n, 0) as n, coalesce(content, false) as content, coalesce(listed, false) as listed, last_e,
    coalesce(n_rows, 0) as n_rows, coalesce(opened, false) as opened, coalesce(not_opened, false) as not_opened
  from (select run, lead, first(url order by e, place) as address, bool_or(found) as from_search from nodes group by run, lead) f left join tried t using (run, lead) left join said using (run, lead)),
queries as (select run, q, min(e) as e from (select run, e, value % 9 as q from e where search and e % 11 > 0) group by run, q),
judged as (
  select l.*, inventory_empty, exists (select 1 from queries q where q.run = l.run and q.e > l.last_e) or exists (select 1 from fetches f where f.run = l.run and f.e > l.last_e and f.lead <> l.lead) as followed
  from leads l join runs using (run) where from_search),
problems as (
  select run, address, unnest(list_filter([case when n_rows = 0 then 'lead_unaccounted' end, case when opened and n = 0 then 'ledger_claims_open_without_request' end, case when inventory_empty and ids > 0 and n = 0 then 'identifier_lead_unopened' end,
    case when n > 0 and not content and not followed then 'blocked_without_independent_attempt' end, case when n > 0 and not_opened then 'ledger_says_not_opened_but_requested' end], lambda x: x is not null)) as code from judged
  union all select distinct run, address, 'ledger_unknown_address' from row_leads where lead is null
  union all select run, '', 'empty_without_any_page_request' from runs where run not in (select run from e where not search and not bad and value % 2 = 0))"""

QUERIES = {"lead_outcomes": lead_outcomes, "lead_problems": lead_problems, "lead_summaries": lead_summaries}
ORACLE_SQL = {
    "lead_outcomes": f"""with {_SQL} select run, address, from_search, ids, case when content then 'content' when n > 0 then 'blocked' else 'unattempted' end as outcome,
  case when not content then null when listed then 'listed_address' when from_search then 'mirror_same_record' else 'model_chosen_address' end as via, n_rows as "rows" from leads""",
    "lead_problems": f"with {_SQL} select run, code, address, code = 'ledger_says_not_opened_but_requested' as warning from problems",
    "lead_summaries": f"""with {_SQL},
t as (select run, count(*) filter (search) as searches, count(distinct value % 9) filter (search and e % 11 > 0) as distinct_queries, count(*) filter (not search) as fetches, count(*) filter (not search and not bad) as fetches_with_content, count(*) as ledger_rows from e group by run),
l as (select run, count(*) as leads, count(*) filter (content) as leads_content, count(*) filter (n > 0 and not content) as leads_blocked, count(*) filter (n = 0) as leads_unattempted from leads where from_search group by run),
p as (select run, string_agg(code || ':' || n, ',' order by code) as problems, bool_or(code <> 'ledger_says_not_opened_but_requested') as bad from (select run, code, count(*) as n from problems group by all) group by run)
select run, inventory_empty, searches, distinct_queries, fetches, fetches_with_content, coalesce(leads, 0) as leads, coalesce(leads_content, 0) as leads_content, coalesce(leads_blocked, 0) as leads_blocked, coalesce(leads_unattempted, 0) as leads_unattempted,
  ledger_rows, coalesce(problems, '') as problems, not coalesce(bad, false) as satisfied from runs join t using (run) left join l using (run) left join p using (run)""",
}
