"""Accounting of leads: what a run was told of, asked for and says of it, joined by address or record, as problem codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.functions.identity import MOST_CHARS, address_ids, address_key
from veritally.functions.texts import links, query_key
from veritally.operators.ranking import disjoint_sets
from veritally.operators.usage import followed_up
from veritally.shared import written

# Codes of problems and of the warning, dispositions that say that a lead wasn't opened.
UNACCOUNTED, UNKNOWN_ADDRESS, CLAIMS_OPEN = "lead_unaccounted", "ledger_unknown_address", "ledger_claims_open_without_request"
IDENTIFIER_UNOPENED, NO_FALLBACK, NO_PAGE = "identifier_lead_unopened", "blocked_without_independent_attempt", "empty_without_any_page_request"
SAYS_UNOPENED = "ledger_says_not_opened_but_requested"
NOT_OPENED = ("not_opened_secondary", "not_opened_off_topic")


def told(rows: DataFrame, address: str) -> DataFrame:
    """``rows`` with key and ids of the column ``address``; an address that many rows have is read once."""
    each = written(rows.select(address).distinct(), "addresses").withColumns({"key": address_key(F.col(address)), "ids": address_ids(F.col(address))})
    return rows.join(written(each, "told-addresses"), address, "left")


def lead_nodes(events: DataFrame) -> DataFrame:
    """run, seq, place, url, from_search, content, key, ids of each address that a run's ``events`` name, with a key."""
    content = (F.col("kind") == "request").alias("content")
    found = events.where("tool = 'WebSearch' and kind = 'request'").select("run", "seq", F.posexplode(links(F.col("returned"))).alias("place", "url"), F.lit(True).alias("from_search"), content)
    asked = events.where("tool = 'WebFetch'").select("run", "seq", F.lit(0).alias("place"), "url", F.lit(False).alias("from_search"), content)
    return told(written(found.unionByName(asked), "addressed"), "url").where("key is not null")


def lead_accounts(events: DataFrame, ledger: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The leads (run, lead, address, from_search, ids, outcome, via, rows) and the problems (run, code, address, warning).

    ``events``: run, seq, tool (WebSearch or WebFetch), kind (request: it returned content), query, url, returned, in
    order of seq; ``ledger``: run, address, disposition; ``runs``: run, inventory_empty, one row a run. Addresses that
    share a key or a record, directly or over others of the run, are one lead, named by its first address. A row of the
    ledger belongs to the lead of its address, else to that of the first of its records, in order, that is known; its
    address is a problem where there is neither. Rows without events or a ledger are fine; a run without a page that
    returned text has a problem of its own.
    """
    named = written(lead_nodes(events), "lead-nodes")
    node = lambda key: F.concat(F.col("run").cast("string"), F.lit(" k "), key)
    record = lambda i: F.concat(F.col("run").cast("string"), F.lit(" r "), i)
    by_id = written(named.select("run", "key", F.explode("ids").alias("id")).distinct(), "lead-ids")
    own = named.select(node(F.col("key")).alias("a")).distinct().withColumn("b", F.col("a"))
    roots = written(disjoint_sets(own.unionByName(by_id.select(node(F.col("key")).alias("a"), record(F.col("id")).alias("b")))), "lead-roots")
    at = roots.withColumnsRenamed({"root": "lead"})
    placed = written(named.drop("ids").withColumn("node", node(F.col("key"))).join(at, "node").drop("node"), "placed-nodes")
    known = written(by_id.select("run", "id").distinct().withColumn("node", record(F.col("id"))).join(at, "node").select("run", "id", "lead"), "lead-records")
    keys = placed.groupBy("run", "key", "lead").agg(F.max("from_search").alias("listed"))

    fetches = placed.where("not from_search").select("run", "seq", "key", "content").join(keys, ["run", "key"])
    tried = fetches.groupBy("run", "lead").agg(F.count("*").alias("n"), F.max("content").alias("content"), F.max(F.col("content") & F.col("listed")).alias("listed"))
    rows = told(ledger, "address").withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "ledger-rows").join(keys.select("run", "key", F.col("lead").alias("_by_key")), ["run", "key"], "left")
    ids = rows.where("_by_key is null").select("run", "row", F.explode("ids").alias("id")).join(known, ["run", "id"]).groupBy("row").agg(F.min_by("lead", "id").alias("_by_id"))
    rows = written(rows.join(ids, "row", "left").withColumn("lead", F.coalesce("_by_key", "_by_id")), "ledger-leads")
    said = rows.where("lead is not null").groupBy("run", "lead").agg(F.count("*").alias("rows"), F.max(F.col("disposition") == "opened").alias("opened"), F.max(F.col("disposition").isin(*NOT_OPENED)).alias("not_opened"))

    first = placed.groupBy("run", "lead").agg(F.min(F.struct("seq", "place", "url"))["url"].alias("address"), F.max("from_search").alias("from_search"))
    counts = known.groupBy("run", "lead").agg(F.count("*").alias("ids"))
    leads = first.join(counts, ["run", "lead"], "left").join(tried, ["run", "lead"], "left").join(said, ["run", "lead"], "left").fillna(0, ["ids", "n", "rows"]).fillna(False, ["content", "listed", "opened", "not_opened"])
    via = F.when(F.col("content"), F.when(F.col("listed"), "listed_address").when(F.col("from_search"), "mirror_same_record").otherwise("model_chosen_address"))
    leads = written(leads.withColumns({"outcome": F.when(F.col("content"), "content").when(F.col("n") > 0, "blocked").otherwise("unattempted"), "via": via}), "leads")

    to_follow = events.join(fetches.select("run", "seq", "lead"), ["run", "seq"], "left")
    first_query = F.when((F.col("tool") == "WebSearch") & (query_key(F.col("query")) != ""), query_key(F.col("query")))
    followed = followed_up(to_follow, "run", "seq", "lead", F.col("tool") == "WebFetch", F.col("kind") != "request", first_query).select("run", "lead", "followed")
    judged = leads.where("from_search").join(runs, "run").join(followed, ["run", "lead"], "left")
    attempted = F.col("n") > 0
    codes = [
        (F.col("rows") == 0, UNACCOUNTED),
        (F.col("opened") & ~attempted, CLAIMS_OPEN),
        (F.col("inventory_empty") & (F.col("ids") > 0) & ~attempted, IDENTIFIER_UNOPENED),
        (attempted & ~F.col("content") & ~F.coalesce("followed", F.lit(False)), NO_FALLBACK),
        (attempted & F.col("not_opened"), SAYS_UNOPENED),
    ]
    problems = judged.select("run", "address", F.explode(F.array_compact(F.array(*(F.when(when, code) for when, code in codes)))).alias("code"))
    strangers = rows.where("lead is null").select("run", F.substring(F.coalesce("address", F.lit("")), 1, MOST_CHARS).alias("address"), F.lit(UNKNOWN_ADDRESS).alias("code")).distinct()
    pages = events.groupBy("run").agg(F.max((F.col("tool") == "WebFetch") & (F.col("kind") == "request") & (F.length("returned") > 0)).alias("page"))
    without = runs.join(pages.where("page").select("run"), "run", "left_anti").select("run", F.lit("").alias("address"), F.lit(NO_PAGE).alias("code"))
    problems = problems.unionByName(strangers).unionByName(without).withColumn("warning", F.col("code") == SAYS_UNOPENED)
    return leads.select("run", "lead", "address", "from_search", "ids", "outcome", "via", "rows"), problems


def lead_summary(events: DataFrame, ledger: DataFrame, runs: DataFrame, leads: DataFrame, problems: DataFrame) -> DataFrame:
    """One row a run: counts of searches, distinct queries, fetches and leads by outcome, problems by code, satisfied."""
    query = F.when((F.col("tool") == "WebSearch") & (query_key(F.col("query")) != ""), query_key(F.col("query")))
    fetch, content = F.col("tool") == "WebFetch", F.col("kind") == "request"
    told = events.groupBy("run").agg(F.count_if(F.col("tool") == "WebSearch").alias("searches"), F.count_distinct(query).alias("distinct_queries"), F.count_if(fetch).alias("fetches"), F.count_if(fetch & content).alias("fetches_with_content"))
    of_leads = leads.where("from_search").groupBy("run").agg(F.count("*").alias("leads"), *(F.count_if(F.col("outcome") == o).alias(f"leads_{o}") for o in ("content", "blocked", "unattempted")))
    rows = ledger.groupBy("run").agg(F.count("*").alias("ledger_rows"))
    by_code = problems.groupBy("run", "code", "warning").agg(F.count("*").alias("n")).groupBy("run")
    by_code = by_code.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("code", "n"))), lambda x: F.concat_ws(":", x["code"], x["n"])), ",").alias("problems"), F.max(~F.col("warning")).alias("_bad"))
    out = runs
    for part in (told, of_leads, rows, by_code):
        out = out.join(part, "run", "left")
    counts = [c for c in out.columns if c not in (*runs.columns, "problems", "_bad")]
    return out.fillna(0, counts).fillna("", ["problems"]).withColumn("satisfied", ~F.coalesce("_bad", F.lit(False))).drop("_bad")
