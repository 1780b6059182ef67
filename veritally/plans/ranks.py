"""Queries of orders, picks, joins of vocabularies and checks of runs, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.operators import evidence, ranking
from veritally.operators.eligibility import background
from veritally.plans.eligibility import _of, _sql_of
from veritally.plans.evidence import r6, studies
from veritally.plans.records import RECORDS_SQL, keyed, records
from veritally.plans.views import ORDER, SCORES_SQL, STUDIES_SQL, UNIT, table

OUTCOMES = ("outcome_2", "outcome_0", "outcome_3")


def oa_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 records that are read first: the most readable, then the newest, then as they came."""
    access = _of(F.col("seq") % 5, "full_text", "abstract_only", None, "green", "sr_table")
    rows = records(spark, sf_dir).select("seq", "year", ranking.access_rank(access).alias("rank"), (F.col("seq") % 6 == 0).alias("located"))
    readable = rows.where((F.col("rank") <= 1) | F.col("located"))
    return readable.orderBy("rank", F.desc("year"), "seq").limit(50).select("seq", "rank", "year")


def review_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each review: readable first, then by design, then the newest."""
    s = F.col("seq")
    rows = records(spark, sf_dir).select("seq", "year", F.when(s % 3 > 0, 0).otherwise(1).alias("unreadable"), F.coalesce(F.when(s % 4 > 0, (s % 4).cast("int")), F.lit(9)).alias("design"))
    out = ranking.numbered(rows, [F.col("unreadable"), F.col("design"), F.desc("year"), F.col("seq")])
    return out.select("seq", F.col("position").cast("long").alias("position"))


def top_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts with most lines, of those that have few the ones by key; parts without lines come last."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "part").join(counts, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("n"))
    return rows.orderBy(F.desc("n"), "p_partkey").limit(20)


def store_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 units with most trials, then most evidence; those without a score come after the scored ones."""
    rows = evidence.score_units(studies(spark, sf_dir), UNIT).select("ecu", "n_primaries", F.round("e", 6).alias("e"), "score")
    return rows.orderBy(F.col("score").isNull(), F.desc("n_primaries"), F.desc("e"), "ecu").limit(30)


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of events after a given one, newest first."""
    return table(spark, sf_dir, "events").where("ts < timestamp_ntz'2024-01-20 00:00:00' or (ts = timestamp_ntz'2024-01-20 00:00:00' and event_id < 500)").orderBy(F.desc("ts"), F.desc("event_id")).limit(25).select("event_id", "ts", "event_type")


def newest_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest shipped line of each (part, return flag)."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", *[c for c in ORDER if c != "l_returnflag"])
    order = [F.datediff(F.lit("2100-01-01").cast("date"), F.col("l_shipdate")), *(F.col(c) for c in ORDER if c not in ("l_returnflag", "l_shipdate"))]
    return ranking.newest(rows, ["l_partkey", "l_returnflag"], order).select("l_partkey", "l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber")


def latest_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two latest orders of each status."""
    o = table(spark, sf_dir, "orders")
    first = o.groupBy("o_orderstatus").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("best"))
    rest = o.join(F.broadcast(first), "o_orderstatus").where("struct(o_orderdate, o_orderkey) < best")
    second = rest.groupBy("o_orderstatus").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("best"))
    return first.unionByName(second).select("o_orderstatus", "best.o_orderkey", "best.o_orderdate")


def strided_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 97th order by price, and what of them is finished."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return ranking.strided(rows, [F.desc("o_totalprice"), F.col("o_orderkey")], 97)


def first_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types named L1, L2, ... in the order in which they first appear."""
    first = table(spark, sf_dir, "events").groupBy("event_type").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    out = ranking.numbered(first, [F.col("first")])
    return out.select("event_type", F.concat(F.lit("L"), (F.col("position") + 1).cast("string")).alias("label"))


def turn_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each turn of a conversation got on with the problems that the turn before left."""
    c, t = F.col("conv_id"), F.col("turn")
    problems = F.array_compact(F.array(*(F.when((c + t * (i + 1)) % 4 > 1, f"p{i}") for i in range(4))))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.count("*").alias("rows")).select("conv_id", "turn", problems.alias("problems"), ((c + t) % 3).alias("events"))
    return ranking.turn_progress(rows, "conv_id", "turn", "problems", "events").select("conv_id", "turn", "progress")


def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty records, one of each outcome in turn, the most readable first."""
    rows = keyed(spark, sf_dir)
    kept = rows.groupBy("canonical").agg(F.min("seq").alias("seq"))
    tags = rows.select("canonical", F.col("retrieved_for").alias("outcome"))
    return ranking.round_robin(kept, tags, list(OUTCOMES), ["seq", "canonical"], 40, "canonical")


def venue_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as records of papers, against a list made of nations and segments."""
    s = F.col("c_custkey")
    publisher = F.concat_ws(" ", F.lower("c_mktsegment"), _of(s % 3, "press", "house of books", None))
    rows = table(spark, sf_dir, "customer").select(s.alias("seq"), F.when(s % 9 == 0, F.concat(F.lit("1234-"), (s % 40).cast("string"))).alias("issn"), F.concat(F.lit("journal "), (s % 37).cast("string")).alias("title"), publisher.alias("publisher"))
    n = table(spark, sf_dir, "nation")
    venues = n.select(F.lit("issn").alias("kind"), F.concat(F.lit("1234-"), F.col("n_nationkey").cast("string")).alias("name")).unionByName(n.where("n_nationkey < 5").select(F.lit("title").alias("kind"), F.concat(F.lit("journal "), F.col("n_nationkey").cast("string")).alias("name")))
    names = n.where("n_nationkey < 3").select(F.lit("publisher").alias("kind"), _of(F.col("n_nationkey"), "machinery", "building press", "auto").alias("name"))
    return ranking.venue_flags(rows, venues.unionByName(names), "issn", "title", "publisher").select("seq", "flag")


def venue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records were checked, and how many each rule flagged."""
    flags = venue_flags(spark, sf_dir)
    return flags.groupBy(F.coalesce("flag", F.lit("clean")).alias("flag")).agg(F.count("*").alias("n"))


def _actives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("label"), (F.col("l_partkey") % 50).alias("active"))


def active_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a label's actives, and which of them the curated table has."""
    curated = table(spark, sf_dir, "part").where("p_partkey < 600").select((F.col("p_partkey") % 50).alias("a"), (F.col("p_partkey") * 7 % 50).alias("b"))
    return ranking.uncovered_pairs(_actives(spark, sf_dir), curated, "label", "active")


def form_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with the notes of their ingredient and form."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 9).alias("ingredient"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_partkey") % 4).alias("form"))
    notes = table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 9).alias("ingredient"), F.when(F.col("n_nationkey") % 3 > 0, F.col("n_nationkey") % 3).alias("form"), F.col("n_nationkey").alias("note"))
    return ranking.form_notes(p, notes).select("p_partkey", "note")


def parent_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose ingredient is a form, put right."""
    p = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("v"), (p % 30).cast("string")).alias("ingredient"), F.when(p % 5 == 0, "given").alias("form"))
    n = F.col("n_nationkey")
    forms = table(spark, sf_dir, "nation").select(F.concat(F.lit("v"), n.cast("string")).alias("form_id"), F.concat(F.lit("parent"), (n % 4).cast("string")).alias("parent"))
    return ranking.parent_repair(rows, forms)


def review_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far nations, as reviews of parts, stand on the same evidence."""
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    members = table(spark, sf_dir, "lineitem").join(supp, F.col("l_suppkey") == F.col("s_suppkey")).select("s_nationkey", "l_partkey")
    out = ranking.set_overlap(members, "s_nationkey", "l_partkey")
    return out.select("a", "b", "shared", r6("containment"), r6("covered"), "same")


def held_out_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials that reviews name and the corpus doesn't hold."""
    named = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trial")).distinct()
    held = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("trial"))
    return named.join(held, "trial", "left_anti")


def label_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results joined to the included rows of their review by label; of rows with one label the last counts."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    included = l.where("l_quantity > 10").groupBy(F.col("l_orderkey").alias("review"), F.col("l_linenumber").alias("label")).agg(F.max(F.struct(*[c for c in ORDER if c not in ("l_orderkey", "l_linenumber")], "l_suppkey")).alias("last"))
    results = l.where("l_quantity <= 30").select(F.col("l_orderkey").alias("review"), F.col("l_linenumber").alias("label"), F.col("l_linestatus").alias("direction"))
    rows = results.join(included, ["review", "label"]).groupBy("review", F.col("last.l_suppkey").alias("trial"))
    agree = F.min("direction") == F.max("direction")
    return rows.agg(F.when(agree, F.min("direction")).alias("direction"), F.count("*").alias("n"))


def run_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders came to which stage of a run, by reason where they were skipped."""
    k = F.col("o_orderkey")
    skipped = F.when(k % 11 == 0, "no_text").when(k % 7 == 0, "failed").when(k % 5 == 0, "ineligible")
    return table(spark, sf_dir, "orders").groupBy(F.coalesce(skipped, F.lit("landed")).alias("stage")).agg(F.count("*").alias("n"), F.count_if(k % 2 == 0).alias("partial"))


def efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, value and events of each type for a user and for a purchase; null where there are none."""
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("value") > 100).alias("large"))
    return e.select("event_type", F.round(ranking.share(F.col("calls"), F.col("users")), 6).alias("calls_per_user"), F.round(ranking.share(F.col("cents"), F.col("users")), 6).alias("cents_per_user"), F.round(ranking.share(F.col("cents"), F.col("large")), 6).alias("cents_per_large"))


def null_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signs of what null findings measured: the estimate, else the middle of the interval."""
    d = F.col("l_discount")
    effect = F.when(F.col("l_partkey") % 3 > 0, F.round(d * 10 - 0.5, 1))
    middle = F.when(F.col("l_partkey") % 6 > 0, F.round(d * 10 - 0.5, 1) - 0.0)
    point = F.coalesce(effect, middle)
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").groupBy(F.signum(point).cast("int").alias("sign")).agg(F.count("*").alias("n"))


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An artifact of units against the source it was made from."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    artifact = rows.where("p_partkey % 13 <> 0").withColumns({"size": F.when(F.col("p_partkey") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")), "price": F.when(F.col("p_partkey") % 5 == 0, None).otherwise(F.col("price") + 1e-9)})
    return ranking.reconcile(artifact, rows.where("p_partkey % 17 <> 0"), ["p_partkey"], ["size", "price"])


def identity_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that share a DOI or a PMID, directly or over others: the smallest of each set."""
    rows = records(spark, sf_dir)
    keys = rows.select("seq", F.explode(F.array_compact(F.array(F.concat(F.lit("d"), "doi"), F.when(F.col("seq") % 4 == 0, F.concat(F.lit("p"), "pmid"))))).alias("key"))
    least = keys.groupBy("key").agg(F.min("seq").alias("first"))
    return ranking.disjoint_sets(keys.join(least, "key").select(F.col("seq").alias("a"), F.col("first").alias("b")))


def stream_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews and primaries as one stream, each outcome set with its first occurrences in order."""
    rows = records(spark, sf_dir)
    tags = F.array("retrieved_for", F.concat(F.lit("outcome_"), (F.col("seq") % 3).cast("string")), "retrieved_for")
    reviews, primaries = (rows.where(c).select("seq", F.lit(k).alias("stream"), F.array_join(F.array_distinct(tags), ",").alias("outcomes")) for k, c in (("review", "title <> 'A trial'"), ("primary", "title = 'A trial'")))
    return reviews.unionByName(primaries)


def background_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sets of co-interventions have in common, and what only one has."""
    k = F.col("o_orderkey")
    a = background(F.array(F.lit("Whey"), _of(k % 3, "carb ", "CARB", "beta-alanine"), F.lit("")))
    b = background(F.array(_of(k % 4, "whey", "carb", "beta alanine", "iron"), F.lit("WHEY")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(F.array_intersect(a, b)).alias("shared"), F.array_join(F.array_sort(F.array_except(a, b)), ",").alias("only_a"), F.array_join(F.array_sort(F.array_union(a, b)), ",").alias("either"))


QUERIES = {f.__name__: f for f in (oa_priority, review_ranking, top_outcomes, store_order, keyset_page, newest_products, latest_two, strided_sample, first_labels, turn_progress, round_robin, venue_flags, venue_summary, active_pairs, form_notes, parent_repair, review_pairs, held_out_trials, label_results, run_funnel, efficiency, null_signs, reconciled, identity_sets, stream_union, background_sets)}

_FLAGS = """
v as (select c_custkey as seq, case when c_custkey % 9 = 0 then c_custkey % 40 end as issn, c_custkey % 37 as title, lower(c_mktsegment) as seg, c_custkey % 3 as house from customer),
flags as (select seq, case when issn < (select count(*) from nation) then 'issn' when title < 5 and title < (select count(*) from nation) then 'title' when seg = 'machinery' or (seg = 'building' and house = 0) then 'publisher' end as flag from v)"""

ORACLE_SQL = {
    "oa_priority": f"with {RECORDS_SQL}, r as (select seq, year, [0, 3, 3, 1, 2][seq % 5 + 1] as rank from records) select seq, rank, year from r where rank <= 1 or seq % 6 = 0 order by rank, year desc, seq limit 50",
    "review_ranking": f"with {RECORDS_SQL} select seq, row_number() over (order by case when seq % 3 > 0 then 0 else 1 end, case when seq % 4 > 0 then seq % 4 else 9 end, year desc, seq) - 1 as position from records",
    "top_outcomes": "select p_partkey, count(l_partkey) as n from part left join lineitem on p_partkey = l_partkey group by 1 order by n desc, 1 limit 20",
    "store_order": f"with {SCORES_SQL} select ecu, n_primaries, round(e, 6) as e, score from scores order by score is null, n_primaries desc, round(e, 6) desc, ecu limit 30",
    "keyset_page": "select event_id, ts, event_type from events where (ts, event_id) < (timestamp '2024-01-20 00:00:00', 500) order by ts desc, event_id desc limit 25",
    "newest_products": f"select l_partkey, l_returnflag, l_shipdate, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_partkey, l_returnflag order by l_shipdate::date desc, {', '.join(c for c in ORDER if c not in ('l_returnflag', 'l_shipdate'))}) as nth from lineitem) where nth = 1",
    "latest_two": "select o_orderstatus, o_orderkey, o_orderdate from (select *, row_number() over (partition by o_orderstatus order by o_orderdate desc, o_orderkey desc) as nth from orders) where nth <= 2",
    "strided_sample": "select o_orderkey, o_totalprice, o_orderstatus from (select *, row_number() over (order by o_totalprice desc, o_orderkey) - 1 as nth from orders) where nth % 97 = 0",
    "first_labels": "with f as (select event_type, ts, event_id, row_number() over (partition by event_type order by ts, event_id) as nth from events) select event_type, 'L' || row_number() over (order by ts, event_id) as label from f where nth = 1",
    "turn_progress": "with t as (select distinct conv_id as c, turn as t from conversations), p as (select c, t, list_filter([" + ", ".join(f"case when (c + t * {i + 1}) % 4 > 1 then 'p{i}' end" for i in range(4)) + """], lambda x: x is not null) as now, (c + t) % 3 as n from t),
b as (select *, lag(now) over (partition by c order by t) as was from p) select c as conv_id, t as turn, coalesce(len(list_filter(was, lambda x: not list_contains(now, x))) > 0 and (n > 0 or len(now) < len(was)), false) as progress from b""",
    "venue_flags": f"with {_FLAGS} select * from flags",
    "venue_summary": f"with {_FLAGS} select coalesce(flag, 'clean') as flag, count(*) as n from flags group by 1",
    "active_pairs": """with a as (select distinct l_orderkey as label, l_partkey % 50 as x from lineitem), c as (select distinct least(p_partkey % 50, p_partkey * 7 % 50) as a, greatest(p_partkey % 50, p_partkey * 7 % 50) as b from part where p_partkey < 600)
select p.label, p.x as a, q.x as b, c.a is not null as curated from a p join a q on p.label = q.label and p.x < q.x left join c on c.a = p.x and c.b = q.x""",
    "form_notes": "select p_partkey, n_nationkey as note from part join nation on p_partkey % 9 = n_nationkey % 9 and (n_nationkey % 3 = 0 or (p_partkey % 4 > 0 and p_partkey % 4 = n_nationkey % 3))",
    "parent_repair": "select p_partkey, case when n_nationkey is not null then 'parent' || (n_nationkey % 4) else 'v' || (p_partkey % 30) end as ingredient, case when p_partkey % 5 = 0 then 'given' when n_nationkey is not null then 'v' || n_nationkey end as form from part left join nation on p_partkey % 30 = n_nationkey",
    "review_pairs": """with m as (select distinct s_nationkey as g, l_partkey as x from lineitem join supplier on l_suppkey = s_suppkey), n as (select g, count(*) as n from m group by g),
p as (select p.g as a, q.g as b, count(*) as shared from m p join m q on p.x = q.x and p.g < q.g group by 1, 2), f as (select a, b, shared, shared / least(x.n, y.n)::double as con, shared / (x.n + y.n - shared)::double as cov from p join n x on a = x.g join n y on b = y.g)
select a, b, shared, round(con, 6) as containment, round(cov, 6) as covered, con > 0.5 or cov > 0.5 as same from f""",
    "held_out_trials": "select distinct l_orderkey as trial from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P')",
    "label_results": f"""with i as (select l_orderkey as review, l_linenumber as label, l_suppkey as trial, row_number() over (partition by l_orderkey, l_linenumber order by {', '.join(f'{c} desc' for c in ORDER if c not in ('l_orderkey', 'l_linenumber'))}, l_suppkey desc) as nth from lineitem where l_quantity > 10)
select review, trial, case when min(l_linestatus) = max(l_linestatus) then min(l_linestatus) end as direction, count(*) as n from lineitem join i on l_orderkey = review and l_linenumber = label and nth = 1 where l_quantity <= 30 group by 1, 2""",
    "run_funnel": "select case when o_orderkey % 11 = 0 then 'no_text' when o_orderkey % 7 = 0 then 'failed' when o_orderkey % 5 = 0 then 'ineligible' else 'landed' end as stage, count(*) as n, count(*) filter (o_orderkey % 2 = 0) as partial from orders group by 1",
    "efficiency": """with e as (select event_type, count(*) as calls, sum(round(value * 100)::bigint)::bigint as cents, count(distinct user_id) as users, count(*) filter (value > 100) as large from events group by 1)
select event_type, round(calls / users::double, 6) as calls_per_user, round(cents / users::double, 6) as cents_per_user, round(cents / nullif(large, 0)::double, 6) as cents_per_large from e""",
    "null_signs": "select sign(case when l_partkey % 6 > 0 then round(l_discount * 10 - 0.5, 1) end)::int as sign, count(*) as n from lineitem where l_returnflag = 'N' group by 1",
    "reconciled": """with k as (select p_partkey as k from part where p_partkey % 13 <> 0 or p_partkey % 17 <> 0), s as (select k, case when k % 13 = 0 then 'missing' when k % 17 = 0 then 'extra' end as one, array_to_string(list_filter([case when k % 7 = 0 then 'size' end, case when k % 5 = 0 then 'price' end], lambda x: x is not null), ',') as f from k)
select k as p_partkey, coalesce(one, case when f = '' then 'same' else 'differs' end) as status, case when one is null then f else '' end as fields from s""",
    "identity_sets": f"""with recursive {RECORDS_SQL}, k as (select seq, 'd' || doi as key from records where doi is not null union all select seq, 'p' || pmid from records where pmid is not null and seq % 4 = 0),
l as (select distinct x.seq as a, y.seq as b from k x join k y using (key)), r as (select a, b from l union select r.a, l.b from r join l on r.b = l.a) select a as node, min(b) as root from r group by a""",
    "stream_union": f"with {RECORDS_SQL} select seq, case when title = 'A trial' then 'primary' else 'review' end as stream, case when seq % 4 = seq % 3 then retrieved_for else retrieved_for || ',outcome_' || (seq % 3) end as outcomes from records",
    "background_sets": """with s as (select o_orderkey, list_sort(['whey', case when o_orderkey % 3 = 2 then 'beta alanine' else 'carb' end]) as a, list_sort(list_distinct([['whey', 'carb', 'beta alanine', 'iron'][o_orderkey % 4 + 1], 'whey'])) as b from orders)
select o_orderkey, len(list_intersect(a, b))::int as shared, array_to_string(list_sort(list_filter(a, lambda x: not list_contains(b, x))), ',') as only_a, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') as either from s""",
}
