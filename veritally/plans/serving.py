"""Queries of what is served and checked: products, histories, caches, validations, fetches and leads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritally.functions import scoring
from veritally.operators import evidence, identity, ranking
from veritally.operators.eligibility import first_reason
from veritally.plans.eligibility import _of, _sql_of
from veritally.plans.evidence import r6, studies
from veritally.plans.records import RECORDS_SQL, records
from veritally.plans.views import SCORES_SQL, UNIT, table
from veritally.shared import spread
from veritally.sources import readers


def quota_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five records of each outcome, newest first; a record of two outcomes is kept for both."""
    order = Window.partitionBy("retrieved_for").orderBy(F.desc("year"), "seq")
    rows = records(spark, sf_dir).select("seq", "year", "retrieved_for").withColumn("nth", F.row_number().over(order))
    return rows.where("nth <= 5").select("retrieved_for", F.col("nth").cast("long").alias("nth"), "seq")


def two_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews and primaries found apart, each with a cap of its own."""
    rows = records(spark, sf_dir).select("seq", "year", "title")
    parts = [rows.where(c).orderBy(F.desc("year"), "seq").limit(n).select("seq", F.lit(k).alias("stream")) for k, c, n in (("review", "title <> 'A trial'", 3), ("primary", "title = 'A trial'", 40))]
    return parts[0].unionByName(parts[1])


def best_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best text of each document and the tier that it comes from."""
    d, text = F.col("doc_id"), F.nullif("text", F.lit(""))
    ladder = [("sections", F.when(d % 5 == 0, text)), ("abstract_section", F.when(d % 5 == 1, F.substring("text", 1, 200))), ("free_address", F.when((d % 5 == 2) & (F.length("text") >= 1500), text)), ("abstract", F.when(d % 7 > 0, F.substring("text", 1, 100)))]
    best = F.coalesce(*(F.when(F.coalesce(t, F.lit("")) != "", F.struct(t.alias("text"), F.lit(k).alias("tier"))) for k, t in ladder))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(best["text"]).alias("text_md5"), best["tier"].alias("tier"))


def unit_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored parts after a new run: sizes are replaced, prices filled where missing, brands keep their first value."""
    p = table(spark, sf_dir, "part")
    base = p.where("p_partkey % 3 > 0").select("p_partkey", F.col("p_size").alias("score"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_retailprice")).alias("e"), "p_brand")
    new = p.where("p_partkey % 4 > 0").select("p_partkey", (F.col("p_size") + 1).alias("score"), F.col("p_retailprice").alias("e"), F.lit("new").alias("p_brand"))
    return identity.upsert(base, new, "p_partkey", ["score"], ["e"])


def call_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What names each event as a call, and whether an earlier one has the name."""
    e = table(spark, sf_dir, "events")
    key = readers.call_key([F.col("event_type"), F.lit("v1"), (F.col("user_id") % 20).cast("string"), F.lit(None)])
    first = e.groupBy(key.alias("key")).agg(F.min("event_id").alias("first"))
    return e.select("event_id", key.alias("key")).join(first, "key").select("event_id", "key", (F.col("event_id") > F.col("first")).alias("cached"))


def owner_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 newest purchases of each of three users."""
    rows = table(spark, sf_dir, "events").where("user_id in (1, 2, 3)").select("user_id", "event_id", "ts", "value")
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return rows.withColumn("nth", F.row_number().over(order)).where("nth <= 20").select("user_id", "event_id", "value")


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each product was asked for, first and last."""
    asked = table(spark, sf_dir, "events")
    return asked.groupBy("event_type", (F.col("user_id") % 10).alias("form")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


def bias_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six items of each document: the registry decides the third, and fills the fifth by its dropout."""
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", *(F.when(d % (i + 2) > 0, (d % (i + 3) > 1).cast("int")).alias(f"i{i}") for i in range(1, 7)))
    facts = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_d"), F.when(F.col("doc_id") % 4 > 0, "quality").alias("_x"), F.when(F.col("doc_id") % 4 > 0, F.col("quality").cast("int")).alias("prospective"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 50 / 100).alias("dropout")).drop("_x")
    joined = rows.join(facts, F.col("doc_id") == F.col("_d"), "left")
    items = {"i3": F.coalesce("prospective", "i3"), "i5": F.coalesce("i5", F.when(F.col("dropout") < 0.2, 1).when(F.col("dropout").isNotNull(), 0))}
    done = joined.withColumns(items)
    return done.select("doc_id", *(f"i{i}" for i in range(1, 7)), scoring.rob_band(F.array(*(F.col(f"i{i}") for i in range(1, 7)))).alias("band"))


def inherited_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band that the last row of each label gives, unclear ones left out."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    band = F.when(F.col("l_tax") < 0.03, "low").when(F.col("l_tax") < 0.05, "unclear").when(F.col("l_tax") < 0.07, "some_concerns").otherwise("high")
    rows = l.select("l_orderkey", "l_linenumber", band.alias("band"), F.struct("l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax").alias("at")).where("band <> 'unclear'")
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.max_by("band", "at").alias("band"))


def search_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as ids to search by."""
    name = F.concat(F.lit("Vitamin_"), "n_name", F.lit("__X"))
    terms = readers.search_terms(F.array(name, F.lower(name), F.lit("ab"), F.lit(None), "n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", readers.search_phrase(name).alias("phrase"), F.array_join(terms, "|").alias("terms"))


def venue_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a venue list, as keys."""
    p = F.col("p_partkey")
    line = _of(p % 6, " # a comment", "12.5", "1234-567x", "Journal of  Things, B.", "", "2049 3630")
    v = readers.venue_name(F.when(p % 6 == 3, F.concat(line, p.cast("string"))).otherwise(line))
    return table(spark, sf_dir, "part").select("p_partkey", v["kind"].alias("kind"), v["name"].alias("name"))


def anchor_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with expectations made from parts: one row a problem."""
    p = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select((p - F.when(p % 10 == 0, 1).otherwise(0)).alias("id"), _of(p % 4, "strong_positive", "harm", "pair", "inconclusive").alias("band"), F.when(p % 7 > 0, (p % 90 - 50).cast("int")).alias("low"), F.when(p % 7 > 0, (p % 80 - 30).cast("int")).alias("high"), F.when(p % 4 == 2, F.when(p % 3 > 0, p % 5)).alias("pair"))
    twice = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate_id").alias("problem"))
    pair = F.col("band") == "pair"
    checks = F.array_compact(F.array(F.when(~pair & (F.col("low").isNull() | F.col("high").isNull()), "no_range"), F.when(F.col("low") > F.col("high"), "range_reversed"), F.when((F.col("band") == "strong_positive") & (F.col("high") < 0), "sign_against_band"), F.when((F.col("band") == "harm") & (F.col("low") > 0), "sign_against_band"), F.when(pair & F.col("pair").isNull(), "no_pair")))
    return rows.select("id", F.explode(checks).alias("problem")).unionByName(twice)


def vocabulary_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that two suppliers share, and nations that don't exist."""
    s = table(spark, sf_dir, "supplier")
    twice = s.groupBy((F.col("s_suppkey") % 40).alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate").alias("problem"))
    known = table(spark, sf_dir, "nation").where("n_nationkey < 20").select("n_nationkey")
    lost = s.join(F.broadcast(known), F.col("s_nationkey") == F.col("n_nationkey"), "left_anti").select(F.col("s_suppkey").alias("id"), F.lit("unknown_family").alias("problem"))
    return twice.unionByName(lost)


def product_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer to each product asked for: its score, or which of the reasons there is none."""
    p = F.col("p_partkey")
    asked = table(spark, sf_dir, "part").select("p_partkey", (p + F.when(p % 10 == 9, 1_000_000).otherwise(0)).alias("ecu"), F.when(p % 12 > 0, (p % 400 * 10).cast("double")).alias("dose"), (p % 15 == 4).alias("demo"), (p % 15 == 5).alias("invalid"))
    scores = evidence.score_units(studies(spark, sf_dir), UNIT, more=evidence.dose_aggregates()).select("ecu", "score", "benefit_low", "benefit_high", F.lit(True).alias("known"))
    joined = asked.join(scores, "ecu", "left")
    status = first_reason([(F.col("known").isNull(), "not_assessed"), (F.col("demo"), "demo_only"), (F.col("invalid"), "invalid_run"), (F.col("score").isNull(), "gated"), (F.col("dose").isNull(), "dose_unknown")])
    credit = scoring.dose_factor(F.col("dose"), F.col("dose"), F.col("benefit_low"), F.col("benefit_high"))
    return joined.select("p_partkey", F.coalesce(status, F.lit("scored")).alias("status"), F.when(status.isNull(), F.col("score")).alias("score"), F.when(status.isNull(), credit).alias("dose_credit"))


def vocabulary_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each form with how its doses convert: exact, bounded or refused."""
    n = F.col("n_nationkey")
    mass, active, hydrate = F.when(n % 4 > 0, n + 100.0), F.when(n % 5 > 0, n + 50.0), F.when(n % 3 == 0, n + 120.0)
    status = F.when(mass.isNull() | active.isNull(), "refused").when(hydrate.isNotNull(), "bounded").otherwise("exact")
    return table(spark, sf_dir, "nation").select("n_nationkey", status.alias("conversion"), F.round(active / F.coalesce(hydrate, mass), 6).alias("least"), F.round(active / mass, 6).alias("most"))


def fetch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came of each page that was fetched, the first rule that holds."""
    p = F.col("page_id")
    code, text = F.when(p % 6 > 1, _of(p % 6, "0", "0", "200", "404", "302", "200").cast("int")), _of(p % 7, "A page", "HTTP 503 from server", "REDIRECT DETECTED: x", "I cannot see the page: please verify you are human", "I cannot find content: enable cookies", "I can't read this PDF", "content")
    refused = text.rlike(r"(?i)^i (cannot|can't)")
    wall = text.rlike("(?i)verify you are human|enable cookies")
    what = first_reason([(p % 11 == 0, "no_result"), (p % 13 == 0, "tool_flagged_error"), (text.rlike("^HTTP [0-9]{3}") | (code >= 400), "http_error"), (text.startswith("REDIRECT") | (code >= 300), "redirect_not_followed"), (refused & wall, "wall"), (refused, "refusal")])
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(what, F.lit("content_bearing")).alias("outcome"))


def form_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form that a text names: the one whose name it contains; of two none."""
    p = F.col("p_partkey")
    text = F.concat_ws(" ", F.lit("took"), _of(p % 4, "Form A1", "form b22", None, "forma1"), _of(p % 3, None, "FORM A1", "form c"), F.lit("daily"))
    names = {"a1": ("form a1", "forma1"), "b22": ("form b22",), "b2": ("form b2 ",), "c": ("form c",)}
    low = F.regexp_replace(F.lower(text), r"\s+", " ")
    hits = F.array_compact(F.array(*(F.when(first_reason([(F.contains(low, F.lit(n)), "y") for n in ns]).isNotNull(), k) for k, ns in names.items())))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.size(hits) == 1, F.get(hits, F.lit(0))).otherwise("unspecified").alias("form"))


def active_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed names as actives: the longest alias that a name contains, the first of equal ones."""
    p = F.col("p_partkey")
    printed = F.concat(_of(p % 5, "Magnesium ", "vitamin D", "D-", "creatine HCl ", "x "), _of(p % 3, "oxide", "3", "ribose"))
    aliases = [("magnesium", "magnesium"), ("magnesium_oxide", "magnesium oxide"), ("vitamin_d", "vitamin d"), ("vitamin_d3", "vitamin d3"), ("ribose", "d-ribose"), ("ribose_b", "ribose"), ("creatine", "creatine")]
    ordered = sorted(enumerate(aliases), key=lambda x: (-len(x[1][1]), x[0]))
    found = first_reason([(F.contains(F.lower(printed), F.lit(alias)), name) for _, (name, alias) in ordered])
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("active"))


def grounded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers that results print and the same call didn't type, and how many calls print each."""
    d = F.col("doc_id")
    printed = F.array(F.concat(F.lit("pmid:"), (d % 30).cast("string")), F.concat(F.lit("doi:"), (d % 7).cast("string")))
    typed = F.array(F.concat(F.lit("pmid:"), (d % 20).cast("string")), F.concat(F.lit("doi:"), (d % 14).cast("string")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_except(printed, typed)).alias("id"))
    return rows.groupBy("id").agg(F.count_distinct("doc_id").alias("calls"))


def speed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each type: how many, how many failed, the mean, and what to do about the rate of failures."""
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.count_if(F.col("value") > 150).alias("failed"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    rate = ranking.share(F.col("failed"), F.col("calls"))
    advice = F.when(F.col("calls") < 10, "too_few").when(rate > 0.25, "back_off").when(rate < 0.05, "headroom").otherwise("ok")
    return e.select("event_type", "calls", "failed", F.round(ranking.share(F.col("cents"), F.col("calls")) / 100, 6).alias("mean"), advice.alias("advice"))


def review_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials that no one can read and reviews cover: how many each review adds that no smaller-numbered one has.

    Orders and lines meet in one sort by trial, a starved trial's own row first. An aggregate by trial would hold about
    every line that a task reads, and a join would sort each side.
    """
    starved = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' or o_orderkey % 6 = 0").select(F.col("o_orderkey").alias("trial"), F.lit(None).cast("long").alias("review"), F.lit(0).alias("line"))
    named = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trial"), (F.col("l_suppkey") % 25).alias("review"), F.lit(1).alias("line"))
    of_trial = Window.partitionBy("trial").orderBy("line", F.asc_nulls_last("review"))
    so_far = of_trial.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = spread(starved.unionByName(named).where("trial is not null"), "trial")
    placed = rows.select("review", "line", F.min("line").over(so_far).alias("least"), F.sum("line").over(so_far).alias("nth"), F.lag("review").over(of_trial).alias("before"))
    covered = placed.where((F.col("line") == 1) & (F.col("least") == 0) & ((F.col("nth") == 1) | ~F.col("review").eqNullSafe(F.col("before"))))
    return covered.groupBy("review").agg(F.count("*").alias("covered"), F.count_if((F.col("nth") == 1) & F.col("review").isNotNull()).alias("newly"))


def axis_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals as positions on an axis that holds no effect and a tenth more on either side."""
    low, high, value = F.col("l_discount") * 10 - 1, F.col("l_discount") * 10 + F.col("l_tax") * 10, F.col("l_discount") * 10
    least, most = F.least(low, F.lit(0.0)), F.greatest(high, F.lit(0.0))
    span = most - least
    start, width = least - 0.1 * span, 1.2 * span

    def at(x: F.Column) -> F.Column:
        return F.round(100 * ranking.share(x - start, width), 6)

    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", at(low).alias("low"), at(value).alias("value"), at(high).alias("high"), at(F.lit(0.0)).alias("none"))


def allowed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored units of an allow-list, in its order."""
    allowed = [5, 3, 8, 1, 999_999, 2]
    names = spark.createDataFrame([(i, u) for i, u in enumerate(allowed)], "place int, ecu long")
    rows = evidence.score_units(studies(spark, sf_dir), UNIT).select("ecu", r6("e"), "score")
    return rows.join(F.broadcast(names), "ecu").select("place", "ecu", "e", "score")


QUERIES = {f.__name__: f for f in (quota_discovery, two_streams, best_texts, unit_upsert, call_keys, owner_history, demand, bias_items, inherited_bands, search_words, venue_lines, anchor_problems, vocabulary_problems, product_lookup, vocabulary_catalog, fetch_outcomes, form_of_text, active_names, grounded_ids, speed_report, review_inheritance, axis_scale, allowed_rows)}

_ITEMS = [f"case when d % {i + 2} > 0 then (d % {i + 3} > 1)::int end" for i in range(1, 7)]

ORACLE_SQL = {
    "quota_discovery": f"with {RECORDS_SQL}, r as (select retrieved_for, seq, row_number() over (partition by retrieved_for order by year desc, seq) as nth from records) select retrieved_for, nth, seq from r where nth <= 5",
    "two_streams": f"with {RECORDS_SQL} (select seq, 'review' as stream from records where title <> 'A trial' order by year desc, seq limit 3) union all (select seq, 'primary' from records where title = 'A trial' order by year desc, seq limit 40)",
    "best_texts": """with d as (select doc_id as d, coalesce(text, '') as t from documents), b as (select d, case when t = '' then null when d % 5 = 0 then 'sections' when d % 5 = 1 then 'abstract_section' when d % 5 = 2 and length(t) >= 1500 then 'free_address' when d % 7 > 0 then 'abstract' end as tier, t from d)
select d as doc_id, md5(case tier when 'sections' then t when 'abstract_section' then t[1:200] when 'free_address' then t when 'abstract' then t[1:100] end) as text_md5, tier from b""",
    "unit_upsert": """select p_partkey, case when p_partkey % 4 > 0 then p_size + 1 else p_size end as score, case when p_partkey % 4 > 0 or p_partkey % 2 = 0 then p_retailprice end as e, case when p_partkey % 3 > 0 then p_brand else 'new' end as p_brand from part where p_partkey % 3 > 0 or p_partkey % 4 > 0""",
    "call_keys": "with k as (select event_id, sha256(event_type || chr(0) || 'v1' || chr(0) || (user_id % 20) || chr(0)) as key from events) select event_id, key, event_id > min(event_id) over (partition by key) as cached from k",
    "owner_history": "select user_id, event_id, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as nth from events where user_id in (1, 2, 3)) where nth <= 20",
    "demand": "select event_type, user_id % 10 as form, count(*) as n, min(event_id) as first_id, max(event_id) as last_id from events group by 1, 2",
    "bias_items": f"""with x as (select doc_id as d from documents), y as (select d, {', '.join(f'{s} as j{i + 1}' for i, s in enumerate(_ITEMS))}, case when d % 4 > 0 then l.quality end as p, case when d % 3 > 0 and l.doc_id is not null then d % 50 / 100::double end as r from x left join labels l on d = l.doc_id),
z as (select d, j1, j2, coalesce(p, j3)::int as j3, j4, coalesce(j5, case when r < 0.2 then 1 when r is not null then 0 end)::int as j5, j6 from y), k as (select *, list_filter([j1, j2, j3, j4, j5, j6], lambda v: v is not null) as a from z)
select d as doc_id, j1 as i1, j2 as i2, j3 as i3, j4 as i4, j5 as i5, j6 as i6, case when len(a) >= 2 and list_sum(a) >= 0.8 * len(a) then 'low' when len(a) > 0 and list_sum(a) >= 0.5 * len(a) then 'some_concerns' else 'high' end as band from k""",
    "inherited_bands": "with b as (select l_orderkey, l_linenumber, case when l_tax < 0.03 then 'low' when l_tax < 0.07 then 'some_concerns' else 'high' end as band, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_extendedprice desc, l_quantity desc, l_discount desc, l_tax desc) as nth from lineitem where l_tax < 0.03 or l_tax >= 0.05) select l_orderkey, l_linenumber, band from b where nth = 1",
    "search_words": "with p as (select n_nationkey, n_name, trim(regexp_replace(lower('Vitamin_' || n_name || '__X'), '[_\\s]+', ' ', 'g')) as p, trim(regexp_replace(lower(n_name), '[_\\s]+', ' ', 'g')) as n from nation) select n_nationkey, p as phrase, case when length(n) > 2 and n <> p then p || '|' || n else p end as terms from p",
    "venue_lines": "select p_partkey, case p_partkey % 6 when 2 then 'issn' when 5 then 'issn' when 3 then 'title' end as kind, case p_partkey % 6 when 2 then '1234567X' when 5 then '20493630' when 3 then 'journal of things b ' || p_partkey end as name from part",
    "anchor_problems": """with r as (select p_partkey - case when p_partkey % 10 = 0 then 1 else 0 end as id, p_partkey % 4 as b, case when p_partkey % 7 > 0 then p_partkey % 90 - 50 end as lo, case when p_partkey % 7 > 0 then p_partkey % 80 - 30 end as hi, p_partkey % 3 > 0 as paired from part)
select id, 'no_range' as problem from r where b <> 2 and lo is null union all select id, 'range_reversed' from r where lo > hi union all select id, 'sign_against_band' from r where (b = 0 and hi < 0) or (b = 1 and lo > 0)
union all select id, 'no_pair' from r where b = 2 and not paired union all select id, 'duplicate_id' from r group by id having count(*) > 1""",
    "vocabulary_problems": "select s_suppkey % 40 as id, 'duplicate' as problem from supplier group by 1 having count(*) > 1 union all select s_suppkey, 'unknown_family' from supplier where s_nationkey not in (select n_nationkey from nation where n_nationkey < 20)",
    "product_lookup": f"""with {SCORES_SQL}, g as (select ecu, min(dose_low) filter (s > 0) as lo, max(dose_low) filter (s > 0) as hi from studies group by ecu),
a as (select p_partkey as p, p_partkey + case when p_partkey % 10 = 9 then 1000000 else 0 end as ecu, case when p_partkey % 12 > 0 then (p_partkey % 400 * 10)::double end as dose from part),
j as (select a.*, s.score, lo, hi, case when s.ecu is null then 'not_assessed' when p % 15 = 4 then 'demo_only' when p % 15 = 5 then 'invalid_run' when s.score is null then 'gated' when dose is null then 'dose_unknown' else 'scored' end as status from a left join scores s using (ecu) left join g using (ecu))
select p as p_partkey, status, case when status = 'scored' then score end as score, case when status = 'scored' and lo > 0 and hi > 0 then round(case when dose <= 0.5 * lo then 0.1 when dose < lo then 0.1 + 0.9 * (dose - 0.5 * lo) / (0.5 * lo) when dose >= 2 * hi then 0.6 when dose > hi then 1 - 0.4 * (dose - hi) / hi else 1.0 end::double, 4) end as dose_credit from j""",
    "vocabulary_catalog": """with m as (select n_nationkey as n, case when n_nationkey % 4 > 0 then n_nationkey + 100.0 end::double as m, case when n_nationkey % 5 > 0 then n_nationkey + 50.0 end::double as a, case when n_nationkey % 3 = 0 then n_nationkey + 120.0 end::double as h from nation)
select n as n_nationkey, case when m is null or a is null then 'refused' when h is not null then 'bounded' else 'exact' end as conversion, round(a / coalesce(h, m), 6) as least, round(a / m, 6) as most from m""",
    "fetch_outcomes": """select page_id, case when page_id % 11 = 0 then 'no_result' when page_id % 13 = 0 then 'tool_flagged_error' when page_id % 7 = 1 or page_id % 6 = 3 then 'http_error' when page_id % 7 = 2 or page_id % 6 = 4 then 'redirect_not_followed'
  when page_id % 7 in (3, 4) then 'wall' when page_id % 7 = 5 then 'refusal' else 'content_bearing' end as outcome from pages""",
    "form_of_text": """with t as (select p_partkey as p, p_partkey % 4 as x, p_partkey % 3 as y from part), h as (select p, list_filter([case when x in (0, 3) or y = 1 then 'a1' end, case when x = 1 then 'b22' end, case when y = 2 then 'c' end], lambda v: v is not null) as h from t)
select p as p_partkey, case when len(h) = 1 then h[1] else 'unspecified' end as form from h""",
    "active_names": """select p_partkey, case p_partkey % 5 when 0 then case when p_partkey % 3 = 0 then 'magnesium_oxide' else 'magnesium' end when 1 then case when p_partkey % 3 = 1 then 'vitamin_d3' else 'vitamin_d' end
  when 2 then case when p_partkey % 3 = 2 then 'ribose' end when 3 then 'creatine' else case when p_partkey % 3 = 2 then 'ribose_b' end end as active from part""",
    "grounded_ids": "with i as (select doc_id, unnest([case when doc_id % 30 <> doc_id % 20 then 'pmid:' || (doc_id % 30) end, case when doc_id % 7 <> doc_id % 14 then 'doi:' || (doc_id % 7) end]) as id from documents) select id, count(distinct doc_id) as calls from i where id is not null group by id",
    "speed_report": """with e as (select event_type, count(*) as calls, count(*) filter (value > 150) as failed, sum(round(value * 100)::bigint)::bigint as cents from events group by 1)
select event_type, calls, failed, round(cents / calls::double / 100, 6) as mean, case when calls < 10 then 'too_few' when failed / calls::double > 0.25 then 'back_off' when failed / calls::double < 0.05 then 'headroom' else 'ok' end as advice from e""",
    "review_inheritance": """with n as (select distinct l_orderkey as t, l_suppkey % 25 as r from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'P' or o_orderkey % 6 = 0)), f as (select *, min(r) over (partition by t) as first from n)
select r as review, count(*) as covered, count(*) filter (r = first) as newly from f group by r""",
    "axis_scale": """with a as (select *, l_discount * 10 - 1 as lo, l_discount * 10 + l_tax * 10 as hi, l_discount * 10 as v from lineitem), b as (select *, least(lo, 0) as a0, greatest(hi, 0) - least(lo, 0) as w from a), c as (select *, a0 - 0.1::double * w as s0, 1.2::double * w as ww from b)
select l_orderkey, l_linenumber, l_partkey, l_extendedprice, round(100 * ((lo - s0) / ww), 6) as low, round(100 * ((v - s0) / ww), 6) as value, round(100 * ((hi - s0) / ww), 6) as high, round(100 * ((0 - s0) / ww), 6) as none from c""",
    "allowed_rows": f"with {SCORES_SQL} select i - 1 as place, ecu, round(e, 6) as e, score from (select unnest([5, 3, 8, 1, 999999, 2]) as ecu, unnest(range(1, 7)) as i) join scores using (ecu)",
}
