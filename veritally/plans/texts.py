"""Queries of the text rules: labels, dates, doses, formats and facts, over orders, lines and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.functions import texts
from veritally.plans.eligibility import _of, _sql_of
from veritally.plans.views import table

DESIGNS = ("A randomised trial", "non-randomized, open", "Prospective cohort", "retrospective cohort study", "case control", "Cross-Sectional survey", "a survey", None)
EFFECTS = ("MD -0.30 (95% CI -1.10 to 0.50)", "MD -1.40 (95% CI: -2.20 to -0.60)", "SMD 0.5, 95%CI [0.2, 0.8]", "RR 1.02 (0.88-1.18)", "odds ratio 0.5 (confidence interval 0.3; 0.7)", "no interval", None)
CELLS = ("1.5 ± 0.2", "12,5 +/- 1.5 kg", "1,234 ± 5", "3 ± 0", "mean = 4 ± sd = 1.25*", "7.5 (0.3)", None)


def label_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities as labels and as queries."""
    key = F.col("o_orderkey")
    raw = F.concat(F.lit("  "), "o_orderpriority", F.lit(" -  "), key.cast("string"), F.lit(" "))
    return table(spark, sf_dir, "orders").select("o_orderkey", texts.label_key(raw).alias("label"), texts.query_key(raw).alias("query"))


def registration_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each order was registered by its start, of which some are known by month alone, and some are overdue."""
    key = F.col("o_orderkey")
    day, shift = F.col("o_orderdate").cast("date"), (key % 61 - 30).cast("int")
    start = F.date_add(day, shift)
    known = F.when(key % 7 == 0, None).when(key % 3 == 0, F.date_format(start, "yyyy-MM")).otherwise(F.date_format(start, "yyyy-MM-dd"))
    registered = F.date_format(day, "yyyy-MM-dd")
    late = texts.overdue_unpublished(F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("RECRUITING"), known, key % 5 == 0, key % 11 == 0, F.lit("1997-06-01").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", texts.registered_before(registered, known).alias("prospective"), late.alias("overdue"))


def attrition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participants lost, by counts as text of which some aren't numbers."""
    key = F.col("o_orderkey")
    started = F.array((key % 50).cast("string"), F.lit("n/a"), (key % 7).cast("string"))
    a = texts.attrition(started, F.array((key % 50).cast("string"), F.lit("-3"), F.lit("0")))
    return table(spark, sf_dir, "orders").select("o_orderkey", a.alias("a")).select("o_orderkey", "a.n_started", "a.n_completed", "a.dropout_rate")


def dose_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts and servings as typed: milligrams, or why they are refused."""
    key = F.col("o_orderkey")
    amount = F.when(key % 13 > 0, (key % 300 - 20) * 0.5)
    unit, servings = _of(key % 4, "mg", "g", "mcg", "IU"), F.when(key % 9 > 0, (key % 60) / 2)
    return table(spark, sf_dir, "orders").select("o_orderkey", texts.dose_mg(amount, unit).alias("mg"), texts.dose_error(amount, unit).alias("error"), texts.servings_error(servings).alias("servings_error"))


def email_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as typed: as kept, and why they are refused."""
    key = F.col("o_orderkey")
    raw = F.concat(_of(key % 3, " ", "MailTo:", ""), _of(key % 5, "A.b@", "x@y@", "@", "noat", "q+1@"), _of(key % 7, "Example.org", "example", ".example.org", "exa mple.org", "a..org", "example.c1", "sub.example.co"), F.lit(" "))
    raw = F.when(key % 31 == 0, None).otherwise(raw)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(texts.email_key(raw), F.lit("")).alias("email"), texts.email_error(raw).alias("error"))


def display_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as they are shown."""
    key = F.col("o_orderkey")
    value, share = F.when(key % 17 > 0, (key % 401 - 200) / 8), F.when(key % 19 > 0, (key % 1001) / 1000)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        texts.signed(value).alias("signed"),
        texts.signed(F.floor(value).cast("double"), 0).alias("whole"),
        texts.percent_text(share).alias("percent"),
        texts.dose_text((key % 7001).cast("double")).alias("dose"),
        texts.confidence_words(share).alias("confidence"),
    )


def dose_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a product's dose lies against the range that worked."""
    key = F.col("o_orderkey")
    dose, low = F.when(key % 6 > 0, (key % 90 * 50).cast("double")), F.when(key % 5 > 0, (key % 40 * 50).cast("double"))
    r = texts.dose_reading(dose, low, low + 1000.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", r.alias("r")).select("o_orderkey", "r.tone", "r.text")


def text_designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Design, direction and cells read from words."""
    key = F.col("o_orderkey")
    effect = _of(key % 7, *EFFECTS)
    cell = texts.mean_sd(_of(key % 7, *CELLS))
    polarity = _of(key % 3, "higher_better", "lower_better", None)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", texts.design_of(_of(key % 8, *DESIGNS)).alias("design"), texts.interval_of(effect)["low"].alias("low"), texts.interval_of(effect)["high"].alias("high"),
        texts.direction_of(effect, polarity).alias("direction"), cell["mean"].alias("mean"), cell["sd"].alias("sd"),
    )


def decoded_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with escapes, once and twice encoded, some malformed."""
    key = F.col("o_orderkey")
    url = F.concat(F.lit("https://x.org/a%2Fb%252F"), key.cast("string"), _of(key % 4, "%20", "%E9", "%4", "%zz%41"))
    return table(spark, sf_dir, "orders").select("o_orderkey", texts.percent_decoded(url).alias("url"))


def trimmed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut to a budget from their middle, and without what repeats their source's name."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(texts.elided(text, 500)).alias("elided"), F.md5(texts.without_echo(text, F.coalesce("lang", F.lit("")))).alias("without_echo"))


def kept_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a made translation keeps the numbers and quotes of its source."""
    key = F.col("o_orderkey")
    source = F.concat(F.lit("dose "), (key % 9).cast("string"), F.lit(' mg, 95% of "them", p 0.05'))
    out = F.concat(F.lit('p 0.05; "them" at '), (key % 9 + (key % 4 == 0).cast("int")).cast("string"), _of(key % 3, " mg and 95%", " mg and 95", " mg and 95% of 1"))
    return table(spark, sf_dir, "orders").select("o_orderkey", texts.facts_kept(source, out).alias("kept"))


def link_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses that a search result lists."""
    key = F.col("o_orderkey")
    page = F.concat(F.lit('Found:\nLinks: [{"title":"a","url":"https://x.org/'), (key % 10).cast("string"), F.lit('"},{"title":"b","url":"ftp://y.org"},{"title":"c","url":"http://z.org/'), (key % 3).cast("string"), F.lit('"},{"title":"d","url":"https://x.org/'), (key % 10).cast("string"), F.lit('"}]\nend'))
    page = F.when(key % 11 == 0, "Links: [broken").otherwise(page)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(texts.links(page), " ").alias("links"))


QUERIES = {f.__name__: f for f in (label_keys, registration_timing, attrition, dose_checks, email_checks, display_formats, dose_readings, text_designs, decoded_addresses, trimmed_texts, kept_facts, link_lines)}


def _grams(mg: str) -> str:
    return f"case when {mg} is null then '—' when {mg} >= 1000 then regexp_replace(printf('%.2f', ({mg}) / 1000.0), '\\.?0+$', '') || ' g' else floor({mg} + 0.5)::int || ' mg' end"


ORACLE_SQL = {
    "label_keys": """select o_orderkey, trim(regexp_replace(lower(o_orderpriority || ' - ' || o_orderkey), '[^a-z0-9]+', ' ', 'g')) as label, lower(trim(regexp_replace('  ' || o_orderpriority || ' -  ' || o_orderkey || ' ', '\\s+', ' ', 'g'))) as query from orders""",
    "registration_timing": """with d as (select *, o_orderdate::date as day, o_orderdate::date + (o_orderkey % 61 - 30)::int as start from orders),
s as (select *, case when o_orderkey % 7 = 0 then null when o_orderkey % 3 = 0 then date_trunc('month', start)::date else start end as known, o_orderkey % 3 = 0 as by_month from d)
select o_orderkey, case when known is null or (by_month and date_trunc('month', day) = date_trunc('month', known)) then null else (day <= known)::int end as prospective,
  coalesce(o_orderstatus = 'F' and date '1997-06-01' - known > 730 and o_orderkey % 5 <> 0 and o_orderkey % 11 <> 0, false) as overdue from s""",
    "attrition": "with a as (select o_orderkey, (o_orderkey % 50 + o_orderkey % 7)::bigint as s, (o_orderkey % 50)::bigint as c from orders) select o_orderkey, s as n_started, c as n_completed, case when s > 0 then round((s - c)::double / s, 3) end as dropout_rate from a",
    "dose_checks": f"""with a as (select o_orderkey, case when o_orderkey % 13 > 0 then (o_orderkey % 300 - 20) * 0.5::double end as amount, {_sql_of("o_orderkey % 4", "mg", "g", "mcg", "IU")} as unit, case when o_orderkey % 9 > 0 then (o_orderkey % 60) / 2::double end as n from orders),
m as (select *, round(amount * case unit when 'mg' then 1.0 when 'g' then 1000.0 when 'mcg' then 0.001 end::double, 6) as mg from a),
e as (select *, case when unit = 'IU' then 'unit' when amount is null or amount <= 0 then 'not_positive' when mg > 100000 then 'over_ceiling' when mg <= 0 then 'not_positive' end as error from m)
select o_orderkey, case when error is null then mg end as mg, error, case when n is null or n <> floor(n) or n <= 0 then 'not_whole' when n > 24 then 'too_many' end as servings_error from e""",
    "email_checks": f"""with r as (select o_orderkey, case when o_orderkey % 31 > 0 then trim({_sql_of("o_orderkey % 5", "a.b@", "x@y@", "@", "noat", "q+1@")} || lower({_sql_of("o_orderkey % 7", "Example.org", "example", ".example.org", "exa mple.org", "a..org", "example.c1", "sub.example.co")})) else '' end as k from orders),
s as (select *, len(k) - len(replace(k, '@', '')) as ats, string_split(k, '@')[1] as l, string_split(k, '@')[-1] as d from r)
select o_orderkey, k as email, case when k = '' then 'empty' when contains(k, ' ') then 'has_whitespace' when ats = 0 then 'no_at' when ats > 1 then 'multiple_at' when l = '' then 'empty_local'
  when not (regexp_full_match(d, '[a-z0-9.-]+') and regexp_matches(d, '\\.[a-z]{{2,}}$') and not regexp_matches(d, '^[.-]|[.-]$|\\.\\.')) then 'bad_domain' end as error from s""",
    "display_formats": f"""with v as (select o_orderkey, case when o_orderkey % 17 > 0 then (o_orderkey % 401 - 200) / 8::double end as v, case when o_orderkey % 19 > 0 then (o_orderkey % 1001) / 1000::double end as s, (o_orderkey % 7001)::double as mg from orders)
select o_orderkey, case when v is null then '—' when v = 0 then '0' else case when v > 0 then '+' else '−' end || regexp_replace(printf('%.3f', abs(v)), '\\.?0+$', '') end as signed,
  case when v is null then '—' when floor(v) = 0 then '0' else case when v > 0 then '+' else '−' end || printf('%.0f', abs(floor(v))) end as whole, coalesce(printf('%.1f', 100 * s) || '%', 'Unavailable') as percent, {_grams("mg")} as dose,
  case when s is null then 'no evidence mass' when s < 0.1 then 'almost no evidence yet' when s < 0.3 then 'very little evidence' when s < 0.6 then 'some evidence' when s < 0.85 then 'substantial evidence' else 'extensive evidence' end as confidence from v""",
    "dose_readings": f"""with v as (select o_orderkey, case when o_orderkey % 6 > 0 then (o_orderkey % 90 * 50)::double end as d, case when o_orderkey % 5 > 0 then (o_orderkey % 40 * 50)::double end as lo from orders),
t as (select *, lo + 1000 as hi, case when d is null or lo is null then 'unassessable' when d < lo then 'below' when d > lo + 1000 then 'above' else 'in_range' end as tone from v)
select o_orderkey, tone, case tone when 'unassessable' then 'the dose can''t be compared' else ({_grams("d")}) || case tone when 'in_range' then ' lies in the range that worked, ' when 'below' then ' is less than what worked, ' else ' is more than what worked, ' end || ({_grams("lo")}) || ' to ' || ({_grams("hi")}) end as text from t""",
    "text_designs": """with o as (select o_orderkey, [4, 5, 6, 7, 8, 9, null, null][o_orderkey % 8 + 1] as design, [-1.1, -2.2, 0.2, 0.88, 0.3, null, null][o_orderkey % 7 + 1]::double as low, [0.5, -0.6, 0.8, 1.18, 0.7, null, null][o_orderkey % 7 + 1]::double as high,
    o_orderkey % 7 as e, o_orderkey % 3 as p, [1.5, 12.5, null, null, 4.0, null, null][o_orderkey % 7 + 1]::double as mean, [0.2, 1.5, null, null, 1.25, null, null][o_orderkey % 7 + 1]::double as sd from orders)
select o_orderkey, design, low, high, case when e in (0, 3) then 'null_effect' when p = 2 or e > 4 then null when (e = 2) = (p = 0) then 'benefit' else 'harm' end as direction, mean, sd from o""",
    "decoded_addresses": "select o_orderkey, 'https://x.org/a/b/' || o_orderkey || [' ', '%E9', '%4', '%zzA'][o_orderkey % 4 + 1] as url from orders",
    "trimmed_texts": """with d as (select doc_id, coalesce(text, '') as t, coalesce(lang, '') as l from documents)
select doc_id, md5(case when length(t) <= 500 then t else t[1:246] || chr(10) || '[...]' || chr(10) || right(t, 247) end) as elided, md5(case when l = '' then t else replace(t, l, ' ') end) as without_echo from d""",
    "kept_facts": "select o_orderkey, o_orderkey % 4 <> 0 and o_orderkey % 3 = 0 as kept from orders",
    "link_lines": "select o_orderkey, case when o_orderkey % 11 = 0 then '' else 'https://x.org/' || (o_orderkey % 10) || ' http://z.org/' || (o_orderkey % 3) end as links from orders",
}
