"""Identity queries over the documents and pages, read as records of papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.functions import identity as ids
from veritally.operators import identity
from veritally.plans.views import table

FIELDS = ["nct", "doi", "pmid", "first_author", "year", "n", "country", "dose_text"]
TYPES = ("Randomized Controlled Trial", "Clinical Trial", "Review", "Systematic Review", "Meta-Analysis", "Case Reports", "Letter", "Journal Article", "Controlled Clinical Trial")
TERMS = ("Animals", "Humans", "Case-Control Studies", "Prospective Studies", "Retrospective Studies", "In Vitro Techniques", "Cross-Sectional Studies")


def _pick(values: tuple[str, ...], at: F.Column) -> F.Column:
    return F.get(F.array(*(F.lit(v) for v in values)), at.cast("int"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record a document: identifiers by rule of doc_id, so that papers share trials."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        d.alias("seq"),
        F.when(d % 5 == 0, F.concat(F.lit("registered as NCT"), F.lpad((d % 97).cast("string"), 8, "0"), F.lit(" (main paper)"))).alias("nct"),
        F.when(d % 5 < 2, F.concat(F.lit("10.1000/"), "lang", F.lit("."), (d % 53).cast("string"))).alias("doi"),
        F.when(d % 5 < 3, (d % 41 + 100000).cast("string")).alias("pmid"),
        F.when(d % 4 == 1, F.concat(F.lit("Müller-Ångström ﬁ "), "source")).otherwise(F.col("source")).alias("first_author"),
        (d % 20 + 2000).alias("year"),
        (F.col("n_chars") % 9).alias("n"),
        F.col("lang").alias("country"),
        F.when(d % 3 > 0, F.concat((d % 2).cast("string"), F.lit(" mg"))).alias("dose_text"),
        F.concat(F.lit("outcome_"), (d % 4).cast("string")).alias("retrieved_for"),
        F.array_compact(F.array(F.when(d % 10 < 9, _pick(TYPES, d % 9)), F.when(d % 11 < 3, _pick(TYPES, d % 5)))).alias("pub_types"),
        F.array_compact(F.array(F.when(d % 13 < 7, _pick(TERMS, d % 7)), F.when(d % 17 < 5, "Humans"))).alias("mesh_terms"),
        F.when(d % 29 == 0, "An overview of reviews").otherwise("A trial").alias("title"),
    )


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    return rows.withColumn("canonical", ids.canonical_id({f: F.col(f) for f in FIELDS}))


def record_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical key of each record."""
    return keyed(spark, sf_dir).select("seq", "canonical")


def record_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record that stands for each canonical key, and how many it stands for."""
    kept = identity.dedup_records(keyed(spark, sf_dir), "canonical", "seq", FIELDS)
    return kept.select("canonical", "seq", "n_merged", "doi", "first_author")


def dedup_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records and keys each kind of identity has."""
    rows = keyed(spark, sf_dir).groupBy("canonical").agg(F.count("*").alias("n"))
    return rows.groupBy(F.substring_index("canonical", ":", 1).alias("kind")).agg(F.count("*").alias("keys"), F.sum("n").alias("records"))


def tag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcomes that each canonical key was retrieved for."""
    return identity.tag_union(keyed(spark, sf_dir), "canonical", "retrieved_for")


def design_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Design rank and the rule that gave it, for each record."""
    rule = identity.design_rule(F.col("title"), F.col("pub_types"), F.col("mesh_terms"))
    return records(spark, sf_dir).select("seq", rule.alias("r")).select("seq", "r.rank", "r.basis")


def design_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by design rank and rule, and the percent of all."""
    counts = design_rules(spark, sf_dir).groupBy("rank", "basis").agg(F.count("*").alias("n"))
    total = F.broadcast(counts.agg(F.sum("n").alias("total")))
    return counts.join(total, F.lit(True)).select("rank", "basis", "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("percent"))


def _identifiers() -> dict[str, F.Column]:
    by_author = F.concat_ws("|", ids.key_text(F.col("first_author")), F.col("year").cast("string"))
    return {"registry": ids.registry_id(F.col("nct")), "doi": ids.key_text(F.col("doi")), "pmid": ids.key_text(F.col("pmid")), "author_year": by_author}


def priority_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record resolved against the trials that records with a DOI name, by the best identifier they share."""
    rows = keyed(spark, sf_dir)
    known = identity.known_identities(rows.where("doi is not null"), "canonical", _identifiers(), ("author_year",))
    return identity.resolve(rows, known, _identifiers(), "seq").select("seq", "trial", "by")


def page_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What names each page."""
    return table(spark, sf_dir, "pages").select("page_id", ids.address_key(F.col("url")).alias("page_key"))


def record_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identifiers that addresses of records carry."""
    url = (
        F.when(F.col("seq") % 4 == 0, F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "pmid"))
        .when(F.col("seq") % 4 == 1, F.concat(F.lit("https://example.org/content/"), "doi", F.lit("/full?x=1")))
        .when(F.col("seq") % 4 == 2, F.concat(F.lit("https://example.org/study/nct"), F.lpad((F.col("seq") % 97).cast("string"), 8, "0")))
        .otherwise(F.concat(F.lit("https://example.org/articles/PMC"), (F.col("seq") + 100000).cast("string"), F.lit("/pdf")))
    )
    return records(spark, sf_dir).select("seq", F.array_join(ids.address_ids(url), " ").alias("ids"))


def registry_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record with what the labels say of it; unknown stays null."""
    facts = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq"), "quality", "toxic")
    return records(spark, sf_dir).select("seq", "country").join(facts, "seq", "left")


def study_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of orders after an update that has some of its rows, and new ones."""
    orders = table(spark, sf_dir, "orders")
    base = orders.where("o_orderstatus <> 'P'").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    new = orders.where("o_orderpriority < '3'").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(1.0)).alias("o_totalprice"), F.lit("new").alias("o_orderpriority"))
    return identity.upsert(base, new, "o_orderkey", ["o_orderstatus"], ["o_totalprice"])


QUERIES = {f.__name__: f for f in (record_identity, record_dedup, dedup_kinds, tag_union, design_rules, design_stats, priority_join, page_keys, record_addresses, registry_facts, study_upsert)}


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


RECORDS_SQL = f"""
records as (select doc_id as seq, case when doc_id % 5 = 0 then 'registered as NCT' || lpad((doc_id % 97)::varchar, 8, '0') || ' (main paper)' end as nct,
    case when doc_id % 5 < 2 then '10.1000/' || lang || '.' || (doc_id % 53) end as doi, case when doc_id % 5 < 3 then (doc_id % 41 + 100000)::varchar end as pmid,
    case when doc_id % 4 = 1 then 'Müller-Ångström ﬁ ' || source else source end as first_author, doc_id % 20 + 2000 as year, n_chars % 9 as n, lang as country, case when doc_id % 3 > 0 then (doc_id % 2) || ' mg' end as dose_text,
    'outcome_' || (doc_id % 4) as retrieved_for, case when doc_id % 29 = 0 then 'An overview of reviews' else 'A trial' end as title,
    list_filter([case when doc_id % 10 < 9 then {_list(TYPES)}[doc_id % 9 + 1] end, case when doc_id % 11 < 3 then {_list(TYPES)}[doc_id % 5 + 1] end], lambda x: x is not null) as pub_types,
    list_filter([case when doc_id % 13 < 7 then {_list(TERMS)}[doc_id % 7 + 1] end, case when doc_id % 17 < 5 then 'Humans' end], lambda x: x is not null) as mesh_terms
  from documents),
keyed as (select *, case when nct is not null then 'registry:nct' || lpad((seq % 97)::varchar, 8, '0')
    when doi is not null then 'doi:' || regexp_replace(lower(doi), '[^a-z0-9]', '', 'g') when pmid is not null then 'pmid:' || pmid
    else 'fingerprint:' || regexp_replace(lower(strip_accents(replace(coalesce(first_author, ''), 'ﬁ', 'fi'))), '[^a-z0-9]', '', 'g') || '|' || year || '|' || case when coalesce(n, 0) = 0 then '' else n::varchar end || '|'
      || regexp_replace(lower(coalesce(country, '')), '[^a-z0-9]', '', 'g') || '|' || regexp_replace(lower(coalesce(dose_text, '')), '[^a-z0-9]', '', 'g') end as canonical from records)"""

_FILLED = " + ".join(f"(coalesce({f}::varchar, '') <> '')::int" for f in FIELDS)


def _has(column: str, *words: str) -> str:
    return "(" + " or ".join(f"len(list_filter({column}, lambda x: contains(lower(x), '{w}'))) > 0" for w in words) + ")"


_RULES = f"""
ruled as (select seq, case when {_has("mesh_terms", "animals")} and not {_has("mesh_terms", "humans")} then '12|animals'
    when {_has("mesh_terms", "in vitro techniques")} and not {_has("mesh_terms", "humans")} then '13|in vitro' when contains(lower(title), 'overview of reviews') then '1|umbrella review'
    when {_has("pub_types", "meta-analysis")} then '2|meta-analysis' when {_has("pub_types", "systematic review")} then '3|systematic review'
    when {_has("pub_types", "randomized controlled trial")} then '4|randomised trial' when {_has("pub_types", "controlled clinical trial")} then '5|controlled trial'
    when {_has("pub_types", "case reports")} then '11|case reports' when {_has("pub_types", *identity.OPINIONS)} then '14|opinion'
    when {_has("mesh_terms", "case-control studies")} then '8|case-control' when {_has("mesh_terms", "cross-sectional studies")} then '9|cross-sectional'
    when {_has("mesh_terms", "prospective studies")} then '6|prospective' when {_has("mesh_terms", "retrospective studies")} then '7|retrospective'
    when {_has("pub_types", "clinical trial")} then '|allocation not stated' when {_has("pub_types", "review")} then '|search not stated'
    when len(pub_types) = 0 and len(mesh_terms) = 0 then '|no tags' else '|no decisive tag' end as r from records),
designs as (select seq, nullif(string_split(r, '|')[1], '')::int as rank, string_split(r, '|')[2] as basis from ruled)"""

_IDS = """[{'kind': 'registry', 'pri': 0, 'value': case when nct is not null then 'nct' || lpad((seq % 97)::varchar, 8, '0') end},
    {'kind': 'doi', 'pri': 1, 'value': regexp_replace(lower(doi), '[^a-z0-9]', '', 'g')}, {'kind': 'pmid', 'pri': 2, 'value': pmid},
    {'kind': 'author_year', 'pri': 3, 'value': regexp_replace(lower(strip_accents(replace(coalesce(first_author, ''), 'ﬁ', 'fi'))), '[^a-z0-9]', '', 'g') || '|' || year}]"""

ORACLE_SQL = {
    "record_identity": f"with {RECORDS_SQL} select seq, canonical from keyed",
    "record_dedup": f"with {RECORDS_SQL}, r as (select *, count(*) over (partition by canonical) as n_merged, row_number() over (partition by canonical order by {_FILLED} desc, seq) as nth from keyed) select canonical, seq, n_merged, doi, first_author from r where nth = 1",
    "dedup_kinds": f"with {RECORDS_SQL} select string_split(canonical, ':')[1] as kind, count(distinct canonical) as keys, count(*) as records from keyed group by 1",
    "tag_union": f"with {RECORDS_SQL} select canonical, string_agg(distinct retrieved_for, ',' order by retrieved_for) as tags from keyed group by canonical",
    "design_rules": f"with {RECORDS_SQL}, {_RULES} select * from designs",
    "design_stats": f"with {RECORDS_SQL}, {_RULES} select rank, basis, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 6) as percent from designs group by rank, basis",
    "priority_join": f"""with {RECORDS_SQL}, i as (select seq, canonical, doi, unnest({_IDS}) as u from keyed), e as (select seq, canonical, doi, u.kind as kind, u.pri as pri, u.value as value from i where coalesce(u.value, '') <> ''),
k as (select kind, value, min(canonical) as trial from e where doi is not null group by kind, value having kind <> 'author_year' or count(distinct canonical) = 1),
b as (select seq, trial, kind, row_number() over (partition by seq order by pri, trial) as nth from e join k using (kind, value))
select keyed.seq, trial, kind as by from keyed left join b on keyed.seq = b.seq and nth = 1""",
    "page_keys": f"""with p as (select page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) as place, regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) as path, regexp_extract(url, '\\?([^#]*)', 1) as query from pages),
q as (select *, string_split(path, '/') as parts, list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' and not list_contains({_list(ids.DROPPED)}, lower(string_split(x, '=')[1])) and not starts_with(lower(x), 'utm_'))) as kept from p),
r as (select *, regexp_replace(case when len(parts) > 2 and parts[3] <> '' and list_contains({_list(tuple(ids.LANGUAGES))}, lower(parts[2])) then '/' || array_to_string(parts[3:], '/') else path end, '/+$', '') as page from q)
select page_id, regexp_replace(lower(place), '^www\\.', '') || case when page = '' then '/' else page end || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end as page_key from r""",
    "record_addresses": f"""with {RECORDS_SQL} select seq, coalesce(case seq % 4 when 0 then 'pmid:' || pmid when 1 then 'doi:' || lower(doi) || ' doi:' || lower(doi) || '/full'
  when 2 then 'NCT' || lpad((seq % 97)::varchar, 8, '0') else 'PMC' || (seq + 100000) end, '') as ids from records""",
    "registry_facts": f"with {RECORDS_SQL} select seq, country, quality, toxic from records left join labels on seq = doc_id",
    "study_upsert": """with b as (select o_orderkey, o_orderstatus, o_totalprice, o_orderpriority from orders where o_orderstatus <> 'P'), n as (select o_orderkey as k, case when o_orderkey % 2 = 0 then 1.0::double end as price from orders where o_orderpriority < '3')
select coalesce(o_orderkey, k) as o_orderkey, case when k is not null then 'X' else o_orderstatus end as o_orderstatus, coalesce(price, o_totalprice) as o_totalprice, case when o_orderkey is not null then o_orderpriority else 'new' end as o_orderpriority
from b full join n on o_orderkey = k""",
}
