"""Queries of the statistics: effect sizes, errors, tiers, checklists, ledgers, anchors and meta-analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.functions import scoring, statistics
from veritally.operators import evidence, meta, overlap
from veritally.operators.eligibility import first_reason
from veritally.plans.eligibility import _of, _sql_of
from veritally.plans.evidence import r6, studies
from veritally.plans.views import ORDER, SCORES_SQL, UNIT, table
from veritally.shared import spread

BANDS = ("strong evidence against / harm", "does not work", "weak evidence against", "inconclusive", "weak support", "moderate support", "strong support")
STRATA = {"strong_positive": 6, "moderate_positive": 5, "weak_positive": 4, "inconclusive": 3, "moderate_negative": 1, "strong_negative": 0, "harm": 0}
LINE = ["l_orderkey", *ORDER[1:]]


def effect_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hedges' g of each line, its arms made from it."""
    q = F.col("l_quantity")
    g = statistics.hedges_g(F.col("l_discount") * 50, F.when(q > 3, q / 10).otherwise(0.0), (q % 13).cast("int"), F.col("l_tax") * 50, q / 12, (q % 11).cast("int") + 1)
    return table(spark, sf_dir, "lineitem").select(*LINE, g.alias("e")).select(*LINE, r6("e.g").alias("g"), F.round("e.variance", 6).alias("variance"), F.round("e.se", 6).alias("se"))


def standard_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard errors from intervals and from p."""
    q, d = F.col("l_quantity"), F.col("l_discount")
    by_ci = statistics.se_from_ci(d * 10, d * 10 + q / 10 - 0.5, F.when(q % 3 == 0, 0.9).when(q % 3 == 1, 0.95).otherwise(0.99))
    by_p = statistics.se_from_p(d * 10 - 0.3, q / 50)
    return table(spark, sf_dir, "lineitem").select(*LINE, F.round(by_ci, 6).alias("by_ci"), F.round(by_p, 6).alias("by_p"), F.round(statistics.normal_quantile((q - 0.5) / 50), 6).alias("z"))


def effect_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tier of each line's estimate, before and after disagreement."""
    d = F.col("l_discount")
    metric, estimate = F.when(F.col("l_linenumber") % 2 == 0, "smd").otherwise("rr"), F.round(d * 20 - 0.4, 2)
    narrow, wide = (estimate - F.col("l_tax"), estimate + F.col("l_tax")), (estimate - 4 * F.col("l_tax"), estimate + 4 * F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select(*LINE, statistics.effect_tier(metric, estimate, *narrow).alias("raw"), statistics.tier_after_disagreement(metric, estimate, narrow, wide, F.col("l_suppkey") % 2 == 0).alias("tier"))


def review_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each supplier, as a review, did: its methodology score, its checklist and the quality that scores use."""
    supp = F.col("s_suppkey")
    flags = {"is_cochrane": supp % 7 == 0, "prospero": supp % 2 == 0, "grade": supp % 3 == 0, "rob_tool": supp % 5 < 3, "heterogeneity": supp % 4 == 1, "pub_bias": supp % 6 == 2, "trial_count": supp % 23, "total_n": supp * 37 % 3000}
    items = F.array(*(F.when(supp % (i + 4) > 1, supp % (i + 2) > 0) for i in range(7)))
    c = statistics.checklist(items)
    quality = statistics.review_quality(items, supp % 9 > 0, supp % 8 > 0)
    return table(spark, sf_dir, "supplier").select("s_suppkey", statistics.methodology_score(flags).alias("methodology"), c["band"].alias("band"), c["hits"].alias("hits"), c["answered"].alias("answered"), quality.alias("quality"))


def ledger_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows made from parts: certainty, fired gates and the headline."""
    part = F.col("p_partkey")
    row = {"is_rct": part % 3 > 0, "concerns": (part % 4).cast("int"), "rct_count": (part % 6).cast("int"), "largest_n": part * 7 % 200, "chronic": part % 2 == 0, "longest_weeks": part % 9, "surrogate": part % 5 == 0}
    row |= {"form_fit": F.when(part % 11 > 5, (part % 11 - 6).cast("int")), "dose_fit": F.when(part % 7 > 1, (part % 7 - 2).cast("int")), "effect": F.when(part % 13 > 0, F.get(F.array(*(F.lit(x) for x in (-3, 0, 1, 2, 3))), (part % 5).cast("int")))}
    return table(spark, sf_dir, "part").select("p_partkey", statistics.ledger_score(row).alias("l")).select("p_partkey", "l.certainty", "l.gates", F.round("l.applicability", 6).alias("applicability"), "l.headline", "l.label")


def impact_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far results made from parts reach into a life."""
    part = F.col("p_partkey")
    value = (part % 21 - 8) / 10
    i = {"separate": part % 17 == 0, "not_graded": part % 19 == 0, "metric": _of(part % 2, "rr", "smd"), "value": value, "low": F.when(part % 7 > 0, value - (part % 5) / 10), "high": F.when(part % 7 > 0, value + (part % 5) / 10), "better": _of(part % 4, "higher_better", "lower_better", "unclear", "higher_better")}
    i |= {"surrogate": part % 5 == 1, "verdict": _of(part % 3, "cleared", "failed", "none"), "anchored": part % 11 > 3, "population": _of(part % 3, "same", "comparable", "other")}
    return table(spark, sf_dir, "part").select("p_partkey", statistics.impact_level(i).alias("i")).select("p_partkey", "i.kind", "i.level")


def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit's score carried on to four times its trials."""
    scored = evidence.score_units(studies(spark, sf_dir), UNIT).where("score is not null")
    p = statistics.projection(F.col("e"), F.col("d"), F.col("h"), F.col("n_primaries"), 4 * F.col("n_primaries"))
    needed = statistics.studies_needed(F.col("e") / F.col("n_primaries"))
    return scored.select("ecu", p.alias("p"), needed.alias("needed")).select("ecu", F.round("p.e_projected", 6).alias("e_projected"), F.round("p.c_projected", 6).alias("c_projected"), "p.projected", "p.expected_error", "needed")


def ceilings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best score under a share of null findings, and the largest share that lets a target be reached."""
    part = F.col("p_partkey")
    share = part % 101 / 100
    grid = spark.range(1).select(statistics.null_share_grid(200).alias("grid"))  # one row
    rows = spread(table(spark, sf_dir, "part").select("p_partkey")).crossJoin(F.broadcast(grid))
    return rows.select("p_partkey", F.round(statistics.ceiling_score(share), 6).alias("ceiling"), statistics.most_null_share((part % 111 - 5).cast("double"), F.col("grid"), 200).alias("most_null"))


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expectations of units, some of which have no score: the first in pairs, all with a band and a range."""
    part = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").where("p_partkey % 3 <> 1")
    return parts.select(part.alias("anchor"), (part + F.when(part % 10 == 0, 1_000_000).otherwise(0)).alias("ecu"), _of(part % 8, *STRATA, "pair").alias("band"), (part % 60 - 40).cast("int").alias("expected_min"), (part % 60 - 10).cast("int").alias("expected_max"), F.floor(part / 6).cast("long").alias("pair"), F.when(part % 6 < 3, "a").otherwise("b").alias("member"), _of(part % 4, "a_gt_b", "b_gt_a", "approx_equal", "other").alias("expect"))


def _rank(score: F.Column) -> F.Column:
    return F.array_position(F.array(*(F.lit(b) for b in BANDS)), scoring.band(score)) - 1


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.score_units(studies(spark, sf_dir), UNIT).select("ecu", "score")


def anchor_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores against expectations: status of the range, and how many bands off."""
    joined = _anchors(spark, sf_dir).where("band <> 'pair'").join(_scored(spark, sf_dir).withColumn("known", F.lit(True)), "ecu", "left")
    score, low, high = F.col("score"), F.col("expected_min"), F.col("expected_max")
    status = first_reason([(F.col("known").isNull(), "unknown"), (score.isNull(), "gated"), (((low > 0) & (score < 0)) | ((high < 0) & (score > 0)), "sign_error"), ((score < low) | (score > high), "range_miss")])
    want = F.create_map(*(F.lit(x) for kv in STRATA.items() for x in kv))[F.col("band")]
    return joined.select("anchor", F.coalesce(status, F.lit("pass")).alias("status"), F.when(score.isNotNull(), _rank(score) - want).cast("int").alias("bands_off"))


def anchor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of units whose order is expected: passed, error or incomplete."""
    rows = _anchors(spark, sf_dir).join(_scored(spark, sf_dir), "ecu", "left")
    side = {m: rows.where(F.col("member") == m).groupBy("pair").agg(F.min_by(F.struct("score", "expect"), "anchor").alias(m)) for m in ("a", "b")}
    joined = side["a"].join(side["b"], "pair", "full_outer")
    a, b, expect = _rank(F.col("a.score")), _rank(F.col("b.score")), F.col("a.expect")
    holds = F.when(expect == "a_gt_b", a > b).when(expect == "b_gt_a", b > a).when(expect == "approx_equal", a == b)
    none = F.col("a.score").isNull() | F.col("b.score").isNull() | holds.isNull()
    return joined.select("pair", F.when(none, "incomplete").when(holds, "passed").otherwise("error").alias("status"))


def random_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random-effects analyses of parts, one estimate of each order."""
    lines = table(spark, sf_dir, "lineitem").withColumn("seq", F.xxhash64(*ORDER))
    out = meta.random_effects(lines, "l_partkey", "l_orderkey", F.col("l_discount") * 10 - 0.3, (1 + F.col("l_quantity")) / 100, [*ORDER])
    return out.select("stratum", "k", *(r6(c) for c in ("tau2", "effect", "se", "ci_low", "ci_high", "pi_low", "pi_high")), "refusal")


QUERIES = {f.__name__: f for f in (effect_sizes, standard_errors, effect_tiers, review_quality, ledger_scores, impact_levels, projections, ceilings, anchor_grades, anchor_pairs, random_effects)}

_LINE = ", ".join(LINE)


def _poly(coefficients: tuple[float, ...], x: str) -> str:
    out = f"{coefficients[0]!r}::double"
    for c in coefficients[1:]:
        out = f"({out} * {x} + ({c!r}))"
    return out


def _quantile(p: str) -> str:
    st = statistics
    q = f"(({p}) - 0.5)"

    def tail(x: str) -> str:
        return f"({_poly(st._TAIL, x)} / ({_poly(st._TAIL_BELOW, x)} * {x} + 1))"

    centre = f"({_poly(st._CENTRE, f'({q} * {q})')} * {q} / ({_poly(st._CENTRE_BELOW, f'({q} * {q})')} * {q} * {q} + 1))"
    return f"case when ({p}) <= 0 or ({p}) >= 1 then null when ({p}) < 0.02425 then {tail(f'sqrt(-2 * ln({p}))')} when ({p}) > 0.97575 then -{tail(f'sqrt(-2 * ln(1 - ({p})))')} else {centre} end"


def _tier(lo: str, hi: str) -> str:
    return f"""case when smd then case when {lo} < 0 and {hi} > 0 then 0 when e < 0 then case when e <= -0.1 then -3 else 0 end when e >= 0.5 then 3 when e >= 0.3 then 2 when e >= 0.1 then 1 else 0 end
      else case when {lo} < 1 and {hi} > 1 then 0 when e > 1 then case when e >= 1.25 then -3 else 0 end when e <= 0.5 then 3 when e <= 0.67 then 2 when e <= 0.8 then 1 else 0 end end"""


_BAND_RANK = "case when score >= 70 then 6 when score >= 30 then 5 when score >= 10 then 4 when score >= -9 then 3 when score >= -39 then 2 when score >= -69 then 1 when score is not null then 0 end"
_ANCHORS = f"""anchors as (select p_partkey as anchor, p_partkey + case when p_partkey % 10 = 0 then 1000000 else 0 end as ecu, {_sql_of("p_partkey % 8", *STRATA, "pair")} as band, p_partkey % 60 - 40 as lo, p_partkey % 60 - 10 as hi,
    p_partkey // 6 as pair, p_partkey % 6 < 3 as first, p_partkey % 4 as expect from part where p_partkey % 3 <> 1)"""
_CEILING = "(100 * d * (1 - 0.4 * least(1.0, ((1 - p) * (1.0 - d) ** 2 + p * (-0.35 - d) ** 2) / 1.5)))"

ORACLE_SQL = {
    "effect_sizes": f"""with a as (select {_LINE}, l_discount * 50 as m1, case when l_quantity > 3 then l_quantity / 10 else 0 end as s1, (l_quantity % 13)::int as n1, l_tax * 50 as m2, l_quantity / 12 as s2, (l_quantity % 11)::int + 1 as n2 from lineitem),
b as (select *, case when n1 >= 2 and n2 >= 2 then sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / nullif(n1 + n2 - 2, 0)::double) end as sd from a),
c as (select *, (1 - 3 / (4 * (n1 + n2 - 2)::double - 1)) * (m1 - m2) / sd as g from b where sd > 0), v as (select *, (n1 + n2) / (n1 * n2)::double + g * g / (2.0 * (n1 + n2)) as variance from c)
select a.{_LINE.replace(', ', ', a.')}, round(g, 6) as g, round(variance, 6) as variance, round(sqrt(variance), 6) as se from a left join v on {' and '.join(f'a.{c} = v.{c}' for c in LINE)}""",
    "standard_errors": f"""with a as (select {_LINE}, l_quantity as q, l_discount * 10 as lo, l_discount * 10 + l_quantity / 10 - 0.5 as hi, case l_quantity::int % 3 when 0 then 0.9 when 1 then 0.95 else 0.99 end::double as lv, l_discount * 10 - 0.3 as e from lineitem)
select {_LINE}, round(case when lo < hi then (hi - lo) / (2 * ({_quantile("0.5 + lv / 2")})) end, 6) as by_ci, round(case when q < 50 and e <> 0 then abs(e) / -({_quantile("q / 50 / 2")}) end, 6) as by_p, round({_quantile("(q - 0.5) / 50")}, 6) as z from a""",
    "effect_tiers": f"""with a as (select {_LINE}, l_suppkey % 2 = 0 as off, l_linenumber % 2 = 0 as smd, round(l_discount * 20 - 0.4, 2) as e, l_tax as t from lineitem), b as (select *, {_tier("(e - t)", "(e + t)")} as raw, {_tier("(e - 4 * t)", "(e + 4 * t)")} as wide from a)
select {_LINE}, raw, case when off then least(wide, greatest(0, raw - 1)) else raw end as tier from b""",
    "review_quality": """with i as (select s_suppkey as s, list_filter([""" + ", ".join(f"case when s_suppkey % {i + 4} > 1 then s_suppkey % {i + 2} > 0 end" for i in range(7)) + """], lambda x: x is not null) as a,
    least(9, 2 * (s_suppkey % 7 = 0)::int + (s_suppkey % 2 = 0)::int + (s_suppkey % 3 = 0)::int + (s_suppkey % 5 < 3)::int + (s_suppkey % 4 = 1)::int + (s_suppkey % 6 = 2)::int + (s_suppkey % 23 >= 10)::int + (s_suppkey * 37 % 3000 >= 1000)::int) as m from supplier),
h as (select *, len(list_filter(a, lambda x: x)) as hits, len(a) as answered from i), b as (select *, case when hits >= 5 then 'high' when hits >= 3 then 'moderate' else 'low' end as band from h)
select s as s_suppkey, m as methodology, band, hits::int as hits, answered::int as answered, case when s % 9 = 0 then 0 else least(case when answered = 0 then 0.4 when band = 'high' then 1.0 when band = 'moderate' then 0.7 else 0.4 end, case when s % 8 = 0 then 0.4 else 1.0 end) end::double as quality from b""",
    "ledger_scores": """with a as (select p_partkey as p, greatest(0, case when p_partkey % 3 > 0 then 4 else 2 end - p_partkey % 4) as start, p_partkey % 6 as rcts, p_partkey * 7 % 200 < 50 or (p_partkey % 2 = 0 and p_partkey % 9 < 4) as small, p_partkey % 5 = 0 as sur,
    coalesce(case when p_partkey % 11 > 5 then (p_partkey % 11 - 6) / 4 end::double, 0.1) as f, coalesce(case when p_partkey % 7 > 1 then (p_partkey % 7 - 2) / 4 end::double, 0.1) as d, case when p_partkey % 13 > 0 then [-3, 0, 1, 2, 3][p_partkey % 5 + 1] end as e from part),
b as (select *, least(start, case rcts when 0 then 0 when 1 then 1 else 4 end, case when small then 2 else 4 end, case when sur then 3 else 4 end) as c, (f + d) / 2 as fit from a),
s as (select *, case when c > 0 and rcts > 0 then floor(50 + 50 * (e / 3::double * (c / 4::double)) * case when e > 0 then fit else 1 end + 0.5)::int end as h from b)
select p as p_partkey, c::int as certainty, array_to_string(list_filter([case rcts when 0 then 'No human controlled trial' when 1 then 'Only one RCT' end, case when small then 'Best RCT is small or short' end, case when sur then 'Outcome is a surrogate marker' end], lambda x: x is not null), '; ') as gates,
  round(fit, 6) as applicability, h as headline, case when h is null then 'Not scored' when e = 0 and c >= 3 then 'No meaningful benefit' when h >= 65 then 'Works' when h >= 55 then 'Probably works' when h >= 45 then 'Unclear' when h >= 30 then 'Probably does not work' else 'Evidence against' end as label from s""",
    "impact_levels": """with a as (select p_partkey as p, (p_partkey % 21 - 8) / 10::double as v, case when p_partkey % 7 > 0 then (p_partkey % 5) / 10::double end as w, case when p_partkey % 2 = 0 then 1 else 0 end::double as nil, p_partkey % 4 as b from part),
c as (select *, coalesce(v - w < nil and v + w > nil, false) as spans, case when b in (0, 3) then v > nil when b = 1 then not v > nil end as good from a),
k as (select p, case when p % 17 = 0 then 's' when p % 19 = 0 then 'n' when spans or not good then '0' when good is null then 'n' when p % 5 = 1 or p % 3 = 1 then '1' when p % 3 = 0 and p % 11 > 3 then '3' else '2' end as k from c)
select p as p_partkey, case k when 's' then 'separate_track' when 'n' then 'not_graded' else 'graded' end as kind, try_cast(k as int) as level from k""",
    "projections": f"""with {SCORES_SQL}, p as (select ecu, e * 4 as ep, 1 - exp(-e * 4 / 1.5) as cp, d, h, n_primaries as n, e / n_primaries as w from scores where score is not null)
select ecu, round(ep, 6) as e_projected, round(cp, 6) as c_projected, case when n >= 20 then round_even(100 * d * cp * (1 - 0.4 * h), 0)::int end as projected, case when n <= 5 then 42 when n <= 10 then 35 when n <= 20 then 17 when n <= 40 then 11 when n <= 80 then 7 else 5 end as expected_error, ceil(-1.5 * ln(1 - 0.9) / w)::bigint as needed from p""",
    "ceilings": f"""with s as (select p_partkey, p_partkey % 101 / 100::double as p, (p_partkey % 111 - 5)::double as target from part), c as (select *, (1 - p) - 0.35 * p as d from s),
g as (select i / 200::double as p, (1 - i / 200::double) - 0.35 * (i / 200::double) as d from range(201) t(i)), m as (select p, {_CEILING} as ceiling from g)
select p_partkey, round({_CEILING}, 6) as ceiling, (select max(m.p) from m where m.ceiling >= target and (select ceiling from m where p = 0) >= target) as most_null from c""",
    "anchor_grades": f"""with {SCORES_SQL}, {_ANCHORS}, j as (select a.*, s.score, s.ecu is not null as known, {_BAND_RANK} as rank from anchors a left join scores s using (ecu) where band <> 'pair')
select anchor, case when not known then 'unknown' when score is null then 'gated' when (lo > 0 and score < 0) or (hi < 0 and score > 0) then 'sign_error' when score < lo or score > hi then 'range_miss' else 'pass' end as status,
  rank - case band when 'strong_positive' then 6 when 'moderate_positive' then 5 when 'weak_positive' then 4 when 'inconclusive' then 3 when 'moderate_negative' then 1 else 0 end as bands_off from j""",
    "anchor_pairs": f"""with {SCORES_SQL}, {_ANCHORS}, j as (select a.*, {_BAND_RANK} as rank, row_number() over (partition by pair, first order by anchor) as nth from anchors a left join scores s using (ecu)),
x as (select * from j where first and nth = 1), y as (select * from j where not first and nth = 1), z as (select coalesce(x.pair, y.pair) as pair, x.rank as a, y.rank as b, x.expect as e from x full join y on x.pair = y.pair)
select pair, case when a is null or b is null or e is null or e = 3 then 'incomplete' when (e = 0 and a > b) or (e = 1 and b > a) or (e = 2 and a = b) then 'passed' else 'error' end as status from z""",
}


def combined_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, as reviews of parts, combined for each of a hundred outcomes, and the tier that they reach."""
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    rows = table(spark, sf_dir, "lineitem").groupBy((part % 100).alias("outcome"), (supp % 8).alias("review"))
    source = rows.agg(F.collect_set(part).alias("trials"), F.round(F.sum(F.round(F.col("l_discount") * 100).cast("long")) / F.count("*") / 10, 2).alias("estimate"), F.count("*").alias("n"))
    width = F.round(1 / F.sqrt("n"), 3)
    source = source.select("outcome", F.col("review").cast("string").alias("id"), F.lit("smd").alias("metric"), "estimate", (F.col("estimate") - width).alias("ci_low"), (F.col("estimate") + width).alias("ci_high"), (F.col("review") + 2000).alias("year"), (F.col("review") * 5 % 10).alias("quality"), F.size("trials").alias("trial_count"), "trials")
    c = overlap.combined_effects(source, "outcome")
    tier = statistics.tier_after_disagreement(F.col("metric"), F.col("estimate"), (F.col("ci_low_narrow"), F.col("ci_high_narrow")), (F.col("ci_low"), F.col("ci_high")), F.col("disagreement"))
    return c.select("outcome", "estimate", "ci_low", "ci_high", F.array_join("used", ",").alias("used"), F.array_join("dropped", ",").alias("dropped"), F.array_join("excluded", ",").alias("excluded"), "disagreement", tier.alias("tier"))


QUERIES["combined_effects"] = combined_effects
