"""The evidence queries over the stand-in claims: votes, scores, contributions, doses, arcs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.functions import scoring
from veritally.functions.columns import apart
from veritally.operators import evidence
from veritally.plans.views import CLAIMS_SQL, ORDER, SCORES_SQL, STUDIES_SQL, UNIT, VOTES_SQL, claims
from veritally.shared import written


def r6(name: str) -> F.Column:
    return F.round(name, 6).alias(name)


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.one_vote_per_trial(claims(spark, sf_dir), UNIT, "trial", list(ORDER))


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.weighted(votes(spark, sf_dir))


def kept_studies(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The same, written once for queries that read them more than once; ``columns`` are all that they need."""
    return written(studies(spark, sf_dir).select(*columns or "*"), "studies")


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = kept_studies(spark, sf_dir)
    return rows, evidence.score_units(rows, UNIT)


def vote_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One claim of each trial of a unit."""
    return votes(spark, sf_dir).select("ecu", "trial", "n_claims", "direction", "magnitude", r6("effect_s"), "effect_route", "design_rank", "n")


def study_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and value of each trial's vote."""
    return studies(spark, sf_dir).select("ecu", "trial", "direction", F.round("w", 10).alias("w"), r6("s"))


def ecu_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: claims to votes to one score a unit."""
    return evidence.score_units(studies(spark, sf_dir), UNIT).select("ecu", "n_primaries", r6("gate_mass"), r6("e"), r6("d"), r6("h"), r6("c"), "gate_fired", "score", "band")


def study_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that each trial adds to its unit's score."""
    return evidence.contributions(*_scored(spark, sf_dir), UNIT).select("ecu", "trial", r6("d_share"), r6("points"))


def dose_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dose ranges of each unit."""
    return evidence.dose_ranges(studies(spark, sf_dir), UNIT)


def product_dose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product's dose against the range with benefit: tier and credit."""
    ranges = evidence.dose_ranges(studies(spark, sf_dir), UNIT, F.max("product_dose").alias("dose"))
    args = (F.col("dose"), F.col("dose"), F.col("benefit_low"), F.col("benefit_high"))
    return ranges.select("ecu", "dose", scoring.dose_tier(*args).alias("tier"), scoring.dose_factor(*args).alias("credit"))


def unit_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and dose arcs, applicability, composite and words of each unit; gated ones have no composite."""
    rows, scores = _scored(spark, sf_dir)
    ranges = evidence.dose_ranges(rows, UNIT).select("ecu", "benefit_low", "benefit_high")
    half, twice = F.col("product_dose") * 0.5, F.col("product_dose") * 2
    rows = rows.join(ranges, "ecu").withColumns(
        {
            "dose_credit": apart(scoring.dose_factor(F.col("dose_low"), F.col("dose_high"), half, twice)),
            "product_credit": apart(scoring.dose_factor(F.col("product_dose"), F.col("product_dose"), F.col("benefit_low"), F.col("benefit_high"))),
        }
    )
    out = evidence.arcs(rows, scores, UNIT)
    return out.select("ecu", "n_in_form", r6("form_verdict"), r6("form_coverage"), r6("form_strength"), "form_basis", r6("dose_verdict"), r6("dose_coverage"), r6("closeness"), r6("applicability"), "gate_fired", "composite", "words")


def applicability_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of weight in the product's form and of known form, and with full text."""
    form, text = F.col("form_match"), F.col("access")
    axes = {"form": (form == "exact", form != "unspecified"), "text": (text == "full_text", F.lit(True))}
    out = evidence.weight_shares(studies(spark, sf_dir), UNIT, axes)
    return out.select("ecu", r6("form_matched"), r6("form_assessable"), r6("text_matched"), r6("text_assessable"))


def form_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many trials of a unit used which form."""
    return evidence.tier_mix(studies(spark, sf_dir), UNIT, "form_match").select("ecu", "form_match", "n", r6("percent"))


def study_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct warnings about a unit's trials."""
    flags = F.array_compact(F.array(F.when(F.col("funding") == "brand_funded", "brand funded"), F.when(F.col("access") == "abstract_only", "abstract only"), F.when(F.col("n") < 20, "small"), F.when(F.col("rob_inherited"), "inherited risk of bias")))
    return evidence.flag_union(studies(spark, sf_dir), UNIT, flags)


def routed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores over trials in the product's form alone, with how many rows the filter dropped."""
    rows = kept_studies(spark, sf_dir)
    exact = rows.where("form_match = 'exact'")
    dropped = rows.groupBy("ecu").agg(F.count_if(F.col("form_match") != "exact").alias("n_dropped"))
    return dropped.join(evidence.score_units(exact, UNIT), "ecu", "left").select("ecu", "n_dropped", "n_primaries", r6("e"), "score")


QUERIES = {f.__name__: f for f in (vote_collapse, study_weights, ecu_scores, study_contributions, dose_bands, product_dose, unit_arcs, applicability_shares, form_mix, study_flags, routed_scores)}

_RANGES = """,
ranges as (select ecu, min(dose_low) as observed_low, max(dose_low) as observed_high, count(dose_low) as n_with_dose, count(*) as n_total,
    min(dose_low) filter (s > 0) as benefit_low, max(dose_low) filter (s > 0) as benefit_high, count(*) filter (s > 0) as n_benefit,
    min(dose_low) filter (s <= 0) as null_low, max(dose_low) filter (s <= 0) as null_high, count(*) filter (s <= 0) as n_null from studies group by ecu)"""


def _credit(d: str, lo: str, hi: str) -> str:
    return f"""case when {d} is null or not ({lo} > 0 and {hi} > 0) or {lo} is null then null
      else round(case when {d} <= 0.5 * {lo} then 0.1 when {d} < {lo} then 0.1 + 0.9 * ({d} - 0.5 * {lo}) / (0.5 * {lo})
        when {d} >= 2 * {hi} then 0.6 when {d} > {hi} then 1 - 0.4 * ({d} - {hi}) / {hi} else 1.0 end::double, 4) end"""


ORACLE_SQL = {
    "vote_collapse": f"with {VOTES_SQL} select ecu, trial, n_claims, direction, magnitude, round(effect_s, 6) as effect_s, effect_route, design_rank, n from votes",
    "study_weights": f"with {STUDIES_SQL} select ecu, trial, direction, round(w, 10) as w, round(s, 6) as s from studies",
    "ecu_scores": f"with {SCORES_SQL} select ecu, n_primaries, round(gate_mass, 6) as gate_mass, round(e, 6) as e, round(d, 6) as d, round(h, 6) as h, round(c, 6) as c, gate_fired, score, band from banded",
    "study_contributions": f"with {SCORES_SQL} select s.ecu, trial, round(w * s / e, 6) as d_share, round(100 * c * (1 - 0.4 * h) * w * s / e, 6) as points from studies s join scores using (ecu) where score is not null",
    "dose_bands": f"with {STUDIES_SQL} {_RANGES} select * from ranges",
    "product_dose": f"""with {STUDIES_SQL} {_RANGES}, p as (select ecu, max(product_dose) as dose, any_value(benefit_low) as lo, any_value(benefit_high) as hi from studies join ranges using (ecu) group by ecu)
select ecu, dose, case when dose is null or lo is null then 'unspecified' when dose < 0.5 * lo then 'below_50' when dose < lo then 'low_50_99' when dose > 2 * hi then 'above_200' else 'in_band' end as tier,
  {_credit("dose", "lo", "hi")} as credit from p""",
    "unit_arcs": f"""with {SCORES_SQL} {_RANGES},
r as (select studies.*, {_credit("dose_low", "(product_dose * 0.5)", "(product_dose * 2)")} as dose_credit, {_credit("product_dose", "benefit_low", "benefit_high")} as product_credit,
    form_match = 'exact' as exact, case when form_match = 'exact' and direction <> 'harm' and s >= 0 then case design_rank when 4 then 0.8 when 5 then 0.55 when 6 then 0.45 when 7 then 0.35 when 8 then 0.25 when 12 then 0.1 end::double end as step
  from studies join ranges using (ecu)),
t as (select *, row_number() over (partition by ecu order by step desc nulls last) as nth from r),
u as (select ecu, count(*) filter (exact) as n_in_form, sum(w) as tw, sum(w) filter (exact) as fw, sum(w * s) filter (exact) as fws, sum(mass) filter (exact) as fm,
    sum(w * dose_credit) filter (w > 0) as dw, sum(w * dose_credit * s) filter (w > 0) as dws, avg(step) filter (nth <= 3) as ladder, max(product_credit) as closeness from t group by ecu),
v as (select *, coalesce(ladder, 0) as strength, greatest(0, least(1, (coalesce(ladder, 0) + coalesce(closeness, 0.1)) / 2)) as fit, d * c * (1 - 0.4 * h) as signal from u join scores using (ecu)),
x as (select *, case when signal is not null then greatest(0, least(100, round_even(50 + 50 * case when signal > 0 then signal * fit else signal end, 0)))::int end as comp from v)
select ecu, n_in_form, round(case when fm >= 0.5 and fw > 0 then fws / fw end, 6) as form_verdict, round(coalesce(fw / tw, 0), 6) as form_coverage, round(strength, 6) as form_strength,
  case when n_in_form = 0 then 'untested_in_form' when ladder is null then 'all_negative_in_form' else 'ladder' end as form_basis,
  round(case when dw > 0 then dws / dw end, 6) as dose_verdict, round(coalesce(dw / tw, 0), 6) as dose_coverage, round(closeness, 6) as closeness, round(fit, 6) as applicability, gate_fired, comp as composite,
  case when comp is null then 'not enough human evidence' when c < 0.15 then 'barely studied' when d >= 0.25 and comp < 55 then case when fit < 0.5 then 'works, but not tested for your product' else 'works, but weakly evidenced' end
    when d <= -0.25 and comp >= 55 then 'does not work' when comp >= 65 then 'works' when comp >= 55 then 'probably works' when comp >= 45 then 'unclear' when comp >= 30 then 'probably does not work' else 'does not work' end as words
from x""",
    "applicability_shares": f"""with {STUDIES_SQL} select ecu, round(coalesce(sum(w) filter (form_match = 'exact'), 0) / sum(w), 6) as form_matched, round(coalesce(sum(w) filter (form_match <> 'unspecified'), 0) / sum(w), 6) as form_assessable,
  round(coalesce(sum(w) filter (access = 'full_text'), 0) / sum(w), 6) as text_matched, round(sum(w) / sum(w), 6) as text_assessable from studies group by ecu""",
    "form_mix": f"with {STUDIES_SQL}, m as (select ecu, form_match, count(*) as n from studies group by ecu, form_match) select ecu, form_match, n, round(100.0::double * n / sum(n) over (partition by ecu), 6) as percent from m",
    "study_flags": f"""with {STUDIES_SQL}, f as (select ecu, unnest([case when funding = 'brand_funded' then 'brand funded' end, case when access = 'abstract_only' then 'abstract only' end, case when n < 20 then 'small' end, case when rob_inherited then 'inherited risk of bias' end]) as flag from studies)
select ecu, coalesce(string_agg(distinct flag, ',' order by flag), '') as flags from f group by ecu""",
    "routed_scores": SCORES_SQL.replace("from studies group by ecu)", "from studies where form_match = 'exact' group by ecu)").replace("from studies join means m using (ecu)", "from studies join means m using (ecu) where form_match = 'exact'"),
}
ORACLE_SQL["routed_scores"] = f"""with {ORACLE_SQL["routed_scores"]}, q as (select ecu, count(*) filter (form_match <> 'exact') as n_dropped from studies group by ecu)
select q.ecu, n_dropped, n_primaries, round(e, 6) as e, score from q left join scores using (ecu)"""

__all__ = ["ORACLE_SQL", "QUERIES", "CLAIMS_SQL"]
