"""Queries of standardised estimates: a line of an order is a study's estimate, with gaps and odd values of all kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.functions import estimates
from veritally.plans.views import ORDER, table

#: Each field as SQL of a line, alike in Spark and DuckDB: what is there varies with the line's keys, in coprime periods.
FIELDS = {
    "outcome_raw": "case l_suppkey % 4 when 0 then 'strength' when 1 then ' Body mass' when 2 then '' end",
    "timepoint": "case when l_partkey % 37 = 0 then ' ' when l_partkey % 37 = 1 then null else 'week 8' end",
    "contrast": "case when l_partkey % 23 = 0 then 'within_group' when l_partkey % 23 = 1 then 'vs_ingredient_arm' when l_partkey % 23 = 2 then null when l_partkey % 23 = 3 then 'other' when l_partkey % 2 = 0 then 'VS_ingredient_free ' else 'between_arm' end",
    "estimand": "case when l_suppkey % 31 = 0 then '' when l_suppkey % 31 = 1 then 'slope' when l_suppkey % 3 = 0 then 'Endpoint' else 'change_from_baseline' end",
    "estimate_kind": "case l_orderkey % 5 when 0 then 'hedges_g' when 1 then 'mean_difference' when 2 then 'Cohen''s d' when 3 then 'raw_difference' else case when l_partkey % 3 = 0 then 'smd' else 'hedges'' g' end end",
    "effect_favours": "case when l_suppkey % 29 = 0 then null when l_linenumber % 2 = 0 then 'Ingredient' else 'control' end",
    "effect_sd_basis": "case l_partkey % 5 when 0 then 'baseline' when 1 then null when 2 then 'other' else 'pooled' end",
    "p_value_kind": "case when l_partkey % 6 = 0 then 'bound' else 'exact' end",
    "p_sidedness": "case when l_suppkey % 6 = 0 then 'one' else 'two' end",
    "test_distribution": "case when l_orderkey % 7 = 0 then 't' else 'normal' end",
    "design_kind": "case when l_orderkey % 17 = 0 then 'cohort' when l_orderkey % 17 < 3 then 'crossover' when l_orderkey % 17 = 3 then 'Cluster' else 'parallel' end",
    "estimate": "case when l_partkey % 19 = 0 then null when l_partkey % 19 = 1 then cast('NaN' as double) else l_discount * 10 - 0.4 end",
    "effect_sd": "case when l_suppkey % 7 = 0 then null when l_suppkey % 7 = 1 then 0.0 else l_tax * 10 + 1 end",
    "mean_ingredient": "case when l_orderkey % 5 in (1, 3) and l_partkey % 4 > 0 then l_quantity + 1.5 end",
    "mean_control": "case when l_orderkey % 5 in (1, 3) and l_partkey % 4 > 1 then l_quantity end",
    "sd_ingredient": "case when l_suppkey % 5 < 3 then l_discount * 20 + l_suppkey % 2 end",
    "sd_control": "case when l_suppkey % 5 in (1, 2, 3) then l_tax * 20 + l_suppkey % 2 end",
    "n_ingredient": "case when l_partkey % 11 > 0 then l_partkey % 30 end",
    "n_control": "case when l_suppkey % 13 > 0 then l_suppkey % 25 + 1 end",
    "variance": "case when l_partkey % 8 = 0 then l_tax when l_partkey % 8 = 1 then cast('Infinity' as double) end",
    "sampling_variance": "case when l_suppkey % 8 = 0 then 0.04 end",
    "se": "case when l_suppkey % 9 = 0 then 0.2 - l_discount * 4 end",
    "ci_lower": "case when l_orderkey % 6 < 3 then l_discount * 10 - l_tax * 10 end",
    "ci_upper": "case when l_orderkey % 6 < 2 then l_discount * 10 + l_tax * 10 end",
    "ci_level": "case when l_partkey % 9 > 0 then 0.95 end",
    "p_value": "case when l_suppkey % 4 > 0 then l_quantity / 50 end",
    "adjusted_effect": "case when l_partkey % 13 < 3 then l_discount * 5 - 0.2 end",
    "adjusted_effect_variance": "case when l_partkey % 13 in (0, 1, 5) then l_tax end",
    "directly_adjusted": "case when l_linenumber % 3 > 0 then true when l_suppkey % 2 = 0 then false end",
}


def derived_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's estimate: its route, its oriented g and variance, or the reason why it has none."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as trial", *ORDER, *(f"{sql} as {name}" for name, sql in FIELDS.items()))
    made = estimates.measured(estimates.coerced(rows))
    return made.select("trial", *ORDER, "stratum", "route", F.round("g", 6).alias("g"), F.round("variance", 6).alias("variance"), "refusal", "eligible")


def estimate_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each stratum: estimates that are eligible and measured, the share of these, and refusals by reason."""
    made = derived_estimates(spark, sf_dir)
    by = made.groupBy("stratum", "refusal").agg(F.count("*").alias("n"), F.count_if("eligible").alias("eligible"))
    told = by.groupBy("stratum").agg(
        F.sum("eligible").alias("eligible"),
        F.coalesce(F.sum(F.when(F.col("refusal").isNull(), F.col("n"))), F.lit(0)).alias("measured"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("refusal").isNotNull(), F.struct("refusal", "n")))), lambda r: F.concat_ws(":", r["refusal"], r["n"])), ",").alias("refusals"),
    )
    return told.withColumn("share", F.round(F.coalesce(F.try_divide("measured", "eligible"), F.lit(0.0)), 6))


_QUANTILE = """
  case when x <= 0 or x >= 1 then null when x < 0.02425 then
    (((((-7.784894002430293e-03 * t + -3.223964580411365e-01) * t + -2.400758277161838e00) * t + -2.549732539343734e00) * t + 4.374664141464968e00) * t + 2.938163982698783e00)
    / ((((7.784695709041462e-03 * t + 3.224671290700398e-01) * t + 2.445134137142996e00) * t + 3.754408661907416e00) * t + 1.0)
  else (((((-3.969683028665376e01 * r + 2.209460984245205e02) * r + -2.759285104469687e02) * r + 1.383577518672690e02) * r + -3.066479806614716e01) * r + 2.506628277459239e00) * (x - 0.5)
    / (((((-5.447609879822406e01 * r + 1.615858368580409e02) * r + -1.556989798598866e02) * r + 6.680131188771972e01) * r + -1.328068155288572e01) * r + 1.0) end"""

_DERIVED = f"""
f as (select l_orderkey as trial, {", ".join(ORDER)}, {", ".join(f"{sql} as {name}" for name, sql in FIELDS.items())} from lineitem),
k as (
  select *, lower(trim(design_kind)) as design, lower(trim(estimate_kind)) as kind, coalesce(effect_sd_basis, '') as basis, case lower(trim(coalesce(contrast, ''))) when 'vs_ingredient_free' then 'between_arm' else lower(trim(coalesce(contrast, ''))) end as con,
    lower(trim(estimand)) as est, case lower(effect_favours) when 'ingredient' then 1.0 when 'control' then -1.0 end as sgn, adjusted_effect is not null and adjusted_effect_variance is not null as adj,
    coalesce(variance, sampling_variance) as stated, abs(estimate) as size, coalesce(n_ingredient >= 2 and n_control >= 2, false) as sized, (n_ingredient + n_control)::double as n, p_value / 2 as x from f),
q as (select *, kind in ('hedges_g', 'hedges'' g') as is_g, kind = 'cohen''s d' as is_d, kind in ('mean_difference', 'raw_difference') as is_md, sd_ingredient is not null or sd_control is not null as printed,
    1 - 3 / (4 * (n - 2) - 1) as j, case when x > 0 then sqrt(-2 * ln(x)) end as t, (x - 0.5) * (x - 0.5) as r from k),
s as (
  select *, -({_QUANTILE}) as z, case when sized and sd_ingredient >= 0 and sd_control >= 0 then sqrt(((n_ingredient - 1) * sd_ingredient * sd_ingredient + (n_control - 1) * sd_control * sd_control) / (n - 2)) end as pool,
    case when adj or design <> 'parallel' then 'adjusted' when mean_ingredient is not null or mean_control is not null then 'derived' else 'reported' end as way from q),
w as (
  select *, case when ci_lower < ci_upper and ci_level > 0 then (ci_upper - ci_lower) / (2 * 1.959963984540054) end as se_ci, case when p_value > 0 and p_value < 1 and size > 0 and not isnan(size) then size / z end as se_p,
    stated is null and se is null as no_se, abs(case when printed then j * (mean_ingredient - mean_control) / pool else j * (mean_ingredient - mean_control) / effect_sd end) as arms from s),
c as (
  select *, case when design not in ('parallel', 'crossover', 'cluster') then 'unsupported_design' when con = 'within_group' then 'within_group_not_between_arm' when con = 'vs_ingredient_arm' then 'analogous_contrast_not_between_arm'
    when con <> 'between_arm' then 'between_arm_contrast_required' when est = '' then 'estimand_required' when est not in ('endpoint', 'change_from_baseline') then 'unsupported_estimand' when trim(coalesce(timepoint, '')) = '' then 'timepoint_required' end as setting from w),
d as (
  select *, case when setting is not null then setting when sgn is null then 'missing_effect_direction'
    when (adjusted_effect is not null or adjusted_effect_variance is not null) and not coalesce(directly_adjusted, false) then 'direct_adjustment_flag_required' when adj and adjusted_effect_variance <= 0 then 'adjusted_variance must be positive'
    when way = 'adjusted' then case when not adj then 'crossover_or_cluster_unadjusted' when not is_g then 'adjusted_estimate_requires_hedges_g' end
    when way = 'derived' then case when not is_md then 'derived_estimate_kind_required' when mean_ingredient is null or mean_control is null or n_ingredient is null or n_control is null then 'missing_parallel_arm_values' when not sized then 'invalid_arm_sample_size'
      when printed and (sd_ingredient is null or sd_control is null) then 'both_arm_sd_required' when printed and coalesce(pool, 0) <= 0 then 'arm_sds_not_usable' when printed then null when basis = 'baseline' then 'primary_pool_sd_not_pooled'
      when basis <> 'pooled' or effect_sd is null then 'pooled_sd_required' when effect_sd <= 0 then 'effect_sd must be positive' end
    else case when estimate is null then 'missing_effect_size' when is_md and effect_sd is not null and basis = 'baseline' then 'primary_pool_sd_not_pooled' when not is_g and not is_d then 'reported_estimate_not_explicit_smd' when isnan(estimate) then 'effect_size must be finite'
      when isinf(stated) then 'variance must be finite' when stated <= 0 then 'variance must be positive' when stated is null and se <= 0 then 'standard_error must be positive' when no_se and (ci_lower is null) <> (ci_upper is null) then 'incomplete_confidence_interval'
      when no_se and ci_lower is not null and ci_level is null then 'ci_level_required' when no_se and ci_lower is not null and se_ci is null then 'interval_not_usable'
      when no_se and ci_lower is null and p_value is not null and p_value_kind <> 'exact' then 'p_value_not_exact' when no_se and ci_lower is null and p_value is not null and p_sidedness <> 'two' then 'p_value_not_two_sided'
      when no_se and ci_lower is null and p_value is not null and test_distribution <> 'normal' then 'p_value_not_normal' when no_se and ci_lower is null and p_value is not null and se_p is null then 'p_value_not_usable'
      when no_se and ci_lower is null and p_value is null then 'missing_variance_or_uncertainty' when is_d and not sized then 'cohen_d_arm_sample_sizes_required' end end as refusal,
    case way when 'adjusted' then abs(adjusted_effect) when 'derived' then arms else size * case when is_d then j else 1 end end as m,
    case way when 'adjusted' then adjusted_effect_variance when 'derived' then n / (n_ingredient * n_control) + arms * arms / (2 * n)
      else coalesce(stated, pow(coalesce(se, se_ci, se_p), 2)) * case when is_d then j * j else 1 end end as v from c),
done as (
  select trial, {", ".join(ORDER)}, coalesce(nullif(trim(outcome_raw), ''), '(unspecified outcome)') || '|' || trim(estimand) || '|' || design || '|' || con as stratum, case when refusal is null then way end as route,
    case when refusal is null then round(sgn * m, 6) + 0.0 end as g, case when refusal is null then round(v, 6) end as variance, refusal, setting is null and (design = 'parallel' or (coalesce(directly_adjusted, false) and adj)) as eligible from d)"""

QUERIES = {"derived_estimates": derived_estimates, "estimate_strata": estimate_strata}
ORACLE_SQL = {
    "derived_estimates": f"with {_DERIVED} select * from done",
    "estimate_strata": f"""with {_DERIVED}, told as (select stratum, refusal, count(*) as n, count(*) filter (eligible) as e from done group by all)
select stratum, sum(e)::bigint as eligible, coalesce(sum(n) filter (refusal is null), 0)::bigint as measured, coalesce(string_agg(refusal || ':' || n, ',' order by refusal) filter (refusal is not null), '') as refusals,
  round(case when sum(e) > 0 then coalesce(sum(n) filter (refusal is null), 0) / sum(e) else 0 end, 6) as share from told group by stratum""",
}
