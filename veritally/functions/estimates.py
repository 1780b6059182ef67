"""Standardised estimates of studies by route (adjusted, from arms, as reported), each with its own refusals, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.functions.columns import apart, once
from veritally.functions.statistics import hedges_g, se_from_ci, se_from_p
from veritally.operators.eligibility import first_reason

# Names of one field, kinds of estimates, designs, estimands, contrasts and bases that aren't pooled.
ALIASES = {"outcome": "outcome_raw", "effect_size": "estimate", "standard_error": "se", "ci_low": "ci_lower", "ci_high": "ci_upper", "adjusted_estimate": "adjusted_effect", "adjusted_variance": "adjusted_effect_variance"}
HEDGES_G, COHEN_D = ("hedges_g", "hedges g", "hedges' g"), ("cohen_d", "cohen d", "cohen's d", "d")
DIFFERENCES = ("mean_difference", "raw_difference")
DESIGNS, ESTIMANDS = ("parallel", "crossover", "cluster"), ("endpoint", "change_from_baseline")
CONTRASTS = {"vs_ingredient_free": "between_arm"}
NOT_POOLED = ("baseline", "control_arm", "control", "primary")

TEXTS = ("outcome", "timepoint", "contrast", "estimand", "estimate_kind", "effect_favours", "effect_sd_basis", "p_value_kind", "p_sidedness", "test_distribution", "design_kind")
NUMBERS = ("effect_size", "effect_sd", "mean_ingredient", "mean_control", "sd_ingredient", "sd_control", "variance", "effect_variance", "sampling_variance", "standard_error", "ci_low", "ci_high", "ci_level", "p_value", "adjusted_estimate", "adjusted_variance")
COUNTS = ("n_ingredient", "n_control")


def coerced(records: DataFrame) -> DataFrame:
    """``records`` as one column ``e``: all fields by their own names, from their aliases where those alone are there.

    Fields that aren't there are null. Other columns stay as they are.
    """
    at = {c: c if c in records.columns else ALIASES.get(c, c) for c in (*TEXTS, *NUMBERS, *COUNTS, "directly_adjusted")}
    kind = dict.fromkeys(TEXTS, "string") | dict.fromkeys(NUMBERS, "double") | dict.fromkeys(COUNTS, "long") | {"directly_adjusted": "boolean"}
    fields = [(F.col(name) if name in records.columns else F.lit(None)).cast(kind[c]).alias(c) for c, name in at.items()]
    return records.withColumn("e", F.struct(*fields))


def _key(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def _is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def _numbers(e: Column, names: tuple[str, ...], positive: bool = False) -> list[tuple[Column, str]]:
    """Rules that refuse values that aren't finite, or not above 0."""
    out = []
    for c in names:
        out.append((e[c].isNotNull() & ~_is_finite(e[c]), f"{c} must be finite"))
        if positive:
            out.append((e[c] <= 0, f"{c} must be positive"))
    return out


def contrast_class(contrast: Column) -> Column:
    """What a contrast compares: its own name, but for those that mean another one."""
    return once(_key(contrast), lambda key: F.coalesce(*(F.when(key == k, F.lit(v)) for k, v in CONTRASTS.items()), key))


def measured(records: DataFrame) -> DataFrame:
    """``records`` (see :func:`coerced`) with route, g, variance, refusal, eligible, stratum.

    Oriented by the arm that an estimate favours, its size taken as a magnitude. What is adjusted directly goes before
    what follows from the arms, and that before what is reported; crossover and cluster designs need the first.
    ``eligible`` says whether the setting alone lets the estimate be counted. Either refusal is null or all three values
    are; rules are in order, the first that holds is the refusal. What estimates must share to be pooled is the stratum:
    outcome, estimand, design and class of contrast.

    Columns named m_* hold what several rules look at, so that each is computed once. A step with a value that is kept
    apart is generated as many small methods, all of which the JVM compiles; each long step holds one.
    """
    e = F.col("e")
    one = {"design": _key(e["design_kind"]), "kind": _key(e["estimate_kind"]), "basis": _key(e["effect_sd_basis"]), "contrast": contrast_class(e["contrast"]), "estimand": _key(e["estimand"]), "favours": _key(e["effect_favours"]), "size": F.abs(e["effect_size"])}
    m = {c: F.col(f"m_{c}") for c in (*one, "adjusted", "route", "sized", "printed", "stated", "use", "by_arms", "by_sd", "by_ci", "by_p", "setting", "refusal")}
    n1, n2 = e["n_ingredient"], e["n_control"]
    parallel, is_g, is_d, differs = m["design"] == "parallel", m["kind"].isin(*HEDGES_G), m["kind"].isin(*COHEN_D), m["kind"].isin(*DIFFERENCES)
    adjusted = e["adjusted_estimate"].isNotNull() & e["adjusted_variance"].isNotNull()
    arms = e["mean_ingredient"].isNotNull() | e["mean_control"].isNotNull()
    stated = F.coalesce(e["variance"], e["effect_variance"], e["sampling_variance"])
    ci = e["ci_low"].isNotNull() | e["ci_high"].isNotNull()
    use = F.when(stated.isNotNull(), "variance").when(e["standard_error"].isNotNull(), "se").when(ci, "ci").when(e["p_value"].isNotNull(), "p").otherwise("none")
    two = {"adjusted": adjusted, "route": F.when(adjusted | ~parallel, "adjusted").when(arms, "derived").otherwise("reported"), "sized": F.coalesce((n1 >= 2) & (n2 >= 2), F.lit(False))}
    two |= {"printed": e["sd_ingredient"].isNotNull() | e["sd_control"].isNotNull(), "stated": stated, "use": use}
    j = 1 - 3 / (4 * (n1 + n2 - 2).cast("double") - 1)
    three = {
        "by_arms": hedges_g(e["mean_ingredient"], e["sd_ingredient"], n1, e["mean_control"], e["sd_control"], n2),
        "by_sd": F.abs(j * (e["mean_ingredient"] - e["mean_control"]) / F.nullif(e["effect_sd"], F.lit(0.0))),
        "by_ci": se_from_ci(e["ci_low"], e["ci_high"], e["ci_level"]),
        "by_p": se_from_p(m["size"], e["p_value"]),
    }
    setting = [
        (~m["design"].isin(*DESIGNS), "unsupported_design"),
        (m["contrast"] == "within_group", "within_group_not_between_arm"),
        (m["contrast"] == "vs_ingredient_arm", "analogous_contrast_not_between_arm"),
        (m["contrast"] != "between_arm", "between_arm_contrast_required"),
        (m["estimand"] == "", "estimand_required"),
        (~m["estimand"].isin(*ESTIMANDS), "unsupported_estimand"),
        (_key(e["timepoint"]) == "", "timepoint_required"),
    ]
    sign = F.when(m["favours"] == "ingredient", 1.0).when(m["favours"] == "control", -1.0)
    flagged = F.coalesce(e["directly_adjusted"], F.lit(False))
    before = [(sign.isNull(), "missing_effect_direction"), ((e["adjusted_estimate"].isNotNull() | e["adjusted_variance"].isNotNull()) & ~flagged, "direct_adjustment_flag_required")]
    before += [(m["adjusted"] & when, why) for when, why in [*_numbers(e, ("adjusted_estimate",)), *_numbers(e, ("adjusted_variance",), positive=True)]]
    of_adjusted = [(~m["adjusted"], "crossover_or_cluster_unadjusted"), (~is_g, "adjusted_estimate_requires_hedges_g")]
    printed, not_pooled = m["printed"], m["basis"].isin(*NOT_POOLED)
    of_derived = [
        (~differs, "derived_estimate_kind_required"),
        (e["mean_ingredient"].isNull() | e["mean_control"].isNull() | n1.isNull() | n2.isNull(), "missing_parallel_arm_values"),
        (~m["sized"], "invalid_arm_sample_size"),
        *_numbers(e, ("mean_ingredient", "mean_control")),
        (printed & (e["sd_ingredient"].isNull() | e["sd_control"].isNull()), "both_arm_sd_required"),
        (printed & m["by_arms"].isNull(), "arm_sds_not_usable"),
        (~printed & not_pooled, "primary_pool_sd_not_pooled"),
        (~printed & ((m["basis"] != "pooled") | e["effect_sd"].isNull()), "pooled_sd_required"),
        *((~printed & when, why) for when, why in _numbers(e, ("effect_sd",), positive=True)),
    ]
    by = lambda name: m["use"] == name
    of_reported = [
        (e["effect_size"].isNull(), "missing_effect_size"),
        (differs & e["effect_sd"].isNotNull() & not_pooled, "primary_pool_sd_not_pooled"),
        (~is_g & ~is_d, "reported_estimate_not_explicit_smd"),
        *_numbers(e, ("effect_size",)),
        (by("variance") & ~_is_finite(m["stated"]), "variance must be finite"),
        (by("variance") & (m["stated"] <= 0), "variance must be positive"),
        *((by("se") & when, why) for when, why in _numbers(e, ("standard_error",), positive=True)),
        (by("ci") & (e["ci_low"].isNull() | e["ci_high"].isNull()), "incomplete_confidence_interval"),
        (by("ci") & e["ci_level"].isNull(), "ci_level_required"),
        (by("ci") & m["by_ci"].isNull(), "interval_not_usable"),
        (by("p") & (_key(e["p_value_kind"]) != "exact"), "p_value_not_exact"),
        (by("p") & (_key(e["p_sidedness"]) != "two"), "p_value_not_two_sided"),
        (by("p") & (_key(e["test_distribution"]) != "normal"), "p_value_not_normal"),
        (by("p") & m["by_p"].isNull(), "p_value_not_usable"),
        (by("none"), "missing_variance_or_uncertainty"),
        (is_d & ~m["sized"], "cohen_d_arm_sample_sizes_required"),
    ]
    of_route = F.when(m["route"] == "adjusted", first_reason(of_adjusted)).when(m["route"] == "derived", first_reason(of_derived)).otherwise(first_reason(of_reported))
    g_derived = F.when(printed, F.abs(m["by_arms"]["g"])).otherwise(m["by_sd"])
    v_derived = F.when(printed, m["by_arms"]["variance"]).otherwise((n1 + n2) / (n1 * n2).cast("double") + m["by_sd"] * m["by_sd"] / (2.0 * (n1 + n2)))
    se = F.when(by("se"), e["standard_error"]).when(by("ci"), m["by_ci"]).when(by("p"), m["by_p"])
    scale = F.when(is_d, j).otherwise(1.0)
    g = F.when(m["route"] == "adjusted", F.abs(e["adjusted_estimate"])).when(m["route"] == "derived", g_derived).otherwise(scale * m["size"])
    v = F.when(m["route"] == "adjusted", e["adjusted_variance"]).when(m["route"] == "derived", v_derived).otherwise(scale * scale * F.coalesce(m["stated"], se * se))
    only = lambda x: F.when(m["refusal"].isNull(), x)
    parts = (F.coalesce(F.nullif(e["outcome"], F.lit("")), F.lit("(unspecified outcome)")), F.coalesce(e["estimand"], F.lit("")), F.coalesce(F.nullif(m["design"], F.lit("")), F.lit("missing")), m["contrast"])
    steps = [one, two, three, {"setting": first_reason(setting)}, {"refusal": F.coalesce(apart(m["setting"]), first_reason(before), of_route)}]
    rows = records
    for step in steps:
        rows = rows.withColumns({f"m_{name}": c for name, c in step.items()})
    out = {"route": only(m["route"]), "g": only(sign * g), "variance": only(v), "refusal": m["refusal"], "eligible": m["setting"].isNull() & (parallel | (flagged & m["adjusted"])), "stratum": F.array_join(F.array(*map(F.trim, parts)), "|")}
    return rows.withColumns(out).select(*records.columns, *out)
