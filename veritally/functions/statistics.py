"""Statistics of trials as columns: effect sizes, standard errors, quantiles, tiers, projections and ceilings."""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritally.functions.columns import once
from veritally.functions.constants import POLICY, Policy


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def pooled_sd(sd1: Column, n1: Column, sd2: Column, n2: Column) -> Column:
    """The within-arm standard deviation of two arms; null where it isn't finite and above 0, or an arm has under two."""
    value = F.sqrt(((n1 - 1) * sd1 * sd1 + (n2 - 1) * sd2 * sd2) / F.nullif((n1 + n2 - 2).cast("double"), F.lit(0.0)))
    return once(value, lambda x: F.when((n1 >= 2) & (n2 >= 2) & (sd1 >= 0) & (sd2 >= 0) & _finite(x) & (x > 0), x))


def hedges_g(mean1: Column, sd1: Column, n1: Column, mean2: Column, sd2: Column, n2: Column) -> Column:
    """struct(g, variance, se): the standardised difference with the correction for small samples; null where refused."""
    df = (n1 + n2 - 2).cast("double")
    value = (1 - 3 / (4 * df - 1)) * (mean1 - mean2) / pooled_sd(sd1, n1, sd2, n2)
    variance = lambda g: (n1 + n2) / (n1 * n2).cast("double") + g * g / (2.0 * (n1 + n2))
    made = lambda g: once(variance(g), lambda v: F.struct(g.alias("g"), v.alias("variance"), F.sqrt(v).alias("se")))
    return once(value, lambda g: F.when(_finite(g), made(g)))


# The published coefficients of the rational formula of the normal quantile.
_CENTRE = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_CENTRE_BELOW = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_TAIL = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_TAIL_BELOW = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
_EDGE = 0.02425


def _polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    return reduce(lambda a, c: a * x + c, coefficients[1:], F.lit(coefficients[0]))


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile; null outside of 0 < p < 1."""

    def tail(p: Column) -> Column:
        return once(F.sqrt(-2.0 * F.log(p)), lambda q: _polynomial(_TAIL, q) / (_polynomial(_TAIL_BELOW, q) * q + 1.0))

    def centre(q: Column) -> Column:
        return once(q * q, lambda r: _polynomial(_CENTRE, r) * q / (_polynomial(_CENTRE_BELOW, r) * q * q + 1.0))

    return once(p, lambda p: F.when((p > 0) & (p < 1), F.when(p < _EDGE, tail(p)).when(p > 1 - _EDGE, -tail(1.0 - p)).otherwise(once(p - 0.5, centre))))


def se_from_ci(low: Column, high: Column, level: Column) -> Column:
    """The standard error of a symmetric normal interval; null unless low < high and 0 < level < 1."""
    se = (high - low) / (2.0 * normal_quantile(0.5 + level / 2))
    return once(se, lambda x: F.when((low < high) & (level > 0) & (level < 1) & _finite(x), x))


def se_from_p(effect: Column, p: Column) -> Column:
    """The standard error by an exact two-sided normal p; null for no effect and outside of 0 < p < 1."""
    se = F.try_divide(F.abs(effect), -normal_quantile(p / 2))
    return once(se, lambda x: F.when((p > 0) & (p < 1) & (effect != 0) & _finite(x), x))


# Tiers of a standardised difference, and of a ratio.
SMD_TIERS, RATIO_TIERS = ((0.5, 3), (0.3, 2), (0.1, 1)), ((0.5, 3), (0.67, 2), (0.8, 1))


def effect_tier(metric: Column, estimate: Column, low: Column, high: Column) -> Column:
    """-3 (harm) or 0 to 3: by the estimate, 0 where the interval spans no effect; a ratio above 1 is more bad events."""

    def graded(tiers: tuple, at_least: bool) -> Column:
        chain = F.lit(0)
        for bound, tier in reversed(tiers):
            chain = F.when(estimate >= bound if at_least else estimate <= bound, tier).otherwise(chain)
        return chain

    smd = F.when((low < 0) & (high > 0), 0).when(estimate < 0, F.when(estimate <= -SMD_TIERS[-1][0], -3).otherwise(0)).otherwise(graded(SMD_TIERS, True))
    worse = 1 / RATIO_TIERS[-1][0]
    ratio = F.when((low < 1) & (high > 1), 0).when(estimate > 1, F.when(estimate >= worse, -3).otherwise(0)).otherwise(graded(RATIO_TIERS, False))
    return F.when(metric == "smd", smd).otherwise(ratio)


def tier_after_disagreement(metric: Column, estimate: Column, narrow: tuple[Column, Column], wide: tuple[Column, Column], disagree: Column) -> Column:
    """The tier that is left: disagreement costs one at least, and more where the widened interval spans no effect."""
    raw = effect_tier(metric, estimate, *narrow)
    return F.when(disagree, F.least(effect_tier(metric, estimate, *wide), F.greatest(F.lit(0), raw - 1))).otherwise(raw)


def methodology_score(facts: dict[str, Column]) -> Column:
    """0 to 9 by what a review did: is_cochrane counts twice, funding isn't looked at."""
    one = ("prospero", "grade", "rob_tool", "heterogeneity", "pub_bias")
    points = [F.coalesce(facts[c], F.lit(False)).cast("int") for c in one]
    points += [2 * F.coalesce(facts["is_cochrane"], F.lit(False)).cast("int"), (F.coalesce(facts["trial_count"], F.lit(0)) >= 10).cast("int"), (F.coalesce(facts["total_n"], F.lit(0)) >= 1000).cast("int")]
    return F.least(F.lit(9), reduce(lambda a, b: a + b, points))


# A review's quality by its band; the most of one whose extraction isn't complete.
REVIEW_QUALITY, INCOMPLETE = {"high": 1.0, "moderate": 0.7, "low": 0.4}, 0.4


def checklist(items: Column) -> Column:
    """struct(band, hits, answered) of an array of booleans; null is no answer, and bands go by hits alone."""
    answered = F.filter(items, lambda x: x.isNotNull())
    hits = F.size(F.filter(answered, lambda x: x))
    band = F.when(hits >= 5, "high").when(hits >= 3, "moderate").otherwise("low")
    return F.struct(band.alias("band"), hits.alias("hits"), F.size(answered).alias("answered"))


def review_quality(items: Column, resolved: Column, complete: Column) -> Column:
    """What a review's quality counts: by its band, least with no answer, 0 if it names no trials."""
    c = checklist(items)
    by_band = F.when(c["answered"] == 0, REVIEW_QUALITY["low"])
    for band, value in REVIEW_QUALITY.items():
        by_band = by_band.when(c["band"] == band, value)
    return F.when(resolved, F.when(complete, by_band).otherwise(F.least(by_band, F.lit(INCOMPLETE)))).otherwise(0.0)


def ledger_score(l: dict[str, Column]) -> Column:  # noqa: E741
    """struct(certainty, gates, applicability, headline, label) of a ledger row.

    ``l`` names is_rct, concerns (how many count), rct_count, largest_n, chronic, longest_weeks, surrogate, form_fit and
    dose_fit (0 to 4, null: unknown), effect (-3 to 3, null: unclear).
    """
    start = F.greatest(F.lit(0), F.when(l["is_rct"], 4).otherwise(2) - l["concerns"])
    small = (l["largest_n"] < 50) | (l["chronic"] & (l["longest_weeks"] < 4))
    caps = [(l["rct_count"] == 0, 0, "No human controlled trial"), (l["rct_count"] == 1, 1, "Only one RCT"), (small, 2, "Best RCT is small or short"), (l["surrogate"], 3, "Outcome is a surrogate marker")]
    certainty = F.least(start, *(F.when(when, cap).otherwise(4) for when, cap, _ in caps))
    gates = F.array_compact(F.array(*(F.when(when, name) for when, _, name in caps)))
    fit = (F.coalesce(l["form_fit"] / 4, F.lit(0.1)) + F.coalesce(l["dose_fit"] / 4, F.lit(0.1))) / 2
    signal = l["effect"] / 3 * (certainty / 4)
    headline = F.when((certainty > 0) & (l["rct_count"] > 0), F.floor(50 + 50 * F.when(signal > 0, signal * fit).otherwise(signal) + 0.5).cast("int"))
    band = F.when(headline >= 65, "Works").when(headline >= 55, "Probably works").when(headline >= 45, "Unclear").when(headline >= 30, "Probably does not work").otherwise("Evidence against")
    label = F.when(headline.isNull(), "Not scored").when((l["effect"] == 0) & (certainty >= 3), "No meaningful benefit").otherwise(band)
    return F.struct(certainty.alias("certainty"), F.array_join(gates, "; ").alias("gates"), fit.alias("applicability"), headline.alias("headline"), label.alias("label"))


def impact_level(i: dict[str, Column]) -> Column:
    """struct(kind, level): how far a result reaches into a life; rules in order.

    ``i`` names separate, not_graded, metric, value, low, high, better (higher_better, lower_better, unclear), surrogate,
    verdict (cleared, failed, none), anchored, population (same, comparable, other).
    """
    null = F.when(i["metric"] == "rr", 1.0).otherwise(0.0)
    spans = F.coalesce((i["low"] < null) & (i["high"] > null), F.lit(False))
    benefit = F.when(i["better"] == "higher_better", i["value"] > null).when(i["better"] == "lower_better", ~(i["value"] > null))
    promotes = (i["verdict"] == "cleared") & i["anchored"] & i["population"].isin("same", "comparable")
    rules = [
        (i["separate"], "separate_track", None),
        (i["not_graded"], "not_graded", None),
        (spans, "graded", 0),
        (~benefit, "graded", 0),
        (benefit.isNull(), "not_graded", None),
        (i["surrogate"], "graded", 1),
        (i["verdict"] == "failed", "graded", 1),
        (promotes, "graded", 3),
    ]
    out = F.struct(F.lit("graded").alias("kind"), F.lit(2).alias("level"))
    for when, kind, level in reversed(rules):
        out = F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(level).cast("int").alias("level"))).otherwise(out)
    return out


# The mean absolute error of a projection by the size of its sample, and the least sample projected.
PROJECTION_ERROR, PROJECTION_LEAST = ((5, 42), (10, 35), (20, 17), (40, 11), (80, 7)), 20


def projection(e: Column, d: Column, h: Column, sampled: Column, total: Column, policy: Policy = POLICY) -> Column:
    """struct(e_projected, c_projected, projected, expected_error): a sample's score carried on to the whole corpus."""
    whole = e / sampled * total
    c = 1 - F.exp(-whole / policy.saturation)
    error = F.lit(5)
    for most, value in reversed(PROJECTION_ERROR):
        error = F.when(sampled <= most, value).otherwise(error)
    score = F.bround(100 * d * c * (1 - policy.disagreement * h), 0).cast("int")
    return F.struct(whole.alias("e_projected"), c.alias("c_projected"), F.when(sampled >= PROJECTION_LEAST, score).alias("projected"), error.alias("expected_error"))


def studies_needed(mean_weight: Column, confidence: float = 0.9, policy: Policy = POLICY) -> Column:
    """How many studies of this weight reach a confidence; 0 without weight."""
    return F.when(mean_weight > 0, F.ceil(F.lit(-policy.saturation * log(1 - confidence)) / mean_weight)).otherwise(0).cast("long")


def ceiling_score(null_share: Column, policy: Policy = POLICY) -> Column:
    """The best score with this share of null findings, as confidence saturates."""
    best, null = policy.benefit_meaningful, policy.null_effect
    d = (1 - null_share) * best + null_share * null
    variance = (1 - null_share) * (F.lit(best) - d) ** 2 + null_share * (F.lit(null) - d) ** 2
    return 100 * d * (1 - policy.disagreement * F.least(F.lit(1.0), variance / policy.disagreement_full))


def null_share_grid(steps: int = 2000) -> Column:
    """For each share of a grid the best score at it or at a larger one: the same for all rows, so worked out once."""
    shares = F.sequence(F.lit(steps), F.lit(0), F.lit(-1))
    best = lambda acc, i: F.array_append(acc, F.greatest(ceiling_score(i / steps), F.try_element_at(acc, F.lit(-1))))
    return F.reverse(F.aggregate(shares, F.array().cast("array<double>"), best))


def most_null_share(target: Column, grid: Column, steps: int = 2000) -> Column:
    """The largest share of a grid at which ``target`` is within reach; null where it never is.

    ``grid`` is :func:`null_share_grid` of the same ``steps``; it never rises, so a row halves it instead of walking it.
    """
    halves = F.array(*(F.lit(1 << k) for k in reversed(range(steps.bit_length()))))
    at = F.aggregate(halves, F.lit(0), lambda at, h: F.when(F.get(grid, at + h) >= target, at + h).otherwise(at))
    return F.when(ceiling_score(F.lit(0.0)) >= target, at / steps)
