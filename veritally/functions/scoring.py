"""Scalar rules of evidence scoring, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritally.functions.columns import once
from veritally.functions.constants import POLICY, Policy


def lookup(key: Column, values: dict, otherwise: float | None = None) -> Column:
    """``values[key]``, or ``otherwise``; a handful of literals, so it stays inside generated code."""
    pairs = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    found = F.try_element_at(pairs, key)
    return found if otherwise is None else F.coalesce(found, F.lit(otherwise))


def rob_band(items: Column) -> Column:
    """low, some_concerns or high by the share of known items (0 or 1) of an array that are 1; null items are unknown."""

    def judged(known: Column) -> Column:
        n, hits = F.size(known), F.size(F.array_remove(known, 0))
        return F.when((n >= 2) & (5 * hits >= 4 * n), "low").when((n > 0) & (2 * hits >= n), "some_concerns").otherwise("high")

    return once(F.filter(items, lambda x: x.isin(0, 1)), judged)


def size_factor(n: Column) -> Column:
    """0.2 up to one participant or unknown; then log10(n) / 2, at most 1."""
    return F.when(F.coalesce(n, F.lit(0)) <= 1, 0.2).otherwise(F.least(F.lit(1.0), F.log10(n.cast("double")) / 2))


def study_weight(s: dict[str, Column], policy: Policy = POLICY) -> Column:
    """Design x risk of bias x size x funding x access (x 0.85 where inherited); 0 if retracted or in a bad venue.

    ``s`` names the columns design_rank, rob_band, n, funding, access and may name rob_inherited, retracted, venue_ok.
    """
    weight = lookup(s["design_rank"], policy.design, 0.0) * lookup(s["rob_band"], policy.rob, policy.rob["high"]) * size_factor(s["n"])
    weight = weight * lookup(s["funding"], policy.funding, policy.funding_other) * lookup(s["access"], policy.access, policy.access_other)
    if "rob_inherited" in s:
        weight = weight * F.when(s["rob_inherited"], policy.inherited).otherwise(1.0)
    out = s.get("retracted", F.lit(False)) | ~s.get("venue_ok", F.lit(True))
    return F.when(out, 0.0).otherwise(weight)


def study_value(direction: Column, magnitude: Column, effect_s: Column, route: Column, policy: Policy = POLICY) -> Column:
    """What a finding counts in -1..1: a measured effect before its label, and a harm never above zero."""
    by_label = (
        F.when(direction == "harm", policy.harm)
        .when(direction == "null_effect", policy.null_effect)
        .when((direction == "benefit") & (magnitude == "meaningful"), policy.benefit_meaningful)
        .when(direction == "benefit", policy.benefit_trivial)
        .otherwise(0.0)
    )
    measured = F.when((direction == "harm") & (effect_s > 0), policy.harm).otherwise(effect_s)
    return F.when(route == "inconclusive_unquantified", 0.0).when(effect_s.isNotNull(), measured).otherwise(by_label)


def rescale(value: Column, mid: float, full: float) -> Column:
    """0 at ``mid``, 1 at ``full``, cut to -1..1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (value - mid) / (full - mid)))


# Words of a unit that refuse a number, and words that name its scale.
WITHIN_GROUP = ("vs baseline", "within-group", "within group", "from baseline", "post vs")
UNSIGNED = ("eta-squared", "eta squared", "eta2", "r-squared", "r2")
RATIO_PHRASES = ("relative risk", "odds ratio", "risk ratio", "hazard ratio")
RATIO_TOKENS = ("or", "rr", "hr", "hazard")
ABSOLUTE_PERCENT = ("percentage point", "cid", "absolute risk", "risk difference")
PERCENT = ("%", "percent")
STANDARDISED = ("cohen", "hedge", "glass", "smd", "standardised", "standardized")
STANDARDISED_TOKENS = ("d", "g", "es", "smd")
NO_UNIT = ("", "none", "n/a", "na", "unknown", "unitless")


def standardise_effect(value: Column, unit: Column, sd: Column, policy: Policy = POLICY) -> Column:
    """struct(s, route): an effect, oriented so that positive is good, on the scale of -1..1, or why it is refused.

    The order of the rules is the rule: a ratio is refused before its unit is looked at for a percentage.
    """
    u = F.lower(F.trim(F.coalesce(unit, F.lit(""))))
    tokens = F.regexp_extract_all(u, F.lit("[a-z]+"), F.lit(0))

    def has(words: tuple[str, ...]) -> Column:
        return reduce(lambda a, b: a | b, (u.contains(w) for w in words))

    def token(words: tuple[str, ...]) -> Column:
        return F.arrays_overlap(tokens, F.array(*(F.lit(w) for w in words)))

    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    sized = sd.isNotNull() & ~F.isnan(sd) & (sd > 0) & (sd < float("inf"))
    none = F.lit(None).cast("double")
    rules = [
        (value.isNull(), none, "no_effect_size"),
        (bad, none, "unparseable_effect_size"),
        (u.isin(*NO_UNIT), none, "no_unit"),
        (has(WITHIN_GROUP), none, "within_group_not_between_arm"),
        (has(UNSIGNED), none, "unsigned_variance_explained"),
        (token(RATIO_TOKENS) | has(RATIO_PHRASES), none, "ratio_null_is_one"),
        (has(ABSOLUTE_PERCENT), none, "absolute_percentage_difference"),
        (has(PERCENT), rescale(value, policy.mid_percent, policy.full_percent), "percent"),
        (has(STANDARDISED) | token(STANDARDISED_TOKENS), rescale(value, policy.mid_smd, policy.full_smd), "smd"),
        (sized, rescale(value / sd, policy.mid_smd, policy.full_smd), "smd_from_sd"),
        (F.lit(True), none, "raw_unit_needs_sd"),
    ]
    out = F.lit(None).cast("struct<s:double,route:string>")
    for when, s, route in reversed(rules):
        out = F.when(when, F.struct(s.alias("s"), F.lit(route).alias("route"))).otherwise(out)
    return out


def band(score: Column) -> Column:
    """The words of a signed score, each range inclusive; null says that the gate fired."""
    return (
        F.when(score.isNull(), "insufficient human evidence")
        .when(score >= 70, "strong support")
        .when(score >= 30, "moderate support")
        .when(score >= 10, "weak support")
        .when(score >= -9, "inconclusive")
        .when(score >= -39, "weak evidence against")
        .when(score >= -69, "does not work")
        .otherwise("strong evidence against / harm")
    )


def dose_factor(low: Column, high: Column, band_low: Column, band_high: Column, policy: Policy = POLICY) -> Column:
    """Credit of a dose (an interval: the worse end) against the range with benefit; 4 digits, null if unassessable."""

    def credit(d: Column) -> Column:
        below = policy.dose_floor + (1 - policy.dose_floor) * (d - 0.5 * band_low) / (0.5 * band_low)
        above = 1.0 + (policy.dose_above - 1.0) * (d - band_high) / band_high
        return (
            F.when(d <= 0.5 * band_low, policy.dose_floor)
            .when(d < band_low, below)
            .when(d >= 2 * band_high, policy.dose_above)
            .when(d > band_high, above)
            .otherwise(1.0)
        )

    known = low.isNotNull() & high.isNotNull() & (band_low > 0) & (band_high > 0)
    return F.when(known, F.round(F.least(credit(low), credit(high)), 4))


def dose_tier(low: Column, high: Column, band_low: Column, band_high: Column) -> Column:
    """below_50, low_50_99, in_band, above_200; unspecified if unknown or if the two ends lie in different tiers."""

    def tier(d: Column) -> Column:
        return F.when(d < 0.5 * band_low, "below_50").when(d < band_low, "low_50_99").when(d > 2 * band_high, "above_200").otherwise("in_band")

    known = low.isNotNull() & high.isNotNull() & band_low.isNotNull() & band_high.isNotNull()
    return F.when(known & (tier(low) == tier(high)), tier(low)).otherwise("unspecified")


def applicability(form_strength: Column, dose_credit: Column, policy: Policy = POLICY) -> Column:
    """The share of evidence that is about the product: mean of form strength and dose credit, missing ones priced."""
    mean = (F.coalesce(form_strength, F.lit(0.0)) + F.coalesce(dose_credit, F.lit(policy.dose_floor))) / 2
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean))


def composite(d: Column, form_strength: Column, dose_credit: Column, c: Column, h: Column, policy: Policy = POLICY) -> Column:
    """0..100: 50 and half the signed score, a positive one times applicability; null without a verdict."""
    signal = d * c * (1 - policy.disagreement * F.coalesce(h, F.lit(0.0)))
    signal = F.when(signal > 0, signal * applicability(form_strength, dose_credit, policy)).otherwise(signal)
    return F.when(signal.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(50 + 50 * signal, 0))).cast("int"))


def verdict_words(score: Column, c: Column, d: Column, fit: Column) -> Column:
    """Plain words of a composite; thin evidence is said to be thin, not bad."""
    return (
        F.when(score.isNull(), "not enough human evidence")
        .when(c.isNull(), "confidence unknown")
        .when(c < 0.15, "barely studied")
        .when((d >= 0.25) & (score < 55), F.when(fit < 0.5, "works, but not tested for your product").otherwise("works, but weakly evidenced"))
        .when((d <= -0.25) & (score >= 55), "does not work")
        .when(score >= 65, "works")
        .when(score >= 55, "probably works")
        .when(score >= 45, "unclear")
        .when(score >= 30, "probably does not work")
        .otherwise("does not work")
    )
