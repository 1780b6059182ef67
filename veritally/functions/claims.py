"""Rules of one claim: equivalence, the orientation of its measured effect, the dose of its study."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritally.functions.constants import POLICY, Policy
from veritally.functions.scoring import standardise_effect


def _number(x: Column) -> Column:
    """The value where it is finite, else null."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def close(a: Column, b: Column, relative: float = 1e-9, absolute: float = 1e-12) -> Column:
    """Whether two numbers are equal but for the last digits."""
    return F.abs(a - b) <= F.greatest(F.lit(absolute), relative * F.greatest(F.abs(a), F.abs(b)))


def equivalence_valid(c: dict[str, Column]) -> Column:
    """Whether a typed equivalence or non-inferiority result holds together.

    ``c`` names method, conclusion, margin, margin_unit, effect_unit, effect_size, ci_low, ci_high, precision. The
    interval is the criterion: inside the margin, or for non-inferiority above the tolerated loss.
    """
    margin, estimate, low, high, precision = (_number(c[k]) for k in ("margin", "effect_size", "ci_low", "ci_high", "precision"))
    units = [F.lower(F.trim(F.coalesce(c[k], F.lit("")))) for k in ("effect_unit", "margin_unit")]
    typed = c["method"].isin("equivalence", "noninferiority") & c["conclusion"].isin("successful", "equivalent", "noninferior")
    inside = (low >= -margin) & ((c["method"] == "noninferiority") | (high <= margin))
    holds = typed & (margin > 0) & (units[0] != "") & (units[0] == units[1]) & (low <= high) & (precision > 0) & (F.abs(estimate) <= margin) & inside & close(precision, margin)
    return F.coalesce(holds, F.lit(False))


def oriented_effect(c: dict[str, Column], equivalent: Column, policy: Policy = POLICY) -> Column:
    """struct(s, route): a claim's measured effect, signed by the arm that it favours, or why it is refused.

    ``c`` names kind (of the outcome), effect_size, effect_unit, effect_sd, favours, direction, test_kind, statistic,
    provenance. The reported sign counts for nothing, as papers differ in it; a number that favours no arm counts only
    where either sign would be below the threshold. A null without a size is inconclusive unless ``equivalent``.
    """
    raw = c["effect_size"].cast("double")
    magnitude, null = F.abs(raw), (c["direction"] == "null_effect") & ~equivalent
    null = F.coalesce(null, F.lit(False))
    named = F.coalesce(c["favours"].isin("ingredient", "control"), F.lit(False))
    statistic, provenance = (F.lower(F.trim(F.coalesce(c[k], F.lit("")))) for k in ("statistic", "provenance"))
    omnibus = (c["test_kind"] == "group_by_time") & (statistic.startswith("f") | provenance.contains("omnibus"))
    by_arm = standardise_effect(F.when(c["favours"] == "ingredient", magnitude).otherwise(-magnitude), c["effect_unit"], c["effect_sd"], policy)
    unsigned = standardise_effect(magnitude, c["effect_unit"], c["effect_sd"], policy)

    def refused(reason: str | Column) -> Column:
        return F.struct(F.lit(None).cast("double").alias("s"), (F.lit(reason) if isinstance(reason, str) else reason).alias("route"))

    def or_inconclusive(reason: str) -> Column:
        return refused(F.when(null, "inconclusive_unquantified").otherwise(reason))

    rules = [
        (c["kind"] == "adverse_event", refused("adverse_event_inverted_polarity")),
        (raw.isNull(), or_inconclusive("no_effect_size")),
        (F.isnan(magnitude) | (magnitude == float("inf")), or_inconclusive("unparseable_effect_size")),
        ((c["direction"] == "null_effect") & ~named, or_inconclusive("no_effect_size")),
        (((c["direction"] == "benefit") & (c["favours"] == "control")) | ((c["direction"] == "harm") & (c["favours"] == "ingredient")), refused("label_number_contradiction")),
        (omnibus, or_inconclusive("omnibus_magnitude_refused")),
        (named & by_arm["s"].isNull() & null, refused("inconclusive_unquantified")),
        (named, by_arm),
        (unsigned["s"] <= 0, F.struct(unsigned["s"].alias("s"), unsigned["route"].alias("route"))),
        (c["favours"] == "neither", refused("favours_neither_but_above_threshold")),
    ]
    out = refused("sign_convention_unstated")
    for when, value in reversed(rules):
        out = F.when(when, value).otherwise(out)
    return out


def study_dose(d: dict[str, Column]) -> Column:
    """struct(low, high, basis): milligrams of the active part a day.

    ``d`` names elemental, compound, per_kg, mass (only finite numbers above 0 count), basis as declared, and the factor
    of the form, factor_low to factor_high: equal for a known form, a range for an unspecified one, null for an unknown.
    Fields that contradict each other are refused, never chosen between.
    """
    elemental, compound, per_kg, mass = (F.when(_number(d[k]) > 0, _number(d[k])) for k in ("elemental", "compound", "per_kg", "mass"))
    declared = F.coalesce(d["basis"], F.lit("unstated"))
    low, high = d["factor_low"], d["factor_high"]
    known = F.coalesce(low == high, F.lit(False))

    def told(a: Column, b: Column, basis: Column) -> Column:
        return F.struct(a.alias("low"), b.alias("high"), basis.alias("basis"))

    def of_compound(amount: Column) -> Column:
        basis = F.when(amount.isNull(), "unstated").when(low.isNull(), "compound_only").when(known, "converted").otherwise("bounded")
        return told(F.round(amount * low, 3), F.round(amount * high, 3), basis)

    nothing = F.lit(None).cast("double")
    only = declared == "compound_only"
    copied = F.coalesce(close(elemental, compound, absolute=1e-9), F.lit(False))
    inside = F.coalesce((F.round(compound * low, 3) <= elemental) & (elemental <= F.round(compound * high, 3)), F.lit(False))
    daily = per_kg * mass
    rules = [
        (copied & known, of_compound(compound)),
        (only & elemental.isNotNull() & compound.isNotNull() & ~copied, told(nothing, nothing, F.lit("contradictory_dose_fields"))),
        (only & (elemental.isNotNull() | compound.isNotNull()), of_compound(F.coalesce(compound, elemental))),
        (elemental.isNotNull() & compound.isNotNull() & ~inside, told(nothing, nothing, F.lit("contradictory_dose_fields"))),
        (elemental.isNotNull(), told(elemental, elemental, declared)),
        (daily.isNotNull() & only, of_compound(daily)),
        (daily.isNotNull(), told(daily, daily, F.lit("per_kg_x_stated_mass"))),
    ]
    out = of_compound(compound)
    for when, value in reversed(rules):
        out = F.when(when, value).otherwise(out)
    return out


def form_tier(form: Column, family: Column, product_form: Column, product_family: Column) -> Column:
    """exact, salt_family, different, or unspecified where either form, or its family, isn't known."""
    unknown = form.isNull() | product_form.isNull()
    return F.when(unknown, "unspecified").when(form == product_form, "exact").when(family.isNull() | product_family.isNull(), "unspecified").when(family == product_family, "salt_family").otherwise("different")


def population_tier(axes: list[tuple[Column, Column]], adjacent: dict[int, list[tuple[str, str]]] | None = None) -> Column:
    """The worst of the axes: exact, adjacent (unknown on either side, or a pair of ``adjacent`` by axis), different."""
    levels = []
    for i, (a, b) in enumerate(axes):
        near = a.isNull() | b.isNull()
        for x, y in (adjacent or {}).get(i, []):
            near = near | ((a == x) & (b == y)) | ((a == y) & (b == x))
        levels.append(F.when(a == b, 0).when(near, 1).otherwise(2))
    return F.get(F.array(*(F.lit(x) for x in ("exact", "adjacent", "different"))), F.greatest(F.lit(0), F.lit(0), *levels))
