"""From claims to scores: one vote a trial, weights, scores, contributions, dose ranges and arcs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritally.functions import scoring
from veritally.functions.columns import apart
from veritally.functions.constants import POLICY, Policy


def one_vote_per_trial(claims: DataFrame, unit: list[str], trial: str, order: list) -> DataFrame:
    """One row of each trial of a unit, with ``n_claims``: how many it stands for.

    Columns looked at: direction, is_primary, outcome_role, magnitude, effect_s, effect_route; ``order`` is a total
    order in which the first wins. By rule: a claim with the role primary, else one declared primary, the most
    conservative of them; with unknown roles beside secondary ones a harm, else the first as unclear; the majority of
    directions; a tie goes to harm, one of benefit and null is unclear, and any other to the most conservative.
    """
    group = Window.partitionBy(*unit, trial)
    # Rows are sorted once: their place in the order comes first, and all that follows needs no other order.
    claims = claims.withColumn("_at", F.row_number().over(group.orderBy(*order)))
    role, direction = F.coalesce("outcome_role", F.lit("")), F.col("direction")
    names = ("benefit", "null_effect", "unclear", "harm")
    cautious = F.when(direction == "harm", 0).when(direction == "benefit", 2).otherwise(1)
    rows = claims.withColumns({f"_{d}": F.count_if(direction == d).over(group) for d in names})
    rows = rows.withColumns(
        {
            "_n": F.count("*").over(group),
            "_role": F.max((role == "primary").cast("int")).over(group),
            "_primary": F.max(F.coalesce("is_primary", F.lit(False)).cast("int")).over(group),
            "_unknown": F.max((role == "unknown").cast("int")).over(group),
            "_lesser": F.max(role.isin("secondary", "exploratory").cast("int")).over(group),
        }
    )
    top = F.greatest(*(F.col(f"_{d}") for d in names))
    tied = reduce(lambda a, b: a + b, ((F.col(f"_{d}") == top).cast("int") for d in names))
    single, by_role = F.col("_n") == 1, F.col("_role") == 1
    by_primary = ~by_role & (F.col("_primary") == 1)
    mixed = (F.col("_unknown") == 1) & (F.col("_lesser") == 1)
    has_harm = F.col("_harm") > 0
    split = (tied > 1) & (F.col("_benefit") == top) & (F.col("_null_effect") == top) & (F.col("_harm") < top)
    majority = F.when((tied == 1) & reduce(lambda a, b: a | b, ((direction == d) & (F.col(f"_{d}") == top) for d in names)), 0)
    in_tie = (
        F.when(F.col("_harm") == top, F.when(direction == "harm", 0).otherwise(1))
        .when(split, F.when(direction == "null_effect", 0).otherwise(1))
        # Ties without harm and without benefit against null: the most conservative of the tied, as they were first met.
        .otherwise(F.when(reduce(lambda a, b: a | b, ((direction == d) & (F.col(f"_{d}") == top) for d in names)), cautious).otherwise(9))
    )
    rank = (
        F.when(single, 0)
        .when(by_role, F.when(role == "primary", cautious).otherwise(9))
        .when(by_primary, F.when(F.coalesce("is_primary", F.lit(False)), cautious).otherwise(9))
        .when(mixed, F.when(has_harm & (direction != "harm"), 1).otherwise(0))
        .when(tied == 1, F.coalesce(majority, F.lit(1)))
        .otherwise(in_tie)
    )
    settled = single | by_role | by_primary
    route = F.when(~settled & mixed & ~has_harm, "mixed_role_unclear").when(~settled & ~mixed & split, "tie_cleared")
    rows = rows.withColumns({"_place": F.shiftleft(apart(rank).cast("long"), 32) + F.col("_at"), "_route": apart(route)})
    kept = rows.withColumn("_first", F.min("_place").over(group)).where("_place = _first")
    cleared = F.col("_route").isNotNull()
    out = {
        "n_claims": F.col("_n"),
        "direction": F.when(cleared, "unclear").otherwise(direction),
        "magnitude": F.when(~cleared, F.col("magnitude")),
        "effect_s": F.when(~cleared, F.col("effect_s")),
        "effect_route": F.coalesce("_route", "effect_route"),
    }
    return kept.withColumns(out).drop("_n", "_role", "_primary", "_unknown", "_lesser", "_at", "_place", "_route", "_first", *(f"_{d}" for d in names))


def weighted(studies: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """``studies`` with w (weight) and s (value); columns as :func:`veritally.functions.scoring.study_weight` names them."""
    names = ("design_rank", "rob_band", "n", "funding", "access", "rob_inherited", "retracted", "venue_ok")
    s = {n: F.col(n) for n in names if n in studies.columns}
    value = scoring.study_value(F.col("direction"), F.col("magnitude"), F.col("effect_s"), F.col("effect_route"), policy)
    return studies.withColumns({"w": scoring.study_weight(s, policy), "s": value})


def score_units(studies: DataFrame, unit: list[str], syntheses: DataFrame | None = None, policy: Policy = POLICY, more: tuple[Column, ...] = ()) -> DataFrame:
    """One row a unit: gate_mass, e, d, h, c, e_prime, coverage, score, band, n_primaries, and aggregates ``more``.

    ``studies`` has w, s, design_rank: one row a trial. ``syntheses`` (unit, coverage, quality) has at most one row a
    unit. The score is null, with its band and counts, where human designs weigh under the gate or nothing weighs.
    All is one aggregate with partial sums, so a unit of any size is no hot spot; as -1 <= s <= 1, the sum of squares
    loses no more than the last digits.
    """
    human = F.when(F.col("design_rank") <= policy.last_human_rank, scoring.lookup(F.col("design_rank"), policy.design, 0.0)).otherwise(0.0)
    w, s = F.col("w"), F.col("s")
    sums = studies.withColumn("_mass", human).groupBy(*unit).agg(
        F.count("*").alias("n_primaries"),
        F.sum("_mass").alias("gate_mass"),
        F.sum("w").alias("e"),
        F.try_divide(F.sum(w * s), F.sum("w")).alias("d"),
        F.sum(w * s * s).alias("_squares"),
        *more,
    )
    sums = sums.withColumn("_spread", F.greatest(F.lit(0.0), F.col("_squares") - F.col("e") * F.col("d") ** 2)).drop("_squares")
    if syntheses is None:
        sums = sums.withColumns({"coverage": F.lit(0.0), "quality": F.lit(0.0)})
    else:
        sums = sums.join(syntheses.select(*unit, "coverage", "quality"), unit, "left").fillna(0.0, ["coverage", "quality"])
    fired = (F.col("gate_mass") < policy.gate) | (F.col("e") <= 0)
    sums = sums.withColumn("e_prime", F.col("e") * (1 + policy.synthesis * F.col("coverage") * F.col("quality")))
    sums = sums.withColumns(
        {
            "h": F.least(F.lit(1.0), F.try_divide(F.col("_spread"), F.col("e")) / policy.disagreement_full),
            "c": 1 - F.exp(-F.col("e_prime") / policy.saturation),
            "gate_fired": fired,
        }
    )
    raw = 100 * F.col("d") * F.col("c") * (1 - policy.disagreement * F.col("h"))
    score = F.when(~fired, F.greatest(F.lit(-100.0), F.least(F.lit(100.0), F.bround(raw, 0))).cast("int"))
    shown = {k: F.when(~fired, F.col(k)) for k in ("d", "h", "c")}
    return sums.withColumns(shown).withColumn("score", score).withColumn("band", scoring.band(F.col("score"))).drop("_spread", "quality")


def contributions(studies: DataFrame, scores: DataFrame, unit: list[str], policy: Policy = POLICY) -> DataFrame:
    """``studies`` of scored units with points: what each adds to the signed score before it is rounded."""
    scale = 100 * F.col("c") * (1 - policy.disagreement * F.col("h"))
    joined = studies.join(scores.where("score is not null").select(*unit, "e", "c", "h"), unit)
    return joined.withColumns({"d_share": F.col("w") * F.col("s") / F.col("e"), "points": scale * F.col("w") * F.col("s") / F.col("e")}).drop("e", "c", "h")


def dose_ranges(studies: DataFrame, unit: list[str], *more: Column) -> DataFrame:
    """Doses of a unit (see :func:`dose_aggregates`), and aggregates ``more`` of the same rows."""
    return studies.groupBy(*unit).agg(*dose_aggregates(), *more)


def dose_aggregates() -> tuple[Column, ...]:
    """Doses (dose_low, dose_high; the middle counts): all, those with benefit (s > 0), all others."""
    dose = (F.col("dose_low") + F.col("dose_high")) / 2
    good, rest = dose.isNotNull() & (F.col("s") > 0), dose.isNotNull() & (F.col("s") <= 0)
    return (
        F.min(dose).alias("observed_low"),
        F.max(dose).alias("observed_high"),
        F.count(dose).alias("n_with_dose"),
        F.count("*").alias("n_total"),
        F.min(F.when(good, dose)).alias("benefit_low"),
        F.max(F.when(good, dose)).alias("benefit_high"),
        F.count_if(good).alias("n_benefit"),
        F.min(F.when(rest, dose)).alias("null_low"),
        F.max(F.when(rest, dose)).alias("null_high"),
        F.count_if(rest).alias("n_null"),
    )


def arcs(studies: DataFrame, scores: DataFrame, unit: list[str], policy: Policy = POLICY) -> DataFrame:
    """Per unit, scored or not: verdict and coverage of the exact form and of doses near the product's, form strength,
    applicability, composite and its words.

    ``studies`` has w, s, form_match, design_rank, direction, dose_credit (null: unknown), and product_credit of the
    product's own dose, the same over a unit. Where the gate fired, composite is null and gate_fired says so. The best
    few steps of a unit's ladder follow from how many studies stand on each step.
    """
    exact = F.col("form_match") == "exact"
    fair = exact & (F.col("direction") != "harm") & (F.col("s") >= 0) & F.col("design_rank").isNotNull()
    step = scoring.lookup(F.col("design_rank"), policy.ladder, 0.0)
    ws, credit = F.col("w") * F.col("s"), F.col("w") * F.col("dose_credit")
    human = F.when(F.col("design_rank") <= policy.last_human_rank, scoring.lookup(F.col("design_rank"), policy.design, 0.0)).otherwise(0.0)
    steps = sorted(set(policy.ladder.values()), reverse=True)
    sums = studies.withColumn("_step", F.when(fair, step)).groupBy(*unit).agg(
        F.sum("w").alias("_w"),
        F.sum(F.when(exact, F.col("w"))).alias("_form_w"),
        F.sum(F.when(exact, ws)).alias("_form_ws"),
        F.sum(F.when(exact, human)).alias("_form_mass"),
        F.sum(F.when(F.col("w") > 0, credit)).alias("_dose_w"),
        F.sum(F.when(F.col("w") > 0, credit * F.col("s"))).alias("_dose_ws"),
        F.count_if(exact).alias("n_in_form"),
        F.count("_step").alias("_fair"),
        *(F.count_if(F.col("_step") == v).alias(f"_on{i}") for i, v in enumerate(steps)),
        F.max("product_credit").alias("closeness"),
    )
    above, total = F.lit(0), F.lit(0.0)
    for i, v in enumerate(steps):
        total = total + v * F.greatest(F.lit(0), F.least(F.col(f"_on{i}"), policy.ladder_top - above))
        above = above + F.col(f"_on{i}")
    sums = sums.withColumn("_ladder", F.when(F.col("_fair") > 0, total / F.least(F.col("_fair"), F.lit(policy.ladder_top)))).drop("_fair", *(f"_on{i}" for i in range(len(steps))))
    scored = scores.select(*unit, "score", "gate_fired", "d", "c", "h")
    rows = sums.join(scored, unit)
    strength = F.coalesce("_ladder", F.lit(0.0))
    rows = rows.withColumns(
        {
            "form_verdict": F.when((F.col("_form_mass") >= policy.gate) & (F.col("_form_w") > 0), F.col("_form_ws") / F.col("_form_w")),
            "form_coverage": F.coalesce(F.try_divide("_form_w", "_w"), F.lit(0.0)),
            "form_strength": strength,
            "form_basis": F.when(F.col("n_in_form") == 0, "untested_in_form").when(F.col("_ladder").isNull(), "all_negative_in_form").otherwise("ladder"),
            "dose_verdict": F.when(F.col("_dose_w") > 0, F.col("_dose_ws") / F.col("_dose_w")),
            "dose_coverage": F.coalesce(F.try_divide("_dose_w", "_w"), F.lit(0.0)),
            "applicability": scoring.applicability(strength, F.col("closeness"), policy),
            "composite": scoring.composite(F.when(~F.col("gate_fired"), F.col("d")), strength, F.col("closeness"), F.col("c"), F.col("h"), policy),
        }
    )
    words = scoring.verdict_words(F.col("composite"), F.col("c"), F.col("d"), F.col("applicability"))
    return rows.withColumn("words", words).drop("_w", "_form_w", "_form_ws", "_form_mass", "_dose_w", "_dose_ws", "_ladder")


def weight_shares(studies: DataFrame, unit: list[str], axes: dict[str, tuple[Column, Column]]) -> DataFrame:
    """For each axis (name: matched, assessable) the share of a unit's weight that it holds for; null without weight."""
    whole = F.sum("w")
    shares = []
    for name, (matched, assessable) in axes.items():
        shares += [F.try_divide(F.sum(F.when(matched, F.col("w")).otherwise(0.0)), whole).alias(f"{name}_matched")]
        shares += [F.try_divide(F.sum(F.when(assessable, F.col("w")).otherwise(0.0)), whole).alias(f"{name}_assessable")]
    return studies.groupBy(*unit).agg(*shares)


def tier_mix(studies: DataFrame, unit: list[str], tier: str) -> DataFrame:
    """unit, tier, n and its percent of the unit."""
    counts = studies.groupBy(*unit, tier).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(*unit)))


def flag_union(studies: DataFrame, unit: list[str], flags: Column) -> DataFrame:
    """The distinct flags of a unit's studies, sorted and joined by commas."""
    each = studies.select(*unit, F.explode_outer(flags).alias("_flag")).groupBy(*unit).agg(F.collect_set("_flag").alias("_flags"))
    return each.select(*unit, F.array_join(F.array_sort("_flags"), ",").alias("flags"))
