"""From arms and claims to scores in one go: which claims vote, with which effect, and what each gate kept out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.functions import claims as rules
from veritally.operators import eligibility, evidence

#: Fields of a claim that its equivalence result and its measured effect follow from.
EQUIVALENCE = ("method", "conclusion", "margin", "margin_unit", "effect_unit", "effect_size", "ci_low", "ci_high", "precision")
EFFECT = ("kind", "effect_size", "effect_unit", "effect_sd", "favours", "direction", "test_kind", "statistic", "provenance")


def gated_claims(claims: DataFrame, trials: DataFrame, arms: DataFrame, trial: str = "trial", place: str | None = None) -> DataFrame:
    """``claims`` with gate, gate_reason, effect_s, effect_route.

    gate: ``trial`` where the trial can't tell whether the ingredient works, ``claim`` where the claim can't be held
    against its arms, ``bypass`` where it can't but is a harm, as an adverse event, in an arm that surely had the ingredient,
    ``kept`` else. The last two vote. effect_s is the measured effect by the arm that it favours, null where effect_route
    says why it is refused; see :mod:`eligibility` and :func:`rules.oriented_effect` for what the three tables have.
    """
    told = eligibility.trial_eligibility(trials, arms, trial).select(F.col(trial).alias("_trial"), F.col("reason").alias("_of_trial"))
    named = lambda names: {n: F.col(n) for n in names}
    # All that follows from a claim alone comes before its arms are looked for, so that little is shuffled.
    rows = claims.withColumn("_valid", rules.equivalence_valid(named(EQUIVALENCE)))
    rows = rows.withColumn("_effect", rules.oriented_effect(named(EFFECT), F.col("_valid")))
    rows = rows.withColumns({"_harm": F.coalesce((F.col("kind") == "adverse_event") & (F.col("direction") == "harm"), F.lit(False)), "_effect_s": F.round("_effect.s", 6), "_effect_route": F.col("_effect.route")})
    rows = eligibility.held_claims(rows.drop("_valid", "_effect"), arms, trial, place=place)
    rows = rows.join(told, F.col(trial) == F.col("_trial"), "left")
    harm = F.col("exposed") & F.col("_harm")
    gate = F.when(F.col("_of_trial").isNotNull(), "trial").when(F.col("reason").isNull(), "kept").when(harm, "bypass").otherwise("claim")
    rows = rows.withColumns({"gate": gate, "gate_reason": F.coalesce("_of_trial", "reason"), "effect_s": F.col("_effect_s"), "effect_route": F.col("_effect_route")})
    return rows.select(*claims.columns, "gate", "gate_reason", "effect_s", "effect_route")


def assembled_scores(claims: DataFrame, unit: list[str], study: str, order: list[str]) -> DataFrame:
    """One row a unit of ``claims`` (with gate, see :func:`gated_claims`): how many claims each gate kept out or let
    through, and the score of those that vote, one a study (see :mod:`evidence`). Units without votes have no score.
    """
    counts = claims.groupBy(*unit).agg(F.count("*").alias("n_claims"), *(F.count_if(F.col("gate") == g).alias(f"n_{g}") for g in ("trial", "claim", "bypass", "kept")))
    votes = evidence.one_vote_per_trial(claims.where("gate in ('kept', 'bypass')"), unit, study, order)
    return counts.join(evidence.score_units(evidence.weighted(votes), unit), unit, "left")
