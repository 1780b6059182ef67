"""Reviews: what they say of one trial, how far they cover a unit, and comparisons of runs and sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Which judgement of bias is worse.
SEVERITY = ("low", "some_concerns", "high")


def merge_inherited(facts: DataFrame, trial: str, review: str, worst: str, unanimous: list[str]) -> DataFrame:
    """One row a trial: n_reviews, ``worst`` (the worst band that any review gave), ``unanimous`` fields (null where
    reviews differ) and conflicts (the names of fields that differ, sorted and joined by commas).

    Unknown isn't a vote: null differs from nothing.
    """
    level = F.array_position(F.array(*(F.lit(s) for s in SEVERITY)), F.col(worst))
    differ = {c: F.coalesce(F.min(c) != F.max(c), F.lit(False)) for c in [worst, *unanimous]}
    kept = [F.when(~differ[c], F.min(c)).alias(c) for c in unanimous]
    conflicts = F.array_join(F.array_sort(F.array_compact(F.array(*(F.when(d, c) for c, d in differ.items())))), ",")
    return facts.groupBy(trial).agg(
        F.count_distinct(review).alias("n_reviews"),
        F.get(F.array(*(F.lit(s) for s in SEVERITY)), (F.max(level) - 1).cast("int")).alias(worst),
        *kept,
        conflicts.alias("conflicts"),
    )


def merge_directions(results: DataFrame, keys: list[str], direction: str) -> DataFrame:
    """The direction of each (trial, outcome) if all that report one agree, else null and ``conflict``."""
    agree = F.min(direction) == F.max(direction)
    return results.groupBy(*keys).agg(F.when(agree, F.min(direction)).alias(direction), F.coalesce(~agree, F.lit(False)).alias("conflict"))


def review_coverage(studies: DataFrame, included: DataFrame, unit: str, trial: str, review: str) -> DataFrame:
    """unit, review, coverage: the review that names the largest share of a unit's trials, the smallest on ties.

    A maximum, not a sum: thirty reviews of the same trials are one body of evidence.
    """
    # Each trial meets its reviews once; one of them stands for the trial where trials are counted.
    named = included.select(trial, review).distinct().withColumn("_one", F.col(review).eqNullSafe(F.min(review).over(Window.partitionBy(trial))))
    met = studies.select(unit, trial).distinct().join(named, trial, "left")
    shared = met.groupBy(unit, review).agg(F.count("_one").alias("_shared"), F.count_if(F.coalesce("_one", F.lit(True))).alias("_trials"))
    best = F.min(F.when(F.col("_shared") > 0, F.struct((-F.col("_shared")).alias("less"), F.col(review))))
    return shared.groupBy(unit).agg(F.sum("_trials").alias("_n"), best.alias("_best")).select(unit, F.col(f"_best.{review}").alias(review), F.coalesce(-F.col("_best.less") / F.col("_n"), F.lit(0.0)).alias("coverage"))


def compare_runs(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-6) -> DataFrame:
    """All keys of two runs side by side: each value as v_a and v_b, and status: only_a, only_b, same or differs."""
    left = a.select(*keys, *(F.col(v).alias(f"{v}_a") for v in values), F.lit(True).alias("_a"))
    right = b.select(*keys, *(F.col(v).alias(f"{v}_b") for v in values), F.lit(True).alias("_b"))
    same = F.lit(True)
    for v in values:
        x, y = F.col(f"{v}_a"), F.col(f"{v}_b")
        same = same & (x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False)))
    status = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").when(same, "same").otherwise("differs")
    return left.join(right, keys, "full_outer").withColumn("status", status).drop("_a", "_b")


def multiset_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, only_a, only_b: how many more copies of a row one side has; rows that both have equally are left out.

    Both sides are counted before they meet, so repeated rows cost one row each in the shuffle.
    """
    both = a.select(*keys, F.lit(1).alias("_d")).unionByName(b.select(*keys, F.lit(-1).alias("_d")))
    sums = both.groupBy(*keys).agg(F.sum("_d").alias("_d")).where("_d <> 0")
    return sums.select(*keys, F.greatest(F.lit(0), F.col("_d")).cast("long").alias("only_a"), F.greatest(F.lit(0), -F.col("_d")).cast("long").alias("only_b"))


def missing_outcomes(searched: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    """Searched units without a scored row: they are emitted as such, as nothing found is not the same as not looked."""
    return searched.select(*keys).distinct().join(scored.select(*keys), keys, "left_anti")


def pooled(estimates: DataFrame, stratum: list[str], effect: Column, variance: Column) -> DataFrame:
    """k, effect, se, q, i_squared of each stratum by inverse variances; estimates without a variance > 0 don't count.

    Q takes a second pass, from the pooled effect joined back: in one pass it cancels where all agree.
    """
    rows = estimates.select(*stratum, effect.cast("double").alias("_y"), (1 / F.nullif(variance.cast("double"), F.lit(0.0))).alias("_w"))
    rows = rows.where("_w > 0 and _w < double('infinity') and _y is not null and not isnan(_y)")
    first = rows.groupBy(*stratum).agg(F.count("*").alias("k"), (F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).alias("effect"), F.sqrt(1 / F.sum("_w")).alias("se"))
    spread = rows.join(first, stratum).groupBy(*stratum).agg(F.first("k").alias("k"), F.first("effect").alias("effect"), F.first("se").alias("se"), F.sum(F.col("_w") * (F.col("_y") - F.col("effect")) ** 2).alias("q"))
    share = F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - (F.col("k") - 1)) / F.col("q"))).otherwise(0.0)
    return spread.withColumn("i_squared", share)
