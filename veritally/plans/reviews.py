"""Review and comparison queries over the stand-in claims."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.functions.constants import POLICY
from veritally.operators import evidence, reviews
from veritally.plans.evidence import kept_studies, r6, studies
from veritally.plans.views import SCORES_SQL, STUDIES_SQL, UNIT, claims, table


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reviews (suppliers) say of trials (orders)."""
    rob = F.when(F.col("l_tax") < 0.03, "low").when(F.col("l_tax") < 0.06, "some_concerns").otherwise("high")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("trial"),
        F.col("l_suppkey").alias("review"),
        rob.alias("rob"),
        F.when(F.col("l_linenumber") < 3, F.col("l_orderkey") % 40).alias("n"),
        F.col("l_returnflag").alias("form"),
        (F.col("l_linenumber") % 2).alias("outcome"),
        F.col("l_linestatus").alias("direction"),
    )


def inherited_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each trial over all reviews: worst bias, all else unanimous or unknown."""
    return reviews.merge_inherited(facts(spark, sf_dir), "trial", "review", "rob", ["n", "form"])


def review_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The direction of each trial and outcome, null where reviews differ."""
    return reviews.merge_directions(facts(spark, sf_dir), ["trial", "outcome"], "direction")


def _coverage(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    included = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("trial"), F.col("s_nationkey").alias("review"))
    return reviews.review_coverage(rows, included, "ecu", "trial", "review")


def review_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review that covers most of each unit's trials."""
    out = _coverage(spark, sf_dir, claims(spark, sf_dir))  # each trial with a claim has a vote
    return out.select("ecu", "review", r6("coverage"))


def reviewed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with the lift that a review of quality 0.7 gives."""
    rows = kept_studies(spark, sf_dir, "ecu", "trial", "w", "s", "design_rank")
    cover = _coverage(spark, sf_dir, rows).select("ecu", "coverage", F.lit(0.7).alias("quality"))
    out = evidence.score_units(rows, UNIT, cover)
    return out.select("ecu", r6("coverage"), r6("e_prime"), r6("c"), "score")


def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores under the policy and under twice its saturation, side by side; each run lacks some units of the other."""
    rows = kept_studies(spark, sf_dir)
    a, b = (evidence.score_units(rows, UNIT, policy=p) for p in (POLICY, replace(POLICY, saturation=2 * POLICY.saturation)))
    return reviews.compare_runs(a.where("ecu % 10 <> 3"), b.where("ecu % 10 <> 7"), UNIT, ["score"])


def claim_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that shipped and open lines have in different numbers."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("ecu"), F.col("l_returnflag").alias("direction"), "l_linestatus")
    return reviews.multiset_diff(lines.where("l_linestatus = 'F'"), lines.where("l_linestatus = 'O'"), ["ecu", "direction"])


def gated_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units searched for (all parts) that no benefit was found for."""
    searched = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ecu"))
    return reviews.missing_outcomes(searched, studies(spark, sf_dir).where("direction = 'benefit' and s > 0.9"), UNIT)


def pooled_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse-variance pools of each trial's measured lines."""
    lines = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").withColumnRenamed("l_suppkey", "stratum")
    out = reviews.pooled(lines, ["stratum"], F.col("l_discount") * 10 - 0.3, 1 / F.col("l_quantity"))
    return out.select("stratum", "k", r6("effect"), r6("se"), r6("q"), r6("i_squared"))


QUERIES = {f.__name__: f for f in (inherited_facts, review_directions, review_overlap, reviewed_scores, run_comparison, claim_diff, gated_outcomes, pooled_effects)}

_FACTS = """
f as (select l_orderkey as trial, l_suppkey as review, case when l_tax < 0.03 then 0 when l_tax < 0.06 then 1 else 2 end as rob, case when l_linenumber < 3 then l_orderkey % 40 end as n,
    l_returnflag as form, l_linenumber % 2 as outcome, l_linestatus as direction from lineitem)"""
_COVER = """,
o as (select ecu, s_nationkey as review, count(*) as shared from studies join supplier on trial = s_suppkey group by 1, 2),
best as (select ecu, review, shared, row_number() over (partition by ecu order by shared desc, review) as nth from o),
cover as (select s.ecu, review, coalesce(shared, 0) / count(*)::double as coverage from studies s left join best on s.ecu = best.ecu and nth = 1 group by s.ecu, review, shared)"""

ORACLE_SQL = {
    "inherited_facts": f"""with {_FACTS} select trial, count(distinct review) as n_reviews, ['low', 'some_concerns', 'high'][max(rob) + 1] as rob, case when count(distinct n) = 1 then min(n) end as n, case when count(distinct form) = 1 then min(form) end as form,
  array_to_string(list_filter([case when count(distinct form) > 1 then 'form' end, case when count(distinct n) > 1 then 'n' end, case when count(distinct rob) > 1 then 'rob' end], lambda x: x is not null), ',') as conflicts from f group by trial""",
    "review_directions": f"with {_FACTS} select trial, outcome, case when count(distinct direction) = 1 then min(direction) end as direction, count(distinct direction) > 1 as conflict from f group by trial, outcome",
    "review_overlap": f"with {STUDIES_SQL} {_COVER} select ecu, review, round(coverage, 6) as coverage from cover",
    "reviewed_scores": f"""with {STUDIES_SQL} {_COVER}, {SCORES_SQL[len(STUDIES_SQL):].strip().lstrip(",").strip().split("scores as (")[0].strip().rstrip(",").replace("1 - exp(-e / 1.5) as c", "e as e0")},
z as (select ecu, gate_fired, d, h, coverage, e0 * (1 + 0.3 * coverage * 0.7) as e_prime from shape join cover using (ecu))
select ecu, round(coverage, 6) as coverage, round(e_prime, 6) as e_prime, case when not gate_fired then round(1 - exp(-e_prime / 1.5), 6) end as c,
  case when not gate_fired then greatest(-100, least(100, round_even(100 * d * (1 - exp(-e_prime / 1.5)) * (1 - 0.4 * h), 0)))::int end as score from z""",
    "run_comparison": f"""with x as (with {SCORES_SQL} select ecu, score from scores), y as (with {SCORES_SQL.replace("exp(-e / 1.5)", "exp(-e / 3.0)")} select ecu, score from scores)
select ecu, x.score as score_a, y.score as score_b, case when y.here is null then 'only_a' when x.here is null then 'only_b' when x.score is not distinct from y.score then 'same' else 'differs' end as status
from (select *, 1 as here from x where ecu % 10 <> 3) x full join (select *, 1 as here from y where ecu % 10 <> 7) y using (ecu)""",
    "claim_diff": """with c as (select l_partkey as ecu, l_returnflag as direction, count(*) filter (l_linestatus = 'F') - count(*) filter (l_linestatus = 'O') as d from lineitem group by 1, 2)
select ecu, direction, greatest(0, d)::bigint as only_a, greatest(0, -d)::bigint as only_b from c where d <> 0""",
    "gated_outcomes": f"with {STUDIES_SQL} select p_partkey as ecu from part where p_partkey not in (select ecu from studies where direction = 'benefit' and s > 0.9)",
    "pooled_effects": """with e as (select l_suppkey as stratum, l_discount * 10 - 0.3 as y, 1 / (1 / l_quantity) as w from lineitem where l_linestatus = 'F'),
p as (select stratum, count(*) as k, sum(w * y) / sum(w) as effect, sqrt(1 / sum(w)) as se from e group by stratum), q as (select stratum, k, effect, se, sum(w * (y - effect) ** 2) as q from e join p using (stratum) group by all)
select stratum, k, round(effect, 6) as effect, round(se, 6) as se, round(q, 6) as q, round(case when q > 0 then greatest(0, (q - (k - 1)) / q) else 0 end, 6) as i_squared from q""",
}
