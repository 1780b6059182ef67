"""The whole way from arms and claims to scores: eligibility, claim rules, orientation, votes, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.operators import assembly
from veritally.plans import eligibility
from veritally.plans.eligibility import arms, made_claims, trials
from veritally.plans.evidence import r6
from veritally.plans.views import CLAIMS_SQL, ORDER, SCORES_SQL, UNIT, claims
from veritally.shared import written


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in claims, each line's trial being its order for the gates and its supplier for the votes."""
    gated = assembly.gated_claims(made_claims(spark, sf_dir), trials(spark, sf_dir), arms(spark, sf_dir), place="place")
    told = {"gate": "gate", "gate_reason": "gate_reason", "_s": "effect_s", "_route": "effect_route"}
    # The key by which the rows are partitioned, so that they meet their order without another shuffle.
    lines = gated.select(F.col("trial").alias(ORDER[0]), *ORDER[1:], "l_partkey", "l_suppkey", *(F.col(c).alias(n) for n, c in told.items()))
    rows = claims(spark, sf_dir, lines, tuple(told)).drop("effect_s", "effect_route")
    return rows.withColumnsRenamed({"_s": "effect_s", "_route": "effect_route"})


def assembled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit's score from the claims that pass all gates, and how many each gate kept out."""
    rows = assembly.assembled_scores(written(_gated(spark, sf_dir), "gated-claims"), UNIT, "trial", list(ORDER))
    counts = [F.col(c) for c in ("n_claims", "n_trial", "n_claim", "n_bypass", "n_kept")]
    return rows.select("ecu", *counts, "n_primaries", r6("gate_mass"), r6("e"), r6("d"), r6("c"), "gate_fired", "score", "band")


def gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many claims each gate kept out for which reason, and by which route the others have an effect."""
    rows = _gated(spark, sf_dir)
    votes = F.col("gate").isin("kept", "bypass")
    return rows.groupBy("gate", F.coalesce("gate_reason", F.lit("")).alias("reason"), F.when(votes, F.col("effect_route")).otherwise("").alias("route")).agg(F.count("*").alias("n"))


_KEY = f"trial, {', '.join(ORDER)}"
_USING = ", ".join(ORDER)
_GATED = f"""{CLAIMS_SQL},
of_trial as (select trial as t, reason as why from ({eligibility.ORACLE_SQL["trial_eligibility"]})),
of_claim as (select * exclude (trial) from ({eligibility.ORACLE_SQL["claim_reasons"]})),
of_arm as (select * exclude (trial) from ({eligibility.ORACLE_SQL["claim_exposure"]})),
of_effect as (select * exclude (trial) from ({eligibility.ORACLE_SQL["effect_orientation"]})),
joined as (
  select c.* exclude (effect_s, effect_route), why, reason, s as effect_s, route as effect_route,
    exposed and l_suppkey_of % 10 = 0 and ascii(l_returnflag) % 4 = 0 as harm
  from (select *, trial as l_suppkey_of from claims) c left join of_trial on l_orderkey = t join of_claim using ({_USING}) join of_arm using ({_USING}) join of_effect using ({_USING})),
gated as (select *, case when why is not null then 'trial' when reason is null then 'kept' when harm then 'bypass' else 'claim' end as gate, coalesce(why, reason, '') as gate_reason from joined)"""

QUERIES = {"assembled_scores": assembled_scores, "gate_reasons": gate_reasons}
ORACLE_SQL = {
    "assembled_scores": f"""with {_GATED},
voting as (select * from gated where gate in ('kept', 'bypass')) {SCORES_SQL[len(CLAIMS_SQL) :].replace("from claims window", "from voting window").replace("case when effect_s is not null then case when direction", "case when effect_route = 'inconclusive_unquantified' then 0 when effect_s is not null then case when direction")},
counts as (select ecu, count(*) as n_claims, count(*) filter (gate = 'trial') as n_trial, count(*) filter (gate = 'claim') as n_claim, count(*) filter (gate = 'bypass') as n_bypass, count(*) filter (gate = 'kept') as n_kept from gated group by ecu)
select ecu, n_claims, n_trial, n_claim, n_bypass, n_kept, n_primaries, round(gate_mass, 6) as gate_mass, round(e, 6) as e, round(d, 6) as d, round(c, 6) as c, gate_fired, score, band from counts left join banded using (ecu)""",
    "gate_reasons": f"with {_GATED} select gate, gate_reason as reason, case when gate in ('kept', 'bypass') then effect_route else '' end as route, count(*) as n from gated group by all",
}
