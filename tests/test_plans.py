"""What plans must hold so that large tables stay within their limits."""

import re

import pytest

from veritally.operators.evidence import one_vote_per_trial as claim_votes
from veritally.plans import articles, estimates, evidence, reviews, serving, trials

SF = "/root/testdata/sf0.001"


def method_size(spark, df) -> int:
    """The largest method that Spark generates for ``df``, in bytes; the JVM compiles none beyond 8,000."""
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    return max(int(x) for x in re.findall(r"maxMethodCodeSize:(-?\d+)", df._jdf.queryExecution().explainString(mode)))


@pytest.fixture
def fixed(spark):
    """Plans as they are before they adapt."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_votes_are_compiled(fixed):
    assert method_size(fixed, evidence.studies(fixed, SF)) <= 8000


def test_effects_are_compiled(fixed):
    assert method_size(fixed, trials.effect_sizes(fixed, SF)) <= 8000


def test_estimates_are_compiled(fixed):
    assert method_size(fixed, estimates.derived_estimates(fixed, SF)) <= 8000


def test_articles_are_compiled(fixed):
    assert method_size(fixed, articles.article_tables(fixed, SF)) <= 8000


@pytest.mark.parametrize("query", [articles.arm_aliases, articles.article_tables])
def test_no_side_that_grows_is_broadcast(spark, query):
    assert "BroadcastHashJoin" not in query(spark, SF)._jdf.queryExecution().executedPlan().toString()


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_votes_are_sorted_once(fixed):
    rows = fixed.createDataFrame([], "ecu int, trial int, seq int, direction string, is_primary boolean, outcome_role string, magnitude string, effect_s double, effect_route string")
    assert plan_of(claim_votes(rows, ["ecu"], "trial", ["seq"])).count("Sort [") == 1


def test_scores_keep_what_they_need(fixed):
    kept = {f.rsplit("/", 1)[0] for f in reviews.reviewed_scores(fixed, SF).inputFiles() if "/studies-" in f}
    assert [fixed.read.parquet(f).columns for f in kept] == [["ecu", "trial", "w", "s", "design_rank"]]


@pytest.mark.parametrize("query", [reviews.review_overlap, evidence.product_dose, serving.product_lookup])
def test_lines_are_read_once_and_not_written(fixed, query):
    plan = plan_of(query(fixed, SF))
    assert plan.count("/lineitem.parquet") == 1 and "/studies-" not in plan


def test_trials_are_not_aggregated_before_a_shuffle(fixed):
    assert "keys=[trial" not in plan_of(serving.review_inheritance(fixed, SF))
