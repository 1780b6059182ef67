"""Operators on small tables, and what must hold whatever the data."""

import random

import pytest
from pyspark.sql import functions as F

from veritally.operators import evidence, identity, reviews, usage

CLAIM = "ecu int, trial int, seq int, direction string, magnitude string, is_primary boolean, outcome_role string, effect_s double, effect_route string"


def vote(spark, *claims):
    rows = [(1, 1, i, d, "meaningful", p, r, 0.5, "smd") for i, (d, p, r) in enumerate(claims)]
    got = evidence.one_vote_per_trial(spark.createDataFrame(rows, CLAIM), ["ecu"], "trial", ["seq"]).collect()
    assert len(got) == 1 and got[0]["n_claims"] == len(claims)
    return got[0]["direction"], got[0]["effect_s"]


def test_votes(spark):
    b, n, h, u = (lambda p=False, r=None, d=d: (d, p, r) for d in ("benefit", "null_effect", "harm", "unclear"))
    assert vote(spark, b()) == ("benefit", 0.5)
    assert vote(spark, b(), b(), n()) == ("benefit", 0.5)
    assert vote(spark, b(), n()) == ("unclear", None)
    assert vote(spark, b(), h()) == ("harm", 0.5)
    assert vote(spark, b(True), n(), n()) == ("benefit", 0.5)
    assert vote(spark, b(True), n(True), b()) == ("null_effect", 0.5)
    assert vote(spark, b(r="primary"), n(True), n()) == ("benefit", 0.5)
    assert vote(spark, b(r="unknown"), b(r="secondary"), n()) == ("unclear", None)
    assert vote(spark, b(r="unknown"), h(r="secondary"), n()) == ("harm", 0.5)
    assert vote(spark, u(), b()) == ("unclear", 0.5)


def studies(spark, rows):
    schema = "ecu int, trial int, w double, s double, design_rank int"
    return spark.createDataFrame([(1, i, float(w), float(s), d) for i, (w, s, d) in enumerate(rows)], schema)


def test_scores(spark):
    rows = studies(spark, [(0.5, 1, 4)] * 9)
    got = evidence.score_units(rows, ["ecu"]).first()
    assert got["h"] == 0 and got["score"] == 95 and got["band"] == "strong support"
    points = evidence.contributions(rows, evidence.score_units(rows, ["ecu"]), ["ecu"]).agg(F.sum("points")).first()[0]
    assert points == pytest.approx(100 * got["d"] * got["c"])
    for gated in ([(0.9, 1, 12)], [(0.0, 1, 4)]):  # animals alone, and nothing that weighs
        got = evidence.score_units(studies(spark, gated), ["ecu"]).first()
        assert got["score"] is None and got["gate_fired"] and got["n_primaries"] == 1


def test_many_reviews_of_the_same_trials_score_as_one(spark):
    rows = studies(spark, [(0.5, 1, 4)] * 4)
    for n in (1, 30):
        included = spark.createDataFrame([(t, r) for t in (0, 1, 7) for r in range(n)], "trial int, review int")
        got = reviews.review_coverage(rows, included, "ecu", "trial", "review").first()
        assert (got["review"], got["coverage"]) == (0, 0.5)


def test_coverage_counts_each_trial_once(spark):
    """Trials in many reviews or in none, and without a name, against a count by hand."""
    rows = spark.createDataFrame([("a", t) for t in (1, 1, 2, 3, None)] + [("b", 4), ("b", 2)] + [("c", 9)], "unit string, trial int")
    included = spark.createDataFrame([(1, 7), (1, 8), (1, 8), (2, 8), (2, 9), (3, 9), (4, 8), (None, 1)], "trial int, review int")
    got = {r["unit"]: (r["review"], r["coverage"]) for r in reviews.review_coverage(rows, included, "unit", "trial", "review").collect()}
    assert got == {"a": (8, 0.5), "b": (8, 1.0), "c": (None, 0.0)}


def test_dedup_and_upsert(spark):
    rows = spark.createDataFrame([(1, "k", "a", None), (2, "k", "b", "x"), (3, "k", "c", "y"), (4, "l", None, "")], "seq int, key string, a string, b string")
    got = identity.dedup_records(rows, "key", "seq", ["a", "b"]).orderBy("key").collect()
    assert [(r["key"], r["seq"], r["n_merged"]) for r in got] == [("k", 2, 3), ("l", 4, 1)]
    base = spark.createDataFrame([(1, "a", "b", "c"), (2, "a", None, "c")], "k int, over string, fill string, keep string")
    new = spark.createDataFrame([(2, None, "n", "n"), (3, "n", None, "n"), (None, "n", "n", "n")], base.schema)
    got = sorted(map(tuple, identity.upsert(base, new, "k", ["over"], ["fill"]).collect()))
    assert got == [(1, "a", "b", "c"), (2, None, "n", "c"), (3, "n", None, "n")]


def test_ambiguous_author_year_names_nothing(spark):
    known = spark.createDataFrame([("t1", "d1", "ay"), ("t2", "d2", "ay"), ("t3", None, "z")], "trial string, doi string, ay string")
    keys = {"doi": F.col("doi"), "author_year": F.col("ay")}
    entries = spark.createDataFrame([(1, "d2", "z"), (2, None, "ay"), (3, "", "z")], "seq int, doi string, ay string")
    got = identity.resolve(entries, identity.known_identities(known, "trial", keys, ("author_year",)), keys, "seq").orderBy("seq").collect()
    assert [(r["trial"], r["by"]) for r in got] == [("t2", "doi"), (None, None), ("t3", "author_year")]


def test_merge_inherited(spark):
    rows = [(1, 1, "low", 40, "a"), (1, 2, "high", 41, "a"), (1, 2, None, None, None), (2, 1, "some_concerns", None, None)]
    frame = spark.createDataFrame(rows, "trial int, review int, rob string, n int, form string")
    got = sorted(map(tuple, reviews.merge_inherited(frame, "trial", "review", "rob", ["n", "form"]).collect()))
    assert got == [(1, 2, "high", None, "a", "n,rob"), (2, 1, "some_concerns", None, None, "")]


@pytest.mark.parametrize("share", [0.0, 0.5, 0.95, 1.0])
def test_index_percentile(spark, share):
    r = random.Random(2)
    groups = {"one": [3.0], "two": [1.0, 2.0], "ties": [5.0] * 900 + [6.0] * 100, "many": [r.random() for _ in range(3000)]}
    frame = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in [*vs, None]], "k string, v double")
    got = {x["k"]: x["percentile"] for x in usage.index_percentile(frame, ["k"], "v", share).collect()}
    assert got == {k: sorted(vs)[int(share * (len(vs) - 1))] for k, vs in groups.items()}


def test_incomplete_totals_are_unknown(spark):
    frame = spark.createDataFrame([("a", "x", 1), ("a", "y", None), ("b", "x", 2)], "g string, h string, v int")
    got = {(r["grouping"], r["name"]): r["v"] for r in usage.roll_up(frame, ["g", "h"], {"v": usage.whole_sum(F.col("v"))}).collect()}
    assert got == {("g", "a"): None, ("g", "b"): 2, ("h", "x"): 3, ("h", "y"): None, ("all", None): None}


def test_pooled(spark):
    frame = spark.createDataFrame([(1, 0.2, 0.5), (1, 0.6, 0.5), (1, None, 1.0), (1, 1.0, 0.0), (2, 1.0, 2.0)], "g int, y double, v double")
    got = {r["g"]: r for r in reviews.pooled(frame, ["g"], F.col("y"), F.col("v")).collect()}
    assert (got[1]["k"], got[2]["k"]) == (2, 1)
    assert got[1]["effect"] == pytest.approx(0.4) and got[1]["se"] == pytest.approx(0.5) and got[1]["q"] == pytest.approx(0.16) and got[1]["i_squared"] == 0


def test_compare_and_diff(spark):
    a, b = (spark.createDataFrame(x, "k int, v double") for x in ([(1, 1.0), (2, 2.0), (3, None)], [(2, 2.5), (3, None), (4, 4.0)]))
    assert {r["k"]: r["status"] for r in reviews.compare_runs(a, b, ["k"], ["v"]).collect()} == {1: "only_a", 2: "differs", 3: "same", 4: "only_b"}
    x, y = (spark.createDataFrame([(v,) for v in s], "c string") for s in ("aab", "abbc"))
    assert sorted(map(tuple, reviews.multiset_diff(x, y, ["c"]).collect())) == [("a", 1, 0), ("b", 0, 1), ("c", 0, 1)]


def test_design_rules(spark):
    cases = [(["Randomized Controlled Trial"], ["Animals"], "", 12), (["Randomized Controlled Trial"], ["Animals", "Humans"], "", 4), (["Clinical Trial"], None, "", None), (["Review", "Systematic Review"], [], "", 3), ([], [], "An umbrella review", 1), (None, None, None, None)]
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, types array<string>, mesh array<string>, title string, want int")
    got = frame.select("want", identity.design_rule(F.col("title"), F.col("types"), F.col("mesh")).alias("r")).collect()
    assert all(r["r"]["rank"] == r["want"] for r in got)
