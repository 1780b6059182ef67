"""Claim rules, statistics and rankings against worked cases and plain Python."""

import math
import random
from collections import defaultdict
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritally.functions import claims, statistics, texts
from veritally.operators import eligibility, meta, overlap, ranking


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


ARM = "trial int, label string, role string, presence string, cointerventions array<string>"


def test_trial_eligibility(spark):
    given = [(1, "a", None, "yes", None), (1, "b", None, "yes", None), (2, "a", "biomarker", "yes", None), (3, "a", None, "yes", ["X"]), (3, "b", None, "no", ["x", "x"]), (4, "a", None, "yes", ["X"]), (4, "b", None, "no", [])]
    trials = [(i, None, None, "no") for i in range(1, 5)] + [(5, "all_arms_get_ingredient", None, None), (6, None, True, None), (7, None, None, "unknown")]
    got = eligibility.trial_eligibility(spark.createDataFrame(trials, "trial int, comparator string, underpowered boolean, isolated string"), spark.createDataFrame(given, ARM))
    assert {r["trial"]: r["reason"] for r in got.collect()} == {1: "no_ingredient_free_arm", 2: "no_administered_intervention_arm", 3: None, 4: "no_isolated_ingredient_arm", 5: "no_ingredient_free_arm", 6: "self_declared_underpowered", 7: None}


def test_claim_reasons(spark):
    fields = "trial int, seq int, ingredient_arm string, control_arm string, test_kind string, outcome_role string, provenance string, statistic string, contrast string, version string"
    arms = [(1, "Creatine", "administered", "yes", []), (1, "Placebo", "administered", "no", []), (2, "A", "administered", "yes", ["w"]), (2, "a!", "administered", "no", ["w"]), (2, "B", "administered", "no", ["w"])]
    good = (1, 1, "creatine", "PLACEBO", "between_arm", "primary", "pairwise", "t", "vs_ingredient_free", "v1.24")
    rows = [good, (*good[:1], 2, None, *good[3:]), (*good[:1], 3, "placebo", *good[3:]), (2, 4, "a", "b", *good[4:]), (*good[:1], 5, *good[2:4], "omnibus", *good[5:]), (3, 6, *[None] * 7, "legacy-2"), (3, 7, *[None] * 8), (3, 8, *good[2:]), (*good[:1], 9, None, None, *good[4:9], None)]
    got = eligibility.claim_reasons(spark.createDataFrame(rows, fields), spark.createDataFrame(arms, ARM))
    assert {r["seq"]: r["reason"] for r in got.collect()} == {1: None, 2: "modern_provenance_missing", 3: "claim_arms_not_distinct", 4: "claim_arm_not_unique_in_s3", 5: "invalid_test_kind:omnibus", 6: None, 7: "extraction_version_missing", 8: "s3_arms_missing", 9: None}


def test_claims_are_shuffled_once(spark):
    """Claims and arms go by trial in one shuffle; a null trial has no arms, and an empty label names none."""
    claims = "trial int, id int, ingredient_arm string, control_arm string, test_kind string, outcome_role string, provenance string, statistic string, contrast string, version string"
    rows = [(t, i, a, "Placebo", "between_arm", "primary", "t", "t", "vs_ingredient_free", "v1.24") for i, (t, a) in enumerate([(1, "Drug"), (None, "Drug"), (2, "Drug"), (1, "-")])]
    arms = [(t, label, "administered", presence, []) for t in (1, None) for label, presence in (("drug", "yes"), ("placebo", "no"), (" - ", "no"))]
    held = eligibility.held_claims(spark.createDataFrame(rows, claims), spark.createDataFrame(arms, "trial int, label string, role string, presence string, cointerventions array<string>"))
    got = {r["id"]: (r["reason"], r["exposed"]) for r in held.collect()}
    assert got == {0: (None, True), 1: ("s3_arms_missing", False), 2: ("s3_arms_missing", False), 3: ("claim_arm_not_unique_in_s3", False)}
    assert held._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_unique_match_refuses_repeated_labels(spark):
    left = spark.createDataFrame([(1, 1, "Arm A"), (1, 2, "arm-b"), (1, 3, "ARM B"), (2, 4, "arm a")], "trial int, seq int, label string")
    right = spark.createDataFrame([(1, "arm a", 10), (1, "arm b", 20), (2, "Arm A", 30), (2, "arm_a", 40)], "trial int, name string, dose int")
    got = eligibility.unique_match(left, right, "trial", "label", "name", ["dose"]).collect()
    assert {r["seq"]: r["dose"] for r in got} == {1: 10, 2: None, 3: None, 4: None}


def test_effects_that_name_no_arm(spark):
    def effect(size, favours, direction="benefit", unit="d", kind="efficacy", equivalent=False):
        c = {k: F.lit(v) for k, v in {"kind": kind, "effect_size": size, "effect_unit": unit, "favours": favours, "direction": direction, "test_kind": "between_arm", "statistic": "t", "provenance": ""}.items()}
        c["effect_size"], c["effect_sd"] = c["effect_size"].cast("double"), F.lit(None).cast("double")
        got = value(spark, claims.oriented_effect({k: v.cast("string") if k == "favours" else v for k, v in c.items()}, F.lit(equivalent)))
        return got["s"] if got["s"] is None else round(got["s"], 6), got["route"]

    assert effect(-0.5, "ingredient") == (0.5, "smd") and effect(0.5, "control", "harm") == (-1.0, "smd")
    assert effect(0.5, "control") == (None, "label_number_contradiction")
    assert effect(0.1, "neither") == (round(-0.1 / 0.6, 6), "smd") and effect(0.9, "neither") == (None, "favours_neither_but_above_threshold")
    assert effect(0.9, None) == (None, "sign_convention_unstated") and effect(0.1, None, "null_effect") == (None, "inconclusive_unquantified")
    assert effect(None, "ingredient", "null_effect") == (None, "inconclusive_unquantified") and effect(None, None, "null_effect", equivalent=True) == (None, "no_effect_size")
    assert effect(float("inf"), "ingredient") == (None, "unparseable_effect_size") and effect(1.0, "ingredient", kind="adverse_event")[1] == "adverse_event_inverted_polarity"


def test_doses(spark):
    def dose(**d):
        names = ("elemental", "compound", "per_kg", "mass", "factor_low", "factor_high")
        got = value(spark, claims.study_dose({**{n: F.lit(d.get(n)).cast("double") for n in names}, "basis": F.lit(d.get("basis")).cast("string")}))
        return got["low"], got["high"], got["basis"]

    assert dose() == (None, None, "unstated") and dose(elemental=100.0) == (100, 100, "unstated")
    assert dose(per_kg=-300.0, mass=-70.0) == (None, None, "unstated") and dose(per_kg=300.0, mass=70.0) == (21000, 21000, "per_kg_x_stated_mass")
    assert dose(compound=float("inf")) == (None, None, "unstated") and dose(compound=100.0) == (None, None, "compound_only")
    assert dose(compound=100.0, factor_low=0.5, factor_high=0.75) == (50, 75, "bounded") and dose(compound=100.0, elemental=100.0, factor_low=0.5, factor_high=0.5) == (50, 50, "converted")
    assert dose(compound=100.0, elemental=90.0, factor_low=0.5, factor_high=0.5)[2] == "contradictory_dose_fields"


@pytest.mark.parametrize("p", [1e-12, 0.01, 0.3, 0.5, 0.8, 0.99, 1 - 1e-9])
def test_normal_quantile(spark, p):
    assert value(spark, statistics.normal_quantile(F.lit(p))) == pytest.approx(NormalDist().inv_cdf(p), rel=2e-8, abs=1e-8)


def test_t_quantile():
    for df, want in ((1, 12.706204736), (2, 4.302652730), (5, 2.570581836), (30, 2.042272456), (1000, 1.962339081)):
        assert meta.t_quantile(0.975, df) == pytest.approx(want, rel=1e-8)


def test_reml():
    """Against a fine grid; no spread at all gives 0; two studies and unequal variances too."""
    r = np.random.default_rng(5)
    for k in (2, 3, 8, 30):
        y, v = r.normal(0.3, 0.5, k), r.uniform(0.001, 0.3, k)
        grid = np.concatenate([[0.0], np.geomspace(1e-8, 100, 200_000)])
        best = max(meta._profile(part, y, v).max() for part in np.array_split(grid, 50))
        assert meta._profile(np.array([meta.reml_tau2(y, v)]), y, v)[0] >= best - 1e-9
    assert meta.reml_tau2(np.full(4, 0.2), np.full(4, 0.1)) == 0


def test_reml_of_two_peaks():
    """Profiles with two maxima of tau2 apart by decades, and extreme scales, against a dense scan."""
    r = np.random.default_rng(7)
    two = 0
    for n in range(60):
        k = int(r.integers(3, 12))
        v = 10.0 ** r.uniform(-8, 4, k) if n % 2 else np.concatenate([np.full(k, 1e-6), np.full(3, 1e3)])
        y = r.normal(0, 1, len(v)) * 10.0 ** r.uniform(-5, 3, len(v))
        grid = np.concatenate([[0.0], np.geomspace(1e-20, 1e12, 100_000)])
        value = meta._profile(grid, y, v)
        inner = value[1:-1]
        two += int(((inner > value[:-2]) & (inner > value[2:]) & (np.abs(inner - value[0]) > 1e-6)).sum()) > 1
        assert meta._profile(np.array([meta.reml_tau2(y, v)]), y, v)[0] >= value.max() - 1e-9 * max(1, abs(value.max()))
    assert two > 5


def test_reml_is_exact_and_cheap():
    """With equal variances tau2 is the sample variance less theirs, to the last digits; points go no further than a peak can."""
    r = np.random.default_rng(9)
    for k in (2, 5, 30):
        y = r.normal(0, 1, k)
        v = np.full(k, 0.1 * y.var(ddof=1))
        assert meta.reml_tau2(y, v) == pytest.approx(y.var(ddof=1) - v[0], rel=1e-11)
    y, v = r.integers(0, 11, (50, 30)) / 10, r.integers(2, 52, (50, 30)) / 100
    points = meta._points(v.min(axis=1), np.maximum(v.max(axis=1), np.ptp(y, axis=1) ** 2))
    assert points.shape[1] < 250 and (meta._slopes(points[:, -1:], y, v) < 0).all()


def test_large_strata(spark):
    """Strata beyond what a task may hold are summed up over all tasks, to the same result."""
    r = np.random.default_rng(2)
    rows = [(s, i, 0, float(r.normal(0.1 * s, 0.4)), float(r.uniform(0.01, 0.5))) for s, k in ((1, 90), (2, 41), (3, 8), (4, 70)) for i in range(k)]
    rows += [(5, i, 0, 0.25, 0.1) for i in range(60)]
    frame = spark.createDataFrame(rows, "stratum int, study int, seq int, y double, v double").repartition(3)
    few, many = ({x["stratum"]: x for x in meta.random_effects(frame, "stratum", "study", F.col("y"), F.col("v"), ["seq"], most=most).collect()} for most in (1000, 40))
    assert few.keys() == many.keys() == {1, 2, 3, 4, 5} and many[5]["tau2"] == 0
    for s, x in few.items():
        assert [*many[s]][1:9] == pytest.approx([*x][1:9], rel=1e-6, abs=1e-9)


def test_random_effects(spark):
    rows = [("one", 1, 0, 0.5, 0.1), ("two", 1, 0, 0.5, 0.1), ("two", 1, 1, 9.0, 0.1), ("two", 2, 0, 0.7, 0.2), ("none", 1, 0, 0.5, 0.0), ("many", 1, 0, 0.1, 0.1)] + [("many", i, 0, 0.1 * i, 0.05) for i in range(2, 9)]
    frame = spark.createDataFrame(rows, "stratum string, study int, seq int, y double, v double")
    got = {r["stratum"]: r for r in meta.random_effects(frame, "stratum", "study", F.col("y"), F.col("v"), ["seq"]).collect()}
    assert set(got) == {"one", "two", "many"} and got["one"]["refusal"] == "one_study" and got["two"]["k"] == 2
    y, v = np.array([0.1] + [0.1 * i for i in range(2, 9)]), np.array([0.1] + [0.05] * 7)
    tau2 = meta.reml_tau2(y, v)
    w = 1 / (v + tau2)
    mean = (w * y).sum() / w.sum()
    se = math.sqrt(max(1, (w * (y - mean) ** 2).sum() / 7) / w.sum())
    many = got["many"]
    assert many["effect"] == pytest.approx(mean) and many["ci_high"] == pytest.approx(mean + meta.t_quantile(0.975, 7) * se) and many["pi_low"] == pytest.approx(mean - meta.t_quantile(0.975, 6) * math.sqrt(se**2 + tau2))
    assert meta.random_effects(frame.limit(0), "stratum", "study", F.col("y"), F.col("v"), ["seq"]).count() == 0


def test_round_robin(spark):
    """Against the loop over all records that it stands for."""
    r = random.Random(4)
    outcomes = ["x", "y", "z"]
    for n, limit in ((40, 10), (40, 60), (5, 3), (0, 3)):
        tags = {i: [o for o in outcomes if r.random() < 0.3] for i in range(n)}
        pools = {o: [i for i in range(n) if o in tags[i]] for o in outcomes}
        want, at = [], {o: 0 for o in outcomes}
        while len(want) < limit:
            before = len(want)
            for o in outcomes:
                while at[o] < len(pools[o]) and len(want) < limit:
                    at[o] += 1
                    if pools[o][at[o] - 1] not in want:
                        want.append(pools[o][at[o] - 1])
                        break
            if len(want) == before:
                break
        want += [i for i in range(n) if not tags[i]][: max(0, limit - len(want))]
        records = spark.createDataFrame([(i,) for i in range(n)], "id int")
        tagged = spark.createDataFrame([(i, o) for i, os in tags.items() for o in [*os, "other"]], "id int, outcome string")
        got = ranking.round_robin(records, tagged, outcomes, ["id"], limit, "id").orderBy("turn").collect()
        assert [g["id"] for g in got] == want


def test_disjoint_sets(spark):
    r = random.Random(6)
    links = [(i, i + 1) for i in range(60)] + [(r.randint(100, 400), r.randint(100, 400)) for _ in range(150)] + [(500, 500), (None, 1)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {x["node"]: x["root"] for x in ranking.disjoint_sets(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {n: find(n) for n in root}


def test_numbered_and_newest(spark):
    rows = spark.createDataFrame([(i, i * 7 % 31, i % 3) for i in range(200)], "id int, v int, k int").repartition(5)
    got = ranking.numbered(rows, [F.col("v"), F.desc("id")]).collect()
    want = sorted(range(200), key=lambda i: (i * 7 % 31, -i))
    assert {g["position"]: g["id"] for g in got} == dict(enumerate(want))
    assert [x["id"] for x in ranking.strided(rows, [F.col("id")], 50).orderBy("id").collect()] == [0, 50, 100, 150]
    best = {g["k"]: g["id"] for g in ranking.newest(rows, ["k"], [F.col("v"), -F.col("id")]).collect()}
    assert best == {k: next(i for i in want if i % 3 == k) for k in range(3)}


def test_set_overlap(spark):
    sets = {1: {1, 2, 3}, 2: {2, 3, 4, 5}, 3: {9}, 4: {1, 2, 3}}
    frame = spark.createDataFrame([(g, x) for g, xs in sets.items() for x in [*xs, *xs]], "g int, x int")
    got = {(r["a"], r["b"]): (r["shared"], r["containment"], r["covered"]) for r in ranking.set_overlap(frame, "g", "x").collect()}
    want = defaultdict(tuple)
    for a in sets:
        for b in sets:
            if a < b and (n := len(sets[a] & sets[b])):
                want[a, b] = (n, n / min(len(sets[a]), len(sets[b])), n / len(sets[a] | sets[b]))
    assert got == want


def test_texts(spark):
    def text(f, *values):
        return value(spark, f(*(F.lit(v).cast("string") for v in values)))

    assert text(texts.percent_decoded, "%252Fa%C3%A9%4%%41") == "/a%C3%A9%4%A"
    assert text(texts.mean_sd, "1,5 ± 0,5") == (1.5, 0.5) and text(texts.mean_sd, "1,234 ± 5") is None and text(texts.mean_sd, None) is None
    assert text(texts.facts_kept, 'p 0.05 "a"', '"a" p 0.05') and not text(texts.facts_kept, "5 mg", "6 mg")
    assert text(texts.direction_of, "SMD 0.4 (95% CI 0.1 to 0.7)", "higher_better") == "benefit" and text(texts.direction_of, "RR 1.0 (0.9-1.1)", None) == "null_effect"
    assert text(texts.registered_before, "2020-01-05", "2020-01") is None and text(texts.registered_before, "2020-02-05", "2020-01") == 0
    assert text(texts.links, 'x\nLinks: [{"url":"http://a.b/c"},{"url":"nope"}]\n') == ["http://a.b/c"] and text(texts.links, None) == []
    assert value(spark, texts.elided(F.lit("a" * 50 + "b" * 50), 27)) == "a" * 10 + "\n[...]\n" + "b" * 10
    assert len(value(spark, texts.snippets(F.lit("took 5 mg daily. " * 3)))) >= 1


def test_population_tiers(spark):
    def tier(*axes, **adjacent):
        return value(spark, claims.population_tier([tuple(F.lit(x).cast("string") for x in a) for a in axes], **adjacent))

    assert tier(("a", "a")) == "exact" and tier(("a", None), ("b", "b")) == "adjacent" and tier(("a", "c")) == "different"
    assert tier(("a", "c"), adjacent={0: [("c", "a")]}) == "adjacent"
    assert value(spark, claims.form_tier(*(F.lit(x).cast("string") for x in ("a", None, "b", "c")))) == "unspecified"


def source(i, estimate, half, trials, quality=6, year=2020, metric="smd"):
    return {"id": i, "metric": metric, "estimate": estimate, "ci_low": estimate - half, "ci_high": estimate + half, "year": year, "quality": quality, "trial_count": len(trials), "trials": list(trials)}


def test_overlapping_reviews_count_once(spark):
    cases = {
        1: [source("a", 0.5, 0.1, range(69)), source("b", 0.3, 0.1, range(23), quality=5), source("c", 0.4, 0.2, range(100, 110))],
        2: [source("a", 0.5, 0.1, range(10), quality=2), source("b", 0.3, 0.1, range(20, 30), quality=3)],
        3: [source("a", 0.9, 0.1, range(10)), source("b", 0.1, 0.1, range(20, 30)), source("z", 2.0, 0.1, [1], metric="rr")],
        4: [source("a", 0.5, 0.1, range(10), year=2019), source("b", 0.7, 0.1, range(10), year=2021)],
    }
    rows = [{"outcome": k, **s} for k, ss in cases.items() for s in ss]
    schema = "outcome int, id string, metric string, estimate double, ci_low double, ci_high double, year int, quality int, trial_count int, trials array<int>"
    got = {r["outcome"]: r for r in overlap.combined_effects(spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema), "outcome").collect()}
    assert got[1]["used"] == ["a", "c"] and got[1]["dropped"] == ["b<a"] and got[1]["estimate"] == pytest.approx((0.5 * 4 + 0.4) / 5)
    assert got[2]["used"] == ["b"] and got[2]["excluded"] == ["a", "b"]
    assert got[3]["disagreement"] and got[3]["estimate"] == 0.5 and got[3]["ci_low"] == pytest.approx(0.1) and got[3]["ci_low_narrow"] > 0.4
    assert got[4]["used"] == ["b"] and got[4]["dropped"] == ["a<b"] and not got[4]["disagreement"]
    assert overlap.overlap(set(), {1}) == 0.0
