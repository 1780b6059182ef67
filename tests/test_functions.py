"""Scalar rules against worked cases."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from veritally.functions import identity, scoring, statistics


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("effect", "unit", "sd", "s", "route"),
    [
        (None, "d", None, None, "no_effect_size"),
        (float("inf"), "d", None, None, "unparseable_effect_size"),
        (0.5, "", None, None, "no_unit"),
        (1.2, "odds ratio (%)", None, None, "ratio_null_is_one"),
        (5.0, "% change from baseline", None, None, "within_group_not_between_arm"),
        (5.0, "percentage points", None, None, "absolute_percentage_difference"),
        (5.0, "%", None, 0.5, "percent"),
        (0.5, "Cohen d", None, 0.5, "smd"),
        (-9.0, "SMD", None, -1.0, "smd"),
        (4.0, "kg", 8.0, 0.5, "smd_from_sd"),
        (4.0, "kg", 0.0, None, "raw_unit_needs_sd"),
    ],
)
def test_standardise(spark, effect, unit, sd, s, route):
    got = value(spark, scoring.standardise_effect(F.lit(effect).cast("double"), F.lit(unit), F.lit(sd).cast("double")))
    assert got["route"] == route and (got["s"] is None if s is None else got["s"] == pytest.approx(s))


def test_rob_band(spark):
    for items, want in (([1, 1, 1, 1, 0], "low"), ([1], "some_concerns"), ([1, 0], "some_concerns"), ([0, 0, 1], "high"), ([None, None], "high")):
        assert value(spark, scoring.rob_band(F.array(*(F.lit(i).cast("int") for i in items)))) == want


def test_dose(spark):
    def factor(low, high):
        return value(spark, scoring.dose_factor(*(F.lit(x).cast("double") for x in (low, high, 100, 200))))

    assert [factor(d, d) for d in (50, 75, 100, 200, 300, 400, 900)] == [0.1, 0.55, 1.0, 1.0, 0.8, 0.6, 0.6]
    assert factor(75, 150) == 0.55 and factor(None, 150) is None
    tiers = [value(spark, scoring.dose_tier(*(F.lit(x).cast("double") for x in (a, b, 100, 200)))) for a, b in ((40, 40), (60, 60), (300, 300), (500, 500), (40, 150))]
    assert tiers == ["below_50", "low_50_99", "in_band", "above_200", "unspecified"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("NCT01234567 (main paper)", "nct01234567"), ("see isrctn123456.", "isrctn123456"), ("ChiCTR", None), ("", None), (None, None), ("EudraCT 2009-123456-22", "eudract200912345622")],
)
def test_registry(spark, text, want):
    assert value(spark, identity.registry_id(F.lit(text).cast("string"))) == want


def test_fold(spark):
    assert value(spark, identity.key_text(F.lit("Müller-Ångström ﬁ"))) == "mullerangstromfi"
    for text in ("plain", "", "Ａ１ ½ ™ Ǆ ﷺ ｶ", "e\u0301 ß ı İ Ł ø 漢 \U0001d400", "x\u00a0y…№"):
        assert value(spark, identity.ascii_fold(F.lit(text))) == unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://www.Example.org:443/en/page/x/?utm_source=a&b=2&a=1&lang=de#top", "example.org/page/x?a=1&b=2"),
        ("http://example.org", "example.org/"),
        ("http://example.org/en/", "example.org/en"),
        ("http://example.org/pt-br/x", "example.org/x"),
        ("http://example.org/ab/x", "example.org/ab/x"),
        ("http://example.org:8080/", "example.org:8080/"),
        ("ftp://example.org/x", None),
        ("http://exämple.org/x", None),
        (None, None),
    ],
)
def test_address(spark, url, want):
    assert value(spark, identity.address_key(F.lit(url).cast("string"))) == want


def test_address_ids(spark):
    def ids(url):
        return value(spark, identity.address_ids(F.lit(url)))

    assert ids("https://example.org/content/10.1234%2FAb.5/full?x=1") == ["doi:10.1234/ab.5", "doi:10.1234/ab.5/full"]
    assert ids("https://pubmed.ncbi.nlm.nih.gov/12345678/") == ["pmid:12345678"]
    assert ids("https://x.org/nct01234567?id=pmc123456") == ["NCT01234567", "PMC123456"]
    assert ids("not an address 10.1234/x") == []


@pytest.mark.parametrize("steps", [1, 3, 200])
def test_most_null_share(spark, steps):
    """Halving the grid finds what walking it does, whether the ceiling falls or not."""
    targets = [float(t) / 2 for t in range(-80, 204)] + [float("nan")]
    rows = spark.createDataFrame([(t,) for t in targets], "target double")
    grid = spark.range(steps + 1).select((F.col("id") / steps).alias("p")).select("p", statistics.ceiling_score(F.col("p")).alias("c")).collect()
    want = {str(t): max((r["p"] for r in grid if r["c"] >= t), default=None) if max(r["c"] for r in grid if r["p"] == 0) >= t else None for t in targets}
    held = spark.range(1).select(statistics.null_share_grid(steps).alias("grid"))
    got = {str(r["target"]): r["most"] for r in rows.crossJoin(held).select("target", statistics.most_null_share(F.col("target"), F.col("grid"), steps).alias("most")).collect()}
    assert got == want
    assert len(held.first()["grid"]) == steps + 1
