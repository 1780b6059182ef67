"""Markup, serialised tables and the harvest of two-arm results on odd input."""

import json
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veritally.functions import harvest as rules
from veritally.functions import markup
from veritally.functions.serialised import serialised_tables
from veritally.functions.texts import mean_sd
from veritally.operators import harvest


def told(spark, values, column, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("x"))).collect()]


def test_filled():
    """Spans across and down, cells after and beside them, a line of spans alone, a span to the end."""
    assert markup.filled([[("a", 1, 2), ("b", 2, 1)], [("c", 1, 1), ("d", 1, 1)]]) == [["a", "b", "b"], ["a", "c", "d"]]
    assert markup.filled([[("a", 2, 3)], [], [("b", 1, 1)]]) == [["a", "a"], ["a", "a"], ["a", "a", "b"]]
    assert markup.filled([[("a", 1, 1), ("b", 1, 9)], [("c", 1, 1)]]) == [["a", "b"], ["c", "b"]]
    assert markup.filled([[], [("a", 1, 1)]]) == [["a"]] and markup.filled([]) == []


def test_articles(spark):
    table = '<table-wrap><label>T1</label><table><tr><td colspan="0">x<sup>2</sup> &lt; y</td><th rowspan="-3">z</th></tr><tr><td>1</td></tr></table></table-wrap>'
    xml = f"<a><sec><title>2.1 Methods</title>m</sec><sec>none</sec>{table}<table-wrap/><ack> </ack><conflict>no  one</conflict></a>"
    whole, bad, none, empty = told(spark, [xml, xml[:-1], None, ""], markup.article)
    assert bad is none is empty is None
    assert [tuple(s) for s in whole["sections"]] == [("2.1 Methods", "2.1 Methodsm")] and whole["funding"] == ["no one"]
    assert len(whole["tables"]) == 1 and whole["tables"][0]["flat"] == [["x2 < y", "z"], ["1"]]
    parsed = spark.createDataFrame([(xml,)], "x string").select(markup.article("x").alias("a"))
    grid, sections = parsed.select(markup.structured(F.col("a.tables")[0]), markup.section_texts(F.col("a"))).first()
    assert grid["columns"] == ["x2 < y", "z"] and grid["rows"] == [["1", ""]]
    assert sections == {"methods": "2.1 Methodsm", "funding": "no one"}


def test_serialised_tables(spark):
    cases = [
        (None, []),
        ("", []),
        ("{broken", []),
        ("a|b\n1|2", [("", ["a", "b"], [["1", "2"]], [])]),
        ("top\nlast\n|a|b|\n|--|--|\n|1|2|\n|3|\nn", [("top", ["a", "b"], [["--", "--"], ["1", "2"], ["3", ""]], ["last", "n"])]),
        ("|a|b|\n|:---:|---|", []),
        ("x\ty\n1\t2\t3\n4", [("", ["x", "y"], [["1", "2"], ["4", ""]], [])]),
        (json.dumps({"rows": [{"b": 1, "a": None}, {"a": True}], "note": {"p": "q", "r": {}}}), [("", ["b", "a"], [["1", ""], ["", "True"]], ["p: q", "r: {}"])]),
        (json.dumps({"rows": [[1, 2.5], 7]}), [("", ["column_1", "column_2"], [["1", "2.5"], ["7", ""]], [])]),
        (json.dumps({"rows": []}), []),
        (json.dumps({"title": "t", "text": "a\tb\n1\t2", "source": "s"}), [("t", ["a", "b"], [["1", "2"]], ["s"])]),
        (json.dumps({"tables": [{"header": ["h"], "rows": [["1"]]}, 5, {"caption": "own", "header": ["h"], "rows": [["2"]]}], "caption": "w"}), [("w", ["h"], [["1"]], ["w"]), ("own", ["h"], [["2"]], ["w"])]),
        (json.dumps({"caption": "o", "table": {"caption": "i", "headers": ["h"], "rows": [["1"]]}}), [("o", ["h"], [["1"]], ["i"])]),
        ("[" * 100_000, []),
    ]
    got = told(spark, [c[0] for c in cases], serialised_tables)
    assert [[tuple(t) for t in g] for g in got] == [c[1] for c in cases]


def test_cells(spark):
    cells = ["1.5 ± 0.2", "1,5 +/- 0,2 kg (n=4)", "1,234 ± 2", "3 (0.5)", "3 (0.5)*", "3 ± 0", "mean = -2 ± SD = 1", "3", ""]
    want = [(1.5, 0.2), (1.5, 0.2), None, None, None, None, (-2.0, 1.0), None, None]
    assert [x and tuple(x) for x in told(spark, cells, mean_sd)] == want
    want[3] = want[4] = (3.0, 0.5)
    assert [x and tuple(x) for x in told(spark, cells, lambda c: mean_sd(c, F.lit(True)))] == want
    sizes = ["n=20", "N = 7 and n=8", "n = 1,234", "n=1 234", "age=44", "n=-3", "n=x", "in=5"]
    assert [tuple(x) for x in told(spark, sizes, rules.sample_size)] == [(True, 20), (True, 7), (True, None), (True, None), (False, None), (True, -3), (True, None), (False, None)]
    errors = ["mean ± SE", "S.E.M.s", "95% CIs", "Std. Error", "confidence-intervals", "standard deviation", "SD", "season", "mean (SD)"]
    assert told(spark, errors, lambda x: x.rlike(rules.ERROR_OR_INTERVAL)) == [True] * 5 + [False] * 4
    fits = [("Handgrip strength", "Handgrip strength (kg)", True), ("Body mass", "Lean body mass", False), ("Lean body-mass, n=3", "body mass", True), ("", "x", False), ("x", "", False)]
    rows = spark.createDataFrame(fits, "a string, b string, want boolean")
    assert rows.where(rules.term_fits(F.col("a"), F.col("b")) != F.col("want")).count() == 0


ARMS = {"Creatine": "ingredient", "Placebo": "control"}


def harvested(spark, tables, terms=("Strength",), arms=ARMS):
    rows = [(i, 0, t.get("caption", ""), t["columns"], t["rows"], t.get("notes", [])) for i, t in enumerate(tables)]
    tables = spark.createDataFrame(rows, "trial int, table int, caption string, columns array<string>, rows array<array<string>>, notes array<string>")
    aliases = spark.createDataFrame([(i, a, r, 0, a) for i in range(len(rows)) for a, r in arms.items()], "trial int, label string, role string, nth int, alias string")
    named = spark.createDataFrame([(i, t) for i in range(len(rows)) for t in terms], "trial int, term string")
    return harvest.harvest(tables, aliases, named)


def test_harvest(spark):
    two = ["Outcome", "Creatine (n=20)", "Placebo (n=19)"]
    row = ["Strength", "10.2 ± 2.1", "8.1 ± 2.0"]
    visits = ["", "Creatine — Pre", "Creatine — Post", "Placebo — Pre", "Placebo — Post"]
    tables = [
        {"columns": two, "rows": [row]},
        {"columns": ["Outcome", "Placebo", "Creatine"], "rows": [["Strength", "1 ± 1", "2 ± 1 (n=0)"], ["Power", "1 ± 1", "2 ± 1"], ["Strength at week 4", "1 ± 1", "2 ± 1"]]},
        {"columns": visits, "rows": [["Strength", "1 ± 1", "2 ± 1", "3 ± 1", "x"]]},
        {"columns": ["o", "Creatine or placebo", "Placebo"], "rows": [row]},
        {"columns": ["o", "Creatine", "Other"], "rows": [row]},
        {"columns": ["o", "Creatine", "Creatine — a", "Placebo"], "rows": [row]},
        {"columns": ["o", "Creatine — a", "Creatine — a", "Placebo — a"], "rows": [row]},
        {"columns": ["o", "Creatine — a", "Creatine — b", "Placebo — c"], "rows": [row]},
        {"columns": two, "rows": [row], "notes": ["± is the standard error"]},
        {"columns": two, "rows": [["Strength", "10 (2)", "8 (1)"]], "caption": "Mean (SD)"},
        {"columns": two, "rows": [["Strength", "10 (2)", "8 (1)"], ["Strength", "1 ± 1 (n=3)", "1 ± 1"]]},
    ]
    got = Counter((r["trial"], r["row"], r["column_a"], r["column_b"], r["mean_a"], r["sd_b"], r["n_a"], r["reason"]) for r in harvested(spark, tables).collect())
    assert got == Counter(
        [
            (0, 0, 1, 2, 10.2, 2.0, 20, None),
            (1, 0, 1, 2, None, None, None, "bad_sample_size"),
            (1, 1, None, None, None, None, None, "no_outcome_term"),
            (1, 2, None, None, None, None, None, "endpoint_or_timepoint"),
            (2, 0, 1, 3, 1.0, 1.0, None, None),
            (2, 0, 2, 4, None, None, None, "no_mean_and_sd"),
            (3, None, None, None, None, None, None, "ambiguous_header"),
            (4, None, None, None, None, None, None, "not_two_arms"),
            (5, None, None, None, None, None, None, "repeated_arm_without_qualifier"),
            (6, None, None, None, None, None, None, "repeated_qualifier"),
            (7, None, None, None, None, None, None, "no_shared_qualifier"),
            (8, None, None, None, None, None, None, "error_or_interval"),
            (9, 0, 1, 2, 10.0, 1.0, 20, None),
            (10, 0, 1, 2, None, None, None, "no_mean_and_sd"),
            (10, 1, 1, 2, None, None, None, "two_sample_sizes"),
        ]
    )
    assert harvested(spark, tables, terms=(" ",)).count() == 0 and harvested(spark, tables, arms={"Creatine": "ingredient"}).count() == 0
    assert {r["reason"] for r in harvested(spark, tables[:1], terms=("strength", "STRENGTH")).collect()} == {"tied_outcome_terms"}


@pytest.mark.parametrize(
    ("facts", "arms", "want"),
    [
        (("active", "yes", "creatine"), [], harvest.NO_FREE_COMPARATOR),
        (("ingredient_free", None, "creatine"), [], harvest.NOT_ISOLATED),
        (("ingredient_free", "yes", "creatine"), [], harvest.NO_ARMS),
        (("ingredient_free", "yes", None), [("A", None), ("B", True)], harvest.UNKNOWN_CONTROL),
        (("ingredient_free", "yes", None), [("A", True), ("B", True)], harvest.NOT_ONE_CONTROL),
        (("ingredient_free", "yes", None), [("A", True)], harvest.NO_OTHER_ARM),
        (("ingredient_free", "yes", ""), [("A", False), ("C", False), ("B", True)], harvest.NO_TOKEN),
        (("ingredient_free", "yes", "zinc"), [("A", False), ("C", False), ("B", True)], harvest.NO_INGREDIENT_ARM),
        (("ingredient_free", "yes", "zinc"), [("zinc", False), ("Zinc + C", False), ("B", True)], harvest.INGREDIENT_ARMS),
        (("ingredient_free", "yes", "zinc"), [(" ", False), ("B", True)], harvest.NO_LABELS),
        (("ingredient_free", "yes", "zinc"), [("B", False), ("B", True)], harvest.SAME_LABELS),
        (("ingredient_free", "yes", "zinc"), [("Placed", False), ("Placebo", True)], harvest.SHARED_PREFIX),
        (("ingredient_free", "yes", "zinc"), [("Zinc", False), ("Placebo zinc-free", True)], harvest.CONTROL_HAS_TOKEN),
        (("ingredient_free", "yes", "zinc"), [("Zinc (n=3) 5 mg/day", False), ("Other", False), ("Placebo", True)], None),
    ],
)
def test_arm_pairs(spark, facts, arms, want):
    trials = spark.createDataFrame([(1, *facts)], "trial int, comparator string, isolated string, ingredient string")
    rows = spark.createDataFrame([(1, i, label, control, None) for i, (label, control) in enumerate(arms)], "trial int, place int, label string, is_control boolean, intervention_text string")
    pairs = harvest.arm_pairs(trials, rows)
    assert pairs.first()["reason"] == want
    aliases = [r["alias"] for r in harvest.arm_aliases(pairs, rows).where("role = 'ingredient'").orderBy("nth").collect()]
    assert aliases == ([] if want else ["Zinc (n=3) 5 mg/day", "Zinc 5 mg/day", "Zinc", "Zi", "Zin"])


def test_articles_are_parsed_once(spark):
    """A malformed article has no sections, without a filter that would parse all articles a second time."""
    from veritally.plans import articles

    rows = articles.article_sections(spark, "/root/testdata/sf0.001")
    assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    none = spark.createDataFrame([("<a",), (None,)], "x string").select(markup.article("x").alias("a"))
    assert none.select(F.explode(markup.section_texts(F.col("a")))).count() == 0


def test_tables_are_read_once(spark):
    """Each parse of an article or of a serialised table occurs once in a plan: an inner explode doubled both."""
    from veritally.plans import articles

    parses = lambda rows: rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")
    assert parses(articles.article_tables(spark, "/root/testdata/sf0.001")) == 1
    assert parses(articles.serialised_grids(spark, "/root/testdata/sf0.001")) == 2


def test_harvest_meets_its_tables_once(spark):
    """Lines, and what else an article has, are shuffled once each, by article; articles are parsed once, and nothing is written."""
    from veritally.plans import articles
    from veritally.shared import shared_dir

    here = lambda: set(Path(shared_dir(spark)).glob("*"))
    before = here()
    plan = articles.harvested(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Exchange hashpartitioning") <= 5 and "Broadcast" not in plan
    assert here() == before


def test_harvest_of_odd_lists(spark):
    """Keys of texts that end a line, columns or rows that are null, arms told by aliases without a word, cells that are null."""
    ends = ["Creatine\n", "n=3", "\n", "a b\n", "Ärm\n", "x−y"]
    assert told(spark, ends, rules.term_key) == ["creatine", "", "", "a b", "ärm", "x y"]
    tables = [{"columns": None, "rows": [["Strength"]]}, {"columns": ["o", "Creatine\n", "Placebo"], "rows": None}, {"columns": ["o", "Creatine\n", "Placebo"], "rows": [None, [None, "1 ± 1", "2 ± 1"], ["Strength", "1 ± 1"]]}]
    got = Counter((r["trial"], r["row"], r["term"], r["mean_a"], r["reason"]) for r in harvested(spark, tables).collect())
    assert got == Counter([(0, None, None, None, "not_two_arms"), (2, 0, None, None, "no_outcome_term"), (2, 1, None, None, "no_outcome_term"), (2, 2, "Strength", None, "no_mean_and_sd")])
    assert {r["reason"] for r in harvested(spark, [{"columns": ["Creatine", "--"], "rows": [["Strength"]]}], arms={"Creatine": "ingredient", "--": "control"}).collect()} == {"not_two_arms"}


def test_texts_of_arms_with_one_label(spark):
    """Of arms with one label the first tells its text, whatever its role."""
    trials = spark.createDataFrame([(1, "ingredient_free", "yes", "zinc"), (2, "ingredient_free", "yes", "zinc")], "trial int, comparator string, isolated string, ingredient string")
    arms = [(1, 3, "Placebo", True, "late"), (1, 2, "Zinc", False, "some"), (1, 1, "Zinc", False, "first"), (2, 1, "Zinc", False, None), (2, 2, "B", True, " ")]
    rows = spark.createDataFrame(arms, "trial int, place int, label string, is_control boolean, intervention_text string")
    pairs = harvest.arm_pairs(trials, rows)
    assert {(r["trial"], r["reason"]) for r in pairs.collect()} == {(1, harvest.INGREDIENT_ARMS), (2, None)}
    one = harvest.arm_aliases(harvest.arm_pairs(trials, rows.where("place <> 2 or trial = 2")))
    assert [r["alias"] for r in one.where("trial = 1 and role = 'ingredient'").orderBy("nth").collect()] == ["Zinc", "first", "Zi", "Zin"]
    assert [r["alias"] for r in one.where("trial = 2").orderBy("role", "nth").collect()] == ["B", "Zinc", "Zi", "Zin"]


def test_tables_alone(spark):
    """The tables alone are those of the whole parse but for their cells as they stand; malformed articles have none."""
    table = '<table-wrap><label>T1</label><caption>c <b>d</b></caption><table><thead><tr><th rowspan="2" colspan="2">a<sup>2</sup></th><th/></tr><tr><td>n</td></tr></thead><tr/><tr><td colspan="x"> 1 </td><td>2</td></tr></table></table-wrap>'
    inner = "<table-wrap><tr><td>o<table-wrap><tr><td>i</td></tr></table-wrap></td></tr></table-wrap>"
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([f"<a>{table}{inner}<table-wrap/></a>", f"<a>{table}", "<a/>", "", None])], "i int, x string")
    whole, alone = rows.select("i", markup.article("x")["tables"].alias("t")).orderBy("i").collect(), rows.select("i", markup.tables("x").alias("t")).orderBy("i").collect()
    fields = lambda r: r["t"] and [(t["label"], t["caption"], t["head"], t["body"]) for t in r["t"]]
    assert [fields(r) for r in alone] == [fields(r) for r in whole] and [r["t"] for r in alone[1:]] == [None, [], None, None]
    assert [t["body"] for t in alone[0]["t"]] == [[["1", "2"]], [["oi"], ["i"]], [["i"]]] and alone[0]["t"][0]["head"] == [["a2", "a2", ""], ["a2", "a2", "n"]]
