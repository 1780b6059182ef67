"""Two-arm results in tables: which columns are which arm's, which rows tell an outcome, and why others are refused.

All of it is by article: what it has few of by nature (arms, aliases, terms, and the columns of one table) meets its tables
as lists, so that aliases and terms are joined once, by article, and a table is judged where it stands. Its rows and
their pairs of columns are rows of the data frame from there on, and none is met again or written. The sides of all joins
grow with the articles, so they are merges: files of repeated texts look small enough to broadcast, and are not once
they are read. Explodes are outer where an inner one would infer a filter on what it explodes, which is made twice then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.functions import harvest as rules
from veritally.functions.columns import once
from veritally.functions.markup import JOINT
from veritally.functions.texts import mean_sd
from veritally.operators.eligibility import first_reason

#: Most pairs of columns of one table.
PAIRS = 8

# Why the arms of a trial give no aliases.
NO_FREE_COMPARATOR = "S3 comparator is not explicitly ingredient_free"
NOT_ISOLATED = "S3 ingredient_isolated is not explicitly yes"
NO_ARMS = "S3 arms are absent"
UNKNOWN_CONTROL = "S3 has an arm with unknown control status"
NOT_ONE_CONTROL = "S3 does not have exactly one explicit control arm"
NO_OTHER_ARM = "S3 has no explicit non-control arm"
NO_TOKEN = "S3 multi-arm trial has no ingredient token"
NO_INGREDIENT_ARM = "S3 multi-arm trial has no ingredient-alone arm"
INGREDIENT_ARMS = "S3 multi-arm trial has multiple ingredient arms"
NO_LABELS = "S3 arm labels are not explicit"
SAME_LABELS = "S3 arm labels are not unique"
SHARED_PREFIX = "S3 arm words share a prefix; abbreviation is ambiguous"
CONTROL_HAS_TOKEN = "S3 control label contains the ingredient token"


def _listed(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` as one list of each ``key``, in order of their columns."""
    others = [c for c in rows.columns if c != key]
    return rows.repartition(key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*others))).alias(name))


def arm_pairs(trials: DataFrame, arms: DataFrame, key: str = "trial") -> DataFrame:
    """``trials`` with reason and label and text of ingredient and control: the two arms that a header may name.

    ``trials`` has comparator, isolated, ingredient; ``arms`` has place (their order), label, is_control and
    intervention_text; of arms with one label the first tells its text. The rules are in order; the first that holds is
    the reason, and then there are no labels. Two labels share a prefix when their first words, of two letters at least,
    begin with the same two.
    """
    listed = _listed(arms.select(key, "place", "label", "is_control", "intervention_text"), key, "_arms")
    rows = trials.join(listed.hint("merge"), key, "left").withColumn("_token", rules.first_word(F.col("ingredient")))
    all_arms = F.col("_arms")
    rows = rows.withColumn("_others", F.filter(all_arms, lambda a: ~a["is_control"]))
    rows = rows.withColumn("_hits", F.filter("_others", lambda a: rules.has_word(a["label"], F.col("_token"))))
    one = F.size("_others") == 1
    of = lambda arm: F.get(arm, F.lit(0))["label"]
    start = lambda label: F.lower(F.substring(F.regexp_extract(label, "^[A-Za-z]{2,}", 0), 1, 2))
    worded = F.array_distinct(F.filter(F.transform(all_arms, lambda a: a["label"]), lambda x: start(x) != ""))
    rows = rows.withColumns(
        {
            "_unknown": F.exists(all_arms, lambda a: a["is_control"].isNull()),
            "_controls": F.size(F.filter(all_arms, lambda a: a["is_control"])),
            "_control": of(F.filter(all_arms, lambda a: a["is_control"])),
            "_ingredient": F.when(one, of(F.col("_others"))).otherwise(of(F.col("_hits"))),
            "_blank": F.exists(all_arms, lambda a: F.trim(F.coalesce(a["label"], F.lit(""))) == ""),
            "_worded": worded,
        }
    )
    ingredient = F.col("_ingredient")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    known = F.when(F.col("_token") != "", F.col("_token")).otherwise(rules.first_word(ingredient))
    reason = first_reason(
        [
            (~F.col("comparator").eqNullSafe(F.lit("ingredient_free")), NO_FREE_COMPARATOR),
            (~F.col("isolated").eqNullSafe(F.lit("yes")), NOT_ISOLATED),
            (F.col("_arms").isNull(), NO_ARMS),
            (F.col("_unknown"), UNKNOWN_CONTROL),
            (F.col("_controls") != 1, NOT_ONE_CONTROL),
            (F.size("_others") == 0, NO_OTHER_ARM),
            (~one & (F.col("_token") == ""), NO_TOKEN),
            (~one & (F.size("_hits") == 0), NO_INGREDIENT_ARM),
            (~one & (F.size("_hits") > 1), INGREDIENT_ARMS),
            (blank(F.col("_control")) | blank(ingredient), NO_LABELS),
            (F.col("_control") == ingredient, SAME_LABELS),
            (F.col("_blank"), NO_LABELS),
            (F.size("_worded") > F.size(F.array_distinct(F.transform("_worded", start))), SHARED_PREFIX),
            (rules.has_word(F.col("_control"), known), CONTROL_HAS_TOKEN),
        ]
    )
    rows = rows.withColumn("reason", reason)
    only = lambda c: F.when(F.col("reason").isNull(), c)
    text = lambda label: F.array_min(F.transform(F.filter(all_arms, lambda a: a["label"] == label), lambda a: F.struct(a["place"], a["intervention_text"].alias("text"))))["text"]
    sides = [only(c).alias(f"{name}_{what}") for name, label in (("ingredient", ingredient), ("control", F.col("_control"))) for what, c in (("label", label), ("text", text(label)))]
    return rows.select(*trials.columns, "reason", *sides)


def alias_lists(pairs: DataFrame, key: str = "trial") -> DataFrame:
    """``key``, aliases (label, role, nth, alias): what a header may call the two arms of each of ``pairs`` (see
    :func:`arm_pairs`) without a reason; null with one."""
    side = lambda role: F.struct(F.col(f"{role}_label").alias("label"), F.lit(role).alias("role"), F.col(f"{role}_text").alias("text"))
    named = lambda s: F.transform(rules.label_aliases(s["label"], s["text"]), lambda a, i: F.struct(s["label"].alias("label"), s["role"].alias("role"), i.alias("nth"), a.alias("alias")))
    sides = F.when(F.col("reason").isNull(), F.array(side("ingredient"), side("control")))
    return pairs.select(key, F.flatten(F.transform(sides, named)).alias("aliases"))


def arm_aliases(pairs: DataFrame, arms: DataFrame | None = None, key: str = "trial") -> DataFrame:
    """``key``, label, role, nth, alias: the rows of :func:`alias_lists`. ``arms`` is not read: pairs bring their texts."""
    return alias_lists(pairs, key).select(key, F.explode_outer("aliases").alias("a")).where("a is not null").select(key, "a.*")


def keyed_aliases(aliases: Column) -> Column:
    """A list of aliases (label, nth, alias) as tables are asked for them (see :func:`harvested`); null without two labels."""
    keyed = F.transform(aliases, lambda a: F.struct(a["label"].alias("label"), a["nth"].alias("nth"), a["alias"].alias("alias"), rules.padded(rules.term_key(a["alias"])).alias("key")))
    return F.when(F.size(F.array_distinct(F.transform(aliases, lambda a: a["label"]))) >= 2, F.filter(keyed, lambda a: F.trim(a["key"]) != ""))


def named_terms(terms: Column) -> Column:
    """A list of terms as tables are asked for them, without blank ones; null without one."""
    return once(F.filter(terms, lambda t: F.trim(t) != ""), lambda named: F.when(F.size(named) > 0, named))


def _arm_columns(columns: Column, aliases: Column) -> Column:
    """Of the headers that name an arm: column, header, labels, label, qualifier.

    ``labels`` is how many arms' aliases stand in the header; with more than one it is ambiguous. ``qualifier`` is what
    the header's parts say beside the alias, null without.
    """

    def met(h: Column) -> Column:
        labels = F.array_distinct(F.transform(h["hits"], lambda a: a["label"]))
        by = F.array_min(F.transform(h["hits"], lambda a: F.struct(a["nth"], a["alias"], a["key"])))["key"]
        parts = lambda key: F.filter(F.transform(F.split(h["header"], JOINT, -1), F.trim), lambda p: (p != "") & ~F.contains(rules.padded(rules.term_key(p)), key))
        qualifier = once(by, lambda key: F.nullif(F.array_join(parts(key), JOINT), F.lit("")))
        return F.struct(h["column"].alias("column"), h["header"].alias("header"), F.size(labels).alias("labels"), F.array_min(labels).alias("label"), qualifier.alias("qualifier"))

    def hits(header: Column) -> Column:
        return once(rules.padded(rules.term_key(header)), lambda key: F.filter(aliases, lambda a: F.contains(key, a["key"])))

    seen = F.transform(F.coalesce(columns, F.array()), lambda c, i: F.struct(i.alias("column"), c.alias("header"), hits(c).alias("hits")))
    return F.transform(F.filter(seen, lambda h: F.size(h["hits"]) > 0), met)


def _column_pairs(columns: Column) -> Column:
    """The pairs of columns of two arms: of two columns these, of more those with one qualifier."""
    two = F.size(columns) == 2
    a, first = F.array_min(F.transform(columns, lambda c: c["label"])), F.array_min(F.transform(columns, lambda c: c["column"]))
    sided = F.transform(columns, lambda c: F.struct(c["column"].alias("column"), c["header"].alias("header"), c["label"].alias("label"), F.when(two, F.lit("")).otherwise(c["qualifier"]).alias("by"), F.when(two, c["column"] == first).otherwise(c["label"] == a).alias("left")))
    named = lambda x, s: [x[c].alias(f"{c}_{s}") for c in ("column", "header", "label")]
    of = lambda x, all_: F.transform(F.filter(all_, lambda y: ~y["left"] & (y["by"] == x["by"])), lambda y: F.struct(*named(x, "a"), *named(y, "b")))
    return once(sided, lambda all_: F.flatten(F.transform(F.filter(all_, lambda x: x["left"]), lambda x: of(x, all_))))


def harvest(tables: DataFrame, aliases: DataFrame, terms: DataFrame, key: str = "trial") -> DataFrame:
    """What :func:`harvested` finds in ``tables`` (``key``, table, caption, columns, rows, notes) with ``aliases`` (see
    :func:`arm_aliases`) and ``terms`` (``key``, term), which are brought to their tables."""
    listed = _listed(aliases.select(key, "label", "nth", "alias"), key, "aliases").select(key, keyed_aliases(F.col("aliases")).alias("aliases"))
    named = _listed(terms.select(key, "term"), key, "terms").select(key, named_terms(F.transform("terms", lambda t: t["term"])).alias("terms"))
    return harvested(tables.join(listed.hint("merge"), key).join(named.hint("merge"), key).where("aliases is not null and terms is not null"), key)


def harvested(tables: DataFrame, key: str = "trial") -> DataFrame:
    """The candidates for a two-arm result in ``tables``, and the reason of each table, row or pair that is none.

    ``tables``: ``key``, table, caption, columns, rows, notes, and the lists of what their article calls its arms and its
    outcomes, aliases (see :func:`keyed_aliases`) and terms (see :func:`named_terms`), neither null. One row for each refused table
    (reason), each refused row of the others (row, reason), and each pair of columns of a row that tells an outcome
    (column_a, column_b, with a reason or the values of both).

    A table needs exactly two arms in its headers, each header one at most. Where an arm has several columns, those with
    one qualifier go together. A table that speaks of standard errors or intervals is refused as a whole, as are rows
    that tell a visit or a change; of the terms that fit a row's first cell the longest must be one. Cells are mean ± SD,
    or mean (SD) where the table says so. Articles without two arms or without a term have no row.
    """
    asked = tables.withColumn("_columns", _arm_columns(F.col("columns"), F.col("aliases")))
    columns = F.col("_columns")
    distinct = lambda f: F.size(F.array_distinct(F.transform(columns, f)))
    asked = asked.withColumns(
        {
            "_ambiguous": F.exists(columns, lambda c: c["labels"] > 1),
            "_labels": distinct(lambda c: c["label"]),
            "_matched": F.size(columns),
            "_bare": F.exists(columns, lambda c: c["qualifier"].isNull()),
            "_kinds": distinct(lambda c: F.struct(c["label"], F.coalesce(c["qualifier"], F.lit("")))),
        }
    )
    many = F.col("_matched") > 2
    single = ~many | (~F.col("_bare") & (F.col("_kinds") == F.col("_matched")))
    asked = asked.withColumn("_pairs", F.when(~F.col("_ambiguous") & (F.col("_labels") == 2) & single, _column_pairs(columns)))
    texts = rules.all_texts({c: F.col(c) for c in ("caption", "notes", "columns", "rows")})
    of_table = first_reason(
        [
            (F.col("_ambiguous"), "ambiguous_header"),
            (F.col("_labels") != 2, "not_two_arms"),
            (many & F.col("_bare"), "repeated_arm_without_qualifier"),
            (many & (F.col("_kinds") < F.col("_matched")), "repeated_qualifier"),
            (F.size("_pairs") == 0, "no_shared_qualifier"),
            (F.size("_pairs") > PAIRS, "too_many_pairs"),
            (rules.tells_error(texts), "error_or_interval"),
        ]
    )
    at, here = [key, "table"], [key, "table", "row"]
    judged = asked.withColumn("_of_table", of_table)
    good = F.col("_of_table").isNull()
    declared = F.when(good, rules.any_matches(F.concat(F.array("caption"), F.col("notes"), F.col("columns")), rules.SD_DECLARED))
    keyed = F.when(good, F.transform("terms", rules.keyed_term)).alias("_terms")
    judged = judged.select(*at, "_of_table", keyed, "_pairs", declared.alias("_declared"), F.when(good, F.col("rows")).alias("_rows"))
    rows = judged.select(*at, "_of_table", "_terms", "_pairs", "_declared", F.posexplode_outer("_rows").alias("row", "cells")).where("_of_table is not null or row is not null")

    line = F.array_join("cells", " | ")
    rows = rows.withColumn("_visit", once(line, lambda x: x.rlike(rules.ENDPOINT) | x.rlike(rules.TIMEPOINT)))
    longest = lambda fits: F.filter(fits, lambda t: F.length(t["key"]) == F.array_max(F.transform(fits, lambda x: F.length(x["key"]))))
    rows = rows.withColumn("_best", F.when(F.col("row").isNotNull() & ~F.col("_visit"), once(rules.terms_fit(F.get("cells", F.lit(0)), F.col("_terms")), longest)))
    of_row = first_reason([(F.col("_visit"), "endpoint_or_timepoint"), (F.coalesce(F.size("_best"), F.lit(0)) == 0, "no_outcome_term"), (F.size("_best") > 1, "tied_outcome_terms")])
    rows = rows.withColumn("_of_row", F.when(F.col("row").isNotNull(), of_row))
    pairs = F.when(F.col("row").isNotNull() & F.col("_of_row").isNull(), F.col("_pairs"))
    found = rows.select(*here, "cells", "_declared", F.coalesce("_of_table", "_of_row").alias("_refused"), F.get("_best", F.lit(0))["term"].alias("_term"), pairs.alias("_pairs"))
    found = found.select(*here, "cells", "_declared", "_refused", "_term", F.explode_outer("_pairs").alias("_pair"))
    told = F.col("_pair").isNotNull()
    found = found.select(*here, "cells", "_declared", "_refused", F.when(told, F.col("_term")).alias("term"), "_pair.*")
    for s in ("a", "b"):
        cell = F.coalesce(F.get("cells", F.col(f"column_{s}")), F.lit(""))
        found = found.withColumns({f"_value_{s}": mean_sd(cell, F.col("_declared")), f"_head_{s}": rules.sample_size(F.col(f"header_{s}")), f"_cell_{s}": rules.sample_size(cell)})
    wrong = lambda n: n["said"] & F.coalesce(n["n"] <= 0, F.lit(True))
    checks = []
    for s in ("a", "b"):
        head, cell = F.col(f"_head_{s}"), F.col(f"_cell_{s}")
        checks += [(F.col(f"_value_{s}").isNull(), "no_mean_and_sd"), (wrong(head) | wrong(cell), "bad_sample_size"), (head["n"] != cell["n"], "two_sample_sizes")]
    found = found.withColumn("reason", F.coalesce(F.col("_refused"), first_reason(checks)))
    only = lambda c: F.when(F.col("reason").isNull(), c)
    values = [only(x).alias(f"{n}_{s}") for s in ("a", "b") for n, x in (("mean", F.col(f"_value_{s}.mean")), ("sd", F.col(f"_value_{s}.sd")), ("n", F.coalesce(F.col(f"_head_{s}.n"), F.col(f"_cell_{s}.n"))))]
    return found.select(*here, "term", "column_a", "label_a", "column_b", "label_b", *values, "reason")
