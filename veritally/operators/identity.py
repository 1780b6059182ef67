"""Records to trials: one record of each canonical key, the union of tags, known identities, snapshot upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filled(columns: list[str]) -> Column:
    """How many of the columns are neither null nor empty."""
    return reduce(lambda a, b: a + b, (F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", 1).otherwise(0) for c in columns))


def dedup_records(records: DataFrame, key: str, seq: str, fields: list[str]) -> DataFrame:
    """One row of each ``key``: the record with most of ``fields`` filled, the first by ``seq`` on ties; ``n_merged``.

    An aggregate with a total order, so records meet in partial aggregates and a key of any size is no hot spot. Which records
    were merged is the input itself, by ``key``: no group is gathered into a list.
    """
    rest = [c for c in records.columns if c not in (key, seq)]
    first = F.min_by(F.struct(seq, *rest), F.struct(-filled(fields), F.col(seq)))
    merged = records.groupBy(key).agg(first.alias("best"), F.count("*").alias("n_merged"))
    return merged.select(key, "best.*", "n_merged")


def tag_union(records: DataFrame, key: str, tag: str) -> DataFrame:
    """The distinct tags of each key, sorted and joined by commas; tags come from a small vocabulary."""
    tags = F.collect_set(F.nullif(tag, F.lit("")))
    return records.groupBy(key).agg(F.array_join(F.array_sort(tags), ",").alias("tags"))


def known_identities(studies: DataFrame, trial: str, keys: dict[str, Column], ambiguous: tuple[str, ...] = ()) -> DataFrame:
    """kind, value, trial: which trial each identifier names; kinds in ``ambiguous`` that name two trials name none.

    Of other kinds that name two, the smallest trial is meant.
    """
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in keys.items()))
    each = studies.select(F.col(trial).alias("trial"), F.inline(pairs)).where("value is not null and value <> ''")
    found = each.groupBy("kind", "value").agg(F.min("trial").alias("trial"), F.max("trial").alias("_last"))
    return found.where((F.col("trial") == F.col("_last")) | ~F.col("kind").isin(*ambiguous)).drop("_last")


def resolve(entries: DataFrame, known: DataFrame, keys: dict[str, Column], seq: str) -> DataFrame:
    """``entries`` with trial and by: the trial of the first of ``keys``, in their order, that is known; else null.

    One shuffled join over all keys of an entry, then the best by rank, instead of a join for each key.
    """
    ranked = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(k).alias("kind"), v.alias("value")) for i, (k, v) in enumerate(keys.items())))
    each = entries.select(seq, F.inline(ranked)).where("value is not null and value <> ''")
    best = each.join(known, ["kind", "value"]).groupBy(seq).agg(F.min(F.struct("rank", "kind", "trial")).alias("_best"))
    return entries.join(best, seq, "left").withColumns({"trial": F.col("_best.trial"), "by": F.col("_best.kind")}).drop("_best")


def upsert(base: DataFrame, new: DataFrame, key: str, overwrite: list[str] = [], fill: list[str] = []) -> DataFrame:  # noqa: B006
    """The next snapshot: new keys added; of known ones ``overwrite`` is replaced, ``fill`` where new has a value, and
    all else keeps its first value. Rows of ``new`` without a key are refused, as they name nothing."""
    old, fresh = base.alias("old"), new.where(F.col(key).isNotNull()).alias("new")
    there, comes = F.col(f"old.{key}").isNotNull(), F.col(f"new.{key}").isNotNull()
    out = [F.coalesce(f"old.{key}", f"new.{key}").alias(key)]
    for c in base.columns:
        if c == key:
            continue
        was, now = F.col(f"old.{c}"), F.col(f"new.{c}")
        value = F.when(comes, now).otherwise(was) if c in overwrite else F.coalesce(now, was) if c in fill else F.when(there, was).otherwise(now)
        out.append(value.alias(c))
    return old.join(fresh, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer").select(*out)


# Publication types and subject headings that settle a design, in the order of the rules.
OPINIONS = ("editorial", "comment", "letter", "news", "newspaper article", "published erratum", "retraction of publication")


def design_rule(title: Column, pub_types: Column, mesh: Column) -> Column:
    """struct(rank, basis): the design by the first rule that fits; rank is null where no tag settles it.

    Subjects that aren't human come before any design; a bare "Clinical Trial" doesn't say how it allocated.
    """
    types, terms = (F.transform(F.coalesce(a, F.array().cast("array<string>")), F.lower) for a in (pub_types, mesh))
    title = F.lower(F.coalesce(title, F.lit("")))

    def has(values: Column, *words: str) -> Column:
        return F.exists(values, lambda v: reduce(lambda a, b: a | b, (v.contains(w) for w in words)))

    human = has(terms, "humans")
    rules = [
        (has(terms, "animals") & ~human, 12, "animals"),
        (has(terms, "in vitro techniques") & ~human, 13, "in vitro"),
        (title.contains("umbrella review") | title.contains("overview of reviews"), 1, "umbrella review"),
        (has(types, "meta-analysis"), 2, "meta-analysis"),
        (has(types, "systematic review"), 3, "systematic review"),
        (has(types, "randomized controlled trial", "randomised controlled trial"), 4, "randomised trial"),
        (has(types, "controlled clinical trial"), 5, "controlled trial"),
        (has(types, "case reports"), 11, "case reports"),
        (has(types, *OPINIONS), 14, "opinion"),
        (has(terms, "case-control studies"), 8, "case-control"),
        (has(terms, "cross-sectional studies"), 9, "cross-sectional"),
        (has(terms, "prospective studies") | (has(terms, "cohort studies") & has(terms, "follow-up studies")), 6, "prospective"),
        (has(terms, "retrospective studies"), 7, "retrospective"),
        (has(types, "clinical trial"), None, "allocation not stated"),
        (has(types, "review"), None, "search not stated"),
        ((F.size(types) == 0) & (F.size(terms) == 0), None, "no tags"),
    ]
    rank, basis = F.lit(None).cast("int"), F.lit("no decisive tag")
    for when, r, b in reversed(rules):
        rank = F.when(when, F.lit(r).cast("int")).otherwise(rank)
        basis = F.when(when, b).otherwise(basis)
    return F.struct(rank.alias("rank"), basis.alias("basis"))
