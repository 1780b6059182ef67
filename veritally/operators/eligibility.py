"""Which trials and which claims may vote: arms as rows, refusals as a reason.

Arms are rows of their own (trial, label, role, presence, cointerventions), so what a trial has of them is an aggregate.
A claim meets the arms of its trial, and those of its labels, in windows over both kinds of rows: these are shuffled once,
by trial.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritally.functions.texts import label_key

# The version that needs every field, roles that are no intervention, and what a comparison must not be.
STRICT = "v1.24"
NO_INTERVENTION = ("measurement_only", "biomarker")
REFUSED_TESTS = ("within_group", "baseline", "time_main_effect", "omnibus", "unknown")
USABLE_TESTS = ("between_arm", "group_by_time")
REFUSED_CONTRASTS = ("vs_ingredient_arm", "within_group", "unclear")
ROLES_OF_OUTCOMES = ("primary", "secondary", "exploratory", "unknown")
# Patterns of clinical settings, of supplements, of interventions and of routes through the skin.
CLINICAL = r"(?i)\b(intravenous|\biv\b|i\.v\.|infusion|infused|surgery|surgical|perioperative|postoperative|preoperative|anesthesia|anaesthesia|anesthetic|anaesthetic|sedation|intubation|eclampsia|preeclampsia|pre-eclampsia|cardiac surgery|bypass|cesarean|caesarean|ketamine|nerve block|spinal anesthesia|epidural)\b"
TAKEN = r"(?i)\b(supplement(?:ation|s)?|dietary supplement|oral|capsule|capsules|tablet|tablets|softgel|mg\s*/\s*day|mg\s*daily|elemental|bisglycinate|glycinate|citrate|oxide|malate|threonate|powdered|chewable)\b"
NEAR = r"(?:supplement(?:ation)?|oral|dietary|administrat(?:ion|ed)|intake|dose[d]?|treated with|receiving|received)"
SKIN = r"\b(cream|topical|transdermal|ointment|gel applied|dermal)\b"
# The reasons of the relevance gate, in the order of its rules; the last where none holds.
RELEVANCE_REASONS = (
    "no ingredient",
    "no title/abstract",
    "ingredient not in title/abstract",
    "marker mention only (e.g. creatine kinase)",
    "topical/transdermal route in title",
    "clinical/IV context in title",
    "clinical context without oral/supplement signal",
    "ingredient in title",
    "oral/supplement signal",
    "intervention phrasing",
    "ingredient mention only (not intervention)",
)


def first_reason(rules: list[tuple[Column, str | Column]]) -> Column:
    """The reason of the first rule that holds, null where none does; a rule that is null doesn't hold."""
    chain = F.lit(None).cast("string")
    for when, reason in reversed(rules):
        chain = F.when(when, reason if isinstance(reason, Column) else F.lit(reason)).otherwise(chain)
    return chain


def background(values: Column) -> Column:
    """The set of normalised co-interventions as a sorted array; null stays null."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, label_key), lambda x: x != "")))


def trial_eligibility(trials: DataFrame, arms: DataFrame, trial: str = "trial") -> DataFrame:
    """``trials`` with reason: why a trial can't tell whether the ingredient works; null: it can.

    ``trials`` has comparator, underpowered, isolated; ``arms`` has role (null: administered), presence,
    cointerventions. Unknown keeps a trial: only what is declared refuses it, benefits and nulls alike.
    """
    given = F.coalesce("role", F.lit("administered")) == "administered"
    target, control = given & (F.col("presence") == "yes"), given & (F.col("presence") == "no")
    set_of = background(F.col("cointerventions"))
    told = arms.groupBy(trial).agg(
        F.count_if(given).alias("_given"),
        F.count_if(F.col("role").isin(*NO_INTERVENTION)).alias("_other"),
        F.count_if(target).alias("_targets"),
        F.count_if(control).alias("_controls"),
        # Looked at where there is one of each, so any one is that one.
        F.max(F.when(target, set_of)).alias("_target_set"),
        F.max(F.when(control, set_of)).alias("_control_set"),
    )
    matched = (F.col("_targets") == 1) & (F.col("_controls") == 1) & (F.col("_target_set") == F.col("_control_set"))
    reason = first_reason(
        [
            ((F.col("_given") == 0) & (F.col("_other") > 0), "no_administered_intervention_arm"),
            ((F.col("_given") > 0) & (F.col("_targets") == F.col("_given")), "no_ingredient_free_arm"),
            (F.col("comparator") == "all_arms_get_ingredient", "no_ingredient_free_arm"),
            (F.col("underpowered"), "self_declared_underpowered"),
            ((F.col("isolated") == "no") & ~F.coalesce(matched, F.lit(False)), "no_isolated_ingredient_arm"),
        ]
    )
    return trials.join(told, trial, "left").withColumns({"reason": reason, "matched_background": F.coalesce(matched, F.lit(False))}).select(*trials.columns, "reason", "matched_background")


def claim_reasons(claims: DataFrame, arms: DataFrame, trial: str = "trial", version: str = "version", place: str | None = None) -> DataFrame:
    """``claims`` with reason: why a claim can't be held against the arms of its trial; null: it can. See :func:`held_claims`."""
    return held_claims(claims, arms, trial, version, place).drop("exposed")


def _of_claim(version: str) -> dict[str, Column]:
    """What the rules look at in a claim alone, in short, so that little is shuffled; ``_last`` is the reason by the rules that need no arm."""
    strict = F.coalesce(F.col(version) == STRICT, F.lit(False))
    provenance, statistic = (F.lower(F.coalesce(c, F.lit(""))) for c in ("provenance", "statistic"))
    omnibus = provenance.contains("omnibus") | provenance.contains("main effect") | (statistic.startswith("f") & ~provenance.contains("pair"))
    kind = F.col("test_kind")
    last = [
        (kind.isin(*REFUSED_TESTS) | ~kind.isin(*USABLE_TESTS), F.concat(F.lit("invalid_test_kind:"), kind)),
        (omnibus & ~F.coalesce(kind == "group_by_time", F.lit(False)), "omnibus_statistic_not_pairwise"),
        (F.col("contrast").isin(*REFUSED_CONTRASTS), F.concat(F.lit("invalid_contrast:"), F.col("contrast"))),
        (kind.isNull(), "test_kind_missing"),
        (strict & ~F.coalesce(F.col("outcome_role").isin(*ROLES_OF_OUTCOMES), F.lit(False)), "outcome_role_missing"),
    ]
    return {
        "_tk": label_key(F.col("ingredient_arm")),
        "_ck": label_key(F.col("control_arm")),
        "_neither": F.col("ingredient_arm").isNull() & F.col("control_arm").isNull(),
        "_both": F.col("ingredient_arm").isNotNull() & F.col("control_arm").isNotNull(),
        "_strict": strict,
        "_legacy": F.coalesce(F.col(version).startswith("legacy-"), F.lit(False)),
        "_missing": reduce(lambda a, b: a | b, (F.col(c).isNull() for c in ("ingredient_arm", "control_arm", "test_kind", "outcome_role", "provenance", "contrast"))),
        "_declared": reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in ("ingredient_arm", "control_arm", "test_kind", "outcome_role", "provenance"))),
        "_last": first_reason(last),
    }


def held_claims(claims: DataFrame, arms: DataFrame, trial: str = "trial", version: str = "version", place: str | None = None) -> DataFrame:
    """``claims`` with reason, why a claim can't be held against the arms of its trial (null: it can), and exposed, see :func:`exposed`.

    ``claims`` has ingredient_arm, control_arm, test_kind, outcome_role, provenance, statistic, contrast, ``version``;
    ``arms`` has label, role, presence, cointerventions as declared. A label that two arms share names none. The rules
    are in order; the first that holds is the reason. Of arms with an unclear role and such with an unknown presence the
    first by the column ``place`` tells it; without one, the unclear role does.
    """
    administered, unknown = F.col("role") == "administered", ~F.coalesce(F.col("presence").isin("yes", "no"), F.lit(False))
    unclear = ~F.coalesce(administered | F.col("role").isin(*NO_INTERVENTION), F.lit(False))
    unsure = F.when(unclear | (administered & unknown), F.struct(F.col(place) if place else F.lit(0), F.when(unclear, "unclear_s3_arm_role").otherwise("unknown_s3_ingredient_presence").alias("why")))
    key = F.nullif(label_key(F.col("label")), F.lit(""))
    facts = {"_arm": F.lit(True), "_given": F.coalesce(administered, F.lit(False)), "_presence": F.col("presence"), "_set": background(F.col("cointerventions")), "_why": unsure, "_tk": key, "_ck": key}
    marked = arms.where(F.col(trial).isNotNull()).select(trial, *(c.alias(n) for n, c in facts.items()))
    rows = claims.withColumns(_of_claim(version)).unionByName(marked, allowMissingColumns=True).repartition(trial)
    target, control = F.col("_given") & (F.col("_presence") == "yes"), F.col("_given") & (F.col("_presence") == "no")
    # The first window sorts by trial and label, which serves the second one too.
    for at, out in (("_tk", "_target"), ("_ck", "_control")):
        named = Window.partitionBy(trial, at)
        rows = rows.withColumns({f"{out}_n": F.count_if("_given").over(named), out: F.max(F.when(F.col("_given"), F.struct(F.col("_presence").alias("presence"), "_set"))).over(named)})
        if out == "_target":
            whole = Window.partitionBy(trial)
            rows = rows.withColumns(
                {
                    "_exposed": (F.count("_arm").over(named) == 1) & (F.count_if(target).over(named) == 1),
                    "_arms": F.count("_arm").over(whole),
                    "_unsure": F.min("_why").over(whole)["why"],
                    "_targets": F.count_if(target).over(whole),
                    "_controls": F.count_if(control).over(whole),
                    "_t": F.max(F.when(target, F.struct("_set"))).over(whole),
                    "_c": F.max(F.when(control, F.struct("_set"))).over(whole),
                }
            )
    rows = rows.where("_arm is null")
    neither, both = F.col("_neither"), F.col("_both")
    found = (F.col("_target_n") == 1) & (F.col("_control_n") == 1)
    target_set = F.when(neither, F.col("_t._set")).otherwise(F.col("_target._set"))
    control_set = F.when(neither, F.col("_c._set")).otherwise(F.col("_control._set"))
    known_sets = target_set.isNotNull() & control_set.isNotNull()
    modern = F.col("_strict") | (F.col("_arms") > 0)
    legacy = ~modern & ~F.col("_declared") & F.col("_legacy")
    rules = [
        (~modern & ~F.col("_declared"), "extraction_version_missing"),
        (F.col("_strict") & F.col("_missing"), "modern_provenance_missing"),
        (F.col("_arms") == 0, "s3_arms_missing"),
        (F.col("_unsure").isNotNull(), F.col("_unsure")),
        (F.col("_targets") == 0, "no_administered_target_arm"),
        (F.col("_controls") == 0, "no_ingredient_free_control_arm"),
        (neither & ((F.col("_targets") != 1) | (F.col("_controls") != 1)), "claim_arms_unresolved"),
        (~neither & ~both, "claim_arm_names_incomplete"),
        (both & ~found, "claim_arm_not_unique_in_s3"),
        (both & (F.col("_tk") == F.col("_ck")), "claim_arms_not_distinct"),
        (both & (F.col("_target.presence") != "yes"), "named_ingredient_arm_not_target"),
        (both & (F.col("_control.presence") != "no"), "named_control_contains_ingredient"),
        (F.col("_strict") & ~known_sets, "cointervention_provenance_missing"),
        (known_sets & (target_set != control_set), "unmatched_active_cointerventions"),
        (F.lit(True), F.col("_last")),
    ]
    return rows.withColumn("reason", F.when(~legacy, first_reason(rules))).select(*claims.columns, "reason", F.col("_exposed").alias("exposed"))


def exposed(claims: DataFrame, arms: DataFrame, trial: str = "trial") -> DataFrame:
    """``claims`` with exposed: the claim names one arm, declared as given and with the ingredient.

    A harm in such an arm is counted whatever its comparison.
    """
    named = arms.select(F.col(trial).alias("_trial"), label_key(F.col("label")).alias("_key"), (F.col("role") == "administered").alias("_given"), "presence").where("_key <> ''")
    named = named.groupBy("_trial", "_key").agg(F.count("*").alias("_n"), F.count_if(F.col("_given") & (F.col("presence") == "yes")).alias("_yes"))
    joined = claims.withColumn("_tk", label_key(F.col("ingredient_arm"))).join(named, (F.col(trial) == F.col("_trial")) & (F.col("_tk") == F.col("_key")), "left")
    return joined.withColumn("exposed", F.coalesce((F.col("_n") == 1) & (F.col("_yes") == 1), F.lit(False))).select(*claims.columns, "exposed")


def unique_match(left: DataFrame, right: DataFrame, group: str, left_label: str, right_label: str, values: list[str]) -> DataFrame:
    """``left`` with ``values`` of the row of ``right`` that has its label in its group, and matched.

    A label counts only where it stands once on either side of the group; else nothing is taken over.
    """
    mine = left.withColumn("_key", label_key(F.col(left_label)))
    once = mine.where("_key <> ''").groupBy(F.col(group).alias("_lg"), F.col("_key").alias("_lk")).agg(F.count("*").alias("_ln"))
    theirs = right.select(F.col(group).alias("_rg"), label_key(F.col(right_label)).alias("_rk"), *values).where("_rk <> ''")
    theirs = theirs.groupBy("_rg", "_rk").agg(F.count("*").alias("_rn"), F.max(F.struct(*values)).alias("_row")).where("_rn = 1")
    rows = mine.join(once.where("_ln = 1"), (F.col(group) == F.col("_lg")) & (F.col("_key") == F.col("_lk")), "left")
    rows = rows.join(theirs, (F.col(group) == F.col("_rg")) & (F.col("_key") == F.col("_rk")) & F.col("_ln").isNotNull(), "left")
    return rows.select(*left.columns, *(F.col(f"_row.{v}").alias(v) for v in values), F.col("_rn").isNotNull().alias("matched"))


def relevance(title: Column, abstract: Column, ingredient: Column) -> Column:
    """struct(ok, reason): whether a record tests the ingredient as something taken; rules in order, reasons of RELEVANCE_REASONS."""
    name = F.array_join(F.filter(F.split(F.lower(F.trim(F.coalesce(ingredient, F.lit("")))), r"[_\s]+"), lambda x: x != ""), " ")
    t, a = (F.trim(F.coalesce(c, F.lit(""))) for c in (title, abstract))
    text, lower_t, lower_a = F.concat_ws("\n", t, a), F.lower(t), F.lower(a)
    both = F.concat_ws(" ", lower_t, lower_a)
    quoted = F.concat(F.lit("\\Q"), name, F.lit("\\E"))
    mentions, markers = F.regexp_count(both, quoted), F.regexp_count(both, F.concat(quoted, F.lit(r"\s+(kinase|phosphokinase)")))
    # A word begins before the ingredient, or ends after it: "creatine doses" is phrasing too.
    phrase = F.concat(F.lit("(?i)\\b"), quoted, F.lit(rf"\s+{NEAR}|{NEAR}\s+"), quoted, F.lit("\\b"))
    rules = [
        (name == "", False),
        ((t == "") & (a == ""), False),
        (~F.contains(lower_t, name) & ~F.contains(lower_a, name), False),
        ((mentions > 0) & (mentions == markers), False),
        (lower_t.rlike(SKIN), False),
        (t.rlike(CLINICAL), False),
        (text.rlike(CLINICAL) & ~text.rlike(TAKEN), False),
        (F.contains(lower_t, name), True),
        (text.rlike(TAKEN), True),
        (F.regexp_like(text, phrase), True),
        (F.lit(True), False),
    ]
    out = F.lit(None).cast("struct<ok:boolean,reason:string>")
    for (when, ok), reason in reversed([*zip(rules, RELEVANCE_REASONS, strict=True)]):
        out = F.when(when, F.struct(F.lit(ok).alias("ok"), F.lit(reason).alias("reason"))).otherwise(out)
    return out
