"""Eligibility, claim rules, effects and doses over the lines of orders, read as arms and claims of trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.functions import claims as rules
from veritally.operators import eligibility
from veritally.plans.views import ORDER, table


def _list(*values: str | None) -> F.Column:
    return F.array(*(F.lit(v) for v in values))


def _of(n: F.Column, *values: str | None) -> F.Column:
    """The n-th of some texts."""
    return F.get(F.array(*(F.lit(v).cast("string") for v in values)), n.cast("int"))


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An arm a line; a line number that an order has twice is a label of two arms."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    number, part, supp = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    sets = F.when(supp % 7 == 0, None).when(supp % 7 < 4, _list("Whey protein", "carb")).when(supp % 7 < 6, _list("CARB", "whey-protein", "carb")).otherwise(_list())
    return l.select(
        F.col("l_orderkey").alias("trial"),
        F.concat(F.when(number % 2 == 0, "ARM - ").otherwise("arm "), number.cast("string")).alias("label"),
        F.when(supp % 41 == 0, "measurement_only").when(supp % 41 == 1, "unclear").when((supp % 41 == 2) & (part % 3 == 0), None).otherwise("administered").alias("role"),
        F.when(part % 43 == 0, "unknown").when(number % 2 == 1, "yes").otherwise("no").alias("presence"),
        sets.alias("cointerventions"),
        F.struct(*ORDER[1:]).alias("place"),
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, p = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(p.alias("trial"), F.when(p % 19 == 0, "all_arms_get_ingredient").otherwise("placebo").alias("comparator"), (p % 17 == 0).alias("underpowered"), _of(p % 5, "no", "yes", None, "unknown", "no").alias("isolated"))


def made_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim a line, its arms this line's and the next one's."""
    number, part, supp, order = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(
        order.alias("trial"),
        *ORDER,
        "l_partkey",
        "l_suppkey",
        F.when(part % 9 > 0, F.concat(F.lit("Arm "), number.cast("string"))).alias("ingredient_arm"),
        F.when(part % 9 > 1, F.concat(F.lit("arm_"), (number % 4 + 1).cast("string"))).alias("control_arm"),
        _of(supp % 8, "between_arm", "group_by_time", "within_group", None, "anova", "between_arm", "between_arm", "group_by_time").alias("test_kind"),
        _of(part % 6, "primary", "secondary", None, "unknown", "post hoc", "exploratory").alias("outcome_role"),
        _of(part % 5, "pairwise t", "Omnibus F", "main effect of time", None, "pair F").alias("provenance"),
        _of(supp % 3, "t = 2.1", "F(1, 20)", None).alias("statistic"),
        _of(part % 11, "vs_ingredient_free", "unclear", "vs_ingredient_free", None, "vs_ingredient_free", "vs_ingredient_arm", "vs_ingredient_free", "vs_ingredient_free", "vs_ingredient_free", "vs_ingredient_free", "vs_ingredient_free").alias("contrast"),
        _of(order % 4, "v1.24", "legacy-1", None, "v1.24").alias("version"),
        _of(F.ascii("l_returnflag") % 4, "harm", "benefit", "null_effect", "unclear").alias("direction"),
        F.when(part % 7 > 0, F.round(F.col("l_discount") * 20 - 0.5, 2)).alias("effect_size"),
        _of(supp % 5, "SMD", "percent", "odds ratio", "kg", None).alias("effect_unit"),
        F.when(supp % 2 == 0, 4.0).alias("effect_sd"),
        _of(part % 4, "ingredient", "control", "neither", None).alias("favours"),
        _of(supp % 10, "adverse_event", *["efficacy"] * 9).alias("kind"),
        _of(order % 3, "equivalence", "noninferiority", "prose").alias("method"),
        _of(supp % 4, "successful", "equivalent", "considered", "noninferior").alias("conclusion"),
        F.when(part % 3 > 0, 1.5).alias("margin"),
        _of(supp % 6, "smd", "SMD ", "kg", "percent", "percent", "smd").alias("margin_unit"),
        F.when(part % 3 > 0, F.when(order % 5 > 0, 1.5).otherwise(1.4)).alias("precision"),
        (F.round(F.col("l_discount") * 20 - 0.5, 2) - F.col("l_tax") * 10).alias("ci_low"),
        (F.round(F.col("l_discount") * 20 - 0.5, 2) + F.col("l_tax") * 10).alias("ci_high"),
    )


KEY = ["trial", *ORDER]


def trial_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each trial can't tell whether the ingredient works."""
    return eligibility.trial_eligibility(trials(spark, sf_dir), arms(spark, sf_dir)).select("trial", "reason", "matched_background")


def claim_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each claim can't be held against its trial's arms."""
    return eligibility.claim_reasons(made_claims(spark, sf_dir), arms(spark, sf_dir), place="place").select(*KEY, "reason")


def claim_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each claim names one arm that surely had the ingredient."""
    return eligibility.exposed(made_claims(spark, sf_dir), arms(spark, sf_dir)).select(*KEY, "exposed")


def label_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each arm with what its trial's forms say under the same label, where it stands once on either side."""
    forms = table(spark, sf_dir, "lineitem").where("l_suppkey % 3 > 0").select(F.col("l_orderkey").alias("trial"), F.concat(F.lit("Arm: "), F.col("l_linenumber").cast("string")).alias("name"), F.col("l_partkey").alias("form"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trial"), *ORDER, F.concat(F.lit("arm "), F.col("l_linenumber").cast("string")).alias("label"))
    return eligibility.unique_match(rows, forms, "trial", "label", "name", ["form"]).select(*KEY, "form", "matched")


def _columns(*names: str) -> dict[str, F.Column]:
    return {n: F.col(n) for n in names}


def equivalences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each claim's equivalence result holds together."""
    c = _columns("method", "conclusion", "margin", "margin_unit", "effect_unit", "effect_size", "ci_low", "ci_high", "precision")
    return made_claims(spark, sf_dir).select(*KEY, rules.equivalence_valid(c).alias("valid"))


def effect_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measured effect of each claim, or why it is refused."""
    c = _columns("method", "conclusion", "margin", "margin_unit", "effect_unit", "effect_size", "ci_low", "ci_high", "precision")
    rows = made_claims(spark, sf_dir).withColumn("valid", rules.equivalence_valid(c))
    e = rules.oriented_effect(_columns("kind", "effect_size", "effect_unit", "effect_sd", "favours", "direction", "test_kind", "statistic", "provenance"), F.col("valid"))
    return rows.withColumn("e", e).select(*KEY, F.round("e.s", 6).alias("s"), "e.route")


def study_doses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dose of each line's study, by the fields that state it."""
    part, supp, order = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    d = {
        "compound": F.when(part % 4 > 0, F.col("l_quantity") * 100),
        "elemental": F.when(supp % 3 == 0, F.col("l_quantity") * 100).when(supp % 3 == 1, F.col("l_quantity") * 88),
        "per_kg": F.when(part % 5 == 0, F.col("l_quantity") - 25),
        "mass": F.when(supp % 5 > 1, F.lit(70.0)).when(supp % 5 == 1, F.lit(-70.0)),
        "basis": _of(order % 3, "compound_only", "elemental_stated", None),
        "factor_low": F.when(part % 3 == 0, 0.88).when(part % 3 == 1, 0.8),
        "factor_high": F.when(part % 3 == 0, 0.88).when(part % 3 == 1, 0.95),
    }
    return table(spark, sf_dir, "lineitem").select(order.alias("trial"), *ORDER, rules.study_dose(d).alias("d")).select(*KEY, F.round("d.low", 3).alias("low"), F.round("d.high", 3).alias("high"), "d.basis")


def form_and_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near each line's form and population are to the product's."""
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    form, product = F.when(supp % 6 > 0, supp % 6), F.when(part % 7 > 0, part % 6)
    family = [F.when(x % 3 > 0, x % 3) for x in (form, product)]
    axes = [(F.when(supp % 4 > 0, supp % 4), F.when(part % 4 > 0, part % 4)), (supp % 2, part % 2)]
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trial"), *ORDER, rules.form_tier(form, family[0], product, family[1]).alias("form_tier"), rules.population_tier(axes).alias("population_tier"))


TITLES = ("Creatine cream", "Oral creatine and strength", "Intravenous infusion of magnesium", None, "A trial", "Serum creatine kinase after exercise", "", "Vitamin D and  bone", "Perioperative care", "Dermal patches", "Training and magnesium")
ABSTRACTS = ("creatine supplementation helped", "creatine kinase rose", "surgery and creatine", None, "patients receiving  vitamin d daily", "Two creatine doses were compared", "Undosed creatine", "We saw magnesiums rise", "mg / day of Vitamin D in i.v. drips", "treated with creatine kinase", "Magnesium intakes in epidural cases", "creatine", "400 mg daily, magnesium")
INGREDIENTS = ("creatine", "vitamin_d", "Magnesium", " ", "creatine")


def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document, under a made title and with some of its own text as abstract, tests its ingredient."""
    d = F.col("doc_id")
    abstract = F.concat_ws(" ", _of(d % len(ABSTRACTS), *ABSTRACTS), F.when(d % 3 == 0, F.regexp_extract("text", "^[a-z, ]+", 0)))
    checked = eligibility.relevance(_of(d % len(TITLES), *TITLES), abstract, _of(d % len(INGREDIENTS), *INGREDIENTS))
    return table(spark, sf_dir, "documents").select("doc_id", checked.alias("r")).select("doc_id", "r.ok", "r.reason")


QUERIES = {f.__name__: f for f in (trial_eligibility, claim_reasons, claim_exposure, label_match, equivalences, effect_orientation, study_doses, form_and_population, relevance_gate)}

_K = "trial, " + ", ".join(ORDER)
_KEYS = "l_orderkey as trial, " + ", ".join(ORDER)


def _set(column: str) -> str:
    """The sorted set of normalised names."""
    return f"list_sort(list_distinct(list_transform({column}, lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')))))"


_ARMS = f"""
arms as (select *, case when sets is null then null else {_set("sets")} end as co from (select l_orderkey as trial, 'arm ' || l_linenumber as k,
    case when l_suppkey % 41 = 0 then 'measurement_only' when l_suppkey % 41 = 1 then 'unclear' when l_suppkey % 41 = 2 and l_partkey % 3 = 0 then null else 'administered' end as role,
    case when l_partkey % 43 = 0 then 'unknown' when l_linenumber % 2 = 1 then 'yes' else 'no' end as presence,
    case when l_suppkey % 7 = 0 then null when l_suppkey % 7 < 4 then ['Whey protein', 'carb'] when l_suppkey % 7 < 6 then ['CARB', 'whey-protein', 'carb'] else [] end as sets, {', '.join(ORDER[1:])} from lineitem))"""


def _sql_of(n: str, *values: str | None) -> str:
    return "[" + ", ".join("null" if v is None else f"'{v}'" for v in values) + f"][({n}) + 1]"


_CLAIMS = f"""
claims as (select {_KEYS}, case when l_partkey % 9 > 0 then 'arm ' || l_linenumber end as ia, case when l_partkey % 9 > 1 then 'arm ' || (l_linenumber % 4 + 1) end as ca,
    {_sql_of("l_suppkey % 8", "between_arm", "group_by_time", "within_group", None, "anova", "between_arm", "between_arm", "group_by_time")} as test_kind,
    {_sql_of("l_partkey % 6", "primary", "secondary", None, "unknown", "post hoc", "exploratory")} as outcome_role,
    {_sql_of("l_partkey % 5", "pairwise t", "Omnibus F", "main effect of time", None, "pair F")} as provenance, {_sql_of("l_suppkey % 3", "t = 2.1", "F(1, 20)", None)} as statistic,
    case l_partkey % 11 when 1 then 'unclear' when 3 then null when 5 then 'vs_ingredient_arm' else 'vs_ingredient_free' end as contrast, {_sql_of("l_orderkey % 4", "v1.24", "legacy-1", None, "v1.24")} as version,
    {_sql_of("ascii(l_returnflag) % 4", "harm", "benefit", "null_effect", "unclear")} as direction, case when l_partkey % 7 > 0 then round(l_discount * 20 - 0.5, 2) end as effect_size,
    {_sql_of("l_suppkey % 5", "smd", "percent", "odds ratio", "kg", None)} as unit, case when l_suppkey % 2 = 0 then 4.0 end as sd, {_sql_of("l_partkey % 4", "ingredient", "control", "neither", None)} as favours,
    case when l_suppkey % 10 = 0 then 'adverse_event' else 'efficacy' end as kind, {_sql_of("l_orderkey % 3", "equivalence", "noninferiority", "prose")} as method,
    {_sql_of("l_suppkey % 4", "successful", "equivalent", "considered", "noninferior")} as conclusion, case when l_partkey % 3 > 0 then 1.5 end as margin, {_sql_of("l_suppkey % 6", "smd", "smd", "kg", "percent", "percent", "smd")} as munit,
    case when l_partkey % 3 > 0 then case when l_orderkey % 5 > 0 then 1.5 else 1.4 end end as precision,
    round(l_discount * 20 - 0.5, 2) - l_tax * 10 as lo, round(l_discount * 20 - 0.5, 2) + l_tax * 10 as hi from lineitem)"""

_VALID = """
valid as (select *, coalesce(method in ('equivalence', 'noninferiority') and conclusion in ('successful', 'equivalent', 'noninferior') and margin > 0 and unit = munit and lo <= hi and precision > 0
    and abs(effect_size) <= margin and lo >= -margin and (method = 'noninferiority' or hi <= margin) and precision = margin, false) as ok from claims)"""

_COUNTS = f"""
counts as (select trial, count(*) as n, count(*) filter (role is null or role not in ('administered', 'measurement_only', 'biomarker')) as unclear,
    first(case when coalesce(role, '') = 'administered' then 'unknown_s3_ingredient_presence' else 'unclear_s3_arm_role' end order by {', '.join(ORDER[1:])}) filter (coalesce(role, '') not in ('measurement_only', 'biomarker') and (coalesce(role, '') <> 'administered' or presence = 'unknown')) as unsure,
    count(*) filter (role = 'administered' and presence = 'yes') as targets, count(*) filter (role = 'administered' and presence = 'no') as controls,
    any_value(coalesce(co, ['?'])) filter (role = 'administered' and presence = 'yes') as tset, any_value(coalesce(co, ['?'])) filter (role = 'administered' and presence = 'no') as cset from arms group by trial),
named as (select trial, k, count(*) as n, any_value(presence) as presence, any_value(coalesce(co, ['?'])) as co from arms where role = 'administered' group by trial, k)"""


def _smd(value: str) -> str:
    """The scale of -1 to 1 by unit, and its route, as SQL of a struct."""
    def scale(x: str, mid: float, full: float) -> str:
        return f"greatest(-1.0, least(1.0, (({x}) - {mid}) / {full - mid!r}))"

    return f"""case when unit is null then {{'s': null::double, 'route': 'no_unit'}} when unit = 'odds ratio' then {{'s': null::double, 'route': 'ratio_null_is_one'}}
      when unit = 'percent' then {{'s': {scale(value, 2.0, 8.0)}::double, 'route': 'percent'}} when unit = 'smd' then {{'s': {scale(value, 0.2, 0.8)}::double, 'route': 'smd'}}
      when sd > 0 then {{'s': {scale(f"({value}) / sd", 0.2, 0.8)}::double, 'route': 'smd_from_sd'}} else {{'s': null::double, 'route': 'raw_unit_needs_sd'}} end"""


_DOSE = """
d as (select *, case when l_partkey % 4 > 0 then l_quantity * 100 end as compound, case when l_suppkey % 3 = 0 then l_quantity * 100 when l_suppkey % 3 = 1 then l_quantity * 88 end as elemental,
    case when l_partkey % 5 = 0 and l_quantity > 25 then l_quantity - 25 end as per_kg, case when l_suppkey % 5 > 1 then 70.0::double end as mass,
    case l_orderkey % 3 when 0 then 'compound_only' when 1 then 'elemental_stated' else 'unstated' end as declared,
    case l_partkey % 3 when 0 then 0.88::double when 1 then 0.8::double end as fl, case l_partkey % 3 when 0 then 0.88::double when 1 then 0.95::double end as fh from lineitem),
e as (select *, per_kg * mass as daily, compound is not null and elemental is not null and compound = elemental as copied, coalesce(fl = fh, false) as known from d),
how as (select *, case when copied and known then 'c' when declared = 'compound_only' and elemental is not null and compound is not null and not copied then 'x' when declared = 'compound_only' and (elemental is not null or compound is not null) then 'o'
    when elemental is not null and compound is not null and not coalesce(round(compound * fl, 3) <= elemental and elemental <= round(compound * fh, 3), false) then 'x'
    when elemental is not null then 'e' when daily is not null and declared = 'compound_only' then 'd' when daily is not null then 'k' else 'c' end as h from e),
amounts as (select *, case h when 'c' then compound when 'o' then coalesce(compound, elemental) when 'd' then daily end as a from how)"""

_CLINICAL, _TAKEN, _NEARBY = "infusion|intravenous|surgery|i[.]v[.]|perioperative|epidural", r"supplementation|oral|mg\s*/\s*day|mg\s*daily", "(supplementation|intake|dose|dosed|treated with|receiving)"

ORACLE_SQL = {
    "trial_eligibility": f"""with {_ARMS}, t as (select trial, count(*) filter (coalesce(role, 'administered') = 'administered') as given, count(*) filter (role = 'measurement_only') as other,
    count(*) filter (coalesce(role, 'administered') = 'administered' and presence = 'yes') as targets, count(*) filter (coalesce(role, 'administered') = 'administered' and presence = 'no') as controls,
    any_value(coalesce(co, ['?'])) filter (coalesce(role, 'administered') = 'administered' and presence = 'yes') as tset, any_value(coalesce(co, ['?'])) filter (coalesce(role, 'administered') = 'administered' and presence = 'no') as cset from arms group by trial),
m as (select o_orderkey as trial, given, other, targets, coalesce(targets = 1 and controls = 1 and tset = cset and tset <> ['?'], false) as matched from orders left join t on o_orderkey = trial)
select trial, case when given = 0 and other > 0 then 'no_administered_intervention_arm' when given > 0 and targets = given then 'no_ingredient_free_arm' when trial % 19 = 0 then 'no_ingredient_free_arm'
  when trial % 17 = 0 then 'self_declared_underpowered' when trial % 5 in (0, 4) and not matched then 'no_isolated_ingredient_arm' end as reason, matched as matched_background from m""",
    "claim_reasons": f"""with {_ARMS}, {_CLAIMS}, {_COUNTS},
j as (select c.*, coalesce(version = 'v1.24', false) as strict, a.n, a.unsure, a.targets, a.controls, t.n as tn, t.presence as tp, u.n as cn, u.presence as cp,
    case when ia is null and ca is null then nullif(a.tset, ['?']) else nullif(t.co, ['?']) end as ts, case when ia is null and ca is null then nullif(a.cset, ['?']) else nullif(u.co, ['?']) end as cs
  from claims c left join counts a using (trial) left join named t on c.trial = t.trial and ia = t.k left join named u on c.trial = u.trial and ca = u.k)
select {_K}, case when strict and (ia is null or ca is null or test_kind is null or outcome_role is null or provenance is null or contrast is null) then 'modern_provenance_missing'
  when unsure is not null then unsure when targets = 0 then 'no_administered_target_arm' when controls = 0 then 'no_ingredient_free_control_arm'
  when ia is null and ca is null and (targets <> 1 or controls <> 1) then 'claim_arms_unresolved' when (ia is null) <> (ca is null) then 'claim_arm_names_incomplete'
  when ia is not null and not (coalesce(tn, 0) = 1 and coalesce(cn, 0) = 1) then 'claim_arm_not_unique_in_s3' when ia is not null and ia = ca then 'claim_arms_not_distinct'
  when ia is not null and tp <> 'yes' then 'named_ingredient_arm_not_target' when ia is not null and cp <> 'no' then 'named_control_contains_ingredient'
  when strict and (ts is null or cs is null) then 'cointervention_provenance_missing' when ts is not null and cs is not null and ts <> cs then 'unmatched_active_cointerventions'
  when test_kind not in ('between_arm', 'group_by_time') then 'invalid_test_kind:' || test_kind
  when (lower(coalesce(provenance, '')) like '%omnibus%' or lower(coalesce(provenance, '')) like '%main effect%' or (lower(coalesce(statistic, '')) like 'f%' and lower(coalesce(provenance, '')) not like '%pair%')) and coalesce(test_kind, '') <> 'group_by_time' then 'omnibus_statistic_not_pairwise'
  when contrast in ('unclear', 'vs_ingredient_arm') then 'invalid_contrast:' || contrast when test_kind is null then 'test_kind_missing'
  when strict and coalesce(outcome_role, '') not in ('primary', 'secondary', 'exploratory', 'unknown') then 'outcome_role_missing' end as reason from j""",
    "claim_exposure": f"with {_ARMS}, {_CLAIMS}, a as (select trial, k, count(*) as n, count(*) filter (role = 'administered' and presence = 'yes') as y from arms group by 1, 2) select c.{_K.replace('trial, ', 'trial, ')}, coalesce(n = 1 and y = 1, false) as exposed from claims c left join a on c.trial = a.trial and ia = k",
    "label_match": f"""with l as (select {_KEYS}, count(*) over (partition by l_orderkey, l_linenumber) as ln from lineitem), f as (select l_orderkey as k, l_linenumber as n, any_value(l_partkey) as form from lineitem where l_suppkey % 3 > 0 group by 1, 2 having count(*) = 1)
select {_K}, form, form is not null as matched from l left join f on trial = k and l_linenumber = n and ln = 1""",
    "equivalences": f"with {_CLAIMS}, {_VALID} select {_K}, ok as valid from valid",
    "effect_orientation": f"""with {_CLAIMS}, {_VALID}, o as (select *, direction = 'null_effect' and not ok as nul, coalesce(favours in ('ingredient', 'control'), false) as named,
    {_smd("case when favours = 'ingredient' then abs(effect_size) else -abs(effect_size) end")} as arm, {_smd("abs(effect_size)")} as free from valid),
r as (select *, case when kind = 'adverse_event' then {{'s': null::double, 'route': 'adverse_event_inverted_polarity'}} when effect_size is null then {{'s': null::double, 'route': case when nul then 'inconclusive_unquantified' else 'no_effect_size' end}}
  when direction = 'null_effect' and not named then {{'s': null::double, 'route': case when nul then 'inconclusive_unquantified' else 'no_effect_size' end}}
  when (direction = 'benefit' and favours = 'control') or (direction = 'harm' and favours = 'ingredient') then {{'s': null::double, 'route': 'label_number_contradiction'}}
  when test_kind = 'group_by_time' and (lower(coalesce(statistic, '')) like 'f%' or lower(coalesce(provenance, '')) like '%omnibus%') then {{'s': null::double, 'route': case when nul then 'inconclusive_unquantified' else 'omnibus_magnitude_refused' end}}
  when named and arm.s is null and nul then {{'s': null::double, 'route': 'inconclusive_unquantified'}} when named then arm when free.s <= 0 then free
  when favours = 'neither' then {{'s': null::double, 'route': 'favours_neither_but_above_threshold'}} else {{'s': null::double, 'route': 'sign_convention_unstated'}} end as e from o)
select {_K}, round(e.s, 6) as s, e.route as route from r""",
    "study_doses": f"""with {_DOSE} select {_KEYS}, round(case when h in ('c', 'o', 'd') then round(a * fl, 3) when h = 'e' then elemental when h = 'k' then daily end, 3) as low,
  round(case when h in ('c', 'o', 'd') then round(a * fh, 3) when h = 'e' then elemental when h = 'k' then daily end, 3) as high,
  case when h = 'x' then 'contradictory_dose_fields' when h = 'e' then declared when h = 'k' then 'per_kg_x_stated_mass' when a is null then 'unstated' when fl is null then 'compound_only' when known then 'converted' else 'bounded' end as basis from amounts""",
    "form_and_population": f"""with x as (select *, nullif(l_suppkey % 6, 0) as f, case when l_partkey % 7 > 0 then l_partkey % 6 end as p, nullif(l_suppkey % 4, 0) as a, nullif(l_partkey % 4, 0) as b from lineitem)
select {_KEYS}, case when f is null or p is null then 'unspecified' when f = p then 'exact' when f % 3 = 0 or p % 3 = 0 then 'unspecified' when f % 3 = p % 3 then 'salt_family' else 'different' end as form_tier,
  ['exact', 'adjacent', 'different'][greatest(case when a is null or b is null then 1 when a = b then 0 else 2 end, case when l_suppkey % 2 = l_partkey % 2 then 0 else 2 end) + 1] as population_tier from x""",
    "relevance_gate": f"""with m as (select doc_id, lower(trim(coalesce({_sql_of(f"doc_id % {len(TITLES)}", *TITLES)}, ''))) as t,
    lower(trim(concat_ws(' ', {_sql_of(f"doc_id % {len(ABSTRACTS)}", *ABSTRACTS)}, case when doc_id % 3 = 0 and text is not null then regexp_extract(text, '^[a-z, ]+') end))) as a,
    trim(replace(lower({_sql_of(f"doc_id % {len(INGREDIENTS)}", *INGREDIENTS)}), '_', ' ')) as i from documents),
n as (select *, t || chr(10) || a as b, len(regexp_extract_all(t || ' ' || a, i)) as m, len(regexp_extract_all(t || ' ' || a, i || '\\s+(kinase|phosphokinase)')) as k from m),
r as (select doc_id, case when i = '' then 0 when t = '' and a = '' then 1 when not contains(t, i) and not contains(a, i) then 2 when m > 0 and m = k then 3 when regexp_matches(t, '\\b(cream|dermal)\\b') then 4
  when regexp_matches(t, '\\b({_CLINICAL})\\b') then 5 when regexp_matches(b, '\\b({_CLINICAL})\\b') and not regexp_matches(b, '\\b({_TAKEN})\\b') then 6
  when contains(t, i) then 7 when regexp_matches(b, '\\b({_TAKEN})\\b') then 8 when regexp_matches(b, '\\b' || i || '\\s+{_NEARBY}|{_NEARBY}\\s+' || i || '\\b') then 9 else 10 end as n from n)
select doc_id, n in (7, 8, 9) as ok, ['{"', '".join(eligibility.RELEVANCE_REASONS)}'][n + 1] as reason from r""",
}
