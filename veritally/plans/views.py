"""Stand-in views: the star-schema tables read as research claims, in Spark and, the same, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.functions import scoring
from veritally.functions.constants import POLICY

#: A total order of claims; order and line alone don't identify a row.
ORDER = ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
UNIT = ["ecu"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def claims(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """One claim a line: its unit is the part, its trial the supplier, its design and access come from the order.

    ``lines`` may be given, with columns ``more`` that claims keep.
    """
    orders, customers, parts = (table(spark, sf_dir, t) for t in ("orders", "customer", "part"))
    lines = table(spark, sf_dir, "lineitem") if lines is None else lines
    who = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_orderpriority", "o_orderstatus", "c_mktsegment")
    rows = lines.join(who, F.col("l_orderkey") == F.col("o_orderkey")).join(parts.select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"), "left")
    effect = F.when(F.col("l_linestatus") == "F", scoring.rescale(F.col("l_discount") * 10 - 0.3, POLICY.mid_smd, POLICY.full_smd))
    by = F.array(*((F.col("l_orderkey") + i * F.col("l_partkey")) % 4 for i in range(6)))
    items = F.transform(by, lambda x: F.when(x.isin(1, 2), 1).when(x == 0, 0))
    return rows.select(
        F.col("l_partkey").alias("ecu"),
        F.col("l_suppkey").alias("trial"),
        *ORDER,
        F.when(F.col("l_tax") >= 0.07, "unclear").when(F.col("l_returnflag") == "A", "benefit").when(F.col("l_returnflag") == "N", "null_effect").otherwise("harm").alias("direction"),
        F.when(F.col("l_quantity") > 25, "meaningful").otherwise("trivial").alias("magnitude"),
        (F.col("l_linenumber") == 1).alias("is_primary"),
        F.when(F.col("l_orderkey") % 11 == 0, "unknown").when(F.col("l_orderkey") % 11 < 4, "secondary").alias("outcome_role"),
        F.when(F.col("l_partkey") % 23 == 0, 12).otherwise(F.substring("o_orderpriority", 1, 1).cast("int") + 3).alias("design_rank"),
        (F.col("l_quantity") * 4).cast("int").alias("n"),
        F.when(F.col("o_orderstatus") == "F", "full_text").when(F.col("o_orderstatus") == "O", "sr_table").otherwise("abstract_only").alias("access"),
        F.when(F.col("c_mktsegment") == "BUILDING", "independent").when(F.col("c_mktsegment") == "AUTOMOBILE", "industry_other").when(F.col("c_mktsegment") == "MACHINERY", "brand_funded").otherwise("undisclosed").alias("funding"),
        effect.alias("effect_s"),
        F.when(F.col("l_linestatus") == "F", "smd").otherwise("label").alias("effect_route"),
        (F.col("l_quantity") * 100).alias("dose_low"),
        (F.col("l_quantity") * 100).alias("dose_high"),
        (F.col("p_size") * 100.0).alias("product_dose"),
        F.element_at(F.array(*(F.lit(x) for x in ("exact", "salt_family", "different", "unspecified"))), (F.col("l_suppkey") % 4 + 1).cast("int")).alias("form_match"),
        scoring.rob_band(items).alias("rob_band"),
        (F.col("l_orderkey") % 5 == 0).alias("rob_inherited"),
        *more,
    )


CLAIMS_SQL = """
claims as (
  select l_partkey as ecu, l_suppkey as trial, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate,
    case when l_tax >= 0.07 then 'unclear' when l_returnflag = 'A' then 'benefit' when l_returnflag = 'N' then 'null_effect' else 'harm' end as direction,
    case when l_quantity > 25 then 'meaningful' else 'trivial' end as magnitude,
    l_linenumber = 1 as is_primary,
    case when l_orderkey % 11 = 0 then 'unknown' when l_orderkey % 11 < 4 then 'secondary' end as outcome_role,
    case when l_partkey % 23 = 0 then 12 else substr(o_orderpriority, 1, 1)::int + 3 end as design_rank,
    (l_quantity * 4)::int as n,
    case o_orderstatus when 'F' then 'full_text' when 'O' then 'sr_table' else 'abstract_only' end as access,
    case c_mktsegment when 'BUILDING' then 'independent' when 'AUTOMOBILE' then 'industry_other' when 'MACHINERY' then 'brand_funded' else 'undisclosed' end as funding,
    case when l_linestatus = 'F' then greatest(-1.0, least(1.0, ((l_discount * 10 - 0.3) - 0.2) / 0.6000000000000001)) end as effect_s,
    case when l_linestatus = 'F' then 'smd' else 'label' end as effect_route,
    l_quantity * 100 as dose_low, l_quantity * 100 as dose_high, p_size * 100.0::double as product_dose,
    ['exact', 'salt_family', 'different', 'unspecified'][l_suppkey % 4 + 1] as form_match,
    case when known >= 2 and hits >= 0.8 * known then 'low' when hits >= 0.5 * known and known > 0 then 'some_concerns' else 'high' end as rob_band,
    l_orderkey % 5 = 0 as rob_inherited
  from (select *, (l_orderkey % 4 in (1, 2))::int + ((l_orderkey + l_partkey) % 4 in (1, 2))::int + ((l_orderkey + 2 * l_partkey) % 4 in (1, 2))::int
      + ((l_orderkey + 3 * l_partkey) % 4 in (1, 2))::int + ((l_orderkey + 4 * l_partkey) % 4 in (1, 2))::int + ((l_orderkey + 5 * l_partkey) % 4 in (1, 2))::int as hits,
      (l_orderkey % 4 < 3)::int + ((l_orderkey + l_partkey) % 4 < 3)::int + ((l_orderkey + 2 * l_partkey) % 4 < 3)::int
      + ((l_orderkey + 3 * l_partkey) % 4 < 3)::int + ((l_orderkey + 4 * l_partkey) % 4 < 3)::int + ((l_orderkey + 5 * l_partkey) % 4 < 3)::int as known from lineitem)
    join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey left join part on l_partkey = p_partkey)"""

VOTES_SQL = (
    CLAIMS_SQL
    + """,
counted as (
  select *, count(*) over g as n_claims,
    count(*) filter (direction = 'benefit') over g as nb, count(*) filter (direction = 'null_effect') over g as nn,
    count(*) filter (direction = 'unclear') over g as nu, count(*) filter (direction = 'harm') over g as nh,
    bool_or(is_primary) over g as any_primary, bool_or(outcome_role is not distinct from 'unknown') over g as any_unknown,
    bool_or(outcome_role is not distinct from 'secondary') over g as any_lesser
  from claims window g as (partition by ecu, trial)),
topped as (select *, greatest(nb, nn, nu, nh) as top, case direction when 'benefit' then nb when 'null_effect' then nn when 'unclear' then nu else nh end as mine,
    case direction when 'harm' then 0 when 'benefit' then 2 else 1 end as cautious from counted),
ruled as (select *,
    (nb = top)::int + (nn = top)::int + (nu = top)::int + (nh = top)::int as tied,
    case when n_claims = 1 then 'single' when any_primary then 'primary' when any_unknown and any_lesser then 'mixed' else 'vote' end as how from topped),
keyed as (select *,
    case how when 'single' then 0 when 'primary' then case when is_primary then cautious else 9 end
      when 'mixed' then case when nh > 0 and direction <> 'harm' then 1 else 0 end
      else case when tied = 1 then case when mine = top then 0 else 1 end
                when nh = top then case when direction = 'harm' then 0 else 1 end
                when nb = top and nn = top then case when direction = 'null_effect' then 0 else 1 end
                else case when mine = top then cautious else 9 end end end as pick,
    case when how = 'mixed' and nh = 0 then 'mixed_role_unclear' when how = 'vote' and tied > 1 and nb = top and nn = top and nh < top then 'tie_cleared' end as cleared
  from ruled),
firsts as (select *, row_number() over (partition by ecu, trial order by pick, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as nth from keyed),
votes as (select ecu, trial, n_claims, case when cleared is null then direction else 'unclear' end as direction,
    case when cleared is null then magnitude end as magnitude, case when cleared is null then effect_s end as effect_s,
    coalesce(cleared, effect_route) as effect_route, design_rank, n, access, funding, dose_low, dose_high, product_dose, form_match, rob_band, rob_inherited
  from firsts where nth = 1)"""
)

STUDIES_SQL = (
    VOTES_SQL
    + """,
studies as (
  select *,
    case design_rank when 4 then 1.0 when 5 then 0.55 when 6 then 0.3 when 7 then 0.18 when 8 then 0.12 when 12 then 0.004 else 0 end::double
      * case rob_band when 'low' then 1.0 when 'some_concerns' then 0.6 else 0.25 end
      * case when coalesce(n, 0) <= 1 then 0.2 else least(1.0, log10(n) / 2) end
      * case funding when 'independent' then 1.0 when 'industry_other' then 0.9 when 'brand_funded' then 0.6 else 0.8 end
      * case access when 'full_text' then 1.0 when 'sr_table' then 0.85 else 0.55 end
      * case when rob_inherited then 0.85 else 1.0 end as w,
    case when effect_s is not null then case when direction = 'harm' and effect_s > 0 then -1.0 else effect_s end
      else case direction when 'harm' then -1.0 when 'null_effect' then -0.35 when 'benefit' then case when magnitude = 'meaningful' then 1.0 else 0.3 end else 0 end end::double as s,
    case design_rank when 4 then 1.0 when 5 then 0.55 when 6 then 0.3 when 7 then 0.18 when 8 then 0.12 else 0 end::double as mass
  from votes)"""
)

SCORES_SQL = (
    STUDIES_SQL
    + """,
means as (select ecu, count(*) as n_primaries, sum(mass) as gate_mass, sum(w) as e, sum(w * s) / sum(w) as d from studies group by ecu),
spread as (select m.ecu, sum(w * (s - d) ** 2) as off from studies join means m using (ecu) group by m.ecu),
shape as (select *, gate_mass < 0.5 or e <= 0 as gate_fired, least(1.0, off / e / 1.5) as h, 1 - exp(-e / 1.5) as c from means join spread using (ecu)),
scores as (select ecu, n_primaries, gate_mass, e, gate_fired, case when not gate_fired then d end as d, case when not gate_fired then h end as h, case when not gate_fired then c end as c,
    case when not gate_fired then greatest(-100, least(100, round_even(100 * d * c * (1 - 0.4 * h), 0)))::int end as score from shape),
banded as (select *, case when score is null then 'insufficient human evidence' when score >= 70 then 'strong support' when score >= 30 then 'moderate support'
    when score >= 10 then 'weak support' when score >= -9 then 'inconclusive' when score >= -39 then 'weak evidence against' when score >= -69 then 'does not work'
    else 'strong evidence against / harm' end as band from scores)"""
)
