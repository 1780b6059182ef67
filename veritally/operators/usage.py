"""Usage roll-ups: several groupings at once, exact percentiles by index, and the check that totals agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets into which a group's values are cut to find one by its index.
BUCKETS = 256


def whole_sum(value: Column) -> Column:
    """The sum, or null if any value is null: an incomplete total is unknown."""
    return F.when(F.count_if(value.isNull()) == 0, F.sum(value))


def roll_up(rows: DataFrame, groupings: list[str], measures: dict[str, Column]) -> DataFrame:
    """grouping, name and ``measures`` for each value of each of ``groupings``, and of all rows (grouping 'all')."""
    sets = rows.groupingSets([[g] for g in groupings] + [[]], *groupings)
    out = sets.agg(*(m.alias(k) for k, m in measures.items()), F.grouping_id().alias("_id"))
    top = len(groupings) - 1
    which, name = F.lit("all"), F.lit(None).cast("string")
    for i, g in enumerate(groupings):  # of the bits of the id the one of the grouping is 0
        mine = F.col("_id") == (2 ** len(groupings) - 1) - 2 ** (top - i)
        which, name = F.when(mine, g).otherwise(which), F.when(mine, F.col(g).cast("string")).otherwise(name)
    return out.select(which.alias("grouping"), name.alias("name"), *measures)


def index_percentile(rows: DataFrame, keys: list[str], value: str, share: float = 0.95, out: str = "percentile") -> DataFrame:
    """The value at index floor(share * (n - 1)) of each group's sorted non-null values, exact at any size of group.

    Distinct values are counted first; approximate quantiles cut a group into buckets, whose sums tell which one holds
    the index, and only that bucket is ordered. The answer doesn't depend on where the cuts lie.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    cuts = rows.groupBy(*keys).agg(F.percentile_approx(value, [i / BUCKETS for i in range(1, BUCKETS)], 10 * BUCKETS).alias("_cuts"), F.count(value).alias("_n"))
    cuts = cuts.where("_n > 0").withColumn("_k", F.floor(share * (F.col("_n") - 1)))
    placed = counts.join(cuts, keys).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    sums = placed.groupBy(*keys, "_b").agg(F.sum("_c").alias("_s"), F.first("_k").alias("_k"))
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    at = sums.withColumn("_end", F.sum("_s").over(upto)).where((F.col("_k") < F.col("_end")) & (F.col("_k") >= F.col("_end") - F.col("_s")))
    inside = placed.join(at.select(*keys, "_b", (F.col("_end") - F.col("_s")).alias("_before")), [*keys, "_b"])
    order = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return inside.withColumn("_upto", F.col("_before") + F.sum("_c").over(order)).where("_k < _upto").groupBy(*keys).agg(F.min(value).alias(out))


def total_check(rolled: DataFrame, measures: list[str], tolerance: float = 1e-6) -> DataFrame:
    """grouping, measure, total, parts, agrees: whether each grouping's parts sum to the total; null where unknown."""
    parts = rolled.where("grouping <> 'all'").groupBy("grouping").agg(*(whole_sum(F.col(m)).cast("double").alias(m) for m in measures))
    whole = F.broadcast(rolled.where("grouping = 'all'").select(*(F.col(m).cast("double").alias(f"_{m}") for m in measures)))
    both = parts.join(whole, F.lit(True))
    each = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(f"_{m}").alias("total"), F.col(m).alias("parts")) for m in measures))
    return both.select("grouping", F.inline(each)).withColumn("agrees", F.abs(F.col("total") - F.col("parts")) <= tolerance)


def followed_up(events: DataFrame, run: str, seq: str, lead: str, is_fetch: Column, failed: Column, query: Column) -> DataFrame:
    """run, lead, last_fail, followed: whether after a lead's last failed fetch the run made an independent attempt.

    That is a query not used before, or a fetch of another lead. Both are told by a run's latest new query and its two
    leads fetched last, so events are aggregated and never paired with each other.
    """
    rows = events.select(F.col(run).alias("run"), F.col(seq).alias("seq"), F.col(lead).alias("lead"), is_fetch.alias("f"), failed.alias("bad"), query.alias("q"))
    last = rows.where("f and lead is not null").groupBy("run", "lead").agg(F.max("seq").alias("last_fetch"), F.max(F.when(F.col("bad"), F.col("seq"))).alias("last_fail"))
    firsts = rows.where("q is not null").groupBy("run", "q").agg(F.min("seq").alias("first")).groupBy("run").agg(F.max("first").alias("new_query"))
    nth = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("last_fetch"), "lead"))
    two = last.withColumn("_nth", nth).where("_nth <= 2").groupBy("run").agg(
        F.max(F.when(F.col("_nth") == 1, F.col("lead"))).alias("_lead"),
        F.max(F.when(F.col("_nth") == 1, F.col("last_fetch"))).alias("_one"),
        F.max(F.when(F.col("_nth") == 2, F.col("last_fetch"))).alias("_two"),
    )
    joined = last.where("last_fail is not null").join(two, "run").join(firsts, "run", "left")
    other = F.when(F.col("lead") == F.col("_lead"), F.col("_two")).otherwise(F.col("_one"))
    after = F.coalesce(F.col("new_query") > F.col("last_fail"), F.lit(False)) | F.coalesce(other > F.col("last_fail"), F.lit(False))
    return joined.select("run", "lead", "last_fail", after.alias("followed"))
