"""Orders, picks and small joins of a run: priorities, newest rows, round-robin picks, overlaps, repairs, checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritally.shared import written

# How readable a paper is, the most readable first.
ACCESS = ("full_text", "green", "sr_table", "abstract_only")


def access_rank(access: Column) -> Column:
    """Position in ACCESS from 0; unknown comes last."""
    at = F.array_position(F.array(*(F.lit(a) for a in ACCESS)), F.lower(F.coalesce(access, F.lit("abstract_only"))))
    return F.when(at > 0, at - 1).otherwise(len(ACCESS) + 2)


def newest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order`` (values, the least first; total), by an aggregate: no key is a hot spot."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.withColumn("_by", F.struct(*(c.alias(f"_{i}") for i, c in enumerate(order)))).groupBy(*keys).agg(F.min_by(F.struct(*rest), "_by").alias("_best"))
    return best.select(*keys, *(F.col(f"_best.{c}").alias(c) for c in rest))


def numbered(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``rows`` with their place (from 0) in a total order: ranges are counted first, so no task has all rows."""
    dealt = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))  # one row a range
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_nth", nth).join(F.broadcast(sizes), "_range").withColumn(name, F.col("_before") + F.col("_nth")).drop("_range", "_nth", "_before")


def strided(rows: DataFrame, order: list[Column], step: int) -> DataFrame:
    """Every ``step``-th row of a total order, the first included."""
    return numbered(rows, order, "_at").where(F.col("_at") % step == 0).drop("_at")


def round_robin(records: DataFrame, tagged: DataFrame, outcomes: list[str], order: list[str], limit: int, key: str) -> DataFrame:
    """``key``, turn: up to ``limit`` records, one of each outcome in turn, each taken once; the rest fill up.

    ``tagged`` has (key, outcome). An outcome can't give more than its first ``limit`` records, so that many of each
    are looked at, at any size of ``records``; ``order`` is total.
    """
    spark = records.sparkSession
    place = F.row_number().over(Window.partitionBy("outcome").orderBy(*order))
    rows = records.select(key, *[c for c in order if c != key]).join(tagged.where(F.col("outcome").isin(*outcomes)).distinct(), key)
    pools: dict[str, list] = {o: [] for o in outcomes}
    for r in rows.withColumn("_at", place).where(F.col("_at") <= limit).orderBy("_at").select(key, "outcome").collect():  # outcomes * limit rows at most
        pools[r["outcome"]].append(r[key])
    rest = records.join(tagged.where(F.col("outcome").isin(*outcomes)).select(key).distinct(), key, "left_anti")
    chosen: dict = {}
    pending = {o: iter(p) for o, p in pools.items()}
    while pending and len(chosen) < limit:
        for o in list(pending):
            taken = next((k for k in pending[o] if k not in chosen), None)
            if taken is None:
                del pending[o]
            elif len(chosen) < limit:
                chosen[taken] = len(chosen)
    for r in rest.orderBy(*order).select(key).limit(limit - len(chosen)).collect():
        chosen[r[key]] = len(chosen)
    kind = records.schema[key].dataType.simpleString()
    return spark.createDataFrame([*chosen.items()], f"{key} {kind}, turn int")


def disjoint_sets(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node that each reaches over ``links`` (both ways), itself included.

    Each round gives a node the least root among its neighbours' roots, and then that root's own; it ends when none
    changes. Rounds are written, so lost executors cost one of them.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node is not null and other is not null")
    both = written(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "links")
    roots = written(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("other"), F.col("root").alias("_near")), "other").groupBy("node").agg(F.min("_near").alias("_near"))
        step = roots.join(near, "node").select("node", F.col("root").alias("_was"), F.least("root", "_near").alias("root"))
        up = step.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        after = written(step.join(up, "root", "left").select("node", "_was", F.coalesce("_up", "root").alias("root")), "roots")
        roots = after.select("node", "root")
        if after.where("root <> _was").isEmpty():
            return roots


def set_overlap(members: DataFrame, group: str, item: str) -> DataFrame:
    """a, b, shared, containment, covered, same: for groups that share an item. Of a group's items each counts once.

    containment: the share of the smaller set in the larger; covered: corrected covered area of the two. Meant for
    groups such as reviews of one question; items in many groups make many pairs, as the result itself does.
    """
    rows = members.select(group, item).distinct()
    size = rows.groupBy(group).agg(F.count("*").alias("n"))
    left, right = rows.select(F.col(group).alias("a"), item), rows.select(F.col(group).alias("b"), item)
    shared = left.join(right, item).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    sized = shared.join(size.select(F.col(group).alias("a"), F.col("n").alias("n_a")), "a").join(size.select(F.col(group).alias("b"), F.col("n").alias("n_b")), "b")
    containment = F.col("shared") / F.least("n_a", "n_b")
    covered = F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))
    return sized.select("a", "b", "shared", containment.alias("containment"), covered.alias("covered"), ((containment > 0.5) | (covered > 0.5)).alias("same"))


def venue_flags(records: DataFrame, venues: DataFrame, issn: str, title: str, publisher: str) -> DataFrame:
    """``records`` with flag: by which rule a record's venue is listed: issn, title, publisher; null where by none.

    ``venues`` has kind (issn, title, publisher) and name as keys. A publisher is listed by its name or, from six
    characters on, by a name that it begins with before a blank: each prefix that ends at a blank is looked up, so it
    stays an equi-join.
    """
    words = F.split(F.col(publisher), " ")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, 1, i), " "))
    usable = F.filter(prefixes, lambda p: (p == F.col(publisher)) | (F.length(p) >= 6))
    keys = F.array(F.struct(F.lit(0).alias("rank"), F.lit("issn").alias("kind"), F.col(issn).alias("name")), F.struct(F.lit(1).alias("rank"), F.lit("title").alias("kind"), F.col(title).alias("name")))
    keys = F.concat(keys, F.coalesce(F.transform(usable, lambda p: F.struct(F.lit(2).alias("rank"), F.lit("publisher").alias("kind"), p.alias("name"))), F.array().cast("array<struct<rank:int,kind:string,name:string>>")))
    listed = venues.select("kind", "name").distinct()
    hit = records.select("seq", F.inline(keys)).where("name is not null and name <> ''").join(listed, ["kind", "name"]).groupBy("seq").agg(F.min(F.struct("rank", "kind")).alias("_hit"))
    return records.join(hit, "seq", "left").withColumn("flag", F.col("_hit.kind")).drop("_hit")


def uncovered_pairs(actives: DataFrame, curated: DataFrame, label: str, active: str) -> DataFrame:
    """label, a, b, curated: the unordered pairs of a label's actives, and whether the curated table has the pair.

    A label names a few dozen actives at most.
    """
    rows = actives.select(label, active).distinct()
    pairs = rows.select(label, F.col(active).alias("a")).join(rows.select(label, F.col(active).alias("b")), label).where("a < b")
    known = curated.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("curated", F.lit(True))
    return pairs.join(known, ["a", "b"], "left").select(label, "a", "b", F.coalesce("curated", F.lit(False)).alias("curated"))


def form_notes(products: DataFrame, notes: DataFrame) -> DataFrame:
    """Each product (ingredient, form) with the notes of its ingredient that name its form or none."""
    n = notes.select(F.col("ingredient").alias("_i"), F.col("form").alias("_f"), "note")
    return products.join(n, (F.col("ingredient") == F.col("_i")) & (F.col("_f").isNull() | (F.col("form") == F.col("_f")))).drop("_i", "_f")


def parent_repair(rows: DataFrame, forms: DataFrame, ingredient: str = "ingredient", form: str = "form") -> DataFrame:
    """``rows`` in which a form that stands as the ingredient is replaced by its parent, and taken as the form if there is
    none. ``forms`` has form_id and parent; the vocabulary is small and joins by its own size."""
    known = forms.select(F.col("form_id").alias("_id"), F.col("parent").alias("_parent"))
    joined = rows.join(known, F.col(ingredient) == F.col("_id"), "left")
    fixed = {ingredient: F.coalesce("_parent", ingredient), form: F.when(F.col("_parent").isNotNull(), F.coalesce(form, "_id")).otherwise(F.col(form))}
    return joined.withColumns(fixed).drop("_id", "_parent")


def reconcile(artifact: DataFrame, kept: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-6) -> DataFrame:
    """``keys``, status, fields: what an artifact and its source say of each key; nothing is repaired.

    status: missing (in the artifact), extra, differs or same; fields: those that differ, joined by commas.
    """
    a = artifact.select(*keys, *(F.col(v).alias(f"{v}_a") for v in values), F.lit(True).alias("_a"))
    b = kept.select(*keys, *(F.col(v).alias(f"{v}_b") for v in values), F.lit(True).alias("_b"))
    off = [F.when(~(F.col(f"{v}_a").eqNullSafe(F.col(f"{v}_b")) | F.coalesce(F.abs(F.col(f"{v}_a") - F.col(f"{v}_b")) <= tolerance, F.lit(False))), v) for v in values]
    fields = F.array_join(F.array_compact(F.array(*off)), ",")
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "extra").when(fields != "", "differs").otherwise("same")
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"), F.when(F.col("_a") & F.col("_b"), fields).otherwise("").alias("fields"))


def turn_progress(turns: DataFrame, run: str, turn: str, problems: str, events: str) -> DataFrame:
    """``turns`` with progress: something of the turn before is resolved, and there are new events or fewer problems."""
    order = Window.partitionBy(run).orderBy(turn)
    before = F.lag(problems).over(order)
    resolved = F.size(F.array_except(before, F.col(problems))) > 0
    fewer = F.size(F.array_distinct(problems)) < F.size(F.array_distinct(before))
    return turns.withColumn("progress", F.coalesce(resolved & ((F.col(events) > 0) | fewer), F.lit(False)))


def share(n: Column, of: Column) -> Column:
    """n / of, null where that is 0."""
    return F.try_divide(n, of)


def all_of(*conditions: Column) -> Column:
    """Whether all hold; null counts as no."""
    return F.coalesce(reduce(lambda a, b: a & b, conditions), F.lit(False))
