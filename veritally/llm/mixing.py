"""Mixing sources to target weights by Sainte-Lague apportionment.

Each source has a target of words. Documents are dealt to shards by a seeded hash, in which each source has a share of
its target; blocks of BLOCK words are given to the sources of a shard by the highest quotients votes / (2 k + 1), which
makes integer quotas. A source's documents of a shard stand in seeded order as one ring of words, cut into blocks; the
quota takes whole rounds of the ring first, and the rest as blocks from a seeded one on. All of it is DataFrame
functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritally.llm.common import join_groups, running, table, text_of, whole_row, word_count, written

#: Words of a block, documents of a shard (as a mean), most rounds over a source, weights by rank of the source.
BLOCK, SHARD, ROUNDS, WEIGHTS = 32, 20_000, 3, (1, 2, 3)
#: Up to so many sources are joined by broadcast (some 20 MB at most); of more, the hot ones alone.
FEW_SOURCES = 200_000
#: Parts of a word in which votes are counted.
VOTES = 1024
SEED = 20


def _running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with the sum of each of ``sums`` (longs) over all rows before it in a total order.

    Rows are dealt to ranges of that order and added up within each, then one row a range over all of them, so no task
    has all rows.
    """
    dealt = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    names = {name: f"_{i}" for i, name in enumerate(sums)}
    ranges = dealt.groupBy("_range").agg(*(F.sum(c).alias(names[n]) for n, c in sums.items()))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_range", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in names.values()))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = {n: F.col(names[n]) + F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}
    return dealt.join(F.broadcast(ranges), "_range").withColumns(before).drop("_range", *names.values())


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, rounds: int = ROUNDS) -> DataFrame:
    """source, source_size, target from ``sizes`` (source, source_size: one row per source), and its other columns.

    Sources in order of code points, null last, have ``weights`` (integers) in turn, and share the sum of all sizes by
    them. A target stops at ``rounds`` times the source's size; the excess goes to the others by weight, until none is
    above. That is the level L at which the least of rounds * size and L * weight add up to the sum: sources are full in
    order of rounds * size / weight, so it takes running sums over the table of sources, not rounds of sharing; of
    sources full at one level the first tells it. Sums are of integers, so reruns agree to the last digit.
    """
    ranked = _running(sizes, [F.col("source").asc_nulls_last()], {"_rank": F.lit(1).cast("long")})
    weight = F.get(F.array(*(F.lit(w).cast("long") for w in weights)), F.pmod("_rank", F.lit(len(weights))).cast("int"))
    levels = ranked.withColumns({"weight": weight, "full": F.lit(rounds).cast("long") * F.col("source_size")}).drop("_rank")
    levels = levels.withColumn("at", F.col("full") / F.col("weight"))
    levels = _running(levels, [F.col("at"), F.col("source").asc_nulls_last()], {"_full": F.col("full"), "_weight": F.col("weight")})
    whole = levels.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    level = (F.lit(whole["size"]) - F.col("_full")) / (F.lit(whole["weight"]) - F.col("_weight"))
    levels = levels.withColumn("level", level)
    first = levels.where("at >= level").agg(F.min(F.struct("at", F.col("source").isNull().alias("null"), "source", "level")).alias("x")).first()["x"]
    target = F.col("full").cast("double") if first is None else F.least(F.col("full").cast("double"), F.col("weight") * F.lit(first["level"]))
    return levels.select(*sizes.columns, target.alias("target"))


def apportion(votes: DataFrame, group: str, key: str, vote: str, seats: str, out: str = "quota") -> DataFrame:
    """``votes`` with ``out``: how many of the group's ``seats`` each row has by Sainte-Lague.

    The quotients vote / (2 k + 1) that reach a level t are floor(vote / (2 t) + 1/2) of a row, so those of n rows are
    n / 2 more or less than total / (2 t). Two levels follow from that, above and below the last quotient that wins: what
    reaches the upper one is given at once, and only the quotients between, some 2 n in all, are ranked. Equal quotients
    go to the smaller ``key`` (nulls first).
    """
    whole = Window.partitionBy(group)
    names = {"_n": F.count("*").over(whole), "_total": F.sum(vote).over(whole), "_top": F.max(vote).over(whole)}
    upper = F.least(F.col("_top") * 1.01, F.when(F.col(seats) > F.col("_n") / 2, F.col("_total") / (2 * (F.col(seats) - F.col("_n") / 2))))
    lower = F.col("_total") / (2 * (F.col(seats) + F.col("_n") / 2))
    reach = lambda level, slack: F.when(F.col(vote) > 0, F.floor(F.col(vote) / (2 * level) * slack + 0.5)).otherwise(0).cast("long")
    # What stands at a level but for a rounding error is ranked too.
    rows = votes.withColumns(names).withColumns({"_least": reach(upper, 1 - 1e-9), "_most": reach(lower, 1 + 1e-9)})
    rows = rows.withColumn("_given", F.sum("_least").over(whole))
    quotients = rows.where("_most > _least").select(group, key, vote, seats, "_given", F.explode(F.sequence(F.col("_least"), F.col("_most") - 1)).alias("_k"))
    order = Window.partitionBy(group).orderBy((F.col(vote) / (2 * F.col("_k") + 1)).desc(), F.col(key), "_k")
    won = quotients.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= F.col(seats) - F.col("_given"))
    won = won.groupBy(F.col(group).alias("_g"), F.col(key).alias("_s")).agg(F.count("*").alias("_won"))
    joined = rows.join(won, (rows[group] == won["_g"]) & rows[key].eqNullSafe(won["_s"]), "left")
    return joined.withColumn(out, F.col("_least") + F.coalesce("_won", F.lit(0))).drop(*names, "_least", "_most", "_given", "_g", "_s", "_won")


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, rounds: int = ROUNDS, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, few: int = FEW_SOURCES) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of ``docs`` (doc_id, text, source).

    size: words of the text (null: 0). target: words of the row's source in the mix; taken: words of the row in it,
    repeats counted, ``rounds`` * size at most. A null source is a source; a row without words takes nothing; of
    repeated rows each has its own share, and which of them has which is not defined. Texts are read whole; an empty table
    gives an empty result; other columns are not looked at.
    """
    return _mixed(docs, weights, rounds, block, shard, seed, few).select("doc_id", "size", "source_size", "target", "taken")


def _mixed(docs: DataFrame, weights: tuple, rounds: int, block: int, shard: int, seed: int, few: int) -> DataFrame:
    sized = written(docs.select("doc_id", "source", word_count(text_of("text")).alias("size"), F.xxhash64("text").alias("text_key")), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    sources = written(source_targets(sources, weights, rounds), "sources")
    known, rows = sources.agg(F.count("*"), F.coalesce(F.sum("_rows"), F.lit(0))).first()
    shards = max(1, -(-rows // shard))
    dealt = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_key"), F.lit(shards))
    key = F.struct(F.col("source").isNull().alias("null"), F.coalesce("source", F.lit("")).alias("name"))
    by, placed = sources.withColumn("_key", key).drop("source"), sized.withColumn("shard", dealt).withColumn("_key", key)
    placed = placed.join(F.broadcast(by), "_key") if known <= few else join_groups(placed, by, "_key", "_rows")
    placed = placed.drop("_key", "_rows")
    # In each shard a source votes with its share of the target, by its words there; in whole VOTES-ths of a word, so
    # that sums don't depend on their order.
    words = placed.groupBy("shard", "source", "source_size", "target").agg(F.sum("size").alias("words"))
    vote = F.when(F.col("source_size") > 0, F.floor(F.col("target") * F.col("words") / F.col("source_size") * VOTES)).otherwise(0)
    votes = words.withColumn("vote", vote.cast("long"))
    votes = votes.withColumn("seats", F.round(F.sum("vote").over(Window.partitionBy("shard")) / (block * VOTES)).cast("long"))
    quotas = apportion(votes, "shard", "source", "vote", "seats")
    blocks, words = F.ceil(F.col("words") / block), F.col("words")
    quotas = quotas.withColumn("blocks", blocks).withColumn("take", F.least(F.col("quota") * block, words * rounds))
    from_block = F.pmod(F.xxhash64(F.lit(seed), "shard", "source"), F.greatest(F.col("blocks"), F.lit(1)))
    quotas = quotas.select(
        F.col("shard").alias("_shard"),
        F.col("source").alias("_source"),
        words.alias("ring"),
        F.when(words > 0, F.floor(F.col("take") / words)).otherwise(0).alias("whole"),
        (from_block * block).alias("first"),
        F.when(words > 0, F.col("take") % words).otherwise(0).alias("extra"),
    )
    stream = Window.partitionBy("shard", "source").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "text_key"), "doc_id", "text_key", "size")
    at = placed.withColumn("end", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)))
    at = at.join(quotas, (F.col("shard") == F.col("_shard")) & F.col("source").eqNullSafe(F.col("_source")))
    start, first, end = F.col("end") - F.col("size"), F.col("first"), F.col("end")

    def overlap(a: Column, b: Column) -> Column:
        return F.greatest(F.lit(0), F.least(end, b) - F.greatest(start, a))

    # The words from ``first`` on, up to where the ring closes, and the rest from its beginning.
    rest = F.greatest(F.lit(0), first + F.col("extra") - F.col("ring"))
    taken = F.col("whole") * F.col("size") + overlap(first, first + F.col("extra")) + overlap(F.lit(0), rest)
    return at.withColumn("taken", taken.cast("long"))


def whole_copies(taken: DataFrame, seed: int = SEED) -> DataFrame:
    """``taken`` (doc_id, source, text_key, size, taken: size above 0) with ``copies``, whole ones.

    taken / size is rounded. Where that puts a source off its words by more than its longest rounded document, those
    rounded the other way, nearest to one half first, get one copy more (or less) as long as each brings the source
    nearer: it ends within half of that document. What sources are off is an aggregate, and the order is that of running
    sums over ranges, as one source may have most rows. Rows that agree in all columns are alike.
    """
    rounded = taken.withColumn("copies", F.round(F.col("taken") / F.col("size")).cast("int")).withColumn("_off", F.col("taken") - F.col("copies") * F.col("size"))
    key = F.struct(F.col("source").isNull().alias("null"), F.coalesce("source", F.lit("")).alias("name"))
    cut = rounded.where("_off != 0").withColumn("_of", key)
    sources = written(cut.groupBy("_of").agg(F.sum("_off").alias("_short"), F.max("size").alias("_longest"), F.count("*").alias("_rows")), "rounded-sources")
    cut = join_groups(cut, sources, "_of", "_rows")
    cut = cut.withColumn("_may", (F.signum("_off") == F.signum("_short")) & (F.abs("_short") > F.col("_longest")))
    names = [*taken.columns, "copies"]
    few = cut.where("_may").withColumn("_near", F.abs("_off") / F.col("size")).withColumn("_hash", F.xxhash64(F.lit(seed + 2), "doc_id", "text_key"))
    few = running(few, "_of", [F.col("_near").desc(), F.col("_hash"), F.col("doc_id"), F.col("text_key"), F.col("size")], {"_before": F.col("size")})
    change = F.when(F.col("_before") - F.col("size") / 2 < F.abs("_short"), F.signum("_short")).otherwise(0).cast("int")
    few = few.withColumn("copies", F.col("copies") + change)
    return rounded.where("_off = 0").select(*names).unionByName(cut.where("not _may").select(*names)).unionByName(few.select(*names))


def mix_stage(docs: DataFrame, weights: tuple = WEIGHTS, rounds: int = ROUNDS, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, few: int = FEW_SOURCES) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as its words are taken, all its columns with it.

    A text is never cut: taken / size is rounded, which changes the two documents at the ends of a run of blocks alone,
    and what that adds up to over the shards of a source is made up for, see :func:`whole_copies`. Rows without words
    (null, empty or blank texts) are in no mix; a null source is a source; repeated rows share their copies; an empty table
    stays empty. Columns of any name keep their values.
    """
    taken = _mixed(docs, weights, rounds, block, shard, seed, few).where("taken > 0")
    copies = whole_copies(written(taken.select("doc_id", "source", "text_key", "size", "taken"), "taken"), seed)
    copies = copies.select(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.col("text_key").alias("key"), F.col("copies").alias("n"))
    # Repeated rows share their copies: they are counted together and dealt out to one of them.
    copies = copies.groupBy("id", "of", "key").agg(F.sum("n").cast("int").alias("n")).where("n > 0")
    marked = docs.select(whole_row(docs).alias("carried"), F.col("doc_id").alias("my_id"), F.col("source").alias("my_source"), F.xxhash64("text").alias("my_key"))
    mine = ["my_id", "my_source", "my_key"]
    if not marked.groupBy(*mine).count().where("count > 1").isEmpty():
        marked = marked.dropDuplicates(mine)
    on = F.col("my_id").eqNullSafe(F.col("id")) & F.col("my_source").eqNullSafe(F.col("of")) & (F.col("my_key") == F.col("key"))
    return marked.join(copies, on).select("carried", F.explode(F.array_repeat(F.lit(1), F.col("n")))).select("carried.*")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's part in a mix of all sources."""
    return mix_sources(table(spark, sf_dir, "documents"))
