"""Helpers that the operators share: shared tables, word rules, joins that survive one hot key."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritally.shared import new_path, written  # noqa: F401  handed on to the operators

#: ASCII white space, as Java and RE2 regular expressions write it.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: A group is hot when it holds more than 1 / HOT_SHARE of all rows, so fewer than HOT_SHARE groups are.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The input table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what is run inside: bounds the memory of rows that are large each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop_written(*frames: DataFrame) -> None:
    """Delete the files of tables made by :func:`written` that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(column: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_count(text: Column) -> Column:
    """How many words a text has (long)."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` with the columns of ``groups`` (one row per non-null ``key``, ``size`` rows of it in ``rows``).

    Keys with more than a thousandth of all rows, fewer than a thousand by that rule, are joined by broadcast; all
    others by a shuffle in which no key is hot.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    hot = groups.where(F.col(size) > max(total / HOT_SHARE, 100)).limit(HOT_SHARE)
    if hot.isEmpty():
        return rows.join(groups, key)
    keys = F.broadcast(hot.select(key))
    few = rows.join(F.broadcast(hot), key)
    many = rows.join(keys, key, "left_anti").join(groups.join(keys, key, "left_anti"), key)
    return few.unionByName(many)


def whole_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct, so that no name of them meets one that an operator uses."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns))


def one_row_each(docs: DataFrame, kept: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of ``docs`` whose ``keys`` (null equals null) are in ``kept``, one row for each combination.

    ``kept`` has a column of each name in ``keys``, and distinct rows; a key whose name no column of ``docs`` has is
    computed. Of rows that agree in all keys any one stays: they are repeated rows. Columns of any name keep their values.
    """
    names = {k: f"key_{i}" for i, k in enumerate(keys)}
    marked = docs.select(whole_row(docs).alias("carried"), *(keys[k].alias(n) for k, n in names.items()))
    mine = kept.select(*(F.col(k).alias(f"{n}k") for k, n in names.items()))
    on = [F.col(n).eqNullSafe(F.col(f"{n}k")) for n in names.values()]
    repeated = marked.groupBy(*names.values()).count().where("count > 1").drop("count")
    repeated = repeated.select(*(F.col(n).alias(f"{n}k") for n in names.values()))
    rows = marked.join(mine, on, "left_semi")
    if not repeated.isEmpty():
        rows = rows.join(repeated, on, "left_anti").unionByName(rows.join(repeated, on, "left_semi").dropDuplicates([*names.values()]))
    return rows.select("carried.*")


def running(rows: DataFrame, key: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with the sum of each of ``sums`` (longs) over the rows of its ``key`` up to it in a total order.

    Rows are dealt to ranges of key and order and added up in each. A range goes on with one key of those before it at
    most; what that key has there is added, so that one key may have any share of all rows. A null key is a key.
    """
    dealt = written(rows.repartitionByRange(F.col(key), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    names = {n: f"_{i}" for i, n in enumerate(sums)}
    parts = dealt.groupBy(key, "_range").agg(*(F.sum(c).alias(names[n]) for n, c in sums.items()))
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col(key).alias("_key"), F.col("_range").alias("_at"), *(F.sum(c).over(earlier).alias(c) for c in names.values())).where("_0 is not null")
    inside = Window.partitionBy("_range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = dealt.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()})
    told = told.join(F.broadcast(parts), (F.col("_range") == F.col("_at")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    return told.withColumns({n: F.col(n) + F.coalesce(names[n], F.lit(0)) for n in sums}).drop("_range", "_at", "_key", *names.values())


def texts_of(batch: pa.RecordBatch) -> pa.Array:
    """The texts of a batch: its column text, or that field of its column carried, so that no text travels twice."""
    return batch.column("text") if "text" in batch.schema.names else pc.struct_field(batch.column("carried"), "text")


def small_batches(batches: Iterator[pa.RecordBatch], most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices with about ``most`` bytes of text, one row at least: bounds memory."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(texts_of(batch)), 0).to_numpy(zero_copy_only=False)
        at = total = 0
        for row, n in enumerate(size.tolist()):
            if row > at and total + n > most:
                yield batch.slice(at, row - at)
                at, total = row, 0
            total += n
        if batch.num_rows:
            yield batch.slice(at)
