"""Audit of how far the sources of a language differ: sketch-prefiltered counting.

A count-min sketch of document frequencies is made in each task and merged by sums. It never tells too few, so terms
that it puts below the least document frequency can't be kept, and no task sends them on. What is left is counted
exactly; a join of the sources that share a term then gives what a pair's sum of differences has beyond closed forms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritally.llm.common import small_batches, table, written

#: Documents of a lang in which a term must occur, added to each count, scale of a share, terms told of a source.
LEAST, PRIOR, SCALE, TOLD = 30, 5, 1_000_000_000, 50
#: Rows of the sketch; cells of a row for each document, at least and at most (a byte each, so 64 MiB at most).
ROWS, CELLS, FEW, MANY = 4, 32, 1 << 14, 1 << 24
#: A cell stops here; cells of a block that is sent on its own.
FULL, BLOCK = 255, 1 << 14
#: Terms that a task holds before it hands them on.
HELD = 500_000
#: A-Z lower-cased; other ASCII characters that aren't letters become a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: runs of letters and of characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_FOLD).split()


def sketch_width(docs: int) -> int:
    """Cells of a row of the sketch for so many documents; a power of two."""
    return min(MANY, max(FEW, 1 << (docs * CELLS - 1).bit_length())) if docs else FEW


def _places(lang: str, names: list[bytes], width: int) -> np.ndarray:
    """The cell of each term in each row of the sketch."""
    seed = xxhash.xxh64_intdigest(lang) & 0xFFFFFFFF
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(n, seed) for n in names), np.uint64, len(names))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(r) * step) & np.uint64(width - 1) for r in range(ROWS)]).astype(np.int64)


def document_frequencies(docs: DataFrame, width: int) -> DataFrame:
    """block, cells (a byte each): the merged sketch over ``docs`` (lang, text as UTF-8), blocks of zeros left out.

    A task merges the blocks that it gets as they come, so it holds no more than its part of the sketch.
    """

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((ROWS, width), np.uint8)

        def add(held: dict[str, Counter]) -> None:
            for lang, found in held.items():
                n = np.minimum(np.fromiter(found.values(), np.int64, len(found)), FULL)
                for r, at in enumerate(_places(lang, list(found), width)):
                    where, inverse = np.unique(at, return_inverse=True)
                    sums = np.bincount(inverse, n) + cells[r, where]
                    cells[r, where] = np.minimum(sums, FULL).astype(np.uint8)

        held: dict[str, Counter] = {}
        for batch in small_batches(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(set(terms(text)))
            if sum(map(len, held.values())) > HELD:
                add(held)
                held = {}
        add(held)
        parts = cells.reshape(-1, min(BLOCK, width))
        for block in np.flatnonzero(parts.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([parts[block].tobytes()])], ["block", "cells"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column("block").to_pylist(), batch.column("cells"), strict=True):
                more = np.frombuffer(part.as_buffer(), np.uint8)
                before = whole.get(block)
                whole[block] = more.copy() if before is None else before + np.minimum(more, FULL - before)
        for block, part in whole.items():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part.tobytes()])], ["block", "cells"])

    kind = "block long, cells binary"
    return docs.select("lang", "text").mapInArrow(sketched, kind).repartition("block").mapInArrow(merged, kind)


def _held(sketch: DataFrame, width: int) -> Broadcast:
    """The sketch on every machine: ROWS * ``width`` bytes, 64 MiB at most at any size of input."""
    cells = np.zeros((ROWS * width // min(BLOCK, width), min(BLOCK, width)), np.uint8)
    for row in sketch.toLocalIterator():
        cells[row["block"]] = np.frombuffer(row["cells"], np.uint8)
    return sketch.sparkSession.sparkContext.broadcast(cells.reshape(ROWS, width))


def possible_counts(docs: DataFrame, sketch: Broadcast, width: int, least: int = LEAST) -> DataFrame:
    """lang, source, term, n (occurrences), df (documents) over ``docs`` (lang, source, text as UTF-8), some rows each.

    Only of terms that the sketch can't put below ``least`` documents of the lang; a task adds up what it holds first.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = sketch.value

        def told(held: dict) -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in held.items():
                names = list(n)
                most = np.full(len(names), FULL, np.uint8)
                for r, at in enumerate(_places(lang, names, width)):
                    most = np.minimum(most, cells[r, at])
                kept = [names[i] for i in np.flatnonzero(most >= min(least, FULL)).tolist()]
                if kept:
                    m = len(kept)
                    columns = [pa.repeat(pa.scalar(x, pa.string()), m) for x in (lang, source)]
                    columns += [pa.array(kept, pa.binary()).cast(pa.string()), pa.array([n[k] for k in kept], pa.int64()), pa.array([df[k] for k in kept], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "df"])

        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in small_batches(batches):
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                n, df = held.setdefault((lang, source), (Counter(), Counter()))
                found = terms(text)
                n.update(found)
                df.update(set(found))
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from told(held)
                held = {}
        yield from told(held)

    return docs.select("lang", "source", "text").mapInArrow(counted, "lang string, source string, term string, n long, df long")


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept)); whole numbers throughout."""
    whole = "decimal(38,0)"
    over = (total + PRIOR * kept).cast(whole)
    return F.when(over > 0, 1 + F.call_function("div", F.lit(SCALE).cast("decimal(11,0)") * (count + PRIOR).cast("decimal(20,0)"), over)).otherwise(F.lit(1))


def source_divergence(docs: DataFrame, least: int = LEAST, told: int = TOLD) -> DataFrame:
    """lang, source, part, item, value, rank: how the shares of terms of each (lang, source) differ from others'.

    Reads all of ``docs`` (text, lang, source), null as empty. A lang keeps the terms in ``least`` of its documents or
    more. Part ``pair``: for each other source of the lang, the sum over kept terms of the differences of shares. Part
    ``term``: kept terms that the source uses more than its lang as a whole, by the difference, ``told`` at most. Groups
    without terms are groups; a lang without kept terms has 0 for every pair. Equal values are ranked by item in UTF-8.
    Repeated rows count each; texts are read whole, some 2 MB of them at a time; an empty table gives an empty result;
    other columns are not looked at.
    """
    rows = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    groups = written(rows.groupBy("lang", "source").agg(F.count("*").alias("docs")), "groups")
    width = sketch_width(groups.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0])
    sketch = _held(written(document_frequencies(rows, width), "sketch"), width)
    counts = possible_counts(rows, sketch, width, least).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    counts = written(counts, "term-counts")
    sketch.unpersist()
    kept = written(counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("df").alias("df")).where(F.col("df") >= least).drop("df"), "kept-terms")
    found = written(counts.drop("df").join(kept, ["lang", "term"]), "kept-counts")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    totals = groups.drop("docs").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "v", "total_lang"])
    totals = written(totals.withColumn("p0", _share(F.lit(0), F.col("total"), F.col("v")).cast("long")), "group-totals")
    p, q = _share(F.col("n"), F.col("total"), F.col("v")), _share(F.col("n_lang"), F.col("total_lang"), F.col("v"))
    shares = written(found.join(totals, ["lang", "source"]).select("lang", "source", "term", "n", "p0", p.cast("long").alias("p"), q.cast("long").alias("q")), "shares")
    more = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    # Filtered by the row number itself, so each task hands on ``told`` rows a group.
    more = more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= told)
    pairs = source_distances(shares, totals).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(more)


def source_distances(shares: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, source, other, value for each ordered pair of sources of a lang: the sum of |p - p'| over all kept terms.

    ``totals``: lang, source, v, p0 (the share of a term that the source lacks); ``shares``: lang, source, term, n, p of
    the terms that it has. Were all terms lacking in both, the sum would be v * |p0 - p0'|. What the terms of one source
    change while the other lacks them follows from how many terms have each n; only what a term in both changes takes
    the join, whose rows are added up where they are made.
    """
    a, b = totals.select("lang", "source", F.col("p0"), "v"), totals.select("lang", F.col("source").alias("other"), F.col("p0").alias("p0_other"))
    pairs = a.join(b, "lang").where("source <> other")
    flat = F.abs(F.col("p0") - F.col("p0_other"))
    by_n = shares.groupBy("lang", "source", "n", "p", "p0").agg(F.count("*").alias("k"))
    one = by_n.join(b, "lang").where("source <> other").groupBy("lang", "source", "other").agg(F.sum(F.col("k") * (F.abs(F.col("p") - F.col("p0_other")) - flat)).alias("x"))
    x = shares.select("lang", "term", "source", "p", "p0")
    y = shares.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("p_other"), F.col("p0").alias("p0_other"))
    change = F.abs(F.col("p") - F.col("p_other")) - F.abs(F.col("p") - F.col("p0_other")) - F.abs(F.col("p0") - F.col("p_other")) + flat
    both = x.join(y, ["lang", "term"]).where("source < other").groupBy("lang", "source", "other").agg(F.sum(change).alias("x"))
    there, back = ["lang", "source", "other"], ["lang", F.col("other").alias("source"), F.col("source").alias("other")]
    parts = pairs.select(*there, (F.col("v") * flat).alias("x"))
    for df in (one, both):
        parts = parts.unionByName(df.select(*there, "x")).unionByName(df.select(*back, "x"))
    return parts.groupBy(*there).agg(F.sum("x").alias("value"))


OP12_SQL = r"""
with d as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
w as (
  select doc_id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term, count(*) as n_lang from w group by lang, term having count(distinct doc_id) >= 30),
v as (select lang, count(*) as v, sum(n_lang) as total_lang from kept group by lang),
groups as (select distinct lang, source from d),
n as (select lang, source, term, count(*) as n from w group by all),
cells as (
  select g.lang, g.source, k.term, coalesce(n.n, 0) as n, k.n_lang, v.v, v.total_lang, sum(coalesce(n.n, 0)) over (partition by g.lang, g.source) as total
  from groups g join kept k using (lang) join v using (lang) left join n on n.lang = g.lang and n.source = g.source and n.term = k.term),
shares as (
  select lang, source, term, n, 1 + (1000000000::hugeint * (n + 5)) // (total + 5 * v)::hugeint as p, 1 + (1000000000::hugeint * (n_lang + 5)) // (total_lang + 5 * v)::hugeint as q from cells),
pairs as (
  select a.lang, a.source, b.source as item, coalesce((select sum(abs(x.p - y.p)) from shares x join shares y using (lang, term) where x.lang = a.lang and x.source = a.source and y.source = b.source), 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source),
parts as (
  select lang, source, 'pair' as part, item, value from pairs
  union all select lang, source, 'term', term, p - q from shares where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from parts)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked where part = 'pair' or rank <= 50
"""


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source's terms are from those of the other sources and of the whole of its language."""
    return source_divergence(table(spark, sf_dir, "documents"))
