"""Nearest vectors by cosine: collision-counting hashing with query-centred windows.

Vectors are dealt to shards. A shard projects its unit vectors on random lines. A query looks at windows around its own
places on the lines, radius by radius, of which each widens the last (virtual rehashing); a vector that lies in enough
windows is verified, once, by its cosine. Even the narrowest windows hold a good part of a line, so what lies in them is
told by comparing all places of a shard at once, which costs less than walking through sorted lines. A query is done in a shard when its nearest ones
there lie within the radius; the last radius takes in all that are left, so no query ends with too few.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritally.llm.common import table

#: Neighbours of a query; each so-many-th vec_id is a query.
NEAREST, EVERY = 5, 50
#: Vectors of a shard (as a mean), lines of a shard, seed of the lines.
SHARD, LINES, SEED = 8192, 64, 20
#: Half a window over its radius: a vector at the radius itself falls in 79 of 100 windows, give or take; one that is in
#: SHARE of them is verified, so one at the radius is missed in 2 of 100 cases, a nearer one in fewer.
HALF, SHARE = 1.25, 0.687
#: Radii, as distances of unit vectors; the last takes in all.
RADII = (*(0.5 * 1.15**i for i in range(10)), np.inf)


def lines(size: int, n: int = LINES, seed: int = SEED) -> np.ndarray:
    """``n`` random lines for vectors of ``size`` components: the same in each task."""
    return np.random.default_rng([seed, size]).standard_normal((size, n))


def unscaled(vectors: np.ndarray) -> np.ndarray:
    """``vectors`` with the largest component of each between 1/2 and 1, by a power of two: no square overflows."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -exponent[:, None])


def cosines(vectors: np.ndarray, norms: np.ndarray, query: np.ndarray, norm: float) -> np.ndarray:
    """The cosines of ``query`` with ``vectors``; equal vectors have equal ones."""
    return np.clip((vectors * query).sum(axis=1) / (norms * norm), -1.0, 1.0)


class Shard:
    """The vectors of one size in a shard, and their places on each line."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, unscaled(vectors)
        self.norms = np.sqrt((self.vectors**2).sum(axis=1))
        self.lines = lines(vectors.shape[1])
        self.at = np.ascontiguousarray((self.vectors / self.norms[:, None] @ self.lines).T, np.float32)
        self.off, self.inside = np.empty_like(self.at), np.empty(self.at.shape, bool)

    def search(self, ids: np.ndarray, queries: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the places of its ``most`` nearest vectors found, other than those of its own id, and cosines."""
        queries = unscaled(queries)
        norms = np.sqrt((queries**2).sum(axis=1))
        centre = (queries / norms[:, None] @ self.lines).astype(np.float32)
        for i, own in enumerate(ids.tolist()):
            yield self._one(queries[i], norms[i], own, centre[i], most)

    def _hits(self, radius: float) -> np.ndarray:
        """In how many windows of a radius each vector lies."""
        np.less_equal(self.off, np.float32(HALF * radius), out=self.inside)
        return self.inside.view(np.uint8).sum(axis=0, dtype=np.uint8)

    def _one(self, query: np.ndarray, norm: float, own: int, centre: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        np.abs(np.subtract(self.at, centre[:, None], out=self.off), out=self.off)
        left = self.ids != own
        best, score = np.zeros(0, np.int64), np.zeros(0)
        enough = SHARE * len(self.at)
        # No query is done before it has ``most`` vectors; windows grow, so the first radius that gives them is bisected.
        start = bisect_left(RADII, True, hi=len(RADII) - 1, key=lambda r: np.count_nonzero((self._hits(r) >= enough) & left) >= most)
        for radius in RADII[start:]:
            new = np.flatnonzero((self._hits(radius) >= enough) & left)
            left[new] = False
            if len(new):
                best, score = np.concatenate([best, new]), np.concatenate([score, cosines(self.vectors[new], self.norms[new], query, norm)])
                first = np.lexsort((self.ids[best], -score))[:most]
                best, score = best[first], score[first]
            if len(best) == most and np.sqrt(max(0.0, 2 - 2 * score[-1])) <= radius:
                break
        return best, score


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """size, ids, vectors of the rows of ``batch`` (vec_id, vec), for each size of vector."""
    sizes = pc.list_value_length(batch.column("vec")).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes).tolist():
        part = batch.filter(pa.array(sizes == size))
        yield size, part.column("vec_id").to_numpy(), part.column("vec").flatten().to_numpy().reshape(-1, size)


def _searched(most: int):
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, ready = None, {}, {}
        for batch in batches:
            key = batch.column("shard").to_numpy() * 2 + batch.column("asks").cast(pa.int64()).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if key[a] // 2 != shard:
                    shard, held, ready = key[a] // 2, {}, {}
                for size, ids, vectors in _by_size(batch.slice(a, b - a)):
                    if key[a] % 2 == 0:
                        held.setdefault(size, []).append((ids, vectors))
                        continue
                    if size not in ready and size in held:
                        ready[size] = Shard(*(np.concatenate(x) for x in zip(*held.pop(size), strict=True)))
                    if size in ready:
                        found = [*ready[size].search(ids, vectors, most)]
                        asked = np.repeat(ids, [len(x) for x, _ in found])
                        got = ready[size].ids[np.concatenate([x for x, _ in found])]
                        yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(got), pa.array(np.concatenate([s for _, s in found]))], ["query_id", "vec_id", "score"])

    return searched


def nearest_vectors(vectors: DataFrame, queries: DataFrame, most: int = NEAREST, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the ``most`` nearest rows of ``vectors`` found for each row of ``queries``.

    Both have vec_id and embedding (an array of numbers). score is the cosine of the original vectors in double
    precision, rank counts from 1, ties go to the smaller vec_id. A query isn't compared with the rows of its own id;
    one with several vectors asks with the least of them. Rows with a null id, and vectors that are null, empty, zero or hold
    null, NaN or infinity, take no part; vectors of different sizes aren't compared. Repeated rows of ``vectors`` have a
    place each. Fewer rows than ``most``: all of them; empty tables give an empty result; other columns are not looked
    at. Every row is indexed, all queries go to every shard; recall is measured in the tests.
    """
    x = F.col("vec")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    sound = x.isNotNull() & ~bad & F.exists(x, lambda v: v != 0) & F.col("vec_id").isNotNull()
    of = lambda df: df.select("vec_id", F.col("embedding").cast("array<double>").alias("vec")).where(sound)
    rows, asked = of(vectors), of(queries).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    shards = max(1, -(-rows.count() // shard))
    dealt = rows.withColumns({"shard": F.pmod(F.xxhash64("vec_id", "vec"), F.lit(shards)).cast("int"), "asks": F.lit(False)})
    everywhere = asked.withColumns({"shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1))), "asks": F.lit(True)})
    placed = dealt.unionByName(everywhere).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "asks")
    kind = dict(vectors.dtypes)["vec_id"]
    found = placed.mapInArrow(_searched(most), f"query_id {kind}, vec_id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("query_id", "rank", "vec_id", "score")


def op11_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of each 50th one."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_vectors(vectors, vectors.where(F.col("vec_id") % EVERY == 0))
