"""SimHash near-duplicates: meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2 r bits have a common variant: one within r bits of both. Every fingerprint
emits all its variants within r = half the radius; those that meet in a variant are compared and linked. What is
shuffled is the variants of the first bits only, as (bucket, fingerprint); the task of a bucket goes on with the flips
of the other bits that are left, so each variant still meets in one place while few rows move. Linked fingerprints
then get the smallest name of their component by alternating large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.llm.common import drop_written, join_groups, one_row_each, small_batches, table, written

#: Differing bits up to which two fingerprints link.
RADIUS = 4
#: Words of a shingle.
SHINGLE = 4
#: Mean fingerprints to a bucket (before variants), and variants that a task holds at once.
BUCKET_SIZE, HELD = 256, 4_000_000


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The SimHash of a text over XXH64 (seed 42) of its shingles, A-Z lower-cased; 0 for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = min(size, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[last:].tolist(), strict=False)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = np.array(hashes[at : at + 8192], ">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """row, doc_id, text_key, fp (as a signed long) of each row of ``docs``, written to the shared folder."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            fp = np.fromiter((fingerprint(t, size) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fp.view(np.int64))], ["row", "doc_id", "text_key", "fp"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_key"), "text")
    return written(rows.mapInArrow(made, f"row long, doc_id {dict(docs.dtypes)['doc_id']}, text_key long, fp long"), "fingerprints")


def _flips(bits: int, most: int) -> np.ndarray:
    """All numbers of ``bits`` bits with at most ``most`` bits set."""
    return np.array([sum(1 << b for b in chosen) for n in range(most + 1) for chosen in combinations(range(bits), n)], np.uint64)


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def _meet(fps: np.ndarray, prefix: int, value: int, half: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions in ``fps`` that share a variant whose first ``prefix`` bits are ``value``, some at a time.

    Of the many that share one variant, only neighbours in its list are paired, which links all of them.
    """
    used = _ones((fps >> np.uint64(64 - prefix)) ^ np.uint64(value)) if prefix else np.zeros(len(fps), np.int64)
    at, rest = np.flatnonzero(used <= half), 64 - prefix
    sizes = np.array([sum(1 for n in range(half - u + 1) for _ in combinations(range(rest), n)) for u in range(half + 1)])
    if sizes[used[at]].sum() > HELD and len(at) > 1 and prefix < 63:
        for b in (0, 1):  # one more bit, so fewer at once
            yield from ((at[x], at[y]) for x, y in _meet(fps[at], prefix + 1, 2 * value + b, half))
        return
    low = np.uint64((1 << rest) - 1)
    keys, owners = [], []
    for u in range(half + 1):
        mine = at[used[at] == u]
        masks = _flips(rest, half - u)
        keys.append(((fps[mine] & low)[:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(mine, len(masks)))
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(key)
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    a, b = owner[order[same]], owner[order[same + 1]]
    pair = np.unique(np.minimum(a, b) * len(fps) + np.maximum(a, b))
    yield pair // len(fps), pair % len(fps)


def _stars(name: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``name`` (the first of each position's component so far) with the links ``a`` to ``b`` too."""
    while True:
        least = np.minimum(name[a], name[b])
        new = name.copy()
        for x in (a, b, name[a], name[b]):
            np.minimum.at(new, x, least)
        new = np.minimum(new, new[new])
        if (new == name).all():
            return name
        name = new


def _bucket_links(prefix: int, radius: int):
    def links(group: pa.Table) -> pa.Table:
        fps = group.column("fp").to_numpy().view(np.uint64)
        name = np.arange(len(fps))
        for a, b in _meet(fps, prefix, group.column("bucket")[0].as_py(), radius // 2):
            close = _ones(fps[a] ^ fps[b]) <= radius  # verified at once: only components are held, not pairs
            name = _stars(name, a[close], b[close])
        leaf = np.flatnonzero(name != np.arange(len(fps)))
        return pa.table({"a": pa.array(fps[leaf].view(np.int64)), "b": pa.array(fps[name[leaf]].view(np.int64))})

    return links


def ball_links(fps: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between the ``n`` distinct fingerprints ``fps`` (fp) that connect all within ``radius`` bits.

    Fingerprints of one bucket that are connected there come as a star, not as all pairs. ``radius`` must be even. A
    bucket has BUCKET_SIZE fingerprints as a mean, before variants, at any ``n``; those of one text's near copies,
    however many, are distinct within its ball, which has some 680,000 points at radius 4.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    half, prefix = radius // 2, max(0, (n // BUCKET_SIZE).bit_length())
    head = F.shiftrightunsigned("fp", 64 - prefix) if prefix else F.lit(0).cast("long")
    flips = F.array(*(F.lit(int(x)).cast("long") for x in _flips(prefix, half)))
    rows = fps.select("fp", head.alias("head"), F.explode(flips).alias("flip")).select(F.col("head").bitwiseXOR(F.col("flip")).alias("bucket"), "fp")
    return rows.groupBy("bucket").applyInArrow(_bucket_links(prefix, radius), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of ``links`` (a, b) is connected to; roots themselves left out.

    Large-star and small-star steps by turns, each written to the shared folder, until the links don't change. The
    minimum of a node is found by an aggregate; hubs are joined by broadcast (see join_groups).
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        if large:
            pairs = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(pairs.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"), F.count("*").alias("n")), "least")
        joined = join_groups(pairs, least, "u", "n")
        if large:
            new = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            new = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        out = written(new.where("a <> b").distinct(), "links")
        drop_written(least)
        return out

    def state(edges: DataFrame):
        return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = written(links.where("a <> b").distinct(), "links")
    seen = None
    while (now := state(edges)) != seen:
        seen = now
        if not now[0]:
            break
        for large in (True, False):
            before, edges = edges, star(edges, large)
            drop_written(before)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_groups(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, n, root, component_id, keep (struct of doc_id, row, text_key) of each distinct fingerprint of ``rows``."""
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "text_key")
    fps = written(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least_id"), F.min(first).alias("first")), "distinct-fp")
    roots = components(ball_links(fps.select("fp"), fps.count(), radius))
    named = written(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted-fp")
    whole = named.groupBy("root").agg(F.min("least_id").alias("component_id"), F.min("first").alias("keep"), F.count("*").alias("fps"))
    drop_written(fps)
    return join_groups(named.select("fp", "n", "root"), written(whole, "near-components"), "root", "fps").drop("fps")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of ``docs`` (doc_id, text).

    Fingerprints within ``radius`` bits link; component_id is the smallest doc_id that links lead to, null if none of
    them has one. A text that is null or without words has fingerprint 0, linked like any other; texts are
    read whole, some 2 MB of them at a time. Repeated rows are all
    returned; an empty table gives an empty result; other columns are not looked at.
    """
    rows = fingerprints(docs, size)
    groups = written(near_groups(rows, radius).select("fp", "n", "component_id"), "near-groups")
    out = join_groups(rows.select("doc_id", "fp"), groups, "fp", "n")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_stage(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest doc_id, with all its columns."""
    groups = near_groups(fingerprints(docs, size), radius)
    kept = written(groups.select("keep.doc_id", "keep.text_key").distinct(), "near-kept")
    return one_row_each(docs, kept, {"doc_id": F.col("doc_id"), "text_key": F.xxhash64("text")})


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest document of its component."""
    return near_duplicates(table(spark, sf_dir, "documents"))
