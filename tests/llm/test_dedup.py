"""Exact, near and passage deduplication against brute force."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from veritally.llm import exact, simhash, suffix


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact(docs, rows):
    got = sorted((tuple(r) for r in exact.exact_duplicates(docs, fan_bits=1).collect()), key=str)
    groups = defaultdict(list)
    for r in rows:
        groups[normal(r[1])].append(r[0])
    want = []
    for text, ids in groups.items():
        named = sorted(i for i in ids if i is not None)
        least = named[0] if named else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        first = True
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            want.append((i, least, len(ids), first, digest))
            first = False
    assert got == sorted(want, key=str)


def test_exact_merges_runs(spark):
    """Thousands of rows in 40 files, one text in a third of them, over many parts, ranges and rounds."""
    mine = [(i, "same  text" if i % 3 == 0 else f"text {i % 2000}") for i in range(9000)]
    frame = spark.createDataFrame(mine, "doc_id long, text string").repartition(40)
    least = {}
    for i, text in mine:
        least.setdefault(normal(text), i)
    count = Counter(normal(t) for _, t in mine)
    want = {i: (least[normal(t)], count[normal(t)], least[normal(t)] == i) for i, t in mine}
    rows = exact.digests(frame)
    for settings in ({}, {"part_rows": 100, "block_rows": 10}, {"part_rows": 500, "block_rows": 100, "fan_bits": 1}):
        groups = exact.merge_digests(rows, **settings).collect()
        assert len(groups) == len(count) and {r["keep_id"]: r["n"] for r in groups} == {i: count[t] for t, i in least.items()}
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact.exact_duplicates(frame).collect()}
    assert got == want
    damaged = rows.withColumn("verify", F.col("row"))
    with pytest.raises(PythonException):
        exact.merge_digests(damaged).count()


def test_exact_stage(docs, rows, empty):
    kept = exact.exact_stage(docs)
    assert kept.columns == docs.columns
    assert sorted(normal(r["text"]) for r in kept.collect()) == sorted({normal(r[1]) for r in rows})
    assert exact.exact_stage(empty).count() == exact.exact_duplicates(empty).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=4):
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_near(docs, rows, empty):
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str)
    fps = [brute_fingerprint(r[1]) for r in rows]
    root = brute_components(fps)
    least = {}
    for r, f in zip(rows, fps, strict=True):
        if r[0] is not None:
            least[root[f]] = min(least.get(root[f], r[0]), r[0])
    assert got == sorted(((r[0], f"{f:016x}", least.get(root[f])) for r, f in zip(rows, fps, strict=True)), key=str)
    kept = simhash.near_stage(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root.values()))
    assert simhash.near_duplicates(empty).count() == simhash.near_stage(empty).count() == 0


def test_ball_links_find_all_pairs(spark):
    r = random.Random(3)
    fps = set()
    for _ in range(30):
        f = r.getrandbits(64)
        fps.add(f)
        for flips in (1, 3, 4, 5):
            g = f
            for b in r.sample(range(64), flips):
                g ^= 1 << b
            fps.add(g)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    for n in (len(fps), 1 << 14):  # few and many buckets give the same components
        roots = {x["node"]: x["root"] for x in simhash.components(simhash.ball_links(frame, n)).collect()}
        classes = defaultdict(set)
        for x in signed:
            classes[roots.get(x, x)].add(x % (1 << 64))
        want = defaultdict(set)
        for f, g in brute_components(fps).items():
            want[g].add(f)
        assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want.values()))


def brute_repeats(rows, length):
    """Bytes covered by a string that starts earlier; rows in order of doc_id (null last), then of the hash of the text."""
    seen, out = set(), []

    def order(row):
        return row[0] is None, row[0] or 0, xxhash.xxh64_intdigest((row[1] or "").encode(), 42) + 2**63 & 2**64 - 1

    for doc_id, text in sorted(rows, key=order):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


SUFFIX = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_suffix(spark, docs, rows, empty):
    """Null and repeated rows, one doc_id with several texts, clashing columns, texts longer than a chunk."""
    want = brute_repeats([r[:2] for r in rows], 100)
    for settings in ({}, {"chunk": 3000, "shard": 50, "sent": 2000, "array": 1000}, {"chunk": 700, "places": (1, 1 << 14)}, {"chunk": 400, "places": (1, 2)}):
        got = suffix.remove_repeats(docs, **settings).select(*SUFFIX).collect()
        assert Counter(map(tuple, got)) == want
    assert suffix.remove_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        suffix.remove_repeats(docs.selectExpr("string(doc_id) as doc_id", "text"))
    kept = suffix.remove_repeats(docs, chunk=700, with_text=True).collect()
    assert all(hashlib.sha256(r["kept_bytes"]).hexdigest() == r["kept_sha256"] for r in kept)


def test_suffix_of_one_anchor_in_many_contexts(spark):
    """A passage of 60, and of 110, bytes between other bytes in thousands of rows, some rows alike."""
    r = random.Random(3)
    common = ["".join(r.choice("abcdefgh ") for _ in range(n)) for n in (60, 110, 97)]
    own = ["".join(r.choice("ijklmnop") for _ in range(80)) for _ in range(900)]
    mine = [(i, own[i % 900] + common[i % 3] + own[(i * 7) % 450]) for i in range(3000)]
    frame = spark.createDataFrame(mine, "doc_id long, text string").repartition(3)
    want = brute_repeats(mine, 100)
    for settings in ({}, {"chunk": 20_000, "places": (100, 1 << 14)}, {"chunk": 20_000, "places": (100, 200), "array": 5000}):
        assert Counter(map(tuple, suffix.remove_repeats(frame, **settings).select(*SUFFIX).collect())) == want


def test_suffix_array():
    """Against sorting, by both ways of induction, with runs, periods and thousands of names."""
    r = np.random.default_rng(1)
    made = [r.integers(1, k + 1, n) for n, k in ((0, 1), (1, 2), (50, 2), (300, 3), (400, 200), (5000, 2), (20_000, 4), (30_000, 250))]
    made += [np.ones(3000, int), np.tile([1, 2], 2000), np.tile(r.integers(1, 200, 6000), 2), np.repeat(r.integers(1, 9, 50), 100)]
    for body in made:
        s = np.append(body, 0).astype(np.uint16)
        raw = s.astype(np.uint8).tobytes()
        want = sorted(range(len(s)), key=lambda i: raw[i:])
        for waves in (1, 1 << 40):
            suffix._WAVES, kept = waves, suffix._WAVES
            try:
                assert suffix.suffix_array(s, 256).tolist() == want
            finally:
                suffix._WAVES = kept
        prefix = suffix.permuted_prefixes(s, np.array(want))
        for a, b in zip(want[:400], want[1:401], strict=False):
            assert prefix[b] == len(os.path.commonprefix([raw[a:], raw[b:]]))


def test_suffix_array_recurses(monkeypatch):
    """The names of 6,000 symbols in repeats are ordered by the same sorting, level by level."""
    r = np.random.default_rng(2)
    s = np.append(np.tile(r.integers(1, 200, 6000), 3), 0).astype(np.uint16)
    sizes, whole = [], suffix.suffix_array
    monkeypatch.setattr(suffix, "suffix_array", lambda x, n: sizes.append(len(x)) or whole(x, n))
    suffix.suffix_array(s, 200)
    assert sizes[0] == len(s) and sizes[1] > 1024 and all(2 * b <= a for a, b in zip(sizes, sizes[1:], strict=False))
