"""Suffix-array deduplication of repeated passages, by induced sorting.

A byte goes when it lies in a string of LENGTH bytes that also starts earlier. Equal strings share the position of
their least k-gram by hash (the anchor), so anchors deal strings to shards, and each shard has its own suffix array:

1. Documents are packed into chunks of bytes, a long one into pieces. Each chunk tells its anchors; a shuffle by anchor
   tells the chunks which of them another place has too, and at how many places. Text at other anchors repeats nothing.
2. Around each shared anchor a chunk sends its segment: the bytes of all strings that have this anchor, one copy of
   each content with its first place (the chunk's later places of it repeat that one). An anchor of many places is
   dealt further by the bytes beside it: its strings are cut into runs by where the anchor stands in them, and a run
   goes by all the bytes that its strings have in common.
3. A shard orders all suffixes of the contents that meet another one at their key (one that is alone there, in any
   number of places, repeats as a whole): suffixes are classified, leftmost-smaller substrings are sorted by
   induction and named by comparison, their order is found by the same recursively, and all suffixes are induced from
   it; common prefixes are computed in text order, each carried on from the one before. Of equal strings the first
   stays. Contents go through arrays of at most ARRAY bytes, whole anchors together.
4. What is to be removed goes back to the chunks, which cut it out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritally.llm.common import drop_written, rows_per_batch, table, text_of, written

#: Bytes of a repeated string, of an anchor's k-gram, of a chunk, and anchors to a shard that counts them.
LENGTH, GRAM, CHUNK, SHARD = 100, 32, 1 << 20, 400_000
#: Bytes of segments that a shard gets as a mean, and most bytes of one suffix array.
SENT, ARRAY = 4 << 20, 2 << 20
#: Up to so many places an anchor's strings go together; up to the next, in four runs; beyond, one by one. So what goes
#: by one key is less than an array: 4,096 * 168 bytes, 16,384 * 117 bytes, or copies of one string.
PLACES = (1 << 12, 1 << 14)
#: Chunks whose anchors travel in one row; contents of crowded anchors whose first place a task remembers.
_TOGETHER, _KEPT = 32, 200_000
#: Chunks of an Arrow batch.
_BATCH = 4
#: Symbols a bucket holds as a mean from which on whole buckets are induced at once.
_WAVES = 512

_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


# Suffix arrays


def suffix_types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (S); the last, a single least symbol, is."""
    step = np.sign(s[1:].astype(np.int64) - s[:-1])
    change = np.flatnonzero(step)  # the last symbol is the least, so one follows every position
    return np.append(np.repeat(step[change] > 0, np.diff(change, prepend=-1)), True)


def _by_waves(s: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Induction of whole waves of a bucket: what one wave puts into its own bucket is the next."""
    sa = np.zeros(len(s), np.int32)
    head, tail = starts.copy(), ends - 1
    seed_ends = np.searchsorted(s[seeds], np.arange(len(starts)), "right")
    occupied = np.flatnonzero(ends > starts)

    def put(found: np.ndarray, kind: bool, slot: np.ndarray, way: int) -> None:
        found = found[found > 0] - 1
        found = found[smaller[found] == kind]
        order = np.argsort(s[found], kind="stable")
        symbol = s[found[order]]
        n = np.bincount(symbol, minlength=len(slot))
        nth = np.arange(len(order)) - (np.cumsum(n) - n)[symbol]
        sa[slot[symbol] + way * nth] = found[order]
        slot += way * n

    for c in occupied.tolist():
        at = int(starts[c])
        while at < head[c]:
            wave, at = sa[at : head[c]].copy(), int(head[c])
            put(wave, False, head, 1)
        put(seeds[(seed_ends[c - 1] if c else 0) : seed_ends[c]], False, head, 1)
    sa[0] = len(s) - 1  # the last suffix, which no other induces
    tail[s[-1]] -= 1
    for c in occupied[::-1].tolist():
        at = int(ends[c]) - 1
        if c == s[-1]:
            put(sa[:1].copy(), True, tail, -1)
            continue
        while at > tail[c]:
            wave, at = sa[tail[c] + 1 : at + 1][::-1].copy(), int(tail[c])
            put(wave, True, tail, -1)
        put(sa[starts[c] : head[c]][::-1].copy(), True, tail, -1)
    return sa


def _one_by_one(s: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Induction suffix by suffix, for alphabets whose buckets hold few of them."""
    n = len(s)
    symbol = s[seeds]
    order = np.full(n, n, np.int32)
    order[ends[symbol] - (np.cumsum(np.bincount(symbol))[symbol] - np.arange(len(seeds)))] = seeds
    sa = order.tolist()
    before = np.concatenate([[-1], s[:-1], [-1]]).astype(np.int32)
    is_s = np.concatenate([[False], smaller[:-1], [False]])
    bucket, slot = np.where(is_s, -1, before).tolist(), starts.tolist()
    for i in sa:
        c = bucket[i]
        if c >= 0:
            at = slot[c]
            sa[at] = i - 1
            slot[c] = at + 1
    bucket, slot = np.where(is_s, before, -1).tolist(), (ends - 1).tolist()
    for i in reversed(sa):
        c = bucket[i]
        if c >= 0:
            at = slot[c]
            sa[at] = i - 1
            slot[c] = at - 1
    return np.array(sa, np.int32)


def induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes, induced from leftmost-smaller ones in the order ``lms``."""
    ends = np.cumsum(np.bincount(s, minlength=symbols))
    starts = np.append(0, ends[:-1])
    seeds = lms[np.argsort(s[lms], kind="stable")].astype(np.int32)
    way = _by_waves if len(s) >= _WAVES * symbols else _one_by_one
    return way(s, smaller, seeds, starts, ends)


def _names(s: np.ndarray, found: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Numbers of the sorted substrings (``length`` symbols and one more), equal ones alike, by comparison."""
    a, b = found[:-1], found[1:]
    new = length[1:] != length[:-1]
    alike = np.flatnonzero(~new)
    for i in alike[length[alike] > 32].tolist():
        n = length[i] + 1
        new[i] = not np.array_equal(s[a[i] : a[i] + n], s[b[i] : b[i] + n])
    alike = alike[length[alike] <= 32]
    for k in range(33):
        alike = alike[length[alike] >= k]
        differ = s[a[alike] + k] != s[b[alike] + k]
        new[alike[differ]] = True
        alike = alike[~differ]
        if not len(alike):
            break
    return np.append(0, np.cumsum(new))


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix array of ``s`` (symbols from 0), whose last symbol is 0 and stands nowhere else."""
    if len(s) < 2:
        return np.arange(len(s), dtype=np.int32)
    smaller = suffix_types(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    found = induce(s, smaller, lms, symbols)
    found = found[is_lms[found]]  # leftmost-smaller substrings in order
    nth = np.zeros(len(s), np.int32)
    nth[lms] = np.arange(len(lms))
    name = _names(s, found, np.append(lms[1:], len(s) - 1)[nth[found]] - found)
    if name[-1] < len(lms) - 1:
        names = np.empty(len(lms), np.int32)
        names[nth[found]] = name
        found = lms[suffix_array(names, int(name[-1]) + 1)]
    return induce(s, smaller, found, symbols)


def permuted_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position, in text order, how many symbols it shares with the suffix sorted before it.

    Where the symbols before a position and before its neighbour agree, the prefix is one less than that of the
    position before; only the others are compared, four symbols (of 16 bits) at a time.
    """
    n = len(s)
    previous = np.full(n, -1, np.int64)
    previous[sa[1:]] = sa[:-1]
    carried = np.zeros(n, bool)
    at = np.flatnonzero(previous[1:] > 0) + 1
    carried[at] = s[at - 1] == s[previous[at] - 1]
    at = np.flatnonzero(~carried & (previous >= 0))
    first = at
    other = previous[at]
    padded = np.concatenate([s.astype("<u2"), np.zeros(4, "<u2")])
    words = np.lib.stride_tricks.sliding_window_view(padded, 4)
    prefix = np.zeros(n, np.int64)
    alive = np.arange(len(at))
    while len(alive):
        x, y = (np.ascontiguousarray(words[p]).view("<u8")[:, 0] for p in (at, other))
        differ = x ^ y
        same = (differ == 0).astype(np.int64)
        for bits in (48, 32, 16):
            same += differ << np.uint64(bits) == 0
        prefix[first[alive]] += same
        more = (same == 4) & (np.maximum(at, other) + 4 < n)
        at, other, alive = at[more] + 4, other[more] + 4, alive[more]
    start = np.maximum.accumulate(np.where(carried, 0, np.arange(n)))
    return np.maximum(prefix[start] - (np.arange(n) - start), 0)


# Chunks


def _pack(batches: Iterator[pa.RecordBatch], size: int, length: int) -> Iterator[pa.RecordBatch]:
    """Rows of whole documents up to ``size`` bytes together; a longer one as rows of one number.

    ``base`` is where a row's bytes begin in its document. Pieces overlap by length - 1 bytes, so that each string
    lies whole in the piece it starts in; ``own`` leaves out what the next piece has too.
    """
    rows: list = []
    part = total = number = 0

    def row(docs: list, data: list, base: int, own: int, piece: bool = False) -> pa.RecordBatch:
        ids, ties = [d[0] for d in docs], [d[1] for d in docs]
        columns = [pa.array([part * (1 << 32) + number], pa.int64()), pa.array([piece]), pa.array([base], pa.int64()), pa.array([own], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([ties], pa.list_(pa.int64())), pa.array([[len(t) for t in data]], pa.list_(pa.int64())), pa.array([b"".join(data)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "piece", "base", "own", "doc_ids", "ties", "lengths", "bytes"])

    for batch in batches:
        kind = batch.column("doc_id").type
        for p, doc_id, tie, text in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist(), batch.column("text"), strict=True):
            raw = text.as_py().encode()
            if rows and total + len(raw) > size:
                yield row([r[0] for r in rows], [r[1] for r in rows], 0, total)
                rows, total, number = [], 0, number + 1
            part = p
            if len(raw) <= size:
                rows.append(((doc_id, tie), raw))
                total += len(raw)
                continue
            for base in range(0, len(raw), size):
                yield row([(doc_id, tie)], [raw[base : base + size + length - 1]], base, min(size, len(raw) - base), True)
            number += 1
    if rows:
        yield row([r[0] for r in rows], [r[1] for r in rows], 0, total)


def pack_documents(docs: DataFrame, size: int = CHUNK, length: int = LENGTH) -> DataFrame:
    """The texts of ``docs`` as chunks of bytes, see :func:`_pack`; written."""
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise ValueError(f"doc_id is {kind.simpleString()}, not an integer")
    kind = "long" if isinstance(kind, T.NullType) else kind.simpleString()
    text = text_of("text")
    rows = docs.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast(kind).alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    schema = f"chunk long, piece boolean, base long, own long, doc_ids array<{kind}>, ties array<long>, lengths array<long>, bytes binary"
    return written(rows.mapInArrow(lambda b: _pack(b, size, length), schema), "chunks")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    out = []
    for base in (_ODD, np.uint64(pow(int(_ODD), -1, 1 << 64))):
        p = np.full(n, base, np.uint64)
        p[:1] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


class _Hashes:
    """Hashes of any range of some bytes; equal ones have equal hashes, and a clash brings strings together in vain."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _powers(len(data) + 1)
        self.sums = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)]))

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[begin]) * self.down[begin]
        h = (h ^ (h >> np.uint64(31))) * _MIX
        return h ^ (h >> np.uint64(29))


def _segments(data: np.ndarray, lengths: np.ndarray, length: int, gram: int) -> tuple[_Hashes | None, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each run of strings that have one anchor: its hash, its position, document, first string, and the run's end.

    The run's bytes are from its first string to the end: the last string of the run ends there.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length or lengths.max(initial=0) < length:
        return None, none.astype(np.uint64), none, none, none, none
    hashes = _Hashes(data)
    at = np.arange(n - gram + 1)
    h = hashes.of(at, at + gram)
    # The least hash of each string's k-grams, the first of equal ones: the position stands in the low bits.
    low = np.uint64(max(1, n.bit_length()))
    least = (h >> low << low) | at.astype(np.uint64)
    width, reach = length - gram + 1, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if rest := width - reach:
        least = np.minimum(least[:-rest], least[rest:])
    anchor = (least & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)[: n - length + 1]
    valid = np.arange(n - length + 1) + length <= ends[doc]
    new = valid & np.append(True, (anchor[1:] != anchor[:-1]) | ~valid[:-1] | (doc[1:] != doc[:-1]))
    first = np.flatnonzero(new)
    stops = np.append(np.where(valid[:-1] & (new[1:] | ~valid[1:]), np.arange(1, len(valid)), 0), len(valid) if valid[-1] else 0)
    return hashes, h[anchor[first]], anchor[first], doc[first], first, stops[stops > 0] + length - 1


def _read(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(batch.column("bytes")[row].as_py() or b"", np.uint8)
    return data, np.array(batch.column("lengths")[row].as_py(), np.int64)


def _alike(keys: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal numbers."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist() if len(keys) else []
    return list(zip(first, [*first[1:], len(keys)], strict=False))


def shared_anchors(chunks: DataFrame, shards: int, length: int = LENGTH, gram: int = GRAM, places: tuple[int, int] = PLACES) -> DataFrame:
    """chunk, base, n, shared: packed hashes of the anchors that occur more than once anywhere, each with its crowd.

    The crowd of an anchor is 0, 1 or 2: how many of ``places`` its number of places is above. Written.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            key = np.concatenate([k for _, _, k, _ in held])
            n = np.concatenate([c for _, _, _, c in held]).astype("<u4")
            of = np.repeat(np.arange(len(held), dtype="<u4"), [len(k) for _, _, k, _ in held])
            shard = (key % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            key, n, of, shard = key[order], n[order], of[order], shard[order]
            parts = _alike(shard)
            who = [[list(x) for x in ((c for c, _, _, _ in held), (b for _, b, _, _ in held))]] * len(parts)
            columns = [pa.array([int(shard[a]) for a, _ in parts], pa.int64()), pa.array([w[0] for w in who], pa.list_(pa.int64())), pa.array([w[1] for w in who], pa.list_(pa.int64()))]
            columns += [pa.array([x[a:b].tobytes() for a, b in parts], pa.binary()) for x in (of, key, n)]
            return pa.RecordBatch.from_arrays(columns, ["shard", "chunks", "bases", "owner", "keys", "counts"])

        for batch in batches:
            for row in range(batch.num_rows):
                key, n = np.unique(_segments(*_read(batch, row), length, gram)[1], return_counts=True)
                held.append((batch.column("chunk")[row].as_py(), batch.column("base")[row].as_py(), key, n))
                if len(held) == _TOGETHER:
                    yield flush()
                    held = []
        if held:
            yield flush()

    def compared(group: pa.Table) -> pa.Table:
        owner, key, n = (np.frombuffer(b"".join(group.column(c).to_pylist()), k) for c, k in (("owner", "<u4"), ("keys", "<u8"), ("counts", "<u4")))
        each = np.array([len(x) // 8 for x in group.column("keys").to_pylist()])
        row = np.repeat(np.arange(len(each)), each)
        _, of = np.unique(key, return_inverse=True)
        total = np.bincount(of, weights=n)[of]
        mine = np.flatnonzero(total > 1)
        crowd = ((total > places[0]).astype(np.uint8) + (total > places[1]))[mine]
        mine_key = key[mine]
        whose = row[mine] * _TOGETHER + owner[mine]
        parts = _alike(whose)  # rows hold their chunks in order
        chunk, base = group.column("chunks").to_pylist(), group.column("bases").to_pylist()
        where = [divmod(int(whose[a]), _TOGETHER) for a, _ in parts]
        packed = [mine_key[a:b].astype("<u8").tobytes() + crowd[a:b].tobytes() for a, b in parts]
        return pa.table({"chunk": pa.array([chunk[r][o] for r, o in where], pa.int64()), "base": pa.array([base[r][o] for r, o in where], pa.int64()), "n": pa.array([len(p) // 9 for p in packed], pa.int64()), "shared": pa.array(packed, pa.binary())})

    parts = chunks.mapInArrow(told, "shard long, chunks array<long>, bases array<long>, owner binary, keys binary, counts binary")
    back = parts.groupBy("shard").applyInArrow(compared, "chunk long, base long, n long, shared binary")
    with rows_per_batch(chunks.sparkSession, _BATCH):
        return written(back.groupBy("chunk", "base").agg(F.sum("n").alias("n"), F.collect_list("shared").alias("shared")), "anchors")


#: A place: its content, document of the chunk, start in it, and what orders documents.
_PLACE = {"content": "<i4", "doc": "<i4", "at": "<i8", "id": "<i8", "tie": "<i8"}


def _runs(hashes: _Hashes, crowd: np.ndarray, key: np.ndarray, anchor: np.ndarray, doc: np.ndarray, first: np.ndarray, stop: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Segments with those of crowded anchors cut into runs, each keyed by the bytes that all its strings have."""
    out = [[x[crowd == 0] for x in (key, doc, first, stop, crowd)]]
    positions = length - gram + 1
    for level, width in ((1, -(-positions // 4)), (2, 1)):
        mine = np.flatnonzero(crowd == level)
        if not len(mine):
            continue
        for low in range(0, positions, width):  # bytes of a string before its anchor: low to high
            high = min(low + width, positions) - 1
            begin = np.maximum(first[mine], anchor[mine] - high)
            last = np.minimum(stop[mine] - length, anchor[mine] - low)
            some = begin <= last
            at = mine[some]
            salt = np.uint64((low * 2 + 1) * int(_MIX) & 0xFFFFFFFFFFFFFFFF)
            told = hashes.of(anchor[at] - low, anchor[at] - high + length) ^ salt
            out.append([told, doc[at], begin[some], last[some] + length, crowd[at]])
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _send(batches: Iterator[pa.RecordBatch], shards: int, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Segments at shared anchors, by shard: keys, contents and first places; and what repeats a place known here.

    Rows come in order of chunk, so a task that runs again tells the same.
    """
    press = zstandard.ZstdCompressor(level=1).compress
    seen: dict[tuple[int, bytes], tuple] = {}  # first places of contents at crowded anchors
    names = ["chunk", "shard", "keys", "sizes", "contents", "places", "spans"]
    for batch in batches:
        for row in range(batch.num_rows):
            packed = batch.column("shared")[row].as_py() or []
            if not packed:
                continue
            shared = np.concatenate([np.frombuffer(p, "<u8", len(p) // 9) for p in packed])
            crowds = np.concatenate([np.frombuffer(p, np.uint8, -1, len(p) // 9 * 8) for p in packed])
            order = np.argsort(shared)
            shared, crowds = shared[order], crowds[order]
            data, lengths = _read(batch, row)
            chunk, base = batch.column("chunk")[row].as_py(), batch.column("base")[row].as_py()
            raw, begins = data.tobytes(), np.cumsum(lengths) - lengths
            ids = np.array([2**63 - 1 if i is None else int(i) for i in batch.column("doc_ids")[row].as_py()], np.int64)
            ties = np.array(batch.column("ties")[row].as_py(), np.int64)
            hashes, key, anchor, doc, first, stop = _segments(data, lengths, length, gram)
            known = np.minimum(np.searchsorted(shared, key), len(shared) - 1)
            mine = np.flatnonzero(shared[known] == key)
            key, doc, first, stop, crowd = _runs(hashes, crowds[known[mine]], *(x[mine] for x in (key, anchor, doc, first, stop)), length, gram)
            at = first - begins[doc] + base
            order = np.lexsort((at, doc, ties[doc], ids[doc]))  # the first place of a content comes first
            key, doc, first, stop, crowd, at = (x[order] for x in (key, doc, first, stop, crowd, at))
            here: dict[tuple[int, bytes], int] = {}
            firsts, repeats = [], []
            for i, (k, a, b) in enumerate(zip(key.tolist(), first.tolist(), stop.tolist(), strict=True)):
                (firsts if here.setdefault((k, raw[a:b]), i) == i else repeats).append(i)
            if (crowd[firsts] > 0).any():
                if len(seen) > _KEPT:
                    seen = {}
                fresh = []
                for i in firsts:
                    if crowd[i]:
                        content = (int(key[i]), hashlib.blake2b(raw[first[i] : stop[i]], digest_size=16).digest())
                        place = (int(ids[doc[i]]), int(ties[doc[i]]), chunk, int(doc[i]), int(at[i]))
                        if seen.get(content, place) < place:
                            repeats.append(i)
                            continue
                        seen[content] = place
                    fresh.append(i)
                firsts = fresh
            firsts, repeats = np.array(firsts, np.int64), np.array(repeats, np.int64)
            out = []
            if len(repeats):
                spans = np.stack([doc[repeats], at[repeats], at[repeats] + stop[repeats] - first[repeats]], axis=1).astype("<i8")
                spans = _joined(spans[np.lexsort((spans[:, 1], spans[:, 0]))])
                out.append((chunk % shards, None, None, None, None, spans.tobytes()))
            shard = (key[firsts] % np.uint64(shards)).astype(np.int64)
            firsts = firsts[np.argsort(shard, kind="stable")]
            shard.sort()
            for a, b in _alike(shard):
                part = firsts[a:b]
                places = {"content": np.arange(len(part)), "doc": doc[part], "at": at[part], "id": ids[doc[part]], "tie": ties[doc[part]]}
                contents = press(b"".join([raw[x:y] for x, y in zip(first[part].tolist(), stop[part].tolist(), strict=True)]))
                packed = press(b"".join([places[c].astype(k).tobytes() for c, k in _PLACE.items()]))
                out.append((int(shard[a]), key[part].astype("<u8").tobytes(), (stop[part] - first[part]).astype("<i4").tobytes(), contents, packed, None))
            kinds = (pa.int64(), *[pa.binary()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(out), pa.int64()), *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds))], names)


def _unpacked(row: dict, open_) -> tuple[bytes, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    text, sizes, keys = open_(row["contents"]), np.frombuffer(row["sizes"], "<i4").astype(np.int64), np.frombuffer(row["keys"], "<u8")
    packed, at, places = open_(row["places"]), 0, {}
    for name, kind in _PLACE.items():
        places[name] = np.frombuffer(packed, kind, len(keys), at).astype(np.int64)
        at += len(keys) * np.dtype(kind).itemsize
    return text, sizes, keys, places


def _later_strings(texts: list[bytes], doc: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all strings of ``texts``, those that equal an earlier one: their text, and where they start in it.

    Text i begins at ``at[i]`` of the document numbered ``doc[i]``; strings are ordered by document and start. One
    suffix array over all texts tells which are equal.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    s = np.frombuffer(b"\0".join([*texts, b"\0"]), np.uint8).astype(np.uint16) + np.uint16(2)
    s[ends] = 1
    s[-1] = 0
    sa = suffix_array(s, 258)
    prefix = permuted_prefixes(s, sa)
    n = sizes - length + 1
    text = np.repeat(np.arange(len(texts)), n)
    offset = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    begin = (ends - sizes)[text] + offset
    of = np.empty(len(s), np.int32)
    of[sa] = np.cumsum(prefix[sa] < length)  # suffixes in order that share ``length`` symbols are of one class
    mine = of[begin]
    order = np.lexsort((at[text] + offset, doc[text], mine))
    later = np.zeros(len(text), bool)
    later[order[1:]] = mine[order][1:] == mine[order][:-1]
    return text[later], offset[later]


def _arrays(keys: np.ndarray, sizes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Contents in lots of about ``most`` bytes, all of one key in one lot."""
    order = np.argsort(keys, kind="stable")
    lot: list[np.ndarray] = []
    held = 0
    for a, b in _alike(keys[order]):
        size = int(sizes[order[a:b]].sum())
        if lot and held + size > most:
            yield np.concatenate(lot)
            lot, held = [], 0
        lot.append(order[a:b])
        held += size
    if lot:
        yield np.concatenate(lot)


def _compare(group: pa.Table, length: int, most: int) -> pa.Table:
    """chunk, spans: what one shard's segments say is to be removed, as packed (document of the chunk, start, end)."""
    told = group.select(["chunk", "spans"]).filter(pc.is_valid(group.column("spans")))
    group = group.filter(pc.is_valid(group.column("keys")))
    if not group.num_rows:
        return told
    open_ = zstandard.ZstdDecompressor().decompress
    known: dict[tuple[int, bytes], int] = {}
    parts: dict[str, list] = {c: [] for c in _PLACE}
    chunks = group.column("chunk").to_numpy()
    counts = []
    for row in group.select(["keys", "sizes", "contents", "places"]).to_pylist():
        text, sizes, keys, here = _unpacked(row, open_)
        ends = np.cumsum(sizes)
        here["content"] = np.array([known.setdefault((k, text[a:b]), len(known)) for k, a, b in zip(keys.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True)], np.int64)
        for c in parts:
            parts[c].append(here[c])
        counts.append(len(keys))
    place = {c: np.concatenate(x) for c, x in parts.items()}
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((place["at"], place["doc"], chunks[row], place["tie"], place["id"]))
    place, row = {c: x[order] for c, x in place.items()}, row[order]
    document = np.cumsum(np.append(0, (chunks[row][1:] != chunks[row][:-1]) | (place["doc"][1:] != place["doc"][:-1])))
    texts = [c for _, c in known]
    keys = np.array([k for k, _ in known], np.uint64)
    sizes = np.array([len(c) for c in texts], np.int64)
    later = np.ones(len(row), bool)
    first = np.unique(place["content"], return_index=True)[1]  # the first place of each content
    later[first] = False
    rows, starts, ends = [np.flatnonzero(later)], [place["at"][later]], [place["at"][later] + sizes[place["content"][later]]]
    # A content that has its key for itself shares no string with another; all others go through suffix arrays.
    _, of, n = np.unique(keys, return_inverse=True, return_counts=True)
    open_keys = np.flatnonzero(n[of] > 1)
    for lot in _arrays(keys[open_keys], sizes[open_keys], most):
        lot = open_keys[lot]
        holder = first[lot]
        text, offset = _later_strings([texts[i] for i in lot.tolist()], document[holder], place["at"][holder], length)
        rows.append(holder[text])
        starts.append(place["at"][holder[text]] + offset)
        ends.append(starts[-1] + length)
    rows, starts, ends = (np.concatenate(x) for x in (rows, starts, ends))
    spans, owner = np.stack([place["doc"][rows], starts, ends], axis=1).astype("<i8"), row[rows]
    order = np.lexsort((spans[:, 1], spans[:, 0], owner))
    spans, owner = spans[order], owner[order]
    cut = _alike(owner)
    packed = {"chunk": [int(chunks[owner[a]]) for a, _ in cut], "spans": [_joined(spans[a:b]).tobytes() for a, b in cut]}
    return pa.concat_tables([told.cast(_SPANS), pa.table(packed, _SPANS)])


_SPANS = pa.schema([("chunk", pa.int64()), ("spans", pa.binary())])


def _joined(spans: np.ndarray) -> np.ndarray:
    """Sorted spans of one chunk, those of one document that overlap or touch as one."""
    if not len(spans):
        return spans
    big = spans[:, 2].max() + 1
    nth = np.cumsum(np.append(0, spans[1:, 0] != spans[:-1, 0]))
    reach = np.maximum.accumulate(nth * big + spans[:, 2])
    new = np.append(True, nth[1:] * big + spans[1:, 1] > reach[:-1])
    out = spans[new]
    out[:, 2] = reach[np.append(np.flatnonzero(new)[1:], len(spans)) - 1] % big
    return out


def _cut(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """The documents without their spans; rows of one long document follow each other in order of base."""
    held: tuple | None = None  # chunk, doc_id, bytes, removed, spans, digest, kept bytes, whether the end is removed

    def row(long: tuple) -> pa.RecordBatch:
        return batch_of([long[1]], [long[2]], [long[3]], [long[4]], [long[5].hexdigest()], [b"".join(long[6])])

    def batch_of(ids: list, *columns: list) -> pa.RecordBatch:
        arrays = [pa.array(ids, kind), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            arrays, names = [*arrays, pa.array(columns[4], pa.binary())], [*names, "kept_bytes"]
        return pa.RecordBatch.from_arrays(arrays, names)

    for batch in batches:
        kind = batch.column("doc_ids").type.value_type
        for n in range(batch.num_rows):
            data, lengths = _read(batch, n)
            chunk, base, own = (batch.column(c)[n].as_py() for c in ("chunk", "base", "own"))
            begins = np.cumsum(lengths) - lengths
            spans = np.frombuffer(b"".join(batch.column("spans")[n].as_py() or []), "<i8").reshape(-1, 3)
            edge = np.zeros(len(data) + 1, np.int64)
            for column, way in ((1, 1), (2, -1)):
                np.add.at(edge, begins[spans[:, 0]] + np.clip(spans[:, column] - base, 0, lengths[spans[:, 0]]), way)
            keep = (np.cumsum(edge[:-1]) == 0)[:own]
            ids = batch.column("doc_ids")[n].as_py()
            if held and held[0] != chunk:
                yield row(held)
                held = None
            if batch.column("piece")[n].as_py():
                if not base:
                    held = (chunk, ids[0], 0, 0, 0, hashlib.sha256(), [], False)
                _, doc_id, size, gone, runs, digest, kept, ended = held
                mine = data[:own][keep].tobytes()
                digest.update(mine)
                runs += int(np.count_nonzero(~keep & np.append(not ended, keep[:-1])))
                held = (chunk, doc_id, size + own, gone + own - len(mine), runs, digest, [*kept, mine] if with_text else [], not keep[-1])
                continue
            kept = [data[a : a + k][keep[a : a + k]].tobytes() for a, k in zip(begins.tolist(), lengths.tolist(), strict=True)]
            head = np.zeros(len(keep) + 1, bool)
            head[begins] = True
            runs = np.append(0, np.cumsum(~keep & (head[:-1] | np.append(True, keep[:-1]))))
            yield batch_of(ids, lengths.tolist(), [k - len(x) for k, x in zip(lengths.tolist(), kept, strict=True)], (runs[begins + lengths] - runs[begins]).tolist(), [hashlib.sha256(x).hexdigest() for x in kept], kept)
    if held:
        yield row(held)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK, shard: int = SHARD, sent: int = SENT, array: int = ARRAY, places: tuple[int, int] = PLACES, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_bytes) of each row of ``docs`` (doc_id, text).

    Texts are UTF-8 bytes, null an empty one; one of any length is cut into pieces of ``chunk`` bytes. A byte is
    removed when it lies in a string of ``length`` bytes that also starts earlier: in a row with a smaller doc_id, or
    earlier in the same row; matches don't cross rows. doc_id is an integer (ValueError otherwise); a null comes last,
    and rows of one doc_id are in order of the XXH64 of their texts. An empty table gives an empty result; other
    columns are not looked at.
    """
    chunks = pack_documents(docs, chunk, length)
    total = chunks.agg(F.coalesce(F.sum("own"), F.lit(0)).alias("n")).first()["n"]
    anchors = shared_anchors(chunks, max(8, 2 * total // (length - gram + 2) // shard + 1), length, gram, places)
    shared = anchors.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    shards = max(8, shared * (length + (length - gram) // 2) // sent + 1)
    kind = "chunk long, shard long, keys binary, sizes binary, contents binary, places binary, spans binary"
    around = chunks.join(anchors.select("chunk", "base", "shared"), ["chunk", "base"]).sortWithinPartitions("chunk", "base")
    segments = around.mapInArrow(lambda b: _send(b, shards, length, gram), kind)
    spans = segments.groupBy("shard").applyInArrow(lambda t: _compare(t, length, array), "chunk long, spans binary")
    with rows_per_batch(docs.sparkSession, _BATCH):
        gone = written(spans.groupBy("chunk").agg(F.collect_list("spans").alias("spans")), "spans")
    drop_written(anchors)
    out = f"{chunks.schema['doc_ids'].dataType.elementType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    whole, pieces = (chunks.where(c).join(gone, "chunk", "left") for c in ("not piece", "piece"))
    schema = f"doc_id {out}" + ", kept_bytes binary" * with_text
    each = (d.mapInArrow(lambda b: _cut(b, with_text), schema) for d in (whole, pieces.repartition("chunk").sortWithinPartitions("chunk", "base")))
    return next(each).unionByName(next(each))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without what repeats an earlier string of 100 bytes."""
    return remove_repeats(table(spark, sf_dir, "documents"))
