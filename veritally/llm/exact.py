"""Exact deduplication: a tree merge of sorted digest runs.

Each task sorts the digests of the texts it reads into a run without repeats, which belongs to one of 2 ** bits parts.
In every round groups of 2 ** FAN_BITS parts exchange pieces of their runs (those parts whose numbers differ in the bits
of that round; a digest goes to the one whose bits it has) and each merges what it gets, keeping the smallest identifier
of each digest. After the last round each part holds its digests complete. Runs travel as blocks of one range of digests
each; a task merges the runs of one range at a time, and never sorts again. A digest is once in a run, so a group of any
size reaches a task as one row of each run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.llm.common import join_groups, one_row_each, table, text_of, written

#: Bits of the part's number that one round replaces: so many parts, as a power of two, exchange runs.
FAN_BITS = 3
#: Rows of a part and of a block as a mean, and most bits of a part's number.
PART, BLOCK, MOST_BITS = 1 << 19, 1 << 14, 13


def normal_text(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; empty for null."""
    return F.regexp_replace(text_of(text), r"[\x20\x09-\x0D]+", " ")


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, as lowercase hex."""
    return F.sha2(normal_text(text), 256)


def _digest_array(rows: pa.RecordBatch) -> np.ndarray:
    """The digests as numpy strings of 32 bytes, which compare as the digests do."""
    column = rows.column("digest")
    if not len(column):
        return np.empty(0, "S32")
    start = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset])
    return np.frombuffer(column.buffers()[2], np.uint8)[start : start + 32 * len(column)].view("S32")


def _packed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _opened(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def _merge_two(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Two lists of row numbers, each in order of ``key``, as one in order; of equal ones those of ``a`` first."""
    out = np.empty(len(a) + len(b), np.int64)
    at = np.searchsorted(key[a], key[b], "right") + np.arange(len(b))
    rest = np.ones(len(out), bool)
    rest[at] = False
    out[at], out[rest] = b, a
    return out


def _merged(runs: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Runs in order of digest as one run: of each digest the smallest (keep_id, keep_row), nulls last, with the sum of n.

    Rows of one digest must agree in length and second hash, or the job fails.
    """
    rows = pa.Table.from_batches(runs).combine_chunks().to_batches()
    if not rows:
        return runs[0]
    rows = rows[0]
    key = _digest_array(rows)
    ends = np.cumsum([r.num_rows for r in runs])
    lists = [np.arange(e - r.num_rows, e) for e, r in zip(ends.tolist(), runs, strict=True)]
    while len(lists) > 1:
        lists = [_merge_two(*lists[i : i + 2], key) if i + 1 < len(lists) else lists[i] for i in range(0, len(lists), 2)]
    order = lists[0]
    key = key[order]
    equal = key[1:] == key[:-1]
    first = np.flatnonzero(np.append(True, ~equal))
    if equal.any():
        group = np.cumsum(np.append(0, ~equal))
        again = np.flatnonzero(np.append(equal, False) | np.append(False, equal))
        among = rows.take(pa.array(order[again]))
        lengths, second = (among.column(c).to_numpy() for c in ("n_bytes", "verify"))
        same = group[again][1:] == group[again][:-1]
        if (lengths[1:] != lengths[:-1])[same].any() or (second[1:] != second[:-1])[same].any():
            raise ValueError("two texts of one SHA-256 differ in length or in XXH64")
        table_ = pa.table({"group": group[again], "keep_id": among.column("keep_id"), "keep_row": among.column("keep_row")})
        order[again] = order[again][pc.sort_indices(table_, [("group", "ascending"), ("keep_id", "ascending"), ("keep_row", "ascending")]).to_numpy()]
    out = rows.take(pa.array(order[first]))
    n = np.add.reduceat(rows.column("n").to_numpy()[order], first)
    return out.set_column(out.schema.get_field_index("n"), "n", pa.array(n))


def _names(rows: pa.RecordBatch) -> np.ndarray:
    """The first 32 bits of each digest."""
    return np.ascontiguousarray(_digest_array(rows)).view(np.uint8).reshape(-1, 32)[:, :4].copy().view(">u4")[:, 0].astype(np.int64)


_BLOCK = "part int, range int, run binary"


def _dealt(run: pa.RecordBatch, part: int, mask: int, ranges: int) -> Iterator[tuple[int, int, bytes]]:
    """The run cut by range (the highest bits of a digest) and by the part that its bits in ``mask`` name."""
    name = _names(run)
    to = (part & ~mask) | (name & mask)
    at = name >> (32 - ranges)
    code = (to << ranges) | at
    order = np.argsort(code, kind="stable")
    cuts = np.flatnonzero(np.append(True, code[order][1:] != code[order][:-1])).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        rows = run.take(pa.array(order[a:b]))
        yield int(to[order[a]]), int(at[order[a]]), _packed(rows)


def _blocks(cut: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([c[i] for c in cut], k) for i, k in enumerate(kinds)], ["part", "range", "run"])


def digests(docs: DataFrame) -> DataFrame:
    """row, doc_id, digest, n_bytes, verify of each row of ``docs``, written to the shared folder."""
    text = normal_text(F.col("text"))
    return written(
        docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(text).alias("verify")),
        "digests",
    )


def merge_digests(rows: DataFrame, fan_bits: int = FAN_BITS, part_rows: int = PART, block_rows: int = BLOCK) -> DataFrame:
    """One row per digest of ``rows`` (see :func:`digests`): digest, keep_id, keep_row, n.

    There are 2 ** bits parts of about ``part_rows`` rows, whatever the number of files, and runs travel in blocks of
    about ``block_rows``.
    """
    total = rows.count()
    bits = min(MOST_BITS, max(1, (total // part_rows).bit_length()))
    ranges = min(28 - bits, max(0, (total // (block_rows << bits)).bit_length()))
    narrow = rows.select(F.unhex("digest").alias("digest"), "n_bytes", "verify", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("n"))

    def mask(low: int) -> int:
        return ((1 << min(fan_bits, bits - low)) - 1) << low

    def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The only sort: what a task reads, part by part."""
        part = TaskContext.get().partitionId() & ((1 << bits) - 1)
        held: list[pa.RecordBatch] = []

        def run() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            whole = pa.RecordBatch.from_arrays(whole.columns, whole.schema.names)  # all columns nullable
            return _merged([whole.take(pa.array(np.argsort(_digest_array(whole), kind="stable")))])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= part_rows:
                yield _blocks([*_dealt(run(), part, mask(0), ranges)])
                held = []
        if held:
            yield _blocks([*_dealt(run(), part, mask(0), ranges)])

    def merging(low: int):
        last = low >= bits

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at: tuple[int, int] | None = None
            runs: list[pa.RecordBatch] = []

            def out() -> pa.RecordBatch:
                run = _merged(runs)
                return run.select(["digest", "keep_id", "keep_row", "n"]) if last else _blocks([*_dealt(run, at[0], mask(low), ranges)])

            for batch in batches:
                for part, block, run in zip(*(batch.column(c).to_pylist() for c in ("part", "range", "run")), strict=True):
                    if at is not None and at != (part, block):
                        yield out()
                        runs = []
                    at = (part, block)
                    runs.append(_opened(run))
            if runs:
                yield out()

        return merged

    runs = narrow.mapInArrow(sorted_runs, _BLOCK)
    kind = narrow.schema["keep_id"].dataType.simpleString()
    for low in range(fan_bits, bits + fan_bits, fan_bits):
        here = runs.repartitionById(1 << bits, "part").sortWithinPartitions("part", "range")
        runs = here.mapInArrow(merging(low), f"digest binary, keep_id {kind}, keep_row long, n long" if low >= bits else _BLOCK)
    return runs.select(F.lower(F.hex("digest")).alias("digest"), "keep_id", "keep_row", "n")


def exact_duplicates(docs: DataFrame, fan_bits: int = FAN_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs`` (doc_id, text).

    Texts are equal when identical after each run of ASCII white space is one space; a null text is an empty one. The
    row with the smallest doc_id stays; a null doc_id comes last; of repeated rows (one doc_id, equal texts) one stays.
    An empty table gives an empty result; other columns are not looked at.
    """
    rows = digests(docs)
    groups = written(merge_digests(rows, fan_bits), "digest-groups")
    out = join_groups(rows, groups, "digest", "n")
    return out.select("doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.col("digest").alias("text_sha256"))


def exact_stage(docs: DataFrame, fan_bits: int = FAN_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with all their columns."""
    kept = written(exact_duplicates(docs, fan_bits).where("kept").select("doc_id", "text_sha256"), "digest-kept")
    return one_row_each(docs, kept, {"doc_id": F.col("doc_id"), "text_sha256": text_digest(F.col("text"))})


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document that stays of its group."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
       row_number() over (partition by text_sha256 order by doc_id) = 1 as kept, text_sha256
from d"""
