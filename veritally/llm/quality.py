"""Quality rules: base counts of each text and a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words are hashed into ``buckets`` counters. One multinomial is counted over every
document (raw), one over trusted documents (target). A document's score is the mean over its n-grams of
log p_target - log p_raw; it is kept when the base rules pass and the score is at least ``threshold``.

Every trusted document counts. Its texts are met by a join; a bitmap of hashed doc_ids, of bounded size, tells first which
rows can have a label at all, so the others aren't shuffled.

With ``held_out`` the verdict doesn't depend on the size of the corpus: a document's own n-grams are left out of both
multinomials, the target is smoothed towards what the raw counts let expect (an n-gram that nothing else has gives 0),
and the threshold is found on the labelled documents, see :func:`held_out_threshold`.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from decimal import Decimal
from itertools import count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veritally.llm.common import drop_written, running, small_batches, table, text_of, texts_of, whole_row, written

#: Hash buckets of the two multinomials; what is broadcast has this many numbers at any size of input.
BUCKETS = 1 << 14
#: Bits of the bitmap of labelled doc_ids for each of them, and in all, which bounds what is broadcast to 8 MiB. Beyond
#: that more rows without a label are shuffled; results stay the same.
BITS, MOST_BITS = 32, 1 << 26
#: Mean log-likelihood ratio per n-gram below which a document goes, unless the score is held out.
THRESHOLD = -0.06
#: Held out: counts added to an n-gram's target and to what is expected of it; spreads below the trusted mean.
ADDED, SPREADS = 1.0, 3.0
#: Distinct words after which a task forgets its hashes; bounds memory, not results.
_WORDS_KEPT = 300_000

SYMBOLS = "[#*$%&|<>]"


class _Hashes:
    """Codes and 64-bit hashes of the words of many texts; each distinct word is hashed once while it is remembered."""

    def __init__(self) -> None:
        self._clear()

    def _clear(self) -> None:
        self.code = defaultdict(count().__next__)
        self.hash = np.empty(0, np.uint64)

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.code) > _WORDS_KEPT:
            self._clear()
        before = len(self.code)
        codes = np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))
        if fresh := len(self.code) - before:
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, islice(reversed(self.code), fresh)), np.uint64, fresh)
            self.hash = np.concatenate([self.hash, hashes[::-1]])
        return codes, self.hash[codes]


def _flat(texts: list[str | None], hashes: _Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each text's words start (and the end), each word's code, and each word's hash."""
    words, starts = [], [0]
    for text in texts:
        words += (text or "").encode().split()  # bytes split at ASCII white space alone
        starts.append(len(words))
    return np.array(starts, np.int64), *hashes.of(words)


def _grams(h: np.ndarray, starts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words, and of each word with the next one; -1 where a text ends."""
    one = (h % np.uint64(buckets)).astype(np.int64)
    two = np.full(len(h), -1, np.int64)
    if len(h) > 1:
        mixed = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        two[:-1] = ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(buckets)).astype(np.int64)
    ends = starts[1:][starts[1:] > starts[:-1]]
    two[ends - 1] = -1
    return one, two


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of ``values`` in each text."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def repeated_words(codes: np.ndarray, h: np.ndarray, starts: np.ndarray, n: int = 5) -> np.ndarray:
    """For each text, how many of its words lie in windows of ``n`` words that it has twice or more."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.zeros(len(starts) - 1, np.int64)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at = np.flatnonzero(doc[:size] == doc[n - 1 :])
    key = doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(n):
        key = (key ^ (key >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + h[at + k]
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    left, right = at[order[same]], at[order[same + 1]]
    agree = doc[left] == doc[right]
    for k in range(n):
        agree &= codes[left + k] == codes[right + k]
    covered = np.zeros(len(codes), bool)
    for k in range(n):
        covered[left + k] = covered[right + k] = True
    out = _sums(covered.astype(np.int64), starts)
    for d in {int(x) for x in doc[np.concatenate([left[~agree], right[~agree]])]}:
        # Windows of one hash differ, which chance hardly ever gives: count this text by the windows themselves.
        mine = codes[starts[d] : starts[d + 1]].tolist()
        windows = list(zip(*(mine[k:] for k in range(n)), strict=False))
        seen = Counter(windows)
        out[d] = len({i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(n)})
    return out


def ngram_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: n-gram counts over all rows of ``texts`` (text)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total = _Hashes(), np.zeros(buckets, np.int64)
        for batch in small_batches(batches):
            starts, _, h = _flat(batch.column("text").to_pylist(), hashes)
            for g in _grams(h, starts, buckets):
                total += np.bincount(g[g >= 0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return texts.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _count_array(counts: DataFrame, buckets: int) -> np.ndarray:
    """The count of each bucket."""
    out = np.zeros(buckets)
    for row in counts.collect():  # one row per bucket at most
        out[row["bucket"]] = row["n"]
    return out


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw of each bucket, one added to each count; zeros where no target was counted."""
    if not target.any():
        return np.zeros(len(raw))
    return np.log((1 + target) / (1 + target).sum()) - np.log((1 + raw) / (1 + raw).sum())


def _held_out(one: np.ndarray, two: np.ndarray, starts: np.ndarray, trusted: np.ndarray, raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each text's mean of log (target + ADDED) - log (expected + ADDED), the text's own n-grams left out of both.

    An n-gram is expected in the target by its other raw occurrences and the target's share of all of them.
    """
    buckets, n = len(raw), len(starts) - 1
    doc = np.repeat(np.arange(n), np.diff(starts))
    key, own = np.unique(np.concatenate([doc * buckets + one, (doc * buckets + two)[two >= 0]]), return_counts=True)
    doc, gram = key // buckets, key % buckets
    grams = np.bincount(doc, weights=own, minlength=n)
    share = (target.sum() - grams * trusted) / np.maximum(raw.sum() - grams, 1)
    expected = (raw[gram] - own) * share[doc]
    value = np.log(target[gram] - own * trusted[doc] + ADDED) - np.log(expected + ADDED)
    return np.bincount(doc, weights=own * value, minlength=n) / np.maximum(grams, 1)


def held_out_threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The score from which documents are kept, by held-out scores of trusted and of bad ones.

    It is the cut with the largest sum of the shares of trusted documents kept and of bad ones removed, the lowest of
    equal ones, but SPREADS standard deviations below the trusted mean at most; without bad ones that alone; without
    trusted ones nothing goes.
    """
    if not len(good):
        return -np.inf
    most = float(good.mean() - SPREADS * good.std())
    if not len(bad):
        return most
    cuts = np.unique(np.concatenate([good, bad]))
    kept = 1 - np.searchsorted(np.sort(good), cuts) / len(good)
    removed = np.searchsorted(np.sort(bad), cuts) / len(bad)
    return min(most, float(cuts[np.argmax(kept + removed)]))


def _found_threshold(labelled: DataFrame, counts: Broadcast) -> float:
    """:func:`held_out_threshold` on the rows of ``labelled`` (_id, trusted, text) that pass the base rules, without collecting them.

    A doc_id counts once, by its least score. Sums are of decimals and integers, so reruns agree.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in small_batches(batches):
            starts, codes, h = _flat(batch.column("text").to_pylist(), hashes)
            _, failed = _base(starts, codes, h)
            trusted = np.array(batch.column("trusted").to_pylist(), bool)
            llr = _held_out(*_grams(h, starts, len(counts.value[0])), starts, trusted, *counts.value)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("trusted"), pa.array(llr), pa.array(failed)], ["_id", "trusted", "llr", "failed"])

    kind = labelled.schema["_id"].dataType.simpleString()
    scores = labelled.mapInArrow(scored, f"_id {kind}, trusted boolean, llr double, failed boolean").where("not failed")
    scores = scores.groupBy("_id", "trusted").agg(F.min("llr").alias("llr"))
    values = written(scores.groupBy("llr").agg(F.count_if("trusted").alias("good"), F.count_if(~F.col("trusted")).alias("bad")), "scores")
    exact = lambda x: F.sum(x.cast("decimal(20,15)") * F.col("good").cast("decimal(13,0)"))
    told = values.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), exact(F.col("llr")).alias("sum"), exact(F.col("llr") * F.col("llr")).alias("squares")).first()
    if not told["good"]:
        return -np.inf
    mean = told["sum"] / told["good"]
    most = float(mean - Decimal(SPREADS) * max(Decimal(0), told["squares"] / told["good"] - mean * mean).sqrt())
    if not told["bad"]:
        return most
    upto = running(values.withColumn("all", F.lit(0)), "all", [F.col("llr")], {"good_upto": F.col("good"), "bad_upto": F.col("bad")})
    gain = (told["good"] - F.col("good_upto") + F.col("good")) * told["bad"] + (F.col("bad_upto") - F.col("bad")) * told["good"]
    return min(most, upto.agg(F.max_by("llr", F.struct(gain, -F.col("llr"))).alias("cut")).first()["cut"])


def _base(starts: np.ndarray, codes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text, its words in repeated windows, and whether it fails the base rules."""
    n, repeats = np.diff(starts), repeated_words(codes, h, starts)
    return repeats, (n < 10) | (100 * repeats > 20 * n)


def _may_have(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` (with _id) and _may: false only where ``ids`` (doc_id) doesn't have the _id."""
    bits = min(MOST_BITS, 1 << (BITS * ids.count()).bit_length())
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1  # noqa: E731  from 1: bitmaps begin there
    bitmap = ids.groupBy(F.bitmap_bucket_number(place("doc_id")).alias("_piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place("doc_id"))).alias("_bits"))
    at = F.bitmap_bit_position(place("_id"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return rows.join(F.broadcast(bitmap), F.bitmap_bucket_number(place("_id")) == F.col("_piece"), "left").withColumn("_may", may).drop("_piece", "_bits")


def _judge(docs: DataFrame, labels: DataFrame, carried: Column, threshold: float, buckets: int, held_out: bool, whole: bool = False) -> DataFrame:
    """``carried`` and the verdict of each row of ``docs``; ``whole`` says that ``carried`` has the text."""
    marks = labels.where("quality in (0, 1)").select(F.col("doc_id").try_cast(docs.schema["doc_id"].dataType).alias("doc_id"), "quality").where("doc_id is not null")
    marks = written(marks.groupBy("doc_id").agg((F.max("quality") == 1).alias("trusted")), "marks")
    labelled = _may_have(docs.select(F.col("doc_id").alias("_id"), "text"), marks).where("_may").join(marks.hint("merge"), F.col("_id") == F.col("doc_id"))
    labelled = written(labelled.select("_id", "trusted", "text"), "labelled")
    counts = tuple(_count_array(ngram_counts(x, buckets), buckets) for x in (docs, labelled.where("trusted")))
    ratio = docs.sparkSession.sparkContext.broadcast(counts if held_out else log_ratios(*counts))
    if held_out:
        threshold = _found_threshold(labelled, ratio)
    drop_written(labelled)
    text = text_of("carried.text" if whole else "text")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = [
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
    ]
    rows = docs.select(carried.alias("carried"), *([] if whole else ["text"]), F.col("doc_id").alias("_id"))
    if held_out:
        told = _may_have(rows, marks)
        good = marks.where("trusted").select(F.col("doc_id").alias("_good"))
        may = told.where("_may").join(good.hint("merge"), F.col("_id") == F.col("_good"), "left").withColumn("trusted", F.col("_good").isNotNull()).drop("_good")
        rows = told.where("not _may").withColumn("trusted", F.lit(False)).unionByName(may).drop("_may")
    rows = rows.select("carried", *([] if whole else [text_of("text").alias("text")]), *base, *(["trusted"] if held_out else []))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in small_batches(batches):
            starts, codes, h = _flat(texts_of(batch).to_pylist(), hashes)
            n = np.diff(starts)
            one, two = _grams(h, starts, buckets)
            if held_out:
                llr = _held_out(one, two, starts, np.array(batch.column("trusted").to_pylist(), bool), *ratio.value)
            else:
                value = ratio.value[one] + np.where(two >= 0, ratio.value[two], 0.0)
                sums = np.array([value[a:b].sum() for a, b in zip(starts, starts[1:], strict=False)], float)
                llr = sums / np.maximum(n + np.maximum(n - 1, 0), 1)
            repeats, failed = _base(starts, codes, h)
            old = [batch.column(c) for c in ("carried", "word_chars", "n_symbols", "n_dup_lines")]
            new = [pa.array(x) for x in (n, repeats, llr, failed, ~failed & (llr >= threshold))]
            names = ["carried", "word_chars", "n_symbols", "n_dup_lines", "n_words", "n_repeat_words", "llr", "base_failed", "kept"]
            yield pa.RecordBatch.from_arrays(old + new, names)

    verdict = "word_chars long, n_symbols long, n_dup_lines long, n_words long, n_repeat_words long, llr double, base_failed boolean, kept boolean"
    return rows.mapInArrow(judged, StructType([rows.schema["carried"], *StructType.fromDDL(verdict)]))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, held_out: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): base counts, ``llr``, ``base_failed`` and ``kept``.

    Target: every document with quality 1 in ``labels``; the raw counts cover every document. A null text has no words; a text without words fails the base rules; without a
    trusted document every ``llr`` is 0. Repeated rows are judged one by one and all returned; a null doc_id is
    returned as null. Texts are read whole, some 2 MB of them at a time. Empty tables give an empty result. Other columns of
    the inputs are not looked at. With
    ``held_out`` the score leaves the row itself out, and the threshold is found on ``labels`` instead of given.
    """
    judged = _judge(docs, labels, F.col("doc_id"), threshold, buckets, held_out)
    return judged.select(F.col("carried").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def quality_stage(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, held_out: bool = False) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; they go through the scan, without a join.

    Nulls, texts without words, repeated rows and empty tables as in :func:`quality_rules`: a text without words goes,
    repeated rows are judged one by one. Columns of any name keep their values.
    """
    return _judge(docs, labels, whole_row(docs), threshold, buckets, held_out, whole=True).where("kept").select("carried.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base counts and verdict."""
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out=True)
