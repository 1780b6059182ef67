"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent n-grams of a language in order. A text's own most frequent n-grams are compared with
each profile by out-of-place distance: how far each n-gram's rank is from its rank in the profile, a fixed most for one
that the profile hasn't. The nearest language is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritally.llm.common import small_batches, table, text_of

#: Ranks of a profile; n-grams have one to three characters.
RANKS = 300
#: Most languages; ISO 639-3 names fewer.
LANGUAGES = 10_000
#: One part in FOLDS of the documents is never learned from.
FOLDS = 5

#: Alphabets up to this size have a table of all their n-grams; for larger ones the n-grams there are sorted.
_ALPHABET = 160
_BITS = np.int64(21)


def text_grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of some texts: numbers of all of them, text by text; where each text starts; what each number is.

    Texts are lower-cased; each run of letters counts with a blank on either side, and an n-gram has a letter, if of
    three characters in the middle. Numbers are in order of code points, and what they are is given by code points, of
    21 bits each, the first highest.
    """
    lowered = [(t or "").lower() for t in texts]
    chars = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le"), np.uint32)
    points, at = np.unique(chars, return_inverse=True)
    is_letter = np.array([chr(c).isalpha() for c in points.tolist()])
    # Letters are numbered from 2 in order of code points, the blank (anything else) is 1, nothing is 0.
    number = np.where(is_letter, np.cumsum(is_letter) + 1, 1)
    size = int(number.max(initial=1)) + 1
    x, letter = number[at].astype(np.int64), is_letter[at]
    one = np.flatnonzero(letter)
    two = np.flatnonzero(letter[:-1] | letter[1:])
    three = one - 1  # a blank precedes and follows each text
    places = (one, np.where(letter[two], two, two + 1), one)
    codes = (x[one] * size * size, (x[two] * size + x[two + 1]) * size, (x[three] * size + x[one]) * size + x[one + 1])
    if size <= _ALPHABET:
        there = np.zeros(size**3, bool)
        for c in codes:
            there[c] = True
        known = np.flatnonzero(there)
        dense = np.zeros(size**3, np.int32)
        dense[known] = np.arange(len(known), dtype=np.int32)
        ids = [dense[c] for c in codes]
    else:
        known, inverse = np.unique(np.concatenate(codes), return_inverse=True)
        ids = np.split(inverse.astype(np.int32), np.cumsum([len(c) for c in codes])[:-1])
    ends = 1 + np.cumsum([len(t) + 1 for t in lowered])
    cuts = [np.searchsorted(p, np.concatenate([[0], ends])) for p in places]
    flat = np.concatenate([i[c[d] : c[d + 1]] for d in range(len(texts)) for i, c in zip(ids, cuts, strict=True)]) if len(texts) else ids[0]
    point = np.concatenate([[0, ord(" ")], points[is_letter]]).astype(np.int64)
    what = (point[known // size**2] << (2 * _BITS)) | (point[known // size % size] << _BITS) | point[known % size]
    return flat, np.sum(cuts, axis=0), what


def gram_name(what: int) -> str:
    """The n-gram that :func:`text_grams` tells by code points."""
    return "".join(chr(c) for c in (what >> 42, what >> 21 & 0x1FFFFF, what & 0x1FFFFF) if c)


def _what(gram: str) -> int:
    return sum(ord(c) << 21 * (2 - i) for i, c in enumerate(gram))


def held_out(folds: int = FOLDS):
    """Whether a document is kept from learning: by crc32 of doc_id as text; a null doc_id always is."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(True))


def language_profiles(docs: DataFrame, ranks: int = RANKS) -> DataFrame:
    """lang, gram, rank (from 0): the most frequent n-grams of each non-null lang over all of ``docs`` (text, lang)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in small_batches(batches):
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                flat, _, what = text_grams(texts)
                parts = held.setdefault(lang, [])
                parts.append((what, np.bincount(flat, minlength=len(what))))
                if sum(len(w) for w, _ in parts) > 1_000_000:
                    yield told(lang, held.pop(lang))
        for lang, parts in held.items():
            yield told(lang, parts)

    def told(lang: str, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        what, at = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
        n = np.bincount(at, np.concatenate([c for _, c in parts]), len(what)).astype(np.int64)
        names = pa.array([gram_name(w) for w in what.tolist()], pa.string())
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(what)), names, pa.array(n)], ["lang", "gram", "n"])

    rows = docs.where("lang is not null and text is not null").select("lang", "text")
    sums = rows.mapInArrow(counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    # Filtered by the row number itself, so each task of the sums hands on ``ranks`` rows a language.
    best = sums.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= ranks)
    return best.select("lang", "gram", (F.col("nth") - 1).alias("rank"))


def predict_language(docs: DataFrame, profiles: DataFrame, ranks: int = RANKS) -> DataFrame:
    """doc_id, lang_pred, score of each row of ``docs`` (doc_id, text) by ``profiles`` (see :func:`language_profiles`).

    The profiles, ``ranks`` rows a language, are held by every task, each row of them in 16 bytes, so in 48 MB at most;
    ValueError for more than LANGUAGES of them. Texts are read whole. score is 1 - distance / most distance possible.
    Of languages at one distance the first by code point is taken. ``und`` and 0 for a null text, one without a
    letter, or without profiles.
    """
    rows = profiles.limit(LANGUAGES * ranks + 1).collect()
    if len(rows) > LANGUAGES * ranks:
        raise ValueError(f"more than {LANGUAGES} languages")
    langs = sorted({r["lang"] for r in rows})
    number = {lang: i for i, lang in enumerate(langs)}
    # By n-gram, the languages that have it and its ranks there: 16 bytes a row of the profiles.
    held = np.array(sorted((_what(r["gram"]), number[r["lang"]], r["rank"]) for r in rows), np.int64).reshape(-1, 3)
    grams, starts = np.unique(held[:, 0], return_index=True)
    starts = np.append(starts, len(held))
    held = docs.sparkSession.sparkContext.broadcast((langs, grams, starts, held[:, 1].astype(np.int32), held[:, 2].astype(np.int32)))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, grams, ends, of, rank_in = held.value
        for batch in small_batches(batches):
            flat, starts, what = text_grams(batch.column("text").to_pylist())
            place = np.searchsorted(grams, what)
            known = (grams[np.minimum(place, len(grams) - 1)] == what) if len(grams) else np.zeros(len(what), bool)
            place = np.where(known, place, -1)
            preds, scores = [], []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if a == b or not langs:
                    preds.append("und")
                    scores.append(0.0)
                    continue
                n = np.bincount(flat[a:b])
                there = np.flatnonzero(n)
                least = -n[there]
                if len(there) > ranks:  # those with the most, all that tie with the last, in order of code points
                    among = np.flatnonzero(least <= np.partition(least, ranks - 1)[ranks - 1])
                    there, least = there[among], least[among]
                mine = place[there[np.argsort(least, kind="stable")[:ranks]]]
                # All are ``ranks`` away, but for those of a profile: its rows of these n-grams, one after the other.
                at = np.flatnonzero(mine >= 0)
                n_of = ends[mine[at] + 1] - ends[mine[at]]
                entry = np.repeat(ends[mine[at]] - np.cumsum(n_of) + n_of, n_of) + np.arange(n_of.sum())
                near = ranks - np.abs(rank_in[entry] - np.repeat(at, n_of))
                far = ranks * len(mine) - np.bincount(of[entry], near, len(langs)).astype(np.int64)
                best = int(np.argmin(far))
                preds.append(langs[best])
                scores.append(1.0 - float(far[best]) / (ranks * len(mine)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", text_of("text").alias("text")).mapInArrow(predicted, f"doc_id {kind}, lang_pred string, score double")


def identify_languages(docs: DataFrame, folds: int = FOLDS, ranks: int = RANKS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs`` (doc_id, text, lang).

    Profiles are learned from the documents with a lang that aren't held out (see :func:`held_out`); lang has no part in
    a prediction. Repeated rows are all returned, a null doc_id as null and held out; an empty table gives an empty
    result; other columns are not looked at.
    """
    profiles = language_profiles(docs.where(~held_out(folds)), ranks)
    return predict_language(docs, profiles, ranks).select("doc_id", held_out(folds).alias("held_out"), "lang_pred", "score")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language."""
    return identify_languages(table(spark, sf_dir, "documents"))
