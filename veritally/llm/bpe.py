"""BPE encoding and decoding with a pair occurrence index.

A partition's texts are cut into words at white space, and words into pieces by the tokenizer's own rules; each
distinct piece is encoded once. All new pieces of a batch are merged together: an index maps each rank that occurs to
all positions of its pair, the ranks are applied in ascending order, each at all its positions, and every merge updates
the lists of the two pairs beside it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veritally.llm.common import small_batches, table, text_of

#: Words, and pieces, of a generation that a task remembers; it forgets the older one, which costs time alone.
KEPT = 350_000

#: Printable ASCII, on which lower-casing and the split below are what the tokenizer's rules do.
_PLAIN = re.compile(rb"[\x21-\x7e]+")
_PLAIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary lies on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


class PairIndex:
    """The merges of a tokenizer file with word ends, without an unknown token, and the rules that come before them."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.last_letter = {t: self.vocab[t + self.end] for t in self.vocab if len(t) == 1 and t + self.end in self.vocab}
        self.rank: dict[tuple[int, int], int] = {}
        self.merge: list[tuple[int, int, int]] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[self.vocab[a], self.vocab[b]] = rank
            self.merge.append((self.vocab[a], self.vocab[b], self.vocab[a + b]))
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.tokens |= {i: t for t, i in self.added.items()}
        rules = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = rules.normalizer, rules.pre_tokenizer
        self.split_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.plain = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in json.dumps(file["pre_tokenizer"]).replace("\\\\", "\\")

    def pieces(self, word: bytes) -> list[str | int]:
        """The pieces of a word, in the vocabulary's byte letters, and the ids of added tokens in it."""
        if self.plain and _PLAIN.fullmatch(word) and b"<|" not in word:
            return _PLAIN_SPLIT.findall(word.decode().lower())
        out: list[str | int] = []
        text = word.decode()
        for part in self.split_added.split(text) if self.split_added else [text]:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                out += [p for p, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(part))]
        return out

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """The ids of each piece."""
        rank_of, letter, last_letter = self.rank.get, self.vocab.__getitem__, self.last_letter
        symbol: list[int] = []
        before: list[int] = []
        after: list[int] = []
        starts = []
        for piece in pieces:
            at = len(symbol)
            starts.append(at)
            symbol += map(letter, piece[:-1])
            symbol.append(last_letter[piece[-1]])
            n = len(symbol)
            before.append(-1)
            before += range(at, n - 1)
            after += range(at + 1, n)
            after.append(-1)
        places: dict[int, list[int]] = {}
        for i, pair in enumerate(zip(symbol, symbol[1:], strict=False)):
            if (rank := rank_of(pair)) is not None and after[i] >= 0:
                if rank in places:
                    places[rank].append(i)
                else:
                    places[rank] = [i]
        active = list(places)
        heapify(active)
        while active:
            rank = heappop(active)
            left, right, new = self.merge[rank]
            for i in sorted(places.pop(rank)):
                j = after[i]
                if j < 0 or symbol[i] != left or symbol[j] != right:
                    continue  # an earlier merge took one of the two
                symbol[i], symbol[j] = new, -1
                k = after[i] = after[j]
                p = before[i]
                if k >= 0:
                    before[k] = i
                    if (found := rank_of((new, symbol[k]))) is not None:
                        if found in places:
                            places[found].append(i)
                        else:
                            places[found] = [i]
                            heappush(active, found)
                if p >= 0 and (found := rank_of((symbol[p], new))) is not None:
                    if found in places:
                        places[found].append(p)
                    else:
                        places[found] = [p]
                        heappush(active, found)
        return [[s for s in symbol[a:b] if s >= 0] for a, b in zip(starts, [*starts, len(symbol)][1:], strict=True)]


class Memory(dict):
    """What is remembered, in two generations: when the young one is full it takes the place of the old one."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.old = most, {}

    def unknown(self, keys: set) -> list:
        """The keys that neither generation has; those in the old one are young again. Call before adding any."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        out = []
        for k in keys.difference(self):
            if k in self.old:
                self[k] = self.old[k]
            else:
                out.append(k)
        return out


class WordCoder:
    """Ids of words; ``view`` makes what is remembered of them."""

    def __init__(self, index: PairIndex, view: Callable[[list[int]], object], kept: int = KEPT) -> None:
        self.index, self.view = index, view
        self.words, self.done = Memory(kept), Memory(kept)

    def learn(self, words: list[bytes]) -> dict[bytes, object]:
        """What is remembered of words, with all of ``words`` in it."""
        index, view, done = self.index, self.view, self.done
        new = self.words.unknown(set(words))
        cut = [index.pieces(w) for w in new]
        pieces = done.unknown({p for c in cut for p in c if type(p) is str})
        done.update(zip(pieces, index.encode(pieces), strict=True))
        for word, c in zip(new, cut, strict=True):
            if len(c) == 1 and type(c[0]) is str:
                ids = done[c[0]]
            else:
                ids = []
                for p in c:
                    ids += done[p] if type(p) is str else [p]
            self.words[word] = view(ids)
        return self.words


@lru_cache(1)
def pair_index(path: str) -> PairIndex:
    return PairIndex(path)


@lru_cache(1)
def _text_coder(path: str, kept: int) -> WordCoder:
    """The coder of this Python worker, whose words later partitions find again."""
    index = pair_index(path)
    tokens = index.tokens
    return WordCoder(index, lambda ids: (len(ids), " ".join(map(str, ids)), " ".join([tokens[i] for i in ids])), kept)


def _coded(batches: Iterator[pa.RecordBatch], path: str | None, with_ids: bool, kept: int) -> Iterator[pa.RecordBatch]:
    coder = _text_coder(path or vocabulary_path(), kept)
    for batch in small_batches(batches):
        texts = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
        known = coder.learn([w for words in texts for w in words])
        n, id_hash, text_hash, all_ids = [], [], [], []
        for words in texts:
            found = list(map(known.__getitem__, words))
            sizes, ids, decoded = zip(*found, strict=True) if found else ((), (), ())
            if 0 in sizes:  # a word without tokens, as of blanks that aren't ASCII
                sizes, ids, decoded = (list(filter(None, x)) for x in (sizes, ids, decoded))
            ids = " ".join(ids)
            n.append(sum(sizes))
            id_hash.append(hashlib.sha256(ids.encode()).hexdigest())
            text_hash.append(hashlib.sha256(" ".join(decoded).encode()).hexdigest())
            if with_ids:
                all_ids.append([int(x) for x in ids.split()])
        columns = [batch.column("carried"), pa.array(n, pa.int64()), pa.array(id_hash, pa.string()), pa.array(text_hash, pa.string())]
        names = ["carried", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            columns.append(pa.array(all_ids, pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names)


def _code(docs: DataFrame, carried: Column, path: str | None, with_ids: bool, kept: int = KEPT) -> DataFrame:
    rows = docs.select(carried.alias("carried"), text_of("text").alias("text"))
    kind = rows.schema["carried"].dataType.simpleString()
    schema = f"carried {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(lambda batches: _coded(batches, path, with_ids, kept), schema)


def bpe_round_trip(docs: DataFrame, path: str | None = None, kept: int = KEPT) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of ``docs`` (doc_id, text).

    ``path`` is a tokenizer file (BPE, no unknown token, no decoder) on every executor; by default the public one. The
    decoded text is the tokens joined by spaces, as that file has no decoder. A null text is an empty one: no ids, and
    the digests of the empty string; texts are read whole, some 2 MB of them at a time. A Python worker remembers up to
    2 * ``kept`` words, some 600 bytes each, while it lives. Repeated rows and null doc_id are returned as they are; an empty table gives an
    empty result; other columns are not looked at.
    """
    return _code(docs, F.col("doc_id"), path, False, kept).select(F.col("carried").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def bpe_encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>) for each row of ``docs``; see :func:`bpe_round_trip`."""
    return _code(docs, F.col("doc_id"), path, True).select(F.col("carried").alias("doc_id"), "ids")


def bpe_decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text for each row of ``encoded`` (doc_id, ids); a null array is an empty one."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pair_index(path or vocabulary_path()).tokens
        for batch in batches:
            texts = [" ".join([tokens[i] for i in ids or []]) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decoded, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of ids and the digests of its ids and of what they decode to."""
    return bpe_round_trip(table(spark, sf_dir, "documents"))
