"""Token-id files: context-mixing range coder in independent blocks.

A block holds up to BLOCK ids. Before each id, orders 2 and 1 say one id each, and order 0 gives every id its adaptive
frequency. They are mixed into one distribution: an order's weight is how often it was right where orders 2 and 1 were
as sure as now, and an id that both say has the sum of their parts, and an id's part by order 0 as well. The range coder gets the place of the
said ids in it; any other id comes from order 0 without those. A block is cut into lanes that are coded side by side,
step by step, over one model, so that numpy does a step of all lanes at once; each lane has its own range coder and
words. Model and coders start anew in each block, which carries CRC-32 checksums of its bytes and of its ids, so one
block is read without any other.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veritally.llm.bpe import vocabulary_path
from veritally.llm.common import small_batches, table, text_of, written

#: Ids after which a block ends (a longer document has a block of its own), and steps of a lane.
BLOCK, STEPS = 8_000_000, 512
#: Appended to every document.
END_ID = 1
#: Distinct words after which a task forgets their ids, and bytes of text that are cut into words at once.
_WORDS, _SLICE = 700_000, 6 << 20

#: Pieces that are encoded as one text; letters whose lower case is one letter, and signs that aren't apostrophes.
_JOINED = 1000
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+").fullmatch
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: How a tokenizer file names the pieces: contractions, runs of letters, single digits, runs of other signs.
WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_HEADER = struct.Struct("<4sIIIIII")  # magic, ids, vocabulary, steps, lanes, crc32 of the ids and of what follows
_MAGIC = b"VTM2"
_HASH_BITS, _ADD, _REFRESH, _MOST = 20, 24, 8, 1 << 24
_LOW32, _32, _16 = np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(16)


class _Model:
    """Orders 0 to 2 over ids below ``vocab``, and the mixing weights of each state of sureness.

    ``pair`` and ``first`` hold the id that a context of two, or of one, says, times 4, and how sure it is of it (0 to
    3). All is integers, so that reading repeats what writing did.
    """

    def __init__(self, vocab: int) -> None:
        self.pair, self.first = np.zeros(1 << _HASH_BITS, np.int32), np.zeros(vocab + 1, np.int32)
        self.hits = np.full((32, 3), 16, np.int64)  # order 2, order 1, order 0
        self.freq = np.ones(vocab, np.int64)
        self.steps = 0

    def predict(self, p1: np.ndarray, p2: np.ndarray) -> None:
        """Set for each lane, by the two ids before, the said ids and where their parts of 2**16 end."""
        if self.steps % _REFRESH == 0:
            if self.freq.sum() > _MOST:
                self.freq = (self.freq + 1) >> 1
            self.cum = np.append(0, np.cumsum(self.freq)).astype(np.uint32)  # at most _MOST and what a few steps add
            self.total, self.seen = int(self.cum[-1]), self.freq.astype(np.uint32)
            self.part = ((self.freq * ((1 << 40) // self.total)) >> 24).astype(np.uint32)
        self.steps += 1
        share = np.ascontiguousarray((self.hits * (65536 - 8) // self.hits.sum(axis=1)[:, None] + 1).T.astype(np.uint32))
        self.c1 = p1.astype(np.intp)  # the type that numpy looks up by
        self.c2 = ((p2.view(np.uint32) * np.uint32(0x9E3779B1) + p1.view(np.uint32) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - _HASH_BITS)).astype(np.intp)
        self.held2, self.held1 = self.pair.take(self.c2), self.first.take(self.c1)
        self.x2, self.x1 = self.held2 >> 2, self.held1 >> 2
        self.own = self.x1 != self.x2  # said by order 1 alone
        self.state = (self.held2 & 3) * 8 + (self.held1 & 3) * 2 + self.own
        w2, w1, w0 = (row.take(self.state) for row in share)
        by0, by0_first = ((w0 * self.part.take(x)) >> np.uint32(16) for x in (self.x2, self.x1))
        bounds = self.bounds = np.empty((4, len(p1)), np.uint32)
        bounds[0], bounds[3] = 0, 65536
        np.add(w2 + by0, w1 * ~self.own, out=bounds[1])
        np.add(bounds[1], (w1 + by0_first) * self.own, out=bounds[2])

    def interval(self, event: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the part of each lane's event begins in 2**16, and how long it is."""
        at = event * len(event) + np.arange(len(event))
        flat = self.bounds.reshape(-1)
        start = flat.take(at)
        return start.astype(np.uint64), (flat.take(at + len(event)) - start).astype(np.uint64)

    def others(self, at: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """For lanes ``at``: the said ids, what order 0 gives each (an id said twice once), and all else."""
        said = [self.x2.take(at), self.x1.take(at)]
        part = [self.seen.take(said[0]), self.seen.take(said[1]) * self.own.take(at)]
        return said, part, (self.total - part[0] - part[1]).astype(np.uint64)

    def update(self, ids: np.ndarray, event: np.ndarray, rare: np.ndarray) -> None:
        """Learn what the lanes' next ids were, and how each came (0: order 2, 1: order 1, 2, as at ``rare``: order 0)."""
        self.hits += np.bincount(self.state * 3 + event, minlength=96).reshape(32, 3) * 8
        if (over := self.hits.sum(axis=1) > 1 << 20).any():
            self.hits[over] = (self.hits[over] + 1) >> 1
        said = ids << 2
        for table_, context, held, x in ((self.pair, self.c2, self.held2, self.x2), (self.first, self.c1, self.held1, self.x1)):
            sure = held & 3
            table_[context] = np.where(ids == x, held + (sure < 3), np.where(sure > 0, held - 1, said))
        np.add.at(self.freq, ids.take(rare), _ADD)


def _layout(n: int, steps: int) -> tuple[int, int]:
    steps = max(1, min(steps, n))
    return steps, -(-n // steps)


def _before(said: list[np.ndarray], part: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """What order 0 gives the said ids below ``x``."""
    return part[0] * (said[0] < x) + part[1] * (said[1] < x)


def encode_block(ids: np.ndarray, vocab: int, steps: int = STEPS) -> bytes:
    """The bytes of one block; ``ids`` are below ``vocab``."""
    n = len(ids)
    steps, lanes = _layout(n, steps)
    head = (_MAGIC, n, vocab, steps, lanes, zlib.crc32(ids.astype("<u4").tobytes()))
    if not n:
        return _HEADER.pack(*head, zlib.crc32(b""))
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = _Model(vocab)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    all_lanes = np.arange(lanes, dtype=np.int32)
    who: list[np.ndarray] = []
    what: list[np.ndarray] = []

    def settle() -> None:
        at = np.flatnonzero(size <= _LOW32)
        if len(at):
            lo, sz = low[at], size[at]
            sz = np.where((lo ^ (lo + sz)) >> _32 != 0, (~lo + np.uint64(1)) & _LOW32, sz)
            who.append(all_lanes[at])
            what.append((lo >> _32).astype(np.uint32))
            low[at], size[at] = lo << _32, sz << _32

    p1 = p2 = np.full(lanes, vocab, np.int32)
    for now in grid:
        model.predict(p1, p2)
        event = np.where(now == model.x2, 0, np.where(now == model.x1, 1, 2))
        start, width = model.interval(event)
        unit = size >> _16
        low += unit * start
        size = unit * width
        settle()
        rare = np.flatnonzero(event == 2)
        if len(rare):
            x = now[rare]
            said, part, total = model.others(rare)
            unit = size[rare] // total
            low[rare] += unit * (model.cum.take(x) - _before(said, part, x)).astype(np.uint64)
            size[rare] = unit * model.seen.take(x).astype(np.uint64)
            settle()
        model.update(now, event, rare)
        p1, p2 = now, p1
    for word in ((low >> _32), low & _LOW32):
        who.append(all_lanes)
        what.append(word.astype(np.uint32))
    lane, words = np.concatenate(who), np.concatenate(what)
    order = np.argsort(lane.astype(np.uint16) if lanes < 1 << 16 else lane, kind="stable")
    body = np.bincount(lane, minlength=lanes).astype("<u4").tobytes() + words[order].astype("<u4").tobytes()
    return _HEADER.pack(*head, zlib.crc32(body)) + body


def decode_block(block: bytes) -> np.ndarray:
    """The ids of one block (uint32); ValueError where its bytes or its ids are not what was written."""
    magic, n, vocab, steps, lanes, crc, body = _HEADER.unpack_from(block)
    if magic != _MAGIC:
        raise ValueError("not a block of token ids")
    if zlib.crc32(memoryview(block)[_HEADER.size :]) != body:
        raise ValueError("the bytes of a block differ from their checksum")
    if not n:
        return np.zeros(0, np.uint32)
    lengths = np.frombuffer(block, "<u4", lanes, _HEADER.size).astype(np.int64)
    words = np.concatenate([np.frombuffer(block, "<u4", -1, _HEADER.size + 4 * lanes).astype(np.uint64), np.zeros(2, np.uint64)])
    at = np.cumsum(lengths) - lengths
    code = (words[at] << _32) | words[at + 1]
    at += 2
    model = _Model(vocab)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    grid = np.empty((steps, lanes), np.int32)

    def settle() -> None:
        i = np.flatnonzero(size <= _LOW32)
        if len(i):
            lo, sz = low[i], size[i]
            sz = np.where((lo ^ (lo + sz)) >> _32 != 0, (~lo + np.uint64(1)) & _LOW32, sz)
            code[i] = (code[i] << _32) | words[np.minimum(at[i], len(words) - 1)]
            at[i] += 1
            low[i], size[i] = lo << _32, sz << _32

    p1 = p2 = np.full(lanes, vocab, np.int32)
    for step in range(steps):
        model.predict(p1, p2)
        unit = size >> _16
        value = np.minimum((code - low) // unit, np.uint64(65535)).astype(np.uint32)
        event = (value >= model.bounds[1]).astype(np.int64) + (value >= model.bounds[2])
        start, width = model.interval(event)
        low += unit * start
        size = unit * width
        settle()
        now = np.where(event == 0, model.x2, model.x1)
        rare = np.flatnonzero(event == 2)
        if len(rare):
            said, part, total = model.others(rare)
            unit = size[rare] // total
            value = np.minimum((code[rare] - low[rare]) // unit, total - np.uint64(1)).astype(np.uint32)
            # Where each said id would stand among the others: what lies behind it is moved on by its part.
            moved = [p * (value >= model.cum.take(c) - _before(said, part, c)) for c, p in zip(said, part, strict=True)]
            x = np.searchsorted(model.cum, value + moved[0] + moved[1], "right") - 1
            now[rare] = x
            low[rare] += unit * (model.cum.take(x) - _before(said, part, x)).astype(np.uint64)
            size[rare] = unit * model.seen.take(x).astype(np.uint64)
            settle()
        grid[step] = now
        model.update(now, event, rare)
        p1, p2 = now, p1
    ids = np.ascontiguousarray(grid.T).reshape(-1)[:n].astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("the ids of a block differ from its checksum")
    return ids


def _gathered(ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of runs one after the other, and where each run begins, and the last ends, in them."""
    upto = np.append(0, np.cumsum(length))
    return ids[np.repeat(start - upto[:-1], length) + np.arange(upto[-1])], upto


class _Known:
    """Numbers of strings, and the ids of each."""

    def __init__(self) -> None:
        self.code = defaultdict(count().__next__)
        self.start, self.length, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def add(self, ids: np.ndarray, length: np.ndarray) -> None:
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(length) - length])
        self.length, self.ids = np.concatenate([self.length, length]), np.concatenate([self.ids, ids])

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _gathered(self.ids, self.start[codes], self.length[codes])


class _Ids:
    """The library's ids of texts, each distinct word encoded once while it is remembered."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel ones
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocab = max(self.tokenizer.get_vocab_size(), END_ID + 1)
        rules = json.loads(self.tokenizer.to_str())
        suffix = rules["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.vocab, bool)  # of ids: the last one of a piece
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        # Whether lower-case runs of letters, and runs of signs, are pieces; then the same file without its rules of
        # cutting encodes many of them at once.
        self.pieces = None
        if suffix and WORD_RULE in json.dumps(rules["pre_tokenizer"]).replace("\\\\", "\\"):
            cut = [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}]
            bare = {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": cut}, "added_tokens": [], "post_processor": None, "truncation": None, "padding": None}
            self.pieces = Tokenizer.from_str(json.dumps(rules | bare))
        self._clear()

    def _clear(self) -> None:
        self.words, self.parts = _Known(), _Known()
        self.parts.code[""]
        self.parts.add(np.empty(0, np.uint32), np.zeros(1, np.int64))

    def _learn(self, words: list[str]) -> None:
        """Remember new words: those of letters, or of letters and closing signs, by these two, others as they are."""
        code, other = self.parts.code, []
        before = len(code)
        two: list[int] = []
        for at, word in enumerate(words):
            letters = word.rstrip(_SIGNS) if self.pieces else ""
            if letters.isalpha() and (letters.isascii() or _LETTERS(letters)):
                two += code[letters.lower()], code[word[len(letters) :]]
            else:
                two += 0, 0
                other.append(at)
        if len(code) > before:
            fresh = [*islice(reversed(code), len(code) - before)][::-1]
            joined = [" ".join(fresh[a : a + _JOINED]) for a in range(0, len(fresh), _JOINED)]
            ids = np.fromiter(chain.from_iterable([e.ids for e in self.pieces.encode_batch_fast(joined, add_special_tokens=False)]), np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(fresh):
                raise ValueError("the tokenizer's pieces aren't those of its rules")
            self.parts.add(ids, np.diff(ends, prepend=0))
        ids, upto = self.parts.of(np.array(two, np.int64))
        length = np.diff(upto[::2])
        if other:
            coded = [e.ids for e in self.tokenizer.encode_batch_fast([words[i] for i in other], add_special_tokens=False)]
            start = upto[:-1:2].copy()
            length[other] = [len(x) for x in coded]
            start[other] = len(ids) + np.cumsum(length[other]) - length[other]
            ids = _gathered(np.concatenate([ids, np.fromiter(chain.from_iterable(coded), np.uint32)]), start, length)[0]
        self.words.add(ids, length)

    def of(self, texts: pa.Array) -> list[np.ndarray]:
        if len(self.words.code) > _WORDS:
            self._clear()
        lists = pc.ascii_split_whitespace(texts)  # an empty word at either end has no ids
        words = lists.flatten().dictionary_encode()
        code, before = self.words.code, len(self.words.code)
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        codes = np.fromiter(map(code.__getitem__, distinct), np.int64, len(distinct))
        if len(code) > before:
            self._learn([*islice(reversed(code), len(code) - before)][::-1])
        ids, upto = self.words.of(codes[words.indices.to_numpy()])
        at = upto[np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))].tolist()
        return [ids[a:b] for a, b in zip(at, at[1:], strict=False)]


@lru_cache(1)
def _ids_of_worker(path: str) -> _Ids:
    return _Ids(path)


_FILE = "part int, block int, doc_ids array<{id}>, lengths array<long>, n_ids long, crc32 long, bytes binary"


def write_token_file(docs: DataFrame, path: str | None = None, block: int = BLOCK, what: str = "token-file") -> DataFrame:
    """The token file of ``docs`` (doc_id, text), written as a Parquet table of blocks in the shared folder.

    Documents are in ascending order of doc_id (nulls first, equal ids by text) over part and block; each has the ids
    of its whole text and END_ID. A block holds whole documents: their ids and lengths, and the coded bytes with their
    CRC-32. Texts are encoded word by word, words being cut at ASCII white space, which the tokenizer's rules never
    join across.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", text_of("text").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _ids_of_worker(path or vocabulary_path())
        part, number = TaskContext.get().partitionId(), 0
        id_type = None
        names: list = []
        lengths: list[int] = []
        held: list[np.ndarray] = []
        size = 0
        end = np.array([END_ID], np.uint32)

        def flush() -> pa.RecordBatch:
            data = encode_block(np.concatenate(held).astype(np.int64), coder.vocab)
            columns = [[part], [number], [list(names)], [list(lengths)], [size], [zlib.crc32(data)], [data]]
            kinds = [pa.int32(), pa.int32(), pa.list_(id_type), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "block", "doc_ids", "lengths", "n_ids", "crc32", "bytes"])

        for batch in small_batches(batches, most=_SLICE):
            id_type = batch.column("doc_id").type
            coded = coder.of(batch.column("text"))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coded, strict=True):
                ids = np.append(ids, end)
                if size and size + len(ids) > block:
                    yield flush()
                    number, size = number + 1, 0
                    names, lengths, held = [], [], []
                names.append(doc_id)
                lengths.append(len(ids))
                held.append(ids)
                size += len(ids)
        if size:
            yield flush()

    return written(rows.mapInArrow(blocks, _FILE.format(id=kind)), what)


def read_token_file(file: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document in a file of :func:`write_token_file`.

    Every block is decoded and both its checksums are compared; a block that fails ends the job.
    """
    kind = file.schema["doc_ids"].dataType.elementType.simpleString()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, number, at, names, lengths, crc, data = (batch.column(c)[row] for c in ("part", "block", "block_at", "doc_ids", "lengths", "crc32", "bytes"))
                data = data.as_py()
                if zlib.crc32(data) != crc.as_py():
                    raise ValueError(f"part {part}, block {number}: the bytes differ from their checksum")
                ids, lengths = decode_block(data), np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(lengths)
                each = [ids[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                columns = [names.values, pa.array(at.as_py() + ends - lengths), pa.array(lengths), pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())]
                fields = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, fields = [*columns, pa.array(each, pa.list_(pa.uint32())).cast(pa.list_(pa.int32()))], [*fields, "ids"]
                yield pa.RecordBatch.from_arrays(columns, fields)

    # Where blocks start: one row a block, summed within a part, then one row a part. Known before a block is decoded.
    size = file.select("part", "block", "n_ids")
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = size.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("part_at"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    block_at = F.col("part_at") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))
    starts = size.join(parts, "part").select("part", "block", block_at.alias("block_at"))
    schema = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return file.join(starts, ["part", "block"]).mapInArrow(decoded, schema)


def token_file_round_trip(docs: DataFrame, path: str | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row of ``docs``, read back from a token file of them.

    A null text is an empty one (END_ID alone); one with more than ``block`` ids has a block of its own; repeated rows
    are all written; a null doc_id comes first. An empty table gives an empty result; other columns are not looked at.
    """
    return read_token_file(write_token_file(docs, path, block))


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, number of ids and checksum of them, read back from the file."""
    return token_file_round_trip(table(spark, sf_dir, "documents"))
