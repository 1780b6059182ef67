"""BPE and the token file against the tokenizers library, and exact round trips."""

import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from veritally.llm import bpe, tokenfile


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_bpe(docs, rows, empty, library):
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted((tuple(r) for r in bpe.bpe_round_trip(docs).collect()), key=str) == sorted(want, key=str)
    texts = sorted(r["text"] for r in bpe.bpe_decode(bpe.bpe_encode(docs)).collect())
    assert texts == sorted(library.decode(library.encode(r[1] or "", add_special_tokens=False).ids, skip_special_tokens=False) for r in rows)
    assert bpe.bpe_round_trip(empty).count() == 0


def test_token_file(docs, rows, empty, library):
    """With blocks that end inside parts, and texts longer than a block, too."""
    want, at = [], 0
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    for block in (tokenfile.BLOCK, 300, 1):
        got = tokenfile.token_file_round_trip(docs, block=block).orderBy("start").collect()
        assert [tuple(g) for g in got] == want
    file = tokenfile.write_token_file(docs, block=300)
    assert file.agg({"block": "max"}).first()[0] > 1
    assert file.where("n_ids > 300").agg({"doc_ids": "count"}).first()[0] > 0
    assert tokenfile.token_file_round_trip(empty).count() == 0


def test_ids_of_odd_words(library):
    """Words of every kind, one coder for all of them."""
    import pyarrow as pa

    coder = tokenfile._Ids(bpe.vocabulary_path())
    kinds = ["Word", "naïve", "ÀÉÎ", "ß", "İstanbul", "ſ", "don't", "WE'LL", "it's.", "a.b", "..", "$$$", "x<|endoftext|>", "<|startoftext|>", "漢字", "e\u0301", "x\u00a0y", "3rd", "№5", "\u200b", "end.\u2028", "word'", "'s", "L'été!?"]
    r = np.random.default_rng(4)
    texts = ["", " ", "\n lead and trail \t", *(" ".join(r.choice(kinds, 20)) for _ in range(60)), *("".join(r.choice(kinds, 5)) for _ in range(60))]
    for _ in range(2):  # the second time all is remembered
        got = coder.of(pa.array(texts))
        assert [g.tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_blocks_are_small(spark):
    """At least 5 % less than the order-0 entropy of the same ids, on the texts of sf0.01; a repeated text less than a third."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].fill_null("").combine_chunks()
    ids = np.concatenate(tokenfile._Ids(bpe.vocabulary_path()).of(texts)).astype(np.int64)
    share = np.bincount(ids) / len(ids)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    data = tokenfile.encode_block(ids, 49408)
    assert 8 * len(data) / len(ids) < 0.95 * entropy
    assert (tokenfile.decode_block(data) == ids).all()
    again = np.tile(ids[:1000], 500)
    assert 8 * len(tokenfile.encode_block(again, 49408)) / len(again) < entropy / 3


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 5000])
def test_block(n):
    r = np.random.default_rng(n)
    ids = np.where(r.random(n) < 0.7, r.integers(0, 20, n), r.integers(0, 49408, n)).astype(np.int64)
    for steps in (1, 7, 1024):
        data = tokenfile.encode_block(ids, 49408, steps)
        assert (tokenfile.decode_block(data) == ids).all()


def test_damaged_block():
    data = bytearray(tokenfile.encode_block(np.arange(500), 49408))
    data[-3] ^= 255
    with pytest.raises(ValueError):
        tokenfile.decode_block(bytes(data))
