"""The whole pipeline against a brute-force version of each of its stages."""

import hashlib
import sys
from collections import Counter
from pathlib import Path

from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
from test_dedup import brute_components, brute_fingerprint, normal  # noqa: E402
from test_scans import SMALL, brute_held_out  # noqa: E402

import corpus_pipeline  # noqa: E402
from veritally.llm import bpe, mixing, quality  # noqa: E402
from veritally.llm.common import table  # noqa: E402


def test_pipeline(spark):
    docs = table(spark, SMALL, "documents")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    label = {r["doc_id"]: r["quality"] for r in table(spark, SMALL, "labels").collect()}
    scored, least = brute_held_out([*text.items()], *({i for i, q in label.items() if q == k} for k in (1, 0)))
    kept = [i for i, _, failed, llr in scored if not failed and llr >= least - 1e-9]
    assert len(kept) > 0.9 * sum(not failed and i not in label for i, _, failed, _ in scored)
    first = {}
    for i in sorted(kept):
        first.setdefault(normal(text[i]), i)
    fps = {i: brute_fingerprint(text[i]) for i in first.values()}
    root = brute_components(fps.values())
    near = {}
    for i in sorted(fps):
        near.setdefault(root[fps[i]], i)
    left = docs.where(docs.doc_id.isin([*near.values()]))
    want = Counter()
    for r in mixing.mix_sources(left).collect():
        if r["taken"]:
            want[r["doc_id"]] = int(r["taken"] / r["size"] + 0.5)
    library = Tokenizer.from_file(bpe.vocabulary_path())
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter(r["doc_id"] for r in got) == +want
    for r in got:
        ids = library.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


#: Names that the operators use inside, each as a column with values of its own.
CLASHING = ["trusted", "_of", "_key", "_key_0", "key_0", "_n", "_id", "_source", "_text", "carried", "id", "of", "key", "n", "my_id", "my_key", "shard", "row", "digest", "a.b", "_range", "copies"]


def test_stages_keep_clashing_columns(spark):
    """Columns of any name come out of every stage with the values that they had."""
    frame = table(spark, SMALL, "documents").limit(60)
    rows = [(*r, *(r["doc_id"] * 100 + i for i in range(len(CLASHING)))) for r in frame.collect()]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in CLASHING)
    wide = spark.createDataFrame([*rows, rows[0]], schema)
    known = {r[0]: r for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, SMALL)
        assert out.columns == wide.columns
        kept = [tuple(r) for r in out.collect()]
        assert kept and all(r == known[r[0]] for r in kept), name
    labels = spark.createDataFrame([(r[0], r[0] % 2, 0, 1, 2) for r in rows], "doc_id long, quality int, toxic int, trusted int, _of int")
    assert quality.quality_rules(wide, labels, held_out=True).count() == len(rows) + 1
    assert {r["doc_id"] for r in bpe.bpe_round_trip(wide).collect()} == known.keys()


def test_stages_take_odd_rows(spark, docs, empty):
    """Null ids and texts, repeated rows and clashing columns; an empty table stays empty."""
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        kept = out.collect()
        if name != "bpe":
            assert out.columns == docs.columns
            assert {r["doc_id"] for r in kept} <= {r["doc_id"] for r in docs.collect()}
        if name == "exact dedup":
            texts = [normal(r["text"]) for r in kept]
            assert len(texts) == len(set(texts)) == len({normal(r["text"]) for r in docs.collect()})
        if name == "bpe":
            assert len(kept) == docs.count()
        assert stage(spark, empty, SMALL).count() == 0
