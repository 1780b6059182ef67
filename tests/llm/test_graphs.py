"""Nearest vectors, source divergence and the conversation trie against brute force."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from test_scans import SMALL  # noqa: E402

from veritally.llm import divergence, neighbours, trie  # noqa: E402
from veritally.llm.common import table  # noqa: E402

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def oracle(sql, **tables):
    """Rows of a query's SQL, columns by name."""
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    out = con.sql(sql)
    at = [out.columns.index(c) for c in sorted(out.columns)]
    return Counter(tuple(r[i] for i in at) for r in out.fetchall())


def got(df):
    return Counter(tuple(r) for r in df.select(*sorted(df.columns)).collect())


# --- nearest vectors


def brute_nearest(rows, every, most=5):
    """query -> [(vec_id, score)] nearest first, over sound rows."""

    def sound(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    rows = [(i, [float(x) for x in v]) for i, v in rows if i is not None and sound(v)]
    asked = {}
    for i, v in rows:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    out = {}
    for q, v in asked.items():
        scored = [(sum(a * b for a, b in zip(v, w)) / math.sqrt(sum(a * a for a in v)) / math.sqrt(sum(b * b for b in w)), i) for i, w in rows if i != q and len(w) == len(v)]
        out[q] = [(i, s) for s, i in sorted(scored, key=lambda x: (-round(x[0], 12), x[1]))[:most]]
    return out


@pytest.mark.parametrize("shard", [8192, 300])
def test_nearest_vectors_recall(spark, shard):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SMALL.replace("sf0.001", "sf0.1"), "embeddings").collect()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute_nearest(rows, 50)
    found = defaultdict(list)
    for r in neighbours.nearest_vectors(df, df.where("vec_id % 50 = 0"), shard=shard).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert found.keys() == want.keys()
    hit = 0
    for q, rows in found.items():
        assert [r[0] for r in rows] == [1, 2, 3, 4, 5]
        assert [(-s, i) for _, i, s in rows] == sorted((-s, i) for _, i, s in rows)
        known = dict(want[q])
        hit += len(known.keys() & {i for _, i, _ in rows})
        for _, i, s in rows:
            assert i not in known or abs(known[i] - s) < 1e-12
    assert hit >= 0.97 * 5 * len(want)


def test_nearest_vectors_odd_rows(spark):
    """Nulls, zeros, odd components, other sizes, ties, repeated rows and ids, huge and tiny numbers, few rows."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0, 3.0]), (0, [1.0, 2.0, 2.0]), (1, [2.0, 4.0, 4.0]), (2, [2.0, 4.0, 4.0]), (2, [2.0, 4.0, 4.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 1.0])]
    rows += [(7, [nan, 1.0, 1.0]), (8, [inf, 1.0, 1.0]), (9, [1e300, 2e300, 2e300]), (10, [1e-310, 2e-310, 2e-310]), (11, [-1.0, -2.0, -2.0]), (None, [1.0, 2.0, 2.0]), (12, [1.0, 1.0]), (50, [3.0, 1.0]), (100, [1.0] * 4), (150, None)]
    df = spark.createDataFrame([(*r, 1, 2, True) for r in rows], "vec_id long, embedding array<double>, shard int, vec int, asks boolean")
    out = defaultdict(list)
    for r in neighbours.nearest_vectors(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["vec_id"], round(r["score"], 9)))
    assert out == {0: [(1, 1.0), (2, 1.0), (2, 1.0), (9, 1.0), (10, 1.0)], 50: [(12, round(4 / math.sqrt(20), 9))]}
    none = df.where("false")
    assert neighbours.nearest_vectors(none, none).count() == 0


def test_nearest_vectors_few_and_copies(spark):
    """All candidates where there are fewer than asked for; of many equal vectors the smallest ids."""
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in neighbours.nearest_vectors(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 2, 0.0), (0, 2, 1, -1.0)]
    same = np.random.default_rng(1).standard_normal(16).tolist()
    many = spark.createDataFrame([(i, same) for i in range(400)], "vec_id long, embedding array<double>")
    out = neighbours.nearest_vectors(many, many.where("vec_id % 50 = 0"), shard=64).collect()
    assert {(r["query_id"], r["vec_id"]) for r in out} == {(q, i) for q in range(0, 400, 50) for i in [x for x in range(6) if x != q][:5]}
    assert {r["score"] for r in out} == {1.0}


def test_nearest_vectors_windows_as_counted_line_by_line():
    """What lies in the windows, told by comparing all places at once, is what each line by itself tells; a query costs few passes."""
    r = np.random.default_rng(4)
    vectors = r.standard_normal((500, 16))
    shard = neighbours.Shard(np.arange(500), vectors)
    shard.off = np.abs(shard.at - shard.at[:, :1])
    for radius in neighbours.RADII:
        want = sum((np.abs(line - line[0]) <= np.float32(neighbours.HALF * radius)).astype(int) for line in shard.at)
        assert shard._hits(radius).tolist() == want.tolist()
    passes = []
    plain = shard._hits
    shard._hits = lambda radius: passes.append(radius) or plain(radius)
    found = [*shard.search(np.arange(20), vectors[:20], 5)]
    assert all(len(at) == 5 and i not in at for i, (at, _) in enumerate(found)) and len(passes) <= 20 * 8


# --- source divergence


def brute_divergence(rows, least):
    rows = [tuple(x or "" for x in r) for r in rows]
    df, n = Counter(), Counter()
    for text, lang, source in rows:
        found = TERM.findall(text.translate(UPPER))
        df.update((lang, t) for t in set(found))
        n.update((lang, source, t) for t in found)
    kept = defaultdict(list)
    for (lang, t), d in df.items():
        if d >= least:
            kept[lang].append(t)
    groups = {(lang, source) for _, lang, source in rows}

    def shares(count, terms):
        total = sum(count.values())
        return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(terms)) for t in terms}

    p = {g: shares(Counter({t: n[(*g, t)] for t in kept[g[0]]}), kept[g[0]]) for g in groups}
    q = {lang: shares(Counter({t: sum(n[(*g, t)] for g in groups if g[0] == lang) for t in kept[lang]}), kept[lang]) for lang, _ in groups}
    out = []
    for lang, source in groups:
        mine = p[lang, source]
        pairs = [(s, sum(abs(mine[t] - p[lang, s][t]) for t in mine)) for x, s in groups if x == lang and s != source]
        terms = [(t, mine[t] - q[lang][t]) for t in mine if n[lang, source, t] and mine[t] > q[lang][t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, 50)):
            ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(item, lang, part, i + 1, source, v) for i, (item, v) in enumerate(ranked)]
    return Counter(out)


def test_source_divergence(spark, docs, rows, empty):
    r = random.Random(3)
    words = [f"{a}{b}" for a in ("na", "Ébo", "ﬁx", "zu", "漢") for b in "abcdefghij"]
    more = [(1000 + i, " ".join(r.choice(words[: 10 + 8 * (i % 6)]) for _ in range(r.randint(0, 40))), ["en", "fr", None][i % 3], f"src{i % 4}", *rows[0][4:]) for i in range(150)]
    whole = docs.unionByName(spark.createDataFrame(more, docs.schema))
    told = [(x[1], x[2], x[3]) for x in rows + more]
    for least in (1, 3, 30):
        assert got(divergence.source_divergence(whole, least)) == brute_divergence(told, least)
    assert divergence.source_divergence(empty).count() == 0
    assert got(divergence.source_divergence(docs.where("text is null"))) == brute_divergence([x for x in told if x[0] is None], 30)


def test_source_divergence_sql(spark):
    documents = table(spark, SMALL, "documents")
    assert got(divergence.source_divergence(documents)) == oracle(divergence.OP12_SQL, documents=documents.toPandas())


def test_sketch_never_tells_too_few(spark, docs, rows):
    """A narrow sketch tells too many, never too few; a cell stops at 255."""
    docs = docs.selectExpr("coalesce(lang, '') as lang", "cast(coalesce(text, '') as binary) as text")
    docs = docs.unionByName(spark.range(300).selectExpr("'en' as lang", "cast('often' as binary) as text"))
    width = 64
    cells = np.zeros((divergence.ROWS, width), np.uint8).reshape(-1, min(divergence.BLOCK, width))
    for r in divergence.document_frequencies(docs, width).collect():
        cells[r["block"]] = np.frombuffer(r["cells"], np.uint8)
    cells = cells.reshape(divergence.ROWS, width)
    true = Counter({("en", b"often"): 300})
    for _, text, lang, *_ in rows:
        true.update((lang or "", t) for t in set(divergence.terms((text or "").encode())))
    for (lang, t), n in true.items():
        told = min(cells[r, at[0]] for r, at in enumerate(divergence._places(lang, [t], width)))
        assert told >= min(n, 255)
    assert divergence.sketch_width(0) == divergence.FEW and divergence.sketch_width(10**12) == divergence.MANY


# --- conversation trie


def brute_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    built = {}
    for c, own in turns.items():
        base = int(math.fmod(c, 5))
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own if base == 0 else turns.get(c - base, [])[:h] + own[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
        ends[tuple(built[c])].append(c)
    out = Counter()
    for node, convs in members.items():
        under = [x for x in members if x[: len(node)] == node]
        leaves = [x for x in under if not any(y[:-1] == x for y in under if len(y) == len(x) + 1)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x)
        kids = sum(len(x) == len(node) + 1 for x in under)
        parent = members[node[:-1]][0] if node else None
        sha = hashlib.sha256(",".join(map(str, ends.get(node, []))).encode()).hexdigest()
        out[convs[0], len(node), sha, kids, len(convs), len(leaves), parent, saved] += 1
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, i long, depth int, node string, up long, _range int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 9, 9, "n", 9, 9) for r in rows], CONVERSATIONS)


def test_trie(spark):
    """Shared beginnings, copies, snapshots of one conversation, long ones, odd ids, nulls, an id without its base."""
    r = random.Random(4)
    rows = []
    for c in [*range(-7, 60), 1000, 1001, 1003, 2002, 10**12 + 1]:
        if c in (10, 20, 21):
            continue
        text = ["hello", "héllo", "", "start"][abs(c) % 4]
        for t in range(r.randint(1, 12) if c != 30 else 70):
            rows.append((c, t, ["user", "assistant", None][t % 3], text if t < 3 else r.choice(["yes", "no", None, "漢字"])))
    rows += [(c, t, "user", f"snap {t}") for c in range(105, 405, 5) for t in range((c - 100) // 5)]
    rows += [(500, None, "user", "null turn"), (500, 0, "user", "first"), (None, 0, "user", "nobody's"), (505, 1, None, None), (505, 1, None, None)]
    r.shuffle(rows)
    out = trie.conversation_trie(conversations(spark, rows).repartition(6))
    assert got(out.withColumnsRenamed({})) == brute_trie(rows)


@pytest.mark.parametrize("rows", [[], [(1, 0, "user", "x")], [(c, 0, "user", "same") for c in range(40)], [(None, None, None, None)]])
def test_trie_small(spark, rows):
    """No conversation; one that is left without turns; copies; a row without a conversation."""
    assert got(trie.conversation_trie(conversations(spark, rows))) == brute_trie(rows)


def test_trie_sql(spark):
    rows = table(spark, SMALL, "conversations")
    assert got(trie.conversation_trie(rows)) == oracle(trie.OP13_SQL, conversations=rows.toPandas())
    assert got(trie.conversation_trie(rows)) == brute_trie([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])
