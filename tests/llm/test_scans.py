"""Quality rules, url filter, secret scan, mixing and language identification against brute force."""

import hashlib
import heapq
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from veritally.llm import language, mixing, quality, secrets, urlfilter
from veritally.llm.common import new_path, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


def buckets_of(words, size):
    h = [xxhash.xxh64_intdigest(w.encode()) for w in words]
    pairs = [(a * 0x9E3779B97F4A7C15 + b) % (1 << 64) for a, b in zip(h, h[1:], strict=False)]
    return [x % size for x in h] + [(x ^ (x >> 29)) % size for x in pairs]


def brute_quality(rows, trusted, size=quality.BUCKETS):
    raw, target = Counter(), Counter()
    for i, text in rows:
        grams = buckets_of(WORD.findall(text or ""), size)
        raw.update(grams)
        if i in trusted:
            target.update(grams)
    n_raw, n_target = sum(raw.values()) + size, sum(target.values()) + size
    out = []
    for i, text in rows:
        text = text or ""
        words = WORD.findall(text)
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        seen = Counter(windows)
        repeats = len({k + j for k, w in enumerate(windows) if seen[w] > 1 for j in range(5)})
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(words) < 10 or 100 * repeats > 20 * len(words)
        grams = buckets_of(words, size)
        llr = sum(math.log((target[g] + 1) / n_target) - math.log((raw[g] + 1) / n_raw) for g in grams) / max(1, len(grams)) if n_target > size else 0.0
        out.append((i, len(words), sum(map(len, words)), len(re.findall(quality.SYMBOLS, text)), len(lines) - len(set(lines)), repeats, failed, not failed and llr >= quality.THRESHOLD, llr))
    return out


def test_quality(spark, docs, rows, empty):
    labels = spark.createDataFrame([(7, 1, 0), (16, 1, 0), (19, 0, 0), (None, 1, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    got = sorted((tuple(r) for r in quality.quality_rules(docs, labels).collect()), key=str)
    want = sorted(brute_quality([r[:2] for r in rows], {7, 16}), key=str)
    assert [g[:8] for g in got] == [w[:8] for w in want]
    assert all(abs(g[8] - w[8]) < 1e-9 for g, w in zip(got, want, strict=True))
    stage = quality.quality_stage(docs, labels)
    assert stage.columns == docs.columns and stage.count() == sum(w[7] for w in want)
    assert quality.quality_rules(empty, labels).count() == 0
    assert {r["llr"] for r in quality.quality_rules(docs, labels.limit(0)).collect()} == {0.0}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_quality_keeps_clean_documents_at_any_size(spark, sf):
    at = f"/root/testdata/{sf}"
    label = {r["doc_id"]: r["quality"] for r in table(spark, at, "labels").collect()}
    signs = {r["doc_id"] for r in table(spark, at, "documents").where(f"text rlike '{quality.SYMBOLS}'").select("doc_id").collect()}
    judged = [(r["doc_id"], r["kept"]) for r in quality.op1_quality_rules(spark, at).where("not base_failed").collect()]
    clean = [kept for i, kept in judged if i not in label and i not in signs]
    bad = [kept for i, kept in judged if label.get(i) == 0]
    assert sum(clean) >= 0.95 * len(clean) > 0
    assert sum(bad) <= 0.4 * len(bad)


def brute_held_out(rows, trusted, bad=()):
    """doc_id, words, whether the base rules fail and the score of each row, and the threshold."""
    size = quality.BUCKETS
    raw, target, out = Counter(), Counter(), []
    for i, text in rows:
        grams = buckets_of(WORD.findall(text or ""), size)
        raw.update(grams)
        if i in trusted:
            target.update(grams)
    n_raw, n_target = sum(raw.values()), sum(target.values())
    for (i, text), base in zip(rows, brute_quality(rows, ()), strict=True):
        own = Counter(buckets_of(WORD.findall(text or ""), size))
        n, mine = sum(own.values()), i in trusted
        share = (n_target - n * mine) / max(1, n_raw - n)
        llr = sum(c * (math.log(target[g] - c * mine + 1) - math.log((raw[g] - c) * share + 1)) for g, c in own.items()) / max(1, n)
        out.append((i, base[1], base[6], llr))
    least = {}
    for i, _, failed, llr in out:
        if not failed:
            least[i] = min(llr, least.get(i, llr))
    good, worse = (np.array([least[i] for i in ids if i in least]) for ids in (trusted, set(bad) - set(trusted)))
    return out, quality.held_out_threshold(good, worse)


def test_quality_held_out(spark, docs, rows, empty):
    labels = spark.createDataFrame([(7, 1, 0), (16, 1, 0), (19, 0, 0), (None, 1, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    got = sorted((r["doc_id"] or -1, r["n_words"], r["llr"], r["kept"]) for r in quality.quality_rules(docs, labels, held_out=True).collect())
    scored, least = brute_held_out([r[:2] for r in rows], {7, 16}, {19})
    want = sorted((i or -1, n, llr, not failed and llr >= least - 1e-9) for i, n, failed, llr in scored)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 1e-9 and g[3] == w[3] for g, w in zip(got, want, strict=True))
    assert quality.quality_stage(docs, labels, held_out=True).columns == docs.columns
    assert quality.quality_rules(empty, labels, held_out=True).count() == 0
    assert all(r["llr"] == 0 and r["kept"] != r["base_failed"] for r in quality.quality_rules(docs, labels.limit(0), held_out=True).collect())


def test_quality_counts_every_trusted_document(spark):
    """Where all are trusted the target is what is expected, at any number of documents."""
    ids = spark.range(60_000).selectExpr("id as doc_id")
    docs = ids.selectExpr("doc_id", "concat('w', doc_id % 977, ' v', doc_id % 89, ' u', doc_id * 7 % 613) as text")
    out = quality.quality_rules(docs, ids.selectExpr("doc_id", "1 as quality"), held_out=True)
    assert out.where("abs(llr) < 1e-9").count() == 60_000


@pytest.mark.parametrize("most", [32, 1 << 26])
def test_quality_full_bitmap(spark, docs, rows, monkeypatch, most):
    """A bitmap that tells hardly any doc_id apart costs time alone; labels may have ids of another type."""
    monkeypatch.setattr(quality, "MOST_BITS", most)
    labels = spark.createDataFrame([(str(i), i % 3 % 2) for i in range(1, 30)], "doc_id string, quality int")
    got = sorted((r["doc_id"] or -1, r["llr"], r["kept"]) for r in quality.quality_rules(docs, labels, held_out=True).collect())
    scored, least = brute_held_out([r[:2] for r in rows], {i for i in range(1, 30) if i % 3 == 1}, {i for i in range(1, 30) if i % 3 != 1})
    want = sorted((i or -1, llr, not failed and llr >= least - 1e-9) for i, _, failed, llr in scored)
    assert [(g[0], g[2]) for g in got] == [(w[0], w[2]) for w in want]
    assert all(abs(g[1] - w[1]) < 1e-9 for g, w in zip(got, want, strict=True))


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?y#z", "http://x.net", "http://bad.org/", "http://sub.bad.org/fr/1", "http://notbad.org/a", "HTTPS://example.com/de/1", "http://example.com?q=/de/", "x://bad.org#f", "http://y.example.net/en", "http://u:p@bad.org:80/"]
    pages = spark.createDataFrame([(i, u, True) for i, u in enumerate(urls)] + [(None, urls[5], None)], "page_id long, url string, listed boolean")
    listed = spark.createDataFrame([("bad.org",), ("bad.org",), (None,), ("absent.com",)], "key string")

    def judge(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        bad = host == "bad.org" or host.endswith(".bad.org")
        return (host, path, max(fits)[1], max(fits)[2], bad) if fits else (host, path, None, "block" if bad else "allow", bad)

    want = sorted(((i, *judge(u)) for i, u in [*enumerate(urls), (None, urls[5])]), key=str)
    for settings in ({}, {"held": 0}, {"shard": 3, "last": 0}, {"shard": 3, "held": 0}):  # broadcast, and shard by shard
        got = urlfilter.url_verdicts(pages, listed, **settings)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
        assert urlfilter.url_verdicts(pages.limit(0), listed, **settings).count() == 0
        none = urlfilter.url_verdicts(pages, listed.limit(0), **settings)
        assert not any(r["listed"] for r in none.collect())


def test_cascade_of_thousands(spark):
    """6,000 listed keys among 40,000 hosts, a long url, and repeated rows of one host, over several levels and shards."""
    hosts = [f"h{i % 9000}.s{i}.{('com', 'net', 'de')[i % 3]}" for i in range(40_000)]
    bad = {f"s{i}.{('com', 'net', 'de')[i % 3]}" for i in range(0, 40_000, 8)} | {f"absent{i}.org" for i in range(1000)}
    urls = [*((i, f"x://{h}/{i}") for i, h in enumerate(hosts)), *((i, "x://" + hosts[8]) for i in range(5000)), (1, "x://" + "a." * 20_000 + hosts[16] + "/" + "b" * 100_000)]
    pages = spark.createDataFrame(urls, "page_id long, url string").repartition(4)
    listed = spark.createDataFrame([(k,) for k in bad], "key string")
    hit = [h for i, h in enumerate(hosts) if i % 8 == 0]
    want = Counter({h: 1 for h in hit}) + Counter({hosts[8]: 5000, "a." * 20_000 + hosts[16]: 1})
    for settings in ({}, {"shard": 9000, "last": 0}, {"shard": 9000, "held": 0}):
        got = urlfilter.url_verdicts(pages, listed, rules=(), **settings).where("verdict = 'block'").groupBy("host").count()
        assert Counter(dict(map(tuple, got.collect()))) == want
    key = [int(xxhash.xxh64_intdigest(str(i))) for i in range(120_000)]
    h = np.array(key[:60_000], np.uint64), np.array(key[60_000:], np.uint64) | np.uint64(1)
    levels = urlfilter.cascade((h[0][:9000], h[1][:9000]), h, last=0)
    assert len(levels) > 4 and (urlfilter.in_cascade(levels, *h) == (np.arange(60_000) < 9000)).all()
    closed = urlfilter.cascade((h[0][:9000], h[1][:9000]), h)
    assert isinstance(closed[-1], urlfilter.Last) and len(closed) < len(levels) and (urlfilter.in_cascade(closed, *h) == (np.arange(60_000) < 9000)).all()


def brute_spans(text):
    spans = []
    for k, (kind, regex, least, group) in enumerate(secrets.RULES):
        spans += [(m.start(), k, m.end(), kind) for m in re.finditer(regex, text or "") if len(m[group]) >= least]
    return [(k, f"{kind}:{a}:{b}") for a, k, b, kind in sorted(spans)]


def test_secrets(spark, docs, rows, empty):
    ledger = new_path(spark, "ledger")
    want = []
    for r in rows:
        spans = brute_spans(r[1])
        n = Counter(k for k, _ in spans)
        base = ",".join(s for k, s in spans if k < 3)
        want.append((r[0], n[0], n[1], n[2], hashlib.sha256(base.encode()).hexdigest(), ",".join(s for _, s in spans)))
    for _ in range(2):  # the second scan finds everything in the ledger
        got = secrets.scan_secrets(docs, ledger)
        assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
        assert spark.read.parquet(ledger).count() == len({r[1] or "" for r in rows})
    assert secrets.scan_secrets(empty, new_path(spark, "ledger")).count() == 0
    # Other rules have a version of their own: what these found in the ledger isn't theirs.
    fewer = secrets.scan_secrets(docs, ledger, secrets.RULES[:3])
    assert {r["spans"] for r in fewer.collect()} == {",".join(s for k, s in brute_spans(r[1]) if k < 3) for r in rows}


def test_many_secrets_in_one_text(spark):
    """100,000 matches, some too short, in one text: time in proportion to them."""
    text = " ".join(f"token={i:06d}" + "é" * (i % 2) if i % 5 else f"pw secret:{i % 1000}" for i in range(100_000))
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.perf_counter()
    got = secrets.scan_secrets(frame, new_path(spark, "ledger")).first()
    assert got["spans"] == ",".join(s for _, s in brute_spans(text)) and got["n_assign"] > 70_000
    assert time.perf_counter() - began < 60


def brute_targets(sizes, rounds=3):
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(rounds * sizes[s] for s in full)
        free = sum(w for s, w in weights.items() if s not in full)
        target = {s: rounds * sizes[s] if s in full else rest * w / free for s, w in weights.items()}
        over = {s for s in sizes if s not in full and target[s] > rounds * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing(spark, docs, rows, empty):
    for frame, own in ((docs, rows), (table(spark, SMALL, "documents"), [(r["doc_id"], r["text"], None, r["source"]) for r in table(spark, SMALL, "documents").collect()])):
        got = mixing.mix_sources(frame).collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sources(frame.repartition(3)).collect()), key=str)
        sizes = Counter()
        for r in own:
            sizes[r[3]] += len(WORD.findall(r[1] or ""))
        source = defaultdict(set)
        for r in own:
            source[r[0]].add(r[3])
        targets = brute_targets(sizes)
        taken = Counter()
        assert len(got) == len(own)
        for g in got:
            s = next(s for s in source[g["doc_id"]] if sizes[s] == g["source_size"])
            assert g["target"] == pytest.approx(targets[s]) and 0 <= g["taken"] <= 3 * g["size"]
            taken[s] += g["taken"]
        assert all(abs(taken[s] - t) <= max(64, 0.02 * t) for s, t in targets.items())
    assert mixing.mix_sources(empty).count() == mixing.mix_stage(empty).count() == 0
    assert mixing.mix_stage(docs).columns == docs.columns


def test_mix_stage_keeps_long_documents_of_thin_sources(spark):
    def doc(i, source, n):
        return (i, " ".join(f"{source}{i}w{k}" for k in range(n)), source)

    frame = spark.createDataFrame([doc(i, "a", 200) for i in range(2000)], "doc_id long, text string, source string")
    shard = F.pmod(F.xxhash64(F.lit(mixing.SEED), "doc_id", F.xxhash64("text")), F.lit(39))
    long = {r["s"]: r["doc_id"] for r in frame.select("doc_id", shard.alias("s")).collect()}
    assert len(long) == 39  # one long document in each shard, 0.3 of it taken
    rows = [doc(i, "a", 200) for i in long.values()] + [doc(i, "bc"[i % 5 > 1], 10) for i in range(3000, 3500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = Counter({s: sum(len(r[1].split()) for r in rows if r[2] == s) for s in "abc"})
    got = Counter(r["doc_id"] for r in mixing.mix_stage(frame, shard=14).collect())
    assert got == Counter(r["doc_id"] for r in mixing.mix_stage(frame.repartition(3), shard=14).collect())
    words = Counter()
    for i, text, source in rows:
        words[source] += got[i] * len(text.split())
    assert max(got.values()) <= 3
    taken, targets = Counter(), {}
    for r in mixing.mix_sources(frame, shard=14).collect():
        source = "a" if r["size"] == 200 else "bc"[r["source_size"] == sizes["c"]]
        taken[source] += r["taken"]
        targets[source] = r["target"]
    assert targets == pytest.approx(brute_targets(sizes))  # b and c are full at one level
    assert abs(words["a"] - targets["a"]) <= 0.25 * targets["a"]  # quotas are whole blocks, two of 32 words a shard
    assert all(abs(words[s] - taken[s]) <= (100 if s == "a" else 10) for s in "abc")


def test_mixing_of_many_sources_and_shards(spark):
    """300 sources, one with a third of all rows and a null one, over many shards; joined by broadcast and by key."""
    made = [(i, " ".join(["w"] * (1 + i * 7 % 90)), None if i % 50 == 7 else "hot" if i % 3 == 0 else f"s{i % 299}") for i in range(12_000)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in made], "doc_id long, text string, source string, _rows int, name string").repartition(6)
    sizes = Counter()
    for _, text, source in made:
        sizes[source] += len(text.split())
    targets, source = brute_targets(sizes), {r[0]: r[2] for r in made}
    results = []
    for few in (mixing.FEW_SOURCES, 5):
        got = mixing.mix_sources(frame, shard=400, few=few).collect()
        results.append(sorted(map(tuple, got)))
        taken = Counter()
        for g in got:
            s = source[g["doc_id"]]
            assert g["source_size"] == sizes[s] and g["target"] == pytest.approx(targets[s]) and 0 <= g["taken"] <= 3 * g["size"]
            taken[s] += g["taken"]
        assert len(got) == len(made) and all(abs(taken[s] - t) <= max(32 * 15, 0.02 * t) for s, t in targets.items())
    assert results[0] == results[1] == sorted(map(tuple, mixing.mix_sources(frame.repartition(2), shard=400).collect()))


def test_apportion(spark):
    votes = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.0}
    frame = spark.createDataFrame([(1, k, v, 9) for k, v in votes.items()], "g int, k string, v double, seats long")
    got = {r["k"]: r["quota"] for r in mixing.apportion(frame, "g", "k", "v", "seats").collect()}
    quotients = sorted(((v / (2 * i + 1), k) for k, v in votes.items() if v for i in range(9)), key=lambda x: (-x[0], x[1]))[:9]
    assert got == {k: sum(q[1] == k for q in quotients) for k in votes}


def brute_apportion(votes, seats):
    """Sainte-Lague by a heap of next quotients; equal ones to the smaller key."""
    heap = [(-v, k, 0) for k, v in votes.items() if v]
    heapq.heapify(heap)
    got = Counter()
    for _ in range(seats if heap else 0):
        _, k, n = heapq.heappop(heap)
        got[k] = n + 1
        heapq.heappush(heap, (-(votes[k] / (2 * n + 3)), k, n + 1))
    return got


def test_apportion_of_many(spark):
    """20,000 rows of one group; few seats and many; equal votes; one with most of them; none."""
    r = random.Random(8)
    cases = {1: ({i: r.randint(1, 10**6) for i in range(20_000)}, 30_000), 2: ({i: 7 for i in range(500)}, 333), 3: ({0: 10**12, **{i: r.randint(0, 99) for i in range(1, 300)}}, 5000)}
    cases |= {4: ({i: 3 * i for i in range(40)}, 3), 5: ({1: 0, 2: 0}, 0), 6: ({i: 1024 * r.randint(1, 4) for i in range(3000)}, 7001), 7: ({5: 11}, 9)}
    frame = spark.createDataFrame([(g, k, v, seats) for g, (votes, seats) in cases.items() for k, v in votes.items()], "g int, k long, v long, seats long")
    got = defaultdict(dict)
    for x in mixing.apportion(frame, "g", "k", "v", "seats").collect():
        got[x["g"]][x["k"]] = x["quota"]
    for g, (votes, seats) in cases.items():
        want = brute_apportion(votes, seats)
        assert got[g] == {k: want[k] for k in votes}, g


def test_language_of_many(spark):
    """Hundreds of languages, each with letters of its own, and texts of none of them."""
    made = [(i, "".join(chr(0x4E00 + (i // 2) * 7 + j) for j in (0, 1, 2, 0, 3)) + " " + chr(0x4E00 + i), f"l{i // 2:03}") for i in range(800)]
    frame = spark.createDataFrame([*made, (900, "αβγ δ", None)], "doc_id long, text string, lang string")
    got = sorted((tuple(r) for r in language.identify_languages(frame, ranks=40).collect()), key=str)
    want = sorted(brute_languages([*made, (900, "αβγ δ", None)], 40), key=str)
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_second_scan_sends_no_text(spark, tmp_path):
    """A ledger that knows every blob leaves no text to be read; a few new ones are found without sending texts."""
    ledger = str(tmp_path / "ledger")
    frame = table(spark, SMALL, "documents")
    first = sorted(map(tuple, secrets.scan_secrets(frame, ledger).collect()), key=str)
    files = {p.name for p in Path(ledger).glob("*.parquet")}
    assert sorted(map(tuple, secrets.scan_secrets(frame, ledger).collect()), key=str) == first
    assert sum(pq.read_metadata(p).num_rows for p in Path(ledger).glob("*.parquet") if p.name not in files) == 0
    more = frame.unionByName(spark.createDataFrame([(10**6, "token=abcdefgh", "en", "s", 14), (10**6 + 1, "token=abcdefgh", "en", "s", 14)], frame.schema))
    again = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(more, ledger).collect()}
    assert again[10**6] == again[10**6 + 1] == "assign:0:14" and len(again) == len(first) + 2


def brute_grams(text):
    """The n-grams of a text: letters, and what stands beside them, any other character being a blank."""
    s = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
    out = Counter()
    for i in range(1, len(s) - 1):
        if s[i] != " ":
            out.update((s[i], s[i - 1 : i + 2]))
    out.update(s[i : i + 2] for i in range(len(s) - 1) if s[i : i + 2] != "  ")
    return out


def brute_languages(rows, ranks):
    """doc_id, held out, language and score of each row (doc_id, text, lang); ranks by count, then by code points."""
    held = {r: r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in rows}
    counts = defaultdict(Counter)
    for r in rows:
        if not held[r] and r[2] is not None and r[1] is not None:
            counts[r[2]].update(brute_grams(r[1]))
    ranked = lambda c: {g: i for i, g in enumerate(sorted(c, key=lambda g: (-c[g], g))[:ranks])}
    profiles = {k: ranked(c) for k, c in sorted(counts.items())}
    out = []
    for r in rows:
        mine = ranked(brute_grams(r[1]))
        far = [(sum(abs(p[g] - i) if g in p else ranks for g, i in mine.items()), k) for k, p in profiles.items()]
        out.append((r[0], held[r], min(far)[1], 1 - min(far)[0] / (ranks * len(mine))) if mine and far else (r[0], held[r], "und", 0.0))
    return out


def test_language_by_brute_force(spark, docs, rows):
    """Profiles, ranks, distances and ties; null, blank, repeated and very long texts; sf0.001 in full."""
    small = table(spark, SMALL, "documents").select("doc_id", "text", "lang")
    odd = [(i, t, k) for i, (t, k) in enumerate([("ab ab", "b"), ("ab ab", "a"), ("ba", "c"), ("abba", None), ("漢字 かな", "ja"), ("x" * 300_000 + " y", "x"), (None, "a"), ("12 !", "a"), ("Éa éA", "fr")] * 3)]
    made = spark.createDataFrame(odd, "doc_id long, text string, lang string")
    for frame, own, ranks in ((small, [tuple(r) for r in small.collect()], 300), (docs, [r[:3] for r in rows], 300), (made, odd, 300), (made, odd, 3)):
        got = sorted((tuple(r) for r in language.identify_languages(frame, ranks=ranks).collect()), key=str)
        want = sorted(brute_languages(own, ranks), key=str)
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_language(spark, docs, empty):
    frame = table(spark, SMALL, "documents")
    lang = {r["doc_id"]: r["lang"] for r in frame.collect()}
    got = [r for r in language.identify_languages(frame).collect() if r["held_out"] and lang[r["doc_id"]] and r["lang_pred"] != "und"]
    assert got and sum(r["lang_pred"] == lang[r["doc_id"]] for r in got) >= 0.9 * len(got)
    odd = language.identify_languages(docs).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert language.identify_languages(empty).count() == 0
    assert {r["lang_pred"] for r in language.predict_language(docs.where("text is null or trim(text) = ''"), language.language_profiles(frame)).collect()} == {"und"}
