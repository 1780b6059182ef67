"""URL filters: host and path rules, then a block list held in a cascade of Bloom filters.

The keys of a url are its host and every parent domain of it. Level 0 of the cascade encodes the listed keys; level 1
the keys of the corpus that level 0 lets through by mistake; level 2 the listed keys that level 1 lets through by
mistake; and so on, until few are left, which the last level holds as they are. As the levels are built against every
key of the corpus, membership is exact for it, and looking a url up needs no join.

Keys are dealt to shards by hash, each with a cascade of its own that one task builds. Cascades that together take
more than HELD bytes aren't broadcast: each shard's keys are brought to its cascade instead.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.llm.common import join_groups, table, written

#: (host, path, verdict); a rule fits its host and all subdomains where the url's path starts with its path.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Sites that the production query blocks: each name, alone and with the numbers 1 to 99, under each top domain.
NAMES, NUMBERS, TOPS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"), 99, ("com", "net", "org")
LISTED = tuple(f"{name}{i or ''}.example.{top}" for name in NAMES for i in range(NUMBERS + 1) for top in TOPS)
#: Keys of a shard as a mean; most bytes of all cascades together that are broadcast; keys that a last level holds.
SHARD, HELD, LAST = 500_000, 32 << 20, 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """What stands between the first :// and the next / ? # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def host_keys(host: Column, most: int) -> Column:
    """The host and its parent domains with up to ``most`` labels, as an array; empty for an empty host."""
    labels = F.reverse(F.slice(F.reverse(F.split(host, r"\.", -1)), 1, most))
    keys = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


def longest_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as ``host + path``) and its verdict; both null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        rule = F.when(fits, rule_host + rule_path).otherwise(rule)
        verdict = F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _probes(depth: int, size: int, hashes: int, h1: np.ndarray, h2: np.ndarray) -> Iterator[np.ndarray]:
    """The bits of each key, one array a probe; other bits on each level, or two keys could collide on all of them."""
    h = (h1 ^ (h2 * np.uint64(2 * depth + 1))) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    for k in range(hashes):
        yield (h + np.uint64(k) * h2) % np.uint64(size)


class Level:
    """One Bloom filter of the cascade: ``size`` bits, held as 64-bit words, and ``hashes`` probes a key."""

    def __init__(self, depth: int, rate: float, h1: np.ndarray, h2: np.ndarray) -> None:
        self.depth, self.size = depth, max(64, ceil(len(h1) * -log(rate) / log(2) ** 2))
        self.hashes = max(1, round(-log(rate) / log(2)))
        self.words = np.zeros((self.size + 63) // 64, np.uint64)
        for at in _probes(depth, self.size, self.hashes, h1, h2):
            np.bitwise_or.at(self.words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.ones(len(h1), bool)
        for at in _probes(self.depth, self.size, self.hashes, h1, h2):
            found &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def _as_pairs(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    pairs = np.empty(len(h1), [("h1", "<u8"), ("h2", "<u8")])
    pairs["h1"], pairs["h2"] = h1, h2
    return pairs


class Last:
    """The level that closes a cascade: the few keys that are left, so it makes no mistake."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray) -> None:
        self.pairs = _as_pairs(h1, h2)

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        return np.isin(_as_pairs(h1, h2), self.pairs)


def cascade(listed: tuple[np.ndarray, np.ndarray], corpus: tuple[np.ndarray, np.ndarray], last: int = LAST) -> list:
    """The levels that tell the ``listed`` keys from all others of ``corpus``, both as hash pairs.

    Level 0 is made of the list alone; what it lets through of the corpus and isn't listed is the first set of false
    positives.
    """
    mine, levels = listed, []
    rate = min(0.5, max(len(listed[0]) / (len(corpus[0]) or 1) / 2, 1e-6))
    if not len(mine[0]):
        return [Last(*mine)]
    levels.append(Level(0, rate, *mine))
    through = levels[0].has(*corpus)
    other = tuple(h[through] for h in corpus)
    wrong = ~np.isin(_as_pairs(*other), _as_pairs(*listed))
    other = tuple(h[wrong] for h in other)
    while len(other[0]):  # what the level before lets through by mistake
        mine, other = other, mine
        if len(mine[0]) <= last:
            levels.append(Last(*mine))
            break
        levels.append(Level(len(levels), 0.5, *mine))
        through = levels[-1].has(*other)
        other = tuple(h[through] for h in other)
    return levels


def in_cascade(levels: list, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Membership of each key: that of level 0, unless a later level takes it back."""
    listed, alive = np.zeros(len(h1), bool), np.arange(len(h1))
    for depth, level in enumerate(levels):
        through = level.has(h1[alive], h2[alive])
        if depth % 2:
            listed[alive[~through]] = True  # not among the false positives of the level before
        alive = alive[through]
    if len(levels) % 2:
        listed[alive] = True
    return listed


def _hashed(key: Column) -> list[Column]:
    """Two 64-bit hashes of a key, the second odd."""
    return [F.xxhash64(key), F.xxhash64(F.lit("#"), key).bitwiseOR(F.lit(1))]


def _unsigned(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64).view(np.uint64)


def _shard(h1: np.ndarray, shards: int) -> np.ndarray:
    return ((h1 >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)


def _shard_of(h1: Column, shards: int) -> Column:
    """The same number as :func:`_shard`."""
    return F.pmod(F.shiftrightunsigned(h1, 20), F.lit(shards))


def build_cascades(keys: DataFrame, listed: DataFrame, shard: int = SHARD, last: int = LAST) -> tuple[DataFrame, int]:
    """shard, levels (pickled) for each shard of the ``listed`` keys, written; and how many shards there are.

    Both frames have distinct hash pairs (h1, h2), by which keys are told: two keys of one pair, chance n * n / 2**128,
    are one. A shard has ``shard`` keys as a mean, so it is a task's at any size of list and corpus.
    """
    rows = written(keys.withColumn("listed", F.lit(False)).unionByName(listed.withColumn("listed", F.lit(True))), "keys")
    shards = max(1, -(-rows.count() // shard))

    def built(group: pa.Table) -> pa.Table:
        mine = group.column("listed").to_numpy()
        h1, h2 = _unsigned(group.column("h1")), _unsigned(group.column("h2"))
        levels = cascade((h1[mine], h2[mine]), (h1[~mine], h2[~mine]), last)
        return pa.table({"shard": group.column("shard")[:1].cast(pa.int64()), "levels": pa.array([pickle.dumps(levels)], pa.binary())})

    dealt = rows.withColumn("shard", _shard_of(F.col("h1"), shards))
    return written(dealt.groupBy("shard").applyInArrow(built, "shard long, levels binary"), "cascades"), shards


def listed_hosts(pages: DataFrame, host: str, listed: DataFrame, shard: int = SHARD, held: int = HELD, last: int = LAST) -> DataFrame:
    """``pages`` with a boolean column ``listed``: the host (never null) or a parent domain is a key of ``listed``."""
    spark = pages.sparkSession
    h1, h2 = _hashed(F.col("key"))
    hashed = [h1.alias("h1"), h2.alias("h2")]
    # A parent with more labels than any listed key isn't listed, so a host of any length has few keys.
    deepest = listed.agg(F.max(F.size(F.split("key", r"\.", -1))).alias("n")).first()["n"] or 1
    keys = pages.select(F.explode(host_keys(F.col(host), deepest)).alias("key")).select(*hashed).distinct()
    cascades, shards = build_cascades(keys, listed.where("key is not null").select(*hashed).distinct(), shard, last)
    size = cascades.agg(F.coalesce(F.sum(F.length("levels")), F.lit(0)).alias("n")).first()["n"]
    if size > held:
        return _by_shard(pages, host, deepest, cascades, shards)
    by_shard = spark.sparkContext.broadcast({r["shard"]: r["levels"] for r in cascades.collect()})
    opened: dict[int, list] = {}

    @F.pandas_udf("boolean")
    def member(h1: pd.Series, h2: pd.Series) -> pd.Series:
        if not opened:
            opened.update((s, pickle.loads(x)) for s, x in by_shard.value.items())
        n = h1.map(len).to_numpy(np.int64)
        if not n.sum():
            return pd.Series(np.zeros(len(n), bool))
        a, b = (np.concatenate([np.asarray(x, np.int64) for x in h]).view(np.uint64) for h in (h1, h2))
        found, of = np.zeros(len(a), bool), _shard(a, shards)
        for s in np.unique(of).tolist():
            mine = of == s
            found[mine] = in_cascade(opened[s], a[mine], b[mine])
        total = np.concatenate([[0], np.cumsum(found)])
        ends = np.cumsum(n)
        return pd.Series(total[ends] > total[ends - n])

    own = host_keys(F.col(host), deepest)
    return pages.withColumn("listed", member(F.transform(own, lambda k: _hashed(k)[0]), F.transform(own, lambda k: _hashed(k)[1])))


def _by_shard(pages: DataFrame, host: str, deepest: int, cascades: DataFrame, shards: int) -> DataFrame:
    """The same with the keys of the distinct hosts brought to their shards' cascades."""

    def looked_up(keys: pa.Table, filters: pa.Table) -> pa.Table:
        if not keys.num_rows:
            return pa.table({"host": pa.array([], pa.string()), "hit": pa.array([], pa.bool_())})
        levels = pickle.loads(filters.column("levels")[0].as_py())
        return pa.table({"host": keys.column("host"), "hit": in_cascade(levels, _unsigned(keys.column("h1")), _unsigned(keys.column("h2")))})

    hosts = written(pages.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n")), "hosts")
    keys = hosts.select("host", F.explode(host_keys(F.col("host"), deepest)).alias("key"))
    keys = keys.select("host", *(h.alias(f"h{i}") for i, h in enumerate(_hashed(F.col("key")), 1))).withColumn("shard", _shard_of(F.col("h1"), shards))
    found = keys.groupBy("shard").cogroup(cascades.groupBy("shard")).applyInArrow(looked_up, "host string, hit boolean")
    bad = found.groupBy("host").agg(F.max("hit").alias("listed"))
    groups = written(hosts.join(bad, "host", "left").select(F.col("host").alias(host), F.col("n").alias("_rows"), F.coalesce("listed", F.lit(False)).alias("listed")), "listed-hosts")
    return join_groups(pages, groups, host, "_rows").drop("_rows")


def url_verdicts(pages: DataFrame, listed: DataFrame, rules: tuple = RULES, shard: int = SHARD, held: int = HELD, last: int = LAST) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for each row of ``pages`` (page_id, url).

    The longest fitting rule decides; without one, a url is blocked when its host or a parent domain is in ``listed``
    (column key; nulls and repeated ones are as good as absent). A null url, or one without ://, has an empty host and
    path, and is allowed; urls are read whole, however long. Repeated rows are all returned, a null page_id as null; an empty table gives an empty result; other columns are not looked at.
    """
    rows = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = listed_hosts(rows, "host", listed, shard, held, last)
    own = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "listed")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    listed = spark.createDataFrame([(x,) for x in LISTED], "key string")
    return url_verdicts(table(spark, sf_dir, "pages"), listed)


def _sql() -> str:
    fits = [(h + p, v, f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')") for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))]
    rule = reduce(lambda s, r: f"{s} when {r[2]} then '{r[0]}'", fits, "case") + " end"
    verdict = reduce(lambda s, r: f"{s} when {r[2]} then '{r[1]}'", fits, "case") + " when listed then 'block' else 'allow' end"
    names, tops = ("[" + ", ".join(f"'{x}'" for x in xs) + "]" for xs in (NAMES, TOPS))
    return f"""
with parts as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') as host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) as path from pages),
names as (select unnest({names}) as name), numbers as (select case when i = 0 then '' else i::varchar end as number from range({NUMBERS + 1}) t(i)), tops as (select unnest({tops}) as top),
bad as (select name || number || '.example.' || top as key from names, numbers, tops),
hosts as (select distinct host from parts),
hit as (select distinct host from hosts join bad on host = key or ends_with(host, '.' || key)),
judged as (select p.*, h.host is not null as listed from parts p left join hit h on p.host = h.host)
select page_id, host, path, {rule} as rule, {verdict} as verdict, listed from judged"""


OP2_SQL = _sql()
