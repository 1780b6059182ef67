"""Prefix trie of conversations, by the depth from which each conversation owns its path.

Each distinct sequence of first turns is a node, told by a digest of the prefix; the smallest conversation with that
prefix owns it. What a conversation owns of its path is an unbroken run of depths down to its end, as fewer share a
longer prefix: its first owned depth is found by binary search, in rounds of joins against the smallest conversation of
each digest. The runs are chains, each hung on one node of another chain; sums over subtrees go up from chain to chain,
twice as far each round, and then along each chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.llm.common import HOT_SHARE, drop_written, join_groups, running, table, written

#: A conversation takes turns from the one whose id is the next multiple of EVERY towards 0; how many is crc32 % TAKEN.
EVERY, TAKEN = 5, 9
_NONE = hashlib.sha256(b"").hexdigest()
_WORD = 0xFFFFFFFF


def rebuilt_turns(conversations: DataFrame, every: int = EVERY, most: int = TAKEN) -> tuple[DataFrame, DataFrame]:
    """The turns of the rebuilt conversations (conv_id, depth, t0, t1, bytes), and conv_id, n of all of these.

    t0 and t1 are 64 bits each of role and text; no text is sent anywhere.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), *(F.xxhash64(F.lit(i), role, text).alias(f"t{i}") for i in (0, 1)), F.octet_length(text).cast("long").alias("bytes"))
    own = written(running(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("t0"), F.col("t1")], {"i": F.lit(1).cast("long")}).drop("turn", "role"), "turns")
    convs = own.groupBy("conv_id").agg(F.count("*").alias("own"))
    base = F.col("conv_id") - F.col("conv_id") % every
    is_base = F.col("conv_id") % every == 0
    skip = F.when(is_base, F.lit(0).cast("long")).otherwise(F.crc32(F.col("conv_id").cast("string")) % most)
    bases = convs.where(is_base).select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = convs.withColumns({"base": base, "skip": skip}).join(bases, "base", "left")
    taken = F.least("skip", F.coalesce("base_own", F.lit(0)))
    convs = written(convs.select("conv_id", "own", "base", "skip", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("skip"), F.lit(0))).alias("n")), "conversations")
    heads = own.where(is_base & (F.col("i") < most)).withColumnRenamed("conv_id", "base")
    borrowed = convs.where("taken > 0").join(heads, "base").where("i <= taken").select("conv_id", F.col("i").alias("depth"), "t0", "t1", "bytes")
    kept = join_groups(own, convs.select("conv_id", "own", "skip", "taken"), "conv_id", "own").where("i > skip")
    kept = kept.select("conv_id", (F.col("i") - F.col("skip") + F.col("taken")).alias("depth"), "t0", "t1", "bytes")
    return kept.unionByName(borrowed), convs.select("conv_id", "n")


def prefix_digests(turns: DataFrame) -> DataFrame:
    """conv_id, depth, node, bytes: node is depth and 128 bits that tell the sequence of the first turns.

    The bits are four sums, modulo 2^32, of hashes of a turn and its depth: sums can be taken in parts.
    """
    x = [F.xxhash64("depth", t) for t in ("t0", "t1")]
    words = {f"w{i}": (F.shiftrightunsigned(x[i // 2], 32) if i % 2 else x[i // 2]).bitwiseAND(F.lit(_WORD).cast("long")) for i in range(4)}
    summed = running(turns, "conv_id", [F.col("depth")], words)
    half = lambda low, high: F.shiftleft(high, 32).bitwiseOR(F.col(low).bitwiseAND(F.lit(_WORD).cast("long")))
    return written(summed.select("conv_id", "depth", F.struct("depth", half("w0", "w1").alias("a"), half("w2", "w3").alias("b")).alias("node"), "bytes"), "prefixes")


def first_owned(convs: DataFrame, prefixes: DataFrame, minima: DataFrame, root: int | None) -> DataFrame:
    """conv_id, n, first, up, at of each of ``convs``: the first depth that it owns, n + 1 if none, and what holds it.

    (up, at) is the node at depth first - 1, by its owner ``up``; that of the root's owner is null. ``minima`` has node,
    owner, n_convs. Each round asks for the middle depth of every conversation that isn't settled; nodes with more than
    a thousandth of all prefixes, fewer than a thousand, are joined by broadcast, so no node is a hot key.
    """
    total = minima.agg(F.coalesce(F.sum("n_convs"), F.lit(0))).first()[0]
    often = F.col("n_convs") > max(total / HOT_SHARE, 100)
    hot = written(minima.where(often).select("node", "owner").limit(HOT_SHARE), "hot-nodes")
    rest = minima.where(~often).select("node", "owner")

    def owners(asked: DataFrame) -> DataFrame:
        """``asked`` (with conv_id and depth) and the owner of that prefix."""
        nodes = asked.join(prefixes.select("conv_id", "depth", "node"), ["conv_id", "depth"])
        some = nodes.join(F.broadcast(hot), "node")
        return some.unionByName(nodes.join(F.broadcast(hot.select("node")), "node", "left_anti").join(rest, "node")).drop("node")

    least, most = F.col("least"), F.col("most")
    others = convs.where(~F.col("conv_id").eqNullSafe(F.lit(root))).select("conv_id", "n", F.lit(1).cast("long").alias("least"), (F.col("n") + 1).alias("most"))
    settled, asking = [others.where("n = 0")], written(others.where("n > 0"), "asking")
    while not asking.isEmpty():
        found = owners(asking.withColumn("depth", F.floor((least + most) / 2)))
        owned = F.col("owner") == F.col("conv_id")
        found = found.select("conv_id", "n", F.when(owned, least).otherwise(F.col("depth") + 1).alias("least"), F.when(owned, F.col("depth")).otherwise(most).alias("most"))
        now = written(found, "asking")
        settled.append(now.where(least == most))
        asking = now.where(least < most)
    done = settled[0]
    for part in settled[1:]:
        done = done.unionByName(part)
    done = written(done.select("conv_id", "n", F.col("least").alias("first"), (least - 1).alias("depth")), "settled")
    hung = owners(done.where("depth > 0")).unionByName(done.where("depth = 0").withColumn("owner", F.lit(root).cast("long")))
    hung = hung.select("conv_id", "n", "first", F.col("owner").alias("up"), F.col("depth").alias("at"))
    nothing = F.lit(None).cast("long")
    return written(convs.where(F.col("conv_id") == F.lit(root)).select("conv_id", "n", F.lit(0).cast("long").alias("first"), nothing.alias("up"), nothing.alias("at")).unionByName(hung), "chains")


def subtree_sums(tree: DataFrame, sums: list[str]) -> DataFrame:
    """``tree`` (conv_id, up, and ``sums``, longs) with each of ``sums`` taken over the whole subtree of a row.

    Each round adds to a row what those hold whose pointer leads to it, and makes pointers twice as long: as many rounds
    as the binary logarithm of the height. A row that many point to is joined by broadcast (see join_groups).
    """
    state = written(tree.select("conv_id", "up", *sums), "subtrees")
    while True:
        pointing = state.where("up is not null")
        got = written(pointing.groupBy("up").agg(F.count("*").alias("k"), *(F.sum(c).alias(f"_{c}") for c in sums)), "pushed")
        if got.isEmpty():
            return state.drop("up")
        longer = got.select("up", "k").join(state.select(F.col("conv_id").alias("up"), F.col("up").alias("next")), "up")
        moved = join_groups(pointing, written(longer, "pointers"), "up", "k").select("conv_id", F.col("next").alias("up"), *sums)
        moved = moved.unionByName(state.where("up is null"))
        more = moved.join(got.drop("k").withColumnRenamed("up", "conv_id"), "conv_id", "left")
        before, state = state, written(more.select("conv_id", "up", *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums)), "subtrees")
        drop_written(before, got)


def ends_digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 over ``ends`` (conv_id, depth, member): of the members in order, comma-joined.

    Members are sorted over ranges and joined in pieces of one batch; the pieces of a node then pass through its hash
    one after the other, so that nothing holds a node's list.
    """
    key = ["conv_id", "depth"]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, depth, member = (batch.column(c).to_numpy() for c in (*key, "member"))
            starts = np.flatnonzero(np.r_[True, (np.diff(conv) != 0) | (np.diff(depth) != 0)][: len(conv)])
            names = list(map(str, member.tolist()))
            ids = [",".join(names[a:b]) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(names)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(conv[starts]), pa.array(depth[starts]), pa.array(member[starts]), pa.array(ids, pa.string())], [*key, "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, hashlib.sha256()
        for batch in batches:
            out = []
            for *at, ids in zip(*(batch.column(c).to_pylist() for c in (*key, "ids")), strict=True):
                if at == node:
                    digest.update(b"," + ids.encode())
                    continue
                if node:
                    out.append((*node, digest.hexdigest()))
                node, digest = at, hashlib.sha256(ids.encode())
            yield told(out)
        if node:
            yield told([(*node, digest.hexdigest())])

    def told(rows: list[tuple]) -> pa.RecordBatch:
        columns = [[r[i] for r in rows] for i in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], [*key, "ends_sha256"])

    pieces = ends.repartitionByRange(*key, "member").sortWithinPartitions(*key, "member").mapInArrow(joined, "conv_id long, depth long, first long, ids string")
    return pieces.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(hashed, "conv_id long, depth long, ends_sha256 string")


def conversation_trie(conversations: DataFrame, every: int = EVERY, most: int = TAKEN) -> DataFrame:
    """The nodes of the trie of the rebuilt conversations of ``conversations`` (conv_id, turn, role, text).

    Conversation c begins with the first crc32(c) % ``most`` turns of c - c % ``every`` (all if fewer, none if absent)
    and goes on with its own beyond as many. One row a node, all longs but the last: conv_id (the smallest with that
    prefix), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens (over the subtree,
    (n_convs - 1) * bytes of the last text), ends_sha256 (of the ids that end there).

    Turns stand in order of turn, null first, then role, then a hash of the text; repeated rows are turns of their own.
    A null role or text counts as empty; rows without a conv_id are no conversation's; a conversation left without turns
    ends at the root. An empty table has no node; other columns are not looked at.
    """
    turns, convs = rebuilt_turns(conversations, every, most)
    prefixes = prefix_digests(turns)
    minima = written(prefixes.groupBy("node").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes")), "minima")
    root, whole = convs.agg(F.min("conv_id"), F.count("*")).first()
    held = first_owned(convs, prefixes, minima, root)
    chains = held.where("first <= n")

    saved = (F.col("n_convs") - 1) * F.col("bytes")
    nodes = minima.select(F.col("owner").alias("conv_id"), F.col("node.depth").alias("depth"), "n_convs", saved.alias("saved"))
    top = convs.where(F.col("conv_id") == F.lit(root)).select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(whole).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("saved"))
    nodes = nodes.unionByName(top)
    kids = chains.where("up is not null").select("conv_id", "up", "at")
    hung_on = kids.groupBy(F.col("up").alias("conv_id"), F.col("at").alias("n")).agg(F.count("*").alias("kids"))
    tree = chains.join(hung_on, ["conv_id", "n"], "left").join(nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved")), "conv_id")
    totals = subtree_sums(tree.select("conv_id", "up", F.when(F.col("kids").isNull(), 1).otherwise(0).cast("long").alias("leaves"), "saved"), ["leaves", "saved"])

    below = kids.join(totals, "conv_id").groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth"))
    below = below.agg(F.count("*").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved_below"))
    rows = nodes.join(below, ["conv_id", "depth"], "left").fillna(0, ["kids", "leaves", "saved_below"])
    spans = chains.select("conv_id", "n", "first", "up", (F.col("n") - F.col("first") + 1).alias("nodes"))
    rows = join_groups(written(rows, "nodes"), spans, "conv_id", "nodes").drop("nodes")
    last = F.col("depth") == F.col("n")
    rows = running(rows, "conv_id", [F.col("depth").desc()], {"n_leaves": F.col("leaves") + F.when(last & (F.col("kids") == 0), 1).otherwise(0), "saved_tokens": F.col("saved") + F.col("saved_below")})
    ends = held.select(F.when(F.col("first") <= F.col("n"), F.col("conv_id")).otherwise(F.col("up")).alias("conv_id"), F.col("n").alias("depth"), F.col("conv_id").alias("member"))
    rows = rows.join(ends_digests(ends), ["conv_id", "depth"], "left")
    return rows.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") == F.col("first"), F.col("up")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        (F.col("kids") + F.when(last, 0).otherwise(1)).cast("long").alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"),
    )


#: crc32 by its definition, bit by bit; prefixes are told by the sha256 of their turns.
OP13_SQL = """
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i
  from conversations where conv_id is not null),
c as (
  select conv_id, count(*) as own, conv_id - conv_id % 5 as base,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda ch: ascii(ch)::bigint)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)), 4294967295::bigint) % 9 as h
  from t group by conv_id),
s as (select c.conv_id, c.base, c.h, least(c.h, coalesce(b.own, 0)) as taken from c left join c b on b.conv_id = c.base),
r as (
  select s.conv_id, t.i as depth, t.role, t.text from s join t on t.conv_id = s.base where t.i <= s.h
  union all select s.conv_id, t.i - s.h + s.taken, t.role, t.text from s join t using (conv_id) where t.i > s.h),
p as (
  select conv_id, depth, text, sha256(string_agg(sha256(role) || sha256(text), '' order by depth) over (partition by conv_id order by depth)) as node from r
  union all select conv_id, 0, '', 'root' from c),
n as (select depth, node, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * max(strlen(text)) as saved from p group by depth, node),
mine as (select p.conv_id as member, p.depth, n.conv_id from p join n using (depth, node)),
ends as (select m.conv_id, m.depth, m.member from mine m join (select member, max(depth) as depth from mine group by member) l using (member, depth)),
up as (select n.conv_id, n.depth, m.conv_id as parent_conv_id from n left join mine m on m.member = n.conv_id and m.depth = n.depth - 1),
kids as (select parent_conv_id as conv_id, depth - 1 as depth, count(*) as n_children from up where depth > 0 group by all),
one as (select n.conv_id, n.depth, n.n_convs, n.saved, u.parent_conv_id, coalesce(k.n_children, 0) as n_children from n join up u using (conv_id, depth) left join kids k using (conv_id, depth)),
below as (
  select m.conv_id, m.depth, sum(case when o.n_children = 0 then 1 else 0 end) as n_leaves, sum(o.saved) as saved_tokens
  from one o join mine m on m.member = o.conv_id and m.depth <= o.depth group by all),
done as (select conv_id, depth, sha256(string_agg(member::varchar, ',' order by member)) as ends_sha256 from ends group by all)
select o.conv_id, o.depth::bigint as depth, o.parent_conv_id, o.n_convs, o.n_children, b.n_leaves::bigint as n_leaves, b.saved_tokens::bigint as saved_tokens, coalesce(d.ends_sha256, sha256('')) as ends_sha256
from one o join below b using (conv_id, depth) left join done d using (conv_id, depth)
"""


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return conversation_trie(table(spark, sf_dir, "conversations"))
