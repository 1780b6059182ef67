"""Secret scans: an incremental ledger of content-addressed texts.

Every version of a text is a blob, named by the SHA-256 of its bytes. A ledger in the shared folder says which pairs of
blob and rule version were scanned, and what was found. A scan reads the texts of unseen pairs only, one copy of each,
appends to the ledger, and joins the findings back to every path (row) that holds the blob. All of it is DataFrame
functions.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.llm.common import join_groups, new_path, table, text_of, written

#: Rules in the order in which spans of one start are listed: kind, regular expression, least length, group measured.
#: A run of [0-9a-f] of 24 or more is a match of [0-9a-f]+ that is long enough, and likewise for access keys; assign
#: needs its shorter matches too, as they take up text, and drops them afterwards.
RULES = (
    ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1),
    ("access", r"AKIA[A-Z0-9]{16,}", 20, 0),
    ("hex", r"[0-9a-f]{24,}", 24, 0),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("code_host", r"gh[opsru]_[A-Za-z0-9]{36,}", 0, 0),
)
#: Matches of a rule whose starts are added up together; unseen blobs of a known ledger that are broadcast (10 MB).
BLOCK, FEW_BLOBS = 256, 100_000
BASE_KINDS = ("assign", "access", "hex")

SPAN = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, kind: int, regex: str, least: int, group: int) -> Column:
    """The spans of one rule: leftmost matches that don't overlap, in code points, the short ones dropped.

    ``regex`` has one capturing group at most; the text is split at the matches, and the lengths of what lies between
    them and of the matches add up to where each starts. That goes in blocks of BLOCK matches, so that what has been
    found isn't copied once a match.
    """
    whole = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(regex), F.lit(group))
    lengths = F.arrays_zip(F.transform(F.split(text, regex, -1), F.length).alias("gap"), F.transform(whole, F.length).alias("match"), F.transform(measured, F.length).alias("measured"))
    none = F.array().cast(SPAN)

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.coalesce(x["match"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        found = F.when(x["measured"] >= least, F.concat(state["found"], F.array(span))).otherwise(state["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    def of_blocks(each: Column) -> Column:
        def block(state: Column, b: Column) -> Column:
            begin = F.struct(state["at"].alias("at"), none.alias("found"))
            return F.aggregate(F.slice(each, b * BLOCK + 1, BLOCK), begin, step, lambda s: F.struct(s["at"].alias("at"), F.concat(state["found"], F.array(s["found"])).alias("found")))

        begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"))
        return F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor((F.size(each) - 1) / BLOCK).cast("int")), begin, block, lambda s: s["found"]))

    # An array of one element names ``lengths``, or each block would compute it again.
    return F.when(text.rlike(regex), F.get(F.transform(F.array(lengths), of_blocks), F.lit(0))).otherwise(none)


def secret_spans(text: Column, rules: tuple = RULES) -> Column:
    """All spans of a text, by start and then by place of the kind in ``rules``."""
    return F.array_sort(F.concat(*(_spans(text, k, regex, least, group) for k, (_, regex, least, group) in enumerate(rules))))


def _told(spans: Column, rules: tuple) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*(F.lit(r[0]) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def rule_version(rules: tuple = RULES) -> int:
    """A number made from the rules, so that what other rules found is never taken for a scan with these."""
    return zlib.crc32(repr(rules).encode()) & 0x7FFFFFFF


def scan_ledger(docs: DataFrame, ledger: str, rules: tuple = RULES) -> DataFrame:
    """doc_id, blob, spans for each row of ``docs`` (doc_id, text), after a scan of what ``ledger`` hasn't seen.

    ``ledger`` is the path of a Parquet table in a folder that all machines share: blob, version, spans; made where it
    doesn't exist. A null text is the empty blob. A blob whose findings are appended twice, as by two scans at once, is
    read once.
    """
    spark, version = docs.sparkSession, rule_version(rules)
    text = text_of("text")
    paths = written(docs.select("doc_id", F.sha2(text, 256).alias("blob")), "blob-paths")
    # Rows of a blob, and one path to read it from: the smallest, or null if it has none, and how many rows that path has.
    named = paths.groupBy("blob", "doc_id").agg(F.count("*").alias("rows"))
    blobs = named.groupBy("blob").agg(F.sum("rows").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rows")).alias("first"))
    blobs = written(blobs.select("blob", "n", F.col("first.doc_id").alias("path"), F.col("first.rows").alias("copies")), "blobs")
    exists = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if exists.getFileSystem(spark._jsc.hadoopConfiguration()).exists(exists):
        unseen = written(blobs.join(spark.read.parquet(ledger).where(F.col("version") == version).select("blob"), "blob", "left_anti"), "unseen-blobs")
        few = FEW_BLOBS
    else:
        unseen, few = blobs, 0
    texts = docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("blob"))

    def read_by(paths: DataFrame, n: int) -> DataFrame:
        paths = paths.select("blob", "path")
        paths = F.broadcast(paths) if n <= few else paths.hint("shuffle_hash")
        return texts.join(paths, (texts.blob == paths.blob) & texts.doc_id.eqNullSafe(paths.path), "left_semi")

    # A known ledger may leave few: they are found by broadcast, so that no text is sent anywhere; none, and no text is read.
    single, many = unseen.agg(F.count_if(F.col("copies") == 1), F.count_if(F.col("copies") > 1)).first()
    once = read_by(unseen.where("copies = 1"), single)
    if many:  # repeated rows: any one of them is read
        once = once.unionByName(read_by(unseen.where("copies > 1"), many).dropDuplicates(["blob"]))
    if not single + many:
        once = once.limit(0)
    once.select("blob", F.lit(version).alias("version"), secret_spans(F.col("text"), rules).alias("spans")).write.mode("append").parquet(ledger)
    found = spark.read.schema(f"blob string, version int, spans {SPAN}").parquet(ledger).where((F.col("version") == version) & (F.size("spans") > 0))
    found = found.groupBy("blob").agg(F.any_value("spans").alias("spans"))
    # Only blobs with findings are joined back to paths; how many rows each has tells the hot ones.
    found = written(found.join(blobs.select("blob", "n"), "blob"), "blob-findings")
    hit = join_groups(paths, found, "blob", "n").select("doc_id", "blob", "spans")
    clean = _without(paths, found).select("doc_id", "blob", F.array().cast(SPAN).alias("spans"))
    return hit.unionByName(clean)


def _without(paths: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``paths`` whose blob isn't in ``found``."""
    return paths.join(found.select("blob"), "blob", "left_anti")


def scan_secrets(docs: DataFrame, ledger: str, rules: tuple = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of ``docs`` (doc_id, text).

    Spans are kind:start:end in code points, end exclusive, by start and then by kind as listed in ``rules``;
    base_sha256 is over those of the three base kinds. A null or empty text has none; texts are read whole, and the
    time a text takes grows in proportion to its matches. Repeated rows are all returned, a
    null doc_id as null; an empty table gives an empty result; other columns are not looked at.
    """
    base = [k for k, r in enumerate(rules) if r[0] in BASE_KINDS]
    rows = scan_ledger(docs, ledger, rules)
    spans = F.col("spans")
    counts = [_count(spans, k).alias(f"n_{rules[k][0]}") for k in base]
    told = _told(F.filter(spans, lambda s: s["kind"].isin(base)), rules)
    return rows.select("doc_id", *counts, F.sha2(told, 256).alias("base_sha256"), _told(spans, rules).alias("spans"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets, scanned into a new ledger."""
    return scan_secrets(table(spark, sf_dir, "documents"), new_path(spark, "secret-ledger"))


def _sql() -> str:
    lists = []
    for k, (_, regex, least, group) in enumerate(RULES):
        r = regex.replace("'", "''")
        lists.append(f"""
  select doc_id, {k} as kind, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i-1], lambda x: length(x))), 0) as a, length(whole[i]) as n
  from (select doc_id, gaps, whole, measured, unnest(range(1, len(whole) + 1)) as i from (
    select doc_id, string_split_regex(t, '{r}') as gaps, regexp_extract_all(t, '{r}', 0) as whole, regexp_extract_all(t, '{r}', {group}) as measured
    from d where regexp_matches(t, '{r}'))) where length(measured[i]) >= {least}""")
    names = "[" + ", ".join(f"'{r[0]}'" for r in RULES) + "]"
    span = f"{names}[kind + 1] || ':' || a::bigint || ':' || (a + n)::bigint"
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
s as ({" union all ".join(lists)}),
g as (select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
        string_agg({span}, ',' order by a, kind) filter (kind <= 2) as base, string_agg({span}, ',' order by a, kind) as spans from s group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g on d.doc_id is not distinct from g.doc_id"""


OP6_SQL = _sql()
