"""Readers of the small files that a run starts from, and of event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.functions.identity import key_text
from veritally.functions.texts import label_key


def read_anchors(spark: SparkSession, path: str) -> DataFrame:
    """Anchors of a CSV file with a header: ranges as integers or null, tests as an array of what ; parts."""
    rows = spark.read.option("header", True).csv(path)
    tests = F.filter(F.transform(F.split(F.coalesce("tests", F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.withColumns({"expected_min": F.col("expected_min").try_cast("int"), "expected_max": F.col("expected_max").try_cast("int"), "tests": tests})


def read_vocabulary(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The entries of a JSON document that holds them as an array under ``name``, each with the document's version."""
    rows = spark.read.option("multiLine", True).json(path)
    version = F.col("version").cast("string") if "version" in rows.columns else F.lit(None).cast("string")
    return rows.select(version.alias("version"), F.explode(name).alias("entry")).select("version", "entry.*")


def venue_name(line: Column) -> Column:
    """struct(kind, name) of a line of a venue list: an ISSN or a title, as keys; null for comments and bare numbers."""
    text = F.trim(line)
    skipped = (text == "") | text.startswith("#") | text.rlike(r"^\d+(\.\d+)?$")
    issn = F.replace(text, F.lit(" "), F.lit("")).rlike(r"^\d{4}-?\d{3}[\dXx]$")
    name = F.when(issn, F.upper(F.regexp_replace(text, "[^0-9Xx]", ""))).otherwise(label_key(text))
    return F.when(~skipped, F.struct(F.when(issn, "issn").otherwise("title").alias("kind"), name.alias("name")))


def read_venues(spark: SparkSession, path: str) -> DataFrame:
    """kind, name: the distinct entries of a text file of venues."""
    return spark.read.text(path).select(venue_name(F.col("value")).alias("v")).where("v is not null").select("v.kind", "v.name").distinct()


def read_events(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The events of a JSON-lines file, and one row with how many lines were malformed; those are never fatal."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.select(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("e"))
    bad = F.col("e").isNull() | F.col("e._bad").isNotNull()
    return parsed.where(~bad).select("e.*").drop("_bad"), parsed.agg(F.count_if(bad).alias("malformed"), F.count("*").alias("lines"))


def paired_calls(events: DataFrame, seq: str = "seq", call: str = "call_id") -> DataFrame:
    """Each call with the last result that names it; a call without one has a null result.

    ``events`` has kind (call, result), ``call``, ``seq`` and text.
    """
    calls = events.where("kind = 'call'").select(call, F.col(seq).alias("call_seq"), F.col("text").alias("request"))
    results = events.where("kind = 'result'").groupBy(call).agg(F.max_by("text", seq).alias("result"), F.count("*").alias("n_results"))
    return calls.join(results, call, "left").withColumn("n_results", F.coalesce("n_results", F.lit(0)))


def call_key(parts: list[Column]) -> Column:
    """What names a call: SHA-256 of its parts, a zero byte between them; null is an empty part."""
    return F.sha2(F.concat_ws("\0", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def search_phrase(name: Column) -> Column:
    """A vocabulary id as words: vitamin_d becomes vitamin d."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[_\s]+", " "))


def search_terms(labels: Column, most: int = 8) -> Column:
    """Up to ``most`` distinct phrases longer than two letters, in order."""
    return F.slice(F.array_distinct(F.filter(F.transform(labels, search_phrase), lambda x: F.length(x) > 2)), 1, most)


def title_key(title: Column) -> Column:
    """A journal's title as a key: lower case, punctuation as blanks."""
    return label_key(title)


def author_key(name: Column) -> Column:
    """A surname as a key, accents folded."""
    return key_text(F.regexp_extract(F.coalesce(name, F.lit("")), r"^\s*([^\s,]+)", 1))
