"""Small files as sources, event logs, and artifacts that are written once."""

import json

import pytest
from pyspark.sql import functions as F

from veritally.shared import new_path
from veritally.sources import artifacts, readers


def test_anchors_and_venues(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,expected_min,expected_max,tests\n1,10,x,sign; dose ;\n2,,-5,\n")
    got = readers.read_anchors(spark, str(tmp_path / "a.csv")).orderBy("id").collect()
    assert [(r["expected_min"], r["expected_max"], r["tests"]) for r in got] == [(10, None, ["sign", "dose"]), (None, -5, [])]
    (tmp_path / "v.txt").write_text("# list\n\n12\nJournal of  X, A\n1234-567x\njournal of x a\n")
    assert {tuple(r) for r in readers.read_venues(spark, str(tmp_path / "v.txt")).collect()} == {("title", "journal of x a"), ("issn", "1234567X")}


def test_vocabulary(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"version": 3, "forms": [{"id": "a", "m": 1}, {"id": "b", "m": None}]}))
    assert {tuple(r) for r in readers.read_vocabulary(spark, str(tmp_path / "v.json"), "forms").collect()} == {("3", "a", 1), ("3", "b", None)}


def test_events(spark, tmp_path):
    lines = ['{"seq":1,"kind":"call","call_id":"x","text":"q"}', "{broken", '{"seq":2,"kind":"result","call_id":"x","text":"first"}', "", '{"seq":3,"kind":"result","call_id":"x","text":"last"}', '{"seq":4,"kind":"call","call_id":"y","text":"r"}']
    (tmp_path / "e.jsonl").write_text("\n".join(lines))
    events, told = readers.read_events(spark, str(tmp_path / "e.jsonl"), "seq int, kind string, call_id string, text string")
    assert tuple(told.first()) == (1, 5)
    got = {r["call_id"]: (r["result"], r["n_results"]) for r in readers.paired_calls(events).collect()}
    assert got == {"x": ("last", 2), "y": (None, 0)}


def test_artifacts_are_written_once(spark):
    rows, path = spark.range(5).withColumn("v", F.lit("x")), new_path(spark, "artifact")
    assert artifacts.write_once(rows, path) and not artifacts.write_once(rows.repartition(3), path)
    for other in (rows.limit(4), rows.union(rows.limit(1)), rows.withColumn("v", F.lit("y"))):
        with pytest.raises(ValueError):
            artifacts.write_once(other, path)
    assert spark.read.parquet(path).count() == 5
