"""Archives: round trips of every kind of session, older versions, and entries that can't be read."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from loomtext.operators import review
from loomtext.sources import archive
from loomtext.sources.io import LoadError


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def entries(spark):
    make = lambda kind, data: (kind, spark.createDataFrame(data, archive.KINDS[kind][-1].columns))
    plain = spark.createDataFrame([(1, "a", 1.5, True, date(2024, 1, 2), datetime(2024, 1, 2, 3), [1, None], {"k": 2}), (None,) * 8], "id long, t string, d double, b boolean, day date, ts timestamp, xs array<int>, m map<string, int>")
    return {
        "answers": make("annotations", [("s", 0, "x", "labeled", "n", 3), ("s", 1, None, "pending", "", None)]),
        "log": make("annotation_log", [("s", 1, "goto", 2, None, None)]),
        "parts": make("segments", [(1, 1, "é 😀\n", 1, 2, 0, 4, 0)]),
        "windows": make("windows", [(1, 1, "a b c", 1, 1, 0, 5, 0, "b", 2, 3)]),
        "found": make("extractions", [(1, 1, "rq", "sub", 0.5, "e", "why"), (None,) * 7]),
        "review": make("extraction_log", [(1, 5, "edit", 0, None, "new", None, None)]),
        "rqs": make("questions", [("RQ1", "what", ["a", "b"]), ("RQ2", "", [])]),
        "pii": make("replacements", [(1, 0, 3, "a@b", "EMAIL", 0.95, "[EMAIL_1]")]),
        "codebook": make("themes", [("t", "d", ["x"], [])]),
        "plain": ("table", plain),
        "none": ("segments", spark.createDataFrame([], archive.KINDS["segments"][-1].columns)),
    }


def test_round_trip(spark, tmp_path):
    saved = entries(spark)
    values = {"lang": "zh", "n": [1, {"k": None}], "text": "ü"}
    archive.save(saved, values, str(tmp_path / "a"))
    tables, found, warnings = archive.load(spark, str(tmp_path / "a"))
    assert found == values and not warnings and set(tables) == set(saved)
    for name, (_, df) in saved.items():
        assert tables[name].schema.simpleString() == df.schema.simpleString() and rows(tables[name]) == rows(df), name
    stats = review.annotation_stats(tables["answers"]).first()  # a session goes on from what was kept
    assert (stats["total"], stats["labeled"], stats["pending"]) == (2, 1, 1)


def test_unreadable_entries(spark, tmp_path):
    path = str(tmp_path / "a")
    archive.save(entries(spark), {}, path)
    bad = spark.sql("""SELECT 'segments' AS kind, 1 AS version, parse_json('{"doc_id": "many", "segment_id": 2}') AS value, 'parts' AS entry
        UNION ALL SELECT 'annotations', 2, parse_json('[1]'), 'answers' UNION ALL SELECT 'themes', 9, parse_json('{}'), 'codebook'""")
    bad.write.mode("append").partitionBy("entry").parquet(f"{path}/entries")
    manifest = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/manifest").collect()))
    manifest["entries"] |= {"log": {"kind": "annotation_log", "version": 7}, "rqs": {"kind": "unheard of", "version": 1}}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").write.mode("overwrite").text(f"{path}/manifest")
    tables, _, warnings = archive.load(spark, path)
    assert {n for n, t in tables.items() if t is None} == {"parts", "answers", "codebook", "log", "rqs"} and len(warnings) == 5
    assert rows(tables["found"]) == rows(entries(spark)["found"][1])


def test_older_version(spark, tmp_path):
    path = str(tmp_path / "a")
    spark.sql("""SELECT 'annotations' AS kind, 1 AS version, parse_json('{"item": 4, "label": "x", "status": "labeled", "seq": null}') AS value, 'old' AS entry""").write.partitionBy("entry").parquet(f"{path}/entries")
    manifest = {"entries": {"old": {"kind": "annotations", "version": 1}}}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").write.text(f"{path}/manifest")
    tables, values, warnings = archive.load(spark, path)
    assert tables["old"].collect() == [("", 4, "x", "labeled", "", None)] and values == {} and not warnings


def test_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        archive.save({"a": ("segments", spark.range(1))}, {}, str(tmp_path / "a"))
    with pytest.raises(ValueError):
        archive.save({}, {}, str(tmp_path / "a"))
    spark.range(1).select(F.lit("[1]").alias("value")).write.text(str(tmp_path / "b/manifest"))
    with pytest.raises(LoadError):
        archive.load(spark, str(tmp_path / "b"))
