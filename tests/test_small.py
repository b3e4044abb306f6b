"""Small operators: sessions, prompts, templates, hints, budgets of many tasks."""

import pytest
from pyspark.sql import functions as F

from loomtext.operators import advise, consensus, profile, prompting, review
from loomtext.plans import registry
from loomtext.sources import io


def test_create_session(spark):
    df = spark.createDataFrame([(3, "c", " y "), (1, None, None), (2, "b", ""), (4, "d", "x")], "k long, t string, l string")
    items, labels = review.create_session(df, "k", "t", "l")
    assert [tuple(r) for r in items.orderBy("item").collect()] == [("", 0, 1, "", None), ("", 1, 2, "b", None), ("", 2, 3, "c", "y"), ("", 3, 4, "d", "x")] and labels == ["x", "y"]
    shuffled, labels = review.create_session(df, "k", "t", labels=["q"], shuffle_seed=7)
    assert sorted(r["item"] for r in shuffled.collect()) == [0, 1, 2, 3] and labels == ["q"]
    again, _ = review.create_session(df, "k", "t", shuffle_seed=7)
    assert sorted(map(tuple, again.select("item", "id").collect())) == sorted(map(tuple, shuffled.select("item", "id").collect()))
    log = spark.createDataFrame([("", 1, "annotate", None, "x", "")], "session string, seq long, action string, target long, label string, note string")
    state = review.fold_annotations(items, log, ["x", "y"])
    assert sorted(map(tuple, review.export_for_training(items, state).collect())) == [(1, "", "x"), (3, "c", "y"), (4, "d", "x")]
    with pytest.raises(ValueError):
        review.replay(1, [("annotate", None, "z", "")], labels=["x"])
    assert review.create_session(df.limit(0), "k", "t", "l")[0].count() == 0


def test_prompts():
    text = prompting.initial_template("Sort.", {"a": "first", "b": "second"}, {"a": ["ex"]}, {"b": ["no"]})
    assert "- a: first" in text and "belongs: ex" in text and "does not belong: no" in text and "{text}" in text
    fixed, notes = prompting.repaired("Say {what}")
    assert fixed.endswith("Text: {text}") and len(notes) == 3 and prompting.repaired('a label for {text}')[1] == []
    assert prompting.parse_definitions('{"a": " x ", "z": "y"}', ["a"]) == {"a": "x"}
    assert prompting.parse_definitions("- A： first\nb: \nnothing", ["a", "b"]) == {"a": "first"}
    assert prompting.parse_examples('{"a": ["1", 2], "b": "3"}', ["a", "b"]) == {"a": ["1", "2"], "b": ["3"]}
    assert prompting.parse_examples('a: "one"\nA: two\nc: x', ["a"]) == {"a": ["one", "two"]}


def test_templates_and_hints(spark):
    assert io.template(spark, "quantitative").columns == ["id", "text", "label"] and "speaker_id" in io.template(spark, "qualitative").columns
    with pytest.raises(ValueError):
        io.template(spark, "other")
    df = spark.createDataFrame([], "id int, ` Content ` string, text string")
    assert profile.guess_column(df, profile.TEXT_HINTS) == " Content " and profile.guess_column(df, profile.LABEL_HINTS) is None


def test_budgets(spark):
    points = [("own", n, 0.1 * n**0.25 + 0.2) for n in (50, 100, 200, 400, 800)] + [("few", 10, 0.5), ("few", 20, 0.6)]
    tasks = spark.createDataFrame([("own", "topic", 5, 0.6), ("few", "sentiment", 2, 0.8), ("none", "topic", 9, 0.99)], "task string, task_type string, n_classes int, target double")
    found = {r["task"]: r for r in advise.budgets(tasks, spark.createDataFrame(points, "task string, n int, f1 double"), resamples=40).collect()}
    for task, kind, k, target in (("own", "topic", 5, 0.6), ("few", "sentiment", 2, 0.8), ("none", "topic", 9, 0.99)):
        mine = [(n, f) for t, n, f in points if t == task]
        basis = "empirical" if len(mine) >= 3 else "prior"
        used = mine if basis == "empirical" else list(advise.PRIORS[advise.prior_for(kind, k)])
        n = advise.size_for(target, *advise.fit_curve(used)) or int(1.5 * max(p[0] for p in used))
        assert (found[task]["basis"], found[task]["recommended_n"]) == (basis, n)
        assert found[task]["low"] <= found[task]["high"]
    alone = advise.budget(spark, "topic", 5, 0.6, [(n, f) for t, n, f in points if t == "own"])
    assert alone["recommended_n"] == found["own"]["recommended_n"]


def test_budgets_query(spark):
    d = "/root/testdata/sf0.01"
    langs = {r[0] for r in registry.inputs.labelled(spark, d).select("lang").distinct().collect()}
    found = registry.QUERIES["f7_budgets"](spark, d).collect()
    assert {r["task"] for r in found} == langs and {r["basis"] for r in found} == {"empirical"} and all(r["recommended_n"] > 0 for r in found)


def test_memo_of_nothing(spark):
    themes = spark.createDataFrame([(0, "a", None)], "place int, theme string, description string")
    lines = consensus.memo_lines(spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "item_id long, theme string"), themes)
    text = [r["line"] for r in lines.orderBy("part", "k").collect()]
    assert text[:4] == ["# Memo", "", "Texts: 0", "Themes: 1"] and "Frequency: 0 texts (0.0%)" in text and "Definition: " in text
    assert lines.where(F.col("line").isNull()).count() == 0
