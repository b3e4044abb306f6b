"""Languages by trigrams, held against plain Python; held-out accuracy over the given documents."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from loomtext.operators import language, profile
from loomtext.plans import registry

TEXTS = [
    (1, "The cat sat on the mat; the dog ran.", "en"), (2, "Le chat est sur le tapis, l'été!", "fr"), (2, "THE HAT 42 the", "en"), (3, "", "en"),
    (None, "la maison", "fr"), (4, None, "fr"), (5, "über die Straße", None), (6, "...123", ""), (7, "x", "en"), (8, "le le le the", " "),
]


def prepared(text):
    return f" {re.sub(r'[^a-zà-ÿß]+', ' ', (text or '').lower()).strip()} "


def grams(text):
    s = prepared(text)
    return [s[k : k + 3] for k in range(len(s) - 2)]


def slow(rows, kept):
    n = Counter((lang, g) for _, t, lang in rows if (lang or "").strip() for g in grams(t))
    totals = Counter()
    for (lang, _), k in n.items():
        totals[lang] += k
    kinds = len({g for _, g in n})
    known = {g for lang in totals for g in sorted((g for x, g in n if x == lang), key=lambda g: (-n[lang, g], g))[:kept]}
    out = []
    for i, text, _ in rows:
        sums = {lang: sum(math.floor(1000 * math.log((n[lang, g] + 1) / (totals[lang] + kinds))) for g in grams(text) if g in known) for lang in totals}
        order = sorted(sums, key=lambda lang: (-sums[lang], lang))
        out.append((i, order[0], sums[order[0]] - sums[order[1]]) if prepared(text).strip() else (i, None, None))
    return out


@pytest.mark.parametrize("kept", [2000, 4])
def test_brute_force(spark, kept, monkeypatch):
    monkeypatch.setattr(language, "MOST_HELD", 5)
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string")
    found = language.identify(df, language.fit(df, kept=kept)).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, slow(TEXTS, kept)))


def test_without_languages(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    model = language.fit(df)
    assert model.languages == [] and language.identify(df, model).collect() == [(1, None, None)]
    assert language.main_language(df, model).collect() == [("en", None, False)]
    assert language.identify(df.limit(0), model).collect() == []


def test_long_text():
    model = language.Model(["a", "b"], np.sort(language.trigrams(" abc ")), np.array([[1, 0], [2, 0], [3, 0]]))
    assert model.best(" " + "abc " * 500_000)[0] == "a" and model.best("  ") == (None, None)


def test_heldout_accuracy(spark):
    rows = registry.QUERIES["e6_heldout"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) > 1 and sum(r["found"] for r in rows) >= 0.95 * sum(r["n"] for r in rows)


def test_uses(spark):
    df = spark.createDataFrame(TEXTS, "id long, text string, label string")
    model = language.fit(df, lang_col="label")
    french = df.where("label = 'fr'")
    issues = {r["check"]: r["value"] for r in profile.validate(french, languages=model).collect()}
    assert issues["not_english"] == 1.0 and "not_english" not in {r["check"] for r in profile.validate(df.where("label = 'en'"), languages=model).collect()}
    row = profile.features(french, "text", "label", languages=model, stated={"task_type": "stance", "budget_level": "?", "n_classes": 5}).first()
    assert (row["language"], row["multilingual"], row["task_type"], row["budget_level"], row["n_classes"]) == ("fr", False, "stance", "medium", 1)
    report = {(r["section"], r["name"]): r["value"] for r in profile.diagnostics_report(df, "text", "label", model).collect()}
    assert report["table", "rows"] == 10 and report["language", "fr"] + report["language", "en"] == 7
