"""The decoder against an enumeration of all tags, the detector against decoding whole texts, and its query."""

import itertools
import pickle
import random
import re

import pytest
from pyspark.sql import functions as F

from loomtext.operators import entities, pii
from loomtext.plans import registry

GAZETTEER = {"Springfield": "LOCATION", "New York": "LOCATION", "Acme": "ORG", "york": "ORG", "北京": "LOCATION", "Zoe": "PERSON"}


def best_of_all(scores):
    def total(tags):
        s = sum(row[t] for row, t in zip(scores, tags))
        s += 0 if entities.TAGS[tags[0]][0] != "I" else entities.NEVER - scores[0][tags[0]]
        return s + sum(entities.transition(a, b) for a, b in itertools.pairwise(tags))

    return max(itertools.product(range(len(entities.TAGS)), repeat=len(scores)), key=lambda tags: (total(tags), [-t for t in reversed(tags)]))


def test_decoder():
    r = random.Random(4)
    for _ in range(60):
        scores = [[0, *[r.randrange(-6, 9) for _ in entities.TAGS[1:]]] for _ in range(r.randrange(1, 5))]
        assert entities.decoded(scores) == list(best_of_all(scores))


def whole(detector, text):
    """Names by decoding all tokens at once, those that can't be names with O alone."""
    spans, scores = detector.scored(text)
    if not spans:
        return []
    only_o = [0, *[entities.NEVER * 1000] * (len(entities.TAGS) - 1)]
    tags = [entities.TAGS[t] for t in entities.decoded([s or only_o for s in scores])]
    out = []
    for (a, b), tag in zip(spans, tags):
        if tag[0] == "B":
            out.append([a, b, tag[2:]])
        elif tag[0] == "I":
            out[-1][1] = b
    return [tuple(x) for x in out]


def test_runs_are_enough():
    r = random.Random(5)
    detector = entities.EntityDetector(GAZETTEER, frozenset({"the", "end"}))
    words = ["the", "The", "End", "John", "Smith", "of", "and", "University", "Oxford", "in", "Berlin", "Springfield", "New", "York", "york", "Acme", "IBM", "Dr", ".", ",", "x9", "北", "京", "Zoe", "42", "J"]
    for _ in range(400):
        text = " ".join(r.choices(words, k=r.randrange(0, 14)))
        assert list(detector.names(text)) == whole(detector, text), text


def test_names_and_dates():
    detector = pickle.loads(pickle.dumps(entities.EntityDetector(GAZETTEER, frozenset({"the", "end"}))))
    text = "The end. Dr. Weber of the University of Oxford met John Smith in Berlin on 12 March 2024, near New York; 他在北京。 End"
    found = {(text[a:b], kind): c for a, b, kind, c in detector(text)}
    assert found == {
        ("Weber", "PERSON"): 0.88, ("University of Oxford", "ORG"): 0.95, ("John Smith", "PERSON"): 0.92, ("Berlin", "LOCATION"): 0.88,
        ("12 March 2024", "DATE"): 0.95, ("New York", "LOCATION"): 0.92, ("北京", "LOCATION"): 0.88,
    }
    for text, expected in {
        "2024-02-30 and 2024-13-01": ["2024-02-30"], "on 3rd of May, 2021.": ["3rd of May, 2021"], "May I go in May 2020?": ["May 2020"],
        "Sept 5": [], "Sep 5, 1999": ["Sep 5, 1999"], "31/12/99 45/1/2000": ["31/12/99"], "2024年3月5日 2024年15月": ["2024年3月5日"],
    }.items():
        assert [text[a:b] for a, b in entities.dates(text)] == expected


def test_long_text():
    detector = entities.EntityDetector({"a b": "ORG"}, frozenset())
    assert len(list(detector("lower case words only " * 100_000))) == 0
    assert len(list(detector("X" * 200_000 + " Anna Bell. " * 20_000))) >= 20_000


def test_bounds(monkeypatch, spark):
    monkeypatch.setattr(entities, "MOST_ENTRIES", 2)
    with pytest.raises(ValueError):
        entities.EntityDetector({str(k): "ORG" for k in range(3)})
    with pytest.raises(ValueError):
        entities.gazetteer((spark.range(3).select((F.col("id") + 100).cast("string").alias("x")), "x", "ORG"))
    with pytest.raises(ValueError):
        entities.EntityDetector({"a": "THING"})


def test_common_words(spark):
    df = spark.createDataFrame([("the The the Anna",), ("anna Anna Anna on",), (None,), ("",)], "text string")
    assert entities.common_words(df) == {"the", "on"} and entities.common_words(df, kept=1) == {"the"}


def test_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] or "" for r in registry.table(spark, sf_dir, "documents").collect()}
    cities = {r["city"].strip(): "LOCATION" for r in registry.table(spark, sf_dir, "clients").collect() if len((r["city"] or "").strip()) > 1}
    nations = {r["n_name"].strip(): "LOCATION" for r in registry.table(spark, sf_dir, "nation").collect()}
    low, n = {}, {}
    for w in (w for t in docs.values() for w in re.findall(r"[^\W\d_]+", t)):
        n[w.lower()] = n.get(w.lower(), 0) + 1
        low[w.lower()] = low.get(w.lower(), 0) + (w == w.lower())
    common = frozenset(sorted((w for w in n if low[w] > 0.5 * n[w]), key=lambda w: (-n[w], w))[:20_000])
    detector = entities.EntityDetector(nations | cities, common)
    expected = []
    for i, text in docs.items():
        found = [(a, b, "DATE") for a, b in entities.dates(text)] + whole(detector, text)
        at = 0
        for a, b, kind in sorted(found, key=lambda s: s[0]):
            if a >= at:
                expected.append((i, a, b, kind, entities.confidence(text[a:b])))
                at = b
    found = registry.QUERIES["i2_entities"](spark, sf_dir).collect()
    assert sorted((r["text_id"], r["start"], r["end"], r["type"], r["confidence"]) for r in found) == sorted(expected) and expected
    assert pii.coverage(registry.QUERIES["i2_entities"](spark, sf_dir)).count() == len({e[3] for e in expected})


def test_kept_tags_and_scores():
    """Runs of tokens that were met before aren't decoded again, and are tagged as if they were."""
    texts = [f"Then Dr. {a} of {b} met {c} in Paris on 3 May 2021." for a in ("Ann Lee", "Bo", "UNESCO") for b in ("Bath University", "Rome") for c in ("Jo van Dam", "they", "IBM Corp")]
    detector = entities.EntityDetector({"Paris": "LOCATION", "Rome": "LOCATION", "Bath": "LOCATION"}, frozenset({"then"}))
    entities.decoded_kept.cache_clear()
    found = [list(detector(t)) for t in texts * 3]
    assert found[: len(texts)] == found[len(texts) : 2 * len(texts)]
    assert entities.decoded_kept.cache_info().misses < len(texts) * 2
    for text in texts:
        spans, scores = detector.scored(text)
        k = 0
        while k < len(spans):
            end = k
            while end < len(spans) and scores[end] is not None:
                end += 1
            if end > k:
                assert entities.decoded_kept(tuple(scores[k:end])) == entities.decoded([list(s) for s in scores[k:end]])
            k = end + 1
    assert [text[a:b] for text in texts for a, b in entities.dates(text)] == ["3 May 2021"] * len(texts)
