"""Themes, splits and duplicates against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtext.operators import profile, themes, training


def vectors(texts, most=5000):
    """Unit TF-IDF vectors by text, of the texts with terms."""
    words = {i: [w for w in re.findall(r"\b\w\w+\b", (t or "").lower()) if w not in themes.STOP_WORDS] for i, t in texts}
    df, total = Counter(w for ws in words.values() for w in set(ws)), Counter(w for ws in words.values() for w in ws)
    n = len(texts)
    kept = [w for w in df if df[w] >= (2 if n > 10 else 1) and df[w] <= (0.95 if n > 5 else 1.0) * n]
    kept = set(sorted(kept, key=lambda w: (-total[w], w))[:most])
    out = {}
    for i, ws in words.items():
        v = {w: c * (math.log((1 + n) / (1 + df[w])) + 1) for w, c in Counter(ws).items() if w in kept}
        if v:
            length = math.sqrt(sum(x * x for x in v.values()))
            out[i] = {w: x / length for w, x in v.items()}
    return out


def corpus(n=60):
    r = random.Random(3)
    topics = [["garden", "flower", "soil", "water"], ["engine", "wheel", "road", "fuel"], ["music", "song", "choir", "piano"]]
    return [(k, " ".join(r.choices(topics[k % 3], k=8) + ["the", "and"])) for k in range(n)]


def test_themes(spark):
    texts = corpus() + [(100, None), (101, "the and"), (102, "")]
    found = themes.suggest_themes(spark.createDataFrame(texts, "id long, text string"), "id", "text", 3, starts=3).collect()
    mine = vectors(texts)
    assert [r["coverage"] for r in found] == [round(20 / 63, 3)] * 3 and len(found) == 3
    for r in found:  # each theme is a topic, so its centre is the mean of that topic's texts
        topic = int(r["representatives"][0]) % 3
        members = [i for i in mine if i % 3 == topic]
        centre = Counter()
        for i in members:
            for w, x in mine[i].items():
                centre[w] += x / len(members)
        length = math.sqrt(sum(x * x for x in centre.values()))
        cosine = {i: sum(x * centre[w] for w, x in mine[i].items()) / length for i in members}
        best = sorted(members, key=lambda i: (-round(cosine[i], 12), i))[:5]
        assert sorted(round(cosine[int(i)], 9) for i in r["representatives"]) == sorted(round(cosine[i], 9) for i in best)
        assert r["keywords"] == sorted(centre, key=lambda w: (-centre[w], w))[:8] and r["name"] == f"Theme: {', '.join(r['keywords'][:3])}"


@pytest.mark.parametrize(("texts", "n"), [([], 0), ([None, "", "the"], 0), (["one garden"], 1), (["same words", "same words", "same words"], 1), (["garden", "engine"], 2)])
def test_small_input(spark, texts, n):
    found = themes.suggest_themes(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text", starts=2).collect()
    assert len(found) == n and sum(r["coverage"] for r in found) == (1.0 if n else 0)


def test_least_inertia(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.linalg import Vectors

    r = random.Random(8)
    rows = spark.createDataFrame([(Vectors.dense([r.random(), r.random()]),) for _ in range(80)], ["features"])
    costs = [KMeans(k=5, seed=s, maxIter=20).fit(rows).summary.trainingCost for s in range(4)]
    centres = themes.centres_of(rows, 5, 4, 0, 20)
    cost = sum(min(sum((x - y) ** 2 for x, y in zip(v, c)) for c in centres) for (v,) in rows.collect())
    assert cost == pytest.approx(min(costs))


def windowed(df, label, share, seed=42):
    order = Window.partitionBy(label).orderBy(F.xxhash64(F.col("id"), F.lit(seed)), "id")
    rows = df.withColumn("k", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy(label)))
    cut = F.when(F.col("n") > 1, F.greatest(F.lit(1), F.floor(F.col("n") * share))).otherwise(0)
    return sorted(r["id"] for r in rows.where(F.col("k") <= cut).collect())


@pytest.mark.parametrize(("share", "leading"), [(0.2, 12), (0.5, 1), (0.0, 12), (1.0, 3)])
def test_split(spark, share, leading, monkeypatch):
    monkeypatch.setattr(training, "LEADING", leading)
    rows = [(k, "a" if k % 7 else "b") for k in range(200)] + [(300, None), (301, None), (302, "one")]
    df = spark.createDataFrame(rows, "id long, label string")
    fit, held = training.stratified_split(df, "label", "id", share)
    assert fit.columns == held.columns == ["id", "label"]
    held = sorted(r["id"] for r in held.collect())
    assert held == windowed(df, "label", share) and sorted(r["id"] for r in fit.collect()) == sorted({r[0] for r in rows} - set(held))


def test_model_round_trip(spark, tmp_path):
    rows = [(k, f"{'good fine' if k % 2 else 'bad poor'} w{k % 5}", "yes" if k % 2 else "no") for k in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    fit, held = training.stratified_split(df, "label", "id")
    model, history = training.train_until(fit, held, "text", "label", features=256, most=20)
    assert history[0][0] == 5 and max(f for _, f in history) == 1.0 and len(history) <= 3
    before = sorted(map(tuple, training.predict(model, held, "text", "label").collect()))
    training.save(model, str(tmp_path / "model"))
    training.save(model, str(tmp_path / "model"))
    assert sorted(map(tuple, training.predict(training.load(str(tmp_path / "model")), held, "text", "label").collect())) == before


@pytest.mark.parametrize("weak", [False, True])
def test_duplicates(spark, weak):
    rows = [(1, "a"), (1, "a"), (None, "a"), (1, None), (None, None), (None, None), (2, "b")] * 2 + [(9, "x")]
    df = spark.createDataFrame(rows, "k long, text string")
    key = F.lit(0) if weak else None
    kinds = len(set(rows))
    assert tuple(profile.duplicates(df, key=key).first()) == (15, 15 - kinds, round((15 - kinds) / 15, 4))
    assert tuple(profile.kinds(df.limit(0), ["text"], key).first()) == (0, 0)
    assert tuple(profile.text_uniqueness(df, "text").first()) == (9, 3, round(3 / 9, 4), True)


def test_nearest_centres_of_sparse_vectors(spark, monkeypatch):
    """Centres are compared with the vectors as they are, in slices, and not with lists of terms; first among equals."""
    from pyspark.ml.linalg import SparseVector, VectorUDT
    from pyspark.sql.types import LongType, StructField, StructType

    monkeypatch.setattr(themes, "ROWS", 3)
    r = np.random.default_rng(5)
    centres = np.vstack([r.random((3, 9)), np.zeros((1, 9))])
    centres = np.vstack([centres, centres[:1]])  # the last equals the first
    rows, expected = [], {}
    for k in range(40):
        at = np.sort(r.choice(9, r.integers(1, 6), replace=False))
        x = np.zeros(9)
        x[at] = r.random(len(at)) + 0.1
        x /= np.sqrt((x * x).sum())
        rows.append((k, SparseVector(9, at, x[at])))
        c = int(np.argmin(((centres - x) ** 2).sum(axis=1)))
        expected[k] = (c, round(float(centres[c] @ x / np.linalg.norm(centres[c])), 9) if centres[c].any() else 0.0)
    schema = StructType([StructField("id", LongType()), StructField("features", VectorUDT())])
    found = themes.nearest_centres(spark.createDataFrame(rows, schema).repartition(4), centres).collect()
    assert {x["id"]: (x["cluster"], round(x["cosine"], 9)) for x in found} == expected
    assert 4 not in {c for c, _ in expected.values()}
