import math
from collections import Counter

import numpy as np

from loomtext.llm import lm_score as lm

from .helpers import docs, rows

TEXTS = ["the cat sat on the mat", "The dog sat on the log", None, "", " \n", "zzz", "the cat sat on the mat", "a b c d e f g " * 300]


def test_counts_and_scores_brute_force(spark):
    df = docs(spark, TEXTS, extra=True)
    counts = lm.count_words(df)
    assert {r["word"]: r["n"] for r in counts.collect()} == Counter(w for t in TEXTS for w in (t or "").lower().split())
    model = lm.fit(df, own=6, rest=4, vocabulary=14, least=2, steps=40)
    classes, size = model.classes, model.classes.edge + 1
    cells, near = lm.window_counts(df, classes)
    wanted, beside = np.zeros((size, size, size), dtype=int), np.zeros((2, classes.numbered + 1, size), dtype=int)
    for t in TEXTS:
        words = (t or "").lower().split()
        ids = [size - 1, *[classes.of(w)[0] for w in words], size - 1]
        for k, w in enumerate(words):
            wanted[ids[k], ids[k + 1], ids[k + 2]] += 1
            beside[0, classes.of(w)[2], ids[k]] += 1
            beside[1, classes.of(w)[2], ids[k + 2]] += 1
    assert (cells == wanted).all() and classes.numbered > 0 and (near == beside[:, :-1]).all()
    for (doc, n, score, per), text in zip(rows(lm.score(df, model), "doc_id", "n_tokens", "log_likelihood", "per_token"), TEXTS, strict=True):
        coded = [classes.of(w) for w in (text or "").lower().split()]
        ids = [size - 1, *[c for c, _, _ in coded], size - 1]
        expected = 0.0
        for k, (c, share, i) in enumerate(coded):
            expected += float(model.table[ids[k], c, ids[k + 2]]) + share + float(model.factors[0, i, ids[k]]) + float(model.factors[1, i, ids[k + 2]])
        assert n == len(coded) and math.isclose(score, expected, rel_tol=1e-9, abs_tol=1e-9), doc
        assert (per is None) == (n == 0)


def test_shares_follow_the_corpus(spark):
    """Without a place in the vocabulary words still differ by their counts, and buckets grow with the distinct words."""
    texts = [" ".join(f"w{k}x" for _ in range(1 + k % 3)) for k in range(600)]
    few = lm.learn_classes(lm.count_words(docs(spark, texts[:40])), vocabulary=2, own=2, rest=2)
    many = lm.learn_classes(lm.count_words(docs(spark, texts)), vocabulary=2, own=2, rest=2)
    assert many.rest.size > 8 * few.rest.size
    alone = {k for k, n in Counter(lm.place(f"w{k}x", *many.rest.shape) for k in range(600)).items() if n == 1}
    shares = {n: [many.of(f"w{k}x")[1] for k in range(600) if k % 3 == n - 1 and lm.place(f"w{k}x", *many.rest.shape) in alone and f"w{k}x" not in many.words] for n in (1, 2, 3)}
    assert max(shares[1]) < min(shares[2]) and max(shares[2]) < min(shares[3])


def test_probabilities_of_all_words_sum_to_one(spark):
    model = lm.fit(docs(spark, TEXTS), own=3, rest=3, vocabulary=12, least=2, steps=30)
    classes, size = model.classes, model.classes.edge + 1
    words = sorted({w for t in TEXTS for w in (t or "").lower().split()})
    known = [classes.of(w) for w in words]
    kinds = Counter(lm.place(w, *classes.rest.shape) for w in words if w not in classes.words)
    assert classes.numbered > 2
    for left in range(size):
        for right in range(size):
            total = sum(np.exp(float(model.table[left, c, right]) + s + float(model.factors[0, i, left]) + float(model.factors[1, i, right])) for c, s, i in known)
            for (k, j), share in np.ndenumerate(classes.rest):  # one more word, that the corpus doesn't hold, for each bucket
                assert kinds[k, j] >= 0
                total += np.exp(float(model.table[left, classes.own + k, right]) + float(share))
            total += np.exp(model.table[left, classes.edge, right])
            assert math.isclose(total, 1, rel_tol=2e-3)


def test_words_know_their_neighbours(spark):
    """Words of one class, told apart by their neighbours alone."""
    texts = ["red fox ran and blue fish swam and "] * 60
    model = lm.fit(docs(spark, texts), own=1, rest=1, vocabulary=20, steps=60)
    assert model.factors.any()
    plain = lm.LmModel(model.classes, model.table * 0, model.factors * 0)
    assert plain.score("red")[1] == plain.score("swam")[1]
    at = lambda text: model.log_probabilities(text)[1]
    assert at("and red fox") > at("and swam fox")


def test_training_learns():
    counts = np.zeros((5, 5, 5), dtype=int)
    for left in range(4):
        for right in range(4):
            counts[left, (left + right) % 4, right] = 50
    losses = lm.WindowNetwork(5).train(counts, steps=400)
    assert losses[-1] < 0.5 * losses[0]


def test_word_order_matters(spark):
    texts = ["the cat sat on the mat and the dog sat on the log"] * 20
    model = lm.fit(docs(spark, texts), own=8, rest=2, vocabulary=20, steps=200)
    assert model.score(texts[0])[1] > model.score("on on the the sat sat mat log cat dog and the the")[1]
    assert lm.score(docs(spark, []), model).count() == 0


def test_empty_corpus(spark):
    model = lm.fit(docs(spark, []), own=4, rest=2, steps=2)
    assert model.score("any words")[0] == 2 and model.score(None) == (0, 0.0)
