import random
import re

import numpy as np
import pytest

from loomtext.llm import toxicity as tox
from loomtext.llm.queries import op8_toxicity, table

from .helpers import docs, rows


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def brute(terms, word):
    best = None
    for k, term in enumerate(terms):
        bare = term.removesuffix("*")
        row = distance(bare, word)
        e = min(row) if term.endswith("*") else row[-1]
        if e <= min(tox.LexiconTrie.errors(len(word)), tox.LexiconTrie.errors(len(bare))) and (best is None or (e, k) < best):
            best = (e, k)
    return best and (best[1], best[0])


@pytest.mark.parametrize("seed", [1, 2])
def test_automaton_brute_force(seed):
    r = random.Random(seed)
    word = lambda lo, hi: "".join(r.choice("abc") for _ in range(r.randint(lo, hi)))
    terms = list({word(3, 11) + r.choice(["", "*"]) for _ in range(25)})
    trie = tox.LexiconTrie(terms)
    words = [word(1, 13) for _ in range(1500)]
    left = tox.Screen(trie).near(words)
    for w in words:
        found = brute(terms, w)
        assert trie.match(w) == trie.match(w, left.get(w, [])) == found, w


def test_screen_rules_words_out_and_misses_none():
    r = random.Random(3)
    word = lambda lo, hi: "".join(r.choice("abcdefghijklmnopqrstuvwxyzéßñ漢") for _ in range(r.randint(lo, hi)))
    terms = [word(3, 12) + r.choice(["", "*"]) for _ in range(60)]
    misspelled = []
    for term in terms * 20:
        w = list(term.removesuffix("*"))
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w)) : r.randrange(len(w)) + 1] = r.choice([[], [r.choice("abcxyz")], ["q", "z"]])
            w = w or ["a"]
        misspelled.append("".join(w) + (word(0, 4) if term.endswith("*") else ""))
    words = misspelled + [word(1, 14) for _ in range(3000)]
    left = set(tox.Screen(tox.LexiconTrie(terms)).near(words))
    assert all(w in left for w in words if brute(terms, w)) and len(left & set(words[len(misspelled) :])) < 600
    assert tox.Screen(tox.LexiconTrie([])).near(["word"]) == {}


def test_quotation_is_apart():
    matches = tox.Matcher(["stupid", "moron"])
    plain, quoted = (tox.features(t, matches, [3.0, 2.0], 8) for t in ("you stupid moron", 'he wrote "you stupid moron" then'))
    assert plain[0] > 0 and plain[1] == 0 and plain[5] > 0 and quoted[0] == 0 and quoted[1] > 0 and quoted[4] == 0
    assert tox.features("you stupif one", matches, [3.0, 2.0], 8)[2] > 0
    assert tox.features(None, matches, [3.0, 2.0], 8) == tox.features("", matches, [3.0, 2.0], 8) == [0.0] * tox.FEATURES


def test_newton_separates():
    x = np.array([[0.0], [0.2], [1.0], [1.2]] * 20)
    y = np.array([0, 0, 1, 1] * 20, dtype=float)
    w = tox.fit_weights(x, y)
    assert ((x @ w[:-1] + w[-1] > 0) == (y == 1)).all()


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    found = op8_toxicity(spark, d).join(table(spark, d, "labels"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in found) >= 0.93 * len(found)


def test_edges(spark):
    model = tox.ToxicityModel(["stupid"], [4.0], np.array([3.0, 0, 1, 0, 1, 0, 0, -5.0]))
    texts = [None, "", "you are stupid", "x " * 60_000, "you are stupid"]
    scored = rows(tox.score(docs(spark, texts, extra=True), model), "doc_id", "score")
    assert scored[2][1] == scored[4][1] > 0.5 > scored[0][1] == scored[1][1] == scored[3][1]
    kept = tox.without_toxic(docs(spark, texts, extra=True), model)
    assert rows(kept, "doc_id") == [(0,), (1,), (3,)]
    assert tox.score(docs(spark, []), model).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    unlabelled = tox.fit(docs(spark, texts), none)
    assert all(s < 0.01 for _, s in rows(tox.score(docs(spark, texts), unlabelled), "doc_id", "score"))


def test_two_errors_from_nine_letters():
    trie = tox.LexiconTrie(["worthless", "disgusting"])
    assert trie.match("worthelss") == (0, 2) and trie.match("disgutsing") == (1, 2) and trie.match("wrothelss") is None


def test_rare_terms_stay_beside_many(spark):
    texts = [(1, "abominable one")] * 30 + [(1, "zz")] * 12 + [(0, "plain text")] * 400
    found = tox.learn_lexicon(spark.createDataFrame(texts, "toxic int, text string"))
    assert "zz" in [t for t, _ in found]


def slow_quotations(text):
    """By trying each closing mark for each opening one, line by line."""
    out, at = [], 0
    for line in text.split("\n"):
        i = 0
        while i < len(line):
            ends = [line.find(c, i + 1) for c in tox.CLOSERS.get(line[i], "")]
            ends = [e for e in ends if e > 0]
            if ends:
                out.append((at + i, at + min(ends) + 1))
                i = min(ends)
            i += 1
        at += len(line) + 1
    return out


def slow_features(text, terms, weights, window):
    words = list(re.finditer(r"[^\W\d_]+", text.lower()))
    inside = lambda m: any(a <= m.start() and m.end() < b for a, b in slow_quotations(text.lower()))
    hits = [(k, *found, inside(m)) for k, m in enumerate(words) if (found := brute(terms, m[0]))]
    exact, wrong = [[q for _, _, e, q in hits if bool(e) == w] for w in (False, True)]
    open_ = {t for _, t, e, q in hits if not e and not q}
    company = sum(not q and any(0 < abs(k - j) <= window for j, *_ in hits) for k, _, _, q in hits)
    out = [np.log1p(x) for x in (exact.count(False), exact.count(True), wrong.count(False), wrong.count(True))]
    return [*out, max((weights[t] for t in open_), default=0.0), np.log1p(company), sum(weights[t] for t in open_)]


@pytest.mark.parametrize("seed", [1, 2])
def test_features_brute_force(seed):
    r = random.Random(seed)
    terms, weights = ["stupid", "moron*", "worthless", "ugly"], [3.0, 2.0, 1.5, 1.0]
    parts = ["stupid", "stupif", "morons", "worthelss", "ugly", "a", "fine", "day", '"', "“", "”", "„", "«", "»", "‘", "’", "\n", "1", "Stupid"]
    for _ in range(300):
        text = " ".join(r.choice(parts) for _ in range(r.randint(0, 60)))
        assert tox.quotations(text) == slow_quotations(text)
        assert np.allclose(tox.features(text, tox.Matcher(terms), weights, 3), slow_features(text, terms, weights, 3)), text


def test_long_quotations():
    matches = tox.Matcher(["stupid"])
    for n in (300, 450, 10_000):
        assert tox.features('"' + "word " * (n // 5) + 'stupid" he said', matches, [3.0], 8)[:2] == [0.0, float(np.log(2))]
    assert tox.quotations("“" * 200_000) == []
