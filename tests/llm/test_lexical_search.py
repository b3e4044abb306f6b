"""Holds the search against scores computed document by document."""

import math
import random
import re

import pytest

from loomtext.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, k):
    docs = [(i, terms(t)) for i, t in docs]
    docs = [d for d in docs if d[1]]
    n_docs, n_all = len(docs), sum(len(d[1]) for d in docs)
    out = []
    for item, text in items:
        scored = []
        for i, words in docs:
            score = 0
            for t in set(terms(text)):
                df, tf = sum(t in d[1] for d in docs), words.count(t)
                m = 100 - 50 + (50 * len(words) * n_docs) // n_all
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((1000000000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def made(seed):
    r = random.Random(seed)
    words = ["alpha", "Beta", "GAMMA", "ÄÖ", "äö", "x1", "漢字", "é", "İ", "ſ", "the", "a-b", "c_d", "\x7fz", "\x80"]
    docs = [(k, "".join(r.choice(words) + r.choice(" \t\n.,;:-_'\"[]{}@/") for _ in range(r.randrange(0, 60)))) for k in range(150)]
    docs += [(7, "alpha beta"), (7, "alpha beta"), (None, "alpha beta"), (None, None), (500, ""), (501, " .- "), (502, "the " * 3000 + "rare")]
    items = [(k, " ".join(r.choices(words, k=r.randrange(1, 8)))) for k in range(12)]
    return docs, items + [(3, "alpha"), (None, "beta"), (90, None), (91, "unknown"), (92, "rare the the")]


@pytest.mark.parametrize(("window", "chunk", "k"), [(16, 1_000_000, 5), (64, 5, 50), (32768, 1_000_000, 50)])
def test_brute_force(spark, window, chunk, k, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK", 100)
    docs, items = made(window)
    d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, m string")
    q = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, score string")
    found = lexical_search.search(d, q, k, window=window, chunk=chunk)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, ranked(docs, items, k)))


def test_windows_by_postings(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lexical_search, "MOST_POSTINGS", 10)
    lists = [list(range(n)) for n in (3, 9, 12, 0, 4, 4, 4, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32())), pa.array(range(8))], names=["terms", "k"])
    cut = [t["k"].to_pylist() for t in lexical_search.windows(iter([batch, batch.slice(4)]), 4)]
    assert [k for part in cut for k in part] == [*range(8), *range(4, 8)]
    assert all(len(part) <= 4 and (len(part) == 1 or sum(len(lists[k]) for k in part) <= 10) for part in cut)


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert lexical_search.search(docs, items).collect() == []
    assert lexical_search.search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.limit(0)).collect() == []
