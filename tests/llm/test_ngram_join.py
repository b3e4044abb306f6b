import random

import numpy as np
import pytest

from loomtext.llm import ngram_join as nj
from loomtext.llm.components import connected_components

from .helpers import docs, rows


def sets_of(texts, n=5):
    out = []
    for t in texts:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
        words = [w for w in words if w]
        out.append(frozenset(zip(*(words[k:] for k in range(n)), strict=False)) if len(words) >= n else frozenset([tuple(words)] if words else []))
    return out


def brute(texts, percent=75):
    sets = sets_of(texts)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(k, len(s), find(k)) for k, s in enumerate(sets)]


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = [r.choice(vocabulary) for _ in range(40)]
    out = []
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.randint(3, 90))]
        for _ in range(r.choice([1, 2, 5, 30])):
            copy = base[:]
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            out.append(" ".join(copy).title() if r.random() < 0.3 else "\t".join(copy))
    out += [" ".join(passage + [r.choice(vocabulary) for _ in range(r.randint(0, 20))]) for _ in range(40)]
    return [*out, None, "", "  ", "one two", "One  two", "one two three", "same " * 3000, "same " * 5000, "é É x y z", "É É x y z"]


@pytest.mark.parametrize(("seed", "small", "chunk", "hot", "long_list"), [(1, 2, 4, 200, 100), (2, 8, 1024, 2, 100), (3, 2, 4, 200, 5)])
def test_brute_force(spark, seed, small, chunk, hot, long_list):
    texts = corpus(seed)
    found = nj.jaccard_components(docs(spark, texts, extra=True), small=small, chunk=chunk, hot=hot, long_list=long_list)
    assert rows(found, "doc_id", "n_shingles", "component_id") == brute(texts)


def test_shingles_match_words():
    texts = corpus(3)
    assert [len(x) for x in nj.ngram_sets(texts)] == [len(x) for x in sets_of(texts)]
    a, b = nj.ngram_sets(["A b\tC d e F", " a  b c\nD E f "])
    assert (a == b).all()


def test_edges(spark):
    assert nj.jaccard_components(docs(spark, [])).count() == 0
    assert rows(nj.jaccard_components(docs(spark, [None, ""])), "doc_id", "n_shingles", "component_id") == [(0, 0, 0), (1, 0, 1)]
    twice = docs(spark, ["a b c d e f"]).union(docs(spark, ["a b c d e f"]))
    assert rows(nj.jaccard_components(twice), "doc_id", "component_id") == [(0, 0), (0, 0)]


def test_levels():
    df = np.array([2, 2, 3, 3, 500, 500, 500, 500], dtype=np.uint32)
    assert 1 <= nj.choose_level(df, 20, 12, 75, 4) <= 4
    assert nj.needed(20, 75) == 15 and nj.needed(21, 75) == 16


def test_components_of_chains(spark):
    r = random.Random(6)
    order = list(range(200))
    r.shuffle(order)
    links = [(a, b) for a, b in zip(order[:99], order[1:100], strict=True)] + [(a, b) for a, b in zip(order[100:-1], order[101:], strict=True)] + [(5, 5)]
    found = dict(rows(connected_components(spark.createDataFrame(links, "a long, b long")), "node", "component"))
    assert {found[x] for x in order[:100]} == {min(order[:100])} and {found[x] for x in order[100:]} == {min(order[100:])}


def test_components_of_a_long_chain(spark):
    order = list(range(2000))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame(list(zip(order[:-1], order[1:], strict=True)), "a long, b long")
    assert rows(connected_components(links), "node", "component") == [(x, 0) for x in range(2000)]


def test_common_passage_makes_no_pairs(spark, monkeypatch):
    """2000 documents of which four fifths are one passage: too much for a prefix by size alone, too little to link."""
    made = []

    def counting(*args):
        found = pairs(*args)
        made.append(found.count())
        return found

    pairs = nj.candidate_pairs
    monkeypatch.setattr(nj, "candidate_pairs", counting)
    passage = " ".join(f"p{k}" for k in range(80))
    texts = [f"{passage} {' '.join(f'd{i}w{k}' for k in range(20))}" for i in range(2000)] + [f"{passage} {' '.join(f'd7w{k}' for k in range(19))}"]
    found = rows(nj.jaccard_components(docs(spark, texts)), "doc_id", "component_id")
    assert [c for _, c in found] == [*range(2000), 7]
    assert made[0] < 100


def random_sets(seed):
    """Rows of sets as the neighbourhoods hold them, in an order by frequency; some share much, some little."""
    r = random.Random(seed)
    pool = [np.array(r.sample(range(400), 60)) for _ in range(3)]
    whole = [np.unique(np.concatenate([r.choice(pool)[: r.randint(20, 60)], np.array([r.randrange(400) for _ in range(r.randint(0, 12))], dtype=int)])) for _ in range(60)]
    df = np.bincount(np.concatenate(whole), minlength=400)
    out = []
    for k, x in enumerate(whole):
        x = x[np.lexsort((x, df[x]))]
        grams = x[df[x] > 1].astype(np.uint64)
        out.append((k, k, len(x), r.randint(1, 4), grams.tobytes()))
    return [set(x.tolist()) for x in whole], out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_between_finds_every_link(seed):
    import pyarrow as pa

    whole, out = random_sets(seed)
    table = pa.table([pa.array(c) for c in zip(*out, strict=True)], names=["id", "component", "n", "most", "grams"])
    linked = {(a, b) for a, x in enumerate(whole) for b, y in enumerate(whole) if a != b and 100 * len(x & y) >= 75 * len(x | y)}
    assert linked and set(nj.between(table, table, 75)) == linked
    sets = [(np.frombuffer(g, dtype=np.uint64), n, most) for _, _, n, most, g in out]
    assert {(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets) if a != b and nj._links(*x, *y, 75)} == linked
