"""Reliability reports against plain Python."""

import itertools
import random

import pytest

from loomtext.operators import reliability

from .test_agreement import kappa


def rows(df):
    return {(r["section"], r["name"]): (r["value"], r["interpretation"]) for r in df.collect()}


def jaccard(x, y):
    return 1.0 if not x | y else len(x & y) / len(x | y)


def sets(cell):
    return {s.strip() for s in (cell or "").split(",") if s.strip()}


def test_single(spark):
    r = random.Random(2)
    data = [tuple(r.choice(["x", " y ", "z", None]) for _ in range(3)) for _ in range(80)]
    df = spark.createDataFrame(data, "a string, b string, c string")
    label = lambda v: "nan" if v is None else v.strip()
    found = rows(reliability.report(df, ["a", "b", "c"]))
    kappas = {(p, q): round(kappa([(label(t["abc".index(p)]), label(t["abc".index(q)])) for t in data]), 4) for p, q in itertools.combinations("abc", 2)}
    for (p, q), value in kappas.items():
        assert found["pair", f"{p} vs {q}"][0] == pytest.approx(value, abs=1e-4)
    assert found["average", None][0] == pytest.approx(round(sum(kappas.values()) / 3, 4), abs=1e-4)
    assert ("alpha", None) in found and len(found) == 5
    two = rows(reliability.report(df, ["a", "b"]))
    assert two["kappa", None][0] == pytest.approx(kappas["a", "b"], abs=1e-4)
    assert {n for s, n in two if s == "specific"} == {"x", "y", "z", "nan"}


def test_multi(spark):
    r = random.Random(3)
    cells = ["p", "p, q", "q ,,p", "", None, "s"]
    data = [tuple(r.choice(cells) for _ in range(3)) for _ in range(60)]
    df = spark.createDataFrame(data, "a string, b string, c string")
    found = rows(reliability.report(df, ["a", "b", "c"], "multi"))
    means = [round(sum(jaccard(sets(t[i]), sets(t[j])) for t in data) / len(data), 4) for i, j in ((0, 1), (0, 2), (1, 2))]
    assert [found["pair", n][0] for n in ("a vs b", "a vs c", "b vs c")] == pytest.approx(means, abs=1e-4)
    assert found["average", None][0] == pytest.approx(sum(means) / 3, abs=1e-4)
    two = rows(reliability.report(df, ["a", "b"], "multi"))
    for theme in "pqs":
        pairs = [(theme in sets(t[0]), theme in sets(t[1])) for t in data]
        assert two["kappa", theme][0] == pytest.approx(round(kappa(pairs), 4), abs=1e-4)
    assert two["jaccard", None][0] == pytest.approx(means[0], abs=1e-4)
    assert two["average", None][0] == pytest.approx(sum(two["kappa", t][0] for t in "pqs") / 3, abs=1e-4)


def test_edges(spark):
    df = spark.createDataFrame([], "a string, b string, c string")
    assert rows(reliability.report(df, ["a", "b"]))["kappa", None][0] == 0.0
    assert rows(reliability.report(df, ["a", "b", "c"], "multi"))["average", None][0] == 0.0
    for wrong in (lambda: reliability.report(df, ["a"]), lambda: reliability.report(df, ["a", "b"], "other")):
        with pytest.raises(ValueError):
            wrong()
