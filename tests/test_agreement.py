import itertools
import random

import pytest

from loomtext.operators import agreement as ag


def kappa(pairs):
    n = len(pairs)
    labels = {x for p in pairs for x in p}
    po = sum(a == b for a, b in pairs) / n
    pe = sum(sum(a == x for a, _ in pairs) * sum(b == x for _, b in pairs) for x in labels) / n**2
    return 0.0 if pe >= 1 else (po - pe) / (1 - pe)


@pytest.mark.parametrize("seed", [1, 2])
def test_kappa_brute_force(spark, seed):
    r = random.Random(seed)
    pairs = [(r.choice("xyz"), r.choice("xyz")) for _ in range(60)]
    row = ag.cohens_kappa(spark.createDataFrame(pairs, "a string, b string"), "a", "b").first()
    assert row["kappa"] == pytest.approx(kappa(pairs), abs=1e-4)
    assert row["n_items"] == 60


def test_kappa_edges(spark):
    df = lambda rows: spark.createDataFrame(rows, "a string, b string")
    assert ag.cohens_kappa(df([("x", "x"), ("y", "y")]), "a", "b").first()["kappa"] == 1.0
    assert ag.cohens_kappa(df([("x", "x")]), "a", "b").first()["kappa"] == 0.0
    assert ag.cohens_kappa(df([]), "a", "b").first()["kappa"] == 0.0
    assert ag.cohens_kappa(df([("x", " x "), (None, None), ("y", "y")]), "a", "b").first()["kappa"] == 1.0
    limited = ag.cohens_kappa(df([("x", "x"), ("y", "y"), ("z", "x")]), "a", "b", labels=["x", "y"]).first()
    assert limited["n_items"] == 3 and limited["n_categories"] == 2


def test_alpha_forms(spark):
    rows = [(1, "a", "x"), (1, "b", "x"), (1, "c", "y"), (2, "a", "y"), (2, "b", "y"), (3, "a", "x"), (3, "b", "y"), (3, "c", "y"), (4, "a", None), (4, "b", "x"), (5, "a", "y"), (5, "b", "x")]
    df = spark.createDataFrame(rows, "item_id int, coder string, label string")
    units = {}
    for i, _, v in rows:
        if v:
            units.setdefault(i, []).append(v)
    units = {k: v for k, v in units.items() if len(v) > 1}
    values = [v for u in units.values() for v in u]
    n = len(values)
    de = (n * n - sum(values.count(x) ** 2 for x in set(values))) / (n * (n - 1))
    off = {k: sum(a != b for a, b in itertools.permutations(u, 2)) for k, u in units.items()}
    world = 1 - sum(off.values()) / sum(len(u) * (len(u) - 1) for u in units.values()) / de
    standard = 1 - sum(off[k] / (len(u) - 1) for k, u in units.items()) / n / de
    assert ag.krippendorffs_alpha(df).first()["alpha"] == pytest.approx(world, abs=1e-4)
    assert ag.krippendorffs_alpha(df, form="standard").first()["alpha"] == pytest.approx(standard, abs=1e-4)
    assert ag.krippendorffs_alpha(df.where("label = 'x'")).first()["alpha"] == 1.0
    assert ag.krippendorffs_alpha(df.limit(0)).first()["alpha"] == 0.0


def test_jaccard(spark):
    rows = [(["a", "b", "c"], ["a", "b"]), ([], []), (["a"], [])]
    df = spark.createDataFrame(rows, "x array<string>, y array<string>")
    assert [r[0] for r in df.select(ag.jaccard(df.x, df.y)).collect()] == [pytest.approx(2 / 3), 1.0, 0.0]


def test_evaluate(spark):
    df = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "B"), ("B", "B")], "t string, p string")
    counts = ag.pair_counts(df, "t", "p")
    rows = {r["label"]: r for r in ag.evaluate(ag.label_margins(counts)).collect()}
    assert (rows["A"]["precision"], rows["A"]["recall"], rows["A"]["f1"], rows["A"]["support"]) == (1.0, 0.5, 0.6667, 2)
    assert (rows["B"]["precision"], rows["B"]["recall"], rows["B"]["f1"], rows["B"]["support"]) == (0.6667, 1.0, 0.8, 2)
    wide = {r["row"]: (r["pred:A"], r["pred:B"]) for r in ag.confusion_wide(counts, ["A", "B"]).collect()}
    assert wide == {"true:A": (1, 1), "true:B": (0, 2)}
