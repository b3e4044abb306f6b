import numpy as np
from pyspark.sql import functions as F

from loomtext.llm import ann
from loomtext.llm.queries import op6_ann, table


def brute(vectors, queries, k):
    out = {}
    for q in queries:
        score = {i: float(np.sqrt(np.square(np.array(v) - np.array(vectors[q])).sum())) for i, v in vectors.items() if i != q and len(v) == len(vectors[q])}
        out[q] = sorted(score.items(), key=lambda x: (x[1], x[0]))[:k]
    return out


def test_recall_and_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").collect()
    vectors = {r["vec_id"]: r["embedding"] for r in rows if r["embedding"] is not None}
    wanted = brute(vectors, [i for i in vectors if i % 100 == 0], 10)
    got = {}
    for r in op6_ann(spark, sf_dir).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(wanted)
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and found == sorted(found, key=lambda x: (x[2], x[1]))
        hit += len({v for _, v, _ in found} & {v for v, _ in wanted[q]})
    assert hit >= 0.9 * 10 * len(wanted)


def test_edges(spark):
    same = [(100 + i, [1.0, 2.0]) for i in range(1, 60)]
    odd = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(0, [1.0, 2.0]), *same, *same[:5], *odd], "vec_id long, embedding array<double>").selectExpr("*", "1 AS q", "2 AS id")
    got = ann.nearest(df, F.col("vec_id") == 0, k=10, chunk=8, block=1).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(i, 100 + i, 0.0) for i in range(1, 11)]
    assert ann.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0
    few = ann.nearest(df.where("vec_id IN (0, 101, 7)"), F.col("vec_id") == 0).collect()
    assert [r["vec_id"] for r in few] == [101]


def test_probe_order():
    h = ann.Hashes.draw(4, 1, 2, 1.0, 1.0, 3)
    cells = np.array([[a, b] for a in range(-4, 5) for b in range(-4, 5)])
    query = np.ones(4)
    ones = np.ones(len(cells))
    order = h.probes(0, query, cells, 0.9, ones, 1)
    assert tuple(cells[order[0]]) == tuple(np.floor(h.positions(0, query)).astype(int)) or len(order) > 1
    assert len(h.probes(0, query, cells, 0.5, ones, 70)) >= 70
    assert len(h.probes(0, query, cells, 0.5, ones, 1)) <= len(order) == len(set(order.tolist()))


def test_large_ids(spark):
    rows = [(0, [1.0, 0.0]), (2**60, [2.0, 0.0]), (2**60 + 1, [2.0, 0.0]), (2**60 + 1, [2.0, 0.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 2**60, 1.0), (2, 2**60 + 1, 1.0)]


def test_large_components(spark):
    rows = [(0, [1e200, 0.0]), (1, [-1e200, 0.0]), (2, [1e200, 1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 2, 1.0), (2, 1, 2e200)]


def test_more_buckets_than_the_driver_holds(spark):
    """Vectors of very uneven norm occupy many cells: the tables are drawn again with fewer functions, and nothing is lost."""
    r = np.random.default_rng(4)
    vectors = {i: (x * np.exp(2 * r.normal())).tolist() for i, x in enumerate(r.normal(size=(2000, 8)))}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    got = {}
    for row in ann.nearest(df, F.col("vec_id") % 20 == 0, bucket_rows=4, most_buckets=40).collect():
        got.setdefault(row["query_id"], set()).add(row["vec_id"])
    wanted = brute(vectors, [i for i in vectors if i % 20 == 0], 10)
    assert sum(len(got[q] & {v for v, _ in found}) for q, found in wanted.items()) >= 0.9 * 10 * len(wanted)
