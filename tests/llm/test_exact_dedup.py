import hashlib

import pytest
from pyspark.sql import functions as F

from loomtext.llm.exact_dedup import DigestIndex, exact_dedup

from .helpers import docs, rows

TEXTS = ["Aa", "aA", None, "", "É", "é", "x" * 200_000, "X" * 200_000, "aa ", "b", *["Hot"] * 40]


def expected(texts, keep):
    low = [(t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for t in texts]
    groups = {}
    for k, t in enumerate(low):
        groups.setdefault(t, []).append(k)
    return sorted((k, keep(groups[t]), len(groups[t]), k == keep(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for k, t in enumerate(low))


@pytest.mark.parametrize("hot", [1, 1000])
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_brute_force(spark, hot, keep):
    found = exact_dedup(docs(spark, TEXTS, extra=True), keep=keep, hot=hot).withColumn("hex", F.lower(F.hex("digest")))
    assert rows(found, "doc_id", "keep_id", "group_size", "kept", "hex") == expected(TEXTS, max if keep == "largest" else min)


def test_weak_digest_is_verified(spark):
    weak = lambda c: F.unhex(F.lpad(F.hex(F.length(c) % 3), 4, "0"))
    found = exact_dedup(docs(spark, TEXTS), digest=weak)
    assert rows(found, "doc_id", "keep_id", "group_size") == [x[:3] for x in expected(TEXTS, max)]


def test_edges(spark):
    assert exact_dedup(docs(spark, [])).count() == 0
    twice = docs(spark, ["a", "b"]).union(docs(spark, ["a", "b"]))
    assert rows(exact_dedup(twice), "doc_id", "keep_id", "group_size") == [(0, 0, 2), (0, 0, 2), (1, 1, 2), (1, 1, 2)]
    with pytest.raises(ValueError):
        exact_dedup(docs(spark, ["a"]), keep="any")
    with pytest.raises(ValueError):
        DigestIndex().compact()


def test_runs_compact(spark):
    index = DigestIndex(memtables=2)
    for ids in ((1, 2), (3,)):
        index.flush(spark.createDataFrame([(i, bytes([i % 2])) for i in ids], "id long, digest binary"))
    level = index.compact()
    assert rows(level, "digest", "lo", "hi", "n") == [(b"\x00", 2, 2, 1), (b"\x01", 1, 3, 2)]
    kept = index.filter(level.where("n > 1"))
    probe = spark.createDataFrame([(1, b"\x01"), (2, b"\x00"), (3, b"\x07")], "id long, digest binary")
    assert 1 in {r["id"] for r in index.maybe(probe, kept).collect()}


@pytest.mark.parametrize("hot", [1, 1_000_000])
def test_null_ids(spark, hot):
    rows_in = [(None, "x"), (None, "x"), (None, "y"), (None, "z"), (3, "z"), (4, "w")]
    found = exact_dedup(spark.createDataFrame(rows_in, "doc_id long, text string"), hot=hot).collect()
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found), key=str)
    assert got == sorted([(None, None, 2, False), (None, None, 2, False), (None, None, 1, False), (None, 3, 2, False), (3, 3, 2, True), (4, 4, 1, True)], key=str)
