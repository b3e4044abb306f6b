"""Texts are rewritten by id and content: null and repeated ids, and repeated segments, keep no personal data."""

import pytest
from pyspark.sql import functions as F

from loomtext.operators import pii

ROWS = [
    (None, "first n1@a.org"), (None, "second n2@a.org and n3@a.org"), (1, "mail a@b.com"), (1, "other x@y.org zz"), (1, "mail a@b.com"),
    (2, None), (None, None), (3, ""), (4, "nothing"), (None, "nothing"),
]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(ROWS)], "doc_id long, text string, start int")


def plain(text):
    import re

    return text and re.sub(r"\S+@\S+", "[REDACTED]", text)


def test_rewrite(docs):
    found = pii.name_replacements(pii.detect(docs, kinds=("EMAIL",)), "redact")
    assert sorted(map(str, map(tuple, pii.rewrite(docs, found).collect()))) == sorted(str((i, plain(t))) for i, t in ROWS)


def test_placeholders_are_shared(docs):
    found = pii.name_replacements(pii.detect(docs, kinds=("EMAIL",)))
    texts = [r["text"] for r in pii.rewrite(docs, found).collect()]
    assert len(texts) == len(ROWS) and not any("@" in t for t in texts if t)
    tokens = [t.split()[1] for t in texts if t and t.startswith("mail")]
    assert len(tokens) == 2 and len(set(tokens)) == 1
    of_second = next(t for t in texts if t and t.startswith("second")).split()
    assert of_second[1] != of_second[3]


def test_segments(docs):
    segments = docs.withColumn("segment_id", F.lit(None).cast("int"))
    found = pii.rewrite_segments(segments, "redact", kinds=("EMAIL",)).collect()
    assert sorted((r["start"], str(r["doc_id"]), r["text"]) for r in found) == [(k, str(i), plain(t)) for k, (i, t) in enumerate(ROWS)]


def test_review(spark, docs):
    found = pii.name_replacements(pii.detect(docs, kinds=("EMAIL",)), "redact")
    second = found.where("span = 'n2@a.org' or span = 'x@y.org'")
    log = second.select("text_id", "text_key", "start", F.lit(1).alias("seq"), F.when(F.col("text_id").isNull(), "rejected").otherwise("edited").alias("action"), F.lit("<x>").alias("value"))
    texts = {r["text"] for r in pii.apply_review(docs, found, log).collect()}
    assert "second n2@a.org and [REDACTED]" in texts and "other <x> zz" in texts and "mail [REDACTED]" in texts
    by_id = log.drop("text_key").where("text_id = 1")  # applies to every text of the id with a span there
    texts = {r["text"] for r in pii.apply_review(docs, found, by_id).collect()}
    assert "other <x> zz" in texts and "mail [REDACTED]" in texts and not any("@" in t for t in texts if t)
