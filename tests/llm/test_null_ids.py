"""Rows without an id, in operators that keep rows."""

import pytest
from pyspark.sql import functions as F

from loomtext.llm import ann, bpe, packing, toxicity, url_filter
from loomtext.llm.queries import URL_RULES, op8_toxicity, vocabulary

from .helpers import DOCS


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(None, "a b c", "en", "s", 5), (None, "a b c", "en", "s", 5), (1, None, None, None, None), (None, None, None, None, None)], DOCS)


def test_texts(docs):
    assert sorted(str(r["doc_id"]) for r in bpe.bpe_digests(docs, vocabulary()).collect()) == ["1", "None", "None", "None"]
    packed = packing.pack_documents(docs, vocabulary(), max_tokens=8, end_id=0).collect()
    assert sorted(str(r["doc_id"]) for r in packed) == ["1", "None", "None", "None"] and sum(r["length"] for r in packed) == 2 * 4 + 2


def test_urls(spark):
    pages = spark.createDataFrame([(None, "http://a.com/x"), (None, None), (1, "http://b.net/fr/")], "page_id long, url string")
    found = url_filter.filter_urls(pages, URL_RULES).collect()
    assert sorted((str(r["page_id"]), r["verdict"]) for r in found) == [("1", "block"), ("None", "allow"), ("None", "allow")]


def test_vectors(spark):
    rows = [(None, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.9, 0.0]), (100, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = ann.nearest(vectors, F.col("vec_id") % 100 == 0, k=2).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(found, key=lambda r: r["rank"])] == [(100, 1, 1), (100, 2, 2)]


def test_toxicity(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 1), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = op8_toxicity(spark, str(tmp_path)).collect()
    assert len(found) == 4 and {r["held_out"] for r in found if r["doc_id"] is None} == {False} and all(0 <= r["score"] <= 1 for r in found)
    assert docs.select(toxicity.held_out(docs["doc_id"]).alias("h")).where("h is null").count() == 0
