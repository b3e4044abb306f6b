import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomtext.llm.common import written
from loomtext.llm.queries import table

from .helpers import docs as documents
from .helpers import rows
from .test_line_dedup import brute as brute_lines


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, sf_dir), name)
        assert out.columns == columns, name
        assert out.join(docs, "doc_id", "left_anti").count() == 0
        if name == "ngram_join":
            from loomtext.llm.ngram_join import jaccard_components

            groups = jaccard_components(docs)
            assert out.count() == groups.select("component_id").distinct().count()
            again = jaccard_components(out)
            assert again.where(F.col("doc_id") != F.col("component_id")).count() == 0
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "packing"]


LONG = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120))


@pytest.fixture
def awkward(spark):
    """Nulls, empty and very long texts, near copies, repeated rows, an id with two texts, clashing columns."""
    other = LONG.replace("wordaa", "elsewhere")
    shared = "this very line stands in more than one of them"
    texts = [None, "", " \n ", LONG, other, f"first\n{shared}", f"second\n{shared}", "long " * 50_000, "unlike all the others here", shared]
    df = documents(spark, texts)
    df = df.union(df.where("doc_id IN (5, 8)")).union(df.where("doc_id = 8").withColumn("text", F.lit("another text of the same id")))
    df = df.union(df.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    return df.selectExpr("*", *[f"'{c}' AS {c}" for c in ("n_lines", "n_dropped", "dropped", "h", "th", "id", "score", "piece", "component_id", "cls", "f")])


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_heads(pairs):
    """The smallest id of each component of near copies, by all pairs."""
    component = {i: i for i, _ in pairs}
    sets = [(i, shingles(t)) for i, t in pairs]
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if a and b and 100 * len(a & b) >= 75 * len(a | b) and component[i] != component[j]:
                    component[i] = component[j] = min(component[i], component[j])
                    changed = True
    return {i for i, c in component.items() if i == c}


def test_lines_brute_force(spark, awkward):
    got = written(corpus_pipeline.lines(spark, awkward.where("doc_id IS NOT NULL"), ""), "lines")
    assert got.columns == awkward.columns and got.where("n_lines != 'n_lines' OR dropped != 'dropped' OR n_dropped != 'n_dropped'").count() == 0
    texts = [r["text"] for r in documents(spark, []).union(awkward.where("doc_id < 8").select("doc_id", "text", "lang", "source", "n_chars")).distinct().orderBy("doc_id").collect()]
    wanted = {k: t for k, t in brute_lines([*texts, "unlike all the others here", "this very line stands in more than one of them"], min_docs=2)}
    for r in got.where("doc_id != 8").collect():
        assert r["text"] == wanted[r["doc_id"]] and r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    assert {r["doc_id"] for r in got.collect()} == set(range(9))  # the last one held nothing but a recurring line


def test_near_copies_brute_force(spark, awkward):
    got = corpus_pipeline.near_copies(spark, awkward, "")
    assert got.columns == awkward.columns
    pairs = [(r["doc_id"], r["text"]) for r in awkward.where("doc_id IS NOT NULL AND text != 'another text of the same id' OR text IS NULL").distinct().collect()]
    kept = rows(got.where("doc_id IS NOT NULL"), "doc_id")
    assert {k for k, in kept} == brute_heads(pairs) and len(kept) == len(brute_heads(pairs)) + 1  # both texts of 8
    assert got.where("doc_id IS NULL").count() == 1


def test_whole_run_over_awkward_tables(spark, awkward, tmp_path):
    labels = spark.createDataFrame([(3, 1, 0), (4, 1, None), (99, 0, 1)], "doc_id long, quality int, toxic int")
    for name, df in (("some", awkward), ("none", awkward.limit(0))):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    got = corpus_pipeline.run(spark, str(tmp_path / "some"))
    assert {r["doc_id"] for r in got.collect()} == {0, 1, 2, 3, 5, 6, 7, 8}  # the row without an id held a copy of what 3 keeps
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
