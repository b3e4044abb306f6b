"""Corpus pipeline: rejects toxic documents, drops recurring lines, keeps one of each group of near copies, packs.

Each stage works on all rows the stage before it kept, written as Parquet and read again. All but the last return the
columns of ``documents``. Rows without an id pass every stage; a row whose text is null or empty is neither toxic nor
a near copy and is packed as its end id alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import line_dedup, ngram_join, packing, toxicity
from loomtext.llm.common import table, written
from loomtext.llm.queries import vocabulary


def unused(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labelled ones among them, rejects go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model, threshold=0.5)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template recurs across documents go from all but the first; documents of nothing else go."""
    added = unused(docs, "lines"), unused(docs, "dropped")
    found = line_dedup.line_dedup(docs, min_docs=2, added=added)
    changed = F.col(added[1]) > 0
    empty = changed & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    n_chars = F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.where(~F.coalesce(empty, F.lit(False))).withColumn("n_chars", n_chars).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document of smallest id stays. Rows that share an id and a text count as one;
    rows that share an id but not a text stay together if one of them is to stay."""
    found = ngram_join.jaccard_components(docs, n=5, percent=75)
    stays = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    text = unused(docs, "h")
    kept = docs.join(stays, "doc_id", "left_semi").withColumn(text, F.xxhash64("text")).dropDuplicates(["doc_id", text]).drop(text)
    return kept.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary(), max_tokens=2048, end_id=0)


STAGES = [("toxicity", toxic), ("line_dedup", lines), ("ngram_join", near_copies), ("packing", packed)]

#: No SQL expresses a learned classifier or best-fit packing; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
