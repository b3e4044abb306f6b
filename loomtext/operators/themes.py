"""Theme suggestions: texts clustered by their TF-IDF vectors.

The vocabulary is bounded, so every task may hold it: vectors are made in the JVM, by a count vectorizer over it, a
product with the inverse document frequencies and a normalizer, without shuffling a term. k-means runs from several
starts (k-means||, seeds that follow each other), of which the one of least inertia wins. A theme's representatives are
the texts of largest cosine with its centre, computed for every text from the centres.

Texts without a term of the vocabulary belong to no theme but count in the coverage's denominator. Fewer usable texts
than themes give as many themes as texts at most; one text is one theme, none is an empty result. Null ids count as ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import terms
from ..session import materialised

#: English words that carry no theme.
STOP_WORDS = tuple(
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing "
    "down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor "
    "not now of off on once only or other our ours out over own same she should so some such than that the their theirs them then there these they "
    "this those through to too under until up very was we were what when where which while who whom why will with would you your yours".split()
)
#: Vectors that a task compares with the centres at a time.
ROWS = 2000
THEMES = "cluster int, name string, description string, keywords array<string>, representatives array<string>, coverage double"


def vocabulary(rows: DataFrame, most: int, min_df: int, max_df: float) -> list[tuple[str, int]]:
    """(term, df) of the most frequent terms of rows (terms), by all their occurrences and then by name, in order of
    their names; at most ``most``. A term must occur in min_df rows, and in a share of max_df of them at most."""
    each = rows.select(F.explode("terms").alias("term"), F.lit(1).alias("all"), F.lit(0).alias("df"))
    once = rows.select(F.explode(F.array_distinct("terms")).alias("term"), F.lit(0).alias("all"), F.lit(1).alias("df"))
    total = rows.count()
    n = each.unionAll(once).groupBy("term").agg(F.sum("all").alias("all"), F.sum("df").alias("df"))
    n = n.where((F.col("df") >= min_df) & (F.col("df") <= max_df * total)).orderBy(F.desc("all"), "term").limit(most)
    return sorted((r["term"], r["df"]) for r in n.collect())


def weights_of(n_texts: int, df: np.ndarray) -> np.ndarray:
    return np.log((1 + n_texts) / (1 + df)) + 1


def centres_of(vectors: DataFrame, k: int, starts: int, seed: int, iterations: int) -> np.ndarray:
    """The centres of the start with the least inertia."""
    if k == 1:
        return np.array([vectors.select(Summarizer.mean(F.col("features"))).first()[0].toArray()])
    models = [KMeans(k=k, seed=seed + s, maxIter=iterations).fit(vectors) for s in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return np.array(best.clusterCenters())


def nearest_centres(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, cluster, cosine) of each row (id, features), sparse unit vectors that aren't zero: the centre of least
    distance, the first among equals, and the cosine with it. Every task holds the centres, which are bounded."""
    kind = vectors.schema["id"].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = (centres**2).sum(axis=1)
        norms = np.sqrt(squares)
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            indices, values = batch.column(1), batch.column(2)
            starts = indices.offsets.to_numpy()[:-1] - indices.offsets[0].as_py()
            dots = np.add.reduceat(centres[:, indices.flatten().to_numpy()] * values.flatten().to_numpy(), starts, axis=1)
            best = np.argmin(squares[:, None] - 2 * dots, axis=0)
            cosines = np.where(norms[best] > 0, dots[best, np.arange(len(best))] / np.where(norms[best] > 0, norms[best], 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int32()), pa.array(cosines, pa.float64())], names=["id", "cluster", "cosine"])

    parts = F.unwrap_udt("features")
    return vectors.select("id", parts["indices"].alias("indices"), parts["values"].alias("values")).mapInArrow(walk, f"id {kind}, cluster int, cosine double")


def suggest_themes(
    df: DataFrame, id_col: str, text_col: str, n_themes: int = 6, max_terms: int = 5000, seed: int = 42, stop_words: tuple[str, ...] = STOP_WORDS,
    starts: int = 10, iterations: int = 50,
) -> DataFrame:
    """(cluster, name, description, keywords, representatives, coverage), largest first: up to eight keywords, the ids of
    the five nearest texts (the smaller id among equals), and the share of all texts, to three places."""
    spark: SparkSession = df.sparkSession
    words = terms(F.coalesce(F.col(text_col), F.lit("")))
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(*stop_words))
    rows = materialised(df.select(F.col(id_col).alias("id"), words.alias("terms")))
    n = rows.count()
    found = vocabulary(rows, max_terms, 2 if n > 10 else 1, 0.95 if n > 5 else 1.0)
    if not found:
        return spark.createDataFrame([], THEMES)
    names, idf = [t for t, _ in found], weights_of(n, np.array([k for _, k in found], float))
    counted = CountVectorizerModel.from_vocabulary(names, inputCol="terms", outputCol="counts").transform(rows)  # leaves other terms out
    counted = counted.where(F.size(F.unwrap_udt("counts")["indices"]) > 0)
    weighted = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="counts", outputCol="weighted").transform(counted)
    vectors = materialised(Normalizer(p=2.0, inputCol="weighted", outputCol="features").transform(weighted).select("id", "features"))
    k = min(n_themes, vectors.count())
    if k < 1:
        return spark.createDataFrame([], THEMES)
    centres = centres_of(vectors, k, starts, seed, iterations)
    near = materialised(nearest_centres(vectors, centres))  # read twice: sizes and representatives
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("cosine"), F.col("id").asc_nulls_last()))
    best = near.withColumn("k", place).where("k <= 5").groupBy("cluster")
    best = best.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"].cast("string")).alias("representatives"))
    sizes = near.groupBy("cluster").agg(F.count("*").alias("n"))
    told = []
    for c, centre in enumerate(centres):
        top = sorted(range(len(names)), key=lambda j: (-centre[j], names[j]))[:8]
        keywords = [names[j] for j in top if centre[j] > 0]
        told.append((c, f"Theme: {', '.join(keywords[:3])}", f"Texts about {', '.join(keywords[:5])}", keywords))
    out = spark.createDataFrame(told, "cluster int, name string, description string, keywords array<string>").join(sizes, "cluster").join(best, "cluster")
    out = out.withColumn("coverage", F.round(F.col("n") / n, 3))
    return out.orderBy(F.desc("n"), "cluster").select("cluster", "name", "description", "keywords", "representatives", "coverage")


def suggest(df: DataFrame, id_col: str, text_col: str, provider=None, n_themes: int = 6, first: int = 30, **parameters) -> DataFrame:
    """Themes that a model names from the first texts by id, as many as its prompt holds; without a model, or where its
    reply can't be read, those of suggest_themes(). Themes of a model have no keywords, representatives or coverage."""
    from .prompting import suggest_themes_by

    if provider is not None:
        rows = df.where(F.length(F.trim(F.coalesce(F.col(text_col), F.lit("")))) > 0).orderBy(id_col).select(text_col).limit(first).collect()
        found = suggest_themes_by(provider, [r[0] for r in rows], n_themes, first) if rows else None
        if found:
            told = [(k, str(t["name"]), str(t.get("description") or ""), None, None, None) for k, t in enumerate(found)]
            return df.sparkSession.createDataFrame(told, THEMES)
    return suggest_themes(df, id_col, text_col, n_themes, **parameters)
