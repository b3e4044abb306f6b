"""TF-IDF and what builds on it: diversity, overlap of descriptions, diverse examples.

Weights are a sparse long table (id, term, weight). Texts are shuffled by their id, which is all that
counting a document's terms and its norm need. The counts by term, added up in each task first, meet them by broadcast up to
``HELD_TERMS`` terms, and by a shuffle beyond. Pairs of documents are never formed: the mean similarity of all pairs
follows from the sums by term.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import terms
from ..session import materialised

#: Terms, with a number each, that a task holds (about 50 MB).
HELD_TERMS = 500_000

def tfidf(df: DataFrame, id_col: str, text_col: str, max_terms: int | None = None, min_df: int = 1, max_df: float = 1.0, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """(id, term, weight): lower-cased terms of two or more word characters, idf ln((1 + n) / (1 + df)) + 1, unit rows.
    max_terms keeps the most frequent terms by total count, ties by term."""
    words = terms(F.col(text_col))
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(*stop_words))
    own = df.select(F.col(id_col).alias("id"), F.col(text_col)).repartition("id")  # texts, which are smaller than their terms
    tf = own.select("id", F.explode(words).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    total = df.agg(F.count("*").alias("total"))
    counts = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("all")).join(F.broadcast(total), F.lit(True))
    counts = counts.where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("total")))
    if max_terms:
        counts = counts.orderBy(F.desc("all"), "term").limit(max_terms)
    idf = counts.select("term", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf"))
    n_terms = max_terms or df.select(F.explode(words).alias("term")).agg(F.approx_count_distinct("term")).first()[0]
    raw = tf.join(F.broadcast(idf) if n_terms <= HELD_TERMS else idf, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return raw.select("id", "term", (F.col("w") / norm).alias("weight"))


def diversity(weights: DataFrame, n_texts: int | None = None) -> DataFrame:
    """(n, diversity): 1 minus the mean cosine of all pairs, to four places; 0 for fewer than two texts."""
    n = weights.agg(F.countDistinct("id").alias("docs"))
    sums = weights.groupBy("term").agg(F.sum("weight").alias("s"), F.sum(F.col("weight") * F.col("weight")).alias("q")).agg(F.sum(F.col("s") * F.col("s")).alias("total"), F.sum("q").alias("own"))
    out = sums.join(F.broadcast(n), F.lit(True)).withColumn("n", F.lit(n_texts).cast("long") if n_texts else F.col("docs"))
    mean = (F.col("total") - F.col("own")) / (F.col("n") * (F.col("n") - 1))
    return out.select("n", F.round(F.when(F.col("n") < 2, 0.0).otherwise(1 - mean), 4).alias("diversity"))


def overlaps(weights: DataFrame, least: float = 40.0) -> DataFrame:
    """(a, b, overlap): pairs of texts whose cosine times 100 exceeds least. For codebooks: few texts, by definition."""
    a = weights.select(F.col("id").alias("a"), "term", F.col("weight").alias("wa"))
    b = weights.toDF("b", "term", "wb")
    out = a.join(b, "term").where("a < b").groupBy("a", "b").agg(F.round(100 * F.sum(F.col("wa") * F.col("wb")), 1).alias("overlap"))
    return out.where(F.col("overlap") > least)


def top_terms(weights: DataFrame, groups: DataFrame, k: int = 8) -> DataFrame:
    """(group, rank, term, weight): the k terms of largest mean weight of each group. groups: (id, group)."""
    sizes = groups.groupBy("group").agg(F.count("*").alias("size"))
    sums = weights.join(groups, "id").groupBy("group", "term").agg(F.sum("weight").alias("w")).join(F.broadcast(sizes), "group")
    rank = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("w"), "term"))
    return sums.withColumn("rank", rank).where(F.col("rank") <= k).select("group", "rank", "term", (F.col("w") / F.col("size")).alias("weight"))


def select_examples(df: DataFrame, id_col: str, text_col: str, label_col: str, n: int = 3) -> DataFrame:
    """(label, pick, id): n diverse texts of each label: the first, then each time the one farthest from those chosen.

    Greedy and sequential, so a round is a plan: similarities of all texts to the last pick, by label, n - 1 times.
    The picks' weights, of one text a label, meet all others by broadcast."""
    rows = df.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"))
    weights = materialised(tfidf(df, id_col, text_col, 3000).join(rows, "id"))  # every pick reads them
    nearest = rows.withColumn("near", F.lit(-1.0))
    picks = rows.groupBy("label").agg(F.min("id").alias("id")).withColumn("pick", F.lit(1))
    chosen = picks
    for k in range(2, n + 1):
        last = weights.join(F.broadcast(picks.select(F.col("label").alias("l"), F.col("id").alias("p"))), (F.col("label") == F.col("l")) & (F.col("id") == F.col("p")))
        last = last.select(F.col("label").alias("l"), F.col("term").alias("t"), F.col("weight").alias("w"))
        similar = weights.join(F.broadcast(last), (F.col("label") == F.col("l")) & (F.col("term") == F.col("t"))).groupBy("id").agg(F.sum(F.col("weight") * F.col("w")).alias("s"))
        nearest = nearest.join(similar, "id", "left").select("id", "label", F.greatest("near", F.coalesce("s", F.lit(0.0))).alias("near"))
        left = nearest.join(F.broadcast(chosen.select("id")), "id", "left_anti")
        picks = left.groupBy("label").agg(F.min_by("id", F.struct(F.round("near", 9), "id")).alias("id")).withColumn("pick", F.lit(k))
        chosen = chosen.unionByName(picks)
    return chosen.select("label", "pick", "id")
