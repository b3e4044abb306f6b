"""Reliability of coders and evaluation of classifiers, all from one table of pair counts.

Pairs are counted map-side and shuffled by pair of labels; what follows works on a row for each pair of labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ordinal, ustrip

#: Interpretation scales.
KAPPA_SCALE = ((0.0, "Poor agreement"), (0.21, "Slight agreement"), (0.41, "Fair agreement"), (0.61, "Moderate agreement"), (0.81, "Substantial agreement"), (None, "Almost perfect agreement"))
ALPHA_SCALE = ((0.667, "Unreliable — discard or recode"), (0.8, "Tentatively reliable"), (None, "Reliable"))
JACCARD_SCALE = ((0.2, "Poor agreement"), (0.4, "Fair agreement"), (0.6, "Moderate agreement"), (0.8, "Substantial agreement"), (None, "Almost perfect agreement"))


def interpret_kappa(value: Column) -> Column:
    return ordinal(value, *KAPPA_SCALE)


def interpret_alpha(value: Column) -> Column:
    return ordinal(value, *ALPHA_SCALE)


def interpret_jaccard(value: Column) -> Column:
    return ordinal(value, *JACCARD_SCALE)


def pair_counts(df: DataFrame, a: str, b: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, a, b, n): how often the labels meet; labels are stripped strings, and null is the label nan."""
    label = lambda c: ustrip(F.coalesce(F.col(c).cast("string"), F.lit("nan")))
    return df.groupBy(*keys, label(a).alias("a"), label(b).alias("b")).agg(F.count("*").alias("n"))


def label_margins(counts: DataFrame, keys: tuple[str, ...] = (), labels: list[str] | None = None) -> DataFrame:
    """(keys, label, r, c, tp, total): margins of each label. Pairs outside labels leave the matrix, not the total."""
    inside = F.lit(True) if labels is None else F.col("a").isin(labels) & F.col("b").isin(labels)
    zero, n = F.lit(0).cast("long"), F.when(inside, F.col("n")).otherwise(F.lit(0).cast("long"))
    sides = F.array(
        F.struct(F.col("a").alias("label"), n.alias("r"), zero.alias("c"), F.when(F.col("a") == F.col("b"), n).otherwise(zero).alias("tp"), F.col("n").alias("all")),
        F.struct(F.col("b").alias("label"), zero.alias("r"), n.alias("c"), zero.alias("tp"), zero.alias("all")),
    )
    flat = counts.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.*")
    out = flat.groupBy(*keys, "label").agg(*[F.sum(x).alias(x) for x in ("r", "c", "tp", "all")])
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    out = out.withColumn("total", F.sum("all").over(whole)).drop("all")
    return out if labels is None else out.where(F.col("label").isin(labels))


def kappa_of(margins: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, kappa, n_items, n_categories, interpretation) from label_margins()."""
    n = F.first("total")
    po, pe = F.sum("tp") / n, F.sum(F.col("r").cast("double") * F.col("c")) / (n.cast("double") * n)
    out = margins.groupBy(*keys).agg(po.alias("po"), pe.alias("pe"), n.alias("n_items"), F.count("*").alias("n_categories"))
    raw = F.when(F.col("n_items").isNull() | (F.col("pe") >= 1), F.lit(0.0)).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    return out.select(*keys, F.round(raw, 4).alias("kappa"), "n_items", "n_categories", interpret_kappa(raw).alias("interpretation"))


def cohens_kappa(df: DataFrame, a: str, b: str, labels: list[str] | None = None) -> DataFrame:
    return kappa_of(label_margins(pair_counts(df, a, b), labels=labels))


def krippendorffs_alpha(long: DataFrame, item: str = "item_id", value: str = "label", form: str = "global") -> DataFrame:
    """Nominal alpha of (item, coder, label); null and blank labels are missing.

    (alpha, n_units, n_categories, interpretation). form="global" divides the disagreement of all units by one sum;
    form="standard" weighs each unit by 1 / (m - 1).
    """
    if form not in ("global", "standard"):
        raise ValueError(f"unknown form {form!r}")
    given = long.select(F.col(item).alias("item"), ustrip(F.col(value).cast("string")).alias("v")).where("v is not null and v != ''")
    cells = given.groupBy("item", "v").agg(F.count("*").alias("n")).withColumn("m", F.sum("n").over(Window.partitionBy("item")))
    two = F.col("m") > 1
    sums = cells.groupBy("v").agg(
        F.sum(F.when(two, F.col("n"))).alias("nc"),
        F.sum(F.when(two, F.col("n") * (F.col("m") - F.col("n")))).alias("off"),
        F.sum(F.when(two, F.col("n") * (F.col("m") - 1))).alias("pairs"),
        F.sum(F.when(two, F.col("n") * (F.col("m") - F.col("n")) / (F.col("m") - 1))).alias("weighted"),
        F.sum(F.when(two, F.col("n") / F.col("m"))).alias("units"),
    )
    total = F.sum("nc")
    out = sums.agg(
        total.alias("n"), F.sum("off").alias("off"), F.sum("pairs").alias("pairs"), F.sum("weighted").alias("weighted"),
        F.sum(F.col("nc").cast("double") * F.col("nc")).alias("squares"), F.count("*").alias("n_categories"), F.round(F.sum("units")).cast("long").alias("n_units"),
    )
    observed = F.col("off") / F.col("pairs") if form == "global" else F.col("weighted") / F.col("n")
    expected = (F.col("n").cast("double") * F.col("n") - F.col("squares")) / (F.col("n").cast("double") * (F.col("n") - 1))
    raw = F.when(F.col("n_categories") == 0, F.lit(0.0)).when((F.col("n_categories") == 1) | F.coalesce(expected == 0, F.lit(False)), F.lit(1.0)).when(F.col("n").isNull(), F.lit(0.0)).otherwise(1 - observed / expected)
    return out.select(F.round(raw, 4).alias("alpha"), F.coalesce("n_units", F.lit(0).cast("long")).alias("n_units"), "n_categories", interpret_alpha(raw).alias("interpretation"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two label sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def mean_jaccard(df: DataFrame, a: str, b: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, jaccard, n_items, interpretation) of two array columns."""
    out = df.groupBy(*keys).agg(F.avg(jaccard(F.col(a), F.col(b))).alias("raw"), F.count("*").alias("n_items"))
    raw = F.coalesce(F.col("raw"), F.lit(0.0))
    return out.select(*keys, F.round(raw, 4).alias("jaccard"), "n_items", interpret_jaccard(raw).alias("interpretation"))


def per_category(margins: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, category, observed, expected, specific) agreement."""
    n, p1, p2 = F.col("total"), F.col("r") / F.col("total"), F.col("c") / F.col("total")
    either = F.col("r") + F.col("c") - F.col("tp")
    return margins.select(
        *keys, F.col("label").alias("category"),
        F.round((n - F.col("r") - F.col("c") + 2 * F.col("tp")) / n, 4).alias("observed"),
        F.round(p1 * p2 + (1 - p1) * (1 - p2), 4).alias("expected"),
        F.round(F.when(either > 0, F.col("tp") / either).otherwise(0.0), 4).alias("specific"),
    )


def coder_pairs(long: DataFrame, item: str = "item_id") -> DataFrame:
    """(item, coder_a, label_a, coder_b, label_b) of (item, coder, label), each pair of coders once."""
    a = long.select(F.col(item).alias("item"), F.col("coder").alias("coder_a"), F.col("label").alias("label_a"))
    b = long.select(F.col(item).alias("item"), F.col("coder").alias("coder_b"), F.col("label").alias("label_b"))
    return a.join(b.toDF("item", "coder_b", "label_b"), "item").where("coder_a < coder_b")


def pairwise_kappa(long: DataFrame, item: str = "item_id") -> DataFrame:
    """(coder_a, coder_b, kappa, n_items, n_categories, interpretation) of all pairs of coders in one pass."""
    keys = ("coder_a", "coder_b")
    return kappa_of(label_margins(pair_counts(coder_pairs(long, item), "label_a", "label_b", keys), keys), keys)


def multilabel_kappa(df: DataFrame, item: str, a: str, b: str) -> DataFrame:
    """(theme, kappa, observed, specific) for each theme of two array columns, as yes or no by item."""
    both = df.select(F.col(a).alias("x"), F.col(b).alias("y"))
    total = both.agg(F.count("*").alias("total"))
    side = lambda c: F.transform(F.array_distinct(c), lambda t: t)
    themes = both.select(F.explode(F.array_union(side(F.col("x")), side(F.col("y")))).alias("theme"), "x", "y")
    hits = themes.groupBy("theme").agg(
        F.count_if(F.array_contains("x", F.col("theme"))).alias("r"), F.count_if(F.array_contains("y", F.col("theme"))).alias("c"),
        F.count_if(F.array_contains("x", F.col("theme")) & F.array_contains("y", F.col("theme"))).alias("tp"),
    ).join(F.broadcast(total), F.lit(True))
    n = F.col("total").cast("double")
    po = (n - F.col("r") - F.col("c") + 2 * F.col("tp")) / n
    pe = (F.col("r") * F.col("c") + (n - F.col("r")) * (n - F.col("c"))) / (n * n)
    return hits.select(
        "theme", F.round(F.when(pe >= 1, 0.0).otherwise((po - pe) / (1 - pe)), 4).alias("kappa"), F.round(po, 4).alias("observed"),
        F.round(F.col("tp") / (F.col("r") + F.col("c") - F.col("tp")), 4).alias("specific"),
    )


def evaluate(margins: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, label, precision, recall, f1, support, total, tp); a is the truth, b the prediction."""
    p = F.when(F.col("c") > 0, F.col("tp") / F.col("c")).otherwise(0.0)
    r = F.when(F.col("r") > 0, F.col("tp") / F.col("r")).otherwise(0.0)
    f = F.when(F.col("r") + F.col("c") > 0, 2 * F.col("tp") / (F.col("r") + F.col("c"))).otherwise(0.0)
    return margins.select(*keys, "label", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f, 4).alias("f1"), F.col("r").alias("support"), "total", "tp")


def evaluation_summary(classes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, accuracy, macro_f1, weighted_f1, n) from evaluate(); F1 means are of the rounded values."""
    weighted = F.sum(F.col("f1") * F.col("support")) / F.sum("support")
    return classes.groupBy(*keys).agg(
        F.round(F.sum("tp") / F.first("total"), 4).alias("accuracy"), F.round(F.avg("f1"), 4).alias("macro_f1"),
        F.round(F.coalesce(weighted, F.lit(0.0)), 4).alias("weighted_f1"), F.first("total").alias("n"),
    )


def confusion_wide(counts: DataFrame, labels: list[str]) -> DataFrame:
    """Rows ``true:x``, columns ``pred:x``, zero-filled; labels are the given ones, so nothing is collected."""
    cells = [F.coalesce(F.sum(F.when(F.col("b") == x, F.col("n"))), F.lit(0)).cast("long").alias(f"pred:{x}") for x in labels]
    spark = counts.sparkSession
    base = spark.createDataFrame([(x,) for x in labels], "a string")
    return base.join(counts, "a", "left").groupBy("a").agg(*cells).select(F.concat(F.lit("true:"), "a").alias("row"), *[f"`pred:{x}`" for x in labels])


def macro_f1_of_truth(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(macro_f1): over the labels of the truth alone, stripped and lower-cased, of unrounded F1."""
    low = df.select(F.lower(ustrip(F.col(truth).cast("string"))).alias("t"), F.lower(ustrip(F.col(predicted).cast("string"))).alias("p"))
    margins = label_margins(pair_counts(low, "t", "p")).where("r > 0")
    f = 2 * F.col("tp") / (F.col("r") + F.col("c"))
    return margins.agg(F.round(F.coalesce(F.avg(f), F.lit(0.0)), 4).alias("macro_f1"))
