"""Reliability reports: which measures a set of coders takes, and their averages.

Two coders of single labels: kappa, alpha and agreement by category. More: alpha over all, kappa of each pair and its
average. Two coders of label sets: mean Jaccard, kappa of each label and its average. More: Jaccard of each pair and its
average. Averages are of the rounded values. A table has a column for each coder; its rows are unfolded into pairs of
coders in place, so all pairs are counted in one pass and without a join.

Missing labels are the label ``nan`` for two coders and in pairs, and missing for the alpha of more than two.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ustrip
from . import agreement


def label_set(cell: Column) -> Column:
    """The distinct labels of a cell that lists them with commas; empty for null."""
    labels = F.transform(F.split(F.coalesce(cell.cast("string"), F.lit("")), ","), ustrip)
    return F.array_distinct(F.filter(labels, lambda x: x != ""))


def in_pairs(df: DataFrame, coders: list[str]) -> DataFrame:
    """(coder_a, coder_b, a, b): each row once for each pair of coders, in the order given."""
    pairs = [F.struct(F.lit(x).alias("coder_a"), F.lit(y).alias("coder_b"), F.col(x).alias("a"), F.col(y).alias("b")) for x, y in combinations(coders, 2)]
    return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def _rows(df: DataFrame, section: str, name: Column, value: str, told: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), name.alias("name"), F.col(value).cast("double").alias("value"), told.alias("interpretation"))


def _average(parts: DataFrame, section: str, value: str, told) -> DataFrame:
    mean = parts.agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean")).withColumn("value", F.round("mean", 4))
    return _rows(mean, section, F.lit(None).cast("string"), "value", told(F.col("mean")))


def report(df: DataFrame, coders: list[str], mode: str = "single") -> DataFrame:
    """(section, name, value, interpretation). mode: single, a label in each cell; multi, labels with commas or arrays."""
    if len(coders) < 2:
        raise ValueError("reliability takes two coders")
    if mode not in ("single", "multi"):
        raise ValueError(f"unknown mode {mode!r}")
    return (_single if mode == "single" else _multi)(df, coders)


def _single(df: DataFrame, coders: list[str]) -> DataFrame:
    none = F.lit(None).cast("string")
    if len(coders) == 2:
        a, b = coders
        margins = agreement.label_margins(agreement.pair_counts(df, a, b))
        named = df.select(F.monotonically_increasing_id().alias("item_id"), *[F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in coders])
        out = _rows(agreement.kappa_of(margins), "kappa", none, "kappa", F.col("interpretation"))
        alpha = agreement.krippendorffs_alpha(named.unpivot("item_id", coders, "coder", "label"))
        out = out.unionByName(_rows(alpha, "alpha", none, "alpha", F.col("interpretation")))
        by_category = agreement.per_category(margins)
        for measure in ("observed", "expected", "specific"):
            out = out.unionByName(_rows(by_category, measure, F.col("category"), measure, none))
        return out
    long = df.select(F.monotonically_increasing_id().alias("item_id"), *[F.col(c).cast("string").alias(c) for c in coders]).unpivot("item_id", coders, "coder", "label")
    out = _rows(agreement.krippendorffs_alpha(long), "alpha", none, "alpha", F.col("interpretation"))
    keys = ("coder_a", "coder_b")
    kappas = agreement.kappa_of(agreement.label_margins(agreement.pair_counts(in_pairs(df, coders), "a", "b", keys), keys), keys)
    out = out.unionByName(_rows(kappas, "pair", F.concat_ws(" vs ", *keys), "kappa", F.col("interpretation")))
    return out.unionByName(_average(kappas, "average", "kappa", agreement.interpret_kappa))


def _multi(df: DataFrame, coders: list[str]) -> DataFrame:
    sets = df.select(*[(F.array_distinct(F.coalesce(F.col(c), F.array())) if dict(df.dtypes)[c].startswith("array") else label_set(F.col(c))).alias(c) for c in coders])
    keys = ("coder_a", "coder_b")
    if len(coders) == 2:
        total = agreement.mean_jaccard(sets, *coders)
        out = _rows(total, "jaccard", F.lit(None).cast("string"), "jaccard", F.col("interpretation"))
        themes = agreement.multilabel_kappa(sets.withColumn("item_id", F.lit(0)), "item_id", *coders)
        for section, measure in (("kappa", "kappa"), ("observed", "observed"), ("specific", "specific")):
            told = agreement.interpret_kappa(F.col("kappa")) if section == "kappa" else F.lit(None).cast("string")
            out = out.unionByName(_rows(themes, section, F.col("theme"), measure, told))
        return out.unionByName(_average(themes, "average", "kappa", agreement.interpret_kappa))
    pairs = agreement.mean_jaccard(in_pairs(sets, coders), "a", "b", keys)
    out = _rows(pairs, "pair", F.concat_ws(" vs ", *keys), "jaccard", F.col("interpretation"))
    return out.unionByName(_average(pairs, "average", "jaccard", agreement.interpret_jaccard))
