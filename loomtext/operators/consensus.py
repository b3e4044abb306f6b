"""Consensus of several coders, triage by confidence, and exports of coded items.

Codings are long tables (item_id, coder, theme, confidence); items are a table of ids, so that items without a vote
stay. Votes are aggregated map-side by item and theme.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tiers of the smallest confidence.
HIGH, MEDIUM = 0.85, 0.60


def default_threshold(n_coders: int, threshold: int | None = None) -> int:
    """Half of the coders, rounded up (so one of two); 0 counts as unset."""
    return threshold or ceil(n_coders / 2)


def votes(codings: DataFrame, compat: bool = False) -> DataFrame:
    """(item_id, theme, votes, confidence): a coder votes once for a theme, unless compat counts repeats."""
    given = codings.where("theme is not null")
    if not compat:
        given = given.groupBy("item_id", "coder", "theme").agg(F.avg("confidence").alias("confidence"))
    return given.groupBy("item_id", "theme").agg(F.count("*").alias("votes"), F.avg(F.coalesce("confidence", F.lit(0.5))).alias("confidence"))


def majority_vote(codings: DataFrame, n_coders: int, threshold: int | None = None, compat: bool = False) -> DataFrame:
    """(item_id, theme, votes, confidence): the themes that enough coders chose; confidence to three places."""
    kept = votes(codings, compat).where(F.col("votes") >= default_threshold(n_coders, threshold))
    return kept.withColumn("confidence", F.round("confidence", 3))


def agreement_by_item(items: DataFrame, codings: DataFrame, n_coders: int, compat: bool = False) -> DataFrame:
    """(item_id, agreement, n_themes): mean share of coders over the themes anyone chose; 1 if nobody chose any."""
    share = votes(codings, compat).groupBy("item_id").agg(F.avg(F.col("votes") / n_coders).alias("a"), F.count("*").alias("n_themes"))
    out = items.select("item_id").join(share, "item_id", "left")
    return out.select("item_id", F.coalesce("a", F.lit(1.0)).alias("agreement"), F.coalesce("n_themes", F.lit(0).cast("long")).alias("n_themes"))


def consensus_summary(items: DataFrame, codings: DataFrame, n_coders: int, threshold: int | None = None) -> DataFrame:
    """(n_items, agreement, n_unanimous, n_uncoded, n_consensus_themes) of a consensus run."""
    by_item = agreement_by_item(items, codings, n_coders)
    kept = majority_vote(codings, n_coders, threshold).agg(F.count("*").alias("n_consensus_themes"))
    out = by_item.agg(F.count("*").alias("n_items"), F.round(F.avg("agreement"), 4).alias("agreement"), F.count_if(F.col("agreement") == 1).alias("n_unanimous"), F.count_if(F.col("n_themes") == 0).alias("n_uncoded"))
    return out.join(F.broadcast(kept), F.lit(True))


def merge_details(codings: DataFrame) -> DataFrame:
    """(item_id, theme, triggers, reasoning): union of the voters' trigger words, their reasons joined by a bar."""
    reasons = F.transform(F.array_sort(F.collect_list(F.when(F.col("reasoning") != "", F.struct("coder", "reasoning")))), lambda x: x["reasoning"])
    return codings.groupBy("item_id", "theme").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("triggers")))).alias("triggers"), F.array_join(reasons, " | ").alias("reasoning"))


def tier(least_confidence: Column) -> Column:
    return F.when(least_confidence >= HIGH, "high").when(least_confidence >= MEDIUM, "medium").otherwise("low")


def triage(items: DataFrame, coded: DataFrame) -> DataFrame:
    """(item_id, least, tier) by the smallest confidence of an item's themes; low without themes."""
    least = coded.groupBy("item_id").agg(F.min("confidence").alias("least"))
    return items.select("item_id").join(least, "item_id", "left").withColumn("tier", tier(F.col("least")))


def triage_summary(triaged: DataFrame) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy())
    return triaged.groupBy("tier").agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / total, 4))


def excerpts(items: DataFrame, coded: DataFrame, actions: DataFrame | None = None, source: str = "") -> DataFrame:
    """(item_id, theme, text, confidence, status, source): a row for each theme of an item; and, where coded has triggers
    and reasoning, those too, the triggers joined by commas."""
    more = [c for c in ("triggers", "reasoning") if c in coded.columns]
    out = items.select("item_id", "text").join(coded.select("item_id", "theme", "confidence", *more), "item_id")
    status = F.lit("unreviewed")
    if actions is not None:
        out = out.join(actions.select("item_id", "status"), "item_id", "left")
        status = F.coalesce("status", status)
    told = {"triggers": lambda: F.array_join(F.coalesce("triggers", F.array().cast("array<string>")), ", "), "reasoning": lambda: F.coalesce("reasoning", F.lit(""))}
    own = [F.coalesce("confidence", F.lit(0.0)).alias("confidence"), status.alias("status"), F.lit(source).alias("source")]
    return out.select("item_id", "theme", "text", *own, *[told[c]().alias(c) for c in more])


def cooccurrence(coded: DataFrame, themes: DataFrame) -> DataFrame:
    """(theme_a, theme_b, n) for all pairs of the codebook, 0 included; the diagonal counts the theme's items.

    An item's themes are gathered first (bounded by the codebook) and paired inside the row, so nothing is joined."""
    sets = coded.join(F.broadcast(themes.select("theme")), "theme", "left_semi").groupBy("item_id").agg(F.collect_set("theme").alias("t"))
    pairs = sets.select(F.explode("t").alias("theme_a"), "t").select("theme_a", F.explode("t").alias("theme_b")).groupBy("theme_a", "theme_b").agg(F.count("*").alias("n"))
    book = themes.select(F.col("theme").alias("theme_a"))
    grid = book.join(F.broadcast(themes.select(F.col("theme").alias("theme_b"))), F.lit(True))
    return grid.join(F.broadcast(pairs), ["theme_a", "theme_b"], "left").select("theme_a", "theme_b", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def cooccurrence_wide(coded: DataFrame, themes: list[str]) -> DataFrame:
    spark = coded.sparkSession
    long = cooccurrence(coded, spark.createDataFrame([(t,) for t in themes], "theme string"))
    return long.groupBy("theme_a").pivot("theme_b", themes).agg(F.first("n"))


def memo(items: DataFrame, coded: DataFrame, quotes: int = 3, most: int = 200) -> DataFrame:
    """(theme, n, percent, quotes): items of each theme, their share and the first quotes by item, cut at most."""
    total = items.agg(F.count("*").alias("total"))
    rows = coded.select("item_id", "theme").distinct().join(items.select("item_id", "text"), "item_id")
    quote = F.when(F.length("text") > most, F.concat(F.substring("text", 1, most), F.lit("..."))).otherwise(F.col("text"))
    rank = F.row_number().over(Window.partitionBy("theme").orderBy("item_id"))
    first = rows.withColumn("k", rank).where(F.col("k") <= quotes).groupBy("theme").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", quote.alias("q")))), lambda x: x["q"]).alias("quotes"))
    counts = rows.groupBy("theme").agg(F.count("*").alias("n"))
    out = counts.join(first, "theme").join(F.broadcast(total), F.lit(True))
    return out.select("theme", "n", F.round(100 * F.col("n") / F.col("total"), 1).alias("percent"), "quotes")


def memo_lines(items: DataFrame, coded: DataFrame, themes: DataFrame) -> DataFrame:
    """(part, k, line): a Markdown memo: a head, then a section for each theme of the codebook (place, theme,
    description), also for those that no item has, with its definition, frequency, first quotes and room for notes."""
    found = memo(items, coded.join(F.broadcast(themes.select("theme")), "theme", "left_semi"))
    sizes = items.agg(F.count("*").alias("n")).join(themes.agg(F.count("*").alias("k")), F.lit(True))
    head = [F.lit("# Memo"), F.lit(""), F.concat(F.lit("Texts: "), F.col("n")), F.concat(F.lit("Themes: "), F.col("k")), F.lit("")]
    rows = themes.join(found, "theme", "left")
    quotes = F.flatten(F.transform(F.coalesce("quotes", F.array().cast("array<string>")), lambda q: F.array(F.concat(F.lit("> "), F.regexp_replace(q, "\n", "\n> ")), F.lit(""))))
    times = F.concat(F.lit("Frequency: "), F.coalesce("n", F.lit(0)), F.lit(" texts ("), F.coalesce("percent", F.lit(0.0)), F.lit("%)"))
    body = F.concat(
        F.array(F.concat(F.lit("## "), "theme"), F.lit(""), F.concat(F.lit("Definition: "), F.coalesce("description", F.lit(""))), F.lit(""), times, F.lit("")),
        quotes, F.array(F.lit("Notes:"), F.lit("")),
    )
    out = sizes.select(F.lit(-1).cast("long").alias("part"), F.posexplode(F.array(*head)).alias("k", "line"))
    return out.unionByName(rows.select(F.col("place").cast("long").alias("part"), F.posexplode(body).alias("k", "line")))


def evidence_context(df: DataFrame, text: str, evidence: str, around: int = 300) -> DataFrame:
    """df with found_at (from 0; -1 if absent), before, hit, after: the first hit without regard to case."""
    at = F.when(F.length(evidence) > 0, F.expr(f"locate(lower(`{evidence}`), lower(`{text}`))")).otherwise(0)
    t, n = F.col(text), F.length(evidence)
    out = df.withColumn("found_at", (at - 1).cast("int"))
    inside = F.col("found_at") >= 0
    start = F.greatest(F.lit(0), F.col("found_at") - around)
    return out.withColumns(
        {
            "before": F.when(inside, F.substring(t, start + 1, F.col("found_at") - start)),
            "hit": F.when(inside, F.substring(t, F.col("found_at") + 1, n)),
            "after": F.when(inside, F.substring(t, F.col("found_at") + n + 1, F.lit(around))),
        }
    )


def question_distribution(questions: DataFrame, extractions: DataFrame) -> DataFrame:
    """(rq_id, matches, segments) with 0 for questions without a match."""
    counts = extractions.groupBy("rq_id").agg(F.count("*").alias("matches"), F.countDistinct("segment_id").alias("segments"))
    zero = F.lit(0).cast("long")
    return questions.select("rq_id").join(counts, "rq_id", "left").select("rq_id", F.coalesce("matches", zero).alias("matches"), F.coalesce("segments", zero).alias("segments"))


def confidence_histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, n) over [0, 1]; the last bin holds 1."""
    b = F.least(F.floor(F.col(column) * bins), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def confidence_summary(df: DataFrame, column: str) -> DataFrame:
    """(n, median, mean) of the confidences there are, to four places."""
    return df.agg(F.count(column).alias("n"), F.round(F.median(column), 4).alias("median"), F.round(F.avg(column), 4).alias("mean"))


def normalised_confusion(counts: DataFrame) -> DataFrame:
    """(a, b, share): share of the row's total."""
    return counts.select("a", "b", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("a")), 4).alias("share"))
