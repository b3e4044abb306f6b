"""Validation, diagnostics and features of text tables, each from as few aggregations as they allow."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, n_tokens, ustrip
from . import language

#: Column names that stand for a role, and patterns of personal data in the quick check.
TEXT_HINTS = {"text", "content", "body", "message", "sentence", "comment", "review", "post"}
LABEL_HINTS = {"label", "labels", "class", "category", "tag", "sentiment", "target"}
SPEAKER_HINTS = {"speaker", "speaker_id", "respondent", "participant", "interviewee"}
TIME_HINTS = {"date", "timestamp", "created_at", "time"}
EMAIL_QUICK = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
PHONE_QUICK = r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"


def guess_column(df: DataFrame, hints: set[str]) -> str | None:
    """The first column whose stripped, lower-cased name is among the hints."""
    return next((c for c in df.columns if c.strip().lower() in hints), None)


def validate(
    df: DataFrame, text_col: str | None = None, label_col: str | None = None, mode: str = "quantitative", speaker_col: str | None = None,
    languages: language.Model | None = None,
) -> DataFrame:
    """(severity, field, check, value): the issues of a table; none for a sound one. mode: quantitative, qualitative. With
    a model of languages, a main language other than English is an issue (not_english, its share)."""
    if mode not in ("quantitative", "qualitative"):
        raise ValueError(f"unknown mode {mode!r}")
    text_col, label_col = text_col or guess_column(df, TEXT_HINTS), label_col or guess_column(df, LABEL_HINTS)
    spark = df.sparkSession
    fixed: list[tuple] = []
    parts: list[DataFrame] = []
    if text_col is None:
        fixed.append(("error", "columns", "no_text_column", None))
    else:
        text = F.col(text_col).cast("string")
        full = ~is_blank(text)
        words = F.when(full, n_tokens(text))
        checks = [
            ("warning", "empty_rows", F.count_if(~full).cast("double"), lambda v: v > 0),
            ("warning", "short_texts", F.percentile(words, 0.5), lambda v: v < 10),
            ("info", "long_texts", F.count_if(words > 512).cast("double"), lambda v: v > 0),
        ]
        if mode == "qualitative":
            checks.append(("warning", "emails", F.count_if(text.rlike(EMAIL_QUICK)).cast("double"), lambda v: v > 0))
            checks.append(("warning", "phones", F.count_if(text.rlike(PHONE_QUICK)).cast("double"), lambda v: v > 0))
        row = df.agg(*[x.alias(name) for _, name, x, _ in checks])
        issues = F.array(*[F.when(wrong(F.col(name)), F.struct(F.lit(sev).alias("severity"), F.lit(text_col).alias("field"), F.lit(name).alias("check"), F.col(name).alias("value"))) for sev, name, _, wrong in checks])
        parts.append(row.select(F.explode(F.array_compact(issues)).alias("i")).select("i.*"))
        if languages is not None:
            main = language.main_language(df, languages, text_col).where("language <> 'en'")
            parts.append(main.select(F.lit("info").alias("severity"), F.lit(text_col).alias("field"), F.lit("not_english").alias("check"), F.col("share").alias("value")))
    if mode == "quantitative":
        if label_col is None:
            fixed.append(("info", "columns", "no_label_column", None))
        else:
            ratio = imbalance(df, label_col).where("n_classes >= 2 and ratio > 5")
            parts.append(ratio.select(F.lit("warning").alias("severity"), F.lit(label_col).alias("field"), F.lit("imbalance").alias("check"), F.col("ratio").alias("value")))
    elif speaker_col is None and guess_column(df, SPEAKER_HINTS) is None:
        fixed.append(("warning", "columns", "no_speaker_column", None))
    out = spark.createDataFrame(fixed, "severity string, field string, check string, value double")
    for part in parts:
        out = out.unionByName(part)
    return out


def imbalance(df: DataFrame, label_col: str) -> DataFrame:
    """(n_classes, ratio): of the largest to the smallest class; null labels don't count."""
    counts = df.where(F.col(label_col).isNotNull()).groupBy(label_col).agg(F.count("*").alias("n"))
    return counts.agg(F.count("*").alias("n_classes"), (F.max("n") / F.min("n")).alias("ratio"))


def drop_empty(df: DataFrame, text_col: str) -> DataFrame:
    return df.where(~is_blank(F.col(text_col).cast("string")))


def unlabeled(label: Column) -> Column:
    """Null, blank, or the text of a missing value."""
    return F.coalesce(ustrip(label.cast("string")).isin("", "nan", "None"), F.lit(True))


def token_stats(df: DataFrame, text_col: str) -> DataFrame:
    """min, max, mean, median and the 25th, 75th and 95th percentile of tokens in rows with text, to one place."""
    n = n_tokens(F.col(text_col))
    rows = drop_empty(df, text_col).select(n.alias("n"))
    q = F.percentile("n", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.95)]))
    out = rows.agg(F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.round(F.avg("n"), 1).alias("n_mean"), q.alias("q"))
    return out.select("n_min", "n_max", "n_mean", *[F.round(F.col("q")[k], 1).alias(name) for k, name in enumerate(("p25", "median", "p75", "p95"))])


def distribution(df: DataFrame, column: str, name: str = "label") -> DataFrame:
    """(name, n, share): share of the rows that aren't null, to four places."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias(name)).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total), F.lit(True)).select(name, "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))


def digest(columns: list[str]) -> Column:
    """16 bytes of a row, for telling rows apart before they are compared."""
    return F.struct(F.xxhash64(*columns), F.xxhash64(F.lit(len(columns)), *columns))


def kinds(df: DataFrame, columns: list[str], key: Column | None = None) -> DataFrame:
    """(n_rows, n_kinds) of the rows' values in columns. Digests are counted first; only rows whose digest repeats are
    compared as a whole, so texts that occur once are not shuffled. key: another digest."""
    rows = df.select(*columns).withColumn("__key", digest(columns) if key is None else key)
    counts = rows.groupBy("__key").agg(F.count("*").alias("n"))
    once = counts.where("n = 1").agg(F.count("*").alias("n_rows"), F.count("*").alias("n_kinds"))
    again = rows.join(counts.where("n > 1").select("__key"), "__key", "left_semi")
    several = again.groupBy("__key", *columns).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_kinds"))
    return once.unionByName(several).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("n_kinds"), F.lit(0)).alias("n_kinds"))


def duplicates(df: DataFrame, columns: list[str] | None = None, key: Column | None = None) -> DataFrame:
    """(n_rows, n_duplicates, rate): rows beyond the first of their kind, over all columns."""
    n, extra = F.col("n_rows"), F.col("n_rows") - F.col("n_kinds")
    return kinds(df, columns or df.columns, key).select("n_rows", extra.alias("n_duplicates"), F.round(F.coalesce(F.try_divide(extra, n), F.lit(0.0)), 4).alias("rate"))


def time_span(df: DataFrame, time_col: str) -> DataFrame:
    """(n_valid, days, warning): whether more than 10 readable times span a day or a week at most."""
    t = F.try_to_timestamp(F.col(time_col).cast("string"))
    out = df.select(t.alias("t")).agg(F.count("t").alias("n_valid"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    days = F.floor((F.unix_micros("hi") - F.unix_micros("lo")) / 86_400_000_000)
    out = out.select("n_valid", days.cast("long").alias("days"))
    warning = F.when(F.col("n_valid") <= 10, None).when(F.col("days") <= 1, "one_day").when(F.col("days") <= 7, "one_week")
    return out.withColumn("warning", warning)


def text_uniqueness(df: DataFrame, text_col: str) -> DataFrame:
    """(n_texts, n_unique, rate, warning): warns below 0.8."""
    out = kinds(df.where(F.col(text_col).isNotNull()), [text_col]).withColumnsRenamed({"n_rows": "n_texts", "n_kinds": "n_unique"})
    rate = F.try_divide(F.col("n_unique"), F.col("n_texts"))
    return out.select("n_texts", "n_unique", F.round(F.coalesce(rate, F.lit(1.0)), 4).alias("rate"), F.coalesce(rate < 0.8, F.lit(False)).alias("warning"))


def majority(df: DataFrame, column: str) -> DataFrame:
    """(value, share, mixed): the most frequent value, ties to the smaller; mixed if its share is below 0.9."""
    out = distribution(df, column, "value").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("value"), F.max("n").alias("n"), F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    return out.select("value", F.round(share, 4).alias("share"), (share < 0.9).alias("mixed"))


def diagnostics(df: DataFrame, text_col: str, label_col: str | None = None) -> DataFrame:
    """(metric, value): the counts of a diagnostics report."""
    text = F.col(text_col).cast("string")
    base = df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"), F.count_if(is_blank(text)).alias("empty_texts"), *([F.countDistinct(label_col).alias("classes")] if label_col else []))
    both = base.join(text_uniqueness(df, text_col).select(F.col("n_unique").alias("unique_texts")), F.lit(True))
    both = both.join(duplicates(df).select("n_duplicates"), F.lit(True))
    return both.unpivot([], both.columns, "metric", "value")


def diagnostics_report(df: DataFrame, text_col: str, label_col: str | None = None, languages: language.Model | None = None) -> DataFrame:
    """(section, name, value): rows, columns, empty texts and duplicates; token statistics; languages; labels with their
    shares; warnings of bias, whose value is what they are about: days between the first and the last time of a column, or
    the share of distinct texts."""
    text = F.col(text_col).cast("string")

    def stacked(rows: DataFrame, section: str) -> DataFrame:
        rows = rows.select(*[F.col(c).cast("double") for c in rows.columns])
        return rows.unpivot([], rows.columns, "name", "value").select(F.lit(section).alias("section"), "name", "value")

    base = df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"), F.count_if(is_blank(text)).alias("empty_texts"))
    repeated = duplicates(df).select(F.col("n_duplicates").alias("duplicate_rows"), F.col("rate").alias("duplicate_rate"))
    parts = [stacked(base, "table"), stacked(repeated, "table"), stacked(token_stats(df, text_col), "tokens")]
    if languages is not None:
        found = language.distribution(df, languages, text_col)
        parts.append(found.select(F.lit("language").alias("section"), F.col("language").alias("name"), F.col("n").cast("double").alias("value")))
    if label_col:
        for what in ("n", "share"):
            found = distribution(df, label_col)
            parts.append(found.select(F.lit("label" if what == "n" else "label_share").alias("section"), F.col("label").alias("name"), F.col(what).cast("double").alias("value")))
    for c in df.columns:
        if c.strip().lower() in TIME_HINTS:
            found = time_span(df, c).where("warning is not null")
            parts.append(found.select(F.lit("bias").alias("section"), F.concat(F.lit(f"{c}:"), "warning").alias("name"), F.col("days").cast("double").alias("value")))
    found = text_uniqueness(df, text_col).where("warning")
    parts.append(found.select(F.lit("bias").alias("section"), F.lit("repeated_texts").alias("name"), F.col("rate").alias("value")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: What a user may state about a task, with what stands for anything else.
STATED = {
    "task_type": (("sentiment", "framing", "moral", "topic", "stance", "custom"), "custom"),
    "budget_level": (("low", "medium", "high"), "medium"),
}
STATED_AS_IS = ("domain_specificity", "class_boundary_clarity", "downstream_use")


def stated_features(stated: dict) -> dict[str, Column]:
    """Columns of what a user states: unknown types and levels become the general ones; numbers must be readable."""
    kind, level = (stated[k] if stated.get(k) in STATED[k][0] else STATED[k][1] for k in ("task_type", "budget_level"))
    out = {"task_type": F.lit(kind), "budget_level": F.lit(level), "target_f1": F.lit(float(stated.get("target_f1", 0.8)))}
    agreement = stated.get("annotation_agreement")
    out["annotation_agreement"] = F.lit(None if agreement is None else float(agreement)).cast("double")
    return out | {k: F.lit(stated.get(k)).cast("string") for k in STATED_AS_IS}


def features(
    df: DataFrame, text_col: str, label_col: str, lang_col: str | None = None, languages: language.Model | None = None, stated: dict | None = None
) -> DataFrame:
    """(n_samples, n_labeled, n_classes, balance, mean_tokens) of a task; with a model of languages also its language and
    whether it is multilingual; with what a user states, the columns of stated_features() too. A stated number of classes
    counts where no row has a label."""
    labeled = ~unlabeled(F.col(label_col))
    base = df.agg(F.count("*").alias("n_samples"), F.count_if(labeled).alias("n_labeled"), F.floor(F.avg(F.when(~is_blank(F.col(text_col)), n_tokens(F.col(text_col))))).cast("long").alias("mean_tokens"))
    classes = imbalance(df.where(labeled), label_col).select("n_classes", F.round(F.coalesce("ratio", F.lit(0.0)), 2).alias("balance"))
    out = base.join(F.broadcast(classes), F.lit(True))
    if languages is not None:
        main = language.main_language(df, languages, text_col).select("language", "multilingual")
        out = out.join(F.broadcast(main), F.lit(True))
    if stated is None:
        return out
    n = F.when((F.col("n_classes") == 0) & F.lit("n_classes" in stated), F.lit(int(stated.get("n_classes", 0))).cast("long"))
    return out.withColumn("n_classes", F.coalesce(n, "n_classes")).withColumns(stated_features(stated))


def detect_languages(df: DataFrame, text_col: str, detector, id_col: str, sample: int = 100, seed: int = 42) -> DataFrame:
    """(value, n, share) of what detector, a Python function of a text, says about a sample of rows: those of smallest
    hash. A report on a sample by definition; corpora that carry a language column use distribution()."""
    rows = drop_empty(df, text_col).orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(sample)

    @F.pandas_udf("string")
    def detect(texts: pd.Series) -> pd.Series:
        return texts.map(detector)

    return distribution(rows.select(detect(text_col).alias("value")), "value", "value")


def report_text(rows: list) -> str:
    """A diagnostics report as lines of text, from collected (metric, value) rows."""
    width = max((len(r["metric"]) for r in rows), default=0)
    return "\n".join(f"{r['metric'].replace('_', ' '):<{width}}  {r['value']:,}" for r in sorted(rows, key=lambda r: r["metric"]))


def confirm_columns(df: DataFrame, text_col: str, label_col: str | None = None) -> DataFrame:
    """(check, value): fewer than two distinct texts or labels, and labels out of balance."""
    base = df.agg(F.countDistinct(text_col).alias("texts"), F.countDistinct(label_col if label_col else F.lit(None)).alias("labels"))
    issues = [F.when(F.col("texts") < 2, F.struct(F.lit("one_text").alias("check"), F.col("texts").cast("double").alias("value")))]
    if label_col:
        issues.append(F.when(F.col("labels") < 2, F.struct(F.lit("one_label").alias("check"), F.col("labels").cast("double").alias("value"))))
    out = base.select(F.explode(F.array_compact(F.array(*issues))).alias("i")).select("i.*")
    if label_col:
        ratio = imbalance(df, label_col).where("n_classes >= 2 and ratio > 5").select(F.lit("imbalance").alias("check"), F.col("ratio").alias("value"))
        out = out.unionByName(ratio)
    return out
