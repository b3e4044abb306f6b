"""Small documents that hold the awkward cases."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, extra=False):
    rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:  # columns whose names the operators use inside
        for name in ("id", "digest", "n", "component_id", "line", "score", "template", "piece", "h"):
            df = df.selectExpr("*", f"'{name}' AS {name}")
    return df


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())
