"""Inputs of the registered queries, derived from the tables: coders, codings, replies, transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

THEMES = ("common", "question", "digits", "long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text, lang, n_chars, quality, toxic)."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "n_chars")
    return docs.join(table(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id")


def predicted(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, truth, predicted): quality against a rule of length."""
    return labelled(spark, d).select("doc_id", F.col("quality").cast("string").alias("truth"), F.when(F.col("n_chars") >= 500, "1").otherwise("0").alias("predicted"))


def coders_wide(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, a, b, c): quality, not toxic, and a rule of length that is missing for one language."""
    return labelled(spark, d).select(
        F.col("doc_id").alias("item_id"), F.col("quality").cast("string").alias("a"), (1 - F.col("toxic")).cast("string").alias("b"),
        F.when(F.col("lang") != "es", F.when(F.col("n_chars") >= 800, "1").otherwise("0")).alias("c"),
    )


def coders_long(spark: SparkSession, d: str) -> DataFrame:
    return coders_wide(spark, d).unpivot("item_id", ["a", "b", "c"], "coder", "label")


def theme_sets(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, x, y): theme sets of two coders over the documents."""
    t, n = F.col("text"), F.col("n_chars")
    sets = lambda tests: F.array_compact(F.array(*[F.when(test, name) for name, test in tests]))
    x = sets([("common", F.contains(t, F.lit(" the "))), ("question", F.contains(t, F.lit("?"))), ("digits", t.rlike("[0-9]")), ("long", n > 2000)])
    y = sets([("common", F.contains(t, F.lit(" of "))), ("question", F.contains(t, F.lit("!"))), ("digits", t.rlike("[0-9]{2}")), ("long", n > 1500)])
    return table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), x.alias("x"), y.alias("y"))


def codings(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, coder, theme, confidence): three coders; the third takes what the first two share, for even ids."""
    both = theme_sets(spark, d)
    confidence = lambda k: F.round((50 + (F.col("item_id") * k + F.length("theme") * 7) % 50) / 100.0, 2)
    parts = []
    for coder, k, themes in (("c1", 3, F.col("x")), ("c2", 7, F.col("y")), ("c3", 11, F.when(F.col("item_id") % 2 == 0, F.array_intersect("x", "y")))):
        parts.append(both.select("item_id", F.lit(coder).alias("coder"), F.explode(themes).alias("theme")).withColumn("confidence", confidence(k)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text")


def replies(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, truth, reply): replies of seven shapes with a label that is right for most."""
    base = labelled(spark, d)
    label = F.when(F.col("doc_id") % 5 == 0, "toxic").when(F.col("toxic") == 1, "toxic").otherwise("clean")
    shape = F.col("doc_id") % 7
    reply = (
        F.when(shape == 0, F.concat(F.lit('{"label": "'), label, F.lit('", "confidence": 0.9}')))
        .when(shape == 1, F.concat(F.lit('```json\n{"label": "'), label, F.lit('"}\n```')))
        .when(shape == 2, F.concat(F.lit('My answer: {"label": "'), label, F.lit('", "confidence": 0.5} as asked')))
        .when(shape == 3, F.upper(label))
        .when(shape == 4, F.concat(F.lit("I think it is "), label, F.lit(".")))
        .when(shape == 5, F.concat(F.lit('"'), label, F.lit('"')))
        .otherwise("no idea")
    )
    return base.select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("truth"), reply.alias("reply"))


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text): conversations as transcripts with a blank line between turns."""
    turns = table(spark, d, "conversations").where("text is not null")
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n")
    return turns.groupBy(F.col("conv_id").alias("doc_id")).agg(line.alias("text"))


def action_log(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, seq, action, value): reviews of documents, made from events (several of an item)."""
    action = F.element_at(F.array(F.lit("accepted"), F.lit("rejected"), F.lit("edited")), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, d, "events").select((F.col("user_id") % 500).alias("item_id"), F.col("event_id").alias("seq"), action.alias("action"), F.concat(F.lit("edit "), "event_id").alias("value"))


#: The same inputs as SQL, for DuckDB.
SQL = {
    "labelled": "SELECT d.doc_id, d.text, d.lang, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)",
    "predicted": "SELECT doc_id, quality::VARCHAR AS truth, CASE WHEN n_chars >= 500 THEN '1' ELSE '0' END AS predicted FROM labelled",
    "coders_wide": """SELECT doc_id AS item_id, quality::VARCHAR AS a, (1 - toxic)::VARCHAR AS b,
        CASE WHEN lang <> 'es' THEN CASE WHEN n_chars >= 800 THEN '1' ELSE '0' END END AS c FROM labelled""",
    "coders_long": "SELECT item_id, 'a' AS coder, a AS label FROM coders_wide UNION ALL SELECT item_id, 'b', b FROM coders_wide UNION ALL SELECT item_id, 'c', c FROM coders_wide",
    "theme_long": """SELECT item_id, coder, theme FROM (
        SELECT doc_id AS item_id, 'c1' AS coder, 'common' AS theme, contains(text, ' the ') AS yes FROM documents
        UNION ALL SELECT doc_id, 'c1', 'question', contains(text, '?') FROM documents
        UNION ALL SELECT doc_id, 'c1', 'digits', regexp_matches(text, '[0-9]') FROM documents
        UNION ALL SELECT doc_id, 'c1', 'long', n_chars > 2000 FROM documents
        UNION ALL SELECT doc_id, 'c2', 'common', contains(text, ' of ') FROM documents
        UNION ALL SELECT doc_id, 'c2', 'question', contains(text, '!') FROM documents
        UNION ALL SELECT doc_id, 'c2', 'digits', regexp_matches(text, '[0-9][0-9]') FROM documents
        UNION ALL SELECT doc_id, 'c2', 'long', n_chars > 1500 FROM documents) WHERE yes""",
    "codings": """SELECT item_id, coder, theme, round((50 + (item_id * (CASE coder WHEN 'c1' THEN 3 WHEN 'c2' THEN 7 ELSE 11 END) + length(theme) * 7)
      % 50) / 100.0, 2)::DOUBLE AS confidence
        FROM (SELECT * FROM theme_long UNION ALL SELECT a.item_id, 'c3', a.theme FROM theme_long a JOIN theme_long b
              ON a.item_id = b.item_id AND a.theme = b.theme AND a.coder = 'c1' AND b.coder = 'c2' WHERE a.item_id % 2 = 0)""",
    "votes": "SELECT item_id, theme, count(*) AS votes, avg(confidence) AS conf FROM codings GROUP BY ALL",
    "coded": "SELECT item_id, theme, votes, round(conf, 3) AS confidence FROM votes WHERE votes >= 2",
    "replies": """SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS truth, x AS label, CASE doc_id % 7
        WHEN 0 THEN '{"label": "' || x || '", "confidence": 0.9}'
        WHEN 1 THEN '```json' || chr(10) || '{"label": "' || x || '"}' || chr(10) || '```'
        WHEN 2 THEN 'My answer: {"label": "' || x || '", "confidence": 0.5} as asked'
        WHEN 3 THEN upper(x) WHEN 4 THEN 'I think it is ' || x || '.' WHEN 5 THEN '"' || x || '"' ELSE 'no idea' END AS reply
        FROM (SELECT *, CASE WHEN doc_id % 5 = 0 OR toxic = 1 THEN 'toxic' ELSE 'clean' END AS x FROM labelled)""",
    "turns": """SELECT conv_id AS doc_id, turn, text, row_number() OVER w AS k,
        coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS
      pos,
        coalesce(sum(length(text) - length(replace(text, chr(10), '')) + 2) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED
      PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lines
        FROM conversations WHERE text IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)""",
    "log": """SELECT user_id % 500 AS item_id, event_id AS seq, ['accepted', 'rejected', 'edited'][(event_id % 3 + 1)::INT] AS action, 'edit ' ||
      event_id AS value FROM events""",
    "last_log": "SELECT item_id, arg_max(action, seq) AS action, arg_max(value, seq) AS value FROM log GROUP BY item_id",
}
_NEEDS = {
    "predicted": ("labelled",), "coders_wide": ("labelled",), "coders_long": ("labelled", "coders_wide"), "codings": ("theme_long",),
    "votes": ("theme_long", "codings"), "coded": ("theme_long", "codings", "votes"), "replies": ("labelled",), "last_log": ("log",),
}


def named(name: str) -> str:
    """The clause of one input, for a WITH that goes on."""
    return f"{name} AS ({SQL[name]})"


def with_inputs(names: str, body: str) -> str:
    """body after the WITH clauses of the inputs it names."""
    wanted: list[str] = []
    for name in names.split():
        wanted += [x for x in (*_NEEDS.get(name, ()), name) if x not in wanted]
    first = ", ".join(f"{n} AS ({SQL[n]})" for n in wanted)
    body = body.strip()
    return f"WITH {first}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {first} {body}"
