"""All registered queries by name, and the SQL that DuckDB runs beside them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, n_tokens
from ..operators import advise, agreement, completion, consensus, entities, extraction_review, language, methods, pii, profile, prompting, reliability, review, runs, segment, tfidf, themes, training
from ..session import materialised, shared_dir
from ..sources import archive, io
from ..streaming import annotation_stream, review_stream
from . import inputs
from .inputs import table, with_inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, needs: str = "") -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = with_inputs(needs, sql) if needs else sql
        return f

    return add


def _scratch(spark: SparkSession) -> str:
    """A folder of its own in the shared folder, for round trips."""
    import uuid

    return f"{shared_dir(spark)}/roundtrip-{uuid.uuid4().hex}"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


# sources and sinks: written and read again

def _nation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long"), "n_name", F.col("n_regionkey").cast("long"))


def _typed(df: DataFrame) -> DataFrame:
    return df.select(F.col("n_nationkey").cast("long"), "n_name", F.col("n_regionkey").cast("long"))


NATION = "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation"


@query("a2_b1_csv", NATION)
def a2_b1_csv(spark, d):
    io.save_csv(_nation(spark, d), path := _scratch(spark) + ".csv", single=True)
    return _typed(io.load(spark, path))


@query("a4_json", NATION)
def a4_json(spark, d):
    rows = _nation(spark, d).agg(F.to_json(F.struct(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey")).alias("data"))).alias("value"))
    rows.write.text(path := _scratch(spark) + ".json")
    return _typed(io.load(spark, path))


@query("a5_jsonl", NATION)
def a5_jsonl(spark, d):
    _nation(spark, d).write.json(path := _scratch(spark) + ".jsonl")
    return _typed(io.load(spark, path))


@query("a6_b4_text", "SELECT n_name AS text FROM nation")
def a6_b4_text(spark, d):
    io.save_lines(_nation(spark, d), "n_name", path := _scratch(spark) + ".txt")
    return io.load(spark, path)


@query("a7_document", "SELECT sum(length(n_name) + 1)::INT AS n_chars, (count(*) + 1)::INT AS n_lines FROM nation")
def a7_document(spark, d):
    io.save_lines(_nation(spark, d), "n_name", path := _scratch(spark) + ".txt")
    return io.load_document(spark, path + "/*.txt").select("n_chars", "n_lines")


@query("a10_parquet", NATION)
def a10_parquet(spark, d):
    return _typed(io.load(spark, f"{d}/nation.parquet"))


@query("b5_finetune", """SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, sum(length(text))::BIGINT AS chars FROM labelled""", "labelled")
def b5_finetune(spark, d):
    lines = io.finetune_lines(inputs.labelled(spark, d), "doc_id", "text", "quality", ["0", "1"], "Rate the text.")
    said = F.from_json("line", "messages array<struct<role:string,content:string>>")["messages"]
    return lines.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.sum(F.length(said[1]["content"])).alias("chars"))


@query("b7_project", NATION)
def b7_project(spark, d):
    io.save_project(spark, {"nation": _nation(spark, d)}, {"step": 3}, path := _scratch(spark))
    tables, _, _ = io.load_project(spark, path)
    return tables["nation"]


# validation and diagnostics

TOKENS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))"


@query("c2_empty", f"SELECT count(*) FILTER (text IS NULL OR trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '') AS n_empty, count(*) AS n_rows FROM documents")
def c2_empty(spark, d):
    return _docs(spark, d).agg(F.count_if(is_blank(F.col("text"))).alias("n_empty"), F.count("*").alias("n_rows"))


@query(
    "c3_validate",
    f"""WITH t AS (SELECT {TOKENS} AS n, text FROM documents),
    s AS (SELECT count(*) FILTER (n = 0) AS e, median(n) FILTER (n > 0) AS m, count(*) FILTER (n > 512) AS l FROM t),
    c AS (SELECT max(n) / min(n) AS r, count(*) AS k FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1))
    SELECT 'warning' AS severity, 'text' AS field, 'empty_rows' AS "check", e::DOUBLE AS value FROM s WHERE e > 0
    UNION ALL SELECT 'warning', 'text', 'short_texts', m FROM s WHERE m < 10
    UNION ALL SELECT 'info', 'text', 'long_texts', l::DOUBLE FROM s WHERE l > 0
    UNION ALL SELECT 'warning', 'lang', 'imbalance', r FROM c WHERE k >= 2 AND r > 5""",
)
def c3_validate(spark, d):
    return profile.validate(_docs(spark, d), label_col="lang")


@query("c4_imbalance", "SELECT count(*) AS n_classes, max(n) / min(n) AS ratio FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)")
def c4_imbalance(spark, d):
    return profile.imbalance(_docs(spark, d), "lang")


@query("c5_qualitative", r"""WITH s AS (SELECT count(*) FILTER (regexp_matches(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+')) AS e,
    count(*) FILTER (regexp_matches(text, '\b\d{3}[-.]?\d{3}[-.]?\d{4}\b')) AS p FROM documents)
    SELECT 'warning' AS severity, 'text' AS field, 'emails' AS "check", e::DOUBLE AS value FROM s WHERE e > 0
    UNION ALL SELECT 'warning', 'text', 'phones', p::DOUBLE FROM s WHERE p > 0
    UNION ALL SELECT 'warning', 'columns', 'no_speaker_column', NULL""")
def c5_qualitative(spark, d):
    return profile.validate(_docs(spark, d), mode="qualitative").where(F.col("check").isin("emails", "phones", "no_speaker_column"))


@query("c6_auto_fix", "SELECT doc_id FROM documents WHERE trim(coalesce(text, '')) <> ''")
def c6_auto_fix(spark, d):
    return profile.drop_empty(_docs(spark, d), "text").select("doc_id")


@query("c8_unlabeled", "SELECT count(*) FILTER (c IS NULL) AS n_unlabeled, count(*) AS n FROM coders_wide", "coders_wide")
def c8_unlabeled(spark, d):
    return inputs.coders_wide(spark, d).agg(F.count_if(profile.unlabeled(F.col("c"))).alias("n_unlabeled"), F.count("*").alias("n"))


@query("c9_head", "SELECT doc_id, lang FROM documents WHERE text IS NOT NULL ORDER BY doc_id LIMIT 50")
def c9_head(spark, d):
    return _docs(spark, d).dropna(subset=["text"]).orderBy("doc_id").limit(50).select("doc_id", "lang")


# reliability and evaluation

_MARGINS = """m AS (SELECT label, sum(r)::BIGINT AS r, sum(c)::BIGINT AS c, sum(tp)::BIGINT AS tp FROM (
        SELECT x AS label, 1 AS r, 0 AS c, (x = y)::INT AS tp FROM p UNION ALL SELECT y, 0, 1, 0 FROM p) GROUP BY 1),
    n AS (SELECT count(*) AS n FROM p)"""
_KAPPA = """CASE WHEN pe >= 1 THEN 0.0 ELSE (po - pe) / (1 - pe) END"""
_SCALE = "CASE WHEN k < 0 THEN 'Poor agreement' WHEN k < 0.21 THEN 'Slight agreement' WHEN k < 0.41 THEN 'Fair agreement' WHEN k < 0.61 THEN 'Moderate agreement' WHEN k < 0.81 THEN 'Substantial agreement' ELSE 'Almost perfect agreement' END"


@query("d1_kappa", f"""WITH p AS (SELECT a AS x, b AS y FROM coders_wide), {_MARGINS},
    s AS (SELECT sum(tp) / max(n) AS po, sum(r * c) / (max(n)::DOUBLE * max(n)) AS pe, max(n) AS n_items, count(*) AS n_categories FROM m, n),
    t AS (SELECT *, {_KAPPA} AS k FROM s)
    SELECT round(k, 4)::DOUBLE AS kappa, n_items, n_categories, {_SCALE} AS interpretation FROM t""", "coders_wide")
def d1_kappa(spark, d):
    return agreement.cohens_kappa(inputs.coders_wide(spark, d), "a", "b")


_ALPHA = """WITH c AS (SELECT item_id, label, count(*) AS n FROM coders_long WHERE label IS NOT NULL GROUP BY ALL),
    i AS (SELECT item_id, sum(n) AS m, sum(n * n) AS q FROM c GROUP BY 1 HAVING sum(n) > 1),
    v AS (SELECT label, sum(n) AS nc FROM c JOIN i USING (item_id) GROUP BY 1),
    o AS (SELECT {observed} AS d_o, count(*) AS n_units FROM i),
    e AS (SELECT (sum(nc) * sum(nc) - sum(nc * nc)) / (sum(nc)::DOUBLE * (sum(nc) - 1)) AS d_e FROM v),
    t AS (SELECT 1 - d_o / d_e AS a, n_units FROM o, e)
    SELECT round(a, 4)::DOUBLE AS alpha, n_units, (SELECT count(DISTINCT label) FROM c) AS n_categories,
    CASE WHEN a < 0.667 THEN 'Unreliable — discard or recode' WHEN a < 0.8 THEN 'Tentatively reliable' ELSE 'Reliable' END AS interpretation FROM t"""


@query("d2_alpha", _ALPHA.format(observed="sum(m * m - q) / sum(m * (m - 1))::DOUBLE"), "coders_long")
def d2_alpha(spark, d):
    return agreement.krippendorffs_alpha(inputs.coders_long(spark, d))


@query("d2_alpha_standard", _ALPHA.format(observed="sum((m * m - q) / (m - 1)::DOUBLE) / sum(m)"), "coders_long")
def d2_alpha_standard(spark, d):
    return agreement.krippendorffs_alpha(inputs.coders_long(spark, d), form="standard")


_SETS = """d AS (SELECT doc_id AS item_id FROM documents),
    s AS (SELECT d.item_id, coalesce(x, []) AS x, coalesce(y, []) AS y FROM d
      LEFT JOIN (SELECT item_id, list(theme) AS x FROM theme_long WHERE coder = 'c1' GROUP BY 1) a ON a.item_id = d.item_id
      LEFT JOIN (SELECT item_id, list(theme) AS y FROM theme_long WHERE coder = 'c2' GROUP BY 1) b ON b.item_id = d.item_id)"""


@query("d3_jaccard", f"""WITH {_SETS}, j AS (SELECT avg(CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) /
      len(list_distinct(list_concat(x, y))) END) AS k, count(*) AS n FROM s)
    SELECT round(k, 4)::DOUBLE AS jaccard, n AS n_items, CASE WHEN k < 0.2 THEN 'Poor agreement' WHEN k < 0.4 THEN 'Fair agreement' WHEN k < 0.6 THEN
      'Moderate agreement'
    WHEN k < 0.8 THEN 'Substantial agreement' ELSE 'Almost perfect agreement' END AS interpretation FROM j""", "theme_long")
def d3_jaccard(spark, d):
    return agreement.mean_jaccard(inputs.theme_sets(spark, d), "x", "y")


@query("d4_per_category", f"""WITH p AS (SELECT a AS x, b AS y FROM coders_wide), {_MARGINS}
    SELECT label AS category, round((n - r - c + 2 * tp) / n, 4)::DOUBLE AS observed, round((r / n) * (c / n) + (1 - r / n) * (1 - c / n), 4)::DOUBLE
      AS expected,
    round(tp / (r + c - tp), 4)::DOUBLE AS specific FROM m, n""", "coders_wide")
def d4_per_category(spark, d):
    return agreement.per_category(agreement.label_margins(agreement.pair_counts(inputs.coders_wide(spark, d), "a", "b")))


@query("d6_theme_kappa", f"""WITH {_SETS}, t AS (SELECT theme, count(*) FILTER (list_contains(x, theme)) AS r, count(*) FILTER (list_contains(y,
      theme)) AS c,
      count(*) FILTER (list_contains(x, theme) AND list_contains(y, theme)) AS tp, count(*) AS n FROM s, (SELECT DISTINCT theme FROM theme_long) GROUP
      BY 1),
    k AS (SELECT *, (n - r - c + 2 * tp) / n AS po, (r * c + (n - r) * (n - c)) / (n::DOUBLE * n) AS pe FROM t)
    SELECT theme, round({_KAPPA}, 4)::DOUBLE AS kappa, round(po, 4)::DOUBLE AS observed, round(tp / (r + c - tp), 4)::DOUBLE AS specific FROM k""", "theme_long")
def d6_theme_kappa(spark, d):
    return agreement.multilabel_kappa(inputs.theme_sets(spark, d), "item_id", "x", "y")


@query("d7_pairwise", f"""WITH q AS (SELECT 'a' AS coder_a, 'b' AS coder_b, a AS x, b AS y FROM coders_wide UNION ALL SELECT 'a', 'c', a, coalesce(c,
      'nan') FROM coders_wide
      UNION ALL SELECT 'b', 'c', b, coalesce(c, 'nan') FROM coders_wide),
    m AS (SELECT coder_a, coder_b, label, sum(r) AS r, sum(c) AS c, sum(tp) AS tp FROM (
        SELECT coder_a, coder_b, x AS label, 1 AS r, 0 AS c, (x = y)::INT AS tp FROM q UNION ALL SELECT coder_a, coder_b, y, 0, 1, 0 FROM q) GROUP BY
      ALL),
    s AS (SELECT coder_a, coder_b, sum(tp) / sum(r) AS po, sum(r * c) / (sum(r)::DOUBLE * sum(r)) AS pe, sum(r)::BIGINT AS n_items, count(*) AS
      n_categories FROM m GROUP BY ALL),
    t AS (SELECT *, {_KAPPA} AS k FROM s)
    SELECT coder_a, coder_b, round(k, 4)::DOUBLE AS kappa, n_items, n_categories, {_SCALE} AS interpretation FROM t""", "coders_wide")
def d7_pairwise(spark, d):
    return agreement.pairwise_kappa(inputs.coders_long(spark, d))


_PAIRS = """q AS (SELECT 'a vs b' AS name, a AS x, b AS y FROM coders_wide UNION ALL SELECT 'a vs c', a, coalesce(c, 'nan') FROM coders_wide UNION ALL
      SELECT 'b vs c', b, coalesce(c, 'nan') FROM coders_wide),
    m AS (SELECT name, label, sum(r) AS r, sum(c) AS c, sum(tp) AS tp FROM (SELECT name, x AS label, 1 AS r, 0 AS c, (x = y)::INT AS tp FROM q UNION
      ALL SELECT name, y, 0, 1, 0 FROM q) GROUP BY ALL),
    z AS (SELECT name, sum(tp) / sum(r) AS po, sum(r * c) / (sum(r)::DOUBLE * sum(r)) AS pe FROM m GROUP BY ALL)"""
_JACCARD_SCALE = "CASE WHEN k < 0.2 THEN 'Poor agreement' WHEN k < 0.4 THEN 'Fair agreement' WHEN k < 0.6 THEN 'Moderate agreement' WHEN k < 0.8 THEN 'Substantial agreement' ELSE 'Almost perfect agreement' END"


@query("d7_report", f"""{_ALPHA.format(observed="sum(m * m - q) / sum(m * (m - 1))::DOUBLE").replace("WITH c AS", "WITH {coders}, c AS", 1).rsplit("SELECT round(a, 4)", 1)[0].rstrip()},
      {_PAIRS.replace("m AS", "mm AS").replace("FROM m ", "FROM mm ")},
    t2 AS (SELECT name, {_KAPPA} AS k FROM z), mean AS (SELECT avg(round(k, 4)) AS k FROM t2)
    SELECT 'alpha' AS section, NULL AS name, round(a, 4)::DOUBLE AS value, CASE WHEN a < 0.667 THEN 'Unreliable — discard or recode' WHEN a < 0.8 THEN
      'Tentatively reliable' ELSE 'Reliable' END AS interpretation FROM t
    UNION ALL SELECT 'pair', name, round(k, 4)::DOUBLE, {_SCALE} FROM t2 UNION ALL SELECT 'average', NULL, round(k, 4)::DOUBLE, {_SCALE} FROM mean""".replace("{coders}", ", ".join(inputs.named(n) for n in ("labelled", "coders_wide", "coders_long"))))
def d7_report(spark, d):
    return reliability.report(inputs.coders_wide(spark, d), ["a", "b", "c"])


@query("d6_report", f"""WITH {_SETS}, t AS (SELECT theme, count(*) FILTER (list_contains(x, theme)) AS r, count(*) FILTER (list_contains(y, theme)) AS
      c,
      count(*) FILTER (list_contains(x, theme) AND list_contains(y, theme)) AS tp, count(*) AS n FROM s, (SELECT DISTINCT theme FROM theme_long) GROUP
      BY 1),
    k AS (SELECT *, (n - r - c + 2 * tp) / n AS po, (r * c + (n - r) * (n - c)) / (n::DOUBLE * n) AS pe FROM t),
    v AS (SELECT theme, round({_KAPPA}, 4)::DOUBLE AS k, round(po, 4)::DOUBLE AS observed, round(tp / (r + c - tp), 4)::DOUBLE AS specific FROM k),
    j AS (SELECT avg(CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END) AS k FROM s),
      mean AS (SELECT avg(k) AS k FROM v)
    SELECT 'jaccard' AS section, NULL AS name, round(k, 4)::DOUBLE AS value, {_JACCARD_SCALE} AS interpretation FROM j
    UNION ALL SELECT 'kappa', theme, k, {_SCALE} FROM v UNION ALL SELECT 'observed', theme, observed, NULL FROM v UNION ALL SELECT 'specific', theme,
      specific, NULL FROM v
    UNION ALL SELECT 'average', NULL, round(k, 4)::DOUBLE, {_SCALE} FROM mean""", "theme_long")
def d6_report(spark, d):
    return reliability.report(inputs.theme_sets(spark, d), ["x", "y"], "multi")


@query("d7_multilabel", f"""WITH w AS (SELECT doc_id AS item_id, coalesce(x, []) AS x, coalesce(y, []) AS y, coalesce(z, []) AS z FROM documents d
      LEFT JOIN (SELECT item_id, list(theme) AS x FROM codings WHERE coder = 'c1' GROUP BY 1) a ON a.item_id = d.doc_id
      LEFT JOIN (SELECT item_id, list(theme) AS y FROM codings WHERE coder = 'c2' GROUP BY 1) b ON b.item_id = d.doc_id
      LEFT JOIN (SELECT item_id, list(theme) AS z FROM codings WHERE coder = 'c3' GROUP BY 1) c ON c.item_id = d.doc_id),
    p AS (SELECT 'c1 vs c2' AS name, x AS a, y AS b FROM w UNION ALL SELECT 'c1 vs c3', x, z FROM w UNION ALL SELECT 'c2 vs c3', y, z FROM w),
    j AS (SELECT name, avg(CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END) AS k
      FROM p GROUP BY 1), mean AS (SELECT avg(round(k, 4)) AS k FROM j)
    SELECT 'pair' AS section, name, round(k, 4)::DOUBLE AS value, {_JACCARD_SCALE} AS interpretation FROM j UNION ALL SELECT 'average', NULL, round(k,
      4)::DOUBLE, {_JACCARD_SCALE} FROM mean""", "codings")
def d7_multilabel(spark, d):
    """The three coders of the documents, from cells that list themes with commas."""
    coded = inputs.codings(spark, d).groupBy("item_id").pivot("coder", ["c1", "c2", "c3"]).agg(F.array_join(F.collect_list("theme"), ", "))
    return reliability.report(inputs.items(spark, d).select("item_id").join(coded, "item_id", "left"), ["c1", "c2", "c3"], "multi")


_EVAL = f"""p AS (SELECT truth AS x, predicted AS y FROM predicted), {_MARGINS},
    e AS (SELECT label, round(CASE WHEN c > 0 THEN tp / c ELSE 0 END, 4)::DOUBLE AS "precision", round(CASE WHEN r > 0 THEN tp / r ELSE 0 END,
      4)::DOUBLE AS recall,
      round(2 * tp / (r + c), 4)::DOUBLE AS f1, r AS support, n AS total, tp FROM m, n)"""


@query("d9_evaluate", f'WITH {_EVAL} SELECT label, "precision", recall, f1, support, total FROM e', "predicted")
def d9_evaluate(spark, d):
    return agreement.evaluate(agreement.label_margins(agreement.pair_counts(inputs.predicted(spark, d), "truth", "predicted"))).drop("tp")


@query("d9_summary", f"WITH {_EVAL} SELECT round(sum(tp) / max(total), 4)::DOUBLE AS accuracy, round(avg(f1), 4)::DOUBLE AS macro_f1, round(sum(f1 * support) / sum(support), 4)::DOUBLE AS weighted_f1, max(total) AS n FROM e", "predicted")
def d9_summary(spark, d):
    return agreement.evaluation_summary(agreement.evaluate(agreement.label_margins(agreement.pair_counts(inputs.predicted(spark, d), "truth", "predicted"))))


@query("d11_confusion", """SELECT 'true:' || t AS "row", count(*) FILTER (truth = t AND predicted = '0') AS "pred:0", count(*) FILTER (truth = t AND
      predicted = '1') AS "pred:1"
    FROM predicted, (VALUES ('0'), ('1')) v(t) GROUP BY t""", "predicted")
def d11_confusion(spark, d):
    return agreement.confusion_wide(agreement.pair_counts(inputs.predicted(spark, d), "truth", "predicted"), ["0", "1"])


@query("d13_macro_f1", f"WITH p AS (SELECT truth AS x, predicted AS y FROM predicted), {_MARGINS} SELECT round(avg(2 * tp / (r + c)), 4)::DOUBLE AS macro_f1 FROM m WHERE r > 0", "predicted")
def d13_macro_f1(spark, d):
    return agreement.macro_f1_of_truth(inputs.predicted(spark, d), "truth", "predicted")


# diagnostics and features


@query("e1_diagnostics", """SELECT 'rows' AS metric, count(*) AS value FROM documents UNION ALL SELECT 'columns', 5 UNION ALL SELECT 'empty_texts',
      count(*) FILTER (trim(coalesce(text, '')) = '') FROM documents
    UNION ALL SELECT 'unique_texts', count(DISTINCT text) FROM documents UNION ALL SELECT 'classes', count(DISTINCT lang) FROM documents
    UNION ALL SELECT 'n_duplicates', count(*) - count(DISTINCT (doc_id, text, lang, source, n_chars)) FROM documents""")
def e1_diagnostics(spark, d):
    return profile.diagnostics(_docs(spark, d), "text", "lang")


@query("e2_token_stats", f"""SELECT min(n) AS n_min, max(n) AS n_max, round(avg(n), 1)::DOUBLE AS n_mean, round(quantile_cont(n, 0.25), 1)::DOUBLE AS
      p25, round(quantile_cont(n, 0.5), 1)::DOUBLE AS median,
    round(quantile_cont(n, 0.75), 1)::DOUBLE AS p75, round(quantile_cont(n, 0.95), 1)::DOUBLE AS p95 FROM (SELECT {TOKENS} AS n FROM documents) WHERE
      n > 0""")
def e2_token_stats(spark, d):
    return profile.token_stats(_docs(spark, d), "text")


@query("e3_distribution", "SELECT lang AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4)::DOUBLE AS share FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def e3_distribution(spark, d):
    return profile.distribution(_docs(spark, d), "lang")


@query("e4_duplicates", "SELECT count(*) AS n_rows, count(*) - count(DISTINCT text) AS n_duplicates, round((count(*) - count(DISTINCT text)) / count(*), 4)::DOUBLE AS rate FROM documents")
def e4_duplicates(spark, d):
    return profile.duplicates(_docs(spark, d), ["text"])


@query("e5_time_span", """SELECT n_valid, days, CASE WHEN n_valid <= 10 THEN NULL WHEN days <= 1 THEN 'one_day' WHEN days <= 7 THEN 'one_week' END AS
      warning
    FROM (SELECT count(ts) AS n_valid, ((epoch_us(max(ts)) - epoch_us(min(ts))) // 86400000000)::BIGINT AS days FROM events)""")
def e5_time_span(spark, d):
    return profile.time_span(table(spark, d, "events"), "ts")


@query("e5_uniqueness", "SELECT count(text) AS n_texts, count(DISTINCT text) AS n_unique, round(count(DISTINCT text) / count(text), 4)::DOUBLE AS rate, count(DISTINCT text) / count(text) < 0.8 AS warning FROM documents")
def e5_uniqueness(spark, d):
    return profile.text_uniqueness(_docs(spark, d), "text")


@query("e7_majority", """SELECT lang AS value, round(n / t, 4)::DOUBLE AS share, n / t < 0.9 AS mixed FROM (SELECT lang, count(*) AS n, sum(count(*))
      OVER () AS t FROM documents GROUP BY 1) ORDER BY n DESC, lang LIMIT 1""")
def e7_majority(spark, d):
    return profile.majority(_docs(spark, d), "lang")


@query("e8_tokens", f"SELECT doc_id, {TOKENS} AS n_tokens FROM documents")
def e8_tokens(spark, d):
    return _docs(spark, d).select("doc_id", n_tokens(F.col("text")).alias("n_tokens"))


@query("e9_features", f"""SELECT count(*) AS n_samples, count(quality) AS n_labeled, (SELECT count(DISTINCT quality) FROM labels) AS n_classes,
    (SELECT round(max(n) / min(n), 2)::DOUBLE FROM (SELECT count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY quality)) AS balance,
      floor(avg({TOKENS}))::BIGINT AS mean_tokens
    FROM documents LEFT JOIN labels USING (doc_id)""")
def e9_features(spark, d):
    rows = _docs(spark, d).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return profile.features(rows, "text", "quality")


# languages, learned from the documents that state one

_GRAMS = """prepared AS (SELECT *, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}]+', ' ', 'g')) || ' ' AS s FROM documents),
    grams AS (SELECT doc_id, lang, substr(s, i::INT, 3) AS gram FROM (SELECT doc_id, lang, s, unnest(range(1, length(s) - 1)) AS i FROM prepared)),
    """


def _languages(train: str, score: str) -> str:
    """WITH clauses of (doc_id, lang, language, margin), trained on and scored for the documents of two conditions."""
    return _GRAMS + f"""counts AS (SELECT lang, gram, count(*) AS n FROM grams WHERE trim(lang) <> '' AND {train} GROUP BY ALL),
    totals AS (SELECT lang, sum(n) + (SELECT count(DISTINCT gram) FROM counts) AS of FROM counts GROUP BY 1),
    known AS (SELECT DISTINCT gram FROM (SELECT gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS place FROM counts) WHERE place <=
      2000),
    weights AS (SELECT gram, t.lang AS language, floor(1000 * ln((coalesce(n, 0) + 1) / of))::BIGINT AS w FROM known CROSS JOIN totals t LEFT JOIN
      counts c USING (gram, lang)),
    sums AS (SELECT doc_id, language, sum(w)::BIGINT AS w FROM (SELECT doc_id, gram FROM grams WHERE {score}) JOIN weights USING (gram) GROUP BY ALL),
    all_sums AS (SELECT p.doc_id, p.lang, t.lang AS language, coalesce(w, 0) AS w FROM prepared p CROSS JOIN totals t
        LEFT JOIN sums s ON s.doc_id = p.doc_id AND s.language = t.lang WHERE trim(p.s) <> '' AND {score.replace("doc_id", "p.doc_id")}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, language) AS place FROM all_sums),
    identified AS (SELECT a.doc_id, a.lang, a.language, coalesce(a.w - b.w, 0)::BIGINT AS margin FROM ranked a LEFT JOIN ranked b ON a.doc_id =
      b.doc_id AND b.place = 2 WHERE a.place = 1)"""


_IDENTIFIED = _languages("true", "true")


def _language_model(spark, rows):
    return language.fit(rows, counted=materialised)


@query("e6_identify", f"""WITH {_IDENTIFIED} SELECT doc_id, language, margin FROM documents LEFT JOIN identified USING (doc_id)""")
def e6_identify(spark, d):
    return language.identify(_docs(spark, d), _language_model(spark, _docs(spark, d)))


@query("e6_heldout", f"""WITH {_languages("doc_id % 5 <> 0", "doc_id % 5 = 0")} SELECT lang, count(*) AS n, count(*) FILTER (language = lang) AS found
      FROM identified WHERE trim(lang) <> '' GROUP BY 1""")
def e6_heldout(spark, d):
    held = F.col("doc_id") % 5 == 0  # of five folds one is held out
    model = _language_model(spark, _docs(spark, d).where(~held))
    rows = _docs(spark, d).where(held & ~is_blank(F.col("lang")))
    found = language.identify(rows, model).where("language is not null").join(rows.select("doc_id", "lang"), "doc_id")
    return found.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("language") == F.col("lang")).alias("found"))


@query("e7_main_language", f"""WITH {_IDENTIFIED}, n AS (SELECT language, count(*) AS n FROM identified GROUP BY 1)
    SELECT language, round(n / (SELECT sum(n) FROM n), 4)::DOUBLE AS share, n / (SELECT sum(n) FROM n) < 0.9 AND (SELECT count(*) FROM n) > 1 AS
      multilingual FROM n ORDER BY n DESC, language LIMIT 1""")
def e7_main_language(spark, d):
    return language.main_language(_docs(spark, d), _language_model(spark, _docs(spark, d)))


@query("c3_language", f"""WITH {_IDENTIFIED}, n AS (SELECT language, count(*) AS n, sum(count(*)) OVER () AS t FROM identified WHERE lang IS NULL OR
      lang <> 'en' GROUP BY 1),
    m AS (SELECT * FROM n ORDER BY n DESC, language LIMIT 1)
    SELECT 'info' AS severity, 'text' AS field, 'not_english' AS check, round(n / t, 4)::DOUBLE AS value FROM m WHERE language <> 'en'""")
def c3_language(spark, d):
    model = _language_model(spark, _docs(spark, d))
    rows = _docs(spark, d).where("lang is null or lang <> 'en'").select("text")
    return profile.validate(rows, languages=model).where(F.col("check") == "not_english")


@query("e1_report", f"""WITH {_IDENTIFIED}, t AS (SELECT {TOKENS} AS n FROM documents),
    u AS (SELECT count(text) AS a, count(DISTINCT text) AS b FROM documents), l AS (SELECT lang, count(*) AS n, sum(count(*)) OVER () AS t FROM
      documents WHERE lang IS NOT NULL GROUP BY 1),
    dup AS (SELECT count(*) AS n, count(DISTINCT (doc_id, text, lang, source, n_chars)) AS k FROM documents)
    SELECT section, name, value::DOUBLE AS value FROM (
    SELECT 'table' AS section, 'rows' AS name, count(*) AS value FROM documents UNION ALL SELECT 'table', 'columns', 5
    UNION ALL SELECT 'table', 'empty_texts', count(*) FILTER (n = 0) FROM t
    UNION ALL SELECT 'table', 'duplicate_rows', n - k FROM dup UNION ALL SELECT 'table', 'duplicate_rate', round((n - k) / n, 4) FROM dup
    UNION ALL SELECT 'tokens', x.name, x.value FROM (SELECT unnest([{{'name': 'n_min', 'value': min(n)}}, {{'name': 'n_max', 'value': max(n)}},
      {{'name': 'n_mean', 'value': round(avg(n), 1)}},
        {{'name': 'p25', 'value': round(quantile_cont(n, 0.25), 1)}}, {{'name': 'median', 'value': round(quantile_cont(n, 0.5), 1)}},
        {{'name': 'p75', 'value': round(quantile_cont(n, 0.75), 1)}}, {{'name': 'p95', 'value': round(quantile_cont(n, 0.95), 1)}}]) AS x FROM t WHERE
      n > 0)
    UNION ALL SELECT 'language', language, count(*) FROM identified GROUP BY 2
    UNION ALL SELECT 'label', lang, n FROM l UNION ALL SELECT 'label_share', lang, round(n / t, 4) FROM l
    UNION ALL SELECT 'bias', 'repeated_texts', round(b / a, 4) FROM u WHERE b / a < 0.8)""")
def e1_report(spark, d):
    return profile.diagnostics_report(_docs(spark, d), "text", "lang", _language_model(spark, _docs(spark, d)))


@query("e9_task", f"""WITH {_IDENTIFIED}, n AS (SELECT language, count(*) AS n, sum(count(*)) OVER () AS t, count(*) OVER () AS k FROM identified
      GROUP BY 1), m AS (SELECT * FROM n ORDER BY n DESC, language LIMIT 1)
    SELECT count(*) AS n_samples, count(quality) AS n_labeled, (SELECT count(DISTINCT quality) FROM labels) AS n_classes,
    (SELECT round(max(n) / min(n), 2)::DOUBLE FROM (SELECT count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY quality)) AS balance,
      floor(avg({TOKENS}))::BIGINT AS mean_tokens,
    (SELECT language FROM m) AS language, (SELECT n / t < 0.9 AND k > 1 FROM m) AS multilingual, 'custom' AS task_type, 'low' AS budget_level,
      0.85::DOUBLE AS target_f1,
    0.7::DOUBLE AS annotation_agreement, NULL::VARCHAR AS domain_specificity, 'clear' AS class_boundary_clarity, NULL::VARCHAR AS downstream_use
    FROM documents LEFT JOIN labels USING (doc_id)""")
def e9_task(spark, d):
    rows = _docs(spark, d).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    stated = {"task_type": "unheard of", "budget_level": "low", "target_f1": 0.85, "n_classes": 9, "annotation_agreement": 0.7, "class_boundary_clarity": "clear"}
    return profile.features(rows, "text", "quality", languages=_language_model(spark, _docs(spark, d)), stated=stated)


_WEIGHTS = """tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]{2,}')) AS term
      FROM src) GROUP BY ALL),
    idf AS (SELECT term, ln((1 + (SELECT count(*) FROM src)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
    raw AS (SELECT id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
    weights AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM raw)"""


@query("e10_diversity", f"""WITH src AS (SELECT doc_id AS id, text FROM documents), {_WEIGHTS}, s AS (SELECT sum(s * s) AS total, sum(q) AS own FROM
      (SELECT sum(weight) AS s, sum(weight * weight) AS q FROM weights GROUP BY term))
    SELECT n, round(1 - (total - own) / (n * (n - 1)), 4)::DOUBLE AS diversity FROM s, (SELECT count(DISTINCT id) AS n FROM weights)""")
def e10_diversity(spark, d):
    return tfidf.diversity(tfidf.tfidf(_docs(spark, d), "doc_id", "text"))


# advice

_TASKS = "SELECT user_id AS task, (user_id * 37 % 900) * (user_id % 3) AS n_labeled, CASE WHEN user_id % 2 = 0 THEN 'sentiment' ELSE 'topic' END AS task_type, user_id % 7 + 2 AS n_classes, CASE WHEN user_id % 5 < 3 THEN 0.8 ELSE 0.9 END AS target_f1, CASE WHEN user_id % 4 = 0 THEN 'hypothesis_testing' ELSE 'description' END AS downstream_use FROM (SELECT DISTINCT user_id FROM events)"


@query("f1_f2_recommend", f"""WITH t AS ({_TASKS}), r AS (SELECT *, CASE WHEN n_labeled = 0 AND target_f1 <= 0.85 AND task_type = 'sentiment' AND
      n_classes <= 3 THEN 1 WHEN n_labeled = 0 AND target_f1 <= 0.85 THEN 2
      WHEN n_labeled = 0 THEN 3 WHEN n_labeled < 200 THEN 4 WHEN n_labeled < 500 THEN 5 WHEN target_f1 <= 0.85 THEN 6 ELSE 7 END AS rule,
      CASE WHEN n_classes <= 3 AND task_type = 'sentiment' THEN 1 WHEN n_classes <= 5 THEN 2 ELSE 3 END AS lv FROM t)
    SELECT task, rule, ['zero_shot', 'few_shot', 'fine_tune', 'few_shot', 'few_shot', 'fine_tune', 'active_learning'][rule] AS method, [0.75, 0.65,
      0.70, 0.75, 0.78, 0.85, 0.87][rule]::DOUBLE AS expected_f1,
    [0.05, 0.08, 0.08, 0.05, 0.05, 0.03, 0.03][rule]::DOUBLE AS margin, downstream_use = 'hypothesis_testing' AS sensitivity_analysis,
    CASE WHEN rule = 3 THEN [200, 300, 500][lv] END AS minimum_n, CASE WHEN rule = 3 THEN [500, 800, 1200][lv] END AS recommended_n, CASE WHEN rule =
      3 THEN [1000, 1500, 2000][lv] END AS diminishing_n FROM r""")
def f1_f2_recommend(spark, d):
    u = F.col("user_id")
    tasks = table(spark, d, "events").select("user_id").distinct().select(
        u.alias("task"), ((u * 37 % 900) * (u % 3)).alias("n_labeled"), F.when(u % 2 == 0, "sentiment").otherwise("topic").alias("task_type"), (u % 7 + 2).alias("n_classes"),
        F.when(u % 5 < 3, 0.8).otherwise(0.9).alias("target_f1"), F.when(u % 4 == 0, "hypothesis_testing").otherwise("description").alias("downstream_use"),
    )
    return advise.recommend(tasks).drop("n_labeled", "task_type", "n_classes", "target_f1", "downstream_use")


@query("f3_f7_budget")
def f3_f7_budget(spark, d):
    plan = advise.budget(spark, "sentiment", 3, 0.8)
    return spark.createDataFrame([(plan["recommended_n"], *plan["interval"], plan["basis"])], "recommended_n long, low long, high long, basis string")


@query("f5_curve", "SELECT n::INT AS n, round(least(1.0, 0.1 * pow(n, 0.25) + 0.2), 6)::DOUBLE AS f1 FROM range(100, 5001, 100) r(n)")
def f5_curve(spark, d):
    return advise.curve(spark, 0.1, 0.25, 0.2)


_CURVES = "(SELECT DISTINCT user_id AS task, 0.05 + (user_id % 5) / 50.0 AS a, 0.2 + (user_id % 3) / 20.0 AS b, (user_id % 4) / 10.0 AS c FROM events)"


@query("f5_task_curves", f"SELECT task, n::INT AS n, round(least(1.0, a * pow(n, b) + c), 4)::DOUBLE AS f1 FROM {_CURVES}, range(100, 5001, 100) r(n)")
def f5_task_curves(spark, d):
    u = F.col("user_id")
    tasks = table(spark, d, "events").select("user_id").distinct().select(u.alias("task"), (0.05 + (u % 5) / 50.0).alias("a"), (0.2 + (u % 3) / 20.0).alias("b"), ((u % 4) / 10.0).alias("c"))
    return advise.task_curves(tasks)


@query("f7_budgets")
def f7_budgets(spark, d):
    """A task for each language: how often a rule of length is right among its first n documents, as its curve."""
    rows = inputs.labelled(spark, d).withColumn("right", (F.col("quality") == (F.col("n_chars") >= 500).cast("int")).cast("int"))
    first = Window.partitionBy("lang").orderBy("doc_id")
    grown = rows.select(F.col("lang").alias("task"), F.row_number().over(first).alias("n"), F.avg("right").over(first.rowsBetween(Window.unboundedPreceding, 0)).alias("f1"))
    points = grown.where((F.col("n") >= 5) & (F.log2("n") == F.floor(F.log2("n"))))
    tasks = rows.select(F.col("lang").alias("task")).distinct().withColumns({"task_type": F.lit("topic"), "n_classes": F.lit(2), "target": F.lit(0.7)})
    return advise.budgets(tasks, points)


@query("f8_curve_table", "WITH c AS (SELECT n::INT AS n, round(least(1.0, 0.1 * pow(n, 0.25) + 0.2), 6)::DOUBLE AS f1 FROM range(100, 5001, 100) r(n)) SELECT n, f1, n = 1300 AS recommended FROM c WHERE (n - 100) // 100 % 6 = 0 OR n = 1300")
def f8_curve_table(spark, d):
    return advise.curve_table(advise.curve(spark, 0.1, 0.25, 0.2), 1250)


# annotation sessions


def _session(spark, d):
    """A session of each user (ids from 0): the documents dealt to it, and all its events. An event that acts on an item opens it
    first, so no action meets the end of the items."""
    users = table(spark, d, "events").agg(F.greatest(F.countDistinct("user_id"), F.lit(1)).alias("users"))
    session = lambda c: F.pmod(F.col(c), "users").cast("string").alias("session")
    items = inputs.items(spark, d).join(F.broadcast(users), F.lit(True)).select(session("item_id"), F.col("item_id").alias("item"), F.lit(None).cast("string").alias("label"))
    e = F.col("event_id")
    name = F.element_at(F.array(*[F.lit(x) for x in ("annotate", "skip", "annotate", "flag", "undo", "annotate", "goto")]), (e % 7 + 1).cast("int"))
    events = table(spark, d, "events").join(F.broadcast(users), F.lit(True)).select(session("user_id"), e, F.col("ts").cast("timestamp").alias("ts"), name.alias("name"))
    events = events.join(items.groupBy("session").agg(F.count("*").alias("n_items")), "session", "left")
    steps = F.when(F.col("name").isin("undo", "goto"), F.array("name")).otherwise(F.array(F.lit("goto"), "name"))
    log = events.select("session", e, "ts", "n_items", F.posexplode(steps).alias("k", "action"))
    target = F.coalesce(e * 13 % F.col("n_items"), F.lit(-1).cast("long"))
    return items, log.select("session", (2 * e + F.col("k")).alias("seq"), "action", target.alias("target"), F.concat(F.lit("L"), e % 3).alias("label"), F.lit("").alias("note"), "ts")


@query("g1_g4_annotations")
def g1_g4_annotations(spark, d):
    return review.fold_annotations(*_session(spark, d))


@query("g2_stream")
def g2_stream(spark, d):
    items, log = _session(spark, d)
    place = F.row_number().over(Window.partitionBy("session").orderBy("item")) - 1  # a session's items are numbered from 0
    numbered = materialised(items.withColumn("k", place.cast("long")))
    changes = annotation_stream.replayed(log, numbered.select("session", F.col("k").alias("item"), "label"), _scratch(spark))
    state = annotation_stream.after(numbered.select("session", F.col("k").alias("item"), "label"), changes).withColumnRenamed("item", "k")
    return state.join(numbered.select("session", "k", "item"), ["session", "k"]).select("session", "item", "label", "status", "note", "seq")


@query("l3_action_counts", """SELECT time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') AS start, action, count(*) AS n
    FROM (SELECT ts, ['accepted', 'rejected', 'edited'][(event_id % 3 + 1)::INT] AS action FROM events) GROUP BY ALL""")
def l3_action_counts(spark, d):
    """Counted over a stream; a last row, of no action, closes all windows."""
    action = F.element_at(F.array(F.lit("accepted"), F.lit("rejected"), F.lit("edited")), (F.col("event_id") % 3 + 1).cast("int"))
    rows = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), action.alias("action"))
    home = _scratch(spark)
    end = rows.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("interval 1 day")).alias("ts"), F.lit(None).cast("string").alias("action"))
    rows.unionByName(end).write.parquet(f"{home}/log")
    counts = review_stream.action_counts(spark.readStream.schema(rows.schema).parquet(f"{home}/log"))
    query = (
        counts.writeStream.outputMode("append").option("checkpointLocation", f"{home}/checkpoint")
        .foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{home}/counts/batch={k}")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    found = spark.read.schema("start timestamp, action string, n long, batch int").parquet(f"{home}/counts").where("action is not null")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "action", "n")


@query("g5_g6_stats")
def g5_g6_stats(spark, d):
    return review.annotation_stats(review.fold_annotations(*_session(spark, d)))


@query("g7_export")
def g7_export(spark, d):
    return review.export_annotations(review.fold_annotations(*_session(spark, d)))


@query("g1_session", """SELECT '' AS session, row_number() OVER (ORDER BY doc_id) - 1 AS item, doc_id AS id, text, quality::VARCHAR AS label,
    (SELECT list(DISTINCT quality::VARCHAR ORDER BY quality::VARCHAR) FROM labelled) AS labels FROM documents LEFT JOIN labels USING (doc_id)""", "labelled")
def g1_session(spark, d):
    rows = _docs(spark, d).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    items, labels = review.create_session(rows, "doc_id", "text", "quality")
    return items.withColumn("labels", F.array(*[F.lit(x) for x in labels]))


@query("g8_merge_labels", """WITH l AS (SELECT text, arg_max(quality, doc_id)::VARCHAR AS label FROM labelled GROUP BY 1) SELECT doc_id, label FROM
      documents LEFT JOIN l USING (text)""", "labelled")
def g8_merge_labels(spark, d):
    state = inputs.labelled(spark, d).select("text", F.col("doc_id").alias("item"), F.col("quality").cast("string").alias("label"))
    docs = _docs(spark, d).select("doc_id", "text", F.lit(None).cast("string").alias("label"))
    return review.merge_labels(docs, state, "text", "label").select("doc_id", "label")


# segmentation


@query("h1_h4_paragraphs", """SELECT doc_id, k::INT AS segment_id, trim(text, ' ' || chr(10)) AS text, (1 + lines)::INT AS line_start, (1 + lines +
      length(text) - length(replace(text, chr(10), '')))::INT AS line_end,
    pos::INT AS char_start, (pos + length(text))::INT AS char_end, (k - 1)::INT AS paragraph_index FROM turns""", "turns")
def h1_h4_paragraphs(spark, d):
    return segment.segment(inputs.transcripts(spark, d))


@query("h2_sentences")
def h2_sentences(spark, d):
    return segment.segment(_docs(spark, d), mode="sentence")


@query("h3_windows")
def h3_windows(spark, d):
    return segment.segment(inputs.transcripts(spark, d), mode="context_window", window=1)


@query("h6_h7_preview", """SELECT doc_id, CASE WHEN length(text) > 120 THEN substr(trim(text, ' ' || chr(10)), 1, 120) || '...' ELSE text END AS text,
      pos || '-' || (pos + length(text)) AS chars FROM turns WHERE k = 2""", "turns")
def h6_h7_preview(spark, d):
    return segment.preview(segment.lookup(segment.segment(inputs.transcripts(spark, d)), 2)).select("doc_id", "text", "chars")


# review of extractions: paragraphs of transcripts, found by rules, reviewed by events

_EXTRACTED = """seg AS (SELECT doc_id, k::INT AS segment_id, trim(text, ' ' || chr(10)) AS text, (1 + lines)::INT AS line_start,
      (1 + lines + length(text) - length(replace(text, chr(10), '')))::INT AS line_end, pos::INT AS char_start, (pos + length(text))::INT AS char_end,
      (k - 1)::INT AS paragraph_index FROM turns),
    found AS (SELECT doc_id, segment_id, 'asks' AS rq_label, 'question' AS sub_theme, '?' AS evidence_span FROM seg WHERE contains(text, '?')
      UNION ALL SELECT doc_id, segment_id, 'tells', 'long', substr(text, 1, 20) FROM seg WHERE length(text) > 80
      UNION ALL SELECT doc_id, segment_id, 'counts', 'number', regexp_extract(text, '[0-9]') FROM seg WHERE regexp_matches(text, '[0-9]')),
    ext AS (SELECT *, round((50 + (doc_id * 3 + segment_id * 7 + length(rq_label)) % 50) / 100.0, 2)::DOUBLE AS confidence, 'rule' AS reasoning FROM
      found),
    acts AS (SELECT user_id AS doc_id, event_id AS seq, ['accept', 'reject', 'edit', 'add', 'edit', 'accept', 'accept_high'][(event_id % 7 + 1)::INT]
      AS action, (event_id * 13 % 9)::INT AS item,
      (event_id * 5 % 8 + 1)::INT AS segment_id, CASE WHEN event_id % 2 = 0 THEN 'new ' || event_id % 3 END AS rq_label, CASE WHEN event_id % 3 = 0
      THEN 'sub ' || event_id % 4 END AS sub_theme,
      CASE WHEN event_id % 5 = 0 THEN 0.7 END AS threshold FROM events),
    base AS (SELECT e.*, s.text, line_start, line_end, char_start, char_end, paragraph_index, NULL::BIGINT AS added,
      row_number() OVER (PARTITION BY e.doc_id ORDER BY rq_label, char_start, e.segment_id, sub_theme, confidence, evidence_span) - 1 AS item FROM ext
      e JOIN seg s USING (doc_id, segment_id)),
    adds AS (SELECT a.doc_id, a.segment_id, a.rq_label, a.sub_theme, '' AS evidence_span, 1.0 AS confidence, 'added by hand' AS reasoning, s.text,
      line_start, line_end, char_start, char_end, paragraph_index,
      a.seq AS added, row_number() OVER (PARTITION BY a.doc_id ORDER BY a.seq) - 1 + (SELECT count(*) FROM base b WHERE b.doc_id = a.doc_id) AS item
      FROM acts a JOIN seg s USING (doc_id, segment_id) WHERE action = 'add'),
    all_items AS (SELECT * FROM base UNION ALL BY NAME SELECT * FROM adds),
    last AS (SELECT a.doc_id, a.item, arg_max(action, seq) AS action, arg_max(a.rq_label, seq) FILTER (action = 'edit' AND a.rq_label IS NOT NULL) AS
      new_rq,
      arg_max(a.sub_theme, seq) FILTER (action = 'edit' AND a.sub_theme IS NOT NULL) AS new_sub
      FROM acts a JOIN all_items i ON i.doc_id = a.doc_id AND i.item = a.item AND (i.added IS NULL OR a.seq > i.added) WHERE action IN ('accept',
      'reject', 'edit') GROUP BY ALL),
    high AS (SELECT doc_id, min(coalesce(threshold, 0.85)) AS high FROM acts WHERE action = 'accept_high' GROUP BY 1),
    review AS (SELECT i.* EXCLUDE (rq_label, sub_theme, added), CASE WHEN action = 'edit' THEN coalesce(new_rq, rq_label) ELSE rq_label END AS
      rq_label,
      CASE WHEN action = 'edit' THEN coalesce(new_sub, sub_theme) ELSE sub_theme END AS sub_theme,
      CASE action WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' WHEN 'edit' THEN 'edited' ELSE CASE WHEN added IS NOT NULL OR confidence
      >= high THEN 'accepted' ELSE 'pending' END END AS review_status
      FROM all_items i LEFT JOIN last USING (doc_id, item) LEFT JOIN high USING (doc_id))"""


def _extractions(spark, d):
    """(extractions, segments, log): the extractions name a place, from which their segments are found."""
    segments = segment.segment(inputs.transcripts(spark, d))
    text, rules = F.col("text"), []
    for rq, sub, is_found, evidence in (
        ("asks", "question", F.contains("text", F.lit("?")), F.lit("?")), ("tells", "long", F.length("text") > 80, F.substring("text", 1, 20)),
        ("counts", "number", text.rlike("[0-9]"), F.regexp_extract("text", "[0-9]", 0)),
    ):
        rules.append(F.when(is_found, F.struct(F.lit(rq).alias("rq_label"), F.lit(sub).alias("sub_theme"), evidence.alias("evidence_span"), (F.col("char_start") + F.position(evidence, text) - 1).alias("at"))))
    found = segments.select("doc_id", F.col("segment_id").alias("k"), F.explode(F.array_compact(F.array(*rules))).alias("x")).select("doc_id", "k", "x.*")
    found = extraction_review.place(found, segments)
    confidence = F.round((50 + (F.col("doc_id") * 3 + F.col("segment_id") * 7 + F.length("rq_label")) % 50) / 100.0, 2)
    found = found.select("doc_id", "segment_id", "rq_label", "sub_theme", confidence.alias("confidence"), "evidence_span", F.lit("rule").alias("reasoning"))
    e = F.col("event_id")
    action = F.element_at(F.array(*[F.lit(a) for a in ("accept", "reject", "edit", "add", "edit", "accept", "accept_high")]), (e % 7 + 1).cast("int"))
    log = table(spark, d, "events").select(
        F.col("user_id").alias("doc_id"), e.alias("seq"), action.alias("action"), (e * 13 % 9).cast("int").alias("item"), (e * 5 % 8 + 1).cast("int").alias("segment_id"),
        F.when(e % 2 == 0, F.concat(F.lit("new "), e % 3)).alias("rq_label"), F.when(e % 3 == 0, F.concat(F.lit("sub "), e % 4)).alias("sub_theme"), F.when(e % 5 == 0, 0.7).alias("threshold"),
    )
    return found, segments, log


_REVIEW_SQL = f"WITH {inputs.named('turns')}, {_EXTRACTED} SELECT doc_id, item::INT AS item, segment_id, text, rq_label, sub_theme, confidence, line_start, line_end, char_start, char_end, paragraph_index, review_status, reasoning, evidence_span FROM review WHERE review_status <> 'rejected'"


@query("b7_archive", _REVIEW_SQL)
def b7_archive(spark, d):
    """A review that goes on from an archive."""
    found, segments, log = _extractions(spark, d)
    path = _scratch(spark)
    archive.save({"found": ("extractions", found), "segments": ("segments", segments), "log": ("extraction_log", log)}, {"lang": "en"}, path)
    tables, _, _ = archive.load(spark, path)
    return extraction_review.export(extraction_review.reviewed(tables["found"], tables["segments"], tables["log"]))


@query("l4_extraction_review", _REVIEW_SQL)
def l4_extraction_review(spark, d):
    return extraction_review.export(extraction_review.reviewed(*_extractions(spark, d)))


@query("l4_extraction_stats", f"""WITH {inputs.named('turns')}, {_EXTRACTED} SELECT rq_label, count(*) AS total, count(*) FILTER (review_status =
      'accepted') AS accepted, count(*) FILTER (review_status = 'edited') AS edited,
    count(*) FILTER (review_status = 'rejected') AS rejected, count(*) FILTER (review_status = 'pending') AS pending, round(100 * count(*) FILTER
      (review_status <> 'pending') / count(*), 1)::DOUBLE AS progress FROM review GROUP BY 1""")
def l4_extraction_stats(spark, d):
    return extraction_review.stats(extraction_review.reviewed(*_extractions(spark, d)), "rq_label")


# de-identification


@query("i1_i3_detect")
def i1_i3_detect(spark, d):
    return pii.detect(_docs(spark, d))


@query("i1_emails", r"SELECT doc_id AS text_id, unnest(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b')) AS span FROM documents")
def i1_emails(spark, d):
    return pii.detect(_docs(spark, d), kinds=("EMAIL",)).select("text_id", "span")


@query("i2_entities")
def i2_entities(spark, d):
    places = entities.gazetteer((table(spark, d, "nation"), "n_name", "LOCATION"), (table(spark, d, "clients"), "city", "LOCATION"))
    detector = entities.EntityDetector(places, entities.common_words(_docs(spark, d)))
    return pii.detect(_docs(spark, d), kinds=(), detectors=(detector,))


@query("i4_i5_rewrite")
def i4_i5_rewrite(spark, d):
    docs, path = _docs(spark, d), _scratch(spark)
    pii.detect(docs).write.parquet(path)  # numbering and rewriting both read what was found
    return pii.rewrite(docs, pii.name_replacements(spark.read.parquet(path)))


@query("i5_redact", r"SELECT doc_id AS text_id, regexp_replace(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b', '[REDACTED]', 'g') AS text FROM documents")
def i5_redact(spark, d):
    docs = _docs(spark, d)
    return pii.rewrite(docs, pii.name_replacements(pii.detect(docs, kinds=("EMAIL",)), "redact"))


@query("i6_coverage")
def i6_coverage(spark, d):
    return pii.coverage(pii.detect(_docs(spark, d)))


@query("i7_i9_review", """SELECT coalesce(l.action, 'pending') AS action, count(*) AS n FROM (SELECT doc_id AS item_id FROM documents) d LEFT JOIN
      last_log l USING (item_id) GROUP BY 1""", "last_log")
def i7_i9_review(spark, d):
    rows = review.reviewed(inputs.items(spark, d), inputs.action_log(spark, d), ["item_id"], "text")
    return rows.groupBy("action").agg(F.count("*").alias("n"))


_EMAIL = r"'\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b'"
_EMAIL_SPANS = f"(SELECT doc_id AS item_id, unnest(regexp_extract_all(text, {_EMAIL})) AS span FROM documents)"


def _reviewed_spans(spark, d):
    """E-mail addresses of the documents, each with the last action on its document."""
    found = pii.name_replacements(pii.detect(_docs(spark, d), kinds=("EMAIL",)), "redact")
    log = inputs.action_log(spark, d).withColumnRenamed("item_id", "text_id")
    return review.reviewed(found, log, ["text_id"], "replacement", "span")


@query("i7_spans", f"""SELECT coalesce(action, 'pending') AS action, CASE action WHEN 'rejected' THEN span WHEN 'edited' THEN value ELSE '[REDACTED]'
      END AS final, count(*) AS n
    FROM {_EMAIL_SPANS} LEFT JOIN last_log USING (item_id) GROUP BY ALL""", "last_log")
def i7_spans(spark, d):
    return _reviewed_spans(spark, d).groupBy("action", "final").agg(F.count("*").alias("n"))


@query("i7_accept_confident", f"""SELECT count(*) AS total, count(*) FILTER (action IS NULL OR action = 'accepted') AS accepted, count(*) FILTER
      (action = 'edited') AS edited,
    count(*) FILTER (action = 'rejected') AS rejected, 0::BIGINT AS pending FROM {_EMAIL_SPANS} LEFT JOIN last_log USING (item_id)""", "last_log")
def i7_accept_confident(spark, d):
    return review.review_stats(review.accept_confident(_reviewed_spans(spark, d), 0.9))


@query("i9_correspondence", f"SELECT '[REDACTED]' AS replacement, span, 'EMAIL' AS type, count(*) AS n FROM {_EMAIL_SPANS} GROUP BY 2")
def i9_correspondence(spark, d):
    return pii.correspondence(pii.name_replacements(pii.detect(_docs(spark, d), kinds=("EMAIL",)), "redact"))


@query("i8_apply_review", r"""SELECT doc_id AS text_id, CASE coalesce(action, 'pending') WHEN 'rejected' THEN text ELSE
    regexp_replace(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b', CASE action WHEN 'edited' THEN value ELSE '[REDACTED]' END, 'g') END
      AS text
    FROM documents LEFT JOIN last_log ON doc_id = item_id""", "last_log")
def i8_apply_review(spark, d):
    """Every span of a document takes the last action on the document."""
    docs, path = _docs(spark, d), _scratch(spark)
    pii.name_replacements(pii.detect(docs, kinds=("EMAIL",)), "redact").write.parquet(path)
    found = spark.read.parquet(path)
    log = found.select("text_id", "start").join(inputs.action_log(spark, d).withColumnRenamed("item_id", "text_id"), "text_id")
    return pii.apply_review(docs, found, log)


@query("i10_segments", r"SELECT doc_id, k::INT AS segment_id, regexp_replace(trim(text, ' ' || chr(10)), '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b', '[REDACTED]', 'g') AS text FROM turns", "turns")
def i10_segments(spark, d):
    segments = segment.segment(inputs.transcripts(spark, d)).select("doc_id", "segment_id", "text")
    return pii.rewrite_segments(segments, "redact", kinds=("EMAIL",))


# replies


def _prices(spark):
    return completion.price_table(spark)


@query("j4_j5_cost", """SELECT model, count(*) AS calls, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, round((sum(i) * pi + sum(o)
      * po) / 1e6, 6)::DOUBLE AS dollars FROM (
    SELECT CASE event_id % 3 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4.1-nano' ELSE 'local' END AS model, event_id % 900 AS i, event_id % 70 AS o FROM
      events)
    JOIN (VALUES ('gpt-4o', 2.5, 10.0), ('gpt-4.1-nano', 0.1, 0.4), ('local', 0.0, 0.0)) v(model, pi, po) USING (model) GROUP BY model, pi, po""")
def j4_j5_cost(spark, d):
    e = F.col("event_id")
    usage = table(spark, d, "events").select(F.when(e % 3 == 0, "gpt-4o").when(e % 3 == 1, "gpt-4.1-nano").otherwise("local").alias("model"), (e % 900).alias("input_tokens"), (e % 70).alias("output_tokens"))
    return completion.cost(usage, _prices(spark))


@query("j4_estimate", f"SELECT count(*) AS n_prompts, sum(n)::BIGINT AS input_tokens, count(*) * 512 AS output_tokens, round((sum(n) * 2.5 + count(*) * 5120.0) / 1e6, 4)::DOUBLE AS dollars, (sum(n) * 2.5 + count(*) * 5120.0) / 1e6 > 5 AS over_limit FROM (SELECT {TOKENS} AS n FROM documents)")
def j4_estimate(spark, d):
    return completion.estimate_cost(_docs(spark, d), "text", "gpt-4o", _prices(spark))


@query("j6_j10_classify", """SELECT CASE WHEN contains(text, ' the ') THEN 'english' ELSE 'other' END AS label, count(*) AS n, round(count(*) /
      sum(count(*)) OVER (), 4)::DOUBLE AS share, false AS failed FROM documents GROUP BY 1""")
def j6_j10_classify(spark, d):
    stub = completion.TableProvider({" the ": '{"label": "english", "confidence": 0.9}'}, "other")
    template = "{text}|{labels}"
    docs = _docs(spark, d).select("doc_id", "text")
    return completion.batch_report(completion.classify(docs, stub, ["english", "other"], template=template))


_REPLY = "SELECT doc_id, CASE doc_id % 7 WHEN 6 THEN 'no idea' ELSE label END AS parsed FROM replies"


@query("j7_parse", """SELECT doc_id, CASE doc_id % 7 WHEN 6 THEN 'no idea' WHEN 3 THEN label ELSE label END AS label, CASE doc_id % 7 WHEN 0 THEN 0.9
      WHEN 2 THEN 0.5 END::DOUBLE AS confidence FROM replies""", "replies")
def j7_parse(spark, d):
    return inputs.replies(spark, d).select("doc_id", completion.parse_label(F.col("reply"), ["clean", "toxic"]).alias("p")).select("doc_id", "p.label", "p.confidence")


@query("j8_parse_robust", _REPLY, "replies")
def j8_parse_robust(spark, d):
    return inputs.replies(spark, d).select("doc_id", completion.parse_label_robust(F.col("reply"), ["clean", "toxic"]).alias("parsed"))


@query("j9_parse_plain", "SELECT doc_id, CASE doc_id % 7 WHEN 3 THEN reply WHEN 4 THEN reply WHEN 6 THEN 'no idea' ELSE label END AS parsed FROM replies", "replies")
def j9_parse_plain(spark, d):
    return inputs.replies(spark, d).select("doc_id", completion.parse_label_plain(F.col("reply")).alias("parsed"))


@query("j11_unlabeled", "SELECT item_id, CASE WHEN c IS NULL THEN 'new' ELSE c END AS final_label, CASE WHEN c IS NULL THEN 'predicted' ELSE 'given' END AS source FROM coders_wide", "coders_wide")
def j11_unlabeled(spark, d):
    rows = inputs.coders_wide(spark, d)
    return completion.classify_unlabeled(rows, lambda x: x.select("item_id", F.lit("new").alias("predicted")), "item_id", "c").select("item_id", "final_label", "source")


@query("j15_variants", """WITH v AS (SELECT 'plain' AS variant, truth, CASE WHEN doc_id % 7 IN (3, 4) THEN lower(reply) WHEN doc_id % 7 = 6 THEN
      'no idea' ELSE label END AS p FROM replies
      UNION ALL SELECT 'robust', truth, CASE doc_id % 7 WHEN 6 THEN 'no idea' ELSE label END FROM replies),
    m AS (SELECT variant, label, sum(r) AS r, sum(c) AS c, sum(tp) AS tp FROM (SELECT variant, truth AS label, 1 AS r, 0 AS c, (truth = p)::INT AS tp
      FROM v UNION ALL SELECT variant, p, 0, 1, 0 FROM v) GROUP BY ALL),
    s AS (SELECT variant, sum(r)::BIGINT AS n, round(sum(tp) / sum(r), 4)::DOUBLE AS accuracy, round(avg(2 * tp / (r + c)) FILTER (r > 0), 4)::DOUBLE
      AS macro_f1 FROM m GROUP BY 1)
    SELECT *, row_number() OVER (ORDER BY macro_f1 DESC, variant) = 1 AS best FROM s""", "replies")
def j15_variants(spark, d):
    rows = inputs.replies(spark, d)
    plain = rows.select(F.lit("plain").alias("variant"), "truth", completion.parse_label_plain(F.col("reply")).alias("predicted"))
    robust = rows.select(F.lit("robust").alias("variant"), "truth", completion.parse_label_robust(F.col("reply"), ["clean", "toxic"]).alias("predicted"))
    return completion.evaluate_variants(plain.unionByName(robust))


@query("j16_examples")
def j16_examples(spark, d):
    rows = _docs(spark, d).withColumn("label", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd"))
    return tfidf.select_examples(rows, "doc_id", "text", "label", 3)


@query("j17_j18_coding", """SELECT doc_id AS item_id, CASE doc_id % 3 WHEN 0 THEN 'Work' WHEN 1 THEN 'Family life' END AS theme, least(1.0,
      round((doc_id % 13) / 10.0, 3))::DOUBLE AS confidence, 'because' AS reasoning, 'x' AS evidence
    FROM documents WHERE doc_id % 3 < 2""")
def j17_j18_coding(spark, d):
    name = F.element_at(F.array(F.lit("work"), F.lit("family"), F.lit("unknown thing")), (F.col("doc_id") % 3 + 1).cast("int"))
    reply = F.concat(F.lit('Here: {"themes": [{"name": "'), name, F.lit('", "confidence": '), (F.col("doc_id") % 13) / 10.0, F.lit(', "trigger_words": ["a"], "reasoning": "because", "evidence_span": " x "}]} done'))
    rows = _docs(spark, d).select(F.col("doc_id").alias("item_id"), reply.alias("reply"))
    return completion.parse_coding(rows, "reply", ["Work", "Family life"]).drop("triggers")


@query("j19_extraction", """SELECT doc_id, 1::BIGINT AS segment_id, 'RQ1' AS rq_id, CASE doc_id % 3 WHEN 0 THEN 'a' ELSE 'uncategorised' END AS
      sub_theme, 0.7::DOUBLE AS confidence, '' AS evidence FROM documents WHERE doc_id % 3 < 2""")
def j19_extraction(spark, d):
    sub = F.element_at(F.array(F.lit("a"), F.lit(""), F.lit("zzz")), (F.col("doc_id") % 3 + 1).cast("int"))
    reply = F.concat(F.lit('```json\n{"matches": [{"segment_id": 1, "rq_id": "RQ1", "sub_theme": "'), sub, F.lit('", "confidence": 0.7}, {"segment_id": 2, "rq_id": "RQ9"}]}\n```'))
    questions = spark.createDataFrame([("RQ1", ["a", "b"])], "rq_id string, sub_themes array<string>")
    return completion.parse_extraction(_docs(spark, d).select("doc_id", reply.alias("reply")), "reply", questions)


class _Asks:
    """Finds the segments of a prompt that ask something, and for a strict prompt those alone that say who. Prompts are told
    apart by how they begin, and segments by the blank line before their number, which no segment holds; texts may say anything."""

    def complete(self, prompt: str, system: str = "") -> str:
        if prompt.startswith(("STRICT", "Is it")):
            hit = (" the " if prompt.startswith("STRICT") else "e") in prompt.split("Text:", 1)[1]
            return json.dumps({"label": "toxic" if hit else "clean"})
        body, _, _ = prompt.rpartition("\n\nWhich segments")
        found = [part for part in re.split(r"\n\n(?=\[\d+\] )", body) if "?" in part]
        return "Here: " + json.dumps({"matches": [{"segment_id": int(part[1 : part.index("]")]), "rq_id": "RQ1", "sub_theme": "asks", "confidence": 1.7, "evidence_span": "?"} for part in found if part.startswith("[")]})


_QUESTIONS = [{"rq_id": "RQ1", "description": "What is asked", "sub_themes": ["asks"]}, {"rq_id": "RQ2", "description": "What is answered"}]
#: What j19_run shows of a segment, by its SQL: a question beyond isn't seen there. j19_report shows segments whole.
_SHOWN = 500


def _extracted(spark, d, most=None):
    segments = segment.segment(inputs.transcripts(spark, d))
    return runs.extract(segments, _QUESTIONS, _Asks(), _scratch(spark), most=most)


@query("j19_run", f"""WITH {inputs.named('turns')}, {_EXTRACTED.split("found AS")[0]} asked AS (SELECT * FROM seg WHERE contains(substr(text, 1, {_SHOWN}), '?'))
    SELECT doc_id, segment_id, 'RQ1' AS rq_id, 'asks' AS sub_theme, 1.0::DOUBLE AS confidence, '?' AS evidence, text, line_start, line_end,
      char_start, char_end, paragraph_index FROM asked""")
def j19_run(spark, d):
    return _extracted(spark, d, _SHOWN)[0]


@query("j19_report", f"""WITH {inputs.named('turns')}, {_EXTRACTED.split("found AS")[0]} asked AS (SELECT * FROM seg WHERE contains(text, '?'))
    SELECT 'batches' AS name, count(*) AS n FROM (SELECT DISTINCT doc_id, (segment_id - 1) // 15 FROM seg) UNION ALL SELECT 'failed', 0
    UNION ALL SELECT 'matches', count(*) FROM asked UNION ALL SELECT 'segments', count(*) FROM asked UNION ALL SELECT 'RQ1', count(*) FROM asked UNION
      ALL SELECT 'RQ2', 0""")
def j19_report(spark, d):
    return runs.extraction_report(*_extracted(spark, d), _QUESTIONS)


_VARIANTS = {"strict": "STRICT toxic or clean? Text: {text}", "open": "Is it toxic?"}


@query("j15_detail", """SELECT doc_id AS id, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '…' ELSE text END AS text, truth, strict, strict
      = truth AS "strict right", open, open = truth AS "open right"
    FROM (SELECT doc_id, text, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS truth, CASE WHEN contains(' ' || text, '  the ') OR contains(text,
      ' the ') THEN 'toxic' ELSE 'clean' END AS strict,
      CASE WHEN contains(text, 'e') THEN 'toxic' ELSE 'clean' END AS open FROM labelled)""", "labelled")
def j15_detail(spark, d):
    """Every labelled document, asked with two prompts."""
    rows = inputs.labelled(spark, d).withColumn("truth", F.when(F.col("toxic") == 1, "toxic").otherwise("clean"))
    found = runs.run_variants(rows, _VARIANTS, _Asks(), ["clean", "toxic"], "doc_id", "text", "truth", _scratch(spark), most=None)
    return runs.variant_detail(found, list(_VARIANTS))


# consensus, triage, export


@query("k1_votes", "SELECT item_id, theme, votes, confidence FROM coded", "coded")
def k1_votes(spark, d):
    return consensus.majority_vote(inputs.codings(spark, d), 3)


@query("k2_agreement", """WITH a AS (SELECT item_id, avg(votes / 3.0) AS a, count(*) AS n FROM votes GROUP BY 1), i AS (SELECT doc_id, coalesce(a,
      1.0) AS a, coalesce(n, 0) AS n FROM documents LEFT JOIN a ON doc_id = item_id)
    SELECT count(*) AS n_items, round(avg(a), 4)::DOUBLE AS agreement, count(*) FILTER (abs(a - 1) < 1e-12) AS n_unanimous, count(*) FILTER (n = 0) AS
      n_uncoded, (SELECT count(*) FROM coded) AS n_consensus_themes FROM i""", "coded")
def k2_agreement(spark, d):
    return consensus.consensus_summary(inputs.items(spark, d), inputs.codings(spark, d), 3)


@query("k3_merge", "SELECT item_id, theme, list_sort(list(coder)) AS triggers, string_agg(coder || ' saw ' || theme, ' | ' ORDER BY coder) AS reasoning FROM codings GROUP BY ALL", "codings")
def k3_merge(spark, d):
    rows = inputs.codings(spark, d).withColumn("triggers", F.array("coder")).withColumn("reasoning", F.concat("coder", F.lit(" saw "), "theme"))
    return consensus.merge_details(rows)


@query("l1_triage", """SELECT doc_id AS item_id, least, CASE WHEN least >= 0.85 THEN 'high' WHEN least >= 0.6 THEN 'medium' ELSE 'low' END AS tier
      FROM documents LEFT JOIN (SELECT item_id, min(confidence) AS least FROM coded GROUP BY 1) ON doc_id = item_id""", "coded")
def l1_triage(spark, d):
    return consensus.triage(inputs.items(spark, d), k1_votes(spark, d))


@query("l2_triage_summary", """SELECT tier, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4)::DOUBLE AS share FROM (SELECT CASE WHEN least >=
      0.85 THEN 'high' WHEN least >= 0.6 THEN 'medium' ELSE 'low' END AS tier
    FROM documents LEFT JOIN (SELECT item_id, min(confidence) AS least FROM coded GROUP BY 1) ON doc_id = item_id) GROUP BY 1""", "coded")
def l2_triage_summary(spark, d):
    return consensus.triage_summary(l1_triage(spark, d))


@query("l3_coding_review", """SELECT c.item_id, theme, coalesce(l.action, 'pending') AS action, CASE l.action WHEN 'rejected' THEN NULL WHEN 'edited'
      THEN l.value ELSE theme END AS final FROM coded c LEFT JOIN last_log l USING (item_id)""", "coded last_log")
def l3_coding_review(spark, d):
    return review.reviewed(k1_votes(spark, d), inputs.action_log(spark, d), ["item_id"], "theme").select("item_id", "theme", "action", "final")


@query("l4_review_stats", """SELECT theme, count(*) AS total, count(*) FILTER (action = 'accepted') AS accepted, count(*) FILTER (action = 'edited')
      AS edited, count(*) FILTER (action = 'rejected') AS rejected, count(*) FILTER (action = 'pending') AS pending
    FROM (SELECT theme, CASE WHEN l.action IS NULL THEN CASE WHEN confidence >= 0.85 THEN 'accepted' ELSE 'pending' END ELSE l.action END AS action
      FROM coded c LEFT JOIN last_log l USING (item_id)) GROUP BY 1""", "coded last_log")
def l4_review_stats(spark, d):
    rows = review.reviewed(k1_votes(spark, d), inputs.action_log(spark, d), ["item_id"], "theme")
    return review.review_stats(review.accept_confident(rows, 0.85), "theme")


@query("m1_excerpts", "SELECT item_id, theme, text, confidence, 'unreviewed' AS status, 'documents' AS source FROM coded JOIN documents ON item_id = doc_id", "coded")
def m1_excerpts(spark, d):
    return consensus.excerpts(inputs.items(spark, d), k1_votes(spark, d), source="documents")


@query("m1_reasons", """SELECT c.item_id, theme, text, confidence, 'unreviewed' AS status, 'documents' AS source, theme || ', ' || lang AS triggers,
      'because' AS reasoning
    FROM coded c JOIN documents ON item_id = doc_id""", "coded")
def m1_reasons(spark, d):
    reasons = _docs(spark, d).select(F.col("doc_id").alias("item_id"), "lang")
    coded = k1_votes(spark, d).join(reasons, "item_id").withColumns({"triggers": F.array("theme", "lang"), "reasoning": F.lit("because")})
    return consensus.excerpts(inputs.items(spark, d), coded, source="documents")


@query("b3_sheets", """SELECT 'excerpts' AS sheet, theme AS a, NULL AS b, count(*) AS n FROM coded JOIN documents ON item_id = doc_id GROUP BY ALL
    UNION ALL SELECT 'cooccurrence', x.theme, y.theme, (SELECT count(*) FROM coded p JOIN coded q USING (item_id) WHERE p.theme = x.theme AND q.theme
      = y.theme)
    FROM (SELECT unnest(['common', 'question', 'digits', 'long']) AS theme) x CROSS JOIN (SELECT unnest(['common', 'question', 'digits', 'long']) AS
      theme) y""", "coded")
def b3_sheets(spark, d):
    """Both sheets of a coding, written and read again."""
    path = _scratch(spark)
    io.save_sheets({"excerpts": m1_excerpts(spark, d), "cooccurrence": m2_cooccurrence(spark, d)}, path)
    excerpts, pairs = (spark.read.parquet(f"{path}/{name}") for name in ("excerpts", "cooccurrence"))
    first = excerpts.groupBy(F.lit("excerpts").alias("sheet"), F.col("theme").alias("a"), F.lit(None).cast("string").alias("b")).agg(F.count("*").alias("n"))
    return first.unionByName(pairs.select(F.lit("cooccurrence").alias("sheet"), F.col("theme_a").alias("a"), F.col("theme_b").alias("b"), "n"))


@query("b2_display", """SELECT doc_id AS id, CASE WHEN quality IS NULL THEN 'pending' ELSE 'labeled' END AS status, quality::VARCHAR AS label,
    CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS text FROM documents LEFT JOIN labels USING (doc_id)""")
def b2_display(spark, d):
    rows = _docs(spark, d).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    status = F.when(F.col("quality").isNull(), "pending").otherwise("labeled")
    return io.annotations_display(rows.select(F.col("doc_id").alias("id"), status.alias("status"), F.col("quality").cast("string").alias("label"), "text"))


@query("b4_markdown", """WITH t AS (SELECT * FROM (VALUES (0, 'common', 'd common'), (1, 'question', 'd question'), (2, 'digits', 'd digits'), (3,
      'long', 'd long'), (4, 'absent', 'd absent')) v(place, theme, description)),
    r AS (SELECT theme, item_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS q, row_number() OVER (PARTITION BY
      theme ORDER BY item_id) AS k FROM coded JOIN documents ON item_id = doc_id),
    m AS (SELECT theme, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM documents), 1)::DOUBLE AS pct, list(q ORDER BY k) FILTER (k <= 3)
      AS quotes FROM r GROUP BY 1),
    l AS (SELECT place AS part, list_concat(['## ' || theme, '', 'Definition: ' || description, '', 'Frequency: ' || coalesce(n, 0) || ' texts (' ||
      coalesce(pct, 0.0)::DOUBLE || '%)', ''],
      flatten(list_transform(coalesce(quotes, []), lambda q: ['> ' || replace(q, chr(10), chr(10) || '> '), ''])), ['Notes:', '']) AS ls FROM t LEFT
      JOIN m USING (theme)
      UNION ALL SELECT -1, ['# Memo', '', 'Texts: ' || (SELECT count(*) FROM documents), 'Themes: 5', ''])
    SELECT part::BIGINT AS part, k::INT - 1 AS k, ls[k] AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS k FROM l)""", "coded")
def b4_markdown(spark, d):
    themes = spark.createDataFrame([(k, t, f"d {t}") for k, t in enumerate((*inputs.THEMES, "absent"))], "place int, theme string, description string")
    return consensus.memo_lines(inputs.items(spark, d), k1_votes(spark, d), themes)


@query("m2_cooccurrence", """WITH t AS (SELECT unnest(['common', 'question', 'digits', 'long']) AS theme), p AS (SELECT a.theme AS theme_a, b.theme AS
      theme_b, count(*) AS n FROM coded a JOIN coded b USING (item_id) GROUP BY ALL)
    SELECT x.theme AS theme_a, y.theme AS theme_b, coalesce(n, 0) AS n FROM t x CROSS JOIN t y LEFT JOIN p ON p.theme_a = x.theme AND p.theme_b =
      y.theme""", "coded")
def m2_cooccurrence(spark, d):
    return consensus.cooccurrence(k1_votes(spark, d), spark.createDataFrame([(t,) for t in inputs.THEMES], "theme string"))


@query("m3_memo", """WITH r AS (SELECT theme, item_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS q,
      row_number() OVER (PARTITION BY theme ORDER BY item_id) AS k FROM coded JOIN documents ON item_id = doc_id)
    SELECT theme, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM documents), 1)::DOUBLE AS "percent", list(q ORDER BY k) FILTER (k <= 3)
      AS quotes FROM r GROUP BY 1""", "coded")
def m3_memo(spark, d):
    return consensus.memo(inputs.items(spark, d), k1_votes(spark, d))


@query("m4_evidence", """SELECT doc_id, p::INT - 1 AS found_at, CASE WHEN p > 0 THEN substr(text, greatest(1, p - 300), least(300, p - 1)) END AS
      "before", CASE WHEN p > 0 THEN substr(text, p, 3) END AS hit,
    CASE WHEN p > 0 THEN substr(text, p + 3, 300) END AS "after" FROM (SELECT doc_id, text, strpos(lower(text), 'the') AS p FROM documents)""")
def m4_evidence(spark, d):
    rows = _docs(spark, d).select("doc_id", "text", F.lit("The").alias("e"))
    return consensus.evidence_context(rows, "text", "e").select("doc_id", "found_at", "before", "hit", "after")


@query("m5_questions", "WITH q AS (SELECT unnest(['common', 'question', 'digits', 'long', 'none']) AS rq_id) SELECT rq_id, count(item_id) AS matches, count(DISTINCT item_id) AS segments FROM q LEFT JOIN codings ON rq_id = theme GROUP BY 1", "codings")
def m5_questions(spark, d):
    questions = spark.createDataFrame([(t,) for t in (*inputs.THEMES, "none")], "rq_id string")
    found = inputs.codings(spark, d).select(F.col("theme").alias("rq_id"), F.col("item_id").alias("segment_id"))
    return consensus.question_distribution(questions, found)


# TF-IDF


@query("p1_tfidf", f"WITH src AS (SELECT doc_id AS id, text FROM documents), {_WEIGHTS} SELECT id, term, round(weight, 6)::DOUBLE AS weight FROM weights")
def p1_tfidf(spark, d):
    return tfidf.tfidf(_docs(spark, d), "doc_id", "text").withColumn("weight", F.round("weight", 6))


@query("p2_themes")
def p2_themes(spark, d):
    return themes.suggest_themes(_docs(spark, d), "doc_id", "text")


@query("p4_overlap", f"""WITH src AS (SELECT item_id AS id, text FROM benchmark), {_WEIGHTS} SELECT * FROM (SELECT a.id AS a, b.id AS b, round(100 *
      sum(a.weight * b.weight), 1)::DOUBLE AS overlap FROM weights a JOIN weights b USING (term) WHERE a.id < b.id GROUP BY ALL) WHERE overlap > 10""")
def p4_overlap(spark, d):
    return tfidf.overlaps(tfidf.tfidf(table(spark, d, "benchmark"), "item_id", "text"), 10.0)


# feeds of charts


@query("r1_confusion_shares", "SELECT a, b, round(n / sum(n) OVER (PARTITION BY a), 4)::DOUBLE AS share FROM (SELECT truth AS a, predicted AS b, count(*) AS n FROM predicted GROUP BY ALL)", "predicted")
def r1_confusion_shares(spark, d):
    return consensus.normalised_confusion(agreement.pair_counts(inputs.predicted(spark, d), "truth", "predicted"))


@query("r2_distributions", "SELECT coalesce(t.l, p.l) AS label, coalesce(t.n, 0) AS n_true, coalesce(p.n, 0) AS n_predicted FROM (SELECT truth AS l, count(*) AS n FROM predicted GROUP BY 1) t FULL JOIN (SELECT predicted AS l, count(*) AS n FROM predicted GROUP BY 1) p ON t.l = p.l", "predicted")
def r2_distributions(spark, d):
    m = agreement.label_margins(agreement.pair_counts(inputs.predicted(spark, d), "truth", "predicted"))
    return m.select("label", F.col("r").alias("n_true"), F.col("c").alias("n_predicted"))


@query("r3_histogram", "SELECT least(floor(confidence * 20), 19)::INT AS bin, count(*) AS n FROM codings GROUP BY 1", "codings")
def r3_histogram(spark, d):
    return consensus.confidence_histogram(inputs.codings(spark, d), "confidence")


@query("r3_median", "SELECT count(confidence) AS n, round(median(confidence), 4)::DOUBLE AS median, round(avg(confidence), 4)::DOUBLE AS mean FROM codings", "codings")
def r3_median(spark, d):
    return consensus.confidence_summary(inputs.codings(spark, d), "confidence")


# reports of several operators


@query("c7_confirm", """WITH c AS (SELECT max(n) / min(n) AS r FROM (SELECT count(*) AS n FROM labelled GROUP BY quality)), l AS (SELECT
      count(DISTINCT quality) AS k FROM labelled)
    SELECT 'imbalance' AS "check", r AS value FROM c WHERE r > 5 UNION ALL SELECT 'one_label', k::DOUBLE FROM l WHERE k < 2""", "labelled")
def c7_confirm(spark, d):
    return profile.confirm_columns(inputs.labelled(spark, d), "text", "quality")


@query("c10_bridge", "SELECT text FROM turns LEFT JOIN last_log ON k = item_id WHERE coalesce(action, 'pending') <> 'rejected'", "turns last_log")
def c10_bridge(spark, d):
    """Segments that a review didn't reject go on as texts; a number of a segment has one review in all documents."""
    segments = segment.segment(inputs.transcripts(spark, d)).withColumnRenamed("segment_id", "item_id")
    kept = review.reviewed(segments, inputs.action_log(spark, d), ["item_id"], "text").where("action != 'rejected'")
    return kept.select("text")


@query("d5_report", f"""WITH p AS (SELECT a AS x, b AS y FROM coders_wide), {_MARGINS},
    s AS (SELECT sum(tp) / max(n) AS po, sum(r * c) / (max(n)::DOUBLE * max(n)) AS pe FROM m, n)
    SELECT 'kappa' AS metric, round({_KAPPA}, 4)::DOUBLE AS value FROM s UNION ALL SELECT 'specific:' || label, round(tp / (r + c - tp), 4)::DOUBLE
      FROM m""", "coders_wide")
def d5_report(spark, d):
    margins = agreement.label_margins(agreement.pair_counts(inputs.coders_wide(spark, d), "a", "b"))
    kappa = agreement.kappa_of(margins).select(F.lit("kappa").alias("metric"), F.col("kappa").alias("value"))
    return kappa.unionByName(agreement.per_category(margins).select(F.concat(F.lit("specific:"), "category").alias("metric"), F.col("specific").alias("value")))


@query("d7_multilabel", f"""WITH {_SETS}, z AS (SELECT a.item_id, x, y, list_intersect(x, y) AS w FROM s a),
    j AS (SELECT 'x' AS coder_a, 'y' AS coder_b, x AS p, y AS q FROM z UNION ALL SELECT 'x', 'z', x, w FROM z UNION ALL SELECT 'y', 'z', y, w FROM z)
    SELECT coder_a, coder_b, round(avg(CASE WHEN len(p) + len(q) = 0 THEN 1.0 ELSE len(list_intersect(p, q)) / len(list_distinct(list_concat(p, q)))
      END), 4)::DOUBLE AS jaccard FROM j GROUP BY ALL""", "theme_long")
def d7_multilabel(spark, d):
    sets = inputs.theme_sets(spark, d).withColumn("z", F.array_intersect("x", "y"))
    pair = lambda a, b: F.struct(F.lit(a).alias("coder_a"), F.lit(b).alias("coder_b"), F.col(a).alias("p"), F.col(b).alias("q"))
    long = sets.select(F.explode(F.array(pair("x", "y"), pair("x", "z"), pair("y", "z"))).alias("v")).select("v.*")
    return agreement.mean_jaccard(long, "p", "q", ("coder_a", "coder_b")).select("coder_a", "coder_b", "jaccard")


@query("e6_languages", "SELECT count(DISTINCT lang)::INT AS n_languages FROM documents")
def e6_languages(spark, d):
    found = profile.distribution(_docs(spark, d), "lang")
    return found.agg(F.count("*").cast("int").alias("n_languages"))


@query("e6_detected")
def e6_detected(spark, d):
    return profile.detect_languages(_docs(spark, d), "text", lambda t: "en" if " the " in t else "other", "doc_id")


@query("e11_report")
def e11_report(spark, d):
    rows = profile.diagnostics(_docs(spark, d), "text", "lang").collect()
    return spark.createDataFrame([(profile.report_text(rows),)], "report string")


@query("f6_interval")
def f6_interval(spark, d):
    low, high = advise.bootstrap_interval(spark, advise.PRIORS["simple_binary"], 0.8)
    return spark.createDataFrame([(low, high)], "low long, high long")


@query("j14_variants", "SELECT 0 AS k, 'Judge {text}' AS template UNION ALL SELECT 1, 'Weigh {text}'")
def j14_variants(spark, d):
    made = prompting.generate_variants(completion.TableProvider({"Judge": "Weigh {text}"}), "Judge {text}")
    return spark.createDataFrame(list(enumerate(made)), "k int, template string")


@query("j20_questions", "SELECT 'RQ1' AS rq_id, 'How?' AS description, ['a', 'b', 'c'] AS sub_themes UNION ALL SELECT 'RQ2', 'Why?', []")
def j20_questions(spark, d):
    return prompting.questions_table(spark, prompting.parse_questions("RQ1: How?\n- a, b\n- c\n\nRQ2：Why?"))


@query("j21_local_classifier")
def j21_local_classifier(spark, d):
    rows = inputs.labelled(spark, d).select("doc_id", "text", F.col("toxic").cast("string").alias("label"))
    fit, held = training.stratified_split(rows, "label", "doc_id")
    found = training.predict(training.train(fit, "text", "label"), held, "text", "label")
    return agreement.evaluate(agreement.label_margins(agreement.pair_counts(found, "label", "predicted"))).drop("tp")


@query("j21_split", """WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1) SELECT lang, n - CASE WHEN n > 1 THEN greatest(1, floor(n *
      0.2)) ELSE 0 END::BIGINT AS fit,
    CASE WHEN n > 1 THEN greatest(1, floor(n * 0.2)) ELSE 0 END::BIGINT AS held FROM n""")
def j21_split(spark, d):
    fit, held = training.stratified_split(_docs(spark, d), "lang", "doc_id")
    both = fit.select("lang", F.lit(1).alias("f"), F.lit(0).alias("h")).unionAll(held.select("lang", F.lit(0), F.lit(1)))
    return both.groupBy("lang").agg(F.sum("f").alias("fit"), F.sum("h").alias("held"))


@query("k4_coders", """SELECT doc_id AS item_id, count(*) AS votes FROM (SELECT doc_id FROM documents WHERE contains(text, ' the ') UNION ALL SELECT
      doc_id FROM documents WHERE contains(text, ' of ')) GROUP BY 1""")
def k4_coders(spark, d):
    said = '{"themes": [{"name": "english", "confidence": 0.9}]}'
    coders = {"a": completion.TableProvider({" the ": said}), "b": completion.TableProvider({" of ": said})}
    docs = _docs(spark, d).select(F.col("doc_id").alias("item_id"), "text")
    found = prompting.code_by_all(docs, coders, [{"name": "english", "description": ""}])
    return consensus.votes(found).select("item_id", "votes")


@query("l4_export", """SELECT item_id, theme, action, CASE action WHEN 'edited' THEN value ELSE theme END AS final FROM (
    SELECT c.item_id, theme, value, CASE WHEN l.action IS NULL THEN 'pending' ELSE l.action END AS action FROM coded c LEFT JOIN last_log l USING
      (item_id)) WHERE action <> 'rejected'""", "coded last_log")
def l4_export(spark, d):
    return review.reviewed(k1_votes(spark, d), inputs.action_log(spark, d), ["item_id"], "theme").where("action <> 'rejected'").select("item_id", "theme", "action", "final")


@query("m2_wide", """WITH t AS (SELECT unnest(['common', 'question', 'digits', 'long']) AS theme_a), p AS (SELECT a.theme AS theme_a, b.theme AS b,
      count(*) AS n FROM coded a JOIN coded b USING (item_id) GROUP BY ALL)
    SELECT theme_a, coalesce(sum(n) FILTER (b = 'common'), 0)::BIGINT AS common, coalesce(sum(n) FILTER (b = 'question'), 0)::BIGINT AS question,
      coalesce(sum(n) FILTER (b = 'digits'), 0)::BIGINT AS digits,
    coalesce(sum(n) FILTER (b = 'long'), 0)::BIGINT AS "long" FROM t LEFT JOIN p USING (theme_a) GROUP BY 1""", "coded")
def m2_wide(spark, d):
    return consensus.cooccurrence_wide(k1_votes(spark, d), list(inputs.THEMES))


@query("b6_log", f"""WITH {_EVAL}, k AS (SELECT sum(tp) / max(n) AS po, sum(r * c) / (max(n)::DOUBLE * max(n)) AS pe FROM m, n)
    SELECT unnest([{{'name': 'n_samples', 'value': max(total)::DOUBLE}},
      {{'name': 'n_classes', 'value': (SELECT count(DISTINCT predicted) FROM predicted)::DOUBLE}},
      {{'name': 'accuracy', 'value': round(sum(tp) / max(total), 4)::DOUBLE}},
      {{'name': 'macro_f1', 'value': round(avg(f1), 4)::DOUBLE}},
      {{'name': 'weighted_f1', 'value': round(sum(f1 * support) / sum(support), 4)::DOUBLE}},
      {{'name': 'cohens_kappa', 'value': (SELECT round({_KAPPA}, 4)::DOUBLE FROM k)}}], recursive := true) FROM e""", "predicted")
def b6_log(spark, d):
    """The numbers of a run's log, written and read again."""
    io.save_log(spark, methods.quantitative_log(inputs.predicted(spark, d), "predicted", "truth"), path := _scratch(spark))
    log = io.load_log(spark, path)
    return spark.createDataFrame([(k, float(v)) for k, v in log.items() if isinstance(v, (int, float))], "name string, value double")


@query("n1_methods")
def n1_methods(spark, d):
    """Of a classification and of a coding, whose figures come from the tables."""
    spans = pii.coverage(pii.detect(_docs(spark, d), kinds=("EMAIL",))).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    reviewed = review.reviewed(k1_votes(spark, d), inputs.action_log(spark, d), ["item_id"], "theme")
    logs = [
        methods.quantitative_log(inputs.predicted(spark, d), "predicted", "truth", classification_method="few-shot"),
        methods.qualitative_log(reviewed, "item_id", "theme", "action", deidentification_performed=True, n_pii_detected=spans),
    ]
    return spark.createDataFrame([(log["pipeline"], lang, methods.methods_text(log, lang)) for log in logs for lang in ("en", "zh")], "pipeline string, language string, text string")
