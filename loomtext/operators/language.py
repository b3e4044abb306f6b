"""Language identification by character trigrams, learned from the languages that a corpus states.

A text's letters, in lower case, with one space for every run of anything else and at both ends, give its trigrams.
Training counts them by language. A language gives a trigram the weight floor(1000 ln((n + 1) / (total + kinds))), n
its count in the language, total that of all trigrams there and kinds the number of distinct trigrams; the language
with the largest sum over a text is the text's, the first by name among equals. Weights are whole numbers, so that sums
don't depend on their order.

The model keeps the ``kept`` most frequent trigrams of each language with their weights in all of them; others say
nothing. That bounds it by kept * languages ** 2 numbers, whatever the corpus, so tasks may hold it. Texts are counted
and scored in numpy, an Arrow batch at a time and each text by itself; counts are added up in the task before they are
shuffled by (language, trigram).

Texts without letters have no language. Rows whose language is null or blank don't train; ids may be null or repeated.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank

#: Distinct trigrams of a task that it holds at most before it emits their counts.
MOST_HELD = 500_000


def letters(text: Column) -> Column:
    """Lower-case letters with single spaces for all else, and at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " ")), F.lit(" "))


def trigrams(text: str) -> np.ndarray:
    """Each trigram as one number of 63 bits."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return (code[:-2] << 42) | (code[1:-1] << 21) | code[2:] if len(code) > 2 else np.zeros(0, np.int64)


@dataclass
class Model:
    """Weights of known trigrams (sorted) by language (sorted)."""

    languages: list[str]
    known: np.ndarray
    weights: np.ndarray  # trigrams by languages

    def scores(self, prepared: str) -> np.ndarray:
        """The sum of each language for a text that letters() has prepared."""
        found = trigrams(prepared)
        at = np.minimum(np.searchsorted(self.known, found), max(0, len(self.known) - 1))
        at = at[self.known[at] == found] if len(self.known) else at[:0]
        return np.bincount(at, minlength=len(self.known)) @ self.weights if len(at) else np.zeros(len(self.languages), np.int64)

    def best(self, prepared: str) -> tuple[str | None, int | None]:
        """The language and how far its sum is ahead of the next one."""
        if not self.languages or not prepared.strip():
            return None, None
        sums = self.scores(prepared)
        first = int(np.argmax(sums))
        rest = np.delete(sums, first)
        return self.languages[first], int(sums[first] - rest.max()) if len(rest) else 0


def counts(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n) over the rows that state a language."""
    rows = df.where(~is_blank(F.col(lang_col))).select(F.col(lang_col).alias("lang"), letters(F.col(text_col)).alias("text"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[str, int]] = Counter()

        def flushed() -> pa.RecordBatch:
            lang, gram = zip(*held) if held else ((), ())
            columns = [pa.array(lang, pa.string()), pa.array(gram, pa.int64()), pa.array(list(held.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                grams, n = np.unique(trigrams(text.as_py()), return_counts=True)
                lang = lang.as_py()
                for gram, k in zip(grams.tolist(), n.tolist()):
                    held[lang, gram] += k
                if len(held) > MOST_HELD:
                    yield flushed()
                    held.clear()
        yield flushed()

    return rows.mapInArrow(walk, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", kept: int = 2000, counted: Callable[[DataFrame], DataFrame] | None = None) -> Model:
    """A model of the languages in lang_col. counted may keep the counts, which are read three times: a checkpoint, say."""
    n = (counted or (lambda x: x))(counts(df, text_col, lang_col))
    totals = {r["lang"]: r["total"] for r in n.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    kinds = n.select("gram").distinct().count()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    frequent = n.withColumn("place", place).where(F.col("place") <= kept).select("gram").distinct()
    rows = n.join(F.broadcast(frequent), "gram", "left_semi").collect()  # kept * languages ** 2 at most
    languages, known = sorted(totals), np.unique(np.array([r["gram"] for r in rows], np.int64))
    found = np.zeros((len(known), len(languages)))
    if rows:
        at = np.searchsorted(known, [r["gram"] for r in rows])
        found[at, [languages.index(r["lang"]) for r in rows]] = [r["n"] for r in rows]
    of = np.array([totals[lang] for lang in languages], float) + kinds
    return Model(languages, known, np.floor(1000 * np.log((found + 1) / of)).astype(np.int64) if rows else np.zeros((0, len(languages)), np.int64))


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, language, margin) of every row; null for texts without letters."""
    rows = df.select(F.col(id_col).alias("id"), letters(F.col(text_col)).alias("text"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            language, margin = zip(*[model.best(t.as_py()) for t in batch.column(1)]) if len(batch) else ((), ())
            columns = [batch.column(0), pa.array(language, pa.string()), pa.array(margin, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "language", "margin"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(walk, f"id {kind}, language string, margin long").withColumnRenamed("id", id_col)


def distribution(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(language, n): of how many texts each is the language."""
    found = identify(df.withColumn("__row", F.lit(0)), model, "__row", text_col)
    return found.where("language is not null").groupBy("language").agg(F.count("*").alias("n"))


def main_language(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(language, share, multilingual): the most frequent one, the first by name among equals; multilingual if several
    occur and its share is below 0.9. No text with letters: English, not multilingual."""
    n = distribution(df, model, text_col).agg(
        F.min_by("language", F.struct(-F.col("n"), "language")).alias("language"), F.max("n").alias("n"), F.sum("n").alias("total"), F.count("*").alias("kinds")
    )
    share = F.col("n") / F.col("total")
    return n.select(
        F.coalesce("language", F.lit("en")).alias("language"), F.round(share, 4).alias("share"),
        F.coalesce((F.col("kinds") > 1) & (share < 0.9), F.lit(False)).alias("multilingual"),
    )
