"""De-identification: detection, overlap removal, consistent replacement, rewriting and review.

Detection and rewriting walk each text once, in Arrow batches, so their work grows with the text's length. Patterns may
be joined by detectors, such as models that recognise names. Only the numbering of placeholders shuffles: distinct
spans, in ranges of their order, so that no task holds all of a type. Numbers run in the order texts are met and, within
a text, from right to left, as spans are replaced.

Spans belong to a text: they carry its id and a digest of it (text_key), and texts are rewritten by both, null-safely. So
rows without an id, and rows that share one, each get their own spans; rows that share an id and a text get the same. A
review without text_key applies to all texts of an id.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ..functions.batches import in_slices
from ..session import materialised
from .review import reviewed

#: Finds spans of a text: (start, end, type, confidence), in code points. It runs in the workers, so it must pickle;
#: one that holds a model loads it on its first call.
Detector = Callable[[str], Iterable[tuple[int, int, str, float]]]

#: The hundred most frequent Chinese surnames; a parameter, for lists of any length.
SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许韩邓冯曹彭曾肖田董潘袁蔡蒋余于杜叶程魏苏吕丁任卢姚沈钟姜崔谭陆范汪廖石金韦贾夏付方邹熊白孟秦邱侯江尹薛闫段雷龙黎史陶贺毛郝顾龚邵万覃武钱戴严莫孔向常"
#: Patterns of personal data, in the order in which they are tried.
HONORIFICS = "先生|女士|老师|教授|医生|博士|同志|大爷|大妈|阿姨|叔叔|大哥|大姐|小姐|同学|师傅"
PATTERNS = {
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "PHONE": r"(?:(?:\+?86[-\s]?)?1[3-9]\d{9}|(?:0\d{2,3}[-\s]?)?\d{7,8}|(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}(?:\s*(?:ext|x|extension)\s*\d{1,5})?)",
    "URL": r"""https?://[^\s<>"']+|www\.[^\s<>"']+""",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "IP_ADDRESS": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "PERSON": None,  # made from the surnames
    "ID_CARD": r"\b\d{6}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]\b",
}
PREFIXES = {"PERSON": "NAME", "IP_ADDRESS": "IP"}
CATEGORIES = {"ORG": "ORGANIZATION"}


def pattern(kind: str, surnames: str = SURNAMES) -> str:
    found = PATTERNS[kind]
    if found is None:
        found = rf"(?:[{surnames}][一-鿿]{{0,2}}(?:{HONORIFICS})|(?:老|小|阿)[{surnames}]|[A-Z][a-z]+(?:\s[A-Z][a-z]+)+)"
    return found


def _confidence(kind: str) -> float:
    return 0.88 if kind == "PERSON" else 0.95


class PatternDetector:
    """All matches of one kind's pattern."""

    def __init__(self, kind: str, surnames: str = SURNAMES):
        self.kind, self.pattern = kind, re.compile(pattern(kind, surnames))

    def __call__(self, text: str) -> Iterator[tuple[int, int, str, float]]:
        return ((*m.span(), self.kind, _confidence(self.kind)) for m in self.pattern.finditer(text))


def without_overlaps(found: Iterable[tuple]) -> Iterator[tuple]:
    """Keeps a span, by start and then order of detection, if it starts where the last kept one ends, or later."""
    at = 0
    for span in sorted(found, key=lambda s: s[0]):
        if span[0] >= at:
            at = span[1]
            yield span


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; null for null."""
    return F.unhex(F.md5(text))


def detect(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[str, ...] = tuple(PATTERNS), surnames: str = SURNAMES, detectors: tuple[Detector, ...] = ()
) -> DataFrame:
    """(text_id, text_key, start, end, span, type, confidence): kept spans, a row each. Patterns come before detectors.
    Null and empty texts have no spans; neither do detected ranges that are empty or outside the text."""
    rows = df.select(F.col(id_col).alias("text_id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("t"))
    own = {"start": IntegerType(), "end": IntegerType(), "span": StringType(), "type": StringType(), "confidence": DoubleType()}
    fields = [rows.schema[0], rows.schema[1], *[StructField(name, kind) for name, kind in own.items()]]
    all_of = (*[PatternDetector(kind, surnames) for kind in kinds], *detectors)
    arrow = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64())
    names = [f.name for f in fields]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            owners, made = [], []
            for i, value in enumerate(batch.column(2)):
                text = value.as_py() or ""
                for a, b, kind, confidence in without_overlaps(s for d in all_of for s in d(text) if 0 <= s[0] < s[1] <= len(text)):
                    owners.append(i)
                    made.append((a, b, text[a:b], kind, confidence))
            columns = [pa.array([row[k] for row in made], kind) for k, kind in enumerate(arrow)]
            at = pa.array(owners, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], names=names)

    return rows.mapInArrow(walk, StructType(fields))


def name_replacements(found: DataFrame, strategy: str = "placeholder") -> DataFrame:
    """found with replacement. Equal spans (lower-cased, stripped) of a type share theirs, across texts."""
    if strategy == "redact":
        return found.withColumn("replacement", F.lit("[REDACTED]"))
    if strategy == "category":
        return found.withColumn("replacement", F.concat(F.lit("["), _named("type", CATEGORIES), F.lit("]")))
    if strategy != "placeholder":
        raise ValueError(f"unknown strategy {strategy!r}")
    keyed = found.withColumn("key", F.trim(F.lower("span")))
    first = keyed.groupBy("type", "key").agg(F.min(F.struct("text_id", -F.col("start"))).alias("seen"))
    numbered = in_order(first, "type", ["seen", "key"]).drop("seen")
    token = F.concat(F.lit("["), _named("type", PREFIXES), F.lit("_"), F.col("n"), F.lit("]"))
    return keyed.join(numbered, ["type", "key"]).withColumn("replacement", token).drop("n", "key")


def in_order(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """rows with n, their number from 1 among those of the same value of by. Each range of the order is numbered by
    itself and starts where the ones before it end."""
    placed = materialised(rows.repartitionByRange(by, *order).withColumn("__part", F.spark_partition_id()))
    before = Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(by, "__part").agg(F.count("*").alias("__n"))  # a row for each range and value of by
    starts = starts.select(by, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy(by, "__part").orderBy(*order))
    return placed.withColumn("n", place).join(F.broadcast(starts), [by, "__part"]).withColumn("n", F.col("n") + F.col("__start")).drop("__part", "__start")


def _named(column: str, names: dict[str, str]) -> Column:
    out = F.col(column)
    for kind, name in names.items():
        out = F.when(F.col(column) == kind, name).otherwise(out)
    return out


def replaced(text: str, spans: Iterable[tuple[int, int, str | None]]) -> str:
    """text with spans replaced, from left to right; a null replacement leaves the span."""
    out, at = [], 0
    for a, b, new in sorted(spans, key=lambda s: s[:2]):
        out += [text[at:a], text[a:b] if new is None else new]
        at = b
    return "".join([*out, text[at:]])


def rewritten(df: DataFrame, replacements: DataFrame, key: Column, text_col: str = "text") -> DataFrame:
    """df with its texts' spans replaced, row for row, and all other columns as they are. replacements name the text by
    key, as text_id, and text_key; a null replacement leaves the span."""
    span = F.struct("start", "end", "replacement")
    spans = replacements.groupBy(F.col("text_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.collect_set(span).alias("__spans"))
    same = key.eqNullSafe(F.col("__id")) & (text_key(F.col(text_col)) == F.col("__key"))
    rows = df.join(spans, same, "left").select(*[df[c] for c in df.columns], "__spans")
    at = df.columns.index(text_col)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            columns, made = batch.columns, []
            for text, found in zip(columns[at], columns.pop()):
                text, found = text.as_py(), found.as_py()
                made.append(replaced(text, [(s["start"], s["end"], s["replacement"]) for s in found]) if found else text)
            columns[at] = pa.array(made, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return rows.mapInArrow(walk, df.schema)


def rewrite(df: DataFrame, replacements: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text_id, text): texts with their spans replaced; a null replacement leaves the span."""
    rows = df.select(F.col(id_col).alias("text_id"), F.col(text_col).alias("text"))
    return rewritten(rows, replacements, F.col("text_id"))


def apply_review(df: DataFrame, replacements: DataFrame, log: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text_id, text): the originals with the reviewed replacements. log: (text_id, start, seq, action, value), and
    text_key where ids are shared. Pending and accepted spans take their replacement, edited ones the value, and rejected
    ones stay as they are."""
    keys = ["text_id", "start", *[c for c in ("text_key",) if c in log.columns]]
    rows = reviewed(replacements, log, keys, "replacement")
    return rewrite(df, rows.withColumn("replacement", F.col("final")), id_col, text_col)


def rewrite_segments(
    segments: DataFrame, strategy: str = "placeholder", keys: tuple[str, ...] = ("doc_id", "segment_id"), text_col: str = "text", **parameters
) -> DataFrame:
    """segments with their texts de-identified, row for row, all other columns as they are. keys name a segment; they may
    be null and repeated."""
    keyed = segments.withColumn("__segment", F.struct(*keys))
    found = name_replacements(detect(keyed, "__segment", text_col, **parameters), strategy)
    return rewritten(segments, found, F.struct(*keys), text_col)


def coverage(found: DataFrame) -> DataFrame:
    return found.groupBy("type").agg(F.count("*").alias("n"))


def correspondence(replacements: DataFrame) -> DataFrame:
    """(replacement, span, type, n): what each token stands for."""
    return replacements.groupBy("replacement", "span", "type").agg(F.count("*").alias("n"))
