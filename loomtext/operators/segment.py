"""Position-tracked segments of documents: paragraphs, sentences and windows of sentences.

A text is walked once, in Arrow batches: pieces come as ranges, line breaks and paragraphs are found by bisection, so
the work grows with the text's length and not with its square. Nothing shuffles. Offsets count code points from 0,
half open; lines count from 1, paragraphs from 0. Null and blank texts have no segments.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

Range = tuple[int, int]

#: A paragraph: lines up to a blank one.
PARAGRAPH = re.compile(r"[^\n]+(?:\n(?!\s*?\n)[^\n]*)*")
#: Where sentences end, first by enders of both scripts and ellipses, else by an ender before white space.
SENTENCE = re.compile(r"""(?<=[。！？!?])(?:\s*(?=[^。！？!?\s）\)」』"'])|$)|(?<=\.{3})\s+|(?<=……)\s*""")
SENTENCE_SIMPLE = re.compile(r"(?<=[。！？.!?])\s+(?=\S)")
LINE = re.compile(r"\n")
#: Segments in an Arrow batch.
ROWS = 5_000


def paragraphs_of(text: str) -> list[Range]:
    return [m.span() for m in PARAGRAPH.finditer(text)]


def between(text: str, cut: re.Pattern) -> list[Range]:
    """The ranges that the matches of cut leave."""
    cuts = [m.span() for m in cut.finditer(text)]
    return list(zip([0, *[b for _, b in cuts]], [*[a for a, _ in cuts], len(text)], strict=True))


def stripped(text: str, a: int, b: int) -> Range:
    piece = text[a:b]
    a += len(piece) - len(piece.lstrip())
    return a, a + len(piece.strip())


def sentences_of(text: str) -> list[Range]:
    """Ranges of stripped sentences, cut by the first of three patterns that cuts at all."""
    found = next((x for x in (between(text, cut) for cut in (SENTENCE, SENTENCE_SIMPLE, LINE)) if len(x) > 1), [(0, len(text))])
    return [(a, b) for a, b in (stripped(text, *x) for x in found) if a < b]


class Places:
    """Line and paragraph of an offset."""

    def __init__(self, text: str):
        self.breaks = [m.start() for m in LINE.finditer(text)]
        self.paragraphs = paragraphs_of(text)
        self.starts = [a for a, _ in self.paragraphs]

    def of(self, a: int, b: int) -> tuple[int, int, int, int, int]:
        """line_start, line_end, char_start, char_end, paragraph_index; from a gap, the last paragraph."""
        k = bisect_right(self.starts, a) - 1
        if k < 0 or a >= self.paragraphs[k][1]:
            k = max(0, len(self.starts) - 1)
        return bisect_left(self.breaks, a) + 1, bisect_left(self.breaks, max(a, b - 1)) + 1, a, b, k


def pieces(text: str, mode: str, window: int) -> Iterator[tuple]:
    """Rows of segment() without the id."""
    places = Places(text)
    if mode != "context_window":
        found = sentences_of(text) if mode == "sentence" else places.paragraphs
        for k, (a, b) in enumerate(found, 1):
            if clean := text[a:b].strip():
                yield k, clean, *places.of(a, b)
        return
    cores, k, met = sentences_of(text), 0, None
    for i, core in enumerate(cores):
        around = cores[max(0, i - window)][0], cores[min(len(cores) - 1, i + window)][1]
        if around == met:  # near the ends of a text windows repeat
            continue
        met, k, clean = around, k + 1, text[slice(*around)].strip()
        yield k, clean, *places.of(*around), text[slice(*core)], max(0, core[0] - around[0]), min(len(clean), core[1] - around[0])


_POSITION = ("line_start", "line_end", "char_start", "char_end", "paragraph_index")


def _schema(id_field: StructField, mode: str) -> StructType:
    out = [id_field, StructField("segment_id", IntegerType()), StructField("text", StringType()), *[StructField(n, IntegerType()) for n in _POSITION]]
    if mode == "context_window":
        out += [StructField("core_sentence", StringType()), StructField("core_start", IntegerType()), StructField("core_end", IntegerType())]
    return StructType(out)


def segment(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mode: str = "paragraph", window: int = 2) -> DataFrame:
    """(id, segment_id, text, line_start, line_end, char_start, char_end, paragraph_index), and for windows
    core_sentence, core_start, core_end. mode: paragraph (also for unknown names), sentence, context_window.
    Rows that repeat an id are segmented each by itself."""
    rows = df.select(F.col(id_col).alias(id_col), F.col(text_col).alias("__t"))
    schema = _schema(rows.schema[0], mode)
    names = schema.names
    kinds = [pa.string() if isinstance(f.dataType, StringType) else pa.int32() for f in schema.fields[1:]]

    def batch_of(ids: pa.Array, owners: list[int], made: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, kind) for c, kind in zip(zip(*made, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(owners, pa.int64())), *columns], names=names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, owners, made = batch.column(0), [], []
            for i, text in enumerate(batch.column(1)):
                for row in pieces(text.as_py() or "", mode, window):
                    owners.append(i)
                    made.append(row)
                    if len(made) == ROWS:
                        yield batch_of(ids, owners, made)
                        owners, made = [], []
            if made:
                yield batch_of(ids, owners, made)

    return rows.mapInArrow(walk, schema)


def preview(segments: DataFrame, most: int = 120) -> DataFrame:
    """segments with the text cut and its ranges as text."""
    cut = F.when(F.length("text") > most, F.concat(F.substring("text", 1, most), F.lit("..."))).otherwise(F.col("text"))
    return segments.withColumn("text", cut).withColumn("lines", F.concat_ws("-", "line_start", "line_end")).withColumn("chars", F.concat_ws("-", "char_start", "char_end"))


def lookup(segments: DataFrame, segment_id: int) -> DataFrame:
    return segments.where(F.col("segment_id") == segment_id)
