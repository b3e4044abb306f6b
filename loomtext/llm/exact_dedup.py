"""Exact dedup: a log-structured merge index of text digests, in DataFrame operations only.

Rows are dealt into memtables by a hash of their id. Each memtable is flushed as a sorted run of
``(digest, smallest id, largest id, count)``, written to the shared folder. Compaction merges the runs and keeps the
smallest and the largest identifier of each digest. A bitmap filter over the digests that occur more than once decides
which texts are looked at again: only these hits are compared byte for byte.

Scale: flush and compaction aggregate map-side before they shuffle some 60 bytes a digest. The comparison is a
minimum and a maximum of the text by digest, both partial before the shuffle, so a group of a third of all rows leaves
each task as one row. Digests that hold more than 1/``HOT`` of all rows (fewer than ``HOT`` of them, by their
definition) meet the rows by broadcast, the rest by a shuffle in which no key holds more than that share. The filter's
size follows the number of repeated digests, up to 32 MB (33 million at eight bits each): where it fills up, more texts
are compared, never fewer.

Defined cases: a null text counts as empty; empty texts are equal to each other. Of equal texts the row with the
largest (or smallest) id stays. Rows that repeat an id are each returned and counted, and are kept together. An empty
table gives an empty result; extra columns are ignored. A row with a null id is counted in its group and isn't the one
that stays while another has an id; of a group without ids keep_id is null. A row without an id is never kept: kept is false.
Texts that share a digest but not their bytes (only possible with a weak ``digest``) are grouped again by their bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmap import LEAST, bitmap, bits_for, maybe
from .common import ascii_lower, deleted, only, written

HOT = 10_000


def sha256(c: Column) -> Column:
    return F.unhex(F.sha2(c.cast("binary"), 256))


class DigestIndex:
    """Sorted runs of digests; ``flush`` adds runs, ``compact`` merges them, ``filter`` tests membership."""

    def __init__(self, memtables: int = 4):
        self.memtables, self.filter_bits, self.runs = memtables, LEAST, []

    def flush(self, rows: DataFrame) -> None:
        """rows: (id, digest). Each memtable becomes a run, sorted by digest."""
        rows = rows.withColumn("run", F.pmod(F.xxhash64("id"), F.lit(self.memtables)).cast("int"))
        run = rows.groupBy("run", "digest").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n"))
        self.runs.append(written(run.sortWithinPartitions("run", "digest"), "run", "run"))

    def compact(self) -> DataFrame:
        """One run from all: each digest once, with its smallest and largest id and its count."""
        if not self.runs:
            raise ValueError("nothing was flushed")
        merged = self.runs[0]
        for run in self.runs[1:]:
            merged = merged.unionByName(run)
        merged = merged.groupBy("digest").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
        old = self.runs
        self.runs = [written(merged.withColumn("run", F.lit(0)).sortWithinPartitions("digest"), "level")]
        deleted(*old)
        return self.runs[0].drop("run")

    def filter(self, digests: DataFrame) -> DataFrame:
        """(page, bits): a bitmap over hashes of the digests, a written table; eight bits a digest, up to 32 MB."""
        self.filter_bits = bits_for(digests.count())
        return written(bitmap(digests, "digest", self.filter_bits), "filter")

    def maybe(self, rows: DataFrame, kept: DataFrame) -> DataFrame:
        """The rows whose digest may be in the set that kept is the latest filter of."""
        return maybe(rows, "digest", kept, self.filter_bits)


def exact_dedup(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "largest",
    normalise: Callable[[Column], Column] = ascii_lower,
    digest: Callable[[Column], Column] = sha256,
    index: DigestIndex | None = None,
    hot: int = HOT,
) -> DataFrame:
    """(id, keep_id, group_size, kept, digest) for each row of df; ``digest`` is binary."""
    if keep not in ("largest", "smallest"):
        raise ValueError(f"unknown keep {keep!r}")
    index = index or DigestIndex()
    text = normalise(F.coalesce(F.col(text_col), F.lit("")))
    base = only(df, id_col, text_col)
    digests = written(base.select(F.col(id_col).alias("id"), digest(text).alias("digest")), "digests")
    index.flush(digests)
    level = index.compact().select("digest", F.col("hi" if keep == "largest" else "lo").alias("keep_id"), "n")

    # byte verification of the hits
    texts = base.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("digest", digest(F.col("text")))
    hits = index.maybe(texts, index.filter(level.where("n > 1")))
    wrong = hits.groupBy("digest").agg(F.min("text").alias("first"), F.max("text").alias("last")).where("first != last")
    wrong = written(wrong.select("digest"), "wrong")

    out = with_group(digests, level, hot)
    if not wrong.isEmpty():  # digests that stand for more than one text: grouped by their bytes
        again = texts.join(wrong, "digest", "left_semi")
        best = F.max("id") if keep == "largest" else F.min("id")
        found = again.groupBy("digest", "text").agg(best.alias("keep_id"), F.count("*").alias("n"))
        out = out.join(wrong, "digest", "left_anti").unionByName(again.join(found, ["digest", "text"]).drop("text"))
    return out.select(
        F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)).alias("kept"), "digest"
    )


def with_group(rows: DataFrame, groups: DataFrame, hot: int = HOT) -> DataFrame:
    """rows with the keep_id and n of their digest. rows is a written table, so counting it reads no data."""
    least = rows.count() // hot
    large = groups.where(F.col("n") > least).select("digest", F.col("keep_id").alias("hot_id"), F.col("n").alias("hot_n"))  # hot_n is never null
    marked = rows.join(F.broadcast(large), "digest", "left")
    by_hot = marked.where("hot_n is not null").withColumnRenamed("hot_id", "keep_id").withColumnRenamed("hot_n", "n")
    by_rest = marked.where("hot_n is null").drop("hot_id", "hot_n").join(groups.where(F.col("n") <= least), "digest")
    return by_hot.unionByName(by_rest)
