"""Review of extractions: what a reader does to the passages found for research questions, as an event log.

A document's extractions are its items, numbered from 0 by question, place and segment; segments that the reader adds
follow, in the order of their events, with confidence 1.0. The log (doc_id, seq, action, item, segment_id, rq_label,
sub_theme, threshold) holds ``accept``, ``reject`` and ``edit`` of an item, ``accept_high`` of all pending items of a
document from a threshold on, and ``add`` of a segment. Nothing is folded event by event: an item's status is its last
own action, else whether an accept_high reached it, else pending (added ones: accepted), and that takes aggregations
alone. An edit's label lasts until another edit names a new one, and shows only while the item's last action is an edit.

Events that name no item, or one that is only added later, and additions of unknown segments do nothing. Null ids of
documents are one document. Numbering sorts each document's items: a document is one reader's work and bounded by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POSITION = ("line_start", "line_end", "char_start", "char_end", "paragraph_index")
STATUS = {"accept": "accepted", "reject": "rejected", "edit": "edited"}
HIGH = 0.85


def _joined(left: DataFrame, right: DataFrame, *keys: str, how: str = "inner", also: Column | None = None) -> DataFrame:
    """left with right's other columns; null keys are the same key."""
    right = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(right, same if also is None else [*same, also], how).drop(*[f"__{k}" for k in keys])


def place(found: DataFrame, segments: DataFrame, at: str = "at") -> DataFrame:
    """found (doc_id, at, ...) with the segment_id of the segment that holds the offset, null in gaps and outside.
    Segments don't overlap, so the last one that starts at the offset or before it is the only one that may hold it: a
    range join by one sort of each document's segments and offsets together."""
    started = F.struct("segment_id", "char_end")
    starts = segments.select("doc_id", F.col("char_start").alias("__at"), F.lit(0).alias("__kind"), started.alias("__segment"), F.lit(None).alias("__row"))
    row = F.struct(*[found[c] for c in found.columns])
    offsets = found.select("doc_id", F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.lit(None).alias("__segment"), row.alias("__row"))
    before = Window.partitionBy("doc_id").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    both = starts.unionByName(offsets).withColumn("__last", F.last("__segment", ignorenulls=True).over(before))
    held = F.when(F.col("__at") < F.col("__last.char_end"), F.col("__last.segment_id"))
    return both.where("__kind = 1").select("__row.*", held.alias("segment_id"))


def items(extractions: DataFrame, segments: DataFrame, log: DataFrame) -> DataFrame:
    """All items with their number, place and text; added ones carry the seq of their event."""
    known = segments.select("doc_id", "segment_id", "text", *POSITION)
    order = Window.partitionBy("doc_id").orderBy("rq_label", "char_start", "segment_id", "sub_theme", "confidence", "evidence_span", "reasoning")
    own = ("doc_id", "segment_id", "rq_label", "sub_theme", "confidence", "evidence_span", "reasoning")
    rows = _joined(extractions.select(*own), known, "doc_id", "segment_id", how="left").select(
        *own, "text", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in POSITION], F.lit(None).cast("long").alias("added")
    )
    rows = rows.withColumn("item", F.row_number().over(order) - 1)
    n = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    adds = log.where("action = 'add'").select("doc_id", "segment_id", "rq_label", "sub_theme", F.col("seq").cast("long").alias("added"))
    by_hand = {"confidence": F.lit(1.0), "evidence_span": F.lit(""), "reasoning": F.lit("added by hand")}
    adds = _joined(_joined(adds, known, "doc_id", "segment_id").withColumns(by_hand), n, "doc_id", how="left")
    place_of = F.row_number().over(Window.partitionBy("doc_id").orderBy("added")) - 1
    adds = adds.withColumn("item", (place_of + F.coalesce("n", F.lit(0))).cast("int")).select(*rows.columns)
    return rows.unionByName(adds)


def reviewed(extractions: DataFrame, segments: DataFrame, log: DataFrame) -> DataFrame:
    """All items with review_status, and the labels that hold after the review."""
    rows = items(extractions, segments, log)
    own = log.where(F.col("action").isin(*STATUS)).select("doc_id", F.col("item").cast("int").alias("item"), "seq", "action", "rq_label", "sub_theme")
    since = F.col("added").isNull() | (F.col("seq") > F.col("added"))
    own = _joined(own, rows.select("doc_id", "item", "added"), "doc_id", "item", also=since)
    edit = F.col("action") == "edit"
    last = own.groupBy("doc_id", "item").agg(
        F.max_by("action", "seq").alias("action"),
        *[F.max_by(F.when(edit, F.col(c)), F.when(edit & F.col(c).isNotNull(), F.col("seq"))).alias(f"new_{c}") for c in ("rq_label", "sub_theme")],
    )
    high = log.where("action = 'accept_high'").groupBy("doc_id").agg(F.min(F.coalesce("threshold", F.lit(HIGH))).alias("high"))
    out = _joined(_joined(rows, last, "doc_id", "item", how="left"), high, "doc_id", how="left")
    status = F.when(F.col("added").isNotNull() | (F.col("confidence") >= F.col("high")), "accepted").otherwise("pending")
    for action, name in reversed(STATUS.items()):
        status = F.when(F.col("action") == action, name).otherwise(status)
    out = out.withColumn("review_status", status)
    edited = F.col("review_status") == "edited"
    labels = {c: F.coalesce(F.when(edited, F.col(f"new_{c}")), F.col(c)) for c in ("rq_label", "sub_theme")}
    return out.withColumns(labels).drop("action", "high", "new_rq_label", "new_sub_theme", "added")


def export(rows: DataFrame) -> DataFrame:
    """What wasn't rejected, with its place."""
    kept = rows.where("review_status <> 'rejected'")
    return kept.select("doc_id", "item", "segment_id", "text", "rq_label", "sub_theme", "confidence", *POSITION, "review_status", "reasoning", "evidence_span")


def stats(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, total, accepted, edited, rejected, pending, progress)."""
    counts = [F.count_if(F.col("review_status") == s).alias(s) for s in ("accepted", "edited", "rejected", "pending")]
    out = rows.groupBy(*keys).agg(F.count("*").alias("total"), *counts)
    return out.withColumn("progress", F.round(F.coalesce(100 * F.try_divide(F.col("total") - F.col("pending"), F.col("total")), F.lit(0.0)), 1))
