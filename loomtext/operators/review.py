"""Annotation and review sessions as append-only action logs.

A session is the table of its items and a log (session, seq, action, item, label, note). Statuses in which the last
action decides are one aggregation; annotation with its cursor and undo stack is a fold over each session's log, in
order, inside ``applyInArrow``: a session is one annotator's work and bounded by it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ustrip

STATE = "session string, item long, label string, status string, note string, seq long"


def create_session(
    df: DataFrame, id_col: str, text_col: str, label_col: str | None = None, labels: list[str] | None = None, session: str = "", shuffle_seed: int | None = None
) -> tuple[DataFrame, list[str]]:
    """(items, labels): (session, item from 0, id, text, label) in the order of the ids, or of their hashes with a seed;
    labels that rows have already are kept, blank ones apart, and are the session's labels, sorted, if none are given.
    Items are numbered by ranges of that order, so that no task holds them all. Null texts are read as empty."""
    from .pii import in_order

    label = F.lit(None).cast("string") if label_col is None else F.nullif(ustrip(F.col(label_col).cast("string")), F.lit(""))
    rows = df.select(F.lit(session).alias("session"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), label.alias("label"))
    order = ["id", "text"] if shuffle_seed is None else ["place", "id", "text"]
    rows = rows if shuffle_seed is None else rows.withColumn("place", F.xxhash64("id", "text", F.lit(shuffle_seed)))
    items = in_order(rows, "session", order).select("session", (F.col("n") - 1).alias("item"), "id", "text", "label")
    if labels is None:
        labels = [r["label"] for r in rows.where("label is not null").select("label").distinct().orderBy("label").collect()]
    return items, labels


def replay(n_items: int, actions: list[tuple], preset: dict[int, str] | None = None, labels: list[str] | None = None) -> tuple[list[dict], int]:
    """Items and cursor after the actions (name, item, label, note): annotate, skip, flag, undo, goto. A label that isn't
    among labels, where there are any, is an error."""
    items = [{"label": (preset or {}).get(k), "status": "labeled" if (preset or {}).get(k) else "pending", "note": "", "seq": None} for k in range(n_items)]
    history: list[int] = []

    def pending(k: int) -> int:
        return next((j for j in range(k, n_items) if items[j]["status"] == "pending"), n_items)

    cursor = pending(0)
    for seq, (name, target, label, note) in enumerate(actions):
        if name == "undo":
            if history:
                cursor = history.pop()
                items[cursor] = {"label": None, "status": "pending", "note": "", "seq": None}
            continue
        if name == "goto":
            if not 0 <= target < n_items:
                raise IndexError(f"no item {target}")
            cursor = target
            continue
        if cursor >= n_items:
            raise IndexError("no more items")
        item = items[cursor]
        if name == "annotate":
            if labels and label not in labels:
                raise ValueError(f"unknown label {label!r}; known: {labels}")
            item |= {"label": label, "status": "labeled", "note": note or ""}
        elif name == "skip":
            item["status"] = "skipped"
        elif name == "flag":
            item |= {"status": "flagged", "note": note or ""}
        else:
            raise ValueError(f"unknown action {name!r}")
        item["seq"] = seq
        history.append(cursor)
        cursor = pending(cursor + 1)
    return items, cursor


def fold_annotations(items: DataFrame, log: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """(session, item, label, status, note, seq) after each session's log. items: (session, item from 0, label). With
    labels, an action that sets another one is an error."""

    def fold(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = sorted(left.to_pylist(), key=lambda r: r["item"])
        acts = sorted(right.to_pylist(), key=lambda r: r["seq"])
        done, _ = replay(len(rows), [(r["action"], r["target"], r["label"], r["note"]) for r in acts], {k: r["label"] for k, r in enumerate(rows) if r["label"]}, labels)
        out = [{"session": r["session"], "item": r["item"]} | d for r, d in zip(rows, done, strict=True)]
        kinds = [("session", pa.string()), ("item", pa.int64()), ("label", pa.string()), ("status", pa.string()), ("note", pa.string()), ("seq", pa.int64())]
        return pa.table({n: pa.array([r[n] for r in out], t) for n, t in kinds})

    left = items.select(F.col("session").cast("string"), F.col("item").cast("long"), "label")
    right = log.select(F.col("session").cast("string"), F.col("seq").cast("long"), "action", F.col("target").cast("long"), "label", "note")
    return left.groupBy("session").cogroup(right.groupBy("session")).applyInArrow(fold, STATE)


def annotation_stats(state: DataFrame) -> DataFrame:
    """(session, total, labeled, skipped, flagged, pending, progress, complete)."""
    of = lambda s: F.count_if(F.col("status") == s)
    out = state.groupBy("session").agg(F.count("*").alias("total"), *[of(s).alias(s) for s in ("labeled", "skipped", "flagged", "pending")])
    return out.withColumn("progress", F.round(100 * (F.col("total") - F.col("pending")) / F.col("total"), 1)).withColumn("complete", F.col("pending") == 0)


def export_annotations(state: DataFrame, include_all: bool = False) -> DataFrame:
    return state if include_all else state.where("status = 'labeled'")


def export_for_training(items: DataFrame, state: DataFrame) -> DataFrame:
    """(id, text, label) of the labelled items of create_session()."""
    done = state.where("status = 'labeled' and label is not null").select("session", "item", F.col("label").alias("__label"))
    return items.join(done, ["session", "item"]).select("id", "text", F.col("__label").alias("label"))


def merge_labels(df: DataFrame, state: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """df with labels of equal texts from state (text, item, label); the last item's label wins for repeated texts."""
    last = state.where("label is not null").groupBy(F.col("text").alias("__text")).agg(F.max_by("label", "item").alias("__label"))
    out = df.join(last, df[text_col] == last["__text"], "left")
    return out.select(*[F.coalesce("__label", df[c]).alias(c) if c == label_col else df[c] for c in df.columns])


def last_actions(log: DataFrame, *keys: str) -> DataFrame:
    """(keys, action, value): the last action on each reviewed thing."""
    return log.groupBy(*keys).agg(F.max_by(F.struct("action", "value"), "seq").alias("x")).select(*keys, "x.*")


def final_value(action: Column, original: Column, edited: Column, when_rejected: Column) -> Column:
    """Pending counts as accepted."""
    return F.when(action == "rejected", when_rejected).when(action == "edited", edited).otherwise(original)


def reviewed(rows: DataFrame, log: DataFrame, keys: list[str], original: str, when_rejected: str | None = None) -> DataFrame:
    """rows with action (pending without one) and final. Null keys of rows and of the log are the same key."""
    last = last_actions(log, *keys).withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    out = rows.join(last, same, "left").drop(*[f"__{k}" for k in keys]).withColumn("action", F.coalesce("action", F.lit("pending")))
    rejected = F.lit(None) if when_rejected is None else F.col(when_rejected)
    return out.withColumn("final", final_value(F.col("action"), F.col(original), F.col("value"), rejected)).drop("value")


def accept_confident(rows: DataFrame, threshold: float, confidence: str = "confidence") -> DataFrame:
    """Pending rows of at least threshold become accepted."""
    return rows.withColumn("action", F.when((F.col("action") == "pending") & (F.col(confidence) >= threshold), "accepted").otherwise(F.col("action")))


def review_stats(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, total, accepted, edited, rejected, pending)."""
    return rows.groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(F.col("action") == a).alias(a) for a in ("accepted", "edited", "rejected", "pending")])


class Codebook:
    """Themes under review: a small driver-side list of dicts; merging concatenates examples, locking ends edits."""

    def __init__(self, themes: list[dict]):
        self.themes, self.locked = [dict(t) for t in themes], False

    def _open(self) -> None:
        if self.locked:
            raise ValueError("the codebook is locked")

    def add(self, name: str, description: str = "", inclusion: list[str] | None = None, exclusion: list[str] | None = None) -> None:
        self._open()
        self.themes.append({"name": name, "description": description, "inclusion": inclusion or [], "exclusion": exclusion or []})

    def edit(self, index: int, **changes) -> None:
        self._open()
        self.themes[index] |= changes

    def delete(self, index: int) -> dict:
        self._open()
        return self.themes.pop(index)

    def merge(self, indices: list[int], name: str, description: str = "") -> dict:
        self._open()
        if len(set(indices)) < 2:
            raise ValueError("merging takes two themes")
        chosen = [self.themes[i] for i in sorted(set(indices))]
        made = {"name": name, "description": description or " ".join(t["description"] for t in chosen if t["description"])}
        made |= {k: [x for t in chosen for x in t[k]] for k in ("inclusion", "exclusion")}
        self.themes = [t for i, t in enumerate(self.themes) if i not in set(indices)] + [made]
        return made

    def problems(self) -> list[str]:
        names = [t["name"].strip() for t in self.themes]
        out = [] if names else ["no theme"]
        out += [f"theme {i + 1} has no name" for i, n in enumerate(names) if not n]
        out += [f"theme {n!r} occurs twice" for n in sorted({n for n in names if n and names.count(n) > 1})]
        return out + [f"theme {t['name']!r} has no description" for t in self.themes if not t["description"].strip()]

    def lock(self) -> list[str]:
        if not (found := self.problems()):
            self.locked = True
        return found

    def unlock(self) -> None:
        self.locked = False
