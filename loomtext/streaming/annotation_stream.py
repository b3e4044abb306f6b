"""Annotation sessions over a stream of actions: cursor, items and undo stack are state of each session.

Actions may come in any order and in any cutting into micro-batches. They wait in the session's state until the
watermark reaches their time and are then applied by (time, seq), so the outcome is that of a fold over the whole log;
an action that comes after the watermark has passed its time is late and is dropped. Items come as the initial state.

Every applied action emits the item it changed, and its number among the session's applied ones (``step``); a goto
changes none. An action that has no item to act on, or a label that isn't among those allowed, emits ``ignored`` and
changes nothing, where the batch fold raises. The state store is RocksDB, which this kind of state needs.

A call to the state costs more than an action does, so state lies in blocks that are read and written once for all
actions that are due: items that aren't pending in blocks of BLOCK neighbours, the undo stack in blocks of its places,
waiting actions in the pieces they came in. Calls grow with the blocks that actions touch.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGED = "session string, step long, item long, label string, status string, note string, seq long"
CHANGE = Row(*[c.split()[0] for c in CHANGED.split(", ")])
BLANK = (None, "pending", "", None)
#: Items, or places of the undo stack, in a block; actions in a piece of those that wait on.
BLOCK = 256


class Blocks:
    """Values by number from 0, over a map state of blocks of them; blocks are read once and written by flush()."""

    def __init__(self, state):
        self.state, self.held, self.changed = state, {}, set()

    def block(self, k: int) -> dict:
        if k not in self.held:
            found = self.state.getValue((k,))
            self.held[k] = {} if found is None else {int(at): value for at, value in json.loads(found[0]).items()}
        return self.held[k]

    def get(self, at: int):
        return self.block(at // BLOCK).get(at)

    def put(self, at: int, value) -> None:
        """Sets a value; None takes it out."""
        block = self.block(at // BLOCK)
        if value is None:
            block.pop(at, None)
        else:
            block[at] = value
        self.changed.add(at // BLOCK)

    def first_free(self, at: int, n: int) -> int:
        """The first number from at on that has no value, n at most. Full blocks are passed at once."""
        while at < n:
            k = at // BLOCK
            block, end = self.block(k), min((k + 1) * BLOCK, n)
            if len(block) < end - k * BLOCK:
                while at < end and at in block:
                    at += 1
                if at < end:
                    return at
            at = end
        return max(at, n)

    def flush(self) -> None:
        for k in self.changed:
            if self.held[k]:
                self.state.updateValue((k,), (json.dumps(self.held[k]),))
            else:
                self.state.removeKey((k,))
        self.changed.clear()


class Annotating(StatefulProcessor):
    def __init__(self, labels: list[str] | None = None):
        self.labels = labels

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "block long", "held string")  # item: label, status, note, seq, unless pending
        self.place = handle.getValueState("place", "cursor long, n_items long, step long, depth long")
        self.history = handle.getMapState("history", "block long", "held string")  # place on the undo stack: item
        self.waiting = handle.getListState("waiting", "actions string")  # lists of (at, seq, action, target, label, note)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        """A block of items: how many there are up to its end, the first without a label (or null), and those with one."""
        cursor, n, step, depth = self.place.get() or (None, 0, 0, 0)
        if initialState.preset:
            held = {r["item"]: (r["label"], "labeled", "", None) for r in initialState.preset}
            self.items.updateValue((initialState.block,), (json.dumps(held),))
        free = [c for c in (cursor, initialState.free) if c is not None]
        self.place.update((min(free) if free else None, max(n, initialState.n_items), step, depth))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r["at"], r["seq"], r["action"], r["target"], r["label"], r["note"]) for r in rows]
        if new:
            self._wait(new)
            self.handle.registerTimer(max(min(n[0] for n in new), timerValues.getCurrentWatermarkInMs()))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        all_of = sorted((tuple(a) for w in self.waiting.get() for a in json.loads(w[0])), key=lambda w: w[:2])
        due, rest = [w for w in all_of if w[0] <= mark], [w for w in all_of if w[0] > mark]
        if due:
            self.waiting.clear()
            if rest:
                self._wait(rest)
                self.handle.registerTimer(rest[0][0])
            yield from self._applied(key[0], due)

    def _wait(self, actions: list[tuple]) -> None:
        self.waiting.appendList([(json.dumps(actions[k : k + BLOCK]),) for k in range(0, len(actions), BLOCK)])

    def _applied(self, session: str, actions: list[tuple]) -> list[Row]:
        cursor, n, step, depth = self.place.get() or (0, 0, 0, 0)
        items, history, out = Blocks(self.items), Blocks(self.history), []
        cursor = n if cursor is None else cursor
        for _, seq, action, target, label, note in actions:
            step, item = step + 1, None
            if action == "goto" and target is not None and 0 <= target < n:
                cursor = target
                continue
            if action == "undo":
                if not depth:
                    continue
                depth -= 1
                cursor = item = history.get(depth)
                history.put(depth, None)
                state = BLANK
                items.put(item, None)
            elif action in ("annotate", "skip", "flag") and cursor < n and not (action == "annotate" and self.labels and label not in self.labels):
                item = cursor
                held_label, _, held_note, _ = items.get(item) or BLANK
                state = {"annotate": (label, "labeled", note or ""), "skip": (held_label, "skipped", held_note), "flag": (held_label, "flagged", note or "")}[action]
                state = (*state, seq)
                items.put(item, state)
                history.put(depth, item)
                depth += 1
            if item is None:
                out.append(CHANGE(session, step, None, label, "ignored", note, seq))
                continue
            out.append(CHANGE(session, step, item, *state))
            if action != "undo":
                cursor = items.first_free(item + 1, n)
        self.place.update((cursor, n, step, depth))
        items.flush()
        history.flush()
        return out


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store is RocksDB for queries that start within."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def annotations_stream(log: DataFrame, items: DataFrame, time_col: str = "ts", late: str = "10 minutes", labels: list[str] | None = None) -> DataFrame:
    """The changes of items that the actions of a streamed log make, for output mode update. log: (session, ts, seq,
    action, target, label, note); items: (session, item from 0, label), not streamed."""
    rows = log.withWatermark(time_col, late).select(
        F.col("session").cast("string"), F.col(time_col), F.unix_millis(time_col).alias("at"), F.col("seq").cast("long"), "action",
        F.col("target").cast("long"), "label", "note",
    )
    item, preset = F.col("item").cast("long"), F.length("label") > 0
    start = items.groupBy(F.col("session").cast("string").alias("session"), F.floor(item / BLOCK).alias("block")).agg(
        (F.max(item) + 1).alias("n_items"), F.min(F.when(~F.coalesce(preset, F.lit(False)), item)).alias("free"),
        F.collect_list(F.when(preset, F.struct(item.alias("item"), "label"))).alias("preset"),
    )
    return rows.groupBy("session").transformWithState(
        Annotating(labels), outputStructType=CHANGED, outputMode="Update", timeMode="EventTime", initialState=start.groupBy("session")
    )


def after(items: DataFrame, changes: DataFrame) -> DataFrame:
    """(session, item, label, status, note, seq): items as the changes so far leave them."""
    last = changes.where("item is not null").groupBy("session", "item").agg(F.max_by(F.struct("label", "status", "note", "seq"), "step").alias("x"))
    preset = F.when(F.length("label") > 0, F.col("label"))
    start = F.struct(preset.alias("label"), F.when(preset.isNotNull(), "labeled").otherwise("pending").alias("status"), F.lit("").alias("note"), F.lit(None).cast("long").alias("seq"))
    rows = items.select(F.col("session").cast("string").alias("session"), F.col("item").cast("long").alias("item"), start.alias("s"))
    return rows.join(last, ["session", "item"], "left").select("session", "item", F.coalesce("x", "s").alias("x")).select("session", "item", "x.*")


def replayed(log: DataFrame, items: DataFrame, home: str, cuts: int = 3, late: str = "1 hour", time_col: str = "ts") -> DataFrame:
    """Changes that the actions of log make, streamed from the folder ``home`` in cuts of equal time, each a start of the
    query on one checkpoint; the last also has an action of no session, a year later, which lets all others go."""
    spark = log.sparkSession
    span = log.agg(F.min(time_col).alias("a"), F.max(time_col).alias("b")).first()
    if span["a"] is None:
        return spark.createDataFrame([], CHANGED)
    width = (span["b"] - span["a"]) / cuts
    at, source = F.col(time_col), f"{home}/log"
    parts = [log.where((at >= span["a"] + k * width) & (at < span["a"] + (k + 1) * width if k + 1 < cuts else F.lit(True))) for k in range(cuts)]
    end = log.limit(1).withColumns({"session": F.lit(""), time_col: F.lit(span["b"]) + F.expr("interval 1 year"), "action": F.lit("undo")})
    parts[-1] = parts[-1].unionByName(end)
    for part in parts:
        part.write.mode("append").parquet(source)
        changes = annotations_stream(spark.readStream.schema(log.schema).parquet(source), items, time_col, late)
        with rocksdb(spark):
            query = (
                changes.writeStream.outputMode("update").option("checkpointLocation", f"{home}/checkpoint")
                .foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{home}/changes/batch={k}"))
                .trigger(availableNow=True).start()
            )
            query.awaitTermination()
    return spark.read.schema(f"{CHANGED}, batch int").parquet(f"{home}/changes").where("session <> ''").drop("batch")
