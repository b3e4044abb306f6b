"""Streams of actions, in any cutting into micro-batches, against the fold over the whole log."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from loomtext.operators import review
from loomtext.plans import registry
from loomtext.streaming import annotation_stream, review_stream

LOG = "session string, ts timestamp, seq long, action string, target long, label string, note string"
T0 = datetime(2024, 1, 1)


def made(seed, n=60):
    r = random.Random(seed)
    items = [(s, k, r.choice([None, None, "x"])) for s in ("a", "b", "c") for k in range(40)]
    log = []
    for k in range(n):
        action = r.choice(["annotate", "annotate", "skip", "flag", "undo", "undo", "goto"])
        log.append((r.choice("ab"), T0 + timedelta(minutes=k // 2), k, action, r.randrange(6) if action == "goto" else None, r.choice("xy"), r.choice([None, "n"])))
    return items, log


def streamed(spark, items, log, cuts, tmp_path, **options):
    source = tmp_path / "log"
    out = tmp_path / "out"
    last = [("", T0 + timedelta(days=k), 10**6 + k, "undo", None, None, None) for k in (1, 2)]  # moves the watermark on
    for part in [*cuts, *[[x] for x in last]]:
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(source))
    changes = annotation_stream.annotations_stream(stream, items, late="1 hour", **options)
    with annotation_stream.rocksdb(spark):
        query = (
            changes.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "checkpoint"))
            .foreachBatch(lambda df, _: df.write.mode("append").parquet(str(out))).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.schema(annotation_stream.CHANGED).parquet(str(out)).where("session <> ''")


@pytest.mark.parametrize("seed", [1, 2])
def test_any_cutting(spark, tmp_path, seed):
    rows, log = made(seed)
    items = spark.createDataFrame(rows, "session string, item long, label string")
    r = random.Random(seed)
    shuffled = log[:]
    for k in range(0, len(shuffled) - 20, 20):  # out of order by less than the watermark's delay
        part = shuffled[k : k + 20]
        r.shuffle(part)
        shuffled[k : k + 20] = part
    at = sorted(r.sample(range(1, len(log)), 2)) if seed == 1 else []
    cuts = [shuffled[a:b] for a, b in zip([0, *at], [*at, len(log)])]
    found = annotation_stream.after(items, streamed(spark, items, cuts=cuts, log=log, tmp_path=tmp_path))
    kept = [(s, seq, action, target, label, note) for s, _, seq, action, target, label, note in log]
    batch = review.fold_annotations(items, spark.createDataFrame(kept, "session string, seq long, action string, target long, label string, note string"))
    number = {(s, k): x[1] for s in "abc" for k, x in enumerate(x for x in kept if x[0] == s)}  # the fold counts a session's own actions
    expected = [(r["session"], r["item"], r["label"], r["status"], r["note"], number.get((r["session"], r["seq"]))) for r in batch.collect()]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, expected))
    assert len({e[3] for e in expected}) == 4


class Held:
    """A state of one session, of any kind, that counts the calls to it."""

    def __init__(self, *_):
        self.value, self.calls = {}, 0

    def _call(self, at, value):
        self.calls += 1
        if value is not None:
            self.value[at] = value
        return self.value.get(at)

    def get(self):
        return self._call("", None)

    def update(self, value):
        self._call("", value)

    def getValue(self, at):
        return self._call(at, None)

    def updateValue(self, at, value):
        self._call(at, value)

    def removeKey(self, at):
        self._call(at, None)
        self.value.pop(at, None)


class Handle:
    getMapState = getValueState = getListState = Held


def applied(actions, n):
    made = annotation_stream.Annotating()
    made.init(Handle)
    for b in range(0, n, annotation_stream.BLOCK):
        preset = [{"item": k, "label": "x"} for k in range(b, min(b + annotation_stream.BLOCK, n)) if k % 3 == 1]
        made.handleInitialState(("a",), Row(block=b // annotation_stream.BLOCK, n_items=min(b + annotation_stream.BLOCK, n), free=next((k for k in range(b, n) if k % 3 != 1), None), preset=preset), None)
    out = [tuple(r) for k in range(0, len(actions), 700) for r in made._applied("a", actions[k : k + 700])]
    return out, sum(s.calls for s in (made.items, made.place, made.history))


def test_blocks(monkeypatch):
    """Outcomes don't hang on the size of a block, and calls to the state grow with blocks, not with actions."""
    r = random.Random(3)
    actions = [(k, k, r.choice(["annotate", "annotate", "skip", "flag", "undo", "undo", "goto"]), r.randrange(600), r.choice("xy"), None) for k in range(3000)]
    found, calls = applied(actions, 600)
    monkeypatch.setattr(annotation_stream, "BLOCK", 7)
    assert applied(actions, 600)[0] == found
    assert len(found) > 2000 and {s[4] for s in found} == {"labeled", "skipped", "flagged", "pending", "ignored"}
    assert calls < 100


def test_ignored(spark, tmp_path):
    items = spark.createDataFrame([("a", 0, None)], "session string, item long, label string")
    log = [("a", T0, 1, "annotate", None, "no such label", None), ("a", T0, 2, "annotate", None, "x", None), ("a", T0, 3, "skip", None, None, None), ("a", T0, 4, "goto", 7, None, None), ("new", T0, 5, "flag", None, None, "n")]
    changes = streamed(spark, items, log, [log], tmp_path, labels=["x"])
    assert sorted((r["session"], r["seq"], r["status"]) for r in changes.collect()) == [("a", 1, "ignored"), ("a", 2, "labeled"), ("a", 3, "ignored"), ("a", 4, "ignored"), ("new", 5, "ignored")]
    assert annotation_stream.after(items, changes).collect() == [("a", 0, "x", "labeled", "", 2)]


def test_action_counts(spark, tmp_path):
    rows = [(T0 + timedelta(minutes=m), a) for m, a in ((0, "x"), (1, "x"), (6, "y"), (40, "x"), (41, "x"), (2, "x"), (90, "z"), (200, "z"))]
    for row in rows:  # 2 comes two batches after 40: its window was closed
        spark.createDataFrame([row], "ts timestamp, action string").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema("ts timestamp, action string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    query = review_stream.action_counts(stream).writeStream.outputMode("append").format("memory").queryName("counted").trigger(availableNow=True).start()
    query.awaitTermination()
    found = sorted(((r["start"] - T0).seconds // 60, r["action"], r["n"]) for r in spark.table("counted").where(F.col("start") < F.lit(T0 + timedelta(hours=2))).collect())
    assert found == [(0, "x", 2), (5, "y", 1), (40, "x", 2), (90, "z", 1)]


def test_query(spark, sf_dir):
    """The registered stream over all documents and events ends where the fold over their whole log does."""
    of = lambda name: sorted(map(str, ((r["session"], r["item"], r["label"], r["status"], r["note"]) for r in registry.QUERIES[name](spark, sf_dir).collect())))
    assert of("g2_stream") == of("g1_g4_annotations")
