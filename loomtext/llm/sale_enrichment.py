"""Valid-time enrichment: each sale takes the version of its client that was valid when it was sold.

Sales and the changes of clients come in batches, out of order. A stateful streaming query holds the versions of every
client and the sales that wait. Each table's watermark is declared on a clock that no row is late for, the table's
largest time up to and with the row's batch; Spark takes the smaller of the two (the minimum policy) as H, and makes it
known one batch later. Event-time timers at the earliest time at which a client has something to do wake it: its waiting
sales before H leave, and its versions up to H but the last are pruned.

State lies by shard. A shard holds many clients, or one cell of one client: a client with many sales or changes is
dealt over a grid, a sale to one row of it, a change to one column, so that each pair of a sale and a version meets in
one cell. What the cells found for a sale is put together afterwards: of the candidates the last one, unless the client
as a whole has pruned it. A cell alone holds versions that the whole client has pruned; each cell therefore reports its
last pruned-to version (its floor), and the largest floor is the client's.

Defined cases. A null time of sale leaves at once with no version; a change with a null time is no change. A null
client has no versions. Repeated rows of sales are sales of their own; changes that agree in time, seq and id are
ordered by op and balance, nulls first. Times are wall-clock; Spark's watermarks are whole milliseconds and begin in
1970, so a finer rest of a table's maximum is cut off. A null batch, and one beyond the last, counts as the last; a
negative one as the first. Either table may be empty; batches without rows run too. Other columns are ignored.
A NaN balance counts as null.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .common import deleted, shared_dir, written

# Spark's own concatenation of a task's frames and states warns of empty columns
warnings.filterwarnings("ignore", "The behavior of DataFrame concatenation", FutureWarning)

NONE = -(2**63)  # stands for null in long columns of the stream and sorts before all others
SALE, VERSION, LATE, TICK, FLUSH = range(5)

EVENT = """shard long, kind int, clock timestamp, client long, at long, id long, uid long, cells int, seq long, op string,
balance double"""
STATE = "versions binary, waiting binary"
FOUND = """rec string, id long, uid long, cells int, others long, has_floor boolean, floor_at long, floor_seq long,
floor_id long, at long, seq long, change_id long, op string, balance double, fresh boolean"""

EVENT_COLUMNS = [c.split()[0] for c in EVENT.split(",")[1:]]
FOUND_COLUMNS = [c.split()[0] for c in FOUND.split(",")]
V = ("client", "at", "seq", "id", "op", "balance", "floor")
S = ("client", "at", "id", "uid", "cells")
ORDER = ["client", "at", "seq", "id", "op_set", "op", "balance_set", "balance"]


def micros(t: Column) -> Column:
    """Wall-clock microseconds since 1970, whatever the session's time zone and the column's kind of timestamp."""
    seconds = F.unix_date(F.to_date(t)) * 86400 + F.hour(t) * 3600 + F.minute(t) * 60
    return seconds.cast("long") * 1_000_000 + (F.extract(F.lit("SECONDS"), t) * 1_000_000).cast("long")


def packed(df: pd.DataFrame) -> bytes | None:
    if df.empty:
        return None
    batch = pa.RecordBatch.from_pandas(df, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes | None, columns: tuple[str, ...]) -> pd.DataFrame:
    if data is None:
        types = {"op": object, "floor": bool, "balance": float}
        return pd.DataFrame({c: pd.Series(dtype=types.get(c, "int64")) for c in columns})
    return pa.ipc.open_stream(data).read_all().to_pandas()


def in_order(v: pd.DataFrame) -> pd.DataFrame:
    """Versions by client and validity; of equal ones by op and balance, nulls first."""
    if len(v) < 2:
        return v
    keyed = v.assign(op_set=v["op"].notna(), balance_set=v["balance"].notna(), op=v["op"].fillna(""))
    return v.loc[keyed.sort_values(ORDER, kind="stable").index]


def matched(due: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
    """What each due sale finds among the versions v, which are in order."""
    clients, times = np.unique(v["client"]), np.unique(v["at"])
    first = np.searchsorted(v["client"].to_numpy(), due["client"].to_numpy(), "left")
    last = np.searchsorted(v["client"].to_numpy(), due["client"].to_numpy(), "right")
    # one number for (client, time), so that one search finds the last version not after the sale
    step = len(times) + 1
    have = np.searchsorted(clients, v["client"].to_numpy()) * step + np.searchsorted(times, v["at"].to_numpy()) + 1
    want = np.searchsorted(clients, due["client"].to_numpy()) * step + np.searchsorted(times, due["at"].to_numpy(), "right")
    at = np.searchsorted(have, want, "right") - 1
    hit = (last > first) & (at >= first)
    at = np.where(hit, at, 0)
    floors = v[v["floor"]]
    floor = np.searchsorted(floors["client"].to_numpy(), due["client"].to_numpy())
    has_floor = np.zeros(len(due), dtype=bool)
    if len(floors):
        floor = np.minimum(floor, len(floors) - 1)
        has_floor = floors["client"].to_numpy()[floor] == due["client"].to_numpy()

    def take(frame: pd.DataFrame, column: str, rows: np.ndarray, mask: np.ndarray, default: object) -> np.ndarray:
        out = np.full(len(due), default, dtype=frame[column].to_numpy().dtype)
        out[mask] = frame[column].to_numpy()[rows[mask]]
        return out

    return pd.DataFrame({
        "rec": "sale", "id": due["id"].to_numpy(), "uid": due["uid"].to_numpy(), "cells": due["cells"].to_numpy("int32"),
        "others": (last - first - has_floor).astype("int64"), "has_floor": has_floor,
        "floor_at": take(floors, "at", floor, has_floor, NONE), "floor_seq": take(floors, "seq", floor, has_floor, NONE),
        "floor_id": take(floors, "id", floor, has_floor, NONE),
        "at": take(v, "at", at, hit, NONE), "seq": take(v, "seq", at, hit, NONE), "change_id": take(v, "id", at, hit, NONE),
        "op": take(v, "op", at, hit, None), "balance": take(v, "balance", at, hit, np.nan), "fresh": take(v, "fresh", at, hit, False),
    })


def pruned(v: pd.DataFrame, h: int) -> pd.DataFrame:
    """v, in order, without what lies up to h but the last of each client, which becomes its floor."""
    client, upto = v["client"].to_numpy(), (v["at"] <= h).to_numpy()
    followed = np.zeros(len(v), dtype=bool)
    followed[:-1] = (client[1:] == client[:-1]) & upto[1:]
    return v.assign(floor=upto)[~(upto & followed)]


def next_timer(v: pd.DataFrame, waiting: pd.DataFrame, h: int) -> int | None:
    """The earliest of the clients' timers in milliseconds: a timer fires once the watermark is beyond it. A waiting sale
    leaves when the watermark is after it; a version makes the one before it go once the watermark reaches it."""
    at = v["at"].to_numpy()
    found = np.concatenate([waiting["at"].to_numpy() // 1000, at[at > h] // 1000 - (at[at > h] % 1000 == 0)])
    return max(1, int(found.min()), h // 1000) if len(found) else None


def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One batch of a shard: new versions join, due sales leave, versions are pruned, the next timer is set."""
    mark = state.getCurrentWatermarkMs()
    h = mark * 1000 if mark > 0 else NONE
    held = state.get if state.exists else (None, None)
    v, waiting = unpacked(held[0], V).assign(fresh=False), unpacked(held[1], S)
    rows = pd.concat(list(frames)) if not state.hasTimedOut else None
    flush = False
    if rows is not None and len(rows):
        flush = bool((rows["kind"] == FLUSH).any())
        late = rows[rows["kind"] == LATE]
        if len(late):
            yield pd.DataFrame({c: None for c in FOUND_COLUMNS} | {"rec": "late", "id": late["id"].to_numpy(), "cells": np.int32(1)}, columns=FOUND_COLUMNS)
        new = rows[rows["kind"] == VERSION]
        if len(new):
            new = new.assign(floor=False, fresh=True)[[*V, "fresh"]]
            v = pd.concat([v, new], ignore_index=True) if len(v) else new.reset_index(drop=True)
        new = rows[rows["kind"] == SALE]
        if len(new):
            waiting = pd.concat([waiting, new[list(S)]], ignore_index=True) if len(waiting) else new[list(S)]
    v = in_order(v)
    due = (waiting["at"] == NONE) | (waiting["at"] < h) | flush
    if due.any():
        yield matched(waiting[due], v)[FOUND_COLUMNS]
    waiting, v = waiting[~due], pruned(v, h)[list(V)]
    if len(v) or len(waiting):
        state.update((packed(v), packed(waiting)))
        if (timer := next_timer(v, waiting, h)) is not None:
            state.setTimeoutTimestamp(timer)
    elif state.exists:
        state.remove()


def heavy_clients(sales: DataFrame, changes: DataFrame, pieces: int) -> list[tuple[int, int, int]]:
    """(client, rows, columns) of the grid of each client that has over 1 / pieces of the sales or of the changes, of
    which there are under 2 * pieces."""
    both = sales.select("client", F.lit(1).alias("s"), F.lit(0).alias("c")).unionAll(
        changes.select("client", F.lit(0), F.lit(1))
    )
    total = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("c"), F.lit(0)).alias("c")).first()
    counts = both.where(F.col("client") != NONE).groupBy("client").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    found = counts.where((F.col("s") * pieces > total["s"]) | (F.col("c") * pieces > total["c"])).collect()

    def parts(n: int, of: int) -> int:
        return max(1, -(-n * pieces // of)) if of else 1

    return sorted((r["client"], parts(r["s"], total["s"]), parts(r["c"], total["c"])) for r in found)


def dealt(rows: DataFrame, heavy: DataFrame, shards: int) -> DataFrame:
    """rows with their shard: whole clients by hash; sales of a heavy client to all cells of one row of its grid, its
    versions to all cells of one column. Rows of no client and late ones go anywhere, ticks to the shard they name."""
    kind, own = F.col("kind"), F.xxhash64("id", "uid")
    anywhere = (F.col("client") == NONE) | (kind >= LATE)
    rows = rows.join(F.broadcast(heavy), "client", "left")
    grid = ~anywhere & F.col("first").isNotNull()
    is_sale = kind == SALE
    mine = F.pmod(own, F.when(is_sale, F.col("n_rows")).otherwise(F.col("n_columns"))).cast("int")
    others = F.sequence(F.lit(0), F.when(is_sale, F.col("n_columns")).otherwise(F.col("n_rows")) - 1)
    rows = rows.withColumn("cells", F.when(grid, F.col("n_columns")).otherwise(1))
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.when(grid, others).otherwise(F.array(F.lit(0)))))
    row, column = F.when(is_sale, F.col("mine")).otherwise(F.col("other")), F.when(is_sale, F.col("other")).otherwise(F.col("mine"))
    shard = (
        F.when(kind >= TICK, F.col("id"))
        .when(anywhere, F.pmod(own, F.lit(shards)))
        .when(grid, F.lit(shards) + F.col("first") + row * F.col("n_columns") + column)
        .otherwise(F.pmod(F.xxhash64("client"), F.lit(shards)))
    )
    return rows.select(shard.cast("long").alias("shard"), *EVENT_COLUMNS)


def enrich(
    sales: DataFrame, changes: DataFrame, batches: int = 10, delay: timedelta = timedelta(hours=36), pieces: int = 32, shard_rows: int = 20_000
) -> DataFrame:
    """(rec, id, batch, n_held, change_id, balance, op) of every sale (rec ``sale``, the batch it left in; what still
    waits after the last one leaves in batch ``batches``) and every late change (rec ``late``).

    sales: sale_id, client_id, sold_at, batch. changes: change_id, client_id, seq, op, valid_at, balance, batch. The
    batches are written to the shared folder and fed in order to a query that starts anew for each on one checkpoint.
    State is held by the session's state store. pieces: clients with over that part of a table are dealt over a grid.
    """
    spark = sales.sparkSession
    last = F.lit(batches - 1)
    batch = F.greatest(F.lit(0), F.least(F.coalesce("batch", last), last)).cast("int").alias("batch")

    def long(name: str) -> Column:
        return F.coalesce(F.col(name).cast("long"), F.lit(NONE))

    sold = sales.select(
        long("client_id").alias("client"), F.coalesce(micros(F.col("sold_at")), F.lit(NONE)).alias("at"), long("sale_id").alias("id"),
        F.monotonically_increasing_id().alias("uid"), batch,
    )
    changed = changes.where("valid_at is not null").select(
        long("client_id").alias("client"), micros(F.col("valid_at")).alias("at"), long("change_id").alias("id"),
        long("seq").alias("seq"), F.col("op").cast("string").alias("op"), F.col("balance").cast("double").alias("balance"), batch,
    )
    tables = {"sales": written(sold, "sales", "batch"), "changes": written(changed, "changes", "batch")}
    known = F.nullif("at", F.lit(NONE))
    largest = {n: {r["batch"]: r for r in t.groupBy("batch").agg(F.max(known).alias("at"), F.count("*").alias("n")).collect()} for n, t in tables.items()}
    shards = max(64, -(-sum(r["n"] for of in largest.values() for r in of.values()) // shard_rows))
    grids, n_shards = [], shards
    for client, n_rows, n_columns in heavy_clients(tables["sales"], tables["changes"], pieces):
        grids.append((client, n_rows, n_columns, n_shards - shards))
        n_shards += n_rows * n_columns
    heavy = spark.createDataFrame(grids, "client long, n_rows int, n_columns int, first long")

    home = f"{shared_dir(spark)}/loomtext/enrich-{uuid.uuid4().hex}"
    clock: dict[str, int | None] = {name: None for name in tables}
    for k in range(batches + 1):
        late_before = None if clock["changes"] is None else clock["changes"] - delay // timedelta(microseconds=1)
        for name, table in tables.items():
            if (of := largest[name].get(k)) and of["at"] is not None:
                clock[name] = of["at"] if clock[name] is None else max(clock[name], of["at"])
            ticks = spark.range(0, 1, 1, 1).withColumn("kind", F.lit(TICK))
            if k == batches:
                ticks = spark.range(0, n_shards, 1, 1).withColumn("kind", F.lit(FLUSH))
            _feed(table.where(F.col("batch") == k), name, ticks, clock[name], late_before, f"{home}/{name}")
        _run(spark, home, k, heavy, shards, delay)
    deleted(*tables.values())
    return _put_together(spark.read.schema(f"{FOUND}, batch int").parquet(f"{home}/found"))


def _feed(rows: DataFrame, name: str, ticks: DataFrame, clock: int | None, late_before: int | None, to: str) -> None:
    """Appends a batch to the folder that the query reads, with the table's clock on every row. A tick makes a batch
    without rows run; after the last batch a flush for every shard lets all sales leave."""
    none, null = F.lit(NONE), F.lit(None)
    if name == "sales":
        rows = rows.withColumns({"kind": F.lit(SALE), "seq": none, "op": null, "balance": null})
    else:
        late = F.lit(False) if late_before is None else F.col("at") < late_before
        rows = rows.withColumns({"kind": F.when(late, LATE).otherwise(VERSION), "uid": F.lit(0)})
    ticks = ticks.withColumns({"client": none, "at": none, "uid": F.lit(0), "seq": none, "op": null, "balance": null})
    rows = rows.drop("batch").unionByName(ticks)
    rows = rows.withColumns({"clock": F.timestamp_micros(F.lit(max(clock or 0, 1_000_000))), "cells": F.lit(1)})
    types = dict(c.split() for c in EVENT.split(","))
    rows.select(*[F.col(c).cast(types[c]).alias(c) for c in EVENT_COLUMNS]).write.mode("append").parquet(to)


def _run(spark: SparkSession, home: str, k: int, heavy: DataFrame, shards: int, delay: timedelta) -> None:
    """Starts the query on what was fed since its last start, as one micro-batch, and waits for it. A start that failed
    may be repeated: the batch's folder is written over."""

    def stream(name: str) -> DataFrame:
        rows = spark.readStream.schema(EVENT.split(",", 1)[1]).parquet(f"{home}/{name}")
        return rows.withWatermark("clock", f"{delay // timedelta(milliseconds=1)} milliseconds")

    found = dealt(stream("sales").union(stream("changes")), heavy, shards).groupBy("shard").applyInPandasWithState(
        step, FOUND, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    needed = {"spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.streaming.multipleWatermarkPolicy": "min"}
    before = {name: spark.conf.get(name, None) for name in needed}
    for name, value in needed.items():
        spark.conf.set(name, value)
    try:
        query = (
            found.writeStream.outputMode("append").option("checkpointLocation", f"{home}/checkpoint")
            .foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{home}/found/batch={k}"))
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _put_together(found: DataFrame) -> DataFrame:
    """One row for each sale and late change. A sale that cells of a grid answered takes the last of their candidates,
    unless it is older than the last of their floors: then the client has pruned it."""
    floor = F.struct(*[F.col(f"floor_{c}").alias(c) for c in ("at", "seq", "id")])
    hit = F.struct("at", "seq", F.col("change_id").alias("id"), F.col("op"), F.nullif("balance", F.lit(float("nan"))).alias("balance"), "fresh")
    found = found.withColumns({"floor": F.when(F.col("has_floor"), floor), "hit": F.when(F.col("at") != NONE, hit)})
    alone = found.where("cells = 1").select("rec", "id", "batch", "others", "floor", "hit")
    several = found.where("cells > 1").groupBy("uid").agg(
        F.first("rec").alias("rec"), F.first("id").alias("id"), F.first("batch").alias("batch"), F.sum("others").alias("others"),
        F.max("floor").alias("floor"), F.max("hit").alias("hit"),
    )
    stays = F.col("hit.fresh") | F.col("floor").isNull() | (F.struct("hit.at", "hit.seq", "hit.id") >= F.struct("floor.at", "floor.seq", "floor.id"))
    both = alone.unionByName(several.drop("uid")).withColumn("hit", F.when(stays, F.col("hit")))
    return both.select(
        "rec", F.nullif("id", F.lit(NONE)).alias("id"), F.col("batch").cast("long").alias("batch"),
        F.when(F.col("rec") == "sale", F.col("others") + F.col("floor").isNotNull().cast("long")).alias("n_held"),
        F.nullif("hit.id", F.lit(NONE)).alias("change_id"), F.col("hit.balance").alias("balance"), F.col("hit.op").alias("op"),
    )
