"""Holds the enrichment against plain Python that replays the batches one after the other."""

import random
from datetime import datetime, timedelta

import pytest

from loomtext.llm import sale_enrichment

T0 = datetime(2024, 1, 1)
SALES = "sale_id long, client_id long, sold_at timestamp_ntz, batch int"
CHANGES = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, balance double, batch int"


def low(x):
    return (x is not None, x if x is not None else 0)


def replayed(sales, changes, batches, delay):
    """Every batch in order: late changes, versions, sales that leave, pruning; no state but lists of rows."""
    held, waiting, out, seen = {}, [], [], {"s": [], "c": []}
    for k in range(batches):
        marks = [max(seen[n]) - delay if seen[n] else None for n in ("s", "c")]
        h = None if None in marks else min(marks)
        for c in [c for c in changes if c[6] == k and c[4] is not None]:
            seen["c"].append(c[4])
            if marks[1] is not None and c[4] < marks[1]:
                out.append(("late", c[0], k, None, None, None, None))
            elif c[1] is not None:
                held.setdefault(c[1], []).append(c)
        new = [s for s in sales if s[3] == k]
        waiting += new
        stay = []
        for s in waiting:
            if s[2] is None or (h is not None and s[2] < h):
                out.append(answer(s, held, k))
            else:
                stay.append(s)
        waiting = stay
        seen["s"] += [s[2] for s in new if s[2] is not None]
        for client, versions in held.items():
            past = sorted((c for c in versions if h is not None and c[4] <= h), key=order)
            held[client] = [c for c in versions if c not in past[:-1]]
    return out + [answer(s, held, batches) for s in waiting]


def order(c):
    return (c[4], low(c[2]), low(c[0]), low(c[3]), low(c[5]))


def answer(s, held, k):
    versions = held.get(s[1], [])
    fits = [c for c in versions if s[2] is not None and c[4] <= s[2]]
    hit = max(fits, key=order) if fits else (None,) * 6
    return ("sale", s[0], k, len(versions), hit[0], hit[5], hit[3])


def made(seed, n, hot):
    r = random.Random(seed)
    hours = lambda: T0 + timedelta(hours=r.randrange(24 * 20))

    def client():
        return 7 if r.random() < hot else r.choice([None, *range(12)])

    sales = []
    for k in range(n):
        at = hours()
        batch = min(5, (at - T0).days * 6 // 20 + r.choice([0, 0, 0, 1, 3]))
        sales.append((k, client(), r.choice([at] * 9 + [None]), batch))
    changes = []
    for k in range(n):
        at = hours()
        batch = min(5, (at - T0).days * 6 // 20 + r.choice([0, 0, 0, 1, 2]))
        changes.append((k, client(), r.choice([None, 0, 1, 2]), r.choice("UID"), r.choice([at] * 9 + [None]), r.choice([None, 1.5, -2.0]), batch))
    sales = [s for s in sales if s[3] != 3]  # a batch without sales
    return sales + sales[:5], [c for c in changes if c[6] != 2]


@pytest.mark.parametrize(("hot", "pieces"), [(0.6, 6), (0.0, 2)])
def test_replay(spark, hot, pieces):
    sales, changes = made(3, 240, hot)
    delay = timedelta(hours=36)
    found = sale_enrichment.enrich(
        spark.createDataFrame([(*s, "x") for s in sales], SALES + ", shard string").withColumnRenamed("shard", "at"),
        spark.createDataFrame(changes, CHANGES), batches=6, delay=delay, pieces=pieces,
    )
    expected = replayed(sales, changes, 6, delay)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, expected))
    assert {e[0] for e in expected} == {"late", "sale"} and len({e[2] for e in expected}) == 7
    if hot:  # one client's sales and versions met in more than one cell
        grid = sale_enrichment.heavy_clients(
            spark.createDataFrame([(s[1],) for s in sales if s[1] is not None], "client long"),
            spark.createDataFrame([(c[1],) for c in changes if c[1] is not None], "client long"), pieces,
        )
        assert any(rows > 1 and columns > 1 for _, rows, columns in grid)


@pytest.mark.parametrize("empty", ["sales", "changes"])
def test_empty_tables(spark, empty):
    sales, changes = made(5, 30, 0.3)
    sales, changes = ([], changes) if empty == "sales" else (sales, [])
    found = sale_enrichment.enrich(spark.createDataFrame(sales, SALES), spark.createDataFrame(changes, CHANGES), batches=2)
    late = [(*s[:3], min(1, s[3])) for s in sales], [(*c[:6], min(1, c[6])) for c in changes]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, replayed(*late, 2, timedelta(hours=36))))
