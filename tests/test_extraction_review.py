"""The review of extractions against a replay of its events, one after the other."""

import random

from pyspark.sql import functions as F

from loomtext.operators import extraction_review as x

EXT = "doc_id long, segment_id int, rq_label string, sub_theme string, confidence double, evidence_span string, reasoning string"
SEG = "doc_id long, segment_id int, text string, line_start int, line_end int, char_start int, char_end int, paragraph_index int"
LOG = "doc_id long, seq long, action string, item int, segment_id int, rq_label string, sub_theme string, threshold double"


def replay(ext, seg, log):
    out = []
    places = {(s[0], s[1]): s for s in seg}
    for doc in {e[0] for e in ext} | {a[0] for a in log}:
        start = lambda e: places[doc, e[1]][5] if (doc, e[1]) in places else 0
        rows = sorted((e for e in ext if e[0] == doc), key=lambda e: (e[2], start(e), e[1], e[3], e[4]))
        state = [{"e": e, "s": "pending", "rq": None, "sub": None} for e in rows]
        for _, _, action, item, segment, rq, sub, threshold in sorted((a for a in log if a[0] == doc), key=lambda a: a[1]):
            if action == "add":
                if (doc, segment) in places:
                    state.append({"e": (doc, segment, rq, sub, 1.0, "", "added by hand"), "s": "accepted", "rq": None, "sub": None})
            elif action == "accept_high":
                for i in state:
                    if i["s"] == "pending" and i["e"][4] >= (0.85 if threshold is None else threshold):
                        i["s"] = "accepted"
            elif item is not None and 0 <= item < len(state):
                state[item]["s"] = {"accept": "accepted", "reject": "rejected", "edit": "edited"}[action]
                if action == "edit":
                    state[item]["rq"], state[item]["sub"] = rq or state[item]["rq"], sub or state[item]["sub"]
        for k, i in enumerate(state):
            e, edited = i["e"], i["s"] == "edited"
            labels = (i["rq"] or e[2] if edited else e[2], i["sub"] or e[3] if edited else e[3])
            at = places.get((doc, e[1]), (doc, e[1], None, 0, 0, 0, 0, 0))
            out.append((doc, k, e[1], at[2], *labels, e[4], *at[3:], i["s"], e[6], e[5]))
    return out


def test_replay(spark):
    r = random.Random(9)
    docs = [None, 1, 2, 3]
    seg = [(d, k, f"t{k}", k, k, 10 * k, 10 * k + 8, k) for d in docs for k in range(1, 6)]
    ext = [(r.choice(docs[:3]), r.choice([1, 2, 3, 9]), r.choice("ab"), r.choice("xy"), r.randrange(50, 100) / 100, f"e{k}", "why") for k in range(25)]
    ext = list({(e[0], e[1], e[2], e[3], e[4]): e for e in ext}.values())
    acts = ["accept", "reject", "edit", "edit", "add", "accept_high"]
    log = [(r.choice(docs), k, r.choice(acts), r.choice([None, -1, *range(12)]), r.choice([1, 2, 7]), r.choice([None, "n1", "n2"]), r.choice([None, "s1"]), r.choice([None, None, 0.6])) for k in range(120)]
    rows = x.reviewed(spark.createDataFrame(ext, EXT), spark.createDataFrame(seg, SEG), spark.createDataFrame(log, LOG))
    names = ["doc_id", "item", "segment_id", "text", "rq_label", "sub_theme", "confidence", *x.POSITION, "review_status", "reasoning", "evidence_span"]
    expected = replay(ext, seg, log)
    assert sorted(map(str, (tuple(i[n] for n in names) for i in rows.collect()))) == sorted(map(str, expected))
    assert {e[-3] for e in expected} == {"accepted", "rejected", "edited", "pending"}
    assert x.export(rows).count() == sum(e[-3] != "rejected" for e in expected)
    total = x.stats(rows).first()
    assert total["total"] == len(expected) and total["pending"] == sum(e[-3] == "pending" for e in expected)
    assert x.stats(rows.limit(0)).first()["progress"] == 0.0


def test_place(spark):
    seg = spark.createDataFrame([(1, 1, "a", 1, 1, 0, 5, 0), (1, 2, "b", 2, 2, 7, 9, 1), (None, 3, "c", 1, 1, 2, 4, 0)], SEG)
    found = spark.createDataFrame([(1, k, "x") for k in (-1, 0, 4, 5, 6, 7, 8, 9)] + [(None, 3, "y"), (2, 0, "z"), (1, None, "n")], "doc_id long, at int, text string")
    got = {(r["doc_id"], r["at"]): r["segment_id"] for r in x.place(found, seg).collect()}
    assert got == {(1, -1): None, (1, 0): 1, (1, 4): 1, (1, 5): None, (1, 6): None, (1, 7): 2, (1, 8): 2, (1, 9): None, (None, 3): 3, (2, 0): None, (1, None): None}
    assert x.place(found.limit(0), seg).count() == 0
    assert x.place(found, seg.where(F.lit(False))).where("segment_id is not null").count() == 0
