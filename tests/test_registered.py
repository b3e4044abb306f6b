"""Registered queries that have no SQL, held against plain Python over the same tables."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomtext.operators import pii
from loomtext.plans import registry

ORDER = ["EMAIL", "PHONE", "URL", "SSN", "IP_ADDRESS", "PERSON", "ID_CARD"]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in registry.table(spark, sf_dir, "documents").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def spans(texts):
    """(doc, start, end, type), kept by start, then order of detection."""
    out = []
    for doc, text in sorted(texts.items()):
        found = sorted((m.start(), k, m.end()) for k, kind in enumerate(ORDER) for m in re.finditer(pii.pattern(kind), text or ""))
        end = 0
        for start, k, stop in found:
            if start >= end and stop > start:
                out.append((doc, start, stop, ORDER[k]))
                end = stop
    return out


def test_detect(spark, sf_dir, texts, spans):
    found = registry.QUERIES["i1_i3_detect"](spark, sf_dir).collect()
    assert sorted((r["text_id"], r["start"], r["end"], r["type"]) for r in found) == spans and spans
    assert all(texts[r["text_id"]][r["start"] : r["end"]] == r["span"] for r in found)


def test_coverage(spark, sf_dir, spans):
    found = registry.QUERIES["i6_coverage"](spark, sf_dir).collect()
    assert {r["type"]: r["n"] for r in found} == Counter(kind for *_, kind in spans)


def test_rewrite(spark, sf_dir, texts, spans):
    numbers, counts = {}, Counter()
    for doc, a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        key = kind, texts[doc][a:b].lower().strip(" ")
        if key not in numbers:
            counts[kind] += 1
            numbers[key] = counts[kind]
    expected = dict(texts)
    for doc, a, b, kind in sorted(spans, reverse=True):
        token = f"[{pii.PREFIXES.get(kind, kind)}_{numbers[kind, texts[doc][a:b].lower().strip(' ')]}]"
        expected[doc] = expected[doc][:a] + token + expected[doc][b:]
    assert {r["text_id"]: r["text"] for r in registry.QUERIES["i4_i5_rewrite"](spark, sf_dir).collect()} == expected


def test_numbers_run_through_ranges(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("type"), (F.col("id") * 7919 % 5000).alias("seen"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = pii.in_order(rows, "type", ["seen"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for kind in "ab":
        mine = sorted((r["seen"], r["n"]) for r in found if r["type"] == kind)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))
    assert pii.in_order(rows.limit(0), "type", ["seen"]).count() == 0


@pytest.fixture(scope="module")
def annotated(spark, sf_dir):
    """(session, item, label, status) after all actions, replayed one by one."""
    items, log = registry._session(spark, sf_dir)
    expected = []
    logs = {}
    for r in sorted(log.collect(), key=lambda r: r["seq"]):
        logs.setdefault(r["session"], []).append((r["action"], r["target"], r["label"]))
    sessions = {}
    for r in sorted(items.collect(), key=lambda r: r["item"]):
        sessions.setdefault(r["session"], []).append(r["item"])
    for session, names in sessions.items():
        state, at, done = {k: (None, "pending") for k in range(len(names))}, 0, []
        for action, target, label in logs.get(session, []):
            if action == "goto":
                at = target
            elif action == "undo":
                if done:
                    at = done.pop()
                    state[at] = (None, "pending")
            else:
                old = state[at][0]
                state[at] = (label, "labeled") if action == "annotate" else (old, {"skip": "skipped", "flag": "flagged"}[action])
                done.append(at)
                at = next((k for k in range(at + 1, len(names)) if state[k][1] == "pending"), len(names))
        expected += [(session, names[k], *value) for k, value in state.items()]
    return expected


def test_annotations(spark, sf_dir, annotated):
    found = registry.QUERIES["g1_g4_annotations"](spark, sf_dir).collect()
    key = lambda r: (r[0], r[1])
    assert sorted(((r["session"], r["item"], r["label"], r["status"]) for r in found), key=key) == sorted(annotated, key=key)


def test_annotation_stats_and_export(spark, sf_dir, annotated):
    by_session = {}
    for session, _, _, status in annotated:
        by_session.setdefault(session, Counter())[status] += 1
    for r in registry.QUERIES["g5_g6_stats"](spark, sf_dir).collect():
        n = by_session.pop(r["session"])
        total = sum(n.values())
        assert (r["total"], *[r[s] for s in ("labeled", "skipped", "flagged", "pending")]) == (total, n["labeled"], n["skipped"], n["flagged"], n["pending"])
        assert abs(r["progress"] - 100 * (total - n["pending"]) / total) <= 0.05 + 1e-9 and r["complete"] == (n["pending"] == 0)
    assert not by_session
    found = registry.QUERIES["g7_export"](spark, sf_dir).collect()
    assert sorted((r["session"], r["item"], r["label"]) for r in found) == sorted(a[:3] for a in annotated if a[3] == "labeled")


def unit_vectors(texts, most):
    words = {i: re.findall(r"\b\w\w+\b", (t or "").lower()) for i, t in texts.items()}
    df, total = Counter(w for ws in words.values() for w in set(ws)), Counter(w for ws in words.values() for w in ws)
    kept = set(sorted(df, key=lambda w: (-total[w], w))[:most])
    out = {}
    for i, ws in words.items():
        v = {w: c * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w, c in Counter(ws).items() if w in kept}
        length = math.sqrt(sum(x * x for x in v.values()))
        out[i] = {w: x / length for w, x in v.items()}
    return out


def cosine(a, b):
    return sum(x * b.get(w, 0.0) for w, x in a.items())


def test_examples(spark, sf_dir, texts):
    vectors, expected = unit_vectors(texts, 3000), []
    for label, ids in (("even", [i for i in texts if i % 2 == 0]), ("odd", [i for i in texts if i % 2])):
        chosen = [min(ids)]
        while len(chosen) < 3:
            near = {i: max(round(cosine(vectors[i], vectors[c]), 9) for c in chosen) for i in ids if i not in chosen}
            chosen.append(min(near, key=lambda i: (near[i], i)))
        expected += [(label, k, i) for k, i in enumerate(chosen, 1)]
    assert sorted((r["label"], r["pick"], r["id"]) for r in registry.QUERIES["j16_examples"](spark, sf_dir).collect()) == sorted(expected)


def test_report(spark, sf_dir):
    counts = {r["metric"]: r["value"] for r in registry.QUERIES["e1_diagnostics"](spark, sf_dir).collect()}
    text = "\n".join(r[0] for r in registry.QUERIES["e11_report"](spark, sf_dir).collect())
    for metric, value in counts.items():
        assert re.search(rf"^{metric.replace('_', ' ')} +{value:,}$", text, re.M), metric


def test_detected_languages(spark, sf_dir, texts):
    found = registry.QUERIES["e6_detected"](spark, sf_dir).collect()
    assert sum(r["n"] for r in found) == min(100, sum(bool((t or "").strip()) for t in texts.values()))
    assert {r["value"] for r in found} <= {"en", "other"}
