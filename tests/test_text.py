import random
import re
import time

import pytest
from pyspark.sql import functions as F

from loomtext.functions.text import is_blank, ustrip
from loomtext.operators import pii, segment


def test_blank_and_strip(spark):
    df = spark.createDataFrame([("　a \n",), ("",), (None,), (" \t",)], "t string")
    assert [tuple(r) for r in df.select(ustrip(F.col("t")), is_blank(F.col("t"))).collect()] == [("a", False), ("", True), (None, True), ("", True)]


PARAGRAPH = re.compile(r"[^\n](?:[^\n]|\n(?!\s*\n))*")


def test_paragraphs(spark):
    r = random.Random(5)
    texts = ["".join(r.choice("ab \n\n") for _ in range(r.randint(1, 40))) for _ in range(300)] + ["x" * 100_000 + "\n\ny"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for row in segment.segment(df).collect():
        got.setdefault(row["doc_id"], []).append(row)
    for k, text in enumerate(texts):
        wanted = [(i + 1, m[0].strip(), *m.span()) for i, m in enumerate(PARAGRAPH.finditer(text)) if m[0].strip()]
        rows = sorted(got.get(k, []), key=lambda x: x["segment_id"])
        assert [(x["segment_id"], x["text"], x["char_start"], x["char_end"]) for x in rows] == wanted
        assert all(x["line_start"] == text.count("\n", 0, x["char_start"]) + 1 for x in rows)


def test_sentences_and_windows(spark):
    text = "First one. Is it? Yes!Then more... and 3.14 is kept. 你好。再见！End"
    df = spark.createDataFrame([(1, text), (2, "a. b. c."), (3, "  "), (4, None)], "doc_id long, text string")
    rows = segment.segment(df, mode="sentence").collect()
    assert {r["doc_id"] for r in rows} == {1, 2}
    assert all(text[r["char_start"] : r["char_end"]] == r["text"] for r in rows if r["doc_id"] == 1)
    windows = segment.segment(df, mode="context_window", window=1).where("doc_id = 2").orderBy("segment_id").collect()
    assert [(w["text"], w["core_sentence"]) for w in windows] == [("a. b.", "a."), ("a. b. c.", "b."), ("b. c.", "c.")]
    assert all(w["text"][w["core_start"] : w["core_end"]] == w["core_sentence"] for w in windows)


def test_pii_round(spark):
    rows = [(1, "Mail Bob Stone at a@b.com or +1 212-555-0100"), (2, "again A@B.com, see https://x.org/y?z 10.0.0.1"), (3, "无 王小明老师 123-45-6789"), (4, None), (5, "clean")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.detect(df)
    texts = dict(rows)
    hits = found.collect()
    assert all(texts[h["text_id"]][h["start"] : h["end"]] == h["span"] for h in hits)
    assert {"EMAIL", "PHONE", "URL", "IP_ADDRESS", "PERSON", "SSN"} <= {h["type"] for h in hits}
    out = {r["text_id"]: r["text"] for r in pii.rewrite(df, pii.name_replacements(found)).collect()}
    assert "[EMAIL_1]" in out[1] and "[EMAIL_1]" in out[2] and "[NAME_1]" in out[1] and out[4] is None and out[5] == "clean"
    redacted = pii.rewrite(df, pii.name_replacements(found, "redact"))
    assert pii.detect(redacted.withColumnRenamed("text_id", "doc_id")).count() == 0
    with pytest.raises(ValueError):
        pii.name_replacements(found, "other")


def test_segments_by_brute_force():
    r = random.Random(11)
    for _ in range(400):
        text = "".join(r.choice(["ab", "c ", ".", "! ", "?", "...", "……", "。", "！", " ", "\n", "\n\n", "）", "😀"]) for _ in range(r.randint(0, 25)))
        paragraphs = [m.span() for m in PARAGRAPH.finditer(text)]
        for mode in ("sentence", "context_window", "paragraph"):
            seen = set()
            for row in segment.pieces(text, mode, 1):
                _, clean, first, last, a, b, k = row[:7]
                assert clean == text[a:b].strip() and (a, b) not in seen
                seen.add((a, b))
                assert first == text.count("\n", 0, a) + 1 and last == text.count("\n", 0, max(a, b - 1)) + 1
                assert k == next((i for i, (x, y) in enumerate(paragraphs) if x <= a < y), max(0, len(paragraphs) - 1))
                if mode == "context_window":
                    assert clean[row[8] : row[9]] == row[7]


def test_segments_take_time_in_proportion():
    def took(n):
        began = time.process_time()
        assert sum(1 for _ in segment.pieces("Some words here. And more! Is it?\n" * n, "sentence", 2)) == 2 * n  # a full stop cuts only where nothing else does
        return time.process_time() - began

    took(100)
    assert took(32_000) < 40 * max(took(2_000), 0.005)  # 16 times the text; the square would be 256
    assert len(list(segment.pieces("x\n" + " \n" * 100_000 + "y", "paragraph", 2))) == 2


def test_segments_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "A. B."), (7, "One. Two."), (7, "One. Two.")], "doc_id long, text string").withColumn("segment_id", F.lit("x"))
    rows = segment.segment(df, mode="sentence").collect()
    assert sorted((str(r["doc_id"]), r["segment_id"], r["text"]) for r in rows) == [("7", 1, "One."), ("7", 1, "One."), ("7", 2, "Two."), ("7", 2, "Two."), ("None", 1, "A."), ("None", 2, "B.")]
    assert segment.segment(df.limit(0), mode="context_window").count() == 0


def organisations(text):
    return [(m.start(), m.end(), "ORG", 0.9) for m in re.finditer(r"[A-Z]\w+ Institute|Bob", text)] + [(5, 5, "ORG", 0.9), (0, 10_000, "ORG", 0.9)]


def test_detectors_join_patterns(spark):
    df = spark.createDataFrame([(1, "Bob Stone of Turing Institute wrote to a@b.com"), (2, ""), (3, None)], "doc_id long, text string")
    found = pii.detect(df, detectors=(organisations,))
    assert sorted((r["start"], r["type"], r["span"]) for r in found.collect()) == [(0, "PERSON", "Bob Stone"), (13, "PERSON", "Turing Institute"), (39, "EMAIL", "a@b.com")]
    only = pii.detect(df, kinds=("EMAIL",), detectors=(organisations,))
    assert sorted((r["type"], r["span"]) for r in only.collect()) == [("EMAIL", "a@b.com"), ("ORG", "Bob"), ("ORG", "Turing Institute")]
    assert {r["replacement"] for r in pii.name_replacements(only, "category").collect()} == {"[EMAIL]", "[ORGANIZATION]"}


def test_review_of_replacements(spark):
    df = spark.createDataFrame([(1, "x@y.org, a@b.com and c@d.net; e@f.org"), (2, "none"), (3, None)], "doc_id long, text string")
    found = pii.name_replacements(pii.detect(df, kinds=("EMAIL",)))
    log = spark.createDataFrame([(1, 0, 1, "accepted", None), (1, 9, 2, "edited", "[A]"), (1, 21, 3, "edited", "[B]"), (1, 21, 4, "rejected", None)], "text_id long, start int, seq long, action string, value string")
    out = {r["text_id"]: r["text"] for r in pii.apply_review(df, found, log).collect()}
    assert out == {1: "[EMAIL_4], [A] and c@d.net; [EMAIL_1]", 2: "none", 3: None}


def test_segments_lose_personal_data(spark):
    df = spark.createDataFrame([(1, "Ask a@b.com.\n\nOr c@d.net, or A@B.com"), (2, "Nobody")], "doc_id long, text string")
    segments = segment.segment(df)
    out = pii.rewrite_segments(segments, kinds=("EMAIL",))
    assert out.columns == segments.columns
    assert sorted((r["doc_id"], r["segment_id"], r["text"]) for r in out.collect()) == [(1, 1, "Ask [EMAIL_1]."), (1, 2, "Or [EMAIL_2], or [EMAIL_1]"), (2, 1, "Nobody")]
