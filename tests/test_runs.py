"""Runs over batches of which some fail, against a server and against plain Python."""

import json
import re
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from loomtext.operators import completion, runs, themes

SEG = "doc_id long, segment_id int, text string, line_start int, line_end int, char_start int, char_end int, paragraph_index int"
QUESTIONS = [{"rq_id": "RQ1", "description": "what", "sub_themes": ["a"]}, {"rq_id": "RQ2", "description": "why"}]


@pytest.fixture
def server():
    """Finds the segments that ask something; fails every third call for good, and remembers what it was asked."""
    calls, lock = [], threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            prompt = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][-1]["content"]
            with lock:
                calls.append(prompt)
                fails = len(calls) % 3 == 0
            matches = [{"segment_id": int(i), "rq_id": "RQ1", "sub_theme": "a", "confidence": 2, "evidence_span": "?"} for i, t in re.findall(r"^\[(\d+)\] (.*)$", prompt, re.M) if "?" in t]
            self.send_response(400 if fails else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"message": {"content": "Found: " + json.dumps({"matches": matches})}}).encode())

        def log_message(self, *_):
            pass

    found = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=found.serve_forever, daemon=True).start()
    yield completion.ChatService("ollama", "m", base_url=f"http://127.0.0.1:{found.server_port}"), calls
    found.shutdown()


def test_no_batch_is_lost(spark, server, tmp_path):
    provider, calls = server
    rows = [(d, k, f"text {d} {k}{'?' if (d * k) % 4 == 1 else ''}", k, k, 0, 5, k) for d in range(5) for k in range(1, 31)]
    segments = spark.createDataFrame(rows, SEG)
    matches, batches = runs.extract(segments, QUESTIONS, provider, str(tmp_path / "replies"), size=10, rounds=4, parallelism=1)
    got = sorted((r["doc_id"], r["segment_id"], r["rq_id"], r["sub_theme"], r["confidence"], r["text"]) for r in matches.collect())
    assert got == sorted((d, k, "RQ1", "a", 1.0, t) for d, k, t, *_ in rows if "?" in t)
    asked = Counter(calls)
    assert len(asked) == 15 and len(calls) < 15 * 2 and sum(n - 1 for n in asked.values()) == len(calls) // 3  # only what failed was asked again
    report = {r["name"]: r["n"] for r in runs.extraction_report(matches, batches, QUESTIONS).collect()}
    assert report == {"batches": 15, "failed": 0, "matches": len(got), "segments": len(got), "RQ1": len(got), "RQ2": 0}
    before = len(calls)  # a run that goes on asks nothing again
    again, _ = runs.extract(segments, QUESTIONS, provider, str(tmp_path / "replies"), size=10)
    assert again.count() == len(got) and len(calls) == before


class Down:
    def complete(self, prompt, system=""):
        raise OSError("down")


def test_all_fail(spark, tmp_path):
    segments = spark.createDataFrame([(1, 1, "a?", 1, 1, 0, 2, 0)], SEG)
    matches, batches = runs.extract(segments, QUESTIONS, Down(), str(tmp_path / "r"), rounds=2)
    report = {r["name"]: r["n"] for r in runs.extraction_report(matches, batches, QUESTIONS).collect()}
    assert report == {"batches": 1, "failed": 1, "matches": 0, "segments": 0, "RQ1": 0, "RQ2": 0}
    empty, batches = runs.extract(segments.limit(0), QUESTIONS, Down(), str(tmp_path / "e"))
    assert empty.count() == batches.count() == 0


class Rules:
    """Strict prompts look for one word, others for another; one text gets no answer."""

    def complete(self, prompt, system=""):
        if "no answer" in prompt:
            raise ValueError
        return f'{{"label": "{"yes" if ("good" if "STRICT" in prompt else "o") in prompt.split("Text:")[-1] else "no"}"}}'


def test_variants(spark, tmp_path):
    texts = ["good", "no", "bad", "good x", "no answer", "fine", None, "good"]
    truth = ["Yes", "no", "no", "yes", "no", "no", "no", None]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(zip(texts, truth))], "k long, text string, truth string")
    variants = {"strict": "STRICT Text: {text}", "plain": "Is it good?"}
    found = runs.run_variants(df, variants, Rules(), ["yes", "no"], "k", "text", "truth", str(tmp_path / "r"), most=None)
    said = {(r["id"], r["variant"]): r["predicted"] for r in found.collect()}
    assert len(said) == 14 and said[4, "plain"] == runs.ERROR and said[0, "strict"] == "yes" and said[1, "plain"] == "yes" and said[6, "plain"] == "no"
    detail = {r["id"]: r for r in runs.variant_detail(found, list(variants)).collect()}
    assert detail[0]["strict right"] and not detail[1]["plain right"] and detail[1]["strict right"] and not detail[4]["strict right"] and len(detail) == 7
    scores = {r["variant"]: r for r in runs.variant_scores(found).collect()}
    assert scores["strict"]["best"] and not scores["plain"]["best"] and scores["strict"]["accuracy"] == round(6 / 7, 4)
    few = runs.run_variants(df, variants, Rules(), ["yes", "no"], "k", "text", "truth", str(tmp_path / "few"), most=5)
    assert {r["id"] for r in few.collect()} == set(range(5))
    with pytest.raises(ValueError):
        runs.run_variants(df.limit(3), variants, Rules(), ["yes", "no"], "k", "text", "truth", str(tmp_path / "x"))
    with pytest.raises(ValueError):
        runs.run_variants(df, {}, Rules(), ["yes", "no"], "k", "text", "truth", str(tmp_path / "x"))
    with pytest.raises(completion.CostLimitExceeded) as e:
        runs.run_variants(df, variants, Rules(), ["yes", "no"], "k", "text", "truth", str(tmp_path / "cost"), most=None, model="gpt-4o", cost_limit=0.0)
    assert e.value.estimate["n_prompts"] == 14


def test_themes_by_model(spark):
    df = spark.createDataFrame([(k, "garden flower soil" if k % 2 else "engine wheel") for k in range(6)], "id long, text string")
    by_model = themes.suggest(df, "id", "text", completion.TableProvider({}, 'Here: [{"name": "Plants", "description": "d"}, {"x": 1}]')).collect()
    assert [(r["name"], r["description"], r["coverage"]) for r in by_model] == [("Plants", "d", None)]
    for provider in (None, completion.TableProvider({}, "no idea")):
        assert [r["coverage"] for r in themes.suggest(df, "id", "text", provider, starts=2, n_themes=2).collect()] == [0.5, 0.5]


class Picks:
    """Picks the last texts of one label, gives nonsense for another, and a number too high for a third."""

    def complete(self, prompt, system=""):
        label = prompt.split("Label: ")[1].split("\n")[0]
        return {"a": "Sure: [4, 2, 4]", "b": "none of them", "c": "[99]"}[label]


def test_examples_by_model(spark):
    from loomtext.operators import prompting, tfidf

    rows = [(10 * k + j, label, f"{label} word{j} {'same ' * j}") for k, label in enumerate("abcd") for j in range(5 if label != "d" else 2)] + [(99, None, "x"), (98, "a", None)]
    df = spark.createDataFrame(rows, "id long, label string, text string")
    found = sorted(map(tuple, prompting.select_examples_by(Picks(), df, "id", "text", "label", 2).collect()))
    diverse = sorted(map(tuple, tfidf.select_examples(df.where("label in ('b', 'c')"), "id", "text", "label", 2).select("label", "pick", "id").collect()))
    assert found == sorted([("a", 1, 3), ("a", 2, 1), *diverse, ("d", 1, 30), ("d", 2, 31)])
