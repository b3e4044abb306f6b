import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from loomtext.operators import completion


class Slow:
    """Counts how many calls run at a time, in a file for each process."""

    def __init__(self, path):
        self.path = path

    def complete(self, prompt, system=""):
        global running
        with lock:
            running += 1
            with open(self.path, "a") as f:
                f.write(f"{running}\n")
        time.sleep(0.05)
        with lock:
            running -= 1
        return prompt.upper()


lock, running = threading.Lock(), 0


def test_concurrency_is_bounded(spark, tmp_path):
    path = str(tmp_path / "calls")
    df = spark.createDataFrame([(f"p{k}",) for k in range(20)] + [(None,)], "prompt string")
    out = completion.complete(df, Slow(path), parallelism=1, concurrency=4).collect()
    assert {r["prompt"]: r["reply"] for r in out} == {f"p{k}": f"P{k}" for k in range(20)} | {None: None}
    at_once = [int(x) for x in open(path)]
    assert len(at_once) == 20 and 1 < max(at_once) <= 4


class Never:
    def complete(self, prompt, system=""):
        raise AssertionError("called")


def test_cost_gate(spark):
    df = spark.createDataFrame([("one two three",)] * 10, "prompt string")
    with pytest.raises(completion.CostLimitExceeded) as e:
        completion.complete(df, Never(), model="gpt-4o", max_tokens=100, cost_limit=0.001)
    assert e.value.estimate["n_prompts"] == 10 and e.value.estimate["input_tokens"] == 30
    answers = completion.TableProvider({"one": "yes"})
    assert completion.complete(df, answers, model="gpt-4o", cost_limit=float("inf")).where("reply = 'yes'").count() == 10
    assert completion.complete(df, answers, model="a model without a price", cost_limit=0.0).count() == 10


@pytest.fixture
def server():
    """Answers in the form of each service; the first call of each prompt that says so fails."""
    failed = set()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            turns, prompt = body["messages"], body["messages"][-1]["content"]
            system = body.get("system") or (turns[0]["content"] if turns[0]["role"] == "system" else "")
            said = f"{system}|{prompt}|{body['model']}|{self.headers.get('x-api-key') or self.headers.get('Authorization') or '-'}"
            code = 200
            if "bad" in prompt:
                code = 400
            elif "busy" in prompt and prompt not in failed:
                failed.add(prompt)
                code = 429
            reply = {"/v1/messages": {"content": [{"type": "text", "text": said}]}, "/api/chat": {"message": {"content": said}}}
            out = json.dumps(reply.get(self.path, {"choices": [{"message": {"content": said}}]})).encode()
            self.send_response(code)
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *_):
            pass

    found = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=found.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{found.server_port}"
    found.shutdown()


@pytest.mark.parametrize(("service", "key"), [("openai", "Bearer k"), ("anthropic", "k"), ("ollama", "-")])
def test_services(spark, server, service, key):
    provider = completion.ChatService(service, "m", "k", server)
    assert provider.complete("hi", "be kind") == f"be kind|hi|m|{key}"
    assert provider.complete("hi") == f"|hi|m|{key}"
    waits = []
    assert completion.with_retries(provider, f"busy {service}", sleep=waits.append) == f"|busy {service}|m|{key}" and waits == [1.0]
    with pytest.raises(Exception, match="400"):
        completion.with_retries(provider, "bad")
    df = spark.createDataFrame([("a",), ("b",)], "prompt string")
    assert {r["reply"] for r in completion.complete(df, provider, concurrency=2).collect()} == {f"|a|m|{key}", f"|b|m|{key}"}


def test_unknown_service():
    with pytest.raises(ValueError):
        completion.ChatService("other", "m")
    assert completion.with_retries(completion.ChatService("ollama", "m", base_url="http://127.0.0.1:1"), "x", sleep=lambda _: None) is None
