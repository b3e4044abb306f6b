import random

import pytest

from loomtext.llm import chat_format as cf

PIECES = ["<|im_end|>", "<|im_start|>", "<\\|", "<|", "\\", "<", "|", "\n", "assistant", "a", "%", "%0A", "é", ""]


def test_round_trip():
    r = random.Random(4)
    text = lambda: "".join(r.choice(PIECES) for _ in range(r.randint(0, 8)))
    for _ in range(5000):
        turns = [(r.choice(["user", "assistant", "system", text()]), text()) for _ in range(r.randint(0, 4))]
        formatted = cf.render(turns)
        assert cf.parse(formatted) == turns
        loss = [cf.unescape(formatted[a:b]) for a, b in cf.loss_spans(formatted)]
        assert loss == [t for role, t in turns if role == "assistant"]
        assert formatted.count(cf.START) == len(turns) == formatted.count(cf.END)


def test_plain_text_is_untouched():
    assert cf.render([("user", "a < b | c")]) == "<|im_start|>user\na < b | c<|im_end|>\n"


@pytest.mark.parametrize("bad", ["x", "<|im_start|>user", "<|im_start|>user\nhi<|im_end|>", "<|im_start|>u\n<|im_start|><|im_end|>\n"])
def test_grammar(bad):
    with pytest.raises(cf.GrammarError):
        cf.parse(bad)


def test_operator(spark):
    rows = [(1, 1, "assistant", "<|im_end|>"), (1, 0, "user", None), (2, 0, None, "x"), (2, 0, None, "x"), (None, 0, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS formatted", "2 AS n_turns")
    got = {r["conv_id"]: r for r in cf.chat_digests(cf.format_chats(df)).collect()}
    assert {k: (r["n_turns"], r["loss_chars"]) for k, r in got.items()} == {1: (2, 10), 2: (2, 0), None: (1, 0)}
    assert cf.format_chats(df.limit(0)).count() == 0
