"""The registered extraction run over texts that say what its prompts say, held against its SQL."""

import duckdb
import pytest

from loomtext.operators import completion
from loomtext.plans import registry

from .oracle import compare

TURNS = [
    ["Well. Is it so, or not", "What then?"], ["a STRICT rule", "none"], ["Which segments are these?", "Text: here?"],
    ["lines\n[2] that look numbered?\nand go on", "no"], ["Is it?", "[1] is it STRICT?"], ["x" * 499 + "?", "x" * 500 + "?"], [None, "why? " * 3],
]


@pytest.mark.parametrize("name", ["j19_run", "j19_report"])
def test_texts_that_look_like_prompts(spark, tmp_path, name):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", x) for c, turns in enumerate(TURNS) for t, x in enumerate(turns)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    compare(registry.QUERIES[name](spark, str(tmp_path)), con, registry.ORACLE_SQL[name])


def test_report_counts_questions_anywhere(spark, tmp_path):
    """Held against plain counts, since its SQL could share a cut: questions behind 500 characters, at the end of a long
    text, in the 16th segment, and none."""
    turns = [["x" * 500 + "?", "x" * 600], ["é" * 70_000 + " why?"], ["no"] * 15 + ["word " * 900 + "?"], ["none"]]
    rows = [(c, t, "user", x) for c, texts in enumerate(turns) for t, x in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = {r["name"]: r["n"] for r in registry.QUERIES["j19_report"](spark, str(tmp_path)).collect()}
    assert found == {"batches": 5, "failed": 0, "matches": 3, "segments": 3, "RQ1": 3, "RQ2": 0}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    compare(registry.QUERIES["j19_report"](spark, str(tmp_path)), con, registry.ORACLE_SQL["j19_report"])


def test_prompts_hold_whole_segments(spark):
    texts = ["a" * 501, "b" * 3000 + "!", "c"]
    segments = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts, 1)], "doc_id long, segment_id int, text string")
    whole = completion.extraction_batches(segments).collect()
    assert [r["prompt"] for r in whole] == ["\n\n".join(f"[{k}] {t}" for k, t in enumerate(texts, 1))]
    cut = completion.extraction_batches(segments, most=500).collect()
    assert [r["prompt"] for r in cut] == ["\n\n".join((f"[1] {'a' * 500}…", f"[2] {'b' * 500}…", "[3] c"))]
