"""Arrow batches in slices, and operators that pass columns through as they are."""

import pyarrow as pa

from loomtext.functions.batches import in_slices
from loomtext.operators import completion, runs


def test_in_slices():
    texts = ["x" * (k % 7) for k in range(5000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[a:b], pa.string())], names=["t"]) for a, b in ((0, 10), (10, 10), (10, 5000))]
    found = list(in_slices(batches, 600))
    assert [t for s in found for t in s.column(0).to_pylist()] == texts
    assert max(s.num_rows for s in found) == 600
    long = pa.RecordBatch.from_arrays([pa.array(["y" * 1000] * 100)], names=["t"])
    assert [s.num_rows for s in in_slices([long], 600, 10_050)] == [10] * 10
    assert [s.num_rows for s in in_slices([long], 600, 10)] == [1] * 100


def test_other_columns_pass(spark):
    """Whole numbers beyond 2 ** 53 beside a null, which a frame would have made a float."""
    rows = [(2**53 + 1, "a the b", [1, None]), (None, "c", None), (2**53 + 3, None, []), (4, "the", [2])]
    df = spark.createDataFrame(rows, "k long, prompt string, xs array<int>").coalesce(1)
    found = completion.complete(df, completion.TableProvider({"the": "yes"}, "no"), concurrency=3).collect()
    assert [tuple(r) for r in found] == [(*row, None if row[1] is None else "yes" if "the" in row[1] else "no") for row in rows]


class Sees:
    def complete(self, prompt, system=""):
        return prompt


def test_ask_sends_keys_and_prompts_alone(spark, tmp_path, monkeypatch):
    sent = []
    whole = runs.complete
    monkeypatch.setattr(runs, "complete", lambda df, *args, **options: sent.append(df.columns) or whole(df, *args, **options))
    df = spark.createDataFrame([(1, "long text", "p"), (2, "other", "q")], "id long, text string, prompt string")
    found = runs.ask(df, ["id"], Sees(), str(tmp_path / "replies")).orderBy("id").collect()
    assert [tuple(r) for r in found] == [(1, "long text", "p", "p"), (2, "other", "q", "q")]
    assert sent == [["id", "prompt"]]
