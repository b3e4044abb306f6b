import pytest

from loomtext.operators import completion
from loomtext.sources import io


def test_csv_variants(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,text\n1,\"a \"\"b\"\"\nc\"\n2,é\n".encode())
    (tmp_path / "b.csv").write_bytes("id\ttext\n1\tcafé\n".encode("latin-1"))
    a = io.load(spark, str(tmp_path / "a.csv")).orderBy("id").collect()
    assert [r["text"] for r in a] == ['a "b"\nc', "é"]
    assert io.load(spark, str(tmp_path / "b.csv")).first()["text"] == "café"


def test_json_and_text(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "b.json").write_text('{"data": [{"x": 3}]}')
    (tmp_path / "c.txt").write_text("one\n\n two \n")
    (tmp_path / "d.txt").write_text("\n \n")
    (tmp_path / "e.txt").write_bytes("你好\n".encode("gb18030"))
    assert io.load(spark, str(tmp_path / "a.json")).count() == 2
    assert io.load(spark, str(tmp_path / "b.json")).first()["x"] == 3
    assert sorted(r["text"] for r in io.load(spark, str(tmp_path / "c.txt")).collect()) == ["one", "two"]
    with pytest.raises(io.LoadError):
        io.load(spark, str(tmp_path / "d.txt"))
    with pytest.raises(io.LoadError):
        io.load(spark, str(tmp_path / "f.zip"))
    with pytest.raises(io.LoadError):
        io.load(spark, str(tmp_path / "missing.csv"))
    assert io.load_document(spark, str(tmp_path / "e.txt")).first()["text"] == "你好\n"


def test_finetune_checks(spark):
    df = spark.createDataFrame([(i, f"t{i}", "a") for i in range(9)], "id long, text string, label string")
    with pytest.raises(ValueError):
        io.finetune_lines(df, "id", "text", "label", ["a"], "s")
    more = df.union(df.selectExpr("id + 100", "text", "'z'"))
    with pytest.raises(ValueError):
        io.finetune_lines(more, "id", "text", "label", ["a"], "s")


def test_project(spark, tmp_path):
    df = spark.range(3)
    io.save_project(spark, {"t": df}, {"k": [1, 2]}, str(tmp_path / "p"))
    tables, values, warnings = io.load_project(spark, str(tmp_path / "p"))
    assert tables["t"].count() == 3 and values == {"k": [1, 2]} and not warnings
    io.save_log(spark, {"pipeline": "qualitative", "n": 1}, str(tmp_path / "log"))
    assert io.load_log(spark, str(tmp_path / "log"))["n"] == 1


def test_retries():
    class Flaky:
        calls = 0

        def complete(self, prompt, system):
            self.calls += 1
            if self.calls < 3:
                raise completion.Transient
            return "ok"

    waits = []
    assert completion.with_retries(Flaky(), "p", sleep=waits.append) == "ok" and waits == [1.0, 2.0]

    class Down:
        def complete(self, prompt, system):
            raise completion.Transient

    assert completion.with_retries(Down(), "p", sleep=waits.append) is None


def test_head(spark, tmp_path):
    (tmp_path / "big.csv").write_bytes(b"a,b\n" + b"1,2\n" * 50_000)
    assert io._head(spark, str(tmp_path / "big.csv")) == (b"a,b\n" + b"1,2\n" * 50_000)[: io.HEAD]
    (tmp_path / "d.csv").mkdir()
    (tmp_path / "d.csv" / "_SUCCESS").write_bytes(b"")
    (tmp_path / "d.csv" / "part-0").write_bytes(b"x\ty\n1\t2\n")
    assert io._head(spark, str(tmp_path / "d.csv")) == b"x\ty\n1\t2\n"
    assert io.load_csv(spark, str(tmp_path / "d.csv"), multi_line=False).columns == ["x", "y"]
    assert io.load_csv(spark, str(tmp_path / "big.csv"), multi_line=False).count() == 50_000
    with pytest.raises(io.LoadError):
        io._head(spark, str(tmp_path / "nothing"))
