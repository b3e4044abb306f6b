"""Readers and writers of text tables, fine-tuning files, run logs and project archives.

Everything is read and written by Spark, from any store that it reads. Only the head of a delimited file is looked at
on the driver, to tell its encoding and separator.
"""

from __future__ import annotations

import json
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ustrip


class LoadError(ValueError):
    """A table that can't be read."""


TEMPLATES = {"quantitative": "id long, text string, label string", "qualitative": "id long, speaker_id string, text string, timestamp string"}
HEAD = 1 << 16


def template(spark: SparkSession, mode: str) -> DataFrame:
    if mode not in TEMPLATES:
        raise ValueError(f"unknown mode {mode!r}")
    return spark.createDataFrame([], TEMPLATES[mode])


def load(spark: SparkSession, path: str) -> DataFrame:
    """A table by its suffix: csv, tsv, json, jsonl, ndjson, txt, parquet, orc; xlsx where a reader is installed."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    reader = {".csv": load_csv, ".tsv": load_csv, ".json": load_json, ".jsonl": load_jsonl, ".ndjson": load_jsonl, ".txt": load_lines, ".parquet": lambda s, p: s.read.parquet(p), ".orc": lambda s, p: s.read.orc(p), ".xlsx": load_excel, ".xls": load_excel}.get(suffix)
    if reader is None:
        raise LoadError(f"no reader for {suffix or path!r}")
    try:
        return reader(spark, path)
    except LoadError:
        raise
    except Exception as e:
        raise LoadError(f"{path}: {e}") from e


def _head(spark: SparkSession, path: str) -> bytes:
    """The first bytes of a file, or of the first file of a folder that has any, whatever its size. Only they are read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files = []
    for found in fs.globStatus(at) or []:
        inside = fs.listStatus(found.getPath()) if found.isDirectory() else [found]
        files += [(x.getPath().toString(), x) for x in inside if not x.isDirectory() and x.getPath().getName()[0] not in "_."]
    if not files:
        raise LoadError(f"{path}: nothing there")
    first = next((x for _, x in sorted(files, key=lambda f: f[0]) if x.getLen()), None)
    if first is None:
        return b""
    stream = fs.open(first.getPath())
    try:
        return bytes(stream.readNBytes(HEAD))
    finally:
        stream.close()


def _encoding(head: bytes, then: str) -> str:
    for cut in range(4):  # a character may be cut at the end of the head
        try:
            head[: len(head) - cut if len(head) == HEAD else None].decode("utf-8")
            return "utf-8"
        except UnicodeDecodeError:
            continue
    return then


def load_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """UTF-8 (with a mark or without), else Latin-1; a single column that holds tabs is read by tabs. Fields may hold line
    breaks, for which a file is one task's; without multi_line large files are split."""
    head = _head(spark, path)
    encoding = _encoding(head, "iso-8859-1")
    first = head.decode(encoding, "replace").lstrip("﻿").split("\n", 1)[0]
    separator = "\t" if "," not in first and "\t" in first else ","
    options = {"header": True, "inferSchema": True, "multiLine": multi_line, "quote": '"', "escape": '"', "encoding": encoding, "sep": separator}
    df = spark.read.options(**options).csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of objects, or an object that holds one under data."""
    df = spark.read.json(path, multiLine=True)
    if df.columns == ["data"] and df.schema["data"].dataType.simpleString().startswith("array<struct"):
        return df.selectExpr("inline(data)")
    if "data" in df.columns and df.schema["data"].dataType.simpleString().startswith("array<struct"):
        return df.selectExpr("inline(data)")
    if df.columns == ["_corrupt_record"]:
        raise LoadError(f"{path}: not a list of objects")
    return df


def load_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def load_lines(spark: SparkSession, path: str) -> DataFrame:
    """(text): a row for each line that isn't blank."""
    rows = spark.read.text(path).select(ustrip(F.col("value")).alias("text")).where("text != ''")
    if rows.isEmpty():
        raise LoadError(f"{path}: no text")
    return rows


def load_document(spark: SparkSession, path: str, preview: int = 3000) -> DataFrame:
    """(path, text, n_chars, n_lines, preview) of whole files; UTF-8, else GB18030."""
    rows = spark.read.format("binaryFile").load(path)

    @F.pandas_udf("string")
    def decoded(content: pd.Series) -> pd.Series:  # Spark's decode() knows few character sets
        return content.map(lambda raw: raw.decode("utf-8" if _encoding(raw, "") else "gb18030", "replace"))

    rows = rows.select("path", decoded("content").alias("text"))
    return rows.select("path", "text", F.length("text").alias("n_chars"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n_lines"), F.substring("text", 1, preview).alias("preview"))


def load_excel(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet, by pandas on the driver; needs openpyxl."""
    import pandas as pd

    try:
        return spark.createDataFrame(pd.read_excel(path))
    except ImportError as e:
        raise LoadError(f"{path}: {e}") from e


# writers


def save_csv(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def annotations_display(df: DataFrame, most: int = 80) -> DataFrame:
    """text cut at most characters, and first after the id."""
    cut = F.when(F.length("text") > most, F.concat(F.substring("text", 1, most), F.lit("..."))).otherwise(F.col("text"))
    return df.select("id", "status", "label", cut.alias("text"))


def save_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """A folder with a Parquet table for each sheet."""
    for name, df in sheets.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def save_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def chat_record(system: str, text: Column, label: Column) -> Column:
    """One line of a fine-tuning file: system, user, assistant."""
    said = [F.struct(F.lit(role).alias("role"), c.alias("content")) for role, c in (("system", F.lit(system)), ("user", text), ("assistant", label))]
    return F.to_json(F.struct(F.array(*said).alias("messages")))


def finetune_lines(df: DataFrame, id_col: str, text_col: str, label_col: str, labels: list[str], system: str, seed: int = 42, least: int = 10) -> DataFrame:
    """(id, line) in an order fixed by seed. Raises for fewer than least rows or a label that isn't among labels."""
    rows = df.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).withColumn("__l", F.col(label_col).cast("string"))
    n, odd = rows.agg(F.count("*"), F.min(F.when(~F.col("__l").isin(*labels), F.col("__l")))).first()
    if n < least:
        raise ValueError(f"{n} rows; at least {least} are needed")
    if odd is not None:
        raise ValueError(f"unknown label {odd!r}")
    return rows.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).select(F.col(id_col).alias("id"), chat_record(system, F.col(text_col), F.col("__l")).alias("line"))


def save_log(spark: SparkSession, log: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(log, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_log(spark: SparkSession, path: str) -> dict:
    """A run's log with its pipeline key checked."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    log = json.loads(text)
    if not isinstance(log, dict) or log.get("pipeline") not in ("quantitative", "qualitative"):
        raise LoadError(f"{path}: not a run's log")
    return log


def save_project(spark: SparkSession, tables: dict[str, DataFrame], values: dict, path: str, version: str = "1.0") -> None:
    """Tables as Parquet, values as JSON, and a manifest."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/tables/{name}")
    manifest = {"version": version, "tables": sorted(tables), "values": values}
    save_log(spark, manifest, f"{path}/manifest")


def load_project(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame | None], dict, list[str]]:
    """(tables, values, warnings); a table that can't be read is None and a warning."""
    manifest = json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/manifest", wholetext=True).collect()))
    tables: dict[str, DataFrame | None] = {}
    warnings = []
    for name in manifest["tables"]:
        try:
            tables[name] = spark.read.parquet(f"{path}/tables/{name}")
        except Exception as e:
            tables[name] = None
            warnings.append(f"{name}: {e}")
    return tables, manifest["values"], warnings
