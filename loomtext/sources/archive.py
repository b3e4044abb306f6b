"""Project archives: tables of several kinds in one Parquet folder, each row a VARIANT tagged with its kind and version.

A kind names what a table is (segments, an annotation session, ...) and has a decoder for each version that was ever
written: the columns that rows of that version have, and what makes the next version's columns of them. Archives of
older versions are read through all the decoders that follow. A plain table is of no kind; its columns are kept beside
it. An entry that can't be read (a row that doesn't have its columns, an unknown kind, a newer version) is None and a
warning, and the others are read all the same.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .io import LoadError

ARCHIVE_VERSION = 2
PLACE = "line_start int, line_end int, char_start int, char_end int, paragraph_index int"


@dataclass(frozen=True)
class Decoder:
    """columns: of rows of this version. upgrade: makes rows of the next version of them; the newest has none."""

    columns: str
    upgrade: Callable[[DataFrame], DataFrame] | None = None


def _named_sessions(df: DataFrame) -> DataFrame:
    return df.withColumns({"session": F.lit(""), "note": F.lit("")})


#: Versions of each kind, from 1. A new version is added at the end; old ones stay.
KINDS: dict[str, tuple[Decoder, ...]] = {
    "annotations": (
        Decoder("item long, label string, status string, seq long", _named_sessions),
        Decoder("session string, item long, label string, status string, note string, seq long"),
    ),
    "annotation_log": (Decoder("session string, seq long, action string, target long, label string, note string"),),
    "segments": (Decoder(f"doc_id long, segment_id int, text string, {PLACE}"),),
    "windows": (Decoder(f"doc_id long, segment_id int, text string, {PLACE}, core_sentence string, core_start int, core_end int"),),
    "extractions": (Decoder("doc_id long, segment_id int, rq_label string, sub_theme string, confidence double, evidence_span string, reasoning string"),),
    "extraction_log": (Decoder("doc_id long, seq long, action string, item int, segment_id int, rq_label string, sub_theme string, threshold double"),),
    "questions": (Decoder("rq_id string, description string, sub_themes array<string>"),),
    "replacements": (Decoder("text_id long, start int, end int, span string, type string, confidence double, replacement string"),),
    "themes": (Decoder("name string, description string, inclusion array<string>, exclusion array<string>"),),
}
TABLE = "table"


def save(entries: dict[str, tuple[str, DataFrame]], values: dict, path: str) -> None:
    """entries: name to (kind, table); the kind of any other table is ``table``. A kind's table must have its columns;
    others are left out. values: what JSON can hold."""
    if not entries:
        raise ValueError("an archive holds at least one table")
    manifest: dict[str, dict] = {}
    rows = None
    for name, (kind, df) in sorted(entries.items()):
        if kind == TABLE:
            version, columns = 1, df.columns
            manifest[name] = {"kind": kind, "version": version, "columns": df.schema.jsonValue()}
        else:
            version = len(KINDS[kind])
            wanted = StructType.fromDDL(KINDS[kind][-1].columns)
            if missing := [f.name for f in wanted if f.name not in df.columns]:
                raise ValueError(f"{name}: {kind} lack {missing}")
            df, columns = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted]), wanted.names
            manifest[name] = {"kind": kind, "version": version}
        part = df.select(F.lit(name).alias("entry"), F.lit(kind).alias("kind"), F.lit(version).alias("version"), F.to_variant_object(F.struct(*columns)).alias("value"))
        rows = part if rows is None else rows.unionByName(part)
    rows.write.mode("overwrite").partitionBy("entry").parquet(f"{path}/entries")
    text = json.dumps({"archive_version": ARCHIVE_VERSION, "entries": manifest, "values": values}, ensure_ascii=False, sort_keys=True)
    rows.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def _decoded(rows: DataFrame, told: dict, name: str) -> DataFrame:
    kind, version = told.get("kind"), told.get("version")
    if kind == TABLE:
        decoders, columns = (), StructType.fromJson(told["columns"])
    elif kind not in KINDS:
        raise LoadError(f"{name}: unknown kind {kind!r}")
    elif not isinstance(version, int) or not 1 <= version <= len(KINDS[kind]):
        raise LoadError(f"{name}: version {version} of {kind} is not known")
    else:
        decoders = KINDS[kind][version - 1 :]
        columns = StructType.fromDDL(decoders[0].columns)
    own = rows.where((F.col("entry") == name) & (F.col("kind") == kind) & (F.col("version") == version))
    # a row is whole if it is an object and every value it has reads as its column's type
    cells = [F.struct(F.try_variant_get("value", f"$['{f.name}']", f.dataType.simpleString()).alias("x"), F.variant_get("value", f"$['{f.name}']", "variant").alias("v")).alias(f"c{k}") for k, f in enumerate(columns)]
    is_object = F.schema_of_variant("value").startswith("OBJECT")
    read = own.select("value", is_object.alias("object"), *cells)
    broken = ~F.coalesce(F.col("object"), F.lit(False))
    for k in range(len(columns)):
        broken |= F.col(f"c{k}.x").isNull() & F.col(f"c{k}.v").isNotNull() & ~F.is_variant_null(F.col(f"c{k}.v"))
    n, bad = read.agg(F.count("*"), F.count_if(broken)).first()
    others = rows.where(F.col("entry") == name).count() - n
    if bad or others:
        raise LoadError(f"{name}: {bad + others} of {n + others} rows can't be read as version {version} of {kind}")
    out = read.select(*[F.col(f"c{k}.x").alias(f.name) for k, f in enumerate(columns)])
    for decoder in decoders:
        if decoder.upgrade is not None:
            out = decoder.upgrade(out)
    return out.select(*StructType.fromDDL(decoders[-1].columns).names) if decoders else out


def load(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame | None], dict, list[str]]:
    """(tables by name, values, warnings)."""
    try:
        manifest = json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/manifest", wholetext=True).collect()))
        entries = manifest["entries"]
    except (ValueError, KeyError, TypeError) as e:
        raise LoadError(f"{path}: not an archive: {e}") from e
    rows = spark.read.schema("kind string, version int, value variant, entry string").parquet(f"{path}/entries")
    tables: dict[str, DataFrame | None] = {}
    warnings = []
    for name, told in entries.items():
        try:
            tables[name] = _decoded(rows, told, name)
        except LoadError as e:
            tables[name] = None
            warnings.append(str(e))
    return tables, manifest.get("values", {}), warnings
