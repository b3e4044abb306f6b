"""Bitmaps over hashes of keys, in DataFrame functions only: small enough to be broadcast, with false hits and no misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 32768  # bits in a page of Spark's bitmaps
LEAST, MOST = 8 * PAGE, 1 << 28


def bits_for(keys: int, most: int = MOST) -> int:
    """Bits of a bitmap for so many keys: eight a key (one false hit in eight keys at most), up to ``most``."""
    bits = LEAST
    while bits < 8 * keys and bits < most:
        bits *= 2
    return bits


def bitmap(keys: DataFrame, column: str, bits: int) -> DataFrame:
    """(page, bits): the bitmap of the column's values; aggregated map-side."""
    at = F.pmod(F.xxhash64(column), F.lit(bits))
    return keys.groupBy(F.floor(at / PAGE).cast("int").alias("page")).agg(F.bitmap_construct_agg(at % PAGE).alias("bits"))


def _placed(rows: DataFrame, at: Column) -> DataFrame:
    """rows with (_page, _bit), never null in the plan either: a check for nulls would be pushed below what makes the key,
    and make it a second time."""
    page, bit = F.floor(at / PAGE).cast("int"), (at % PAGE).cast("int")
    return rows.withColumn("_page", F.coalesce(page, F.lit(0))).withColumn("_bit", F.coalesce(bit, F.lit(0)))


def maybe(rows: DataFrame, column: str, kept: DataFrame, bits: int) -> DataFrame:
    """The rows whose value may be among the keys of kept. Of bits bits, kept is broadcast: 32 MB at most."""
    at = F.pmod(F.xxhash64(column), F.lit(bits))
    rows = _placed(rows, at)
    byte = F.conv(F.hex(F.expr("substring(bits, _bit div 8 + 1, 1)")), 16, 10).cast("int")
    found = rows.join(F.broadcast(kept), rows["_page"] == kept["page"])
    return found.where(byte.bitwiseAND(F.expr("shiftleft(1, _bit % 8)")) != 0).drop("_page", "_bit", "page", "bits")


def flagged(rows: DataFrame, column: str, kept: DataFrame, bits: int, name: str) -> DataFrame:
    """rows with a boolean column: whether the value may be among the keys of kept."""
    at = F.pmod(F.xxhash64(column), F.lit(bits))
    rows = _placed(rows, at)
    found = rows.join(F.broadcast(kept.withColumnsRenamed({"page": "_page", "bits": "_bits"})), "_page", "left")
    byte = F.conv(F.hex(F.expr("substring(_bits, _bit div 8 + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, _bit % 8)")) != 0, F.lit(False))
    return found.withColumn(name, hit).drop("_page", "_bit", "_bits")
