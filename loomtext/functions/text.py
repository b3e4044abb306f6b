"""Column functions over text: trimming, tokens, clipping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ustrip(c: Column) -> Column:
    """Strips Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s++|\s++$", "")


def is_blank(c: Column) -> Column:
    """Null, empty or white space only; never null."""
    return F.coalesce(ustrip(c) == "", F.lit(True))


def tokens(c: Column) -> Column:
    """White-space-separated tokens."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def n_tokens(c: Column) -> Column:
    return F.size(tokens(c)).cast("long")


def terms(c: Column) -> Column:
    """Lower-cased tokens of two or more word characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\b\w\w+\b)"), F.lit(1))


def clip(c: Column, most: int, mark: str = "…") -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(mark))).otherwise(c)


def ordinal(rate: Column, *steps: tuple[float | None, str]) -> Column:
    """The name of the first step that rate stays below; the last step has no limit."""
    out = F
    for limit, name in steps[:-1]:
        out = out.when(rate < limit, name)
    return out.otherwise(steps[-1][1])
