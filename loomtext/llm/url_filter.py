"""URL filters: a trie over reversed host labels, then path segments, with the longest match deciding.

The trie is built once from the rules on the driver, broadcast (its size is that of the rule list, which is
checked against ``MAX_RULE_BYTES``) and walked for Arrow batches of urls. Per url the walk costs one step per host
label and path segment, whatever the number of rules. The scan reads the id and url columns only; nothing shuffles.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule and gets the default
verdict; so do urls no rule fits. Equal rules of both verdicts: block wins. An empty rule list allows everything.
Repeated urls, and rows without an id, each keep their row; an empty table gives an empty result; extra columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import UPPER, only

MAX_RULE_BYTES = 64 << 20
_LOWER = str.maketrans(UPPER, UPPER.lower())
_HOST_END = re.compile(r"[/?#]")
_PATH_END = re.compile(r"[?#]")


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str  # fits itself and its subdomains
    path: str  # what the url's path starts with

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(slots=True)
class _Node:
    labels: dict = field(default_factory=dict)  # host label -> node
    segments: dict = field(default_factory=dict)  # whole path segment -> node
    tails: list = field(default_factory=list)  # (start of the last segment, rule), longest first


class UrlTrie:
    """Host labels from the right lead to a node; from it whole path segments lead on, and a rule's last path
    segment (often empty, for rules that end with a slash) is matched as the start of the url's segment."""

    def __init__(self, rules: Iterable[Rule]):
        self.root = _Node()
        size = 0
        for rule in rules:
            if rule.verdict not in ("allow", "block"):
                raise ValueError(f"unknown verdict {rule.verdict!r}")
            size += len(rule.text)
            if size > MAX_RULE_BYTES:
                raise ValueError(f"rules exceed {MAX_RULE_BYTES} bytes and can't be broadcast")
            node = self.root
            for label in reversed(rule.host.translate(_LOWER).split(".")):
                node = node.labels.setdefault(label, _Node())
            *whole, last = rule.path.split("/")
            for segment in whole:
                node = node.segments.setdefault(segment, _Node())
            node.tails.append((last, rule))
            node.tails.sort(key=lambda x: (-len(x[0]), x[1].verdict != "block"))

    def match(self, host: str, path: str) -> Rule | None:
        """The longest rule: by host first, then by path (hosts that fit one url are suffixes of each other)."""
        found, node = None, self.root
        pieces = path.split("/")
        for label in reversed(host.split(".")) if host else ():
            node = node.labels.get(label)
            if node is None:
                break
            found = self._longest(node, pieces, found)
        return found

    @staticmethod
    def _longest(node: _Node, pieces: list[str], found: Rule | None) -> Rule | None:
        best = None
        for piece in pieces:
            best = next((rule for start, rule in node.tails if piece.startswith(start)), best)
            node = node.segments.get(piece)
            if node is None:
                break
        if best is None or found is not None and len(found.text) > len(best.text):
            return found
        return best


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host from the first :// to /, ?, # or the end, A-Z lower-cased; path from there to ? or #."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = m.start() if (m := _HOST_END.search(rest)) else len(rest)
    path = rest[end:]
    return rest[:end].translate(_LOWER), path[: m.start()] if (m := _PATH_END.search(path)) else path


def filter_urls(df: DataFrame, rules: Iterable[Rule], *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for each row of df."""
    trie = df.sparkSession.sparkContext.broadcast(UrlTrie(rules))
    rows = only(df, id_col, url_col)
    kind = rows.schema[id_col].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = trie.value.match
        for batch in batches:
            parts = [split_url(url) for url in batch.column(1).to_pylist()]
            hits = [match(host, path) for host, path in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([host for host, _ in parts], pa.string()),
                    pa.array([path for _, path in parts], pa.string()),
                    pa.array([hit and hit.text for hit in hits], pa.string()),
                    pa.array([hit.verdict if hit else default for hit in hits], pa.string()),
                ],
                names=[id_col, "host", "path", "rule", "verdict"],
            )

    return rows.mapInArrow(walk, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
