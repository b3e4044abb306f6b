"""Names of persons, organisations and places, and dates: a detector for pii.detect().

Dates follow a small grammar. Names are found by decoding each text's tokens into the tags O, B-x and I-x with the best
sum of two kinds of scores: what a token's own form, its neighbours and a gazetteer say for a tag, and what one tag says
for the next. Gazetteer entries are found by an Aho-Corasick automaton over the text. A token that neither begins with a
capital nor lies in an entry is O whatever else holds, so the decoder runs over the few tokens between such ones, and its
work grows with the text's length.

What the language adds is learned from a corpus: words that it mostly writes in lower case are no names where they
begin a sentence. Confidence grows with the number of words, as 0.85 + 0.1 * min(words, 3) / 3.

A gazetteer and the common words travel with the detector to every task; both are bounded (MOST_ENTRIES, ``kept``).
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ENTRIES = 200_000
KINDS = ("PERSON", "ORG", "LOCATION")
TAGS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
NEVER = -1000

TITLES = frozenset("Mr Mrs Ms Miss Dr Prof Professor Sir Lady President Minister Judge Herr Frau Señor Señora Monsieur Madame".split())
PLACE_WORDS = frozenset("in at near from to toward towards en dans à bei nach aus".split())
ORG_WORDS = frozenset(
    "Inc Ltd LLC Corp Corporation Company Co GmbH AG SA University College Institute Bank Council Ministry Agency Association "
    "Foundation Committee Department Hospital School Party Union".split()
)
PARTICLES = frozenset("of de del la van von der den and & y und et".split())
MONTHS = "January February March April May June July August September October November December".split()

#: Scores of a token's features for the tags of a name, and of one tag after another.
BASE, CAPITAL, ENTRY, TITLED, PLACED, ORGANISED, ACRONYM, COMMON, PARTICLE = -3, 2, 8, 4, 3, 3, 2, -6, -3
INSIDE = {"PERSON": 3, "ORG": 2, "LOCATION": 1}
LONGER, ADJACENT = 2, -2

TOKEN = re.compile(r"[㐀-鿿]|[^\W\d_㐀-鿿]+(?:['’-][^\W\d_㐀-鿿]+)*|\d+|[^\w\s]")
_DAY, _MONTH = r"(?P<d{0}>\d{{1,2}})(?:st|nd|rd|th)?", rf"(?:{'|'.join(f'{m[:3]}(?:{m[3:]})?' if m[3:] else m for m in MONTHS)})\b\.?"
DATE = re.compile(
    r"(?=[\dJFMASOND])(?:" + "|".join([  # how they all begin
        r"\b\d{4}-(?P<m1>\d{1,2})-(?P<d1>\d{1,2})\b",
        r"\b(?P<d2>\d{1,2})[./](?P<m2>\d{1,2})[./](?:\d{4}|\d{2})\b",
        rf"\b{_DAY.format(3)}\s+(?:of\s+)?{_MONTH}(?:,?\s+\d{{4}}\b)?",
        rf"\b{_MONTH}\s+{_DAY.format(4)}\b(?:,?\s+\d{{4}}\b)?",
        rf"\b{_MONTH}\s+\d{{4}}\b",
        r"\d{4}年(?P<m5>\d{1,2})月(?:(?P<d5>\d{1,2})日)?",
    ]) + ")"
)


def confidence(span: str) -> float:
    return round(0.85 + 0.1 * min(len(span.split()), 3) / 3, 2)


def dates(text: str) -> Iterator[tuple[int, int]]:
    """Dates whose days and months exist."""
    for m in DATE.finditer(text):
        parts = {k: int(v) for k, v in m.groupdict().items() if v is not None}
        if all(1 <= v <= (31 if k[0] == "d" else 12) for k, v in parts.items()):
            yield m.span()


def transition(before: int, after: int) -> int:
    """The score of one tag after another, by their numbers in TAGS."""
    a, b = TAGS[before], TAGS[after]
    if b[0] == "I":
        return NEVER if a == "O" or a[2:] != b[2:] else INSIDE[b[2:]] if a[0] == "B" else LONGER
    return ADJACENT if a != "O" and b[0] == "B" else 0


STEPS = [[transition(a, b) for a in range(len(TAGS))] for b in range(len(TAGS))]


def decoded(scores: Sequence[Sequence[int]]) -> list[int]:
    """The tags with the best sum; among equal sums the earlier tags, from the last token back."""
    best, back = [s if TAGS[t][0] != "I" else NEVER for t, s in enumerate(scores[0])], []
    for token in scores[1:]:
        came = [max(range(len(TAGS)), key=lambda a: (best[a] + STEPS[b][a], -a)) for b in range(len(TAGS))]
        best = [best[came[b]] + STEPS[b][came[b]] + token[b] for b in range(len(TAGS))]
        back.append(came)
    tags = [max(range(len(TAGS)), key=lambda t: (best[t], -t))]
    for came in reversed(back):
        tags.append(came[tags[-1]])
    return tags[::-1]


#: Distinct runs of scores, and tokens in one, whose tags a task keeps.
KEPT_RUNS, KEPT_LENGTH = 1 << 14, 6
decoded_kept = functools.lru_cache(KEPT_RUNS)(decoded)


@functools.lru_cache(1 << 12)
def token_scores(capital: bool, tags: frozenset[str], common: bool, titled: bool, placed: bool, organised: bool, acronym: bool) -> tuple[int, ...]:
    """The scores by tag of a token with a capital or within an entry, of which tags are those it can have."""
    scores = [0]
    for tag in TAGS[1:]:
        first, kind = tag[0] == "B", tag[2:]
        s = BASE + CAPITAL * capital + ENTRY * (tag in tags) + COMMON * common
        s += TITLED * (first and kind == "PERSON" and titled) + PLACED * (first and kind == "LOCATION" and placed)
        s += ORGANISED * (kind == "ORG" and organised) + ACRONYM * (kind == "ORG" and acronym)
        scores.append(s)
    return tuple(scores)


NO_TAGS: frozenset[str] = frozenset()
PARTICLE_SCORES = (0, *[NEVER if tag[0] == "B" else PARTICLE for tag in TAGS[1:]])


@dataclass
class EntityDetector:
    """A Detector of the given kinds. gazetteer: entry to PERSON, ORG or LOCATION; common: words that are no names."""

    gazetteer: dict[str, str] = field(default_factory=dict)
    common: frozenset[str] = frozenset()
    kinds: tuple[str, ...] = (*KINDS, "DATE")
    _automaton: Any = field(default=None, init=False, repr=False)

    def __post_init__(self) -> None:
        if len(self.gazetteer) > MOST_ENTRIES:
            raise ValueError(f"the gazetteer has {len(self.gazetteer)} entries; {MOST_ENTRIES} at most travel to a task")
        if wrong := {*self.gazetteer.values()} - {*KINDS}:
            raise ValueError(f"unknown kinds {sorted(wrong)}")

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def entries(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(start, end, kind) of all entries in the text, wherever they lie."""
        if not self.gazetteer:
            return
        if self._automaton is None:
            made = ahocorasick.Automaton()
            for entry, kind in self.gazetteer.items():
                if entry:
                    made.add_word(entry, (len(entry), kind))
            made.make_automaton()
            self._automaton = made
        if len(self._automaton):
            for last, (n, kind) in self._automaton.iter(text):
                yield last + 1 - n, last + 1, kind

    def scored(self, text: str) -> tuple[list[tuple[int, int]], list[tuple[int, ...] | None]]:
        """The tokens and, for those that may belong to a name, their scores by tag."""
        spans = [m.span() for m in TOKEN.finditer(text)]
        listed: dict[int, set[str]] = {}
        entries = list(self.entries(text))
        if entries:
            starts, ends = {a: k for k, (a, _) in enumerate(spans)}, {b: k for k, (_, b) in enumerate(spans)}
            for a, b, kind in entries:
                if a in starts and b in ends:
                    listed.setdefault(starts[a], set()).add(f"B-{kind}")
                    for k in range(starts[a] + 1, ends[b] + 1):
                        listed.setdefault(k, set()).add(f"I-{kind}")
        words = [text[a:b] for a, b in spans]
        capital = [w[0].isupper() for w in words]
        found: list[tuple[int, ...] | None] = [None] * len(words)
        organised, run_end = False, -1
        for k, w in enumerate(words):
            if not capital[k] and k not in listed and w not in PARTICLES:
                continue
            if k > run_end:  # a run of capitals and particles: does it name a kind of organisation?
                run_end = k
                while run_end + 1 < len(words) and (capital[run_end + 1] or words[run_end + 1] in PARTICLES):
                    run_end += 1
                organised = any(words[j] in ORG_WORDS for j in range(k, run_end + 1))
            if not capital[k] and k not in listed:
                found[k] = PARTICLE_SCORES
                continue
            before = words[k - 1] if k else ""
            if before == "." and k > 1 and words[k - 2] in TITLES:
                before = words[k - 2]
            common = w not in ORG_WORDS and w.lower() in self.common
            tags = frozenset(listed[k]) if k in listed else NO_TAGS
            found[k] = token_scores(capital[k], tags, common, before in TITLES, before in PLACE_WORDS, organised, len(w) > 1 and w.isupper())
        return spans, found

    def names(self, text: str) -> Iterator[tuple[int, int, str]]:
        spans, scores = self.scored(text)
        k = 0
        while k < len(spans):
            end = k
            while end < len(spans) and scores[end] is not None:
                end += 1
            if end > k:
                run = tuple(scores[k:end])
                tags, j = [TAGS[t] for t in (decoded_kept(run) if end - k <= KEPT_LENGTH else decoded(run))], 0
                while j < len(tags):
                    stop = j + 1
                    if tags[j] != "O":
                        while stop < len(tags) and tags[stop] == f"I-{tags[j][2:]}":
                            stop += 1
                        yield spans[k + j][0], spans[k + stop - 1][1], tags[j][2:]
                    j = stop
            k = end + 1

    def __call__(self, text: str) -> Iterator[tuple[int, int, str, float]]:
        found = [(*s, "DATE") for s in dates(text)] if "DATE" in self.kinds else []
        found += [s for s in self.names(text) if s[2] in self.kinds]
        return ((a, b, kind, confidence(text[a:b])) for a, b, kind in found)


def common_words(df: DataFrame, text_col: str = "text", kept: int = 20_000, share: float = 0.5) -> frozenset[str]:
    """The ``kept`` most frequent words, first by name among equals, of whose occurrences over ``share`` are in lower case.
    Counts are added up in each task before they are shuffled."""
    words = df.select(F.explode(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(r"\p{L}+"), F.lit(0))).alias("w"))
    n = words.groupBy("w").agg(F.count("*").alias("n"))
    n = n.groupBy(F.lower("w").alias("word")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("w") == F.lower("w"), F.col("n")).otherwise(0)).alias("low"))
    return frozenset(r["word"] for r in n.where(F.col("low") > share * F.col("n")).orderBy(F.desc("n"), "word").limit(kept).collect())


def gazetteer(*tables: tuple[DataFrame, str, str]) -> dict[str, str]:
    """Entries of (table, column, kind): the distinct values, of which the first table to name one decides its kind. Over
    MOST_ENTRIES is an error, since every task holds them all."""
    out: dict[str, str] = {}
    for df, column, kind in tables:
        rows = df.where(F.length(F.trim(column)) > 1).select(F.trim(column).alias("x")).distinct().limit(MOST_ENTRIES + 1).collect()
        out = {r["x"]: kind for r in rows} | out
        if len(out) > MOST_ENTRIES:
            raise ValueError(f"a gazetteer holds {MOST_ENTRIES} entries at most")
    return out
