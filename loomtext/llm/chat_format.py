"""Chat formatting by a grammar round trip.

Grammar of a rendered conversation: turns of ``<|im_start|>`` role, newline, text, ``<|im_end|>`` newline. The parser
is deterministic: it reads exactly this grammar and takes back one escape level. Text conflicts with the grammar when
what is parsed differs from what was rendered. ``render`` first writes every turn as it is, parses the result, and
escapes the turns that don't come back, until source and reading are identical. Escaping puts one more backslash
between ``<`` and ``|`` wherever any number of them (none included) stands there, and is undone by taking one away, so
it is reversible for every text, escaped-looking ones included.

Turns are gathered by conversation with a map-side hash shuffle of the rows; a conversation is the unit of formatting
and is whole in one row. Defined cases: null role or text is empty; turns of equal number are ordered by role, then
text; a null conversation id is a conversation of its own; repeated rows are repeated turns; extra columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only

START, END = "<|im_start|>", "<|im_end|>"
_PLAIN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


class GrammarError(ValueError):
    pass


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def _unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def parse_spans(formatted: str) -> list[tuple[str, int, int]]:
    """(role, start and end of the text as written) for each turn; raises GrammarError outside the grammar."""
    spans, at = [], 0
    while at < len(formatted):
        line = formatted.find("\n", at)
        end = formatted.find(END, line + 1)
        if not formatted.startswith(START, at) or line < 0 or end < 0 or not formatted.startswith("\n", end + len(END)):
            raise GrammarError(f"no turn at {at}")
        role = formatted[at + len(START) : line]
        if START in role or END in role or formatted.find(START, line + 1, end) >= 0:
            raise GrammarError(f"control string inside the turn at {at}")
        spans.append((_unescape_role(role), line + 1, end))
        at = end + len(END) + 1
    return spans


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(role, unescape(formatted[a:b])) for role, a, b in parse_spans(formatted)]


def _write(role: str, text: str) -> str:
    return f"{START}{role}\n{text}{END}\n"


def _comes_back(role: str, text: str, written: str) -> bool:
    try:
        return parse(written) == [(role, text)]
    except GrammarError:
        return False


def render(turns: list[tuple[str, str]]) -> str:
    """The formatted conversation; parse() gives back exactly the turns."""
    parts = [_write(role, text) for role, text in turns]
    for _ in range(3):
        whole = "".join(parts)
        try:
            if parse(whole) == turns:
                return whole
        except GrammarError:
            pass
        for k, (role, text) in enumerate(turns):
            if not _comes_back(role, text, parts[k]):
                parts[k] = _write(_escape_role(role), escape(text))
    raise GrammarError("the conversation doesn't come back")


def loss_spans(formatted: str, role: str = "assistant") -> list[tuple[int, int]]:
    """Where the formatted text is under the loss mask: the texts of the role's turns."""
    return [(a, b) for r, a, b in parse_spans(formatted) if r == role]


def gathered(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turns): each conversation with its turns in order."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = only(df, conv_col, turn_col, role_col, text_col)
    turn = F.struct(F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    turns = F.transform(F.array_sort(F.collect_list(turn)), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return rows.groupBy(conv_col).agg(turns.alias("turns"))


def format_chats(df: DataFrame, **columns: str) -> DataFrame:
    """(conv, formatted, n_turns, loss_spans): the rendered text and where its loss mask is set."""
    conversations = gathered(df, **columns)
    conv = conversations.columns[0]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [render([(t["role"], t["text"]) for t in turns]) for turns in batch.column(1).to_pylist()]
            spans = [[{"start": a, "end": b} for a, b in loss_spans(text)] for text in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(texts, pa.string()),
                    pa.array([len(x) for x in batch.column(1)], pa.int32()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ],
                names=[conv, "formatted", "n_turns", "loss_spans"],
            )

    kind = conversations.schema[0].dataType.simpleString()
    return conversations.mapInArrow(walk, f"`{conv}` {kind}, formatted string, n_turns int, loss_spans array<struct<start:int,end:int>>")


def chat_digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from format_chats()."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[x["start"] : x["end"]]) for x in spans)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                row = (len(turns), _hex(whole), len(loss), _hex(loss), len(text))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    conv = formatted.columns[0]
    rows = formatted.select(conv, "formatted", "loss_spans")
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(walk, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
