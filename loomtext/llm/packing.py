"""Best-fit packing of documents into sequences, as vector bin packing.

Every document becomes token ids with an end id; only a document longer than a sequence is cut, its first piece taking
what is over. A piece is a vector of tokens, documents (1) and attention cost (its length squared); a sequence has a
capacity for each. Pieces are placed longest first. Of the open sequences that have room in every dimension, the one
is chosen whose residual after placement has the smallest weighted norm, or with ``rule="dot"`` whose residual has the
largest weighted dot product with the piece; if none has room, a sequence is opened.

Scale: tokenising is one scan without a shuffle, and writes a few dozen bytes a piece. Pieces are then dealt evenly
(round robin over the written table, so no key decides) into blocks of ``block`` pieces that are packed on their own;
a block leaves about one sequence part-filled, which is under 0.1 % of its sequences. Memory is bounded by a block.

Defined cases: a null text counts as empty, and an empty document is its end id alone. Repeated rows are packed as
often as they occur, as are rows without an id. Extra columns are ignored. An empty table gives an empty result. A document of any length is cut
into pieces of which each fits; with capacities that no piece could meet, the operator raises.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import library_encoder
from .common import lean, only, written

PIECES = "piece int, start long, length long, ids_crc32 long"


def cut(total: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of total ids: all of the most, but the first, which takes what is over."""
    first = total if total <= most else total % most or most
    return [(0, first), *((at, most) for at in range(first, total, most))]


def pieces(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 2048, end_id: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of each document's pieces."""
    rows = only(df, id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(path).encode
        for batch in batches:
            of, out = [], []
            for row, text in enumerate(batch.column(1)):
                ids = array("I", encode(text.as_py() or ""))
                ids.append(end_id)
                ids = np.asarray(ids, dtype="<u4").tobytes()
                for k, (start, length) in enumerate(cut(len(ids) // 4, max_tokens)):
                    of.append(row)
                    out.append((k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *columns], names=[id_col, "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(lean(walk), f"`{id_col}` {kind}, {PIECES}")


def best_fit(
    lengths: np.ndarray, max_tokens: int, max_docs: int | None = None, max_cost: int | None = None, rule: str = "norm", weights=(1.0, 0.05, 0.05)
) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, sequences numbered from 0."""
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {rule!r}")
    capacity = np.array([max_tokens, max_docs or max_tokens, max_cost or max_tokens**2], dtype=float)
    n = len(lengths)
    sequence, offset = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    if n and (lengths.max() > capacity[0] or float(lengths.max()) ** 2 > capacity[2]):
        raise ValueError("a piece exceeds a sequence's capacities")
    vectors = np.stack([lengths, np.ones(n), np.square(lengths, dtype=float)]).T / capacity
    weights = np.asarray(weights)
    # residuals of the open sequences, one column for each dimension; closed ones are taken out now and then
    room, names, used, count, opened = np.zeros((n, 3)), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), 0, 0
    order = np.lexsort((np.arange(n), -lengths))
    least = vectors[order[-1]] if n else None
    for step, item in enumerate(order):
        need = vectors[item]
        if step % 256 == 0 and count:
            stays = np.flatnonzero((room[:count] >= least - 1e-12).all(axis=1))
            room[: len(stays)], names[: len(stays)], used[: len(stays)] = room[stays], names[stays], used[stays]
            count = len(stays)
        fits = np.flatnonzero((room[:count, 0] >= need[0] - 1e-12) & (room[:count, 1] >= need[1] - 1e-12) & (room[:count, 2] >= need[2] - 1e-12))
        if len(fits):
            left = room[fits]
            score = np.square(left - need) @ weights if rule == "norm" else -(left @ (weights * need))
            k = fits[score.argmin()]
        else:
            k, room[count], names[count], used[count] = count, 1.0, opened, 0
            count, opened = count + 1, opened + 1
        sequence[item], offset[item] = names[k], used[k]
        used[k] += lengths[item]
        room[k] -= need
    return sequence, offset


def packed(pieces_: DataFrame, *, max_tokens: int = 2048, max_docs: int | None = None, max_cost: int | None = None, rule: str = "norm", block: int = 8192) -> DataFrame:
    """pieces_ with sequence_id and offset. Of pieces_, a written table, the number is known without reading it."""
    blocks = max(1, -(-pieces_.count() // block))
    dealt = pieces_.repartition(blocks)
    names = pieces_.columns

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, held, opened = TaskContext.get().partitionId() << 40, [], 0

        def placed():
            nonlocal held, opened
            whole = pa.Table.from_batches(held).combine_chunks()
            sequence, offset = best_fit(whole.column("length").to_numpy(), max_tokens, max_docs, max_cost, rule)
            out = whole.append_column("sequence_id", pa.array(sequence + opened + high)).append_column("offset", pa.array(offset))
            opened, held = opened + int(sequence.max()) + 1, []
            return out.to_batches()

        for batch in batches:
            for at in range(0, batch.num_rows, block):
                held.append(batch.slice(at, block))
                if sum(x.num_rows for x in held) >= block:
                    yield from placed()
        if sum(x.num_rows for x in held):
            yield from placed()

    kinds = ", ".join(f"`{n}` {pieces_.schema[n].dataType.simpleString()}" for n in names)
    return dealt.mapInArrow(lean(walk), f"{kinds}, sequence_id long, offset long")


def pack_documents(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 2048, end_id: int = 0, **parameters) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces."""
    found = written(pieces(df, path, id_col=id_col, text_col=text_col, max_tokens=max_tokens, end_id=end_id), "pieces")
    return packed(found, max_tokens=max_tokens, **parameters)
