import zlib

import numpy as np
import pytest

from loomtext.llm import bpe, packing
from loomtext.llm.queries import vocabulary

from .helpers import docs


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize(("max_docs", "max_cost"), [(None, None), (3, None), (5, 40_000)])
def test_capacities(rule, max_docs, max_cost):
    lengths = np.random.default_rng(1).integers(1, 200, 700)
    sequence, offset = packing.best_fit(lengths, 256, max_docs, max_cost, rule)
    for s in range(sequence.max() + 1):
        mine = np.flatnonzero(sequence == s)
        mine = mine[np.argsort(offset[mine])]
        assert (offset[mine] == np.concatenate([[0], np.cumsum(lengths[mine])[:-1]])).all()
        assert lengths[mine].sum() <= 256 and len(mine) <= (max_docs or 256) and np.square(lengths[mine]).sum() <= (max_cost or 256**2)
    least = -(-lengths.sum() // 256)
    if max_docs is None:
        assert sequence.max() + 1 <= 1.03 * least + 1


def test_best_fit_edges():
    assert len(packing.best_fit(np.array([], dtype=np.int64), 8)[0]) == 0
    with pytest.raises(ValueError):
        packing.best_fit(np.array([9]), 8)
    with pytest.raises(ValueError):
        packing.best_fit(np.array([3]), 8, max_cost=4)
    assert packing.cut(5, 2) == [(0, 1), (1, 2), (3, 2)] and packing.cut(4, 2) == [(0, 2), (2, 2)] and packing.cut(1, 2) == [(0, 1)]


def test_operator(spark):
    texts = [None, "", "hello there", "word " * 5000, "x y z " * 400, *["same"] * 50]
    found = packing.pack_documents(docs(spark, texts, extra=True), vocabulary(), max_tokens=128, block=16).collect()
    codec = bpe.codec(vocabulary())
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for k, text in enumerate(texts):
        ids, at = codec.encode(text or "") + b"\0\0\0\0", 0
        for p in sorted(by_doc[k], key=lambda r: r["piece"]):
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + p["length"])])
            at += p["length"]
        assert at == len(ids) // 4
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 128
    assert packing.pack_documents(docs(spark, []), vocabulary()).count() == 0
