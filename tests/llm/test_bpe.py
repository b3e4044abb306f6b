import hashlib
import os
import random
import struct

import pytest

from loomtext.llm import bpe
from loomtext.llm.queries import vocabulary

from .helpers import docs, rows

SMALL = "/root/testdata/sf0.001"

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PARTS = [" ", "  ", "\n", "\t", "a", "the", "'s", "é", "漢字", "😀", "<|endoftext|>", "<|endof", "1", "23", "_", "!", "\xa0", "\x00", "\x1c", "²", "Ⅷ", "́", "'ll", "\r\n", "ñ"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(1)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(3000)] + ["", " ", "ab" * 50_000, "x" * 3000]


def test_same_ids_as_the_library(texts):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(vocabulary())
    ours, fast = bpe.BpeCodec(vocabulary()), bpe.LibraryEncoder(vocabulary())
    for text, found in zip(texts, theirs.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = ours.encode(text)
        assert list(memoryview(ids).cast("I")) == found.ids == fast.encode(text)
        assert ours.decode(ids) == theirs.decode(found.ids, skip_special_tokens=False) == text


def test_documents_have_the_same_ids(spark):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(vocabulary())
    found = bpe.bpe_digests(spark.read.parquet(f"{SMALL}/documents.parquet"), vocabulary()).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    assert len(found) >= len(texts) > 0
    for r in found:
        ids = theirs.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_cache_is_bounded_and_changes_nothing(texts):
    small, large = bpe.BpeCodec(vocabulary(), cache=4000), bpe.codec(vocabulary())
    assert all(small.encode(t) == large.encode(t) for t in texts[:500])
    assert small.word_ids.held <= 2000 and len(small.word_ids) + len(small.word_ids.old) <= 20


def test_operator(spark):
    texts = ["Hello world", None, "", "Hello world"]
    found = bpe.bpe_digests(docs(spark, texts, extra=True), vocabulary())
    empty = hashlib.sha256(b"").hexdigest()
    got = rows(found, "doc_id", "n_tokens", "decoded_sha256")
    assert got[1] == (1, 0, empty) and got[2] == (2, 0, empty) and got[0][1:] == got[3][1:]
    back = bpe.decode(bpe.encode(docs(spark, texts), vocabulary()), vocabulary())
    assert rows(back, "doc_id", "text") == [(k, t or "") for k, t in enumerate(texts)]
    assert bpe.bpe_digests(docs(spark, []), vocabulary()).count() == 0
