"""Byte-level BPE encoding and decoding.

A word (what the pattern cuts out of a text) becomes a doubly linked list of byte symbols. A heap holds
``(rank, position)`` of the pairs that have a merge; the pair of lowest rank, leftmost first, is merged, the pairs it
makes with its neighbours are pushed, and entries whose symbols have changed meanwhile are skipped as stale. Decoding
concatenates the vocabulary's strings. The vocabulary file is a parameter (a ``tokenizers`` JSON file of kind BPE with
the ByteLevel pre-tokenizer); added tokens in a text are cut out first, as that library does.

Speed comes from not merging a word twice: texts are cut at spaces, and a bounded two-generation cache holds the ids
of each piece with its leading space, as bytes. A cut there never changes the words unless white space meets white
space; texts where it does are cut by the pattern as a whole. Each executor process builds the encoder once; its memory
is bounded by the vocabulary and two caches of ``CACHE`` bytes each, which hold no word above ``LONG`` characters. Nothing
shuffles; a lost task is encoded again.

Defined cases: a null text counts as empty and has no ids; an empty text decodes to the empty text; white space only,
control characters and any Unicode text round-trip; repeated rows and rows without an id are each returned; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from hashlib import sha256
from heapq import heapify, heappop, heappush
from struct import pack, unpack

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import lean, only

#: Fixed value: the pattern that cuts texts into words before byte-level merges, as the vocabularies were made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 64 << 20
LONG = 256


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where Latin-1 prints it, else from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    later = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(later)) for b in range(256)]


class _Cache(dict):
    """A dict of words that fills itself, of about so many bytes; when full, the older generation goes and the younger
    becomes the older. What is longer than ``LONG`` characters isn't held."""

    def __init__(self, make, size: int = CACHE):
        super().__init__()
        self.make, self.size, self.old, self.held = make, size // 2, {}, 0

    def __missing__(self, key):
        value = self.old.get(key, self)
        if value is self:
            value = self.make(key)
        if value is not None and len(key) <= LONG:
            self.held += 200 + 2 * len(key) + len(value)  # two objects, their entry, and their contents
            if self.held > self.size:
                self.old, self.held = dict(self), 0
                self.clear()
            self[key] = value
        return value


class BpeCodec:
    def __init__(self, path: str, cache: int = CACHE):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError(f"{path}: only byte-level BPE without a normalizer or prefix space")
        symbols = byte_symbols()
        byte_of = {c: b for b, c in enumerate(symbols)}
        vocab = model["vocab"]
        self.byte_ids = [vocab[c] for c in symbols]
        self.ranks, self.left, self.right, self.made = {}, [], [], []
        for merge in model["merges"]:
            x, y = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks.setdefault(vocab[x] << 32 | vocab[y], len(self.left))
            self.left.append(vocab[x])
            self.right.append(vocab[y])
            self.made.append(vocab[x + y])
        self.strings = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items()}
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        self.strings |= {i: s.encode() for s, i in self.added.items()}
        self.added_pattern = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.words = regex.compile(PATTERN.replace(r"^\s", r"^\p{White_Space}").replace(r"\s+", r"\p{White_Space}+").replace(r"\S", r"\P{White_Space}"))
        self.word_ids = _Cache(self._merge_word, cache)
        self.piece_ids = _Cache(self._piece, cache)

    def merge(self, symbols: list[int]) -> list[int]:
        """The symbols after all merges, by the heap over the linked list. An entry is rank << 32 | position."""
        n = len(symbols)
        if n < 2:
            return symbols
        rank_of, lefts, rights, mades = self.ranks.get, self.left, self.right, self.made
        symbols = [*symbols, -1]  # the list ends in a symbol that nothing merges with
        before, after = list(range(-1, n)), list(range(1, n + 2))
        heap = [rank << 32 | i for i, pair in enumerate(zip(symbols, symbols[1:-1])) if (rank := rank_of(pair[0] << 32 | pair[1])) is not None]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            j = after[i]
            if symbols[i] != lefts[rank] or symbols[j] != rights[rank]:
                continue  # stale
            made = symbols[i] = mades[rank]
            symbols[j] = -1
            k = after[i] = after[j]
            before[k] = i
            if symbols[k] >= 0 and (rank := rank_of(made << 32 | symbols[k])) is not None:
                heappush(heap, rank << 32 | i)
            h = before[i]
            if h >= 0 and (rank := rank_of(symbols[h] << 32 | made)) is not None:
                heappush(heap, rank << 32 | h)
        return [s for s in symbols if s >= 0]

    def _merge_word(self, word: str) -> bytes:
        ids = self.byte_ids
        merged = self.merge([ids[b] for b in word.encode("utf-8", "surrogatepass")])
        return pack(f"<{len(merged)}I", *merged)

    def _piece(self, piece: str) -> bytes | None:
        """Ids of a space and the piece behind it; None where the cut before the piece may differ from the pattern's."""
        if not piece or piece[0].isspace():
            return None
        return self._whole(" " + piece)

    def _whole(self, text: str) -> bytes:
        ids = self.word_ids
        return b"".join([ids[word] for word in self.words.findall(text)])

    def _plain(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        ids = self.piece_ids
        found = [ids[piece] for piece in rest]
        if None in found:
            return self._whole(text)
        return b"".join([self._whole(first), *found])

    def encode(self, text: str) -> bytes:
        """The ids, as little-endian unsigned 32-bit integers."""
        if self.added_pattern is None or not self.added_pattern.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.added_pattern.finditer(text):
            out += [self._plain(text[at : m.start()]), pack("<I", self.added[m[0]])]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        strings = self.strings
        return b"".join([strings[i] for i in unpack(f"<{len(ids) // 4}I", ids)]).decode("utf-8", "replace")


@functools.cache
def codec(path: str) -> BpeCodec:
    """One codec in each process for each vocabulary."""
    return BpeCodec(path)


class LibraryEncoder:
    """Ids of whole texts from a library over the same vocabulary, for callers that want the ids and not this module's
    merging: about twice as fast, and without caches. Long runs of white space, which exhaust that library's stack, are
    merged here."""

    RUN = re.compile(r"\s{5000}")

    #: Fixed value: PATTERN in the form of possessive repeats, which match the same.
    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

    def __init__(self, path: str):
        import tiktoken

        self.own = own = codec(path)
        if any(a >= b for a, b in zip(own.made, own.made[1:])):
            raise ValueError("the vocabulary's ids don't follow the ranks of its merges")
        ranks = {s: i for i, s in own.strings.items() if i not in own.added.values()}
        self.of = tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.added, self.added_pattern = own.added, own.added_pattern

    def encode(self, text: str) -> list[int]:
        if len(text) > 5000 and self.RUN.search(text):
            return memoryview(self.own.encode(text)).cast("I").tolist()
        if self.added_pattern is None or not self.added_pattern.search(text):
            return self.of(text)
        out, at = [], 0
        for m in self.added_pattern.finditer(text):
            out += [*self.of(text[at : m.start()]), self.added[m[0]]]
            at = m.end()
        return out + self.of(text[at:])


@functools.cache
def library_encoder(path: str) -> LibraryEncoder:
    """One encoder in each process for each vocabulary."""
    return LibraryEncoder(path)


def bpe_digests(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for each row of df."""
    rows = only(df, id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            counts, ids_hex, decoded_hex = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                counts.append(len(ids) // 4)
                ids_hex.append(sha256(ids).hexdigest())
                decoded_hex.append(sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(decoded_hex, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(lean(walk), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of each row of df, as array<int>."""
    rows = only(df, id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            ids = [memoryview(bpe.encode(text.as_py() or "")).cast("I").tolist() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return rows.mapInArrow(lean(walk), f"`{id_col}` {kind}, ids array<int>")


def decode(df: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of token ids; null ids give the empty text, an id outside the vocabulary an error."""
    rows = only(df, id_col, ids_col)
    kind = rows.schema[id_col].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            texts = [bpe.decode(pack(f"<{len(ids)}I", *ids)) for ids in (x.as_py() or [] for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return rows.mapInArrow(lean(walk), f"`{id_col}` {kind}, text string")
