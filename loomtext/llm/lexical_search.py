"""Ranked lexical search by windowed bucket scoring.

One scan turns every document into its number of terms and its postings, the counts of the terms that the queries ask
for. Ordered by doc_id, postings are traversed in windows of ``window`` documents that follow each other, so that
neither sparse nor repeated ids make a window thin or overflow it. Within a window postings lie term by term; a query's
terms scatter-add what they give into an array of the window's width, which fits a core's cache, and mark the documents
they touch in a bitset. What the bitset holds is harvested into the query's heap, in which a later document, having a
larger id, must beat the lowest score. Tasks emit their heaps, which are merged in two rounds.

All scores are integers: a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))) over the N documents with terms, of
L terms together; a document of n terms has m = 50 + (50 n N) div L, and a term that occurs tf times in it adds
weight * ((10^9 tf) div (1000 tf + 20 m)).

Scale: postings hold no texts and only terms of the queries. They are dealt by ranges of (doc_id, row), so no id fills a
task. Queries are taken in chunks of about ``chunk`` terms, the only thing the driver holds and sends to tasks; a task
emits k rows for a query at most.

Defined cases. A null or empty text, and one of separators alone, has no terms: it counts neither in N nor in L and is
found by no query; a query without terms finds nothing. Rows of documents that share an id are documents of their own,
as are rows of queries. Null ids of documents rank last among equal scores. Texts may have any length: they are cut into
terms a block at a time. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import deleted, lean, written

#: Bytes of one-byte characters that aren't letters or digits, and A-Z, and what becomes of them.
CLEAN = bytes(c | 32 if chr(c).isupper() else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
BLOCK = 1 << 20
#: Postings that a window holds at most, beside its documents.
MOST_POSTINGS = 1 << 22


def term_blocks(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in lists of about a block's bytes."""
    clean, start = text.translate(CLEAN), 0
    while start < len(clean):
        end = clean.find(b" ", start + BLOCK)
        end = len(clean) if end < 0 else end
        yield clean[start:end].split()
        start = end


def query_terms(queries: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, terms): distinct terms of each query."""
    kind = queries.schema[item_col].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted({t for block in term_blocks(x.as_py() or b"") for t in block}) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary()))], names=["item", "terms"])

    rows = queries.select(queries[item_col].alias("item"), queries[text_col].cast("binary").alias("text"))
    return rows.mapInArrow(walk, f"item {kind}, terms array<binary>")


def postings(documents: DataFrame, numbers: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, n, terms, tfs): each document's number of terms, and counts of those that have numbers."""
    kind = documents.schema[id_col].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.__contains__
        for batch in batches:
            sizes, terms, tfs = [], [], []
            for text in batch.column(1):
                n, counts = 0, Counter()
                for block in term_blocks(text.as_py() or b""):
                    n += len(block)
                    counts.update(filter(known, block))
                sizes.append(n)
                terms.append([numbers[t] for t in counts])
                tfs.append(list(counts.values()))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tfs"])

    rows = documents.select(documents[id_col].alias("doc_id"), documents[text_col].cast("binary").alias("text"))
    found = rows.mapInArrow(lean(walk), f"doc_id {kind}, n long, terms array<int>, tfs array<long>")
    return found.withColumn("row", F.monotonically_increasing_id())


@dataclass
class Scorer:
    """Scores windows against all queries, with a heap of k for each."""

    queries: list[np.ndarray]  # numbers of each query's terms
    weights: np.ndarray
    k: int
    window: int
    heaps: list[list[tuple[int, int, object]]] = field(init=False)
    met: int = 0  # documents so far

    def __post_init__(self) -> None:
        self.heaps = [[] for _ in self.queries]
        self.scores = np.zeros(self.window, np.int64)
        self.occupied = np.zeros(-(-self.window // 64), np.uint64)

    def add(self, ids: pa.Array, m: np.ndarray, lengths: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
        """Takes a window of documents in order of their ids."""
        order = np.argsort(terms, kind="stable")  # a term's documents stay in order
        slots = np.repeat(np.arange(len(m)), lengths)[order]
        terms, tfs = terms[order], tfs[order]
        gives = self.weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[slots]))
        words, bits = slots >> 6, np.left_shift(np.uint64(1), (slots & 63).astype(np.uint64))
        starts = np.searchsorted(terms, np.arange(len(self.weights) + 1))
        for query, heap in zip(self.queries, self.heaps):
            for a, b in zip(starts[query].tolist(), starts[query + 1].tolist()):
                if a < b:
                    self.scores[slots[a:b]] += gives[a:b]
                    np.bitwise_or.at(self.occupied, words[a:b], bits[a:b])
            self.harvest(heap, ids)
        self.met += len(m)

    def harvest(self, heap: list, ids: pa.Array) -> None:
        """Empties the window's array into the query's heap."""
        touched = np.flatnonzero(np.unpackbits(self.occupied.view(np.uint8), bitorder="little"))
        if not len(touched):
            return
        scores = self.scores[touched]
        self.scores[touched] = 0
        self.occupied[:] = 0
        beats = scores > (heap[0][0] if len(heap) == self.k else 0)
        touched, scores = touched[beats], scores[beats]
        if len(scores) > self.k:
            best = np.argsort(-scores, kind="stable")[: self.k]  # of equal ones the earlier
            touched, scores = touched[best], scores[best]
        for slot, score in zip(touched.tolist(), scores.tolist()):
            entry = (score, -(self.met + slot), ids[slot].as_py())
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry[:2] > heap[0][:2]:
                heapq.heapreplace(heap, entry)


def windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.Table]:
    """The rows of all batches in their order, ``window`` at a time, or fewer that hold MOST_POSTINGS."""
    kept: list[pa.RecordBatch] = []
    rows = held = 0
    for batch in batches:
        at = 0
        ends = np.cumsum(pa.compute.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False))
        while at < len(batch):
            before = int(ends[at - 1]) if at else 0
            fits = int(np.searchsorted(ends, before + MOST_POSTINGS - held, "right")) - at
            take = min(window - rows, len(batch) - at, max(fits, 0 if rows else 1))
            if take:
                kept.append(batch.slice(at, take))
                rows, at = rows + take, at + take
                held += int(ends[at - 1]) - before
            if rows == window or at < len(batch):
                yield pa.Table.from_batches(kept).combine_chunks()
                kept, rows, held = [], 0, 0
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def heaps(rows: DataFrame, queries: list[np.ndarray], weights: np.ndarray, k: int, window: int) -> DataFrame:
    """(query, doc_id, score): of rows (doc_id, m, terms, tfs), in order, the k best for each query in each partition."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(queries, weights, k, window)
        doc_type = None
        for part in windows(batches, window):
            ids, terms, tfs = part["doc_id"].combine_chunks(), part["terms"].combine_chunks(), part["tfs"].combine_chunks()
            lengths = pa.compute.list_value_length(terms).to_numpy(zero_copy_only=False)
            scorer.add(ids, part["m"].to_numpy(), lengths, terms.flatten().to_numpy(), tfs.flatten().to_numpy())
            doc_type = ids.type
        found = [(q, doc, score) for q, heap in enumerate(scorer.heaps) for score, _, doc in heap]
        if found:
            q, docs, scores = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(docs, doc_type), pa.array(scores, pa.int64())], names=["query", "doc_id", "score"])

    return rows.select("doc_id", "m", "terms", "tfs").mapInArrow(lean(walk), f"query int, doc_id {kind}, score long")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their rank, first within groups of tasks, then over all."""
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    found = found.withColumn("part", F.spark_partition_id() % 64)
    first = found.withColumn("rank", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(F.col("rank") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k).drop("part")


def search(
    documents: DataFrame, queries: DataFrame, k: int = 50, *, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text",
    window: int = 32_768, chunk: int = 1_000_000,
) -> DataFrame:
    """(item_id, rank, doc_id, score): of each row of queries the k documents of highest score above 0, from rank 1."""
    spark = documents.sparkSession
    asked = written(query_terms(queries, item_col, text_col), "queries")
    n_terms = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("n")).first()["n"]
    n_chunks = max(1, -(-n_terms // chunk))
    kind, doc_kind = queries.schema[item_col].dataType.simpleString(), documents.schema[id_col].dataType.simpleString()
    results = []
    for c in range(n_chunks):
        part = asked.where(F.size("terms") > 0).where(F.pmod(F.xxhash64("item", "terms"), F.lit(n_chunks)) == c).collect()
        numbers = {t: i for i, t in enumerate(sorted({bytes(t) for r in part for t in r["terms"]}))}
        held = written(postings(documents, numbers, id_col, text_col), "postings")
        n_docs, n_all = held.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = {r["term"]: r["count"] for r in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
        if not df:
            continue
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(numbers))], np.int64)
        m = F.expr(f"50 + (cast(50 as decimal(2, 0)) * cast({n_docs} as decimal(18, 0)) * cast(n as decimal(18, 0))) div {n_all}")
        rows = held.where(F.size("terms") > 0).withColumn("m", m.cast("long"))
        order = [F.col("doc_id").asc_nulls_last(), "row"]
        n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        rows = rows.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
        terms = [np.array([numbers[bytes(t)] for t in r["terms"]], np.int64) for r in part]
        items = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(part)], f"query int, item_id {kind}")
        found = best(heaps(rows, terms, weights, k, window), k).join(F.broadcast(items), "query")
        results.append(found.select("item_id", "rank", "doc_id", "score"))
        if n_chunks > 1:
            results[-1] = written(results[-1], "ranked")
            deleted(held)
    if not results:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {doc_kind}, score long")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out.withColumnsRenamed({"item_id": item_col, "doc_id": id_col})
