"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``tables`` hash tables projects a vector on ``functions`` Gaussian directions and cuts each projection into
cells of one width; the cells together are the bucket. A neighbour at distance r of a query is off by a Gaussian of
deviation r on each direction, so the chance that it lies in a bucket is a product of Gaussian masses. A query visits
the buckets that exist in descending order of this chance until it has gathered ``target`` of it in each table, and
buckets of ``least`` times k rows (a query far from all others has its neighbours beyond the usual distance). What
is found in the buckets is reranked by exact Euclidean distance in double precision, and merged over the tables.

Width and r come from a bounded sample (``sample`` vectors of smallest id hash), everything else from all rows, and
every row is indexed. The number of functions follows the number of rows up to five, so that buckets keep their size
until there are some 250,000 rows and grow from there on.

Scale: an entry of the index is a row with its vector, shuffled by bucket; buckets are dealt over chunks of about
``chunk`` vectors and queries over blocks of about ``block``, so that no task holds more than one of each, whatever one
bucket holds (a common vector, say). Each of them returns the ``k`` nearest of each of its queries; these partial
lists are merged by a window with a group limit. The driver holds a row for each bucket; where more than
``most_buckets`` a table are counted (vectors of very uneven norm), the tables are drawn again with a function less, so
that the same rows lie in fewer, larger buckets.

Defined cases: a row without an id takes no part. Vectors that are null, empty, zero or hold a null or a component that isn't finite take no part; vectors
of another dimension aren't neighbours. Ties go to the smaller id; a query is never its own neighbour by id. Rows that
repeat an id and vector count once. With fewer than k candidates all that were found are returned. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, only, written


@dataclass
class Hashes:
    """directions[t]: (dimension, functions), shifts[t]: (functions,); one width."""

    directions: list[np.ndarray]
    shifts: list[np.ndarray]
    width: float
    radius: float
    unit: float = 1.0  # what components are divided by, so that no projection overflows

    @classmethod
    def draw(cls, dimension: int, tables: int, functions: int, width: float, radius: float, seed: int, unit: float = 1.0) -> Hashes:
        r = np.random.default_rng([seed, dimension])
        directions = [r.normal(size=(dimension, functions)) for _ in range(tables)]
        return cls(directions, [r.uniform(0, width, functions) for _ in range(tables)], width, radius, unit)

    def positions(self, table: int, vectors: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            found = ((vectors / self.unit) @ self.directions[table] + self.shifts[table]) / self.width
        return np.clip(np.nan_to_num(found, nan=1e15), -1e15, 1e15)

    def probes(self, table: int, query: np.ndarray, cells: np.ndarray, target: float, sizes: np.ndarray, least: int) -> np.ndarray:
        """Numbers of the cells to visit, in order of their chance (those without any by nearness), until target is gathered
        and least rows are."""
        step = self.width / self.radius
        low = (cells - self.positions(table, query)) * step
        chance = np.prod(_normal(low + step) - _normal(low), axis=1)
        order = np.lexsort((np.square(np.maximum(0, np.maximum(low, -low - step))).sum(axis=1), -chance))
        enough = max(np.searchsorted(np.cumsum(chance[order]), target), np.searchsorted(np.cumsum(sizes[order]), least))
        return order[: int(enough) + 1]


_normal = np.vectorize(lambda z: 0.5 * (1 + erf(z / sqrt(2))), otypes=[float])


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def measure(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances; where squares would overflow, of components divided by the largest."""
    with np.errstate(over="ignore", invalid="ignore"):
        apart = vectors - query
        out = np.sqrt(np.square(apart).sum(axis=1))
        far = np.flatnonzero(~np.isfinite(out))
        if len(far):
            most = np.abs(apart[far]).max(axis=1, keepdims=True)
            scaled = most[:, 0] * np.sqrt(np.square(apart[far] / most).sum(axis=1))
            out[far] = np.where(np.isfinite(most[:, 0]), scaled, np.inf)
    return out


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dimension)


def nearest(
    df: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, tables: int = 2, target: float = 0.72,
    sample: int = 2000, chunk: int = 2048, block: int = 2048, bucket_rows: int = 1024, most_buckets: int = 4096, least: int = 40, seed: int = 11,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest that were found of each row for which is_query holds."""
    rows = only(df.withColumn("__q", F.coalesce(is_query, F.lit(False))), id_col, vector_col, "__q").toDF("id", "v", "q")
    rows = rows.where(usable(F.col("v")) & F.col("id").isNotNull()).withColumn("v", F.col("v").cast("array<double>")).withColumn("d", F.size("v"))
    sizes = {r["d"]: r["n"] for r in rows.groupBy("d").agg(F.count("*").alias("n")).collect()}
    found = [_nearest_of(rows.where(F.col("d") == d).select("id", "v", "q"), d, n, k, tables, target, sample, chunk, block, bucket_rows, most_buckets, least, seed) for d, n in sorted(sizes.items())]
    if not found:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def fit(rows: DataFrame, dimension: int, n: int, *, k: int, tables: int, sample: int, bucket_rows: int, most_buckets: int, seed: int, fewer: int = 0) -> Hashes:
    """Cell width and the distance of neighbours, from a bounded sample; functions, from the number of rows."""
    taken = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").select("v").limit(sample).collect()])
    unit = float(np.abs(taken).max())
    taken = taken / unit
    distances = np.array([np.sort(measure(taken, q))[min(k, len(taken) - 1)] for q in taken[:64]])
    spread = float(np.sqrt(np.square(taken - taken.mean(axis=0)).sum(axis=1).mean())) or float(np.linalg.norm(taken[0]))
    radius = float(np.median(distances)) or spread * 1e-3
    functions = 3
    while functions < 12 and 3.0**functions * bucket_rows < n and 6.0 ** (functions + 1) <= most_buckets * 8:
        functions += 1
    functions -= fewer
    return Hashes.draw(dimension, tables, functions, 1.5 * spread, radius, seed, unit)


def _nearest_of(rows, dimension, n, k, tables, target, sample, chunk, block, bucket_rows, most_buckets, least, seed, fewer=0) -> DataFrame:
    spark = rows.sparkSession
    hashes = fit(rows, dimension, n, k=k, tables=tables, sample=sample, bucket_rows=bucket_rows, most_buckets=most_buckets, seed=seed, fewer=fewer)
    shared = spark.sparkContext.broadcast(hashes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            vectors = _matrix(batch.column(1), dimension)
            for t in range(tables):
                cells = np.floor(known.positions(t, vectors)).astype(np.int64)
                table = pa.array(np.full(len(cells), t, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([table, pa.array(list(cells), pa.list_(pa.int64())), batch.column(0), batch.column(1)], names=["t", "cell", "id", "v"])

    kind = rows.schema["id"].dataType.simpleString()
    index = rows.select("id", "v").mapInArrow(lean(place), f"t int, cell array<bigint>, id {kind}, v array<double>")
    counted = index.groupBy("t", "cell").agg(F.count("*").alias("n")).orderBy("t", "cell").limit(most_buckets * tables + 1).collect()
    if len(counted) > most_buckets * tables and hashes.directions[0].shape[1] > 1:
        # more buckets than the driver is to hold: the same rows in larger ones
        return _nearest_of(rows, dimension, n, k, tables, target, sample, chunk, block, bucket_rows, most_buckets, least, seed, fewer + 1)
    if len(counted) > most_buckets * tables:  # one function, and still too many: cells twice as wide until they fit
        return _nearest_of(rows, dimension, n, k, tables, target, sample, chunk, block, bucket_rows, 2 * most_buckets, least, seed, fewer)
    numbered = [(i, r["t"], tuple(r["cell"]), -(-r["n"] // chunk), r["n"]) for i, r in enumerate(counted)]
    numbers = {(t, cell): (i, chunks) for i, t, cell, chunks, _ in numbered}
    by_table = [[(i, cell, chunks, rows_) for i, u, cell, chunks, rows_ in numbered if u == t] for t in range(tables)]
    n_queries = rows.where("q").count()
    blocks = max(1, -(-n_queries // block))
    seen = spark.sparkContext.broadcast((numbers, by_table))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = seen.value[0]
        for batch in batches:
            at = [known[t, tuple(cell)] for t, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            columns = [pa.array([i for i, _ in at], pa.int32()), pa.array([c for _, c in at], pa.int32()), batch.column(2), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["b", "chunks", "id", "v"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, by_table = shared.value, seen.value[1]
        cells = [np.array([cell for _, cell, _, _ in x]) for x in by_table]
        sizes = [np.array([rows_ for _, _, _, rows_ in x]) for x in by_table]
        for batch in batches:
            vectors = _matrix(batch.column(1), dimension)
            for row, query in enumerate(vectors):
                hit = [by_table[t][c] for t in range(tables) for c in hashes.probes(t, query, cells[t], target, sizes[t], least * k + 1)]
                to = [(i, c) for i, _, chunks, _ in hit for c in range(chunks)]
                of = pa.array(np.full(len(to), row, dtype=np.int64))
                columns = [pa.array([i for i, _ in to], pa.int32()), pa.array([c for _, c in to], pa.int32()), batch.column(0).take(of), batch.column(1).take(of)]
                yield pa.RecordBatch.from_arrays(columns, names=["b", "c", "id", "v"])

    data = index.mapInArrow(lean(entries), f"b int, chunks int, id {kind}, v array<double>")
    data = data.withColumn("c", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = rows.where("q").select("id", "v").mapInArrow(lean(visits), f"b int, c int, id {kind}, v array<double>")
    asked = asked.withColumn("g", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        return best_of(left, right, dimension, k)

    schema = f"query_id {kind}, vec_id {kind}, score double"
    partial = data.select("b", "c", "g", "id", "v").groupBy("b", "c", "g").cogroup(asked.select("b", "c", "g", "id", "v").groupBy("b", "c", "g")).applyInArrow(search, schema)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = written(partial, "found").distinct().withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def best_of(data: pa.Table, asked: pa.Table, dimension: int, k: int) -> pa.Table:
    """(query_id, vec_id, score): the k nearest of data for each of asked."""
    queries, ids, scores = [], [], []
    kind = asked.schema.field("id").type
    if data.num_rows and asked.num_rows:
        own = data.column("id").combine_chunks().to_numpy(zero_copy_only=False)
        vectors = _matrix(data.column("v").combine_chunks(), dimension)
        if len(np.unique(own)) < len(own):  # repeated rows count once
            _, number = np.unique(own, return_inverse=True)
            _, first = np.unique(np.column_stack([number, np.ascontiguousarray(vectors).view(np.int64)]), axis=0, return_index=True)
            own, vectors = own[first], vectors[first]
        for query_id, query in zip(asked.column("id").to_pylist(), _matrix(asked.column("v").combine_chunks(), dimension), strict=True):
            other = np.flatnonzero(own != query_id)
            score = measure(vectors[other], query)
            near = np.flatnonzero(score <= np.partition(score, k - 1)[k - 1]) if len(score) > k else np.arange(len(score))
            near = near[np.lexsort((own[other[near]], score[near]))][:k]
            score, near = score[near], other[near]
            queries += [query_id] * len(near)
            ids += own[near].tolist()
            scores += score.tolist()
    return pa.table([pa.array(queries, kind), pa.array(ids, kind), pa.array(scores, pa.float64())], names=["query_id", "vec_id", "score"])
