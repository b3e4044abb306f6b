"""LM scoring by masked pseudo-likelihood: a bidirectional window network predicts every token from both its sides.

Tokens are lower-cased words. The network's output layer is factored: classes first, then the word within its class.
The most frequent words are classes of their own, all others fall into classes by their ending. An embedding for each
side, a tanh layer and a softmax over classes are trained in numpy, by full batches with Adam, on the counts of (left,
token, right) over the whole corpus: the loss depends on the corpus through these counts alone, so every token of every
document trains it. Within a class a word's weight is its share, times, for each word that occurs ``least`` times or
more, how much likelier it makes its left and its right neighbour than its class does; the weights are normalised
over the class for each pair of neighbours, so that the probabilities of all words sum to one in every window. A
document's score is the sum of the log probabilities of its tokens, each predicted from both sides.

What the model gathers follows the corpus: words with neighbours of their own up to ``vocabulary`` of them, and shares
of all other words in a table of buckets that doubles with the number of distinct words up to ``buckets``; beyond, words
of a bucket share evenly. Both bounds are what is sent to every task (about 9 + 10 + 16 MB with the defaults).

Scale: word counts are aggregated map-side and shuffled by word, growing with the input. Every other statistic is an
array in each task, of which the parts that aren't empty are added up in two rounds. The network is applied to each of
the (classes + 1) squared contexts once, and its table of log probabilities is broadcast; scoring is one scan.

Defined cases: null, empty and blank texts have no tokens and score 0. Repeated rows are each scored; extra columns are
ignored. An empty table gives an empty result; rows with a null id are scored like others. A word that the corpus
doesn't hold has the share of an empty bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import deleted, lean, only, written


#: What every bucket has beyond its count, for words the corpus doesn't hold.
SPARE = 0.1
#: Buckets, and words, whose statistics travel together.
SLICE, WORDS = 1 << 14, 64


@dataclass
class Classes:
    """words: class, log share and number of each word of the vocabulary; rest: log share of any other word, by bucket.
    Words without neighbours of their own have the number ``numbered``."""

    words: dict[str, tuple[int, float, int]]
    rest: np.ndarray  # (classes of endings, buckets of each)
    own: int
    numbered: int

    @property
    def edge(self) -> int:
        return self.own + len(self.rest)

    def of(self, word: str) -> tuple[int, float, int]:
        found = self.words.get(word)
        if found is None:
            k, j = place(word, *self.rest.shape)
            found = (self.own + k, float(self.rest[k, j]), self.numbered)
        return found

    def coded(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, log share and number of each token."""
        found = [self.of(word) for word in (text or "").lower().split()]
        return np.array([x[0] for x in found], dtype=np.int64), np.array([x[1] for x in found]), np.array([x[2] for x in found], dtype=np.int64)


def place(word: str, rest: int, buckets: int) -> tuple[int, int]:
    return ending(word, rest), zlib.crc32(word.encode("utf-8", "surrogatepass")) % buckets


def ending(word: str, n: int) -> int:
    return zlib.crc32(word[-2:].encode("utf-8", "surrogatepass")) % n


def count_words(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts. White space is Python's, so words are cut in both places alike."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update((text.as_py() or "").lower().split())
                if len(counts) > 300_000:
                    yield from _counted(counts)
                    counts = Counter()
        yield from _counted(counts)

    return df.select(text_col).mapInArrow(lean(walk), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(counts) -> Iterator[pa.RecordBatch]:
    words, n = list(counts), list(counts.values())
    for at in range(0, len(words), 20_000):
        columns = [pa.array(words[at : at + 20_000], pa.string()), pa.array(n[at : at + 20_000], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "n"])


def learn_classes(counts: DataFrame, *, vocabulary: int = 20_000, least: int = 20, own: int = 96, rest: int = 32, buckets: int = 1 << 22) -> Classes:
    """counts: (word, n), a written table."""
    types = counts.count()
    top = [(r["word"], r["n"]) for r in counts.orderBy(F.desc("n"), "word").limit(vocabulary).collect()]
    known = {word for k, (word, n) in enumerate(top) if k < own or n >= least}
    per = 16
    while per * rest < min(types, buckets):
        per *= 2
    shared = counts.sparkSession.sparkContext.broadcast(known)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, kinds = np.zeros(rest * per, dtype=np.int64), np.zeros(rest * per, dtype=np.int64)
        for batch in batches:
            for word, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if word not in shared.value:
                    i, j = place(word, rest, per)
                    n[i * per + j] += k
                    kinds[i * per + j] += 1
        yield packed((at // SLICE, np.concatenate([n[at : at + SLICE], kinds[at : at + SLICE]])) for at in range(0, rest * per, SLICE))

    n, kinds = np.zeros(rest * per), np.zeros(rest * per)
    for key, cells in added(counts.select("word", "n").mapInArrow(lean(walk), PARTS)).items():
        at, half = key * SLICE, len(cells) // 2
        n[at : at + half], kinds[at : at + half] = cells[:half], cells[half:]
    n, kinds = n.reshape(rest, per), kinds.reshape(rest, per)
    total = n.sum(axis=1) + SPARE * per
    words = {word: (k, 0.0, -1) for k, (word, _) in enumerate(top[:own])}
    numbered = [(word, ending(word, rest), m) for word, m in top[own:] if word in known]
    np.add.at(total, [k for _, k, _ in numbered], [m for _, _, m in numbered])
    words |= {word: (own + k, float(np.log(m / total[k])), i) for i, (word, k, m) in enumerate(numbered)}
    words |= {word: (k, share, len(numbered)) for word, (k, share, i) in words.items() if i < 0}
    shares = np.log((n + SPARE) / (kinds + 1) / total[:, None]).astype(np.float32)
    return Classes(words, shares, own, len(numbered))


PARTS = "key int, part int, blob binary"


def packed(arrays: Iterable[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    """The arrays that aren't empty, as rows of PARTS."""
    part = TaskContext.get().partitionId() % 64
    rows = [(key, part, zlib.compress(cells.astype("<i8").tobytes(), 1)) for key, cells in arrays if cells.any()]
    columns = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, names=["key", "part", "blob"])


def unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), dtype="<i8")


def added(rows: DataFrame) -> dict[int, np.ndarray]:
    """rows: PARTS. The sum of the arrays of each key, in two rounds, so that no task adds up those of all tasks."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, blob in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                cells = unpacked(blob.as_py())
                total[key] = total[key] + cells if key in total else cells
        if total:
            yield packed(total.items())

    for keys in (["key", "part"], ["key"]):
        rows = rows.repartition(16, *keys).mapInArrow(lean(add), PARTS)
    out: dict[int, np.ndarray] = {}
    for r in rows.toLocalIterator():
        out[r["key"]] = unpacked(bytes(r["blob"]))
    return out


def window_counts(df: DataFrame, classes: Classes, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """counts[left, token, right] of classes over all texts, and neighbours[side, word, class] of the numbered words. The
    edge of a text is a class."""
    shared = df.sparkSession.sparkContext.broadcast(classes)
    size, n_words = classes.edge + 1, classes.numbered

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        cells, sides = np.zeros(size**3, dtype=np.int64), [np.zeros((n_words + 1) * size, dtype=np.int32) for _ in range(2)]
        held, n = [], 0

        def flush() -> None:
            if held:
                ids, words, left, right = (np.concatenate(x) for x in zip(*held, strict=True))
                np.add(cells, np.bincount((left * size + ids) * size + right, minlength=size**3), out=cells)
                for side, near in zip(sides, (left, right), strict=True):
                    side += np.bincount(words * size + near, minlength=len(side)).astype(np.int32)
                held.clear()

        for batch in batches:
            for text in batch.column(0):
                ids, _, words = known.coded(text.as_py())
                if len(ids):
                    held.append((ids, words, *neighbours(ids, size)))
                    n += len(ids)
                if n > 500_000:
                    flush()
                    n = 0
        flush()
        yield packed(enumerate(cells.reshape(size, -1)))
        both = np.stack([side.reshape(-1, size)[:n_words] for side in sides])
        yield packed((size + at // WORDS, both[:, at : at + WORDS].reshape(-1)) for at in range(0, n_words, WORDS))

    counts, near = np.zeros((size, size**2), dtype=np.int64), np.zeros((2, n_words, size), dtype=np.int64)
    for key, cells in added(df.select(text_col).mapInArrow(lean(walk), PARTS)).items():
        if key < size:
            counts[key] = cells
        else:
            at = (key - size) * WORDS
            near[:, at : at + WORDS] = cells.reshape(2, -1, size)
    return counts.reshape(size, size, size), near


def neighbours(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([[size - 1], ids[:-1]]), np.concatenate([ids[1:], [size - 1]])


def word_factors(classes: Classes, counts: np.ndarray, near: np.ndarray, prior: float = 20.0) -> tuple[np.ndarray, np.ndarray]:
    """factors[side, number, class]: log of how much likelier a word makes a neighbour than its class does (0 for words
    without a number), and log_norm[left, token, right]: the sum of a class's weights, by which they are divided."""
    size = classes.edge + 1
    factors, norm = np.zeros((2, classes.numbered + 1, size), dtype=np.float16), np.zeros((size, size, size), dtype=np.float32)
    of, share = np.zeros(classes.numbered, dtype=np.int64), np.zeros(classes.numbered)
    for k, log_share, i in classes.words.values():
        if i < classes.numbered:
            of[i], share[i] = k, np.exp(log_share)
    for k in range(classes.own, classes.edge):
        mine = np.flatnonzero(of == k)
        if not len(mine):
            continue
        for side, by_class in enumerate((counts[:, k, :].sum(axis=1), counts[:, k, :].sum(axis=0))):
            expected = (by_class + 0.5) / (by_class.sum() + 0.5 * size)
            n = near[side, mine]
            factors[side, mine] = np.log((n / expected + prior) / (n.sum(axis=1, keepdims=True) + prior))
        left, right = (np.exp(factors[side, mine].astype(np.float64)) for side in range(2))
        norm[:, k, :] = np.log((left * share[mine, None]).T @ right + max(0.0, 1 - share[mine].sum()))
    return factors, norm


class WindowNetwork:
    """log P(token class | left class, right class), from embeddings of both sides."""

    def __init__(self, size: int, width: int = 16, hidden: int = 32, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "left": r.normal(0, 0.1, (size, width)), "right": r.normal(0, 0.1, (size, width)),
            "w": r.normal(0, 0.2, (2 * width, hidden)), "b": np.zeros(hidden),
            "out": r.normal(0, 0.1, (hidden, size)), "bias": np.zeros(size),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def forward(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = self.p
        x = np.hstack([p["left"][left], p["right"][right]])
        h = np.tanh(x @ p["w"] + p["b"])
        z = h @ p["out"] + p["bias"]
        z -= z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        return x, h, z

    def train(self, counts: np.ndarray, steps: int = 150, rate: float = 0.02) -> list[float]:
        """Full batches over all contexts that occur; returns the mean loss of each step."""
        by_context = counts.transpose(0, 2, 1).reshape(-1, counts.shape[1])
        seen = np.flatnonzero(by_context.any(axis=1))
        if not len(seen):
            return []
        left, right = seen // counts.shape[2], seen % counts.shape[2]
        n = by_context[seen].astype(np.float32) / by_context.sum()
        mass = n.sum(axis=1, keepdims=True)
        self.p["bias"] = np.log(n.sum(axis=0) + 1e-7).astype(np.float32)
        first, second, losses = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, []
        for step in range(1, steps + 1):
            x, h, z = self.forward(left, right)
            losses.append(float(-(n * z).sum()))
            dz = np.exp(z) * mass - n
            dh = (dz @ self.p["out"].T) * (1 - h * h)
            dx = dh @ self.p["w"].T
            width = dx.shape[1] // 2
            g = {"out": h.T @ dz, "bias": dz.sum(axis=0), "w": x.T @ dh, "b": dh.sum(axis=0), "left": np.zeros_like(self.p["left"]), "right": np.zeros_like(self.p["right"])}
            np.add.at(g["left"], left, dx[:, :width])
            np.add.at(g["right"], right, dx[:, width:])
            for k in self.p:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                self.p[k] = (self.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return losses

    def table(self, size: int) -> np.ndarray:
        """log probabilities by (left, token, right)."""
        left, right = np.divmod(np.arange(size * size), size)
        z = self.forward(left, right)[2].reshape(size, size, size)
        return np.ascontiguousarray(z.transpose(0, 2, 1), dtype=np.float32)


@dataclass
class LmModel:
    """table: log probabilities of classes, less the norms of the words within; factors: see word_factors()."""

    classes: Classes
    table: np.ndarray
    factors: np.ndarray

    def log_probabilities(self, text: str | None) -> np.ndarray:
        """One for each token."""
        ids, share, words = self.classes.coded(text)
        left, right = neighbours(ids, self.classes.edge + 1) if len(ids) else (ids, ids)
        near = self.factors[0, words, left].astype(np.float64) + self.factors[1, words, right]
        return self.table[left, ids, right] + share + near

    def score(self, text: str | None) -> tuple[int, float]:
        found = self.log_probabilities(text)
        return len(found), float(found.sum())


def fit(df: DataFrame, *, text_col: str = "text", steps: int = 150, **parameters) -> LmModel:
    words = written(count_words(df, text_col), "words")
    classes = learn_classes(words, **parameters)
    deleted(words)
    counts, near = window_counts(df, classes, text_col)
    network = WindowNetwork(classes.edge + 1)
    network.train(counts, steps)
    factors, norm = word_factors(classes, counts, near)
    return LmModel(classes, network.table(classes.edge + 1) - norm, factors)


def score(df: DataFrame, model: LmModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, log_likelihood, per_token) for each row; per_token is null without tokens."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = only(df, id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [known.score(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _ in found], pa.int64()),
                    pa.array([s for _, s in found], pa.float64()),
                    pa.array([s / n if n else None for n, s in found], pa.float64()),
                ],
                names=[id_col, "n_tokens", "log_likelihood", "per_token"],
            )

    return rows.mapInArrow(lean(walk), f"`{id_col}` {kind}, n_tokens long, log_likelihood double, per_token double")
