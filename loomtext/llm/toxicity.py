"""Toxicity: Levenshtein automata over a lexicon trie, with window features that tell quotation from abuse.

The lexicon is learned from labelled rows: terms, and stems (the first 4 to 8 letters of words, whatever follows),
whose documents are labelled toxic far more often than others. Each distinct word of a text becomes a bit-parallel
Levenshtein automaton that walks those paths of the lexicon's trie whose terms a screen by letters and pairs of letters
leaves, so misspelled terms are found (one error from 5 letters on, two from 9 on). Each hit is looked at in its
context: whether quotation marks of its line enclose it, at whatever distance, and whether a window of words around it holds a further hit. Hits inside and outside quotations, exact and misspelled,
are separate features. A logistic regression, fitted in numpy by Newton steps, turns them into a score.

Scale: fitting reads at most ``max_labelled`` labelled rows (those of smallest hash of their id; documented bound), so
that they can be broadcast to the scan of the documents. Scoring is one scan without a shuffle; it broadcasts the
lexicon, which those rows bound, and eight weights. Words repeat, so each process keeps the last automaton results in a
bounded cache. Labels, ids, languages and sources aren't inputs of a score.

Defined cases: null and empty texts have no hits and get the score of no hits. Documents without a label are scored
like any other, as are those without an id, which are never held out. Several labels of one document count as toxic if any is; null labels are ignored. Without usable
labels every score is below 1e-12. Repeated rows are each returned; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, only, written

WORD = re.compile(r"[^\W\d_]+")
CLOSERS = {'"': '"', "“": "”", "„": "“”", "«": "»", "‘": "’"}
STEMS = (4, 5, 6, 7, 8)
FEATURES = 7
_MARKS = re.compile('["“”„«»‘’\n]')


def quotations(text: str) -> list[tuple[int, int]]:
    """Spans of quotations, in order: from a mark that opens to the next one in its line that closes it. One pass over the
    marks to the right, for what closes each, and one to the left."""
    out, line = [], []
    for m in _MARKS.finditer(text + "\n"):
        if m[0] != "\n":
            line.append((m.start(), m[0]))
            continue
        last, ends = {}, [-1] * len(line)
        for i in range(len(line) - 1, -1, -1):
            ends[i] = min((last[c] for c in CLOSERS.get(line[i][1], "") if c in last), default=-1)
            last[line[i][1]] = i
        i = 0
        while i < len(line):
            if ends[i] >= 0:
                out.append((line[i][0], line[ends[i]][0] + 1))
                i = ends[i]
            i += 1
        line = []
    return out


def deletions(word: str, most: int) -> set[str]:
    """What is left of the word without up to most of its letters."""
    out = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


class LexiconTrie:
    """terms: whole words, or stems written with a closing asterisk. The trie is kept as its terms in order: what
    neighbours have in common at their beginning is the path to an inner node."""

    def __init__(self, terms: list[str]):
        self.terms, self.indexes = terms, {}
        self.bares = [term.removesuffix("*") for term in terms]
        self.order = {k: i for i, k in enumerate(sorted(range(len(terms)), key=self.bares.__getitem__))}

    @staticmethod
    def errors(length: int) -> int:
        return 0 if length < 5 else 1 if length < 9 else 2

    def _index(self, most: int) -> list[tuple]:
        """For words that may have most errors: (errors, shortest, longest, whether stems, the terms of each deletion), of
        the terms that may have as many."""
        if most not in self.indexes:
            groups: dict[tuple[int, bool], list[int]] = {}
            for k, bare in enumerate(self.bares):
                groups.setdefault((min(most, self.errors(len(bare))), self.terms[k].endswith("*")), []).append(k)
            self.indexes[most] = []
            for (e, stem), numbers in sorted(groups.items()):
                sizes, known = [len(self.bares[k]) for k in numbers], {}
                for k in numbers:
                    for left in deletions(self.bares[k], e):
                        known.setdefault(left, []).append(k)
                self.indexes[most].append((e, max(0, min(sizes) - e), max(sizes) + e, stem, known))
        return self.indexes[most]

    def possible(self, word: str) -> set[int]:
        """All terms that the word is near, and few others: strings within e errors share what some e deletions at most
        make of each."""
        n, found = len(word), set()
        for e, shortest, longest, stem, known in self._index(self.errors(n)):
            ends = range(shortest, min(n, longest) + 1) if stem else (n,) if shortest <= n <= longest else ()
            for end in ends:
                for left in deletions(word[:end], e):
                    if left in known:
                        found.update(known[left])
        return found

    def match(self, word: str, possible: list[int] | None = None) -> tuple[int, int] | None:
        """(number of the term, errors): the nearest term, of equal ones the first; None if there is none. possible: the
        terms that a screen has left, of whose trie the word's automaton walks the paths."""
        n = len(word)
        possible = self.possible(word) if possible is None else possible
        if not possible:
            return None
        most = self.errors(n)
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        whole, best, path = 1 << n, None, ""
        every = (whole << 1) - 1
        # state e: bit i is set if i letters of the word fit the path with e errors
        trail = [(1, 3 if most else 0, 7 if most > 1 else 0)]
        for k in sorted(possible, key=self.order.__getitem__):
            bare, depth = self.bares[k], 0
            while depth < len(path) and depth < len(bare) and path[depth] == bare[depth]:
                depth += 1
            del trail[depth + 1 :]
            zero, one, two = trail[-1]
            for c in bare[depth:]:
                mask = masks.get(c, 0)
                next_one = next_two = 0
                next_zero = (zero & mask) << 1
                if most:
                    next_one = ((one & mask) << 1 | zero | zero << 1 | next_zero << 1) & every
                    if most > 1:
                        next_two = ((two & mask) << 1 | one | one << 1 | next_one << 1) & every
                zero, one, two = next_zero, next_one, next_two
                if not (zero or one or two):
                    break
                trail.append((zero, one, two))
            path = bare[: len(trail) - 1]
            if len(path) == len(bare):
                stem, states = self.terms[k].endswith("*"), trail[-1]
                for e in range(min(most, self.errors(len(bare))) + 1):
                    if states[e] if stem else states[e] & whole:
                        if best is None or (e, k) < best:
                            best = (e, k)
                        break
        return best and (best[1], best[0])


class Screen:
    """What letters and pairs of letters rule out, for many words at once and without a miss: a word within e errors of a
    term lacks e of the term's letters at most, has e others at most, and lacks 2 e of its neighbouring pairs at most; of
    a stem's word this holds for its beginning."""

    def __init__(self, trie: LexiconTrie):
        self.errors = np.vectorize(trie.errors, otypes=[np.int64])
        self.width = max(map(len, trie.bares), default=0) + 2
        groups: dict[tuple[int, bool], list[int]] = {}
        for k, (term, bare) in enumerate(zip(trie.terms, trie.bares, strict=True)):
            groups.setdefault((len(bare), term.endswith("*")), []).append(k)
        self.groups = []
        for (size, stem), numbers in sorted(groups.items()):
            if size:
                letters, pairs = self._bits([trie.bares[k] for k in numbers])
                self.groups.append((size, stem, trie.errors(size), np.array(numbers), letters[:, size - 1], pairs[:, size - 1]))

    def _bits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Column k: the letters, and the pairs of neighbours, among each word's first k + 1 letters, as bits."""
        codes = np.array(words, dtype=f"U{self.width}").view(np.uint32).reshape(len(words), self.width).astype(np.uint64)
        one, last, none = np.uint64(1), np.uint64(63), np.uint64(0)
        letters = np.where(codes > 0, one << (codes & last), none)
        pairs = np.zeros_like(letters)
        pairs[:, 1:] = np.where(codes[:, 1:] > 0, one << ((codes[:, :-1] * np.uint64(31) + codes[:, 1:] * np.uint64(17)) & last), none)
        return np.bitwise_or.accumulate(letters, axis=1), np.bitwise_or.accumulate(pairs, axis=1)

    def near(self, words: list[str]) -> dict[str, list[int]]:
        """The words that the screen doesn't rule out, with the terms that it leaves for each."""
        out: dict[str, list[int]] = {}
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            (letters, pairs), sizes = self._bits(part), np.array([len(w) for w in part])
            allowed = self.errors(sizes)
            for size, stem, most, numbers, terms, term_pairs in self.groups:
                e = np.minimum(allowed, most)
                fits = np.flatnonzero((sizes >= size - e) & (stem | (sizes <= size + e)))
                if not len(fits):
                    continue
                e, end = e[fits, None], min(size + most, self.width) - 1
                few = np.bitwise_count(term_pairs & ~pairs[fits, end, None]) <= 2 * e
                few &= np.bitwise_count(terms & ~letters[fits, end, None]) <= e
                if size > most:
                    few &= np.bitwise_count(letters[fits, size - most - 1 if stem else end, None] & ~terms) <= e
                if not stem:
                    few &= np.bitwise_count(pairs[fits, end, None] & ~term_pairs) <= 2 * e
                row, column = np.nonzero(few)
                for k, number in zip(fits[row].tolist(), numbers[column].tolist(), strict=True):
                    out.setdefault(part[k], []).append(number)
        return out


class Matcher:
    """Hits of words, remembered: those near a term, and up to ``most`` words that are near none."""

    def __init__(self, terms: list[str], most: int = 400_000):
        self.trie, self.most, self.near, self.clean = LexiconTrie(terms), most, {}, set()
        self.screen = Screen(self.trie)

    def learn(self, words: set[str]) -> None:
        """All of the words are known afterwards."""
        if len(self.clean) > self.most:
            self.clean = set()
        if len(self.near) > self.most:
            self.near = {}
        unseen = words.difference(self.clean).difference(self.near)
        if unseen:
            for word, left in self.screen.near(list(unseen)).items():
                if hit := self.trie.match(word, left):
                    self.near[word] = hit
            self.clean |= unseen.difference(self.near)


def featured(texts: list[str | None], matches: Matcher, weights, window: int) -> list[list[float]]:
    """The features of each text; words of many texts are looked up at once."""
    out: list[list[float]] = []
    for at in range(0, len(texts), 256):
        part = texts[at : at + 256]
        matches.learn(set().union(*[WORD.findall((text or "").lower()) for text in part]))
        out += [features(text, matches, weights, window) for text in part]
    return out


def features(text: str | None, matches: Matcher, weights, window: int) -> list[float]:
    """Exact hits outside and inside quotations, misspelled ones likewise, the strongest term, hits that have company,
    and all terms together."""
    out = [0.0] * FEATURES
    if not text:
        return out
    low = text.lower()
    words = set(WORD.findall(low))
    matches.learn(words)
    if not any(word in matches.near for word in words):
        return out
    near = matches.near
    quoted = quotations(low)
    starts = [a for a, _ in quoted]
    hits = []
    for k, m in enumerate(WORD.finditer(low)):
        if found := near.get(m[0]):
            at = bisect_right(starts, m.start()) - 1
            inside = at >= 0 and m.end() < quoted[at][1]
            hits.append((k, found[0], found[1], inside))
    for n, (k, term, wrong, inside) in enumerate(hits):
        out[2 * bool(wrong) + inside] += 1
        if not inside and not wrong:
            out[4] = max(out[4], weights[term])
        company = [h for h in hits[max(0, n - 1) : n + 2] if h[0] != k and abs(h[0] - k) <= window]
        out[5] += bool(company) and not inside
    out[6] = sum(weights[term] for term in {term for _, term, wrong, inside in hits if not inside and not wrong})
    return [float(np.log1p(x)) if i < 4 or i == 5 else x for i, x in enumerate(out)]


@dataclass
class ToxicityModel:
    terms: list[str]
    odds: list[float]
    weights: np.ndarray
    window: int = 8

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(rows @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _terms(text: Column) -> Column:
    """Each distinct word of the text and its stems."""
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))

    def stems(n: int) -> Column:
        return F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))

    return F.array_distinct(F.concat(F.filter(words, lambda w: w != ""), *[stems(n) for n in STEMS]))


def learn_lexicon(labelled: DataFrame, *, min_share: float = 0.3, evidence: float = 14.0) -> list[tuple[str, float]]:
    """(term, log odds ratio): terms of which min_share of the documents are toxic, where this has a log-likelihood ratio of
    evidence against the share of all documents (14: one chance in a million). labelled: (text, toxic), bounded.
    The best supported terms come first; what a stem among them covers is left out. Their number is bounded by that of the
    labelled rows: each needs three toxic documents or more."""
    toxic, total = labelled.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    if not 0 < toxic < total:
        return []
    base = toxic / total
    counted = labelled.select("toxic", F.explode(_terms(F.col("text"))).alias("term"))
    counted = counted.groupBy("term").agg(F.sum("toxic").alias("n"), F.count("*").alias("all")).where(F.col("n") >= min_share * F.col("all"))
    share = F.col("n") / F.col("all")
    ratio = F.col("n") * F.log(share / base) + F.when(F.col("n") < F.col("all"), (F.col("all") - F.col("n")) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    rows = counted.withColumn("ratio", ratio).where(F.col("ratio") >= evidence).orderBy(F.desc("ratio"), F.endswith("term", F.lit("*")), F.desc(F.length("term")), "term").toLocalIterator()
    kept: dict[str, float] = {}
    for r in rows:
        bare = r["term"].removesuffix("*")
        covered = any(bare[:n] + "*" in kept for n in range(1, len(bare) + 1))
        # a stem that adds nothing to a word it comes from stays out
        if not covered and not (r["term"].endswith("*") and any(w.startswith(bare) and not w.endswith("*") for w in kept)):
            kept[r["term"]] = float(np.log((r["n"] + 0.5) / (r["all"] - r["n"] + 0.5)) - np.log(base / (1 - base)))
    return list(kept.items())


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty
        step = np.linalg.solve(h, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; one without an id isn't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 20_000, window: int = 8) -> ToxicityModel:
    """Learns from labelled rows that aren't held out, max_labelled of them at most."""
    chosen = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    chosen = chosen.groupBy(id_col).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64(id_col), id_col).limit(max_labelled)
    labelled = only(documents, id_col, text_col).join(F.broadcast(chosen), id_col)
    labelled = written(labelled.select("toxic", F.coalesce(F.col(text_col), F.lit("")).alias("text")), "labelled")
    lexicon = learn_lexicon(labelled)
    terms, odds = [t for t, _ in lexicon], [o for _, o in lexicon]
    rows = _featured(labelled.select("toxic", "text"), terms, odds, window).groupBy("toxic", "f").count().collect()
    if not rows or len({r["toxic"] for r in rows}) < 2:
        return ToxicityModel(terms, odds, np.array([0.0] * FEATURES + [-30.0]), window)
    x = np.repeat(np.array([r["f"] for r in rows]), 1, axis=0)
    n, y = np.array([r["count"] for r in rows], dtype=float), np.array([float(r["toxic"]) for r in rows])
    return ToxicityModel(terms, odds, _fit_counted(x, y, n), window)


def _fit_counted(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """fit_weights() over rows that stand for n rows each."""
    return fit_weights(np.repeat(x, n.astype(int), axis=0), np.repeat(y, n.astype(int)))


def _featured(rows: DataFrame, terms: list[str], odds: list[float], window: int) -> DataFrame:
    """(first column, f): the features of (any column, text)."""
    shared = rows.sparkSession.sparkContext.broadcast((terms, odds))
    first = rows.columns[0]
    kind = rows.schema[0].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, odds = shared.value
        matches = Matcher(terms)
        for batch in batches:
            f = featured(batch.column(1).to_pylist(), matches, odds, window)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f, pa.list_(pa.float64()))], names=[first, "f"])

    return rows.mapInArrow(lean(walk), f"`{first}` {kind}, f array<double>")


def score(documents: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row."""
    rows = _featured(only(documents, id_col, text_col), model.terms, model.odds, model.window)
    terms = [F.lit(float(w)) * F.col("f")[i] for i, w in enumerate(model.weights[:-1])]
    z = sum(terms, F.lit(float(model.weights[-1])))
    return rows.select(id_col, (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).alias("score"))


def without_toxic(documents: DataFrame, model: ToxicityModel, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """documents, all columns, without those that score threshold or more."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text_col)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        matches = Matcher(known.terms)
        for batch in batches:
            if batch.num_rows:
                f = np.array(featured(batch.column(at).to_pylist(), matches, known.odds, known.window))
                yield batch.filter(pa.array(known.score(f) < threshold))

    return documents.mapInArrow(lean(walk), documents.schema)
