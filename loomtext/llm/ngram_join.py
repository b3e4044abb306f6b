"""N-gram Jaccard join with adaptive multi-match prefixes.

A text's set is that of its distinct word n-grams, as hashes of 64 bits, of which 48 and the number of the bucket are
compared (see ``_narrow``); nothing else is approximate. Two sets link when their Jaccard similarity
reaches the threshold. N-grams are ordered globally by their document frequency, then hash. Sets of n and m that link
have at least ``o`` = ceil(t (n + m) / (1 + t)) n-grams in common, so for every l they share at least l of the first
``n - o + l`` and ``m - o + l``. Each document takes the l (1 to ``levels``) for which its prefix, that for the smallest
partner, promises the least work: the members of its n-grams' lists that will be read, and the pairs that must share l
of them to be verified. A pair is held to the smaller l of its two documents and to the prefixes for its two sizes, in
small lists, long lists and neighbourhoods alike, before its whole sets are compared. N-grams that no other document has
come first in the order and are never emitted: a document in which more than ``1 - threshold`` of them are such has no
partner and drops out before any join.

The result is components, not pairs. Small lists give all their pairs. A long list gives the pairs with its first
member (of fewest own n-grams, so the most central); of the hub's neighbourhood, what remains outside its largest
component is then looked up in the whole neighbourhood by prefix n-gram and size, in blocks. Pairs inside one component
aren't verified again, so a group of n near copies costs about n comparisons and not n squared, and no link between
components is lost. A list in which no member can meet one of its own size or larger gives nothing: a passage shared by
many documents that don't link, as long as they are of like size, costs its tokens and no pairs.

Scale: equal sets collapse into a class first, so copies don't count. Frequencies take one shuffle of the hashes as
binary blocks, dealt by hash; n-grams that ``1/hot`` of all documents hold or more (``hot`` times the mean set, at
most) are looked for in tasks of 200 texts or more: what is frequent in one is counted exactly, broadcast, and passes by
the counting; one that is frequent in no such task is counted like all others. Only documents
that can have a partner go on with their sets. Hub pairs are salted; lists are streamed with ``small`` members held, and
the longest ones aren't gathered at all (see ``candidate_pairs``).

Defined cases: ids are integers. Null, empty and blank texts have an empty set and are components of their own; so is
a row with a null id (its component is null). A text of fewer than n words is one n-gram. Repeated rows and copies share a component.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import deleted, lean, only, release, written
from .components import connected_components

FLUSH = 500_000
PER_BUCKET = 1_000_000
PER_HOME = 1_500_000
SLICE = 512
MET = 100_000
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
_BYTES[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]


class _Powers:
    """Powers of the base and of its inverse modulo 2**64."""

    inverse = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
    up, down = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, 1 << 20)
            for name, base in (("up", _BASE), ("down", cls.inverse)):
                x = np.full(n, base, dtype=np.uint64)
                x[0] = 1
                setattr(cls, name, np.cumprod(x, dtype=np.uint64))
        return cls.up[:n], cls.down[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def ngram_sets(texts: list[str | None], n: int = 5) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text: words between ASCII white space, A-Z lower-cased."""
    out, held, size = [], [], 0
    for text in texts:
        held.append(b" " + (text or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size > 1 << 20:
            out += _sets(held, n)
            held, size = [], 0
    return out + _sets(held, n) if held else out


def _sets(raw: list[bytes], n: int) -> list[np.ndarray]:
    """Each of raw begins with a space. A word's hash is a polynomial of its bytes, from sums over the whole."""
    data = np.frombuffer(b"".join(raw) + b" ", dtype=np.uint8)
    ends = np.cumsum([len(x) for x in raw])
    up, down = _Powers.to(len(data) + 1)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, stop = edge[0::2], edge[1::2]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    words = _mixed((sums[stop] - sums[start]) * down[start])
    first = np.searchsorted(start, np.concatenate([[0], ends]))  # of the words of each text
    grams = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
    for k in range(n):
        grams = grams * _BASE + words[k : k + len(grams)]
    grams = _mixed(grams)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            whole = np.array([b - a], dtype=np.uint64)
            for k in range(a, b):
                whole = whole * _BASE + words[k : k + 1]
            out.append(_mixed(whole ^ _U(0x5851F42D4C957F2D)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def needed(size: int, threshold_percent: int) -> int:
    """Least overlap of a set of this size with any set that links to it."""
    return -(-threshold_percent * size // 100)


def overlap(a, b, percent: int):
    """Least overlap of sets of sizes a and b that link."""
    return -(-percent * (a + b) // (100 + percent))


def choose_level(df: np.ndarray, n: int, own: int, percent: int, levels: int) -> int:
    """The l of least estimated work: entries read from the lists of the prefix, and pairs that then share l of it.
    df: frequencies of the set's n-grams that others hold, ascending; own: how many no other holds."""
    best, best_cost = 1, None
    for level in range(1, levels + 1):
        end = n - needed(n, percent) + level - own
        if end > len(df) and level > 1:
            break
        read = float(df[: max(0, end)].sum())
        cost = read + len(df) / 8 * read / level**1.5 / max(1, end)
        if best_cost is None or cost < best_cost:
            best, best_cost = level, cost
    return best


def profiles(rows: DataFrame, n: int) -> DataFrame:
    """(id, n_shingles, cls, digest, frequent): each document's set in brief; frequent: what its task often met, once."""
    kind = rows.schema["id"].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = ngram_sets(batch.column(1).to_pylist(), n)
            digests = [blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
            heads = [d and int.from_bytes(d[:8], "little", signed=True) for d in digests]
            columns = [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(heads, pa.int64()), pa.array(digests, pa.binary()), pa.array(_frequent(sets), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_shingles", "cls", "digest", "frequent"])

    return rows.mapInArrow(lean(walk), f"id {kind}, n_shingles long, cls long, digest binary, frequent binary")


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that the sets of few documents are held at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _frequent(sets: list[np.ndarray]) -> list[bytes | None]:
    """For the first set of a batch, the hashes and counts of what 1 % of the batch's sets hold, if they are many."""
    out: list[bytes | None] = [None] * len(sets)
    if len(sets) >= 200:
        found, counts = np.unique(np.concatenate(sets), return_counts=True)
        often = counts >= max(20, len(sets) // 100)
        if often.any():
            out[0] = np.stack([found[often], counts[often].astype(np.uint64)]).tobytes()
    return out


def _hot(profile: DataFrame, n_docs: int, hot: int) -> np.ndarray:
    """The n-grams that 1/hot of all documents hold or more, as far as tasks met them often; sorted."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                h, n = np.frombuffer(blob, dtype=np.uint64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    counted = profile.where("frequent is not null").select("frequent").mapInArrow(lean(spread), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") >= max(100, n_docs // hot)).select("h").toPandas()["h"].to_numpy(dtype=np.int64)
    return np.sort(rows.view(np.uint64))


def repeated_ngrams(rows: DataFrame, profile: DataFrame, n: int, percent: int, levels: int, hot: int) -> DataFrame:
    """(cls, n_shingles, most, grams): for each class of equal sets that can have a partner, its l and its n-grams that
    other classes hold, in the global order, as binary uint64. cls: the digest's head."""
    spark = rows.sparkSession
    total, n_docs = profile.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count("*")).first()
    buckets, homes = max(1, total // PER_BUCKET + 1), max(1, total // PER_HOME + 1)
    shared = spark.sparkContext.broadcast((_hot(profile, n_docs, hot), n_docs))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_grams = shared.value[0]
        met: set[int] = set()
        held, size = [], 0
        for batch in sliced(batches):
            for x in ngram_sets(batch.column(0).to_pylist(), n):
                if len(x) and (cls := class_of(x)) not in met:  # of equal sets in a task one is dealt
                    if len(met) >= MET:  # only spares work, so it may forget
                        met.clear()
                    met.add(cls)
                    held.append((cls, x))
                    size += len(x)
            if size > FLUSH:
                yield from dealt(held, hot_grams, buckets)
                held, size = [], 0
        yield from dealt(held, hot_grams, buckets)

    def count(table: pa.Table) -> pa.Table:
        release()
        return counted(table, homes, shared.value[1])

    def gather(table: pa.Table) -> pa.Table:
        release()
        return gathered(table, percent, levels)

    blocks = rows.select("text").mapInArrow(lean(deal), "b int, h binary, cls binary, n binary, run binary, hot boolean")
    found = blocks.groupBy("b").applyInArrow(count, "home int, cls binary, n binary, run binary, h binary, df binary")
    return found.groupBy("home").applyInArrow(gather, "cls long, n_shingles long, most int, grams binary")


def class_of(x: np.ndarray) -> int:
    return int.from_bytes(blake2b(x.tobytes(), digest_size=16).digest()[:8], "little", signed=True)


def _narrow(h: np.ndarray) -> bytes:
    """The low 48 bits of each hash. Of the PER_BUCKET n-grams of a bucket two share them by chance in one bucket of 500;
    that makes an intersection larger by one n-gram."""
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _wide(raw: bytes, bucket: int) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel() | _U(bucket % 65536) << _U(48)


def _runs(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal neighbours start, and their lengths."""
    start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, dtype=int)
    return start, np.diff(np.append(start, len(own))).astype(np.uint32)


def dealt(held: list[tuple[int, np.ndarray]], hot_grams: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Blocks of hashes with runs of (class, size), by bucket of the hash; hot n-grams are marked and take any bucket,
    that of their class."""
    if not held:
        return
    sizes = np.array([len(x) for _, x in held], dtype=np.uint32)
    cls = np.array([c for c, _ in held], dtype=np.int64)
    h = np.concatenate([x for _, x in held])
    own = np.repeat(np.arange(len(held), dtype=np.int32), sizes)
    at = np.minimum(np.searchsorted(hot_grams, h), max(0, len(hot_grams) - 1))
    is_hot = hot_grams[at] == h if len(hot_grams) else np.zeros(len(h), dtype=bool)
    home = bucket_of(h, buckets)
    for hot in (False, True):
        which = np.flatnonzero(is_hot == hot)
        bucket = home[which] if not hot else (cls[own[which]] % buckets).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        which, bucket = which[order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        out: list[list] = [[] for _ in range(6)]
        for b in np.flatnonzero(np.diff(cuts)):
            part = which[cuts[b] : cuts[b + 1]]
            start, run = _runs(own[part])
            who = own[part[start]]
            # hot n-grams keep the tag of their own bucket, in whole hashes
            raw = _narrow(h[part]) if not hot else (h[part] & _U(2**48 - 1) | (home[part] % 65536).astype(np.uint64) << _U(48)).tobytes()
            for column, value in zip(out, (int(b), raw, cls[who].tobytes(), sizes[who].tobytes(), run.tobytes(), hot), strict=True):
                column.append(value)
            if len(out[0]) == 8:
                yield _blocks(out)
                out = [[] for _ in range(6)]
        if out[0]:
            yield _blocks(out)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> _U(40)) % _U(buckets)).astype(np.int32)


def _blocks(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int32(), *[pa.binary()] * 4, pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["b", "h", "cls", "n", "run", "hot"])


def _joined(table: pa.Table, name: str, dtype, rows=None) -> np.ndarray:
    column = table.column(name)
    return np.concatenate([np.zeros(0, dtype=dtype), *[np.frombuffer(column[k].as_buffer(), dtype=dtype) for k in (range(len(column)) if rows is None else rows)]])


def _owners(table: pa.Table, rows=None) -> tuple[np.ndarray, np.ndarray]:
    """Class and size of each entry."""
    run = _joined(table, "run", np.uint32, rows)
    return np.repeat(_joined(table, "cls", np.int64, rows), run), np.repeat(_joined(table, "n", np.uint32, rows), run)


def counted(table: pa.Table, homes: int, n_docs: int) -> pa.Table:
    """Entries of n-grams that two or more classes hold, by home of the class, with their frequency."""
    hot = table.column("hot").to_pylist()
    cold_rows, hot_rows = [k for k, x in enumerate(hot) if not x], [k for k, x in enumerate(hot) if x]
    bucket = table.column("b")[0].as_py()
    h = np.concatenate([np.zeros(0, dtype=np.uint64), *[_wide(table.column("h")[k].as_py(), bucket) for k in cold_rows]])
    cls, n = _owners(table, cold_rows)
    order = np.argsort(h, kind="stable")
    _, run = _runs(h[order])
    order = order[np.repeat(run > 1, run)]
    order = order[np.lexsort((cls[order], h[order]))]
    hs, cs = h[order], cls[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (hs[1:] != hs[:-1]) | (cs[1:] != cs[:-1])
    order, hs = order[fresh], hs[fresh]  # copies of a class from several tasks count once
    _, run = _runs(hs)
    df = np.repeat(run, run)
    order, df = order[df > 1], df[df > 1]
    hot_h, (hot_cls, hot_n) = _joined(table, "h", np.uint64, hot_rows), _owners(table, hot_rows)
    h, cls, n = np.concatenate([h[order], hot_h]), np.concatenate([cls[order], hot_cls]), np.concatenate([n[order], hot_n])
    df = np.concatenate([df, np.full(len(hot_h), max(2, n_docs), dtype=np.uint32)])
    home = (cls % homes).astype(np.int32)
    order = np.lexsort((cls, home))
    h, cls, n, df, home = h[order], cls[order], n[order], df[order], home[order]
    cuts = np.searchsorted(home, np.arange(homes + 1))
    out: list[list] = [[] for _ in range(6)]
    for k in np.flatnonzero(np.diff(cuts)):
        s = slice(cuts[k], cuts[k + 1])
        start, run = _runs(cls[s])
        for column, value in zip(out, (int(k), cls[s][start].tobytes(), n[s][start].tobytes(), run.tobytes(), h[s].tobytes(), df[s].tobytes()), strict=True):
            column.append(value)
    kinds = (pa.int32(), *[pa.binary()] * 5)
    return pa.table([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["home", "cls", "n", "run", "h", "df"])


def gathered(table: pa.Table, percent: int, levels: int) -> pa.Table:
    """One row for each class that can have a partner."""
    h, df = _joined(table, "h", np.uint64), _joined(table, "df", np.uint32)
    cls, n = _owners(table)
    order = np.lexsort((h, df, cls))
    cls, n, h, df = cls[order], n[order], h[order], df[order]
    start, run = _runs(cls)
    out: list[list] = [[] for _ in range(4)]
    for a, k in zip(start.tolist(), run.tolist(), strict=True):
        grams, freq = h[a : a + k], df[a : a + k]
        if k > 1:
            once = np.concatenate([[True], grams[1:] != grams[:-1]])  # hot n-grams of copies from several tasks
            grams, freq = grams[once], freq[once]
        size = int(n[a])
        if len(grams) >= needed(size, percent):
            most = choose_level(freq, size, size - len(grams), percent, levels)
            for column, value in zip(out, (int(cls[a]), size, most, grams.tobytes()), strict=True):
                column.append(value)
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.table([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["cls", "n_shingles", "most", "grams"])


def prefix_end(n, held, most, percent: int):
    """How many of the held n-grams of a set of n belong to its longest prefix, that for partners of least size."""
    return np.clip(n - needed(n, percent) + most - (n - held), 0, held)


def prefix_tokens(sets: DataFrame, percent: int) -> DataFrame:
    """(gram, id, n, own, pos, most, down): each document's prefix; pos: the place in the global order, among all of the
    set's n-grams; down: 1 if by this n-gram only partners smaller than the set can be met, else 0."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(7)]
            for key, n, most, grams in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                grams = np.frombuffer(grams, dtype=np.int64)
                own, end = n - len(grams), int(prefix_end(n, len(grams), most, percent))
                pos = own + np.arange(end)
                down = pos >= n - overlap(n, n, percent) + most
                for column, value in zip(out, (grams[:end], *(np.full(end, x) for x in (key, n, own)), pos, np.full(end, most), down), strict=True):
                    column.append(value)
            kinds = (np.int64, np.int64, np.int64, np.int64, np.int64, np.int32, np.int32)
            columns = [pa.array(np.concatenate(x).astype(t)) for x, t in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["gram", "id", "n", "own", "pos", "most", "down"])

    return sets.select("id", "n_shingles", "most", "grams").mapInArrow(lean(walk), "gram long, id long, n long, own long, pos long, most int, down int")


def candidate_pairs(tokens: DataFrame, small: int, percent: int, long_list: int) -> DataFrame:
    """(hub, id, level, star): all pairs of small lists that the shared n-gram counts for, with the number they have to
    share; of long lists those with the hub. tokens: a written table. In any pair the set that isn't larger must meet the
    other by an n-gram that isn't down, so lists of nothing else give nothing. Lists of more than ``long_list`` tokens
    and 1/10000 of all (10,000 lists at most) learn their hub by a minimum and a broadcast; no task holds such a list."""
    many = tokens.groupBy("gram").count().where(F.col("count") > max(long_list, tokens.count() // 10_000))
    many = written(many.select("gram"), "many")
    theirs = tokens.join(F.broadcast(many), "gram")
    heads = theirs.where("down = 0").groupBy("gram").agg(F.min_by("id", F.struct("own", "id")).alias("hub"))
    stars = theirs.join(F.broadcast(heads), "gram").select("hub", "id", F.lit(0).alias("level"), F.lit(True).alias("star"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, held, long, out = None, [], False, []

        def close():
            if not long and held and not held[0][4]:  # those that aren't down come first
                for i, (a, na, pa_, ma, down) in enumerate(held):
                    if down:
                        break
                    for b, nb, pb, mb, _ in held[i + 1 :]:
                        level, least = min(ma, mb), overlap(na, nb, percent)
                        if least <= min(na, nb) and pa_ < na - least + level and pb < nb - least + level:
                            out.append((min(a, b), max(a, b), level, False))

        for batch in batches:
            for g, *entry in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if g != gram:
                    close()
                    gram, held, long = g, [], False
                if long:
                    if not held[0][4]:
                        out.append((held[0][0], entry[0], 0, True))
                else:
                    held.append(entry)
                    if len(held) > small:
                        long = True
                        if not held[0][4]:
                            out += [(held[0][0], x[0], 0, True) for x in held[1:]]
                        held = held[:1]
            if len(out) > 50_000:
                yield _pairs(out)
                out = []
        close()
        yield _pairs(out)

    rest = tokens.join(F.broadcast(many), "gram", "left_anti").repartition("gram").sortWithinPartitions("gram", "down", "own", "id")
    pairs = rest.select("gram", "id", "n", "pos", "most", "down").mapInArrow(lean(walk), "hub long, id long, level int, star boolean")
    return pairs.unionByName(stars).where("hub != id")


def _pairs(out: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["hub", "id", "level", "star"])


def _links(a: np.ndarray, n_a: int, most_a: int, b: np.ndarray, n_b: int, most_b: int, percent: int) -> bool:
    """Whether two sets, in the global order, link. First the prefixes for their sizes must share enough."""
    least, level = overlap(n_a, n_b, percent), min(most_a, most_b)
    if least > min(len(a), len(b)):
        return False
    ends = (max(0, level - least + len(x)) for x in (a, b))  # n - least + level, less those that no other holds
    if len(np.intersect1d(*(x[:end] for x, end in zip((a, b), ends, strict=True)), assume_unique=True)) < level:
        return False
    return len(np.intersect1d(a, b, assume_unique=True)) >= least


def verified(pairs: DataFrame, sets: DataFrame, percent: int, salts: int = 64) -> DataFrame:
    """(hub, id, star, link): the pairs with what their sets say. A hub's set goes to the salts that ask for it."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    member = sets.select("id", F.col("n_shingles").alias("n"), "most", "grams")
    center = sets.select(F.col("id").alias("hub"), *[F.col(c).alias(f"hub_{c}") for c in ("n_shingles", "most", "grams")])
    center = salted.select("hub", "salt").distinct().join(center, "hub")
    both = salted.join(member, "id").join(center, ["hub", "salt"])
    both = both.select("hub", "id", "star", "grams", "n", "most", "hub_grams", "hub_n_shingles", "hub_most")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            link = [
                _links(np.frombuffer(x, dtype=np.uint64), n, most, np.frombuffer(y, dtype=np.uint64), hub_n, hub_most, percent)
                for x, n, most, y, hub_n, hub_most in zip(*(batch.column(k).to_pylist() for k in range(3, 9)), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(link, pa.bool_())], names=["hub", "id", "star", "link"])

    return both.mapInArrow(lean(walk), "hub long, id long, star boolean, link boolean")


def remaining_links(stars: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, chunk: int) -> DataFrame:
    """(a, b): links between components within the hubs' neighbourhoods. Of each neighbourhood, what lies outside its
    largest component is compared with all of it."""
    around = stars.unionByName(stars.select("hub", F.col("hub").alias("id"))).distinct()
    around = around.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    around = written(around, "around")
    parts = around.groupBy("hub", "component").agg(F.count("*").alias("n"))
    largest = parts.groupBy("hub").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("n"), F.count("*").alias("parts"))
    largest = written(largest.where("parts > 1"), "largest")
    inside = around.join(largest.drop("parts"), "hub").withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    inside = inside.join(sets.select("id", F.col("n_shingles").alias("n_all"), "most", "grams"), "id")
    every = inside.withColumn("c", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).select("hub", "c", "id", "component", F.col("n_all").alias("n"), "most", "grams")
    rest = inside.where("component != largest").withColumn("c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    # what is outside the largest component is dealt too, in blocks, so that a task has a chunk of each side
    rest = rest.withColumn("r", F.pmod(F.xxhash64("id", F.lit(3)), F.col("chunks")).cast("int")).select("hub", "c", "r", "id", "component", F.col("n_all").alias("n"), "most", "grams")
    rest = rest.toDF(*rest.columns)  # names of their own, since both sides come from one table
    every = every.join(rest.select("hub", "c", "r").distinct().toDF("hub", "c", "r"), ["hub", "c"]).select("hub", "c", "r", "id", "component", "n", "most", "grams")
    every = every.toDF(*every.columns)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found = between(left, right, percent)
        return pa.table([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    found = written(rest.groupBy("hub", "c", "r").cogroup(every.groupBy("hub", "c", "r")).applyInArrow(compare, "a long, b long"), "more")
    deleted(around, largest)
    return found


def between(rest: pa.Table, every: pa.Table, percent: int) -> list[tuple[int, int]]:
    """One link from each document of rest to each other component of every, where there is one. Candidates share as many
    n-grams of their prefixes, for their sizes, as the smaller l of the two says; partners are looked up by size."""
    ids, comps, n, most = (every.column(c).to_numpy() for c in ("id", "component", "n", "most"))
    if not len(ids) or not rest.num_rows:
        return []
    sets = [np.frombuffer(x, dtype=np.uint64) for x in every.column("grams").to_pylist()]
    held = np.array([len(x) for x in sets], dtype=np.int64)
    ends = prefix_end(n, held, most, percent)
    owner = np.repeat(np.arange(len(sets)), ends)
    pos = np.arange(len(owner)) - np.repeat(np.cumsum(ends) - ends, ends) + (n - held)[owner]
    grams, number = np.unique(np.concatenate([x[:end] for x, end in zip(sets, ends, strict=True)]), return_inverse=True)
    if not len(grams):
        return []
    top = int(n.max()) + 1
    key = number * top + n[owner]
    order = np.argsort(key, kind="stable")
    key, owner, pos = key[order], owner[order], pos[order]
    out = []
    for a, comp, size, level, blob in zip(*(rest.column(c).to_pylist() for c in ("id", "component", "n", "most", "grams")), strict=True):
        mine = np.frombuffer(blob, dtype=np.uint64)
        prefix = mine[: int(prefix_end(size, len(mine), level, percent))]
        place = np.minimum(np.searchsorted(grams, prefix), len(grams) - 1)
        hit = np.flatnonzero(grams[place] == prefix)
        place, at = place[hit], size - len(mine) + hit
        # by an n-gram at this place only partners between these sizes can have enough in common
        fewest = min(needed(size, percent), top)
        largest = np.clip((100 + percent) * (size - at + level - 1) // percent - size, fewest - 1, top - 1)
        lo, hi = np.searchsorted(key, place * top + fewest), np.searchsorted(key, place * top + largest, "right")
        width = np.maximum(0, hi - lo)
        found = np.repeat(lo - np.cumsum(width) + width, width) + np.arange(width.sum())
        b = owner[found]
        least, levels = overlap(size, n[b], percent), np.minimum(level, most[b])
        counts = (np.repeat(at, width) < size - least + levels) & (pos[found] < n[b] - least + levels)
        shared = np.bincount(b[counts], minlength=len(ids))
        seen = {comp}
        for k in np.flatnonzero((shared >= np.minimum(level, most)) & (comps != comp)).tolist():
            if comps[k] not in seen and len(np.intersect1d(mine, sets[k], assume_unique=True)) >= overlap(size, int(n[k]), percent):
                seen.add(comps[k])
                out.append((a, int(ids[k])))
    return out


def jaccard_components(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75, levels: int = 4, small: int = 8, hot: int = 200,
    chunk: int = 1024, long_list: int = 100,
) -> DataFrame:
    """(id, n_shingles, component_id) for each row of df."""
    rows = only(df, id_col, text_col).toDF("id", "text")
    kind = rows.schema["id"].dataType.simpleString()
    profile = written(profiles(rows, n), "profiles")
    docs = profile.select("id", "n_shingles", "cls", "digest")
    classes = written(docs.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("first"), F.first("cls").alias("cls")), "classes")
    found = repeated_ngrams(rows.where("id is not null"), profile, n, percent, levels, hot)
    # a class goes on under its smallest id; the profile has made the same digests
    named = classes.select("cls", F.col("first").cast("long").alias("id"))
    sets = written(found.join(named, "cls").select("id", "n_shingles", "most", "grams"), "sets")

    tokens = written(prefix_tokens(sets, percent), "tokens")
    found = pairs = written(candidate_pairs(tokens, small, percent, long_list), "pairs")
    deleted(tokens)
    few = pairs.where("not star").groupBy("hub", "id", "level").count().where(F.col("count") >= F.col("level"))
    pairs = few.select("hub", "id", F.lit(False).alias("star")).unionByName(pairs.where("star").select("hub", "id", "star")).groupBy("hub", "id").agg(F.max("star").alias("star"))
    checked = written(verified(pairs, sets, percent), "checked")
    deleted(found)
    links = checked.where("link").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    labels = connected_components(links)
    more = remaining_links(checked.where("star").select("hub", "id"), labels, sets, percent, chunk)
    deleted(checked)
    if not more.isEmpty():
        over = more.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
        labels = connected_components(over)
    return _labelled(docs, classes, labels, id_col, kind)


def _labelled(docs: DataFrame, classes: DataFrame, labels: DataFrame, id_col: str, kind: str) -> DataFrame:
    """Each document with its class's component. Large classes (fewer than 10000) meet their rows by broadcast."""
    docs, classes = docs.drop("cls"), classes.drop("cls")
    named = classes.join(labels, classes["first"].cast("long") == labels["node"], "left")
    named = named.select("digest", F.coalesce(F.col("component").cast(kind), F.col("first")).alias("component_id"))
    sizes = docs.where("digest is not null").groupBy("digest").count()
    least = docs.count() // 10_000
    large = named.join(sizes.where(F.col("count") > least), "digest").drop("count").withColumnRenamed("component_id", "large_id")
    out = docs.join(F.broadcast(large), "digest", "left")
    rest = out.where("large_id is null").join(named, "digest", "left")
    out = out.where("large_id is not null").withColumn("component_id", F.col("large_id")).unionByName(rest)
    component = F.when(F.col("digest").isNull() | F.col("id").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"))
