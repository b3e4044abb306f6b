"""Information-theoretic sanitisation of personal data.

Personal data (e-mail addresses, IP addresses, cards, phone numbers) is found by fixed forms. Its values are the
protected entities. How strongly a term reveals an entity is estimated from the corpus: with p(e), p(t) and p(e, t) the
shares of documents that hold the entity, the term and both, the term discloses PMI(e; t) = log2 p(e, t) / (p(e) p(t)) of
the entity's information content IC(e) = -log2 p(e). A term that discloses ``threshold`` of it or more is generalised in
every document that holds the entity, to its first half or to a number of as many digits, if that more general form
discloses less than the threshold, and is removed otherwise. Documents without personal data stay as they are.

Copies are no evidence: an entity, and a pair of an entity and a term, counts from ``min_texts`` different texts on. The
shares are of documents, copies included.

Scale: a first scan finds personal data; only texts that hold entities of several texts are scanned for terms, once for
each group of copies, and only terms met with such an entity in several texts are counted over the corpus. Both filters
are bitmaps over hashes of a fixed largest size; joins make up for their false hits. No pairs of documents or of terms are
made, all counts are added up map-side, and of the texts only those are shuffled in which a term is to go.

Defined cases. A null text is empty and has no spans. Rows are found by their text, so null and repeated ids do no harm.
Terms are runs of two or more word characters, in lower case; what lies inside personal data is no term. Kinds may
overlap each other; where spans overlap in a text to be rewritten, the first one, and of those the longest, is replaced
and the rest of the others goes with it. Texts may have any length: all searches are linear. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmap import PAGE, bitmap, bits_for, flagged
from .common import lean, written

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"\w\w+")

Span = tuple[int, int, int]  # kind, start, end
#: Words whose counts a task holds at most before it emits them.
MOST_COUNTS = 200_000


def emails(text: str) -> Iterator[Span]:
    """Each @ with the longest run of local characters before it and the domain after it."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield 0, start, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def addresses(text: str) -> Iterator[Span]:
    """Numbers with dots between them, four at a time."""
    for m in DOTTED.finditer(text):
        at, parts = m.start(), m[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                yield 1, at, end
            at = end + 1


def luhn(digits: str) -> bool:
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def plain_digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def cards(text: str) -> Iterator[Span]:
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := plain_digits(m[0])) <= 19 and luhn(digits):
            yield 2, m.start(), m.end()


def phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(plain_digits(m[0])) <= 15:
                yield 3, m.start(), m.end()


def base_spans(text: str) -> list[Span]:
    """Personal data by kind, then start; within a kind no span overlaps another."""
    return [*emails(text), *addresses(text), *cards(text), *phones(text)]


def entity(kind: int, value: str) -> str:
    """What makes two mentions the same entity."""
    return f"{KINDS[kind]}:{value.lower() if kind < 2 else plain_digits(value)}"


def general(term: str) -> str | None:
    """A wider form of a term: its first half, or any number of as many digits; None for terms of under four characters."""
    if term.isdecimal():
        return "0" * len(term)
    return f"{term[: (len(term) + 1) // 2]}*" if len(term) > 3 else None


def forms(text: str) -> set[str]:
    """The distinct terms of a text and their general forms."""
    terms = {t.lower() for t in set(WORD.findall(text))}
    return terms | {g for t in terms if (g := general(t))}


def term_spans(text: str, base: list[Span], changes: dict[str, str | None]) -> list[tuple[int, int, int, str]]:
    """Where terms of changes lie outside personal data, with what takes their place."""
    found, inside = [], sorted((a, b) for _, a, b in base)
    at, reach = 0, 0
    for m in WORD.finditer(text):
        while at < len(inside) and inside[at][0] < m.end():
            reach, at = max(reach, inside[at][1]), at + 1
        term = m[0].lower()
        if term in changes and reach <= m.start():
            found.append((4, m.start(), m.end(), changes[term] or ""))
    return found


def rewritten(text: str, spans: Iterable[tuple[int, int, int, str]]) -> str:
    out, at = [], 0
    for _, start, end, instead in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], instead]
        at = max(at, end)
    return "".join(out) + text[at:]


Rows = Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]


def over(rows: DataFrame, each: Rows, schema: str) -> DataFrame:
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from each(batch)

    return rows.mapInArrow(lean(walk), schema)


SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("instead", pa.string())]))
SPANS = "spans array<struct<kind int, start long, end long, instead string>>"


def as_spans(found: list[list[tuple[int, int, int, str]]]) -> pa.Array:
    return pa.array([[dict(zip(("kind", "start", "end", "instead"), s)) for s in spans] for spans in found], SPAN)


def with_names(base: list[Span]) -> list[tuple[int, int, int, str]]:
    return [(*s, f"[{KINDS[s[0]].upper()}]") for s in base]


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, digest)"""
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col].alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("digest"))


def found_in(texts: DataFrame) -> DataFrame:
    """(doc_id, digest, spans, entities) of each row: the personal data of its text."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        spans, entities = [], []
        for text in batch.column("text"):
            text = text.as_py()
            base = base_spans(text)
            spans.append(with_names(base))
            entities.append(sorted({entity(k, text[a:b]) for k, a, b in base}))
        columns = [batch.column("doc_id"), batch.column("digest"), as_spans(spans), pa.array(entities, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "spans", "entities"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return over(texts, each, f"doc_id {kind}, digest binary, {SPANS}, entities array<string>")


def corpus_counts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): in how many rows each of the terms, or of what hashes like one of them, occurs."""
    bits = bits_for(terms.count(), 1 << 26)
    pages = {r["page"]: bytes(r["bits"]) for r in _crc_bitmap(terms, bits).collect()}  # 8 MB at most

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits // 8, np.uint8)
        for page, data in pages.items():
            held[page * PAGE // 8 : (page + 1) * PAGE // 8] = np.frombuffer(data, np.uint8)
        held, counts, known = held.tobytes(), Counter(), {}

        def kept(term: str) -> bool:
            at = zlib.crc32(term.encode()) % bits
            return bool(held[at >> 3] >> (at & 7) & 1)

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

        for batch in batches:
            for text in batch.column(0):
                for term in forms(text.as_py()):
                    hit = known.get(term)
                    if hit is None:
                        if len(known) > MOST_COUNTS:
                            known.clear()
                        hit = known[term] = kept(term)
                    if hit:
                        counts[term] += 1
            if len(counts) > MOST_COUNTS:
                yield flushed()
                counts.clear()
        yield flushed()

    counted = texts.select("text").mapInArrow(lean(walk), "term string, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("n"))


def _crc_bitmap(terms: DataFrame, bits: int) -> DataFrame:
    at = F.crc32(F.col("term").cast("binary")) % bits
    return terms.groupBy(F.floor(at / PAGE).cast("int").alias("page")).agg(F.bitmap_construct_agg(at % PAGE).alias("bits"))


def disclosing_terms(texts: DataFrame, found: DataFrame, threshold: float, min_texts: int) -> DataFrame | None:
    """(digest, changes): for each text in which terms are to go, those terms with what takes their place."""
    mentions = found.where(F.size("entities") > 0).select("digest", F.explode("entities").alias("entity"))
    mentions = written(mentions.groupBy("entity", "digest").agg(F.count("*").alias("copies")), "mentions")
    entities = mentions.groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count("*").alias("texts")).where(F.col("texts") >= min_texts)
    mentions = written(mentions.join(entities.select("entity", "n_entity"), "entity"), "mentions")
    n_mentions, n_docs = mentions.count(), found.count()
    if not n_mentions:
        return None

    def terms_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        terms = pa.array([sorted(forms(t.as_py())) for t in batch.column("text")], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column("digest"), terms], names=["digest", "terms"])

    bits = bits_for(n_mentions)
    near = flagged(texts, "digest", bitmap(mentions, "digest", bits), bits, "near").where("near").select("digest", "text")
    near = over(near, terms_of, "digest binary, terms array<string>").dropDuplicates(["digest"])
    pairs = mentions.join(near, "digest").select("entity", "n_entity", "copies", F.explode("terms").alias("term"))
    pairs = pairs.groupBy("entity", "term").agg(F.first("n_entity").alias("n_entity"), F.sum("copies").alias("n_both"), F.count("*").alias("texts"))
    pairs = written(pairs.where(F.col("texts") >= min_texts), "pairs")
    counts = corpus_counts(texts, pairs.select("term").distinct())
    told = disclosure(F.col("n_entity"), F.col("n"), F.col("n_both"), n_docs) >= threshold
    pairs = written(pairs.join(counts, "term").select("entity", "term", told.alias("told")), "pairs")
    wider = F.when(F.col("term").rlike(r"^\d+$"), F.translate("term", "0123456789", "0000000000"))
    wider = wider.when(F.length("term") > 3, F.concat(F.expr("substring(term, 1, (length(term) + 1) div 2)"), F.lit("*")))
    close = pairs.where("told and term not like '%*'").withColumn("wider", wider)
    safe = pairs.where("not told").select("entity", F.col("term").alias("wider"), F.lit(True).alias("safe"))
    close = close.join(safe, ["entity", "wider"], "left")
    gone = close.select("entity", "term", F.when(F.col("safe"), F.col("wider")).alias("instead"))
    by_text = mentions.join(gone, "entity").groupBy("digest", "term")
    # where two entities ask for different things, the term is removed
    by_text = by_text.agg(F.when(F.count_if(F.col("instead").isNull()) == 0, F.first("instead")).alias("instead"))
    return written(by_text.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("term", "instead"))).alias("changes")), "changes")


def disclosure(n_entity: Column, n_term: Column, n_both: Column, n_docs: int) -> Column:
    """PMI(entity; term) as a part of the entity's information content; 0 for an entity that every document holds."""
    content = F.log2(F.lit(float(n_docs)) / n_entity)
    return F.when(content > 0, F.log2(n_both * F.lit(float(n_docs)) / (n_entity * n_term)) / content).otherwise(0.0)


def _spanned(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    spans, texts = [], []
    changes = batch.column("changes") if "changes" in batch.schema.names else None
    for k, text in enumerate(batch.column("text")):
        text = text.as_py()
        base = base_spans(text)
        told = dict(changes[k].as_py() or ()) if changes is not None else {}
        spans.append([*with_names(base), *(term_spans(text, base, told) if told else ())])
        texts.append(rewritten(text, spans[-1]))
    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), as_spans(spans), pa.array(texts, pa.string())], names=["doc_id", "spans", "text"])


def private_spans(docs: DataFrame, threshold: float = 0.9, min_texts: int = 2, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of each row of docs: personal data and the terms that disclose it, by kind, then start."""
    texts = texts_of(docs, id_col, text_col)
    found = written(found_in(texts), "found")
    changes = disclosing_terms(texts, found, threshold, min_texts)
    if changes is None:
        return found.select(F.col("doc_id").alias(id_col), "spans")
    near, far = _parted(texts, changes, found)
    return far.select("doc_id", "spans").unionByName(near.select("doc_id", "spans")).withColumnRenamed("doc_id", id_col)


def sanitised(docs: DataFrame, threshold: float = 0.9, min_texts: int = 2, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans, text) of each row of docs: as private_spans, with the text that they are replaced in."""
    texts = texts_of(docs, id_col, text_col)
    found = written(found_in(texts), "found")
    changes = disclosing_terms(texts, found, threshold, min_texts)
    kind = texts.schema["doc_id"].dataType.simpleString()
    if changes is None:
        out = over(texts.select("doc_id", "text"), _spanned, f"doc_id {kind}, {SPANS}, text string")
    else:
        near, far = _parted(texts, changes, texts)
        out = over(far.select("doc_id", "text"), _spanned, f"doc_id {kind}, {SPANS}, text string").unionByName(near)
    return out.withColumnsRenamed({"doc_id": id_col, "text": text_col})


def _parted(texts: DataFrame, changes: DataFrame, others: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rewritten rows of the texts that may be among those of changes, and the rows of others that are not."""
    bits = bits_for(changes.count())
    kept = bitmap(changes, "digest", bits)
    near = flagged(texts, "digest", kept, bits, "near").where("near").join(changes, "digest", "left")
    kind = texts.schema["doc_id"].dataType.simpleString()
    near = over(near.select("doc_id", "text", "changes"), _spanned, f"doc_id {kind}, {SPANS}, text string")
    return near, flagged(others, "digest", kept, bits, "near").where("not near")


def written_as_text(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the spans of these kinds, by kind and start, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    of_kinds = F.filter(spans, lambda s: s["kind"] < len(kinds))
    ordered = F.array_sort(F.transform(of_kinds, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
