"""Holds spans against plain patterns, and disclosing terms against counts made document by document."""

import math
import random
import re

import pytest

from loomtext.llm import sanitise

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = 0
    for k, c in enumerate(d[::-1]):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain(text):
    def n(m):
        return re.sub("[^0-9]", "", m)

    kinds = [
        (EMAIL, lambda m: True), (IP, lambda m: all(int(p) <= 255 for p in m.split("."))),
        (CARD, lambda m: 16 <= len(n(m)) <= 19 and luhn(n(m))), (PHONE, lambda m: 8 <= len(n(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, (p, ok) in enumerate(kinds) for m in p.finditer(text) if ok(m[0])]


def test_base_spans():
    r = random.Random(1)
    bits = ["a", "b.c", "@", "@", ".", "..", "1", "22", "256", "192.168.0.1", "4111 1111 1111 1111", "4111-1111", "0", "+", "+1 ", "(", ")", " ", "-", "_", "%", "x@y.z", "é", "\n"]
    for _ in range(20000):
        text = "".join(r.choices(bits, k=r.randrange(1, 14)))
        assert sanitise.base_spans(text) == plain(text), text


def test_long_texts():
    for text in ("1" * 300_000, "1." * 200_000, "a" * 300_000, "a@" * 100_000, "+1" * 100_000, "+1 " + "(" * 200_000, "a@b" * 100_000):
        sanitise.base_spans(text)


def corpus():
    r = random.Random(2)
    common = [f"word{k}" for k in range(30)]
    rows = [(k, " ".join(r.choices(common, k=12))) for k in range(60)]
    for k in range(5):  # a nickname and a town are met with the address alone; a wider form of the town elsewhere too
        rows.append((100 + k, f"{' '.join(r.choices(common, k=5 + k))} Zorro Springfield mail a.b@c.org end"))
    rows += [(200, "springs springfed springtime"), (201, "springs again"), (202, "springs"), (203, "springboard")]
    rows += [(300, "Zorro x@y.org")] * 3  # copies are one text
    rows += [(None, None), (None, "Zorro a.b@c.org"), (100, ""), (301, "12345 +49 30 1234567"), (302, "12345 call +49 (30) 123-4567 now")]
    return rows


def slow(rows, threshold, min_texts):
    texts = [t or "" for _, t in rows]
    base = [plain(t) for t in texts]
    ents = [{sanitise.entity(k, t[a:b]) for k, a, b in s} for t, s in zip(texts, base)]
    forms = [sanitise.forms(t) for t in texts]
    n = len(texts)

    def told(e, f):
        both = [t for t, x, y in zip(texts, ents, forms) if e in x and f in y]
        n_e, n_f = sum(e in x for x in ents), sum(f in y for y in forms)
        if len(set(both)) < min_texts:
            return None
        return n_e < n and math.log2(len(both) * n / (n_e * n_f)) / math.log2(n / n_e) >= threshold

    out = []
    for (doc, _), text, spans, own in zip(rows, texts, base, ents):
        found = [(k, a, b, f"[{sanitise.KINDS[k].upper()}]") for k, a, b in spans]
        for m in re.finditer(r"\w\w+", text):
            term = m[0].lower()
            asks = [e for e in own if told(e, term)]
            if asks and not any(a < m.end() and m.start() < b for _, a, b in spans):
                wider = sanitise.general(term)
                safe = all(wider and told(e, wider) is False for e in asks)
                found.append((4, m.start(), m.end(), wider if safe else ""))
        out.append((doc, found))
    return out


@pytest.mark.parametrize(("threshold", "min_texts"), [(0.9, 2), (0.6, 3), (5.0, 2)])
def test_disclosing_terms(spark, threshold, min_texts):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, digest string, spans string")
    found = sanitise.private_spans(docs, threshold, min_texts).collect()
    expected = slow(rows, threshold, min_texts)
    assert sorted((str(r[0]), [tuple(s) for s in r[1]]) for r in found) == sorted((str(d), s) for d, s in expected)
    terms = {s[3] for _, spans in expected for s in spans if s[0] == 4}
    assert bool(terms) == (threshold < 1)
    clean = {r["doc_id"]: r["text"] for r in sanitise.sanitised(docs, threshold, min_texts).collect()}
    assert "@" not in "".join(clean.values()) and clean[0] == rows[0][1]
    if threshold == 0.9:
        assert "Springfield" not in clean[101] and "Zorro" in clean[101] and clean[203] == "springboard"


def test_query(spark, tmp_path):
    """The registered query's counts, digest and spans, over awkward rows."""
    import hashlib

    from loomtext.llm.queries import op12_pii

    rows = [*corpus(), (400, "x@y.z 1.2.3.4 and 5.6.7.8; 4111 1111 1111 1111 +1 (555) 123-4567 q@r.s"), (401, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    expected = []
    for (doc, _), (_, found) in zip(rows, slow(rows, 0.9, 2)):
        found = sorted(s[:3] for s in found)
        told = [",".join(f"{sanitise.KINDS[k]}:{a}:{b}" for k, a, b in found if k < most) for most in (4, 5)]
        expected.append((doc, *[sum(k == kind for k, _, _ in found) for kind in range(4)], hashlib.sha256(told[0].encode()).hexdigest(), told[1]))
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    got = [tuple(r[n] for n in names) for r in op12_pii(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected)) and any("term:" in e[-1] for e in expected)
    assert (400, 2, 2, 1, 1) in {g[:5] for g in got}


def test_rewriting():
    text = "a 1.2.3.4 b"
    assert sanitise.rewritten(text, [(1, 2, 9, "[IP]"), (4, 4, 7, "x"), (4, 10, 11, "")]) == "a [IP] "


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert sanitise.private_spans(docs).collect() == [] and sanitise.sanitised(docs).collect() == []
