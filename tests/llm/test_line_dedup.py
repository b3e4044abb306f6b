import random
import re
import time

import pytest

from loomtext.llm.line_dedup import line_dedup, recurring_lines, templates

from .helpers import docs, rows


def template(line):
    line = re.sub(r"[ \t\x0b\f\r]{2,}|[\t\x0b\f\r]", " ", line)
    return re.sub(r"(?<!\S)[^\s0-9]*[0-9]\S*", "<*>", line).strip(" ")


def brute(texts, min_docs=3, depth=3, similarity=0.8, keep_first=True):
    """All pairs of a leaf's templates are compared; families are what they connect."""
    where = {}
    for k, text in enumerate(texts):
        for line in {template(x) for x in (text or "").split("\n")} - {""}:
            where.setdefault(line, set()).add((k, text))
    leaves, family = {}, {t: {t} for t in where}
    for t in where:
        leaves.setdefault((t.count(" ") + 1, *t.split(" ")[:depth]), []).append(t)
    for members in leaves.values():
        for i, t in enumerate(members):
            for u in members[:i]:
                same = sum(a == b for a, b in zip(t.split(" "), u.split(" "), strict=True))
                if same >= similarity * (t.count(" ") + 1) and family[t] is not family[u]:
                    both = family[t] | family[u]
                    for x in both:
                        family[x] = both
    first = {}
    for t in where:
        docs_of = set().union(*[where[x] for x in family[t]])
        if len(docs_of) >= min_docs:
            first[t] = min(k for k, _ in docs_of)
    out = []
    for k, text in enumerate(texts):
        if text is None:
            out.append((k, None))
            continue
        stays = [x for x in text.split("\n") if template(x) not in first or (keep_first and first[template(x)] == k)]
        out.append((k, "\n".join(stays)))
    return out


def corpus(seed):
    r = random.Random(seed)
    common = ["Page 3 of 17", "All rights reserved by X", "id=44 error in module  alpha", "Read more about this story here"]
    out = []
    for k in range(60):
        lines = [" ".join(r.choice("abcdefg") + r.choice("xyz") for _ in range(r.randint(1, 7))) for _ in range(r.randint(0, 5))]
        lines += r.sample(common, r.randint(0, 3))
        if k % 3 == 0:
            lines.append(f"Page {k} of 99")
        if k % 4 == 0:
            lines.append("Read more about this tale here")
        if k % 5 == 0:
            lines.append("Read more about that " + r.choice("pq") + " of old there by us today")
        if k % 7 < 3:
            lines.append("Read more about " + r.choice("uvw") + " new place here and now with me")
        r.shuffle(lines)
        out.append("\n".join(lines))
    return [*out, None, "", "\n\n", " \n", "word " * 30_000, *["whole copy\nof a text"] * 5]


@pytest.mark.parametrize(("seed", "hot", "keep"), [(1, 1, True), (2, 10_000, False)])
def test_brute_force(spark, seed, hot, keep):
    texts = corpus(seed)
    found = line_dedup(docs(spark, texts, extra=True), hot=hot, keep_first=keep)
    assert sorted(rows(found, "doc_id", "text")) == brute(texts, keep_first=keep)


def test_edges(spark):
    assert line_dedup(docs(spark, [])).count() == 0
    clean = ["one line here", "another line there", None]
    assert rows(line_dedup(docs(spark, clean)), "doc_id", "text", "n_dropped") == [(0, clean[0], 0), (1, clean[1], 0), (2, None, 0)]
    nulls = docs(spark, ["same line"] * 4).selectExpr("CAST(NULL AS LONG) AS doc_id", "text")
    assert line_dedup(nulls).count() == 4


def test_families_of_one_leaf(spark):
    """Two families in a leaf, of which the rarer one has no template in common with the more frequent one."""
    texts = [f"a b c common words here stand and {x} end" for x in ("p", "p", "q", "r")]
    texts += [f"a b c other things lie there or {x} stop" for x in ("s", "t", "u")]
    found = rows(line_dedup(docs(spark, texts), keep_first=False), "doc_id", "n_dropped")
    assert found == [(k, 1) for k in range(7)]


def test_chains(spark):
    """A agrees with B, B with C, and A not with C: A goes with B and C, and also with B alone."""
    c = "f0 f1 f2 f3 f4 f5 f6 f7 f8 f9 g0 g1"
    for b, a in ((c.replace("f3", "x").replace("f4", "y"), None), (c.replace("f3", "x").replace("f4", "y"), "same")):
        a = b.replace("f6", "u").replace("f7", "v") if a is None else b.replace("x", "u").replace("f5", "v").replace("y", "f4 ").replace("f4 ", "y")
        for texts in ([c] * 3 + [b] * 2 + [a], [b] * 2 + [a]):
            found = line_dedup(docs(spark, [f"own {'x' * k}\n{t}" for k, t in enumerate(texts)]), keep_first=False)
            assert sorted(rows(found, "doc_id", "n_dropped")) == [(k, 1) for k in range(len(texts))]


@pytest.mark.parametrize("seed", [1, 2])
def test_templates_of_one_leaf(spark, seed):
    """Many templates of a leaf, any two of which may agree."""
    r = random.Random(seed)
    texts = ["\n".join("a b c " + " ".join(r.choice("pq") for _ in range(r.choice([6, 9, 13]))) for _ in range(2)) for _ in range(40)]
    found = line_dedup(docs(spark, texts), min_docs=3, similarity=0.8)
    assert sorted(rows(found, "doc_id", "text")) == brute(texts, min_docs=3)


def test_many_lines(spark):
    """Taking out lines takes time in proportion to a document's lines."""
    took = []
    for n in (20_000, 80_000):
        texts = ["\n".join(f"{chr(97 + k % 26)} line {hex(k).translate(str.maketrans('0123456789', 'ghijklmnop'))}" for k in range(n))] * 2
        began = time.perf_counter()
        found = rows(line_dedup(docs(spark, [t + f"\nown {'ab'[k]}" for k, t in enumerate(texts)]), min_docs=2, keep_first=False), "n_lines", "n_dropped", "text")
        took.append(time.perf_counter() - began)
        assert found == [(n + 1, n, "own a"), (n + 1, n, "own b")]
    assert took[1] < 6 * took[0] + 20


def test_a_document_counts_once(spark):
    texts = ["a b c d e f g h i j\na b c d e f g h i k\na b c d e f g h i l", "x"]
    assert rows(line_dedup(docs(spark, texts), min_docs=2, keep_first=False), "doc_id", "n_dropped") == [(0, 0), (1, 0)]


def test_clashing_columns(spark):
    texts = ["same line"] * 3 + [None]
    names = ["n_lines", "n_dropped", "__dropped", "dropped", "__id", "th", "__th", "c0", "id", "t1", "n", "_found", "page"]
    df = docs(spark, texts).selectExpr("*", *[f"'{c}' AS {c}" for c in names])
    found = line_dedup(df, added=("lines_", "gone_"))
    assert found.columns == [*df.columns, "lines_", "gone_"]
    assert rows(found, "doc_id", "gone_", *names) == [(0, 0, *names), (1, 1, *names), (2, 1, *names), (3, 0, *names)]
    found = line_dedup(df)
    assert sorted(found.columns) == sorted(df.columns) and rows(found, "doc_id", "n_lines", "n_dropped", "th") == [(0, 1, 0, "th"), (1, 1, 1, "th"), (2, 1, 1, "th"), (3, 0, 0, "th")]


def test_query_drops_what_two_documents_share(spark, tmp_path):
    from loomtext.llm.queries import op3_line_dedup

    shared = "this line stands in just two documents of them all"
    docs(spark, [f"one thing\n{shared}", f"another thing\n{shared}", "third"]).write.parquet(str(tmp_path / "documents.parquet"))
    assert rows(op3_line_dedup(spark, str(tmp_path)), "doc_id", "n_dropped") == [(0, 0), (1, 1), (2, 0)]


def rare_pair(n, r):
    """Templates that share a block and nothing else, and two rare ones of them that agree."""
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(9))
    texts = [" ".join(["a b c p q", *[word() for _ in range(5)]]) for _ in range(n)]
    texts = [t for t in texts for _ in range(2)]
    one = "a b c p q v w x y z"
    return [*texts, one, one.replace("v", "vv").replace("y", "yy")]


@pytest.mark.parametrize("n", [20, 33, 80])
def test_rare_templates_of_a_large_block(spark, n):
    """Two templates that agree, beside more frequent ones of their block that agree with neither."""
    texts = rare_pair(n, random.Random(n))
    found = rows(line_dedup(docs(spark, texts), min_docs=2), "doc_id", "n_dropped")
    assert found == [(k, k % 2) for k in range(2 * n + 2)]


@pytest.mark.parametrize(("seed", "seeds"), [(1, 1), (2, 2), (3, 5)])
def test_blocks_cut_again(spark, monkeypatch, seed, seeds):
    monkeypatch.setattr("loomtext.llm.line_dedup.SEEDS", seeds)
    r = random.Random(seed)
    texts = ["\n".join("a b c " + " ".join(r.choice("pqrst") for _ in range(r.choice([3, 7, 12]))) for _ in range(2)) for _ in range(70)]
    texts += ["a b c " + " ".join(r.choice(["p", "q"]) if k < 6 else r.choice("stuvwx") for k in range(12)) for _ in range(50)]
    found = line_dedup(docs(spark, texts), min_docs=3)
    assert sorted(rows(found, "doc_id", "text")) == brute(texts, min_docs=3)


def judged(spark, texts):
    return docs(spark, texts).selectExpr("doc_id AS id", "text", "xxhash64(text) AS th")


def test_templates_of_odd_lines(spark):
    """Digits and unusual blanks in one line of a text, several or none, beside plain ones."""
    texts = [
        "plain words\n\n  two at the start\nid=7\tx  9a b9 \r", "\t\nno digit\x0bhere\f\f\n   ", "a b\nc d ", " \u00e9t\u00e9 \u0661 x\ny\u00e97 z", "", "one\r\ntwo",
        "a  b", "x 1\n2 y\n3", "-4\n\r\n.",
    ]
    want = sorted((k, i, template(x)) for k, text in enumerate(texts) for i, x in enumerate(text.split("\n")) if template(x))
    assert sorted(rows(templates(judged(spark, texts)), "id", "line", "template")) == want


def test_each_line_is_judged_once(spark):
    """The patterns run once a line, in compiled code: not in functions over arrays, nor again in a filter below."""
    plan = templates(judged(spark, ["a 1"]))._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and plan.count("regexp_replace(") == 2 and plan.lower().count("rlike(") == 1


def test_text_travels_where_templates_are_compared(spark):
    one, two = "just this line in its leaf", ["a b c d e f g h i j", "a b c d e f g h i k"]
    found = rows(recurring_lines(judged(spark, [one, one, "own", *two]), min_docs=2, depth=3), "id", "template")
    assert found == [(0, None), (1, None), (3, two[0]), (4, two[1])]
