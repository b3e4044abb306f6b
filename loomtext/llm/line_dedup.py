"""Line dedup: a log-template tree of fixed depth, in DataFrame operations only.

A line's fields are what white space separates; a field that bears a digit is variable and reads ``<*>``. The tree's
first level is the number of fields, the next ``depth`` levels are the leading fields; this path names a leaf. Inside a
leaf two templates agree if they are equal in at least ``similarity`` of their fields, and a family is what agreement
connects, however long the chain: a template that joins never parts others. Templates that agree differ in d fields at
most, so of d + 1 blocks of fields one is equal, and only templates that share a block are compared: each with the
``SEEDS`` most frequent ones of the block (of equal frequency those of larger hash). In blocks up to that size all that
agree are found. In larger ones those that stay outside the block's largest family are compared with all of other families, if
they are few (``SEEDS`` or d + 1); else the block's templates are cut again, by the fields that the block leaves, of which
d + 1 new blocks hold one equal one, and so on. A block that leaves d fields or fewer holds only templates that agree. So
all families are found, and a round makes at most max(SEEDS, d + 1) rows or pairs of each row it is given.
A family that recurs in ``min_docs`` documents or more is dropped from all of them but the one of
smallest id, so that no content goes from the corpus as a whole (``keep_first=False`` drops it there too).

Scale: two scans judge the lines; only lines of texts with a digit or unusual blanks pass the masking patterns. The first
counts leaves (map-side, 32 bytes a leaf); a bitmap over the leaves that recur, sized by their number and broadcast, holds
back all other lines in the second, and one over those of several templates says which lines are written with their text.
From there on templates are known by hashes of 128 bits; texts are shuffled once a template, to be compared. Families are components of the links, found in
rounds whose number grows with the logarithm of their length. Templates that hold more than 1/``hot`` of all
occurrences (fewer than ``hot``, by that definition) meet the lines by broadcast, all others by a shuffle in which no
key is larger. The whole text is shuffled once, by document, for the rewriting.

Defined cases: null and empty texts have no lines and come back as they are (null stays null). Blank lines are never
templates and stay. Rows of equal id and text count as one document and are treated alike; a null id is
never the first. In the first document every line of the template stays. Extra columns are passed through, under any
name; where df has columns called as the two added ones (``n_lines``, ``n_dropped``, unless named otherwise), the added
ones take their place. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bitmap import bitmap, bits_for, flagged, maybe
from .common import deleted, written
from .components import connected_components

HOT = 10_000
SEEDS = 32
VARIABLE = "<*>"
KEY = ["t1", "t2"]
#: Characters one by one: with ranges or alternatives, the pattern takes up to twice as long.
ODD = r"[0123456789\t\x0B\f\r]"


def templates(rows: DataFrame) -> DataFrame:
    """(id, th, line, template) of rows (id, th, text): the templates of the texts' lines, with variable fields masked and
    runs of blanks as one space; lines of blanks alone are left out."""
    rows = rows.withColumn("odd", F.col("text").rlike(ODD) | F.contains("text", F.lit("  ")))  # once a text, not once a line
    rows = rows.select("id", "th", "odd", F.posexplode(F.split("text", "\n")).alias("line", "template"))
    line, rows = F.col("template"), rows.where(F.ltrim("template", F.lit(" \t\x0b\f\r")) != "")
    even = F.when(F.col("odd"), F.regexp_replace(line, r"[ \t\x0B\f\r]{2,}|[\t\x0B\f\r]", " ")).otherwise(line)
    mask = F.when(F.col("odd"), F.regexp_replace(line, r"(?<!\S)[^\s0-9]*+[0-9]\S*+", VARIABLE)).otherwise(line)
    return rows.withColumn("template", even).withColumn("template", F.trim(mask)).drop("odd")


def _leaf(line: Column, depth: int) -> Column:
    fields = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "))) + 1
    return F.xxhash64(fields, F.substring_index(line, " ", depth))


def recurring_lines(rows: DataFrame, *, min_docs: int, depth: int) -> DataFrame:
    """(id, th, line, template, leaf, t1, t2): the lines in leaves that hold min_docs lines, and few others; the template is
    null in leaves that hold only one."""
    lines = templates(rows).withColumn("leaf", _leaf(F.col("template"), depth)).withColumn("t1", F.xxhash64("template"))
    leaves = lines.groupBy("leaf").agg(F.count("*").alias("n"), F.min("t1").alias("least"), F.max("t1").alias("most"))
    leaves = written(leaves.where(F.col("n") >= min_docs).select("leaf", (F.col("least") != F.col("most")).alias("several")), "leaves")
    bits = bits_for(leaves.count())
    several = written(bitmap(leaves.where("several"), "leaf", bits), "leaves_of_several")
    kept = written(bitmap(leaves, "leaf", bits), "leaf_filter")
    found = flagged(maybe(lines, "leaf", kept, bits), "leaf", several, bits, "several")
    found = found.select("id", "th", "line", F.expr("if(several, template, null)").alias("template"), "leaf", "t1", F.xxhash64(F.lit(1), "template").alias("t2"))
    found = written(found, "lines")
    deleted(leaves, kept, several)
    return found


def _fields(texts: DataFrame, depth: int, similarity: float) -> DataFrame:
    """(leaf, n, t1, t2, group, apart, rest): how many fields may differ, and those in which templates of a leaf can; no
    row for a template that agrees with none but itself."""
    rows = texts.select("leaf", "n", *KEY, F.lit(0).cast("long").alias("group"), F.split("template", " ").alias("fields"))
    rows = rows.withColumn("apart", F.floor(F.size("fields") * (1 - similarity) + 1e-9).cast("int")).where("apart > 0")
    return rows.withColumn("rest", F.slice("fields", depth + 1, F.greatest(F.size("fields") - depth, F.lit(0)))).drop("fields")


def blocks(rows: DataFrame) -> DataFrame:
    """(leaf, n, t1, t2, group, apart, whole, start, stop, block): hashes of the blocks of fields, of which templates of a
    group that agree share one. All of a group agree where no more fields are left than may differ (whole): there one block
    stands for all. What the blocks are cut from is a column, so that it is made once."""
    rows = rows.withColumn("size", F.size("rest")).withColumn("whole", F.expr("size <= apart")).withColumn("parts", F.expr("if(whole, 1, apart + 1)"))
    start, stop = "cast(i * size div parts as int)", "cast((i + 1) * size div parts as int)"
    block = f"if(whole, xxhash64(group, i), xxhash64(group, i, slice(rest, {start} + 1, {stop} - {start})))"
    cut = F.explode(F.expr(f"transform(sequence(0, parts - 1), i -> struct({start} AS start, {stop} AS stop, {block} AS block))"))
    return rows.select("leaf", "n", *KEY, "group", "apart", "whole", cut.alias("b")).select("leaf", "n", *KEY, "group", "apart", "whole", "b.*")


def _seeded(parts: DataFrame) -> DataFrame:
    """(t1, t2, g1, g2): each template with the SEEDS most frequent ones of its blocks."""
    own = F.struct("n", *KEY)
    place = F.row_number().over(Window.partitionBy("leaf", "block").orderBy(F.desc("n"), F.desc("t1"), F.desc("t2")))
    seeds = parts.withColumn("place", place).where(F.col("place") <= SEEDS).select("leaf", "block", own.alias("seed"))
    pairs = parts.join(seeds, ["leaf", "block"]).where(F.col("seed") > own)
    return pairs.select(*KEY, F.col("seed.t1").alias("g1"), F.col("seed.t2").alias("g2"))


def _crossed(parted: DataFrame) -> DataFrame:
    """(t1, t2, g1, g2): the templates outside a block's largest family, with all of other families."""
    outside = parted.where("family != most").select("leaf", "block", F.col("t1").alias("g1"), F.col("t2").alias("g2"), F.col("family").alias("other"))
    once = (F.col("family") == F.col("most")) | (F.struct(*KEY) < F.struct("g1", "g2"))
    return parted.join(outside, ["leaf", "block"]).where((F.col("family") != F.col("other")) & once).select(*KEY, "g1", "g2")


def _agreeing(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b): those of the pairs (t1, t2, g1, g2) that agree."""
    pairs = pairs.distinct().join(texts.select(*KEY, "template"), KEY).join(texts.select(F.col("t1").alias("g1"), F.col("t2").alias("g2"), F.col("template").alias("seed")), ["g1", "g2"])
    fields = F.split("template", " ")
    agree = F.size(F.filter(F.zip_with(fields, F.split("seed", " "), lambda a, b: a == b), lambda x: x))
    near = pairs.where(agree >= similarity * F.size(fields))
    return near.select(F.struct(*KEY).alias("a"), F.struct(F.col("g1").alias("t1"), F.col("g2").alias("t2")).alias("b"))


def _parted(parts: DataFrame, found: DataFrame) -> DataFrame | None:
    """The rows of blocks of more than SEEDS templates that aren't all of one family, with their family, the block's
    largest one (most) and the number of its templates outside that (others); None where there are none."""
    sizes = parts.groupBy("leaf", "block").agg(F.count("*").alias("members")).where(F.col("members") > SEEDS)
    if sizes.isEmpty():
        return None
    families_of = found.select(F.col("node.t1"), F.col("node.t2"), F.col("component").alias("family"))
    large = parts.join(sizes.drop("members"), ["leaf", "block"]).join(families_of, KEY, "left")
    large = written(large.withColumn("family", F.coalesce("family", F.struct(*KEY))), "large")
    shares = large.groupBy("leaf", "block", "family").agg(F.count("*").alias("k")).groupBy("leaf", "block")
    shares = shares.agg(F.max(F.struct("k", "family")).alias("x"), F.sum("k").alias("members")).where("members > x.k")
    out = written(large.join(shares.select("leaf", "block", F.col("x.family").alias("most"), F.expr("members - x.k").alias("others")), ["leaf", "block"]), "parted")
    deleted(large)
    return None if out.isEmpty() else out


def families(texts: DataFrame, *, depth: int, similarity: float) -> DataFrame:
    """(t1, t2, g1, g2): the templates that agree with others, and their family. texts: (t1, t2, leaf, template, n)."""
    several = texts.groupBy("leaf").agg(F.count("*").alias("members")).where("members > 1").select("leaf")
    texts = written(texts.join(several, "leaf", "left_semi"), "several")  # most leaves hold one template
    rows, links, found = _fields(texts, depth, similarity), [], None
    while rows is not None:
        parts = written(blocks(rows), "blocks")
        links.append(written(_agreeing(_seeded(parts), texts, similarity), "agreeing"))
        found, links = _linked(links, found), []
        parted, left = _parted(parts, found), None
        if parted is not None:
            few = F.col("whole") | (F.col("others") <= F.greatest(F.lit(SEEDS), F.col("apart") + 1))
            links.append(written(_agreeing(_crossed(parted.where(few)), texts, similarity), "agreeing"))
            left = parted.where(~few).select("leaf", *KEY, "group", "block", "start", "stop").join(rows, ["leaf", *KEY, "group"])
            rest = F.concat(F.slice("rest", F.lit(1), F.col("start")), F.slice("rest", F.col("stop") + 1, F.size("rest")))
            left = written(left.select("leaf", "n", *KEY, F.col("block").alias("group"), "apart", rest.alias("rest")), "left")
            left = None if left.isEmpty() else left
        deleted(rows, parts, *(() if parted is None else (parted,)))
        rows = left
    found = _linked(links, found) if links else found
    deleted(texts)
    return found.select("node.t1", "node.t2", F.col("component.t1").alias("g1"), F.col("component.t2").alias("g2"))


def _linked(links: list[DataFrame], found: DataFrame | None) -> DataFrame:
    """(node, component) of the links (a, b) and of what was found before."""
    if found is not None and all(x.isEmpty() for x in links):
        return found
    edges = reduce(DataFrame.unionByName, [*links, *([] if found is None else [found.select(F.col("node").alias("a"), F.col("component").alias("b"))])])
    out = connected_components(edges)
    deleted(*links)
    return out


def _spread_join(rows: DataFrame, keyed: DataFrame, least: int) -> DataFrame:
    """rows with the columns of keyed: (t1, t2, n, others). Keys of more than least rows are broadcast."""
    wanted = keyed.withColumn("_found", F.lit(True))
    marked = rows.join(F.broadcast(wanted.where(F.col("n") > least)), KEY, "left")
    rest = marked.where("_found is null").select(rows.columns)
    return marked.where("_found").unionByName(rest.join(wanted.where(F.col("n") <= least), KEY)).drop("_found", "n")


def recurring_templates(lines: DataFrame, *, min_docs: int, depth: int, similarity: float, hot: int) -> DataFrame:
    """(t1, t2, n, first_id) of the templates to be dropped; n: documents that have the template itself."""
    once = written(lines.select(*KEY, "id", "th").distinct(), "once")
    stats = written(once.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("id").alias("first_id")), "templates")
    least = once.count() // hot
    texts = lines.where("template is not null").where(F.size(F.split("template", " ")) * (1 - similarity) >= 1 - 1e-9).groupBy(*KEY).agg(F.first("leaf").alias("leaf"), F.first("template").alias("template"))
    texts = written(texts.join(stats.select(*KEY, "n"), KEY), "texts")
    member = written(families(texts, depth=depth, similarity=similarity).join(stats.select(*KEY, "n"), KEY), "members")
    # documents of a family count once, whatever many of its templates they have
    family = _spread_join(once, member, least).select("g1", "g2", "id", "th").distinct()
    family = family.groupBy("g1", "g2").agg(F.count("*").alias("docs"), F.min("id").alias("first_id"))
    family = member.join(family.where(F.col("docs") >= min_docs), ["g1", "g2"]).select(*KEY, "n", "first_id")
    alone = stats.where(F.col("n") >= min_docs).join(member, KEY, "left_anti").select(*KEY, "n", "first_id")
    out = written(alone.unionByName(family), "recurring")
    deleted(once, stats, texts, member)
    return out


def dropped_lines(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, depth: int = 3, similarity: float = 0.8,
    keep_first: bool = True, hot: int = HOT,
) -> DataFrame:
    """(id, th, dropped): the numbers (from 0) of the lines that go, for each document that loses any."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    rows = rows.withColumn("th", F.xxhash64("text"))
    lines = recurring_lines(rows, min_docs=min_docs, depth=depth)
    recurring = recurring_templates(lines, min_docs=min_docs, depth=depth, similarity=similarity, hot=hot)
    least = (recurring.agg(F.sum("n")).first()[0] or 0) // hot
    gone = _spread_join(lines.select("id", "th", "line", *KEY), recurring, least)
    if keep_first:
        gone = gone.where(~F.col("id").eqNullSafe(F.col("first_id")) | F.col("id").isNull())
    return gone.groupBy("id", "th").agg(F.collect_set("line").alias("dropped"))


def line_dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", added: tuple[str, str] = ("n_lines", "n_dropped"), **parameters) -> DataFrame:
    """df with recurring lines taken out of text_col, and the numbers of lines and of dropped lines added under the names
    of added, after its columns or in the place of columns so called."""
    gone = dropped_lines(df, id_col=id_col, text_col=text_col, **parameters)
    names = [c for c in df.columns if c not in added]
    own = df.select(*[df[c] for c in names]).toDF(*[f"c{k}" for k in range(len(names))])
    at_id, at_text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    # lines travel instead of the text, so that each is looked up by its number and the text isn't split again for it
    own = own.withColumn("hash", F.xxhash64(at_text)).withColumn(at_text, F.split(at_text, "\n"))
    joined = own.join(gone, own[at_id].eqNullSafe(gone["id"]) & (own["hash"] == gone["th"]), "left")
    stays = F.array_except(F.sequence(F.lit(0), F.size(at_text) - 1), "dropped")
    kept = F.when(F.col("dropped").isNull(), F.col(at_text)).otherwise(F.transform(stays, lambda k: F.get(at_text, k)))
    text = F.array_join(kept, "\n")
    empty = (F.size(at_text) == 1) & (F.get(at_text, F.lit(0)) == "")
    n_lines = F.when(F.col(at_text).isNull() | empty, 0).otherwise(F.size(at_text)).cast("long")
    n_dropped = F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long")
    return joined.select(*[(text if f"c{k}" == at_text else F.col(f"c{k}")).alias(c) for k, c in enumerate(names)], n_lines.alias(added[0]), n_dropped.alias(added[1]))
