"""Runs of a model over a table: batches of which some fail, prompts in variants, and their reports.

Every batch has a key. Replies are written as they come in, round by round, into a folder of the shared storage; a round
asks only what has no reply yet (an anti-join), so a run that was broken off, or a service that was down for a while,
costs no reply that was paid for. A failure is a null reply: nothing of its batch is lost but the batch itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clip
from .completion import Provider, Transient, complete, evaluate_variants, extraction_batches, parse_extraction, parse_label_robust

ERROR = "ERROR"
#: Variants of a prompt that are crossed with the rows at most, and the fewest rows that tell anything about them.
MOST_VARIANTS, LEAST_ROWS = 20, 5


@dataclass(frozen=True)
class Guarded:
    """A provider whose failures of any kind are one batch's: what isn't worth another attempt gives no reply."""

    provider: Provider

    def complete(self, prompt: str, system: str = "") -> str | None:
        try:
            return self.provider.complete(prompt, system)
        except Transient:
            raise
        except Exception:
            return None


def ask(df: DataFrame, keys: list[str], provider: Provider, path: str, rounds: int = 3, **options) -> DataFrame:
    """df (keys, prompt, ...) with reply, null where all rounds failed. path: a folder for the replies of this run; what
    an earlier run left there isn't asked again. Keys name a row and aren't null. options: of complete()."""
    spark = df.sparkSession
    schema = df.select(*keys).withColumn("reply", F.lit(None).cast("string")).schema

    def replies() -> DataFrame:
        return spark.read.schema(schema).parquet(path).dropDuplicates(keys)

    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    for _ in range(rounds):
        left = df.join(replies().select(*keys), keys, "left_anti")
        if left.isEmpty():
            break
        asked = left.select(*keys, options.get("prompt_col", "prompt"))  # nothing else is written
        complete(asked, Guarded(provider), **options).where("reply is not null").select(*schema.names).write.mode("append").parquet(path)
    return df.join(replies(), keys, "left")


FORM = '{"matches": [{"segment_id": 1, "rq_id": "RQ1", "sub_theme": "", "confidence": 0.0, "reasoning": "", "evidence_span": ""}]}'


def framework(questions: list[dict]) -> str:
    """The research questions (rq_id, description, sub_themes) as the prompt tells them."""
    lines = []
    for q in questions:
        lines.append(f"{q['rq_id']}: {q['description']}")
        lines += [f"  - {s}" for s in q.get("sub_themes") or []]
    return "\n".join(lines)


def extract(segments: DataFrame, questions: list[dict], provider: Provider, path: str, size: int = 15, most: int | None = None, rounds: int = 3, **options) -> tuple[DataFrame, DataFrame]:
    """(matches, batches). matches: (doc_id, segment_id, rq_id, sub_theme, confidence, evidence) with the segment's text
    and place; batches: (doc_id, batch, reply), a null reply for those that failed in every round. Segments stand whole
    in the prompts; with most, they are cut at so many characters."""
    spark = segments.sparkSession
    asked = extraction_batches(segments, "doc_id", size, most)
    head, tail = F.lit(framework(questions) + "\n\n"), F.lit(f"\n\nWhich segments speak to which question? Reply as JSON: {FORM}")
    asked = asked.withColumn("prompt", F.concat(head, "prompt", tail))
    replied = ask(asked, ["doc_id", "batch"], provider, path, rounds, **options)
    known = spark.createDataFrame([(q["rq_id"], list(q.get("sub_themes") or [])) for q in questions], "rq_id string, sub_themes array<string>")
    found = parse_extraction(replied.where("reply is not null"), "reply", known)
    matches = found.withColumn("segment_id", F.col("segment_id").cast("int")).join(segments, ["doc_id", "segment_id"])
    return matches, replied.select("doc_id", "batch", "reply")


def extraction_report(matches: DataFrame, batches: DataFrame, questions: list[dict]) -> DataFrame:
    """(name, n): batches, failed ones, matches, distinct segments that match, and matches of each question, none too."""
    counts = batches.agg(F.count("*").alias("batches"), F.count_if(F.col("reply").isNull()).alias("failed"))
    counts = counts.unpivot([], counts.columns, "name", "n")
    of = matches.agg(F.count("*").alias("matches"), F.countDistinct("doc_id", "segment_id").alias("segments"))
    asked = matches.sparkSession.createDataFrame([(q["rq_id"],) for q in questions], "rq_id string")
    each = asked.join(matches.groupBy("rq_id").agg(F.count("*").alias("n")), "rq_id", "left")
    return counts.unionByName(of.unpivot([], of.columns, "name", "n")).unionByName(each.select(F.col("rq_id").alias("name"), F.coalesce("n", F.lit(0)).alias("n")))


def run_variants(
    df: DataFrame, variants: dict[str, str], provider: Provider, labels: list[str], id_col: str, text_col: str, truth_col: str, path: str,
    most: int | None = 50, rounds: int = 1, **options,
) -> DataFrame:
    """(id, text, truth, variant, reply, predicted): every labelled row asked with every variant of the prompt, whose
    place for the text is added where it lacks one. most: rows of smallest id that are asked, as each costs a call for
    each variant; None asks all. The cost gate of complete() is that of the whole product. A failed call is ERROR."""
    if not variants or len(variants) > MOST_VARIANTS:
        raise ValueError(f"between 1 and {MOST_VARIANTS} variants, not {len(variants)}")
    rows = df.where(F.col(truth_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(truth_col).cast("string").alias("truth"))
    if most is not None:
        rows = rows.orderBy("id").limit(most)
    if (n := rows.limit(LEAST_ROWS).count()) < LEAST_ROWS:
        raise ValueError(f"{n} labelled rows; at least {LEAST_ROWS} are needed")
    whole = {name: t if "{text}" in t else f"{t}\n\nText: {{text}}" for name, t in variants.items()}
    crossed = rows.crossJoin(F.broadcast(df.sparkSession.createDataFrame(list(whole.items()), "variant string, template string")))
    asked = crossed.select("id", "text", "truth", "variant", F.replace("template", F.lit("{text}"), F.col("text")).alias("prompt"))
    replied = ask(asked, ["id", "variant"], provider, path, rounds, **options)
    predicted = F.when(F.col("reply").isNull(), ERROR).otherwise(parse_label_robust(F.col("reply"), labels))
    return replied.select("id", "text", "truth", "variant", "reply", predicted.alias("predicted"))


def variant_scores(predictions: DataFrame) -> DataFrame:
    return evaluate_variants(predictions.select("variant", "truth", "predicted"))


def variant_detail(predictions: DataFrame, variants: list[str]) -> DataFrame:
    """(id, text, truth) and for each variant what it said and whether that is right, case aside; texts cut at 60."""
    told = predictions.groupBy("id", "truth", clip(F.col("text"), 60).alias("text")).pivot("variant", variants).agg(F.first("predicted"))
    right = {f"{v} right": F.lower(F.trim(F.col(f"`{v}`"))) == F.lower(F.trim("truth")) for v in variants}
    return told.select("id", "text", "truth", *[c for v in variants for c in (F.col(f"`{v}`"), F.coalesce(right[f"{v} right"], F.lit(False)).alias(f"{v} right"))])
