"""Prompts for classification, coding and extraction; parsers of what users type; runs of several coders."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialised
from . import completion, tfidf
from .completion import Provider

PLACEHOLDERS = ("text", "labels", "definitions", "examples")


def initial_template(task: str, definitions: dict[str, str], inclusion: dict[str, list[str]] | None = None, exclusion: dict[str, list[str]] | None = None) -> str:
    """A classification template with the labels spelt out; {text} is left for completion.classify_prompt()."""
    lines = [task.strip(), "", "Labels:"]
    for label, meaning in definitions.items():
        lines.append(f"- {label}: {meaning}")
        lines += [f"  belongs: {x}" for x in (inclusion or {}).get(label, ())]
        lines += [f"  does not belong: {x}" for x in (exclusion or {}).get(label, ())]
    return "\n".join([*lines, "", "Text: {text}", 'Reply as JSON: {"label": "...", "confidence": 0.0}'])


def repaired(template: str) -> tuple[str, list[str]]:
    """The template with a {text} placeholder, and notes on what was wrong with it."""
    notes = [f"unknown placeholder {{{x}}}" for x in re.findall(r"\{(\w+)\}", template) if x not in PLACEHOLDERS]
    if "{text}" not in template:
        notes.append("no place for the text; added at the end")
        template = template.rstrip() + "\n\nText: {text}"
    if "label" not in template.lower():
        notes.append("no mention of a label in the reply")
    return template, notes


def parse_definitions(typed: str, labels: list[str]) -> dict[str, str]:
    """label -> definition, from a JSON object or lines of ``label: text``; labels without one are left out."""
    try:
        found = json.loads(typed)
        if isinstance(found, dict):
            return {k: str(v).strip() for k, v in found.items() if k in labels}
    except ValueError:
        pass
    low = {x.lower(): x for x in labels}
    out: dict[str, str] = {}
    for line in typed.splitlines():
        name, mark, meaning = re.sub(r"^\s*[-*]\s*", "", line).replace("：", ":").partition(":")
        if mark and (label := low.get(name.strip().strip("\"'").lower())) and meaning.strip():
            out[label] = meaning.strip()
    return out


def parse_examples(typed: str, labels: list[str]) -> dict[str, list[str]]:
    """label -> examples, from a JSON object of lists or strings, or lines of ``label: text``."""
    try:
        found = json.loads(typed)
        if isinstance(found, dict):
            return {k: [str(x) for x in (v if isinstance(v, list) else [v])] for k, v in found.items() if k in labels}
    except ValueError:
        pass
    low = {x.lower(): x for x in labels}
    out: dict[str, list[str]] = {}
    for line in typed.splitlines():
        name, mark, text = re.sub(r"^\s*[-*]\s*", "", line).replace("：", ":").partition(":")
        if mark and (label := low.get(name.strip().strip("\"'").lower())) and text.strip():
            out.setdefault(label, []).append(text.strip().strip('"'))
    return out


def parse_questions(typed: str) -> list[tuple[str, str, list[str]]]:
    """(rq_id, description, sub_themes) from text: a line ``RQ1: description`` opens a question, lines with a dash
    below it are its sub-themes, which may also stand in one line, parted by commas or semicolons."""
    out: list[tuple[str, str, list[str]]] = []
    for line in typed.splitlines():
        line = line.strip()
        if not line:
            continue
        if m := re.match(r"(?i)(RQ\s*\d+)\s*[:：.、]?\s*(.*)", line):
            out.append((m[1].upper().replace(" ", ""), m[2].strip(), []))
        elif out and (m := re.match(r"[-*•·]\s*(.+)", line)):
            out[-1][2].extend(x.strip() for x in re.split(r"[;；,，、]", m[1]) if x.strip())
        else:
            out.append((f"RQ{len(out) + 1}", line, []))
    return out


def questions_table(spark, questions: list[tuple[str, str, list[str]]]) -> DataFrame:
    return spark.createDataFrame(questions, "rq_id string, description string, sub_themes array<string>")


def generate_variants(provider: Provider, template: str, n: int = 3) -> list[str]:
    """The template and up to n rewrites that keep its placeholder; a failed call adds none."""
    out = [template]
    for k in range(n):
        reply = completion.with_retries(provider, f"Rewrite this prompt, variant {k + 1}. Keep {{text}}.\n\n{template}")
        if reply and "{text}" in reply and reply.strip() not in out:
            out.append(reply.strip())
    return out


def coding_prompt(text: Column, themes: list[dict]) -> Column:
    lines = []
    for t in themes:
        lines += [f"### {t['name']}", t.get("description", "")]
        lines += [f'  include: "{x}"' for x in t.get("inclusion", ())[:3]] + [f'  exclude: "{x}"' for x in t.get("exclusion", ())[:3]]
    head = "Themes:\n" + "\n".join(lines) + '\n\nReply as JSON: {"themes": [{"name": "", "confidence": 0.0, "trigger_words": [], "reasoning": "", "evidence_span": ""}]}\n\nText: '
    return F.concat(F.lit(head), text)


def code_texts(df: DataFrame, provider: Provider, themes: list[dict], id_col: str = "item_id", text_col: str = "text", coder: str = "coder") -> DataFrame:
    """(item_id, coder, theme, confidence, triggers, reasoning, evidence) by one coder; failed calls code nothing."""
    asked = df.select(F.col(id_col).alias("item_id"), coding_prompt(F.coalesce(F.col(text_col), F.lit("")), themes).alias("prompt"))
    coded = completion.parse_coding(completion.complete(asked, provider), "reply", [t["name"] for t in themes])
    return coded.select("item_id", F.lit(coder).alias("coder"), "theme", "confidence", "triggers", "reasoning", "evidence")


def code_by_all(df: DataFrame, providers: dict[str, Provider], themes: list[dict], **columns: str) -> DataFrame:
    """Codings of two or more coders, attributed by name; each is a branch of one plan and they run side by side."""
    if len(providers) < 2:
        raise ValueError("a consensus takes two coders")
    parts = [code_texts(df, provider, themes, coder=name, **columns) for name, provider in providers.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def extract_segments(segments: DataFrame, provider: Provider, questions: DataFrame, framework: str, doc_col: str = "doc_id", size: int = 15) -> DataFrame:
    """Matches of segments to research questions, by batches of segments; failed batches match nothing."""
    batches = completion.extraction_batches(segments, doc_col, size)
    asked = batches.withColumn("prompt", F.concat(F.lit(framework + "\n\n"), "prompt", F.lit('\n\nReply as JSON: {"matches": [{"segment_id": 1, "rq_id": "RQ1", "sub_theme": "", "confidence": 0.0, "reasoning": "", "evidence_span": ""}]}')))
    found = completion.parse_extraction(completion.complete(asked, provider), "reply", questions, doc_col)
    return found.join(segments.select(doc_col, "segment_id", "text"), [doc_col, "segment_id"], "left")


def select_examples_by(provider: Provider, df: DataFrame, id_col: str, text_col: str, label_col: str, n: int = 3, most: int = 50) -> DataFrame:
    """(label, pick, id): n examples of each label, which a model picks from the label's first texts by id (a prompt holds
    ``most``); all of them where there are n at most. A label whose reply can't be read, or names none of the texts, gets
    the diverse ones of tfidf.select_examples(). A prompt for each label; the calls run in tasks."""
    rows = df.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    first = Window.partitionBy("label").orderBy("id")
    shown = rows.withColumn("k", F.row_number().over(first)).where(F.col("k") <= most)
    line = F.concat(F.lit("["), F.col("k"), F.lit("] "), "text")
    asked = shown.groupBy("label").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("k", line.alias("line")))).alias("s"))
    head = f"Pick the {n} texts that show best, and most differently, what this label covers. Reply as a JSON list of their numbers.\n\nLabel: "
    asked = asked.where(F.col("n") > n).select("label", F.concat(F.lit(head), "label", F.lit("\n"), F.array_join(F.transform("s", lambda x: x["line"]), "\n")).alias("prompt"))
    picked = F.from_json(F.regexp_extract(F.col("reply"), r"(?s)(\[[\d\s,]*\])", 1), "array<int>")
    replies = materialised(completion.complete(asked, provider).select("label", F.slice(F.array_distinct(F.coalesce(picked, F.array().cast("array<int>"))), 1, n).alias("ks")))
    by_model = replies.select("label", F.posexplode("ks").alias("pick", "k")).join(shown.select("label", "k", "id"), ["label", "k"]).select("label", (F.col("pick") + 1).alias("pick"), "id")
    by_model = materialised(by_model)
    few = shown.withColumn("all", F.count("*").over(Window.partitionBy("label"))).where(F.col("all") <= n).select("label", F.col("k").alias("pick"), "id")
    left = rows.join(by_model.unionByName(few).select("label").distinct(), "label", "left_anti")
    others = tfidf.select_examples(left, "id", "text", "label", n)
    return by_model.unionByName(few).unionByName(others.select("label", "pick", "id"))


def suggest_themes_by(provider: Provider, texts: list[str], n_themes: int = 6, most: int = 30) -> list[dict] | None:
    """Themes from a reply over the first texts (a prompt holds that many); None if the reply can't be read."""
    prompt = f"Suggest {n_themes} themes as a JSON list of name and description.\n\n" + "\n".join(f"- {t}" for t in texts[:most])
    reply = completion.with_retries(provider, prompt) or ""
    m = re.search(r"\[.*\]", reply, re.S)
    try:
        found = json.loads(m[0]) if m else None
    except ValueError:
        found = None
    return [t for t in found if isinstance(t, dict) and t.get("name")] if isinstance(found, list) else None
