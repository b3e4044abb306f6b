"""Language-model operators: providers, cost, prompts, and parsing of replies.

A provider turns prompts into replies inside ``mapInArrow``, some at a time in each task; other columns pass as they are.
One answers from a table, so that every operator runs offline; the others speak to chat services over HTTP. Calls that
would cost more than a limit aren't made unless asked for. Parsing is column expressions, and rows that need no call are
filtered out before one.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import in_slices
from ..functions.text import n_tokens, ustrip
from .profile import unlabeled

UNKNOWN = "UNKNOWN"
#: US dollars a million tokens, in and out; unknown models cost nothing.
PRICES = (
    ("gpt-4o", 2.50, 10.00), ("gpt-4o-mini", 0.15, 0.60), ("gpt-4.1", 2.00, 8.00), ("gpt-4.1-mini", 0.40, 1.60), ("gpt-4.1-nano", 0.10, 0.40),
    ("claude-sonnet-4-20250514", 3.00, 15.00), ("claude-haiku-4-5-20251001", 0.80, 4.00), ("claude-opus-4-20250514", 15.00, 75.00),
)
COST_LIMIT = 5.0


class Provider(Protocol):
    def complete(self, prompt: str, system: str) -> str: ...


class TableProvider:
    """Answers from a mapping of substrings of the prompt to replies; the offline stub."""

    def __init__(self, replies: dict[str, str], default: str = ""):
        self.replies, self.default = replies, default

    def complete(self, prompt: str, system: str = "") -> str:
        return next((r for part, r in self.replies.items() if part in prompt), self.default)


class Transient(Exception):
    """A failure that is worth another attempt."""


class CostLimitExceeded(Exception):
    """The estimate of what a run would cost is above the limit."""

    def __init__(self, estimate: dict):
        super().__init__(f"estimated {estimate['dollars']} dollars for {estimate['n_prompts']} prompts")
        self.estimate = estimate


#: Where each kind of service listens, and its path for chats.
SERVICES = {
    "openai": ("https://api.openai.com", "/v1/chat/completions"),
    "anthropic": ("https://api.anthropic.com", "/v1/messages"),
    "ollama": ("http://localhost:11434", "/api/chat"),
}


@dataclass(frozen=True)
class ChatService:
    """A provider over HTTP. It is sent to the workers as it is, key included; base_url points it at another host."""

    service: str
    model: str
    key: str = ""
    base_url: str | None = None
    temperature: float = 0.0
    max_tokens: int = 512
    timeout: float = 60.0

    def __post_init__(self):
        if self.service not in SERVICES:
            raise ValueError(f"unknown service {self.service!r}; known: {', '.join(SERVICES)}")

    def request(self, prompt: str, system: str = "") -> urllib.request.Request:
        host, path = SERVICES[self.service]
        turns = [{"role": "user", "content": prompt}]
        body: dict = {"model": self.model, "messages": turns}
        headers = {"Content-Type": "application/json"}
        if self.service == "anthropic":
            body |= {"max_tokens": self.max_tokens, "temperature": self.temperature} | ({"system": system} if system else {})
            headers |= {"x-api-key": self.key, "anthropic-version": "2023-06-01"}
        else:
            if system:
                turns.insert(0, {"role": "system", "content": system})
            if self.service == "openai":
                body |= {"max_tokens": self.max_tokens, "temperature": self.temperature}
                headers["Authorization"] = f"Bearer {self.key}"
            else:
                body |= {"stream": False, "options": {"temperature": self.temperature, "num_predict": self.max_tokens}}
        return urllib.request.Request((self.base_url or host).rstrip("/") + path, json.dumps(body).encode(), headers)

    def complete(self, prompt: str, system: str = "") -> str:
        try:
            with urllib.request.urlopen(self.request(prompt, system), timeout=self.timeout) as reply:
                found = json.load(reply)
        except urllib.error.HTTPError as e:
            if e.code == 429 or e.code >= 500:
                raise Transient(str(e)) from e
            raise
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            raise Transient(str(e)) from e
        if self.service == "anthropic":
            return "".join(part.get("text", "") for part in found["content"])
        return (found["choices"][0]["message"] if self.service == "openai" else found["message"])["content"]


def with_retries(provider: Provider, prompt: str, system: str = "", attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """The reply, or None after so many transient failures; waits 1, 2, 4 seconds, 30 at most."""
    for k in range(attempts):
        try:
            return provider.complete(prompt, system)
        except Transient:
            sleep(min(2.0**k, 30.0))
    return None


def complete(
    df: DataFrame, provider: Provider, prompt_col: str = "prompt", system: str = "", parallelism: int | None = None, concurrency: int = 1,
    model: str | None = None, max_tokens: int = 512, cost_limit: float | None = None,
) -> DataFrame:
    """df with reply (null for failures and for null prompts). parallelism is the number of tasks, concurrency that of
    calls at a time in each. With a model, CostLimitExceeded is raised before any call if the estimate of the costs of
    prompts and system prompt exceeds cost_limit (COST_LIMIT by default; infinity asks for the calls anyway)."""
    if model is not None:
        whole = df.select(F.concat_ws(" ", F.lit(system), F.col(prompt_col)).alias("prompt"))
        estimate = estimate_cost(whole, "prompt", model, price_table(df.sparkSession), max_tokens).first().asDict()
        if (estimate["dollars"] or 0) > (COST_LIMIT if cost_limit is None else cost_limit):
            raise CostLimitExceeded(estimate)
    rows = df.repartition(parallelism) if parallelism else df

    schema = rows.withColumn("reply", F.lit(None).cast("string")).schema
    names = schema.names

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(max(1, concurrency)) as pool:
            for batch in in_slices(batches):
                prompts = (p.as_py() for p in batch.column(batch.schema.names.index(prompt_col)))
                replies = pool.map(lambda p: None if p is None else with_retries(provider, p, system), prompts)
                columns = dict(zip(batch.schema.names, batch.columns)) | {"reply": pa.array(replies, pa.string())}
                yield pa.RecordBatch.from_arrays([columns[name] for name in names], names=names)

    return rows.mapInArrow(walk, schema)


def cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, calls, input_tokens, output_tokens, dollars) of a call log (model, input_tokens, output_tokens)."""
    sums = usage.groupBy("model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    priced = sums.join(F.broadcast(prices), "model", "left")
    dollars = (F.col("input_tokens") * F.coalesce("price_in", F.lit(0.0)) + F.col("output_tokens") * F.coalesce("price_out", F.lit(0.0))) / 1e6
    return priced.select("model", "calls", "input_tokens", "output_tokens", F.round(dollars, 6).alias("dollars"))


def price_table(spark) -> DataFrame:
    return spark.createDataFrame(list(PRICES), "model string, price_in double, price_out double")


def estimate_cost(prompts: DataFrame, prompt_col: str, model: str, prices: DataFrame, max_tokens: int = 512) -> DataFrame:
    """(n_prompts, input_tokens, output_tokens, dollars, over_limit) before any call."""
    base = prompts.agg(F.count("*").alias("n_prompts"), F.sum(n_tokens(F.col(prompt_col))).alias("input_tokens")).withColumn("output_tokens", F.col("n_prompts") * max_tokens).withColumn("model", F.lit(model))
    out = base.join(F.broadcast(prices), "model", "left")
    dollars = (F.col("input_tokens") * F.coalesce("price_in", F.lit(0.0)) + F.col("output_tokens") * F.coalesce("price_out", F.lit(0.0))) / 1e6
    return out.select("n_prompts", "input_tokens", "output_tokens", F.round(dollars, 4).alias("dollars"), (dollars > COST_LIMIT).alias("over_limit"))


def classify_prompt(text: Column, labels: list[str], definitions: dict[str, str] | None = None, examples: dict[str, list[str]] | None = None, template: str | None = None) -> Column:
    """The prompt for each text. In a template {text}, {labels}, {definitions}, {examples} are filled in this order."""
    told = "\n".join(f"- {k}: {v}" for k, v in (definitions or {}).items())
    shown = "\n".join(f'"{x}" -> {k}' for k, xs in (examples or {}).items() for x in xs)
    if template is None:
        template = "Classify the text into one of: {labels}.\n" + ("{definitions}\n" if told else "") + ("{examples}\n" if shown else "") + 'Text: {text}\nReply as JSON: {"label": "...", "confidence": 0.0}'
    out = F.replace(F.lit(template), F.lit("{text}"), text)
    for name, value in (("labels", ", ".join(labels)), ("definitions", told), ("examples", shown)):
        out = F.replace(out, F.lit("{" + name + "}"), F.lit(value))
    return out


# replies

#: What a label looks like inside a reply, the fences of code, quotation marks, and what may stand around a
#: label.
_LABEL = r'"label"\s*:\s*"([^"]+)"'
_OBJECT = r'(?s)\{[^}]*"label"\s*:\s*"([^"]+)"[^}]*\}'
_FENCE_START, _FENCE_END = r"^```(?:json)?\s*", r"\s*```\s*$"
_QUOTES = "^[\"']+|[\"']+$"
_BEFORE, _AFTER = r"(?i)(?:^|[\s\"'（(,，:：])\Q", r"\E(?:[\s\"'）),，:：.]|$)"


def _first(labels: list[str], test: Callable[[Column, Column], Column]) -> Column:
    """The first label, in the codebook's order, that passes."""
    return F.coalesce(*[F.when(test(F.lit(x), F.lit(x.lower())), F.lit(x)) for x in labels])


def _json_label(raw: Column) -> Column:
    """The label of a reply that is a JSON object as a whole."""
    return F.when(raw.rlike(r"(?s)^\{.*\}$"), ustrip(F.get_json_object(raw, "$.label")))


def _nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def parse_label(reply: Column, labels: list[str]) -> Column:
    """struct<label, confidence>: JSON, else JSON inside other text, else a label itself or in the text, else a start."""
    raw = ustrip(reply)
    inside = F.regexp_extract(raw, _OBJECT, 1)
    whole = _json_label(raw)
    label = F.coalesce(
        whole, _nonempty(ustrip(inside)), _first(labels, lambda _, low: F.lower(raw) == low), _first(labels, lambda _, low: F.contains(F.lower(raw), low)), F.substring(raw, 1, 50)
    )
    number = _nonempty(F.regexp_extract(raw, r'"confidence"\s*:\s*([0-9.]+)', 1))
    confidence = F.when(whole.isNotNull(), F.get_json_object(raw, "$.confidence")).when(inside != "", number).try_cast("double")
    return F.struct(label.alias("label"), confidence.alias("confidence"))


def match_label(found: Column, labels: list[str]) -> Column:
    """Equal, else at the start, else anywhere, without regard to case; else what was found."""
    low = F.lower(found)
    return F.coalesce(_first(labels, lambda _, x: low == x), _first(labels, lambda _, x: F.startswith(low, x)), _first(labels, lambda _, x: F.contains(low, x)), found)


def parse_label_robust(reply: Column, labels: list[str]) -> Column:
    """Also takes off code fences, and looks at the first line and for labels between delimiters."""
    raw = ustrip(reply)
    bare = ustrip(F.regexp_replace(F.regexp_replace(raw, _FENCE_START, ""), _FENCE_END, ""))
    inside = _nonempty(F.regexp_extract(raw, _LABEL, 1))
    line = ustrip(F.regexp_replace(ustrip(F.split(raw, "\n", 2)[0]), _QUOTES, ""))
    delimited = lambda x, _: F.regexp_like(raw, F.concat(F.lit(_BEFORE), x, F.lit(_AFTER)))
    return F.coalesce(
        match_label(F.coalesce(_json_label(bare), _json_label(raw)), labels), match_label(ustrip(inside), labels), _first(labels, lambda _, low: F.lower(raw) == low),
        _first(labels, lambda _, low: F.lower(line) == low), _first(labels, delimited), _nonempty(F.substring(line, 1, 50)), F.substring(raw, 1, 50),
    )


def parse_label_plain(reply: Column) -> Column:
    """JSON, JSON inside text, a quoted string, else the first line that isn't blank."""
    raw = ustrip(reply)
    quoted = F.when((F.length(raw) > 1) & raw.rlike("(?s)^([\"']).*\\1$"), ustrip(F.substring(raw, F.lit(2), F.length(raw) - 2)))
    line = F.filter(F.transform(F.split(raw, r"\r?\n"), ustrip), lambda x: x != "")
    return F.coalesce(_json_label(raw), _nonempty(ustrip(F.regexp_extract(raw, _LABEL, 1))), quoted, F.get(line, F.lit(0)), raw)


def batch_report(results: DataFrame, label_col: str = "label") -> DataFrame:
    """(label, n, share, failed) of predicted labels."""
    total = F.sum("n").over(Window.partitionBy())
    out = results.groupBy(F.coalesce(F.col(label_col), F.lit(UNKNOWN)).alias("label")).agg(F.count("*").alias("n"))
    return out.select("label", "n", F.round(F.col("n") / total, 4).alias("share"), (F.col("label") == UNKNOWN).alias("failed"))


def classify(df: DataFrame, provider: Provider, labels: list[str], text_col: str = "text", **prompt) -> DataFrame:
    """df with label and confidence; a failed call gives UNKNOWN."""
    asked = df.withColumn("prompt", classify_prompt(F.col(text_col), labels, **prompt))
    out = complete(asked, provider).withColumn("p", parse_label(F.col("reply"), labels))
    return out.select(*df.columns, F.when(F.col("reply").isNull(), UNKNOWN).otherwise(F.col("p.label")).alias("label"), F.col("p.confidence").alias("confidence"))


def classify_unlabeled(df: DataFrame, predict: Callable[[DataFrame], DataFrame], id_col: str, label_col: str) -> DataFrame:
    """df with final_label and source (given, predicted): only rows without a label are predicted, and joined by id.
    predict: DataFrame with (id, predicted) from the rows that need it."""
    new = predict(df.where(unlabeled(F.col(label_col)))).select(F.col(id_col).alias("__id"), "predicted")
    out = df.join(new, df[id_col] == new["__id"], "left").drop("__id")
    empty = unlabeled(F.col(label_col))
    return out.withColumn("final_label", F.when(empty, F.col("predicted")).otherwise(F.col(label_col).cast("string"))).withColumn("source", F.when(empty, "predicted").otherwise("given")).drop("predicted")


def evaluate_variants(predictions: DataFrame) -> DataFrame:
    """(variant, n, accuracy, macro_f1, best) of (variant, truth, predicted); best is the first of largest F1."""
    from .agreement import label_margins, pair_counts

    low = predictions.select("variant", F.lower(ustrip(F.col("truth"))).alias("t"), F.lower(ustrip(F.col("predicted"))).alias("p"))
    margins = label_margins(pair_counts(low, "t", "p", ("variant",)), ("variant",))
    f = F.avg(F.when(F.col("r") > 0, 2 * F.col("tp") / (F.col("r") + F.col("c"))))
    out = margins.groupBy("variant").agg(F.first("total").alias("n"), F.round(F.sum("tp") / F.first("total"), 4).alias("accuracy"), F.round(f, 4).alias("macro_f1"))
    rank = F.row_number().over(Window.orderBy(F.desc("macro_f1"), "variant"))
    return out.withColumn("best", rank == 1)


CODING = "struct<themes:array<struct<name:string,confidence:double,trigger_words:array<string>,reasoning:string,evidence_span:string>>>"


def match_theme(name: Column, themes: list[str]) -> Column:
    """Equal, else equal without case, else one within the other; in the codebook's order."""
    low = F.lower(name)
    return F.coalesce(_first(themes, lambda x, _: name == x), _first(themes, lambda _, x: low == x), _first(themes, lambda _, x: F.contains(x, low) | F.contains(low, x)))


def parse_coding(df: DataFrame, reply_col: str, themes: list[str], id_col: str = "item_id") -> DataFrame:
    """(id, theme, confidence, triggers, reasoning, evidence) of coding replies; confidence in 0..1, to three places."""
    body = F.regexp_extract(F.col(reply_col), r"(?s)(\{.*\})", 1)
    out = df.select(F.col(id_col), F.explode(F.from_json(body, CODING)["themes"]).alias("t")).withColumn("theme", match_theme(F.coalesce("t.name", F.lit("")), themes))
    confidence = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("t.confidence", F.lit(0.5)))), 3)
    return out.where("theme is not null").select(id_col, "theme", confidence.alias("confidence"), F.coalesce("t.trigger_words", F.array().cast("array<string>")).alias("triggers"), F.coalesce("t.reasoning", F.lit("")).alias("reasoning"), F.trim(F.coalesce("t.evidence_span", F.lit(""))).alias("evidence"))


def extraction_batches(segments: DataFrame, doc_col: str = "doc_id", size: int = 15, most: int | None = None) -> DataFrame:
    """(doc, batch, prompt): segments in batches of size, whole; with most, each cut at so many characters."""
    text = F.col("text")
    if most is not None:
        text = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)
    line = F.concat(F.lit("["), "segment_id", F.lit("] "), text)
    rows = segments.select(doc_col, F.floor((F.col("segment_id") - 1) / size).cast("int").alias("batch"), F.struct("segment_id", line.alias("line")).alias("s"))
    return rows.groupBy(doc_col, "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["line"]), "\n\n").alias("prompt"))


MATCHES = "struct<matches:array<struct<segment_id:string,rq_id:string,sub_theme:string,confidence:double,reasoning:string,evidence_span:string>>>"


def parse_extraction(df: DataFrame, reply_col: str, questions: DataFrame, id_col: str = "doc_id", no_theme: str = "uncategorised") -> DataFrame:
    """(id, segment_id, rq_id, sub_theme, confidence, evidence): matches of known questions (rq_id, sub_themes) whose
    sub-theme, where the question names any, is one of them."""
    bare = F.regexp_extract(F.col(reply_col), r"(?s)(\{.*\})", 1)
    out = df.select(F.col(id_col), F.explode(F.from_json(bare, MATCHES)["matches"]).alias("m")).select(id_col, "m.*").withColumn("segment_id", F.col("segment_id").try_cast("long")).where("segment_id is not null")
    out = out.withColumn("sub_theme", F.trim(F.coalesce("sub_theme", F.lit("")))).join(F.broadcast(questions.select("rq_id", "sub_themes")), "rq_id")
    named = F.size(F.coalesce("sub_themes", F.array().cast("array<string>"))) > 0
    out = out.where(~named | (F.col("sub_theme") == "") | F.array_contains("sub_themes", F.col("sub_theme")))
    confidence = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.5)))), 3)
    return out.select(id_col, "segment_id", "rq_id", F.coalesce(_nonempty(F.col("sub_theme")), F.lit(no_theme)).alias("sub_theme"), confidence.alias("confidence"), F.trim(F.coalesce("evidence_span", F.lit(""))).alias("evidence"))
