"""Methods paragraphs from the figures of a run, in English and Chinese, and the logs that hold those figures.

A paragraph is a row of slots. A slot is said if the log has what it needs, so a missing figure leaves its words out;
numbers that are zero count as missing, as they do in logs that were never filled. Logs are made from a run's tables by
one aggregation for each of their parts; what tables can't tell (a model's name, say) is handed in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import agreement

#: What a log says where it says nothing, by pipeline.
DEFAULTS: dict[str, dict] = {
    "quantitative": {
        "n_samples": 0, "n_classes": 0, "class_labels": [], "classification_method": "", "model_name": "", "model_backend": "", "n_annotations": 0,
        "prompt_optimization_used": False, "n_prompt_variants": 0, "accuracy": 0.0, "macro_f1": 0.0, "weighted_f1": 0.0, "cohens_kappa": 0.0,
        "icr_kappa": 0.0, "icr_alpha": 0.0,
    },
    "qualitative": {
        "n_segments": 0, "n_themes": 0, "theme_names": [], "research_questions": [], "deidentification_performed": False, "n_pii_detected": 0,
        "coding_model_name": "", "coding_model_backend": "", "consensus_coding_used": False, "n_consensus_models": 0, "consensus_model_names": [],
        "consensus_agreement": 0.0, "n_high_confidence": 0, "n_medium_confidence": 0, "n_low_confidence": 0,
        "review_stats": {"accepted": 0, "rejected": 0, "edited": 0, "pending": 0}, "icr_jaccard": 0.0, "icr_per_theme_kappa": 0.0,
    },
}
#: Most labels that a log names, and a paragraph lists.
MOST_LABELS, LISTED = 1000, 5

Slot = tuple[Callable[[dict], object], str, str]


def has(*names: str) -> Callable[[dict], bool]:
    return lambda x: all(x.get(n) for n in names)


def _method(name: str) -> Callable[[dict], bool]:
    return lambda x: x["classification_method"] == name


def _tiers(x: dict) -> int:
    return x["n_high_confidence"] + x["n_medium_confidence"] + x["n_low_confidence"]


def _decided(x: dict) -> int:
    return x["accepted"] + x["rejected"] + x["edited"]


def _by_consensus(x: dict) -> bool:
    return bool(x["consensus_coding_used"]) and x["n_consensus_models"] >= 2


_QUANTITATIVE: tuple[Slot, ...] = (
    (has("n_samples"), "The corpus comprised {n_samples:,} texts", "语料共包含 {n_samples:,} 条文本"),
    (has("n_classes"), "each was assigned to one of {n_classes} classes{listed_labels}", "每条文本归入 {n_classes} 个类别之一{listed_labels}"),
    (_method("zero-shot"), "labels were asked of {model} without showing it any example", "由 {model} 在无示例的提示下给出标签"),
    (_method("few-shot"), "labels were asked of {model}, which was shown labelled examples", "由 {model} 参照提示中的已标注示例给出标签"),
    (_method("fine-tune-local"), "{model} was trained further on the annotated texts, on our own machines", "在本地用标注文本对 {model} 作进一步训练"),
    (_method("fine-tune-api"), "{model} was trained further on the annotated texts by its provider", "由服务方用标注文本对 {model} 作进一步训练"),
    (lambda x: x["model_name"] and not x["classification_method"], "labels were predicted with {model}", "标签由 {model} 预测"),
    (has("n_annotations"), "{n_annotations:,} texts were annotated by hand", "人工标注 {n_annotations:,} 条"),
    (lambda x: x["prompt_optimization_used"] and x["n_prompt_variants"] > 1, "the best of {n_prompt_variants} wordings of the prompt was chosen automatically", "从 {n_prompt_variants} 种提示写法中自动选出最优者"),
    (lambda x: x["prompt_optimization_used"] and x["n_prompt_variants"] <= 1, "the wording of the prompt was improved automatically", "提示写法经自动改进"),
    (has("accuracy"), "accuracy was {accuracy:.3f}", "准确率为 {accuracy:.3f}"),
    (has("macro_f1"), "macro-averaged F1 was {macro_f1:.3f}", "宏平均 F1 为 {macro_f1:.3f}"),
    (has("weighted_f1"), "F1 weighted by class size was {weighted_f1:.3f}", "按类别大小加权的 F1 为 {weighted_f1:.3f}"),
    (has("cohens_kappa"), "Cohen's kappa was {cohens_kappa:.3f}", "Cohen's kappa 为 {cohens_kappa:.3f}"),
    (has("icr_kappa"), "the human coders agreed with a kappa of {icr_kappa:.3f}", "人工编码者之间的 kappa 为 {icr_kappa:.3f}"),
    (has("icr_alpha"), "Krippendorff's alpha of the human coders was {icr_alpha:.3f}", "人工编码者之间的 Krippendorff's alpha 为 {icr_alpha:.3f}"),
)
_QUALITATIVE: tuple[Slot, ...] = (
    (has("n_segments"), "The material was divided into {n_segments:,} segments", "材料划分为 {n_segments:,} 个片段"),
    (has("deidentification_performed", "n_pii_detected"), "{n_pii_detected:,} pieces of personal data were replaced before coding", "编码前替换了 {n_pii_detected:,} 处个人信息"),
    (lambda x: x["deidentification_performed"] and not x["n_pii_detected"], "personal data was replaced before coding", "编码前替换了个人信息"),
    (has("research_questions"), "it was read for {n_questions} research questions", "围绕 {n_questions} 个研究问题阅读"),
    (has("n_themes"), "coded with a codebook of {n_themes} themes{listed_themes}", "按 {n_themes} 个主题编码{listed_themes}"),
    (_by_consensus, "{consensus_coders} coded each segment by themselves, and themes on which most agreed were kept", "由 {consensus_coders} 各自独立编码，保留多数一致的主题"),
    (lambda x: _by_consensus(x) and x["consensus_agreement"], "their mean agreement was {consensus_agreement:.3f}", "平均一致率为 {consensus_agreement:.3f}"),
    (lambda x: x["coding_model_name"] and not _by_consensus(x), "first-pass codes were assigned by {coding_model}", "初步编码由 {coding_model} 完成"),
    (_tiers, "confidence was high for {n_high_confidence:,} segments, medium for {n_medium_confidence:,} and low for {n_low_confidence:,}", "置信度高的片段 {n_high_confidence:,} 个，中等的 {n_medium_confidence:,} 个，低的 {n_low_confidence:,} 个"),
    (_decided, "on review {accepted:,} codes were accepted, {rejected:,} rejected and {edited:,} changed", "复核时接受 {accepted:,} 个编码，否决 {rejected:,} 个，修改 {edited:,} 个"),
    (has("icr_jaccard"), "review and first pass shared themes with a mean Jaccard index of {icr_jaccard:.3f}", "复核与初编的主题平均 Jaccard 指数为 {icr_jaccard:.3f}"),
    (has("icr_per_theme_kappa"), "their kappa was {icr_per_theme_kappa:.3f} on average over themes", "各主题 kappa 的平均值为 {icr_per_theme_kappa:.3f}"),
)
_SLOTS = {"quantitative": _QUANTITATIVE, "qualitative": _QUALITATIVE}


def completed(log: dict) -> dict:
    """log with defaults for what it lacks; a null counts as lacking."""
    if log.get("pipeline") not in DEFAULTS:
        raise ValueError(f"unknown pipeline {log.get('pipeline')!r}")
    return DEFAULTS[log["pipeline"]] | {k: v for k, v in log.items() if v is not None}


def _listed(names: list, language: str) -> str:
    if not names:
        return ""
    shown = ("、" if language == "zh" else ", ").join(map(str, names[:LISTED])) + ("…" if len(names) > LISTED else "")
    return f"（{shown}）" if language == "zh" else f" ({shown})"


def _named(name: str, backend: str, language: str) -> str:
    name = name or ("语言模型" if language == "zh" else "a language model")
    return name + (f"（{backend}）" if language == "zh" else f" ({backend})") if backend else name


def _derived(x: dict, language: str) -> dict:
    if x["pipeline"] == "quantitative":
        return {"listed_labels": _listed(x["class_labels"], language), "model": _named(x["model_name"], x["model_backend"], language)}
    models = x["consensus_model_names"]
    many = f"{x['n_consensus_models']} 个模型" if language == "zh" else f"{x['n_consensus_models']} models"
    return DEFAULTS["qualitative"]["review_stats"] | (x["review_stats"] or {}) | {
        "listed_themes": _listed(x["theme_names"], language), "n_questions": len(x["research_questions"]),
        "coding_model": _named(x["coding_model_name"], x["coding_model_backend"], language),
        "consensus_coders": ("、" if language == "zh" else ", ").join(models) if models else many,
    }


def methods_text(log: dict, language: str = "en") -> str:
    """log: what a pipeline wrote about itself; its key pipeline (quantitative, qualitative) chooses the slots."""
    x = completed(log)
    if language not in ("en", "zh"):
        raise ValueError(f"unknown language {language!r}")
    x |= _derived(x, language)
    parts = [(en if language == "en" else zh).format(**x) for needed, en, zh in _SLOTS[x["pipeline"]] if needed(x)]
    if not parts:
        return ""
    return "; ".join(parts) + "." if language == "en" else "；".join(parts) + "。"


def quantitative_log(df: DataFrame, predicted: str, truth: str | None = None, **told) -> dict:
    """The log of a classification: counts, and its quality on the rows that have a truth. At most MOST_LABELS labels."""
    labels = df.where(F.col(predicted).isNotNull()).select(F.col(predicted).cast("string").alias("x")).distinct()
    n_samples, n_classes = df.count(), labels.count()
    log = {"pipeline": "quantitative", "n_samples": n_samples, "n_classes": n_classes, "class_labels": [r["x"] for r in labels.orderBy("x").limit(MOST_LABELS).collect()]}
    if truth is not None:
        margins = agreement.label_margins(agreement.pair_counts(df.where(F.col(truth).isNotNull()), truth, predicted))
        found = agreement.evaluation_summary(agreement.evaluate(margins)).first()
        if found is not None:
            log |= {k: found[k] for k in ("accuracy", "macro_f1", "weighted_f1")}
            log["cohens_kappa"] = agreement.kappa_of(margins).first()["kappa"]
    return log | told


def qualitative_log(coded: DataFrame, item_col: str, theme_col: str, status_col: str | None = None, tiers: DataFrame | None = None, **told) -> dict:
    """The log of a coding (a row for each item and theme; a null theme for items without one): items, themes, what a
    review decided, and tiers (tier, n). At most MOST_LABELS themes."""
    themes = coded.where(F.col(theme_col).isNotNull()).select(F.col(theme_col).cast("string").alias("x")).distinct()
    log = {"pipeline": "qualitative", "n_segments": coded.agg(F.countDistinct(item_col)).first()[0], "n_themes": themes.count()}
    log["theme_names"] = [r["x"] for r in themes.orderBy("x").limit(MOST_LABELS).collect()]
    if status_col is not None:
        known = DEFAULTS["qualitative"]["review_stats"]
        status = F.when(F.col(status_col).isin(*known), F.col(status_col)).otherwise("pending")
        n = {r["s"]: r["n"] for r in coded.where(F.col(theme_col).isNotNull()).groupBy(status.alias("s")).agg(F.count("*").alias("n")).collect()}
        log["review_stats"] = known | n
    if tiers is not None:
        log |= {f"n_{r['tier']}_confidence": r["n"] for r in tiers.where(F.col("tier").isin("high", "medium", "low")).collect()}
    return log | told
