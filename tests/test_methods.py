"""Logs and methods paragraphs: every slot, both languages, defaults."""

import pytest

from loomtext.operators import methods
from loomtext.sources import io

FULL = {
    "quantitative": {
        "n_samples": 5000, "n_classes": 3, "class_labels": ["a", "b", "c", "d", "e", "f"], "classification_method": "few-shot", "model_name": "m1", "model_backend": "srv", "n_annotations": 1200,
        "prompt_optimization_used": True, "n_prompt_variants": 4, "accuracy": 0.9, "macro_f1": 0.8, "weighted_f1": 0.85, "cohens_kappa": 0.7, "icr_kappa": 0.66, "icr_alpha": 0.65,
    },
    "qualitative": {
        "n_segments": 2000, "n_themes": 2, "theme_names": ["x", "y"], "research_questions": ["q1", "q2"], "deidentification_performed": True, "n_pii_detected": 31, "consensus_coding_used": True, "n_consensus_models": 2,
        "consensus_model_names": ["m1", "m2"], "consensus_agreement": 0.81, "n_high_confidence": 5, "n_medium_confidence": 6, "n_low_confidence": 7,
        "review_stats": {"accepted": 8, "rejected": 9, "edited": 10}, "icr_jaccard": 0.5, "icr_per_theme_kappa": 0.4,
    },
}


@pytest.mark.parametrize("language", ["en", "zh"])
def test_all_slots(language):
    text = methods.methods_text({"pipeline": "quantitative", **FULL["quantitative"]}, language)
    for part in ("5,000", "3", "a", "e…", "m1", "srv", "1,200", "4", "0.900", "0.800", "0.850", "0.700", "0.660", "0.650"):
        assert part in text, part
    assert "f)" not in text and "f）" not in text
    text = methods.methods_text({"pipeline": "qualitative", **FULL["qualitative"]}, language)
    for part in ("2,000", "31", "2", "x", "y", "m1", "m2", "0.810", "5", "6", "7", "8", "9", "10", "0.500", "0.400"):
        assert part in text, part


def test_branches():
    say = lambda **x: methods.methods_text({"pipeline": x.pop("pipeline", "quantitative"), **x})
    kinds = {say(classification_method=m, model_name="m") for m in ("zero-shot", "few-shot", "fine-tune-local", "fine-tune-api", "")}
    assert len(kinds) == 5 and all("m" in k for k in kinds)
    assert say(classification_method="zero-shot").count("a language model") == 1
    assert say(prompt_optimization_used=True) != say(prompt_optimization_used=True, n_prompt_variants=3)
    q = lambda **x: say(pipeline="qualitative", **x)
    assert "replaced" in q(deidentification_performed=True) and "31" in q(deidentification_performed=True, n_pii_detected=31)
    assert q(consensus_coding_used=True, n_consensus_models=3).startswith("3 models")
    assert "m (srv)" in q(coding_model_name="m", coding_model_backend="srv", consensus_coding_used=True, n_consensus_models=1)
    assert q(review_stats={"edited": 1}) and not q(review_stats={"pending": 4}) and not q(accuracy=None)
    for wrong in (lambda: methods.methods_text({"pipeline": "x"}), lambda: methods.methods_text({"pipeline": "qualitative"}, "fr")):
        with pytest.raises(ValueError):
            wrong()


def test_logs(spark, tmp_path):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), (None, "b"), ("a", None)], "truth string, p string")
    log = methods.quantitative_log(df, "p", "truth", model_name="m")
    assert (log["n_samples"], log["n_classes"], log["class_labels"], log["model_name"]) == (6, 2, ["a", "b"], "m") and log["accuracy"] == 0.6
    io.save_log(spark, log, str(tmp_path / "log"))
    assert "accuracy was 0.600" in methods.methods_text(io.load_log(spark, str(tmp_path / "log")))
    assert methods.quantitative_log(df.limit(0), "p", "truth")["n_samples"] == 0
    coded = spark.createDataFrame([(1, "x", "accepted"), (1, "y", "edited"), (2, "x", "odd"), (3, None, None)], "item long, theme string, status string")
    tiers = spark.createDataFrame([("high", 2), ("low", 1), ("other", 5)], "tier string, n long")
    log = methods.qualitative_log(coded, "item", "theme", "status", tiers)
    assert log["n_segments"] == 3 and log["theme_names"] == ["x", "y"] and log["review_stats"] == {"accepted": 1, "rejected": 0, "edited": 1, "pending": 1}
    assert methods.completed(log)["n_medium_confidence"] == 0 and (log["n_high_confidence"], log["n_low_confidence"]) == (2, 1)
