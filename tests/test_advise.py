import pytest

from loomtext.operators import advise, methods, review


def test_curve_fit_recovers():
    points = [(n, 0.1 * n**0.25 + 0.2) for n in (50, 100, 200, 400, 800)]
    a, b, c = advise.fit_curve(points)
    assert all(abs(advise.predict(n, a, b, c) - f) < 2e-3 for n, f in points)
    n = advise.size_for(0.6, a, b, c)
    assert advise.predict(n, a, b, c) >= 0.6 > advise.predict(n - 1, a, b, c)
    assert advise.size_for(2.0, a, b, c) is None
    with pytest.raises(ValueError):
        advise.fit_curve([(10, 0.5)])


def test_smallest_size():
    for a, b, c in ((0.1, 0.25, 0.2), (0.02, 0.5, 0.0), (0.0, 0.5, 0.7), (10.0, 1.0, 0.0), (0.001, 0.9, 0.3), (0.3, 0.01, 0.5)):
        for target in (0.0, 0.3, 0.55, 0.7, 0.8, 0.999, 1.0):
            slow = next((n for n in range(1, 3001) if advise.predict(n, a, b, c) >= target), None)
            assert advise.size_for(target, a, b, c, most=3000) == slow, (a, b, c, target)


def test_priors_fit():
    for points in advise.PRIORS.values():
        a, b, c = advise.fit_curve(points)
        assert all(abs(advise.predict(n, a, b, c) - f) < 0.05 for n, f in points)


def test_replay():
    acts = [("annotate", None, "x", ""), ("goto", 2, None, ""), ("annotate", None, "y", ""), ("undo", None, None, ""), ("undo", None, None, ""), ("skip", None, None, "")]
    items, cursor = review.replay(4, acts)
    assert [i["status"] for i in items] == ["skipped", "pending", "pending", "pending"] and cursor == 1
    assert items[0]["label"] is None
    with pytest.raises(IndexError):
        review.replay(1, [("goto", 5, None, "")])
    with pytest.raises(IndexError):
        review.replay(1, [("skip", None, None, ""), ("skip", None, None, "")])


def test_codebook():
    book = review.Codebook([{"name": "a", "description": "x", "inclusion": ["1"], "exclusion": []}])
    book.add("b", "y", ["2"])
    made = book.merge([0, 1], "ab")
    assert made["inclusion"] == ["1", "2"] and book.lock() == []
    with pytest.raises(ValueError):
        book.add("c")
    book.unlock()
    book.add("ab")
    assert any("twice" in p for p in book.lock()) and not book.locked


def test_methods_text():
    log = {"pipeline": "quantitative", "n_samples": 10, "accuracy": 0.91234}
    assert methods.methods_text(log) == "The corpus comprised 10 texts; accuracy was 0.912."
    assert methods.methods_text({"pipeline": "qualitative", "n_themes": 3}, "zh").endswith("。")
    with pytest.raises(ValueError):
        methods.methods_text({"pipeline": "x"})
