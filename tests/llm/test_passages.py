"""Passages are counted at any probability."""

from lexspark.llm import toxicity


def test_weak_passages_are_counted():
    model = toxicity.Toxicity({"bad": 1.0}, scale=10.0, k=0.1, weights=(-9.0, 0.1, 0.1))
    text = "bad " + "fine " * 30
    p, n = model.judged(text)
    assert p <= 0.05 and n == sum(x > 0 for x in model.evidence(text)[1]) == 1
    assert p == model.probability(text)
