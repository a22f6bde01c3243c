"""Veiled addresses are proposed by their own pattern alone."""

from lexspark.llm import pii


def test_every_match_of_the_pattern_is_proposed():
    for text in ("write to jane at example.com", "write to jane AT example.com", "jane(at)example.com", "jane {at} example dot org", "jane[at]example.com"):
        m = pii._VEILED.search(text)
        assert (m.start(), m.end(), 0) in pii.candidates(text, []), text


def test_plain_at_is_found_as_with_dot_elsewhere():
    model = pii.trained()
    wanted = pii.find_spans(["a dot here. write to jane at example.com"], model)[0][1]
    got = pii.find_spans(["write to jane at example.com"], model)[0][1]
    assert [(s + 12, e + 12, k) for s, e, k in got] == wanted
