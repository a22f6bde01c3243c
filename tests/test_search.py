import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexspark.errors import InvalidRequestError
from lexspark.functions import automaton as engine
from lexspark.functions.automaton import Dictionary, Machine
from lexspark.functions.offsets import utf16_length
from lexspark.operators import matching
from lexspark.options import Normalization, SearchOptions, WordBoundary
from lexspark.streaming.scanner import chunked, chunks, scan_chunks, scan_table

TEXT = st.text(alphabet="abcAB é", max_size=40)
KEYS = st.sets(st.text(alphabet="abc", min_size=1, max_size=4), min_size=1, max_size=8)


def naive(keys, text):
    return sorted((i, i + len(k) - 1, k) for k in keys for i in range(len(text)) if text.startswith(k, i))


@settings(max_examples=200, deadline=None)
@given(KEYS, TEXT)
def test_all_matches(keys, text):
    assert sorted(m[:3] for m in engine.parse(Dictionary(keys), text)) == naive(keys, text)
    assert list(Machine(keys).run(text)) == sorted((e, k) for _, e, k in naive(keys, text))


@settings(max_examples=400, deadline=None)
@given(KEYS, TEXT, st.lists(st.integers(0, 40), max_size=5), st.booleans(), st.booleans(), st.sampled_from(list(WordBoundary)))
def test_scanner_equals_parse(keys, text, cuts, overlaps, ignore_case, boundary):
    d = Dictionary(keys, SearchOptions(allow_overlaps=overlaps, ignore_case=ignore_case, boundary=boundary))
    scanner, out, last = engine.Scanner(d), [], 0
    for c in sorted(c for c in cuts if c < len(text)):
        out += scanner.scan(text[last:c])
        last = c
    out += scanner.scan(text[last:]) + scanner.finish()
    assert sorted(out) == sorted(engine.parse(d, text))
    assert engine.parse_rows(d, text) == [m[:3] for m in engine.parse(d, text)]


def test_scanner_decides_clusters_whole():
    d = Dictionary({"a", "aa"}, SearchOptions(allow_overlaps=False))
    s = engine.Scanner(d)
    assert sorted(s.scan("aaAAAAAa") + s.finish()) == sorted(engine.parse(d, "aaAAAAAa"))
    d = Dictionary({"run"}, SearchOptions(boundary=WordBoundary.WHITESPACE_SEPARATED))
    s = engine.Scanner(d)
    assert s.scan("xrun aaa") + s.scan(" b") + s.finish() == []
    s = engine.Scanner(Dictionary({"a"}, SearchOptions(stop_on_first=True)))
    assert [m.start for m in s.scan("a a") + s.finish()] == [0, 2]


def test_refused_texts_are_null(spark):
    rows = spark.createDataFrame([(1, "e" + "́" * 2000), (2, "é"), (3, None)], "id int, text string")
    own = matching.dictionary(["é"], SearchOptions(normalization=Normalization.NFC))
    got = {r.id: r.m for r in rows.select("id", matching.parse(rows["text"], own).alias("m")).collect()}
    assert got[1] is None and got[3] is None and [m.start for m in got[2]] == [0]


def test_chunk_tables_and_arrays_agree(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(i, "".join(rng.choices("ab\n ", k=rng.randrange(60)))) for i in range(30)] + [(99, None)], "doc_id long, text string")
    own = matching.dictionary(["ab", "aba", "b"], SearchOptions(allow_overlaps=False))
    table = {(int(r.stream_id), r.start, r.end, r.keyword) for r in scan_table(chunked(rows, 7), own).collect()}
    arrays = rows.select("doc_id", F.explode(scan_chunks(chunks(F.col("text"), 7), own)).alias("m")).select("doc_id", "m.*")
    assert table == {(r.doc_id, r.start, r.end, r.keyword) for r in arrays.collect()} and table


@settings(max_examples=200, deadline=None)
@given(KEYS, TEXT)
def test_tokens_join_to_the_text(keys, text):
    d = Dictionary(keys)
    assert "".join(t for _, t, _ in engine.tokenize(d, text)) == text
    assert engine.replace_all(d, text, lambda m: m.keyword) == text


def test_goldens():
    found = lambda keys, text, **o: [(m.keyword, m.start, m.end) for m in engine.parse(Dictionary(keys, SearchOptions(**o)), text)]
    assert found(["he", "she", "his", "hers"], "ushers") == [("she", 1, 3), ("hers", 2, 5), ("he", 2, 3)]
    assert found(["a", "ab"], "ab") == [("ab", 0, 1), ("a", 0, 0)]
    assert found(["a", "ba"], "ba", stop_on_first=True) == [("a", 1, 1)]
    assert found(["hot", "hotel"], "hotel", allow_overlaps=False) == [("hotel", 0, 4)]
    assert found(["ab", "bcd"], "abcd", allow_overlaps=False) == [("bcd", 1, 3)]
    assert found(["apple"], "pineapple", boundary=WordBoundary.LATIN_ALPHA) == []
    assert found(["apple"], "eat apple now", boundary=WordBoundary.LATIN_ALPHA) == [("apple", 4, 8)]
    assert found(["apple"], "apple가", boundary=WordBoundary.LATIN_ALPHA) == []
    assert found(["run"], "running fast", boundary=WordBoundary.WHITESPACE_SEPARATED) == []
    first = engine.first(Dictionary(["run"], SearchOptions(boundary=WordBoundary.WHITESPACE_SEPARATED, stop_on_first=True)), "running run")
    assert first.start == 8
    assert [m[1:] for m in found(["İ", "ΟΣ", "ПРИВЕТ"], "İ ΟΣ ПРИВЕТ", ignore_case=True)] == [(0, 0), (2, 3), (5, 10)]
    assert [t[:2] for t in engine.tokenize(Dictionary(["foo", "bar"]), "prefix foo middle bar suffix")] == [("FRAGMENT", "prefix "), ("MATCH", "foo"), ("FRAGMENT", " middle "), ("MATCH", "bar"), ("FRAGMENT", " suffix")]
    assert engine.replace_all(Dictionary(["ab", "bcd"]), "abcd", lambda m: "X") == "Xcd"
    assert engine.replace_all(Dictionary(["ab", "bcd"], SearchOptions(allow_overlaps=False)), "abcd", lambda m: "X") == "aX"
    assert utf16_length("🔥Hello") == 7


def test_normalization():
    nfc = Dictionary(["é"], SearchOptions(normalization=Normalization.NFC))
    assert engine.parse(nfc, "xéy")[0][:2] == (1, 2)
    nfkc = Dictionary(["ABC"], SearchOptions(normalization=Normalization.NFKC))
    assert engine.parse(nfkc, "ＡＢＣ")[0][:2] == (0, 2)
    with pytest.raises(InvalidRequestError):
        engine.parse(nfc, "e" + "́" * 2000)


@pytest.mark.parametrize("keys, options", [({"A", "a"}, {"ignore_case": True}), ({"é", "é"}, {"normalization": Normalization.NFC}), ({"Ａ", "A"}, {"normalization": Normalization.NFKC}), ({" "}, {})])
def test_refused_dictionaries(keys, options):
    with pytest.raises(InvalidRequestError):
        Dictionary(keys, SearchOptions(**options))


def test_scanner_order_and_reset():
    s = engine.Scanner(Dictionary(["a", "ba"]))
    assert [(m.keyword, m.start) for m in s.scan("ba") + s.finish()] == [("a", 1), ("ba", 0)]
    s = engine.Scanner(Dictionary(["secret", "and"]))
    assert [(m.keyword, m.start, m.end) for c in ("se", "cr", "et and") for m in s.scan(c)] + [(m.keyword, m.start, m.end) for m in s.finish()] == [("secret", 0, 5), ("and", 7, 9)]
    with pytest.raises(InvalidRequestError):
        engine.Scanner(Dictionary(["a"], SearchOptions(normalization=Normalization.NFC)))


def test_native_matches_overlap(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices("abc", k=30))) for i in range(40)] + [(99, ""), (100, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keys = ["ab", "bca", "a", "cc"]
    want = sorted((i, *m) for i, t in rows if t for m in naive(keys, t))
    assert sorted(map(tuple, matching.native_matches(df, keys).collect())) == want
    assert sorted(tuple(r)[:4] for r in matching.matches(df, matching.dictionary(keys)).collect()) == want
