import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexspark.errors import InvalidRequestError
from lexspark.functions import blockwords, hangul, ko_chunk, ko_phrases, ko_text, ko_tokenize, requests, scripts, search
from lexspark.functions.ko_chunk import Token
from lexspark.functions.ko_lexicon import sample_lexicon
from lexspark.operators import language, redaction
from lexspark.options import MAX_TEXT_LENGTH, Severity
from lexspark.sources import dictionaries
from lexspark.streaming import scanner

LEX = sample_lexicon()


@settings(max_examples=200, deadline=None)
@given(st.characters(min_codepoint=0xAC00, max_codepoint=0xD7A3))
def test_hangul_round_trip(c):
    assert hangul.compose(*hangul.decompose(c)) == c
    assert hangul.has_coda(c) == (hangul.decompose(c)[2] != " ")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="가각ㅋ ab1$#@.,\n\t漢http://co", max_size=40))
def test_chunks_join_to_the_text(text):
    chunks = ko_chunk.chunk(text)
    assert "".join(c.text for c in chunks) == text
    assert all(text[c.offset : c.offset + c.length] == c.text for c in chunks)


def test_line_breaks_are_foreign():
    assert [c.pos for c in ko_chunk.chunk("가\n나 다")] == ["Korean", "Foreign", "Korean", "Space", "Korean"]


def test_stems_and_phrases():
    merged = ko_tokenize.stem([Token("아", "Exclamation", 0, 1), Token("이럴", "Adjective", 1, 2), Token("수", "PreEomi", 3, 1), Token("가", "Eomi", 4, 1)], LEX)
    assert [(t.text, t.pos, t.length, t.stem) for t in merged] == [("아", "Exclamation", 1, None), ("이럴수가", "Adjective", 4, "이렇다")]
    n = lambda i: Token("N", "Noun", i, 1)
    assert [p.pos for p in ko_phrases.collapse([n(0), n(1)])] == ["Noun", "Noun"]
    assert [(p.text, p.pos) for p in ko_phrases.collapse([Token("X", "KoreanParticle", 0, 1), Token("m", "Modifier", 1, 1), n(2)])] == [("X", "KoreanParticle"), ("mN", "Noun")]
    assert all(len(a) == 1 for a in ko_tokenize.tokenize_top("뀨뀨뀨", LEX, 1))
    with pytest.raises(InvalidRequestError):
        ko_tokenize.tokenize_top("가", LEX, 0)
    with pytest.raises(InvalidRequestError) as e:
        ko_tokenize.tokenize("비밀" * MAX_TEXT_LENGTH, LEX)
    assert "비밀" not in str(e.value)


def test_blockword_tiers():
    tiers = blockwords.Tiers({"low": Severity.LOW, "mid": Severity.MIDDLE, "high": Severity.HIGH})
    assert [len(tiers.at(s)) for s in Severity] == [3, 2, 1]
    assert len(tiers.add(["x"], Severity.HIGH).remove(["low"]).at(Severity.LOW)) == 3


def test_sentences_keep_inner_marks():
    assert [s[0] for s in ko_text.sentences("3.14는 수. 끝!")] == ["3.14는 수.", "끝!"]


def test_redaction():
    policy = redaction.Policy([redaction.Rule("a", "x", pattern="abc"), redaction.Rule("b", "y", pattern="cd", priority=1), redaction.Rule("c", "z", keyword="EF")])
    text, spans = redaction.Redactor(policy).redact("abcdef-abc")
    assert text == "******-***"
    assert spans == [(0, 4, "y", ["b", "a"]), (4, 6, "z", ["c"]), (7, 10, "x", ["a"])]
    for bad in ({"id": "A", "category": "x", "pattern": "a"}, {"id": "a", "category": "x"}, {"id": "a", "category": "x", "pattern": "("}, {"id": "a", "category": "x", "pattern": "a", "priority": 0}):
        with pytest.raises(InvalidRequestError) as e:
            redaction.Rule(**bad)
        assert "(" not in str(e.value).replace("(?", "")
    with pytest.raises(InvalidRequestError):
        redaction.Redactor(redaction.default_policy(max_length=3)).redact("abcd")


def test_language_rules(spark):
    sample = spark.createDataFrame([("the house and the garden", "en"), ("la maison et le jardin", "fr"), (None, "en"), ("", "fr")], "text string, lang string")
    model = language.local_model(language.train(sample, least=1))
    assert model.detect("the garden") == "ENGLISH" and model.detect("la maison") == "FRENCH" and model.detect("ᚠᚢᚦ") == "UNKNOWN"
    assert language.detect_token("x", model) is None
    assert language.segments("ᚠᚢᚦ", model, 0.0) == [(0, 3, "UNKNOWN", 0.0)] and language.segments("ᚠᚢᚦ", model, 1.0) == []
    assert [s[:3] for s in language.segments("안녕漢字", model)] == [(0, 2, "KOREAN"), (2, 4, "CHINESE")]
    assert abs(sum(model.confidences("the garden").values()) - 1) < 1e-9
    assert language.languages(["en", "fra"], without=["en"]) == ["FRENCH"]
    with pytest.raises(InvalidRequestError):
        language.segments("a", model, 2)


def test_scripts(spark):
    df = spark.createDataFrame([("ab가カ漢ไ", 1)], "text string, n int")
    row = df.select(*(scripts.count_script(F.col("text"), s).alias(s) for s in scripts.RANGES), scripts.filter_locale(F.col("text"), "xx").alias("other")).first()
    assert (row.ascii, row.korean, row.japanese, row.chinese, row.thai, row.other) == (2, 1, 1, 1, 1, "ab")


def test_requests(spark):
    rows = spark.createDataFrame([("x" * 11,), ("  ",), (None,), ("ok",)], "text string").select(requests.status(F.col("text"), 10).alias("s")).collect()
    assert [r.s for r in rows] == [413, 400, 400, 200]


def test_dictionary_files(spark, tmp_path):
    import gzip

    (tmp_path / "a.txt").write_text(" one \ntwo\n\none\n", encoding="utf-8")
    with gzip.open(tmp_path / "f.tsv.gz", "wt", encoding="utf-8") as f:
        f.write("사랑\t0.123456789\nno tab\n")
    (tmp_path / "m.txt").write_text("하겟 하겠\nalone\n", encoding="utf-8")
    assert dictionaries.read_lines(spark, f"{tmp_path}/a.txt").count() == 4
    assert sorted(r.word for r in dictionaries.read_words(spark, f"{tmp_path}/a.txt").collect()) == ["one", "two"]
    assert [(r.word, round(r.freq, 4)) for r in dictionaries.read_frequencies(spark, f"{tmp_path}/f.tsv.gz").collect()] == [("사랑", 0.1234)]
    assert [tuple(r) for r in dictionaries.typo_table(dictionaries.read_map(spark, f"{tmp_path}/m.txt")).collect()] == [(2, "하겟", "하겠")]


def test_versions(spark, tmp_path):
    table = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    v = dictionaries.VersionedDictionary(spark, str(tmp_path), "d")
    v.reload("d", 1, lambda: table("legacy-word"))
    before = v.snapshot()
    v.reload("d", 2, lambda: table("legacy-word", "fresh-word"))

    def fails():
        raise RuntimeError("no file")

    with pytest.raises(RuntimeError):
        v.reload("d", 3, fails)
    assert v.revision == 2 and v.snapshot().count() == 2 and before.count() == 1
    for name, revision in (("other", 9), ("d", 2)):
        with pytest.raises(InvalidRequestError):
            v.reload(name, revision, lambda: table("x"))
    assert v.rollback().count() == 1
    with pytest.raises(InvalidRequestError):
        v.rollback()


def test_scan_stream(spark, tmp_path):
    from lexspark.operators.matching import dictionary

    schema = "stream_id string, seq int, chunk string, is_last boolean"
    own = dictionary(["secret", "and"])
    for n, rows in enumerate(([("a", 0, "se", False), ("b", 0, "x and", False)], [("a", 1, "cr", False)], [("a", 2, "et and", True), ("b", 1, "", True)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(f"{tmp_path}/in")
    out = scanner.scan_stream(stream, own).writeStream.format("memory").queryName("found").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    out.awaitTermination(120)
    got = sorted((r.stream_id, r.start, r.keyword) for r in spark.table("found").collect())
    assert got == [("a", 0, "secret"), ("a", 7, "and"), ("b", 2, "and")]


def test_masks_keep_the_length(spark):
    df = spark.createDataFrame([("the Apple and an apple",), ("",)], "text string")
    from lexspark.options import SearchOptions

    rows = df.select(search.mask_matches(F.col("text"), ["apple"], "*", SearchOptions(ignore_case=True)).alias("m")).collect()
    assert [r.m for r in rows] == ["the ***** and an *****", ""]


def test_scores_by_rows_and_by_joins_agree(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, "", "de"), (4, None, "en"), (5, "##", "en"), (6, "the Hund 🔥 and", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, least=1)
    some = lambda df: {(r.doc_id, r.lang): (round(r.score, 9), round(r.confidence, 9)) for r in df.collect()}
    assert some(language.scores(docs, model)) == some(language._joined_scores(docs, model, "doc_id", "text", 3, -12.0))
    assert {r.doc_id: r.detected for r in language.detect(docs, model).collect()} == {1: "en", 2: "de", 3: "UNKNOWN", 4: "UNKNOWN", 5: "UNKNOWN", 6: "de"} | {6: language.detect(docs, model).where("doc_id = 6").first().detected}
