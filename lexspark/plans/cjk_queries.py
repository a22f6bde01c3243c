"""Queries over a few Korean and Japanese texts (the test tables have none), against expected rows as SQL values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import blockwords, hangul, ja_segment, ko_text
from ..functions.ko_lexicon import sample_lexicon
from ..operators import cjk, language, redaction
from ..options import BlockwordOptions, Severity
from .queries import query


def _quote(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else str(v)


def _expect(columns: str, rows: Sequence[tuple]) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_quote, r)) + ')' for r in rows)}) v({columns})"


def _texts(spark, *texts: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t in texts], "text string")


def _joined(tokens: str, *fields: str):
    """Tokens as one string: fields by '/', tokens by a space."""
    return F.array_join(F.transform(tokens, lambda t: F.concat_ws("/", *(t[f].cast("string") for f in fields))), " ")


def case(name: str, columns: str, rows: Sequence[tuple]):
    """Registers f(spark) -> DataFrame with the expected rows."""

    def add(f):
        query(name, _expect(columns, rows))(lambda spark, _: f(spark))
        return f

    return add


@case("ko_decompose", "text, parts", [("한글a", "ㅎㅏㄴ|ㄱㅡㄹ|a  "), ("뷁", "ㅂㅞㄺ")])
def _(spark):
    parts = F.transform(hangul.decompose_column(F.col("text")), lambda p: F.concat(p["onset"], p["vowel"], p["coda"]))
    return _texts(spark, "한글a", "뷁").select("text", F.array_join(parts, "|").alias("parts"))


@case("ko_compose", "text, again", [("한글 뷁힣가a", "한글 뷁힣가a"), ("각", "각")])
def _(spark):
    return _texts(spark, "한글 뷁힣가a", "각").select("text", hangul.compose_column(hangul.decompose_column(F.col("text"))).alias("again"))


@case("ko_has_coda", "text, coda", [("가", False), ("각", True), ("a", False), ("힣", True)])
def _(spark):
    return _texts(spark, "가", "각", "a", "힣").select("text", hangul.has_coda_column(F.col("text")).alias("coda"))


_CHUNKS = [
    ("안녕ㅋㅋ hi!", "안녕/Korean/0 ㅋㅋ/KoreanParticle/2  /Space/4 hi/Alpha/5 !/Punctuation/7"),
    ("http://a.com/b #태그 $ABC 3,000원 @me", "http://a.com/b/URL/0  /Space/14 #태그/Hashtag/15  /Space/18 $ABC/CashTag/19  /Space/23 3,000원/Number/24  /Space/30 @me/ScreenName/31"),
]


@case("ko_chunk", "text, chunks", _CHUNKS)
def _(spark):
    return _texts(spark, *(t for t, _ in _CHUNKS)).select("text", _joined(cjk.ko_chunks(F.col("text")), "text", "pos", "offset").alias("chunks"))


_NORMAL = [
    ("땡큐우우우우우", "땡큐우우우"), ("훌쩍훌쩍훌쩍훌쩍훌쩍훌쩍", "훌쩍훌쩍"), ("ㅋㅋㅎㅋㅋㅎㅋㅋㅎㅋㅋㅎㅋㅋㅎㅋㅋㅎ", "ㅋㅋㅎㅋㅋㅎ"),
    ("http://11111.cccccom soooooooo !!!!!!!!!!!!!!!", "http://11111.cccccom soooooooo !!!!!!!!!!!!!!!"), ("소린가", "소리인가"), ("하겟다", "하겠다"),
]


@case("ko_normalize", "text, normal", _NORMAL)
def _(spark):
    return _texts(spark, *(t for t, _ in _NORMAL)).select("text", cjk.ko_normalize(F.col("text"), sample_lexicon()).alias("normal"))


@case("ko_normalize_repeats", "text, normal", _NORMAL[:3])
def _(spark):
    return _texts(spark, *(t for t, _ in _NORMAL[:3])).select("text", ko_text.repeats_column(F.col("text")).alias("normal"))


@case("ko_correct_typo", "text, fixed", [("하겟다", "하겠다"), ("됬다 왠일", "됐다 웬일")])
def _(spark):
    return _texts(spark, "하겟다", "됬다 왠일").select("text", ko_text.typo_column(F.col("text"), {"하겟": "하겠", "됬": "됐", "왠일": "웬일"}).alias("fixed"))


@case("ko_coda_n", "text, fixed", [("소린가", "소리인가"), ("사랑은", "사랑은")])
def _(spark):
    from pyarrow import string

    lex = sample_lexicon()
    return _texts(spark, "소린가", "사랑은").select("text", cjk.per_text(F.col("text"), "string", string(), lambda t: ko_text.coda_n(t, lex)).alias("fixed"))


@case("ko_sentences", "text, sentences", [("안녕? iphone6안녕? 세상아?", "안녕?/0/3 iphone6안녕?/4/14 세상아?/15/19")])
def _(spark):
    return _texts(spark, "안녕? iphone6안녕? 세상아?").select("text", _joined(cjk.ko_sentences(F.col("text")), "text", "start", "end").alias("sentences"))


@case("ko_sentences_native", "text, sentences", [("안녕? iphone6안녕? 세상아?", "안녕?|iphone6안녕?|세상아?"), ("3.14는 수. 끝", "3.14는 수.|끝")])
def _(spark):
    return _texts(spark, "안녕? iphone6안녕? 세상아?", "3.14는 수. 끝").select("text", F.array_join(ko_text.sentence_column(F.col("text")), "|").alias("sentences"))


_TOKENS = [
    ("사랑해", "사랑/Noun/0 해/Verb/2/하다"), ("이사람의", "이/Determiner/0 사람/Noun/1 의/Josa/3"), ("쵸귀여운", "쵸/VerbPrefix/0 귀여운/Adjective/1/귀엽다"),
    ("안녕ㅋㅋ", "안녕/Noun/0 ㅋㅋ/KoreanParticle/2"), ("한국어를 공부하는 사람", "한국어/Noun/0 를/Josa/3  /Space/4 공부/Noun/5 하는/Verb/7/하다  /Space/9 사람/Noun/10"),
]


@case("ko_tokenize", "text, tokens", _TOKENS)
def _(spark):
    return _texts(spark, *(t for t, _ in _TOKENS)).select("text", _joined(cjk.ko_tokens(F.col("text"), sample_lexicon()), "text", "pos", "offset", "stem").alias("tokens"))


@case("ko_tokens_to_strings", "text, words", [("한국어를 공부하는 사람", "한국어,를,공부,하는,사람")])
def _(spark):
    return _texts(spark, "한국어를 공부하는 사람").select("text", F.array_join(cjk.token_texts(cjk.ko_tokens(F.col("text"), sample_lexicon())), ",").alias("words"))


@case("ko_tokenize_topn", "text, chunks, best", [("대선 후보", 3, "대선")])
def _(spark):
    top = cjk.ko_top_tokens(F.col("text"), sample_lexicon(), 3)
    return _texts(spark, "대선 후보").select("text", top.alias("t")).select("text", F.size("t").alias("chunks"), F.col("t")[0][0][0]["text"].alias("best"))


@case("ko_tokenize_noun", "text, tokens", [("사랑사람", "사랑/Noun 사람/Noun"), ("그리고", "그리고/Conjunction")])
def _(spark):
    return _texts(spark, "사랑사람", "그리고").select("text", _joined(cjk.ko_tokens(F.col("text"), sample_lexicon(), nouns=True), "text", "pos").alias("tokens"))


@case("ko_stem", "text, stems", [("나오는", "나오다"), ("귀여운", "귀엽다"), ("몰라", "모르다")])
def _(spark):
    stems = F.filter(F.transform(cjk.ko_tokens(F.col("text"), sample_lexicon()), lambda t: t["stem"]), lambda s: s.isNotNull())
    return _texts(spark, "나오는", "귀여운", "몰라").select("text", F.array_join(stems, ",").alias("stems"))


@case("ko_conjugate", "stem, form, found", [("귀엽", "귀여운", True), ("귀엽", "귀여워", True), ("고르", "골라", True), ("만들", "만든", True), ("먹", "먹는", True), ("먹", "먹운", False)])
def _(spark):
    asked = spark.createDataFrame([("귀엽", "귀여운", True), ("귀엽", "귀여워", True), ("고르", "골라", False), ("만들", "만든", False), ("먹", "먹는", False), ("먹", "먹운", False)], "stem string, form string, adjective boolean")
    forms = F.when(F.col("adjective"), cjk.ko_forms(F.col("stem"), True)).otherwise(cjk.ko_forms(F.col("stem")))
    return asked.select("stem", "form", F.array_contains(forms, F.col("form")).alias("found"))


@case("ko_phrases", "text, phrases", [("트위터 25.2% 상승.", "트위터/0/3,트위터 25.2%/0/9,트위터 25.2% 상승/0/12,25.2%/4/5,상승/10/2")])
def _(spark):
    p = cjk.ko_phrases_column(F.col("text"), sample_lexicon())
    return _texts(spark, "트위터 25.2% 상승.").select("text", F.array_join(F.transform(p, lambda x: F.concat_ws("/", x["text"], x["offset"].cast("string"), x["length"].cast("string"))), ",").alias("phrases"))


@case("ko_phrases_noun", "text, phrases", [("개인소비", "개인소비,개인,소비"), ("학교에서 음악", "학교,음악")])
def _(spark):
    p = cjk.ko_phrases_column(F.col("text"), sample_lexicon(), nouns=True)
    return _texts(spark, "개인소비", "학교에서 음악").select("text", F.array_join(F.transform(p, lambda x: x["text"]), ",").alias("phrases"))


@case("ko_detokenize", "words, text", [("와 !!! iPhone 6+ 가 , 드디어 나왔다 !", "와!!! iPhone 6+가, 드디어 나왔다!"), ("사람 의 마음", "사람의 마음")])
def _(spark):
    words = F.split("words", " ")
    return _texts(spark, "와 !!! iPhone 6+ 가 , 드디어 나왔다 !", "사람 의 마음").select(F.col("text").alias("words")).select("words", cjk.ko_detokenize(words, sample_lexicon()).alias("text"))


@case("ko_remove_punct", "text, clean", [("안녕? ! 잘가", "안녕? ! 잘가"), ("바.보", "바보"), ("뭐 ~ . ~ 했니", "뭐했니"), ("끝. 시작", "끝. 시작")])
def _(spark):
    return _texts(spark, "안녕? ! 잘가", "바.보", "뭐 ~ . ~ 했니", "끝. 시작").select("text", cjk.ko_remove_punctuation(F.col("text")).alias("clean"))


@case("ko_find_punct", "text, n", [("뭐 ~ . ~ 했니", 7), ("바.보", 1)])
def _(spark):
    return _texts(spark, "뭐 ~ . ~ 했니", "바.보").select("text", F.size(F.filter(cjk.ko_punctuation(F.col("text")), lambda c: c["gone"])).alias("n"))


_TIERS = blockwords.Tiers({"바보": Severity.LOW, "멍청이": Severity.HIGH, "馬鹿": Severity.LOW, "馬鹿野郎": Severity.HIGH})


@case("ko_block_mask", "text, masked, words", [("바.보 멍청이", "** ***", "멍청이,바보"), ("바보의 나라", "**의 나라", "바보"), ("사랑", "사랑", "")])
def _(spark):
    return _texts(spark, "바.보 멍청이", "바보의 나라", "사랑").select("text", cjk.ko_mask(F.col("text"), sample_lexicon(), _TIERS).alias("m")).select("text", "m.masked", F.array_join("m.blockwords", ",").alias("words"))


@case("ko_block_severity", "threshold, masked", [("LOW", "** ***"), ("MIDDLE", "바보 ***"), ("HIGH", "바보 ***")])
def _(spark):
    one = lambda s: _texts(spark, "바보 멍청이").select(F.lit(s.value).alias("threshold"), cjk.ko_mask(F.col("text"), sample_lexicon(), _TIERS, BlockwordOptions(severity=s))["masked"].alias("masked"))
    return one(Severity.LOW).unionAll(one(Severity.MIDDLE)).unionAll(one(Severity.HIGH))


@case("ko_block_find", "text, word, place", [("멍청이와 바.보", "멍청이", 0), ("멍청이와 바.보", "바보", 5)])
def _(spark):
    found = cjk.ko_blockwords(F.col("text"), sample_lexicon(), _TIERS)
    return _texts(spark, "멍청이와 바.보").select("text", F.explode(found).alias("t")).select("text", F.col("t.text").alias("word"), F.col("t.offset").alias("place"))


@case("ko_dict_mutate", "text, before, after, gone", [("테스형", True, False, True)])
def _(spark):
    lex = sample_lexicon()
    added = lex.with_nouns("테스형")
    unknown = lambda x: cjk.ko_tokens(F.col("text"), x)[0]["unknown"]
    return _texts(spark, "테스형").select("text", unknown(lex).alias("before"), unknown(added).alias("after"), unknown(added.without_nouns("테스형")).alias("gone"))


@case("ko_names", "word, name, number, variation", [("김민수", True, False, True), ("우혀니", False, False, True), ("삼백", False, True, False), ("홍길동", True, False, True)])
def _(spark):
    return _texts(spark, "김민수", "우혀니", "삼백", "홍길동").select(F.col("text").alias("word"), cjk.ko_word_kinds(F.col("text"), sample_lexicon()).alias("k")).select("word", "k.*")


@case("ko_josa_attachable", "noun, josa, fits", [("사람", "은", True), ("사람", "는", False), ("나라", "는", True), ("나라", "은", False)])
def _(spark):
    asked = spark.createDataFrame([("사람", "은"), ("사람", "는"), ("나라", "는"), ("나라", "은")], "noun string, josa string")
    return asked.select("noun", "josa", cjk.ko_josa_fits(F.col("noun"), F.col("josa")).alias("fits"))


_JA = "私は、日本語の勉強をしています。"


@case("ja_tokenize", "text, tokens", [(_JA, "私/名詞/0 は/助詞/1 、/記号/2 日本語/名詞/3 の/助詞/6 勉強/名詞/7 を/助詞/9 し/動詞/10 て/助詞/11 い/動詞/12 ます/助動詞/13 。/記号/15")])
def _(spark):
    return _texts(spark, _JA).select("text", _joined(cjk.ja_tokens(F.col("text"), ja_segment.SAMPLE), "surface", "pos", "position").alias("tokens"))


@case("ja_filter_noun", "text, nouns", [(_JA, "私,日本語,勉強")])
def _(spark):
    nouns = F.filter(cjk.ja_tokens(F.col("text"), ja_segment.SAMPLE), lambda t: t["pos"] == ja_segment.NOUN)
    return _texts(spark, _JA).select("text", F.array_join(F.transform(nouns, lambda t: t["surface"]), ",").alias("nouns"))


@case("ja_block_mask", "text, masked, words", [("馬鹿野郎、猫の馬鹿", "****、猫の**", "馬鹿野郎,馬鹿"), ("猫", "猫", "")])
def _(spark):
    m = cjk.ja_mask(F.col("text"), ja_segment.SAMPLE, _TIERS, BlockwordOptions(locale="ja"))
    return _texts(spark, "馬鹿野郎、猫の馬鹿", "猫").select("text", m.alias("m")).select("text", "m.masked", F.array_join("m.blockwords", ",").alias("words"))


_MIXED = "Hello 안녕하세요 こんにちは 漢字"


@case("lang_segments", "text, segments", [(_MIXED, "0/5/ENGLISH 6/11/KOREAN 12/17/JAPANESE 18/20/CHINESE")])
def _(spark):
    sample = spark.createDataFrame([("hello hello hello world", "en"), ("bonjour bonjour le monde", "fr")], "text string, lang string")
    model = language.local_model(language.train(sample, least=1))
    return _texts(spark, _MIXED).select("text", _joined(language.segment_column(F.col("text"), model), "start", "end_exclusive", "language").alias("segments"))


@case("lang_detect_all", "text, languages", [("Hello world. 안녕! bonjour le monde", "ENGLISH,KOREAN,FRENCH"), (" ", "")])
def _(spark):
    sample = spark.createDataFrame([("hello hello hello world", "en"), ("bonjour bonjour le monde", "fr")], "text string, lang string")
    model = language.local_model(language.train(sample, least=1))
    return _texts(spark, "Hello world. 안녕! bonjour le monde", " ").select("text", F.array_join(language.languages_column(F.col("text"), model), ",").alias("languages"))


@case("script_segments", "text, segments", [(_MIXED, "MODEL/Hello KOREAN/안녕하세요 JAPANESE/こんにちは CHINESE/漢字")])
def _(spark):
    return _texts(spark, _MIXED).select("text", _joined(language.script_segments(F.col("text")), "kind", "text").alias("segments"))


@case("redact_mask", "text, masked", [("write a@b.com or 555-123-4567 now", "write ******* or ************ now"), ("메일abc@ex.com입니다", "메일**********입니다")])
def _(spark):
    out = redaction.native_mask(redaction.native_mask(F.col("text"), redaction.EMAIL), redaction.PHONE)
    return _texts(spark, "write a@b.com or 555-123-4567 now", "메일abc@ex.com입니다").select("text", out.alias("masked"))


@case("redact_policy", "text, redacted, spans", [("my secret plan", "my #########an", "3/12/high/b;a")])
def _(spark):
    rules = [redaction.Rule("a", "low", keyword="secret", priority=50), redaction.Rule("b", "high", pattern=r"cret pl", priority=10)]
    policy = redaction.Policy(rules, mask="#")
    text = "my secret plan"
    return _texts(spark, text).select("text", redaction.redact(F.col("text"), policy).alias("r")).select(
        "text", "r.redacted", F.array_join(F.transform("r.spans", lambda s: F.concat_ws("/", s["start"].cast("string"), s["end"].cast("string"), s["category"], F.array_join(s["rule_ids"], ";"))), " ").alias("spans")
    )
