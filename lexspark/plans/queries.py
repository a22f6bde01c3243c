"""Queries over the test tables by name, and SQL that gives the same rows."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidRequestError
from ..functions import requests, scripts, search
from ..operators import language, matching, redaction
from ..options import MAX_TEXT_LENGTH, Normalization, SearchOptions, WordBoundary
from ..sources.dictionaries import VersionedDictionary, cumulative_tiers, words_in, words_out
from ..streaming.scanner import chunks, scan_chunks
from . import pipelines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Keywords that occur in the documents; none overlaps itself, as the SQL needs.
WORDS = ["license", "Licensed", "tion", "the", "Version"]
NESTED = ["tion", "ion", "on"]


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _values(words: Sequence[str]) -> str:
    return ", ".join(f"('{w}')" for w in words)


def _positions(words: Sequence[str], text: str = "text") -> str:
    """CTE m(doc_id, keyword, start, end, t): all places of the words."""
    return f"""
    k(keyword) AS (VALUES {_values(words)}),
    cut AS (SELECT doc_id, {text} AS t, keyword, string_split({text}, keyword) AS parts FROM documents, k WHERE contains({text}, keyword)),
    part AS (SELECT doc_id, t, keyword, unnest(parts) AS p, generate_subscripts(parts, 1) AS i, len(parts) AS n FROM cut),
    placed AS (SELECT doc_id, t, keyword, i, n, CAST(sum(length(p) + length(keyword)) OVER (PARTITION BY doc_id, keyword ORDER BY i) - length(keyword) AS INTEGER) AS start FROM part),
    m AS (SELECT doc_id, t, keyword, start, CAST(start + length(keyword) - 1 AS INTEGER) AS "end" FROM placed WHERE i < n)"""


def _rows(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "start", "end", "keyword")


_ALL = f'WITH {_positions(WORDS)} SELECT doc_id, start, "end", keyword FROM m'


@query("ac_build", "SELECT lower(n_name) AS keyword, count(*) AS n FROM nation GROUP BY 1")
def _(spark, d):
    names = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("keyword"), F.col("n_name").alias("value"))
    found = matching.dictionary_from(names, options=SearchOptions(ignore_case=True))
    own = spark.createDataFrame([(k,) for k in found.values], "keyword string")
    return own.groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))


@query("ac_contains", "SELECT doc_id FROM documents WHERE contains(text, 'license') OR contains(text, 'Version')")
def _(spark, d):
    return documents(spark, d).where(search.contains_any(F.col("text"), ["license", "Version"])).select("doc_id")


@query("ac_count", f"WITH {_positions(WORDS)} SELECT doc_id, keyword, count(*) AS n FROM m GROUP BY ALL")
def _(spark, d):
    counts = F.array(*(F.struct(F.lit(w).alias("keyword"), search.count_overlapping(F.col("text"), w).cast("long").alias("n")) for w in WORDS))
    return documents(spark, d).select("doc_id", F.explode(counts).alias("c")).select("doc_id", "c.*").where("n > 0")


@query("ac_parse", _ALL)
def _(spark, d):
    return _rows(matching.matches(documents(spark, d), matching.dictionary(WORDS)))


@query("ac_parse_native", _ALL)
def _(spark, d):
    return _rows(matching.native_matches(documents(spark, d), WORDS))


_NESTED_SQL = f"""WITH {_positions(["on"])},
    c AS (SELECT doc_id, "end", CASE WHEN substr(t, start - 1, 2) = 'ti' AND start >= 2 THEN 'tion' WHEN substr(t, start, 1) = 'i' AND start >= 1 THEN 'ion' ELSE 'on' END AS keyword FROM m)
    SELECT doc_id, CAST("end" - length(keyword) + 1 AS INTEGER) AS start, "end", keyword FROM c"""


@query("ac_parse_nonoverlap", _NESTED_SQL)
def _(spark, d):
    return _rows(matching.matches(documents(spark, d), matching.dictionary(NESTED, SearchOptions(allow_overlaps=False))))


@query("interval_remove_overlaps", _NESTED_SQL)
def _(spark, d):
    return _rows(matching.without_overlaps(matching.matches(documents(spark, d), matching.dictionary(NESTED))))


@query("interval_overlaps", f"""WITH {_positions(NESTED)}, s AS MATERIALIZED (SELECT doc_id, keyword, start, "end" FROM m),
    x AS (SELECT *, unnest(range(start // 64, "end" // 64 + 1)) AS block FROM s)
    SELECT a.doc_id, a.start, a."end", b.start AS other_start, b."end" AS other_end FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.block = b.block
    WHERE a.keyword = 'tion' AND b.keyword <> 'tion' AND a.start <= b."end" AND a."end" >= b.start AND a.block = greatest(a.start, b.start) // 64""")
def _(spark, d):
    m = matching.matches(documents(spark, d), matching.dictionary(NESTED))
    return matching.overlapping_pairs(m.where("keyword = 'tion'"), m.where("keyword <> 'tion'"))


@query("ac_boundary_alpha", rf"""WITH {_positions(["the", "of"])} SELECT doc_id, start, "end", keyword FROM m
    WHERE NOT regexp_matches(substr(t, start, CAST(start > 0 AS INTEGER)), '\p{{L}}') AND NOT regexp_matches(substr(t, "end" + 2, 1), '\p{{L}}')""")
def _(spark, d):
    return _rows(matching.matches(documents(spark, d), matching.dictionary(["the", "of"], SearchOptions(boundary=WordBoundary.LATIN_ALPHA))))


@query("ac_boundary_ws", rf"""WITH {_positions(["the", "of"])} SELECT doc_id, start, "end", keyword FROM m
    WHERE NOT regexp_matches(substr(t, start, CAST(start > 0 AS INTEGER)), '\S') AND NOT regexp_matches(substr(t, "end" + 2, 1), '\S')""")
def _(spark, d):
    return _rows(matching.matches(documents(spark, d), matching.dictionary(["the", "of"], SearchOptions(boundary=WordBoundary.WHITESPACE_SEPARATED))))


@query("ac_ignore_case", f"WITH {_positions(['licensed', 'the'], 'lower(text)')} SELECT doc_id, start, \"end\", keyword FROM m")
def _(spark, d):
    return _rows(matching.matches(documents(spark, d), matching.dictionary(["LICENSED", "The"], SearchOptions(ignore_case=True))))


@query("ac_normalize", f"WITH {_positions(['é', 'ción'], 'nfc_normalize(text)')} SELECT doc_id, start, \"end\", keyword FROM m")
def _(spark, d):
    return _rows(matching.matches(documents(spark, d), matching.dictionary(["é", "ción"], SearchOptions(normalization=Normalization.NFC))))


@query("ac_stop_first", f"""WITH {_positions(["the", "he", "tion"])} SELECT doc_id, start, "end", keyword FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY "end", keyword) = 1""")
def _(spark, d):
    return _rows(matching.matches(documents(spark, d), matching.dictionary(["the", "he", "tion"], SearchOptions(stop_on_first=True))))


_FIRST = f"""WITH {_positions(["the", "he", "tion"])} SELECT doc_id, start, "end", keyword FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY start, length(keyword) DESC) = 1"""


@query("ac_first", _FIRST)
def _(spark, d):
    return documents(spark, d).select("doc_id", matching.first(F.col("text"), matching.dictionary(["the", "he", "tion"])).alias("m")).where("m is not null").select("doc_id", "m.start", "m.end", "m.keyword")


@query("ac_first_native", _FIRST)
def _(spark, d):
    return documents(spark, d).select("doc_id", search.first_match(F.col("text"), ["the", "he", "tion"]).alias("m")).where("m is not null").select("doc_id", "m.start", "m.end", "m.keyword")


_TOKENS = """SELECT doc_id, len(regexp_extract_all(text, 'tion|the')) AS n_matches,
    len(list_filter(string_split_regex(text, 'tion|the'), lambda x: x <> '')) AS n_fragments FROM documents"""


@query("ac_tokenize", _TOKENS)
def _(spark, d):
    kinds = F.transform(matching.tokenize(F.col("text"), matching.dictionary(["tion", "the"])), lambda t: t["kind"])
    n = lambda k: F.size(F.filter("k", lambda x: x == k)).cast("long")
    return matching.balanced(documents(spark, d)).select("doc_id", kinds.alias("k")).select("doc_id", n("MATCH").alias("n_matches"), n("FRAGMENT").alias("n_fragments"))


@query("ac_tokenize_native", _TOKENS)
def _(spark, d):
    n = lambda k: F.size(F.filter("k", lambda x: x["kind"] == k)).cast("long")
    return documents(spark, d).select("doc_id", search.tokens(F.col("text"), ["tion", "the"]).alias("k")).select("doc_id", n("MATCH").alias("n_matches"), n("FRAGMENT").alias("n_fragments"))


@query("ac_replace", "SELECT doc_id, regexp_replace(text, 'Licensed|tion|the', '#', 'g') AS replaced FROM documents")
def _(spark, d):
    return documents(spark, d).select("doc_id", search.replace_matches(F.col("text"), ["Licensed", "tion", "the"], "#").alias("replaced"))


@query("ac_replace_map", "SELECT doc_id, replace(replace(text, 'tion', '<1>'), 'the', '<2>') AS replaced FROM documents")
def _(spark, d):
    return matching.balanced(documents(spark, d)).select("doc_id", matching.replace_all(F.col("text"), matching.dictionary({"tion": "<1>", "the": "<2>"})).alias("replaced"))


def _scanned(spark, d, own, size=37):
    found = matching.balanced(documents(spark, d)).select("doc_id", F.explode(scan_chunks(chunks(F.col("text"), size), own)).alias("m"))
    return found.select("doc_id", "m.*")


@query("ac_scan", _ALL)
def _(spark, d):
    return _rows(_scanned(spark, d, matching.dictionary(WORDS)))


@query("ac_scan_nonoverlap", _NESTED_SQL)
def _(spark, d):
    return _rows(_scanned(spark, d, matching.dictionary(NESTED, SearchOptions(allow_overlaps=False))))


@query("ac_scan_boundary", rf"""WITH {_positions(["the", "of"])} SELECT doc_id, start, "end", keyword FROM m
    WHERE NOT regexp_matches(substr(t, start, CAST(start > 0 AS INTEGER)), '\S') AND NOT regexp_matches(substr(t, "end" + 2, 1), '\S')""")
def _(spark, d):
    return _rows(_scanned(spark, d, matching.dictionary(["the", "of"], SearchOptions(boundary=WordBoundary.WHITESPACE_SEPARATED))))


@query("ac_flow", f"""WITH {_positions(WORDS)} SELECT doc_id, start, "end", keyword FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY "end", keyword) <= 5""")
def _(spark, d):
    m = matching.stream_matches(F.col("text"), matching.dictionary(WORDS), limit=5)
    return matching.balanced(documents(spark, d)).select("doc_id", F.explode(m).alias("m")).select("doc_id", "m.start", "m.end", "m.keyword")


@query("trace_summary", r"""SELECT doc_id, length(text) AS length, sha256(text) AS sha256, len(regexp_extract_all(text, '\p{L}')) AS letters, len(regexp_extract_all(text, '\p{Nd}')) AS digits,
    len(regexp_extract_all(text, '[\s\x0b\x85\p{Z}]')) AS spaces, length(text) - len(regexp_extract_all(text, '[\p{L}\p{Nd}\s\x0b\x85\p{Z}]')) AS others FROM documents""")
def _(spark, d):
    return documents(spark, d).select("doc_id", search.trace_summary(F.col("text")).alias("s")).select("doc_id", "s.*")


_EMAIL = r"\b[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9.\-]{1,253}\.[A-Za-z]{2,24}\b"
_PHONE = r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"


@query("redact_find", f"""SELECT doc_id, 'email' AS rule, unnest(regexp_extract_all(text, '{_EMAIL}')) AS found FROM documents
    UNION ALL SELECT doc_id, 'phone', unnest(regexp_extract_all(text, '{_PHONE}')) FROM documents""")
def _(spark, d):
    one = lambda rule, p: F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(0)), lambda x: F.struct(F.lit(rule).alias("rule"), x.alias("found")))
    return documents(spark, d).select("doc_id", F.explode(F.concat(one("email", redaction.EMAIL), one("phone", redaction.PHONE))).alias("f")).select("doc_id", "f.*")


@query("redact_default", f"""WITH f AS (SELECT doc_id, list_concat(regexp_extract_all(text, '{_EMAIL}'), regexp_extract_all(text, '{_PHONE}')) AS f, length(text) AS n FROM documents)
    SELECT doc_id, len(f) AS n_spans, coalesce(list_sum(list_transform(f, lambda x: length(x))), 0)::BIGINT AS n_masked, n AS length FROM f""")
def _(spark, d):
    text = F.col("text")
    out = matching.balanced(documents(spark, d)).select("doc_id", text, redaction.redact(text, redaction.default_policy(max_length=1_000_000)).alias("r"))
    stars = lambda c: F.length(c) - F.length(F.replace(c, F.lit("*"), F.lit("")))
    return out.select("doc_id", F.size("r.spans").cast("long").alias("n_spans"), (stars(F.col("r.redacted")) - stars(text)).cast("long").alias("n_masked"), F.length("r.redacted").alias("length"))


@query("redact_merge", f"""WITH {_positions(["tion", "on", "on t"])},
    s AS (SELECT doc_id, start, "end" + 1 AS e, keyword AS id, CASE keyword WHEN 'tion' THEN 3 WHEN 'on' THEN 2 ELSE 1 END AS pr FROM m),
    o AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY start, e DESC, pr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, e DESC, pr) AS g FROM o)
    SELECT doc_id, min(start) AS start, max(e) AS "end", 'c' || min(pr) AS category, string_agg(DISTINCT id, ',' ORDER BY id) AS rule_ids FROM i GROUP BY doc_id, g""")
def _(spark, d):
    m = matching.matches(documents(spark, d), matching.dictionary(["tion", "on", "on t"]))
    priority = F.when(F.col("keyword") == "tion", 3).when(F.col("keyword") == "on", 2).otherwise(1)
    spans = m.select("doc_id", "start", (F.col("end") + 1).alias("end"), F.col("keyword").alias("rule_id"), F.concat(F.lit("c"), priority.cast("string")).alias("category"), priority.alias("priority"))
    return redaction.merge_spans(spans).withColumn("rule_ids", F.array_join(F.array_sort("rule_ids"), ","))


@query("redact_text", "SELECT doc_id, CASE WHEN length(text) > 4096 THEN 413 ELSE 200 END AS status FROM documents")
def _(spark, d):
    return matching.balanced(documents(spark, d)).select("doc_id", redaction.redact(F.col("text"), redaction.default_policy())["status"].alias("status"))


_LETTERS = r"' ' || trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')) || ' '"
_GRAMS = f"""l AS (SELECT doc_id, lang, {_LETTERS} AS t FROM documents), g AS (SELECT doc_id, lang, unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS gram FROM l),
    c AS (SELECT lang, gram, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 2), z AS (SELECT lang, sum(n) AS total, count(*) AS kinds FROM c GROUP BY lang),
    model AS (SELECT lang, gram, ln((n + 1) / (total + kinds)) AS logp FROM c JOIN z USING (lang))"""
_SCORES = f"""WITH {_GRAMS}, o AS (SELECT doc_id, gram, count(*) AS n FROM g WHERE gram IN (SELECT gram FROM model) GROUP BY ALL),
    s AS (SELECT doc_id, x.lang, sum(n * coalesce(logp, -12.0)) AS total FROM o CROSS JOIN (SELECT DISTINCT lang FROM model) x LEFT JOIN model y ON y.lang = x.lang AND y.gram = o.gram GROUP BY ALL)"""


def _language_model(spark, d):
    return language.train(spark.read.parquet(f"{d}/documents.parquet"))


@query("lang_train", f"WITH {_GRAMS} SELECT lang, gram, round(logp, 6) AS logp FROM model")
def _(spark, d):
    return _language_model(spark, d).select("lang", "gram", F.round("logp", 6).alias("logp"))


@query("lang_detect", f"{_SCORES} SELECT doc_id, lang AS detected FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, lang DESC) = 1")
def _(spark, d):
    return language.detect(documents(spark, d), _language_model(spark, d)).select("doc_id", "detected")


@query("lang_confidence", f"{_SCORES}, w AS (SELECT *, exp(total - max(total) OVER (PARTITION BY doc_id)) AS w FROM s) SELECT doc_id, lang, round(w / sum(w) OVER (PARTITION BY doc_id), 4) AS confidence FROM w")
def _(spark, d):
    return language.scores(documents(spark, d), _language_model(spark, d)).select("doc_id", "lang", F.round("confidence", 4).alias("confidence"))


def _re2(*names: str) -> str:
    return "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for s in names for a, b in scripts.RANGES[s])


@query("script_counts", "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '[{_re2(s)}]')) AS n_{s}" for s in scripts.RANGES) + " FROM documents")
def _(spark, d):
    return documents(spark, d).select("doc_id", *(scripts.count_script(F.col("text"), s).cast("long").alias(f"n_{s}") for s in scripts.RANGES))


@query("uni_filter", f"SELECT doc_id, regexp_replace(text, '[^{_re2('ascii', 'korean')}]', '', 'g') AS ko, regexp_replace(text, '[^{_re2('ascii')}]', '', 'g') AS fr FROM documents")
def _(spark, d):
    return documents(spark, d).select("doc_id", scripts.filter_locale(F.col("text"), "ko").alias("ko"), scripts.filter_locale(F.col("text"), "fr").alias("fr"))


@query("uni_contains", f"SELECT doc_id, regexp_matches(text, '[{_re2('ascii', 'chinese')}]') AS some, NOT regexp_matches(text, '[^{_re2('ascii', 'chinese')}]') AS whole FROM documents")
def _(spark, d):
    return documents(spark, d).select("doc_id", scripts.contains_any_locale(F.col("text"), "zh").alias("some"), scripts.contains_all_locale(F.col("text"), "zh").alias("whole"))


_WORDS = r"w AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^\p{L}]+')) AS word FROM documents)"


def _document_words(spark, d):
    return documents(spark, d).select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).distinct()


@query("chararrayset_contains", f"WITH {_WORDS} SELECT word FROM w WHERE word IN (SELECT unnest(string_split_regex(lower(text), '[^\\p{{L}}]+')) FROM benchmark)")
def _(spark, d):
    other = spark.read.parquet(f"{d}/benchmark.parquet").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).distinct()
    return words_in(_document_words(spark, d), other)


@query("chararrayset_remove_all", f"WITH {_WORDS} SELECT word FROM w WHERE word NOT IN (SELECT unnest(string_split_regex(lower(text), '[^\\p{{L}}]+')) FROM benchmark)")
def _(spark, d):
    other = spark.read.parquet(f"{d}/benchmark.parquet").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).distinct()
    return words_out(_document_words(spark, d), other)


@query("charutil_counts", "SELECT doc_id, length(text) AS code_points, length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) AS utf16, lower(text) AS lower FROM documents")
def _(spark, d):
    return documents(spark, d).select("doc_id", F.length("text").alias("code_points"), (F.octet_length(F.encode("text", "UTF-16BE")) / 2).cast("int").alias("utf16"), F.lower("text").alias("lower"))


@query("req_validate", f"SELECT doc_id, CASE WHEN length(text) > {MAX_TEXT_LENGTH} THEN 413 WHEN trim(text) = '' THEN 400 ELSE 200 END AS status FROM documents")
def _(spark, d):
    return documents(spark, d).select("doc_id", requests.status(F.col("text")).alias("status"))


@query("dict_tiers", "SELECT t.threshold, n_name AS word FROM nation JOIN (VALUES ('LOW', 0), ('MIDDLE', 1), ('HIGH', 2)) t(threshold, r) ON n_regionkey % 3 >= r")
def _(spark, d):
    tier = F.element_at(F.array(*map(F.lit, ("LOW", "MIDDLE", "HIGH"))), (F.col("n_regionkey") % 3 + 1).cast("int"))
    return cumulative_tiers(spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("word"), tier.alias("tier")))


@query("dict_versions", "SELECT n_name AS word FROM nation WHERE n_regionkey <> 0 UNION SELECT r_name FROM region")
def _(spark, d):
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise InvalidRequestError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp()
    nation, region = spark.read.parquet(f"{d}/nation.parquet"), spark.read.parquet(f"{d}/region.parquet")
    v = VersionedDictionary(spark, f"{shared.rstrip('/')}/dictionaries", "names", history=3)
    v.reload("names", 1, lambda: nation.select(F.col("n_name").alias("word")))
    v.remove(nation.where("n_regionkey = 0").select(F.col("n_name").alias("word")))
    v.add(region.select(F.col("r_name").alias("word")))
    v.clear()
    return v.rollback()


@query("pipe_moderate", f"""SELECT doc_id, CASE WHEN length(text) > {MAX_TEXT_LENGTH} THEN 413 WHEN trim(text) = '' THEN 400 ELSE 200 END AS status, CASE WHEN length(text) <= {MAX_TEXT_LENGTH} THEN len(regexp_extract_all(text, 'Licensed|tion')) END AS n_keywords,
    CASE WHEN length(text) <= {MAX_TEXT_LENGTH} THEN len(regexp_extract_all(text, '{_EMAIL}')) END AS n_email, CASE WHEN length(text) <= {MAX_TEXT_LENGTH} THEN len(regexp_extract_all(text, '{_PHONE}')) END AS n_phone,
    CASE WHEN length(text) <= {MAX_TEXT_LENGTH} THEN length(text) - length(replace(text, '*', '')) + coalesce(list_sum(list_transform(list_concat(regexp_extract_all(text, '{_EMAIL}'), regexp_extract_all(text, '{_PHONE}')), lambda x: length(x))), 0)::BIGINT END AS n_masked FROM documents""")
def _(spark, d):
    return pipelines.moderate(documents(spark, d), ["Licensed", "tion"])


@query("pipe_risk_alert", f"""WITH {_positions(["Licensed", "tion", "the"])}, f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY start, length(keyword) DESC) = 1)
    SELECT CASE keyword WHEN 'Licensed' THEN 'L1' WHEN 'tion' THEN 'T1' ELSE 'T2' END AS code, count(*) AS n, min(doc_id) AS first_doc FROM f GROUP BY 1""")
def _(spark, d):
    return pipelines.risk_alerts(documents(spark, d), {"Licensed": "L1", "tion": "T1", "the": "T2"})


@query("pipe_safety", f"SELECT CASE WHEN length(text) > {MAX_TEXT_LENGTH} THEN 413 WHEN trim(text) = '' THEN 400 ELSE 200 END AS status, count(*) AS n FROM documents GROUP BY 1")
def _(spark, d):
    return pipelines.request_statuses(documents(spark, d))


@query("pipe_mixed_language", r"WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '\p{L}+')) AS s FROM documents) SELECT doc_id, 'MODEL' AS language, count(*) AS runs, sum(length(s))::BIGINT AS letters FROM r GROUP BY doc_id")
def _(spark, d):
    return pipelines.mixed_language_counts(documents(spark, d))


@query("pipe_stream_equiv", "SELECT 0 AS n_different")
def _(spark, d):
    own = matching.dictionary(["the", "he", "tion", "ion"])
    eager = matching.matches(documents(spark, d), own).select("doc_id", F.col("start").cast("long").alias("start"), "keyword")
    lazy = _scanned(spark, d, own, 53).select("doc_id", F.col("start").cast("long").alias("start"), "keyword")
    return eager.exceptAll(lazy).unionAll(lazy.exceptAll(eager)).agg(F.count(F.lit(1)).cast("int").alias("n_different"))


@query("pipe_corpus_quality", f"{_SCORES}, b AS (SELECT doc_id, lang FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, lang DESC) = 1) SELECT d.lang, b.lang = d.lang AS passed, count(*) AS n FROM documents d JOIN b USING (doc_id) GROUP BY ALL")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    found = language.detect(docs.select("doc_id", "text"), language.train(docs)).select(F.col("doc_id").alias("id"), F.array("detected").alias("languages"))
    cases = docs.select(F.col("doc_id").alias("id"), F.array("lang").alias("expected"), "lang")
    return pipelines.corpus_quality(cases, found).join(cases.select("id", "lang"), "id").groupBy("lang", "passed").agg(F.count(F.lit(1)).alias("n"))


@query("pipe_dict_reload", r"SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)licensed', '********', 'g'), '(?i)tion', '****', 'g') AS masked FROM documents")
def _(spark, d):
    return pipelines.mask_words(documents(spark, d), ["tion", "licensed"])


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["pipe_moderate"](spark, sf_dir)

