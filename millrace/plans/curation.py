"""Queries of the curation funnel over ``documents``, with the SQL that each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions.normalize import normalize
from millrace.operators import dedup, funnel
from millrace.sources.tables import read_table, spread


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(read_table(spark, folder, "documents", "doc_id", "text"))


def lang_ratio_filter(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    return _documents(spark, folder).select("doc_id", F.length(F.coalesce(text, F.lit(""))).cast("long").alias("n"), X.count_of(text, X.ASCII_CLASS).cast("long").alias("plain"), X.is_english(text).alias("passes"))


def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.exact_classes(_documents(spark, folder))


def exact_dedup_kept(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.drop_copies(_documents(spark, folder)).select("doc_id")


def normalize_space(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", F.md5(X.clean_space(F.col("text"))).alias("digest"))


def normalize_full(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", normalize(F.col("text")).alias("text"))


def heuristic_tests(spark: SparkSession, folder: str) -> DataFrame:
    rows = _documents(spark, folder).select("doc_id", X.clean_space(F.col("text")).alias("t"))
    return rows.select("doc_id", *[c.alias(n) for n, c in X.heuristics(F.col("t")).items()], X.passes_heuristics(F.col("t")).alias("passes_heuristics"), X.passes_task_filter(F.col("t")).alias("passes_task_filter"))


def edu_score(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", F.round(X.quality_score(X.clean_space(F.col("text"))), 9).alias("score"))


def domain_tag(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", X.domain(F.col("text")).alias("d")).select("doc_id", "d.domain", "d.confidence")


def domain_tag_whole(spark: SparkSession, folder: str) -> DataFrame:
    """As ``domain_tag``, by the whole text instead of the reference's first characters."""
    return _documents(spark, folder).select("doc_id", X.domain(F.col("text"), None).alias("d")).select("doc_id", "d.domain", "d.confidence")


def redact(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", F.md5(X.redact(X.clean_space(F.col("text")))).alias("digest"))


def shingle_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", F.size(X.shingles(F.col("text"))).cast("long").alias("shingles"))


def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.near_duplicates(dedup.drop_copies(_documents(spark, folder)))


def curated_full(spark: SparkSession, folder: str) -> DataFrame:
    """All stages, near duplicates and full normalization included."""
    return funnel.curate(_documents(spark, folder), near=True)


def _drops(curated: DataFrame) -> DataFrame:
    return curated.select("doc_id", "drop_stage", "domain", F.col("word_count").cast("long").alias("word_count"), F.col("char_count").cast("long").alias("char_count"))


def funnel_drops(spark: SparkSession, folder: str) -> DataFrame:
    return _drops(curated_full(spark, folder))


def funnel_summary(spark: SparkSession, folder: str) -> DataFrame:
    return funnel.summary(curated_full(spark, folder))


def domain_pools(spark: SparkSession, folder: str) -> DataFrame:
    return funnel.domain_pools(curated_full(spark, folder))


def _reduced(spark: SparkSession, folder: str) -> DataFrame:
    """The part of the funnel that SQL can say: no near duplicates, and neither markup nor NFKC in the cleaning."""
    return funnel.curate(_documents(spark, folder), full_normalize=False)


def reduced_funnel_drops(spark: SparkSession, folder: str) -> DataFrame:
    return _drops(_reduced(spark, folder))


def reduced_funnel_summary(spark: SparkSession, folder: str) -> DataFrame:
    return funnel.summary(_reduced(spark, folder))


def reduced_domain_pools(spark: SparkSession, folder: str) -> DataFrame:
    return funnel.domain_pools(_reduced(spark, folder))


QUERIES = {f.__name__: f for f in (lang_ratio_filter, exact_dedup, exact_dedup_kept, normalize_space, normalize_full, heuristic_tests, edu_score, domain_tag, domain_tag_whole, redact, shingle_counts, near_duplicates, funnel_drops, funnel_summary, domain_pools, curated_full, reduced_funnel_drops, reduced_funnel_summary, reduced_domain_pools)}


# ---- the same in SQL --------------------------------------------------------


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _count(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, {_q(pattern)}))"


_TEXT = "coalesce(text, '')"
_CLEAN = f"trim(regexp_replace(regexp_replace({_TEXT}, {_q(X.CONTROL_CLASS)}, '', 'g'), {_q(X.SPACE_CLASS + '+')}, ' ', 'g'))"
_REDACT = f"regexp_replace(regexp_replace({{0}}, {_q(X.EMAIL_PATTERN)}, '[REDACTED_EMAIL]', 'g'), {_q(X.URL_PATTERN)}, '[REDACTED_URL]', 'g')"
_WORDS = "(CASE WHEN t = '' THEN [] ELSE string_split(t, ' ') END)"
_PIECES = "len(list_filter(regexp_split_to_array(t, '[.!?]+'), lambda p: trim(p) <> ''))"
_TESTS = f"""
    n >= {X.MIN_WORDS} AS min_words, n <= {X.MAX_WORDS} AS max_words,
    CASE WHEN t = '' THEN false ELSE {_count("t", r"\p{L}")} / length(t) >= {X.MIN_ALPHA} END AS alpha,
    CASE WHEN t = '' THEN true ELSE {_count("t", X.PUNCT_CLASS)} / length(t) <= {X.MAX_PUNCT} END AS punctuation,
    CASE WHEN t = '' THEN true ELSE {_count("t", r"\p{Nd}")} / length(t) <= {X.MAX_DIGIT} END AS digits,
    CASE WHEN t = '' THEN true ELSE {_count("t", r"\p{Lu}")} / length(t) <= {X.MAX_UPPER} END AS uppercase,
    CASE WHEN n > 0 THEN len(list_distinct(list_transform(w, lambda x: lower(x)))) / n >= {X.MIN_UNIQUE} ELSE false END AS diversity,
    CASE WHEN {_PIECES} > 0 THEN n / {_PIECES} >= {X.MIN_SENTENCE} ELSE true END AS sentence_length"""
_SCORE = f"""CASE WHEN n < 20 THEN 0.10::DOUBLE ELSE least(1.0::DOUBLE, 0.30::DOUBLE + 0.40::DOUBLE * least(1.0::DOUBLE, len(list_intersect(list_transform(w, lambda x: lower(x)), [{", ".join(map(_q, X.EDU_KEYWORDS))}])) / 5.0::DOUBLE)
    + 0.30::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (list_sum(list_transform(w, lambda x: length(x))) / n - 3.5::DOUBLE) / 3.0::DOUBLE))) END"""


def _domain(column: str, what: int, chars: int | None = X.DOMAIN_CHARS) -> str:
    head = f"lower(substring({column}, 1, {chars}))" if chars else f"lower({column})"
    cases = " ".join("WHEN " + " OR ".join(f"contains({head}, {_q(m)})" for m in marks) + f" THEN {_q(name) if what == 0 else f'{sure}::DOUBLE'}" for name, sure, marks in X.DOMAIN_RULES)
    return f"CASE {cases} ELSE {_q(X.DEFAULT_DOMAIN[0]) if what == 0 else f'{X.DEFAULT_DOMAIN[1]}::DOUBLE'} END"


_ENGLISH = f"(length({_TEXT}) >= {X.ASCII_LEAST_CHARS} AND {_count(_TEXT, X.ASCII_CLASS)} / length({_TEXT}) >= {X.ASCII_LEAST_SHARE})"
_PREPARED = f"SELECT doc_id, t, w, len(w) AS n FROM (SELECT doc_id, t, {_WORDS} AS w FROM (SELECT doc_id, {_CLEAN} AS t FROM documents))"
_FUNNEL = f"""
    WITH english AS (SELECT doc_id, text, {_ENGLISH} AS english FROM documents),
         firsts AS (SELECT text, min(doc_id) AS first FROM english WHERE english GROUP BY text),
         copies AS (SELECT e.doc_id, e.english, e.english AND f.first <> e.doc_id AS copy FROM english e LEFT JOIN firsts f ON e.english AND e.text = f.text),
         prepared AS ({_PREPARED}),
         tests AS (SELECT doc_id, t, n, {_TESTS}, {_SCORE} AS score FROM prepared),
         dropped AS (SELECT c.doc_id, t, CASE WHEN NOT english THEN 'language_filter' WHEN copy THEN 'exact_dedup'
                       WHEN NOT (min_words AND max_words AND alpha AND punctuation) THEN 'heuristic_quality' WHEN score < {X.QUALITY_THRESHOLD} THEN 'fineweb_ml_quality'
                       WHEN NOT (n > 0 AND digits AND uppercase AND diversity AND sentence_length) THEN 'syntax_task_filter' END AS drop_stage
                     FROM copies c JOIN tests USING (doc_id)),
         curated AS (SELECT doc_id, drop_stage, t, CASE WHEN drop_stage IS NULL THEN {_REDACT.format("t")} END AS clean FROM dropped)"""

ORACLES = {
    "lang_ratio_filter": f"SELECT doc_id, length({_TEXT}) AS n, {_count(_TEXT, X.ASCII_CLASS)} AS plain, {_ENGLISH} AS passes FROM documents",
    "exact_dedup": "SELECT d.doc_id, f.class_id, f.copies FROM documents d JOIN (SELECT text, min(doc_id) AS class_id, count(*) AS copies FROM documents GROUP BY text) f ON d.text IS NOT DISTINCT FROM f.text",
    "exact_dedup_kept": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
    "normalize_space": f"SELECT doc_id, md5({_CLEAN}) AS digest FROM documents",
    "heuristic_tests": f"WITH p AS ({_PREPARED}), q AS (SELECT doc_id, n, {_TESTS} FROM p) SELECT doc_id, min_words, max_words, alpha, punctuation, digits, uppercase, diversity, sentence_length, (min_words AND max_words AND alpha AND punctuation) AS passes_heuristics, (n > 0 AND digits AND uppercase AND diversity AND sentence_length) AS passes_task_filter FROM q",
    "edu_score": f"SELECT doc_id, round({_SCORE}, 9) AS score FROM ({_PREPARED})",
    "domain_tag_whole": f"SELECT doc_id, {_domain(_TEXT, 0, None)} AS domain, {_domain(_TEXT, 1, None)} AS confidence FROM documents",
    "domain_tag": f"SELECT doc_id, {_domain(_TEXT, 0)} AS domain, {_domain(_TEXT, 1)} AS confidence FROM documents",
    "redact": f"SELECT doc_id, md5({_REDACT.format(_CLEAN)}) AS digest FROM documents",
    "shingle_counts": rf"""SELECT doc_id, CASE WHEN len(w) < 5 THEN len(list_distinct(w)) ELSE len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) END AS shingles
        FROM (SELECT doc_id, regexp_extract_all(lower({_TEXT}), '[\p{{L}}\p{{N}}_]+') AS w FROM documents)""",
    "reduced_funnel_drops": f"{_FUNNEL} SELECT doc_id, drop_stage, CASE WHEN drop_stage IS NULL THEN {_domain('clean', 0)} END AS domain, CASE WHEN drop_stage IS NULL THEN CAST(len(string_split(clean, ' ')) AS BIGINT) END AS word_count, length(clean) AS char_count FROM curated",
    "reduced_funnel_summary": f"""{_FUNNEL}, c AS (SELECT count(*) AS n, count(*) FILTER (drop_stage IS NULL) AS kept, count(*) FILTER (drop_stage IS NULL AND clean <> t) AS redacted_docs,
        {", ".join(f"count(*) FILTER (drop_stage = '{s}') AS {s}" for s in funnel.STAGES)} FROM curated)
        SELECT greatest(1, n) AS total_input_docs, kept AS retained_docs, round_even(kept / greatest(1, n) * 100, 2) AS yield_percentage, round_even((greatest(1, n) - kept) / greatest(1, n) * 100, 2) AS noise_filtered_pct,
        {", ".join(funnel.STAGES)}, kept AS stage7_pii_redacted, redacted_docs FROM c""",
    "reduced_domain_pools": f"{_FUNNEL}, k AS (SELECT {_domain('clean', 0)} AS domain FROM curated WHERE drop_stage IS NULL) SELECT domain, lower(string_split(domain, ' ')[1]) AS pool, count(*) AS documents FROM k GROUP BY domain",
}
