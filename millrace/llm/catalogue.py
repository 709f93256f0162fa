"""Queries of the training-data operators, named pN_ after their problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, language, leakage, mixing, packing, personal, quality, splitting, subjects
from millrace.sources.tables import read_table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return quality.statistics(read_table(spark, folder, "documents", "doc_id", "text")).where("body IS NOT NULL").select("doc_id", "body")


def p1_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return quality.statistics(read_table(spark, folder, "documents", "doc_id", "text"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return language.mislabelled(read_table(spark, folder, "documents", "doc_id", "text", "lang", "shard_id"), read_table(spark, folder, "shards", "shard_id", "language_script", "ingested_at"))


def p2_languages(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(read_table(spark, folder, "documents", "doc_id", "text", "lang"))


def p2_segments(spark: SparkSession, folder: str) -> DataFrame:
    return language.segments(read_table(spark, folder, "documents", "doc_id", "text", "lang"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal.find_personal(read_table(spark, folder, "documents", "doc_id", "text"))


def p3_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return personal.redact(read_table(spark, folder, "documents", "doc_id", "text"))


def p4_selection(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.select_shards(read_table(spark, folder, "shards"), read_table(spark, folder, "stage_lanes"))


def p4_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(read_table(spark, folder, "shards"), read_table(spark, folder, "stage_lanes"), read_table(spark, folder, "microbatch_ledger"))


def p4_recorded_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.recorded_shares(read_table(spark, folder, "microbatch_ledger"))


def p5_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read_table(spark, folder, "documents_tok"))


def p5_gain(spark: SparkSession, folder: str) -> DataFrame:
    return packing.gain(read_table(spark, folder, "documents_tok"), read_table(spark, folder, "packed_sequences"))


def _subject_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        read_table(spark, folder, "documents", "doc_id", "text", "source", "metadata"),
        read_table(spark, folder, "subjects", "subject", "description"),
        read_table(spark, folder, "subject_labels", "doc_id", "subject"),
    )


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.classify(*_subject_tables(spark, folder)).select("doc_id", "subject")


def p6_composition(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.composition(*_subject_tables(spark, folder))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_documents(read_table(spark, folder, "documents", "doc_id", "text"))


def p7_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Whether decoding the ids of each document gives its text back, and how many ids it has."""
    return bpe.round_trip(read_table(spark, folder, "documents", "doc_id", "text"))


def _leak_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return read_table(spark, folder, "documents", "doc_id", "text"), read_table(spark, folder, "eval_items", "item_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.find_leaks(*_leak_tables(spark, folder)).select("doc_id", "item_id")


def p8_places(spark: SparkSession, folder: str) -> DataFrame:
    """Each leak with the length and place of its longest stretch and of its longest verbatim match."""
    return leakage.find_leaks(*_leak_tables(spark, folder))


def p8_longest(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.longest_matches(*_leak_tables(spark, folder))


def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of the documents that stay when those with leaks are removed."""
    documents, items = _leak_tables(spark, folder)
    return leakage.without_leaks(documents, leakage.find_leaks(documents, items)).select("doc_id")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.oversized(read_table(spark, folder, "documents", "doc_id", "text")).select("doc_id")


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_documents(read_table(spark, folder, "documents", "doc_id", "text"))


#: A lane's plain name, as SQL over a column {0}.
_LANE = """CASE regexp_replace(lower(trim({0})), '[\\s_-]+', '_', 'g') WHEN 'general' THEN 'general_web' WHEN 'reasoning' THEN 'math_reasoning' WHEN '' THEN NULL ELSE regexp_replace(lower(trim({0})), '[\\s_-]+', '_', 'g') END"""

ORACLES = {
    "p4_recorded_shares": f"""
        WITH steps AS (SELECT run_id, branch_id, global_step, rank, id, curriculum_stage AS stage, {_LANE.format("mixture_lane")} AS lane,
                              coalesce(list_sum(list_transform(token_span_ids, lambda s: greatest(s.end_idx - s.start_idx, 0))), 0) AS n FROM microbatch_ledger),
             once AS (SELECT *, row_number() OVER (PARTITION BY run_id, branch_id, global_step, rank ORDER BY id DESC) AS k FROM steps),
             tokens AS (SELECT stage, lane, CAST(sum(n) AS BIGINT) AS recorded_tokens FROM once WHERE k = 1 GROUP BY stage, lane)
        SELECT stage, lane, recorded_tokens, recorded_tokens / sum(recorded_tokens) OVER (PARTITION BY stage) AS recorded_share FROM tokens""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_statistics, p2_found, p2_languages, p2_segments, p3_found, p3_redacted, p4_selection, p4_shares, p4_recorded_shares, p5_sequences, p5_gain, p6_found, p6_composition, p7_ids, p7_round_trip, p8_found, p8_places, p8_longest, p8_clean, p9_found, p9_pieces)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
