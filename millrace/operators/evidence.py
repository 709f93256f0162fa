"""Evidence that a run kept its rules: checks with predicates of their own, as rows and as a table in Markdown.

Each check compares two sources that do not know of each other, so that each can
fail; what it counted is its evidence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import ledger as L
from millrace.operators import selection, tokenizer
from millrace.operators.tokenizer import PAD


def _row(source: DataFrame, name: str, passed: Column, evidence: Column) -> DataFrame:
    return source.agg(F.lit(name).alias("requirement"), F.when(F.coalesce(passed, F.lit(False)), "PASS").otherwise("FAIL").alias("result"), evidence.cast("string").alias("evidence"))


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def tokenizer_integrity(documents: DataFrame) -> DataFrame:
    """Every document's tokens are what encoding its text gives."""
    again = F.when(F.coalesce("text", F.lit("")) == "", F.array().cast("array<int>")).otherwise(tokenizer.encode(F.col("text"), add_eod=True))
    wrong = _count(~F.coalesce("tokens", F.array().cast("array<int>")).eqNullSafe(again))
    return _row(documents, "tokenizer_integrity", (wrong == 0) & (F.count("*") > 0), F.concat(F.lit("documents="), F.count("*"), F.lit(", wrong="), wrong))


def evaluation_firewall(ledger: DataFrame, rules: DataFrame) -> DataFrame:
    """No shard or document that the rules name was served, whatever the gate said."""
    served = ledger.select("id", F.explode(F.array_union(F.coalesce("shard_ids", F.array().cast("array<string>")), F.transform(F.coalesce("token_span_ids", F.array()), lambda s: s["doc_id"]))).alias("blocked_id"))
    hits = served.join(rules.select("blocked_id").distinct(), "blocked_id").select("id").distinct()
    return _row(hits, "evaluation_firewall", F.count("*") == 0, F.concat(F.lit("rows that served blocked ids="), F.count("*")))


def manifest_coverage(ledger: DataFrame, manifest: DataFrame) -> DataFrame:
    """Every shard that was served has a manifest."""
    served = ledger.select(F.explode("shard_ids").alias("shard_id")).distinct()
    lacking = served.join(manifest.select("shard_id"), "shard_id", "left_anti")
    return _row(lacking, "manifest_coverage", F.count("*") == 0, F.concat(F.lit("served shards without a manifest="), F.count("*")))


def packing_correctness(packed: DataFrame) -> DataFrame:
    """In every sequence the spans follow each other from 0, and hold all ids but the padding."""
    used = F.size(F.filter("input_ids", lambda t: t != PAD))
    chain = F.aggregate("spans", F.lit(0), lambda at, s: F.when((at >= 0) & (s["start_idx"] == at) & (s["end_idx"] >= at), s["end_idx"]).otherwise(F.lit(-1)))
    wrong = _count(~chain.eqNullSafe(used))
    return _row(packed, "packing_correctness", (wrong == 0) & (F.count("*") > 0), F.concat(F.lit("sequences="), F.count("*"), F.lit(", wrong="), wrong))


def mixture_compliance(shares: DataFrame) -> DataFrame:
    """No protected lane (``lane``, ``share``, ``floor``) lies below its floor."""
    below = _count(~F.coalesce(F.col("share") >= F.col("floor"), F.lit(False)))
    return _row(shares, "mixture_compliance", (below == 0) & (F.count("*") > 0), F.concat(F.lit("protected lanes="), F.count("*"), F.lit(", below="), below))


def selection_audit_trail(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every candidate was decided once, and each reason agrees with the score it names."""
    counts = candidates.groupBy("candidate_id").agg(F.count("*").alias("asked")).join(decisions.groupBy("candidate_id").agg(F.count("*").alias("told"), F.min("reason").alias("reason"), F.min("score").alias("score")), "candidate_id", "full_outer")
    fits = F.when(F.col("reason") == "quality_above_threshold", F.col("score") >= selection.THRESHOLD).when(F.col("reason") == "low_quality_score", F.coalesce("score", F.lit(0.0)) < selection.THRESHOLD).when(F.col("reason") == "protected_floor_rescued", F.col("score") >= selection.RESCUE_FLOOR).otherwise(F.col("reason").isin("quota_pressure", "deferred_for_later_stage"))
    wrong = _count(~(F.col("asked").eqNullSafe(1) & F.col("told").eqNullSafe(1) & F.coalesce(fits, F.lit(False))))
    return _row(counts, "selection_audit_trail", (wrong == 0) & (F.count("*") > 0), F.concat(F.lit("candidates="), F.count("*"), F.lit(", wrong="), wrong))


def crash_recovery(ledger: DataFrame) -> DataFrame:
    """No step of a run is missing, and none was recorded twice."""
    gaps = L.step_gaps(ledger)
    return _row(gaps, "crash_recovery", F.count("*") == 0, F.concat(F.lit("gaps="), _count(F.col("gap") > 0), F.lit(", repeated="), _count(F.col("copies") > 1)))


def replayed(ledger: DataFrame, documents: DataFrame, length: int = 2048) -> DataFrame:
    """Batches built anew from spans and tokens have the recorded hashes."""
    told = L.replay(ledger, documents, length)
    same, changed = _count(F.col("status") == "same"), _count(F.col("status") == "changed")
    return _row(told, "replay", (same > 0) & (changed == 0), F.concat(F.lit("same="), same, F.lit(", changed="), changed))


def lanes_agree(ledger: DataFrame, shards: DataFrame, lane_of) -> DataFrame:
    """Every row's lane is that of one of the shards it served."""
    told = L.lane_agreement(ledger, shards, lane_of)
    other = F.coalesce(F.sum(F.when(~F.coalesce("agrees", F.lit(False)), F.col("rows"))), F.lit(0))
    return _row(told, "lane_agreement", (other == 0) & (F.count("*") > 0), F.concat(F.lit("rows of another lane="), other))


def utilization_recorded(packed: DataFrame) -> DataFrame:
    """The recorded utilization of every sequence is what its ids say."""
    own = F.size(F.filter("input_ids", lambda t: t != PAD)) / F.size("input_ids")
    wrong = _count(~F.coalesce(F.abs(F.col("utilization") - own) < 0.001, F.lit(False)))
    return _row(packed, "throughput", (wrong == 0) & (F.count("*") > 0), F.concat(F.lit("utilization="), F.round(F.avg(own), 4), F.lit(", wrong="), wrong))


def learning_trace(ledger: DataFrame, learning: DataFrame) -> DataFrame:
    """Every step that was consumed was learned from."""
    lacking = ledger.select("global_step").distinct().join(learning.select("global_step"), "global_step", "left_anti")
    return _row(lacking, "learning_trace", F.count("*") == 0, F.concat(F.lit("steps without a learning row="), F.count("*")))


def bundle(rows: list[DataFrame]) -> DataFrame:
    """``requirement``, ``result``, ``evidence``: the rows of the checks together."""
    return reduce(DataFrame.unionByName, rows)


def markdown(evidence: DataFrame) -> DataFrame:
    """One row, ``markdown``: the checks as a table, made from their rows alone."""
    plain = F.regexp_replace("requirement", "_", " ")
    line = F.concat(F.lit("| "), F.concat(F.upper(F.substring(plain, 1, 1)), F.substring(plain, 2, 100)), F.lit(" | "), F.col("result"), F.lit(" | "), F.col("evidence"), F.lit(" |"))
    lines = evidence.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("requirement", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    return lines.select(F.concat(F.lit("| Requirement | Result | Evidence |\n|---|---|---|\n"), F.col("body")).alias("markdown"))


def performance(ledger: DataFrame, packed: DataFrame) -> DataFrame:
    """Figures counted from what is recorded: rows, tokens served, seconds between the first and last row, tokens a second, utilization."""
    tokens = F.aggregate(F.coalesce("token_span_ids", F.array()), F.lit(0).cast("long"), lambda a, s: a + s["end_idx"] - s["start_idx"])
    served = ledger.select(tokens.alias("t"), "recorded_at").agg(F.count("*").alias("microbatches"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), (F.max("recorded_at").cast("timestamp").cast("double") - F.min("recorded_at").cast("timestamp").cast("double")).alias("seconds"))
    used = packed.agg((F.sum(F.size(F.filter("input_ids", lambda t: t != PAD)).cast("long")) / F.sum(F.size("input_ids").cast("long"))).alias("utilization"))
    return served.join(used).select("microbatches", "tokens", "seconds", F.when(F.col("seconds") > 0, F.col("tokens") / F.col("seconds")).alias("tokens_per_second"), "utilization")
