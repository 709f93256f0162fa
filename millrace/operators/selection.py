"""Choosing candidates by quality, quota and protected lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import checkpointed

# ---- fixed values ---------------------------------------------------------
THRESHOLD, RESCUE_FLOOR = 0.70, 0.50
PROTECTED = ("indic",)
# ---------------------------------------------------------------------------


def reason_of(score: Column, lane: Column, quota_full: Column, defer: Column, threshold: float = THRESHOLD) -> Column:
    """Deferral first, then a full quota, then a low score; a protected lane is rescued from the last two above a floor."""
    rescued = lane.isin(*PROTECTED) & (score >= RESCUE_FLOOR)
    return (
        F.when(F.coalesce(defer, F.lit(False)), "deferred_for_later_stage")
        .when(F.coalesce(quota_full, F.lit(False)), F.when(rescued, "protected_floor_rescued").otherwise("quota_pressure"))
        .when(F.coalesce(score, F.lit(0.0)) < threshold, F.when(rescued, "protected_floor_rescued").otherwise("low_quality_score"))
        .otherwise("quality_above_threshold")
    )


def decide(candidates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``candidate_id``, ``status``, ``reason``, ``score``, ``lane``, ``rescued_by_protected_floor`` of each candidate (``candidate_id``, ``score``, ``lane``, ``lane_quota_full``, ``defer``)."""
    reason = reason_of(F.col("score"), F.col("lane"), F.col("lane_quota_full"), F.col("defer"), threshold)
    status = F.when(F.col("reason") == "deferred_for_later_stage", "deferred").when(F.col("reason") == "protected_floor_rescued", "protected-floor-rescued").when(F.col("reason") == "quality_above_threshold", "accepted").otherwise("rejected")
    told = candidates.withColumn("reason", reason)
    return told.select("candidate_id", status.alias("status"), "reason", "score", "lane", (F.col("reason") == "protected_floor_rescued").alias("rescued_by_protected_floor"))


def with_quota(candidates: DataFrame, quotas: DataFrame) -> DataFrame:
    """``candidates`` with ``lane_quota_full``: whether as many of its lane go before it, best score first, then by id.

    Ranks are exact and go over two levels that keep this order: rows are dealt
    into sorted ranges of lane, score and id, however many of them share a lane
    or a score, and each range is told how many rows of the lane go before it.
    """
    keyed = candidates.withColumn("_score", F.coalesce("score", F.lit(0.0)))
    order = [F.col("lane"), F.col("_score").desc(), F.col("candidate_id")]
    # Ranges are drawn by a sample and must be the same for the counts and the ranks.
    parted = checkpointed(keyed.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = parted.groupBy("lane", "_part").agg(F.count("*").alias("_n"))
    ahead = counts.withColumn("_ahead", F.coalesce(F.sum("_n").over(Window.partitionBy("lane").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumnRenamed("lane", "_lane").drop("_n")
    ranked = parted.withColumn("_k", F.row_number().over(Window.partitionBy("_part", "lane").orderBy(F.desc("_score"), "candidate_id")))
    joined = ranked.join(ahead.withColumnRenamed("_part", "_of"), F.col("lane").eqNullSafe(F.col("_lane")) & (F.col("_part") == F.col("_of")), "left").join(F.broadcast(quotas.select("lane", "quota").groupBy("lane").agg(F.max("quota").alias("_quota"))), "lane", "left")
    return joined.withColumn("lane_quota_full", F.coalesce(F.col("_ahead") + F.col("_k") > F.col("_quota"), F.lit(False))).drop("_score", "_part", "_of", "_lane", "_ahead", "_k", "_quota")


def rejection_rates(decisions: DataFrame) -> DataFrame:
    """Decisions and the share rejected in each lane."""
    return decisions.groupBy("lane").agg(F.count("*").alias("decisions"), F.avg((F.col("status") == "rejected").cast("int")).alias("rejection_rate"))
