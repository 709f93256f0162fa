"""Microbatches from packed sequences: labels, masks, positions, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.tokenizer import PAD

IGNORED_LABEL = -100
ISOLATING = "structure-preserving"


def labels(ids: Column) -> Column:
    return F.transform(ids, lambda t: F.when(t == PAD, IGNORED_LABEL).otherwise(t))


def loss_mask(ids: Column) -> Column:
    return F.transform(ids, lambda t: F.when(t == PAD, F.lit(0.0)).otherwise(F.lit(1.0)))


def position_ids(ids: Column, spans: Column) -> Column:
    """Places within the own document, 0 on padding; spans of no length take no place."""
    none = F.array().cast("array<int>")
    runs = F.transform(spans, lambda s: F.when(s["end_idx"] > s["start_idx"], F.sequence(F.lit(0), s["end_idx"] - s["start_idx"] - 1)).otherwise(none))
    placed = F.flatten(F.coalesce(runs, F.array(none)))
    return F.concat(placed, F.array_repeat(F.lit(0), F.size(ids) - F.size(placed)))


def segments(ids: Column, spans: Column) -> Column:
    """For each id the number of its document (from 1), 0 on padding: what attention needs, in one number an id."""
    parts = F.transform(spans, lambda s, k: F.array_repeat((k + 1).cast("int"), (s["end_idx"] - s["start_idx"]).cast("int")))
    placed = F.flatten(F.coalesce(parts, F.array(F.array().cast("array<int>"))))
    return F.concat(placed, F.array_repeat(F.lit(0), F.size(ids) - F.size(placed)))


def attention_mask(ids: Column, segment: Column, policy: Column) -> Column:
    """The square causal mask; only the isolating policy keeps documents apart. For checks: a mask grows as the square of the length."""
    places = F.sequence(F.lit(0), F.size(ids) - 1)

    def row(i: Column) -> Column:
        def cell(j: Column) -> Column:
            seen = (j <= i) & (F.get(ids, i) != PAD) & (F.get(ids, j) != PAD)
            own = (policy != ISOLATING) | ((F.get(segment, i) == F.get(segment, j)) & (F.get(segment, i) > 0))
            return F.when(seen & own, 1).otherwise(0).cast("byte")

        return F.transform(places, cell)

    return F.transform(places, row)


def attended(ids: Column, positions: Column, segment: Column, policy: Column) -> Column:
    """How many places each place attends to: the row sums of the square mask, which padding at the end and documents in a row allow to give without it."""
    seen = lambda t, i: F.when(t == PAD, 0).when(policy == ISOLATING, F.when(F.get(segment, i) > 0, F.get(positions, i) + 1).otherwise(0)).otherwise(i + 1)
    return F.transform(ids, seen)


def json_list(values: Column, number: str = "int") -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: F.when(v == 1.0, "1.0").otherwise("0.0") if number == "mask" else v.cast("string")), ", "), F.lit("]"))


def loss_mask_hash(mask: Column) -> Column:
    return F.sha2(json_list(mask, "mask"), 256)


def json_string(text: Column) -> Column:
    """A JSON string of printable ASCII text. Other characters would need escapes that ids do not have."""
    return F.concat(F.lit('"'), F.regexp_replace(text, r'(["\\])', r"\\$1"), F.lit('"'))


def batch_hash(microbatch_id: Column, ids: Column, mask: Column, positions: Column, spans: Column) -> Column:
    """SHA-256 of the batch as JSON with sorted keys and the usual spaces."""
    told = F.transform(spans, lambda s: F.concat(F.lit('{"doc_id": '), json_string(s["doc_id"]), F.lit(', "end_idx": '), s["end_idx"].cast("string"), F.lit(', "start_idx": '), s["start_idx"].cast("string"), F.lit("}")))
    whole = F.concat(
        F.lit('{"input_ids": '), json_list(ids),
        F.lit(', "loss_mask": '), json_list(mask, "mask"),
        F.lit(', "microbatch_id": '), json_string(microbatch_id),
        F.lit(', "position_ids": '), json_list(positions),
        F.lit(', "spans": ['), F.array_join(F.coalesce(told, F.array().cast("array<string>")), ", "), F.lit("]}"),
    )
    return F.sha2(whole, 256)


def build(packed: DataFrame, microbatch_id: Column) -> DataFrame:
    """``packed`` with ``microbatch_id``, ``labels``, ``loss_mask``, ``position_ids``, ``segment_ids``, ``loss_mask_hash`` and ``batch_hash``."""
    rows = packed.withColumn("microbatch_id", microbatch_id).withColumn("labels", labels(F.col("input_ids"))).withColumn("loss_mask", loss_mask(F.col("input_ids")))
    rows = rows.withColumn("position_ids", position_ids(F.col("input_ids"), F.col("spans"))).withColumn("segment_ids", segments(F.col("input_ids"), F.col("spans")))
    return rows.withColumn("loss_mask_hash", loss_mask_hash(F.col("loss_mask"))).withColumn("batch_hash", batch_hash(F.col("microbatch_id"), F.col("input_ids"), F.col("loss_mask"), F.col("position_ids"), F.col("spans")))


def step_name(step: Column, renumber_from: int | None = None, renumber_to: int = 0) -> Column:
    """``b_<step>``, renumbered from some step on if asked."""
    if renumber_from is None:
        return F.concat(F.lit("b_"), step.cast("string"))
    return F.concat(F.lit("b_"), F.when(step >= renumber_from, step - renumber_from + renumber_to).otherwise(step).cast("string"))
