"""What was learned from each microbatch: token losses and the rows of the learning ledger.

The loss of a token is its surprise under a unigram model of the corpus: the
negative logarithm of its share of all tokens, each id counted once more than it
was met. It is a statistic of the data, the same on every run, and stands where
a trained model's loss would.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.operators import batches
from millrace.operators.tokenizer import vocabulary

# ---- fixed values ---------------------------------------------------------
DEFAULT_SCORE, LANE_SCORES = 0.85, {"indic": 0.62}
PHASE = "midtrain"
# ---------------------------------------------------------------------------
#: From this mean loss on a microbatch counts as hard; places are grouped by so many for the hard parts.
HARD, CLUSTER = 4.0, 256


def surprises(documents: DataFrame, tokens_col: str = "tokens") -> list[float]:
    """The loss of each id of the frozen vocabulary, on the driver: a few hundred numbers, whatever the corpus."""
    most = max(vocabulary()) + 1
    rows = documents.select(F.explode(F.col(tokens_col)).alias("t")).where(F.col("t").between(0, most - 1)).groupBy("t").agg(F.count("*").alias("n")).collect()
    counts = [1] * most
    for r in rows:
        counts[r.t] += r.n
    total = sum(counts)
    return [math.log(total / n) for n in counts]


def token_losses(labels: list, mask: list, losses: list[float]) -> np.ndarray:
    """The losses of the places that count (unmasked, with a label); ids outside the vocabulary cost as much as one never met."""
    y, m = np.asarray(labels, np.int64), np.asarray(mask, float)
    y = y[(m > 0) & (y >= 0)]
    return np.append(losses, max(losses))[np.minimum(y, len(losses))]


def average(values: np.ndarray) -> float:
    """The mean to four places; 0 if there are no values."""
    return round(float(values.mean()), 4) if len(values) else 0.0


def hard_clusters(values: np.ndarray) -> list[int]:
    """The numbers of the groups of CLUSTER counted places whose mean loss is HARD or more."""
    return [k for k in range(-(-len(values) // CLUSTER)) if average(values[k * CLUSTER : (k + 1) * CLUSTER]) >= HARD]


def with_losses(built: DataFrame, losses: list[float]) -> DataFrame:
    """``built`` with ``avg_token_loss`` and ``high_ppl_clusters`` in place of ``labels`` and ``loss_mask``."""
    kept = [c for c in built.columns if c not in ("labels", "loss_mask")]
    out = T.StructType([*[built.schema[c] for c in kept], T.StructField("avg_token_loss", T.DoubleType()), T.StructField("high_ppl_clusters", T.ArrayType(T.IntegerType()))])
    schema = to_arrow_schema(out)

    def run(batches_):
        for batch in batches_:
            values = [token_losses(y or [], m or [], losses) for y, m in zip(batch.column("labels").to_pylist(), batch.column("loss_mask").to_pylist())]
            columns = [batch.column(c).cast(schema.field(c).type) for c in kept]
            yield pa.record_batch([*columns, pa.array(map(average, values), pa.float64()), pa.array([hard_clusters(v) for v in values], schema.field("high_ppl_clusters").type)], schema=schema)

    return built.mapInArrow(run, out)


def assigned_score(lane: Column) -> Column:
    """The selection score that a step takes for a lane where no text was scored."""
    told = F.lit(DEFAULT_SCORE)
    for name, score in LANE_SCORES.items():
        told = F.when(lane == name, score).otherwise(told)
    return told


def learning_rows(built: DataFrame, losses: list[float], order: list[str], by: list[str]) -> DataFrame:
    """Rows of the learning ledger for microbatches (``global_step``, ``shard_id``, ``sample_ids``, ``lane``, ``labels``, ``loss_mask``), without ids.

    ``loss_delta`` is the mean loss less that of the row before (by ``order``)
    of the same ``by``; there is no model here, so ``gradient_norm`` is null.
    """
    told = with_losses(built, losses)
    before = F.lag("avg_token_loss").over(Window.partitionBy(*by).orderBy(*order))
    return told.select(
        "global_step",
        "shard_id",
        F.get("sample_ids", F.lit(0)).alias("sample_id"),
        "lane",
        "avg_token_loss",
        "high_ppl_clusters",
        F.coalesce(F.round(F.col("avg_token_loss") - before, 4), F.lit(0.0)).alias("loss_delta"),
        F.lit(None).cast("double").alias("gradient_norm"),
        assigned_score(F.col("lane")).alias("opus_score"),
        F.lit(PHASE).alias("model_phase"),
        F.when(F.col("avg_token_loss") >= HARD, "high_value").otherwise("routine").alias("usefulness_classification"),
    )


def continued(ids: Column, steps: int) -> Column:
    """``ids`` and ``steps`` further ones by a fixed recurrence over the last id and the length; an empty list stays empty. A stand-in where no model can speak."""
    longer = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), ids, lambda a, _: F.array_append(a, ((F.element_at(a, -1) * 7 + F.size(a) * 13) % 250 + 5).cast("int")))
    return F.when(F.size(ids) > 0, longer).otherwise(ids)


def learn(packed: DataFrame, lanes: DataFrame, documents: DataFrame) -> DataFrame:
    """The learning ledger of packed sequences (``shard_id``, ``seq_no``, ``policy``, ``input_ids``, ``spans``); a shard's sequences of a policy are its steps."""
    rows = packed.select("shard_id", "seq_no", "policy", F.transform("spans", lambda s: s["doc_id"]).alias("sample_ids"), batches.labels(F.col("input_ids")).alias("labels"), batches.loss_mask(F.col("input_ids")).alias("loss_mask"))
    joined = rows.join(lanes.select("shard_id", "lane"), "shard_id", "left").withColumn("global_step", F.col("seq_no").cast("long"))
    keyed = joined.withColumn("shard_id", F.concat_ws("/", "shard_id", "policy"))
    return learning_rows(keyed, surprises(documents), ["global_step"], ["shard_id"])

