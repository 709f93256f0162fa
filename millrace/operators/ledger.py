"""Append-only ledgers: reading, appending, replaying, resuming, forking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import batches
from millrace.operators.tokenizer import PAD

SPAN = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("start_idx", T.IntegerType()), T.StructField("end_idx", T.IntegerType())])
_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
CONSUMPTION = T.StructType(
    [T.StructField(n, t, n in ("checkpoint_id", "opus_decision_id", "trace_id", "span_id")) for n, t in (
        ("id", _L), ("run_id", _S), ("branch_id", _S), ("global_step", _L), ("checkpoint_id", _S), ("rank", _I), ("microbatch_id", _S), ("packed_sample_ids", T.ArrayType(_S)), ("shard_ids", T.ArrayType(_S)), ("token_span_ids", T.ArrayType(SPAN)),
        ("loss_mask_hash", _S), ("mixture_lane", _S), ("curriculum_stage", _S), ("tokenizer_version", _S), ("dataloader_version", _S), ("opus_decision_id", _S), ("batch_hash", _S), ("trace_id", _S), ("span_id", _S),
    )]
)
LEARNING = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("id", _L), ("global_step", _L), ("shard_id", _S), ("sample_id", _S), ("lane", _S), ("avg_token_loss", _D), ("high_ppl_clusters", T.ArrayType(_I)), ("loss_delta", _D), ("gradient_norm", _D), ("opus_score", _D), ("model_phase", _S), ("usefulness_classification", _S),
    )]
)
REQUIRED_STATES = ("model_state", "optimizer_state", "scheduler_state", "rng_state", "dataloader_state", "ledger_offset")


def rows_between(ledger: DataFrame, first: int, last: int) -> DataFrame:
    """Rows with ids of ``first`` to ``last``, both included, in order; the bounds reach the scan."""
    return ledger.where(F.col("id").between(first, last)).orderBy("id")


def at_step(ledger: DataFrame, step: int, branch: str = "br_main") -> DataFrame:
    """The newest row of a step of a branch, or none."""
    return ledger.where((F.col("global_step") == step) & (F.col("branch_id") == branch)).orderBy(F.desc("id")).limit(1)


def latest_steps(ledger: DataFrame, keys: tuple[str, ...] = ("run_id", "branch_id", "global_step", "rank")) -> DataFrame:
    """Each step once, by its latest id."""
    last = ledger.groupBy(*keys).agg(F.max("id").alias("id")).select("id")
    return ledger.join(last, "id", "left_semi")


def max_offset(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("max_offset"))


def append_numbered(ledger: DataFrame, rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ids that go on from the ledger's last, densely, in the given order.

    Ids are dense without a global window: rows are sorted into ranges, ranges
    are counted, and a row's id is the count of the ranges before its own plus
    its place within it.
    """
    from millrace.session import checkpointed

    sorted_ = checkpointed(rows.drop("id").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = sorted_.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # One row for each range.
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    base = max_offset(ledger).first().max_offset
    numbered = sorted_.join(F.broadcast(offsets), "_part").withColumn("id", (F.lit(base) + F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("long"))
    return numbered.drop("_part", "_at", "_first", "_before")


def digest(ledger: DataFrame, first: int, last: int) -> DataFrame:
    """SHA-256 (16 hex digits) over the range's batch hashes in order; ``empty`` for no rows.

    A tree: the hashes of each 4,096 ids are hashed together, then those of each
    4,096 ranges, and so on for all levels that ids of 64 bits may need, so that
    no list is longer than that.
    """
    level = ledger.where(F.col("id").between(first, last)).select("id", F.coalesce("batch_hash", F.lit("")).alias("h"))
    for _ in range(6):
        told = level.groupBy(F.floor(F.col("id") / 4096).cast("long").alias("up")).agg(F.sort_array(F.collect_list(F.struct("id", "h"))).alias("r"))
        level = told.select(F.col("up").alias("id"), F.sha2(F.array_join(F.transform("r", lambda x: x["h"]), ""), 256).alias("h"))
    return level.agg(F.coalesce(F.substring(F.min("h"), 1, 16), F.lit("empty")).alias("digest"))


def flat_digest(ledger: DataFrame, first: int, last: int) -> DataFrame:
    """SHA-256 (16 hex digits) of the plain concatenation of the batch hashes; for short ranges."""
    told = ledger.where(F.col("id").between(first, last)).agg(F.sort_array(F.collect_list(F.struct("id", "batch_hash"))).alias("r"))
    return told.select(F.when(F.size("r") == 0, "empty").otherwise(F.substring(F.sha2(F.array_join(F.transform("r", lambda x: x["batch_hash"]), ""), 256), 1, 16)).alias("digest"))


def rebuild(ledger: DataFrame, documents: DataFrame, length: int = 2048, policy: str = "structure-preserving") -> DataFrame:
    """``id``, ``loss_mask_hash``, ``batch_hash`` built anew from the recorded spans and the documents' own tokens.

    A span's ids begin at its ``doc_start`` (0 where it records none) in the
    document as ``policy`` packs it: ended by EOD and cut by the isolating one.
    Only rows all of whose documents are there. Spans are exploded and joined by
    document, so a hot document is a matter for the join alone, whose skew
    adaptive execution splits. Of rows that name one document the least tokens
    count.
    """
    from millrace.operators.packing import with_eod

    fields = ledger.schema["token_span_ids"].dataType.elementType.names
    start = F.col("s.doc_start") if "doc_start" in fields else F.lit(0)
    wanted = ledger.select("id", "microbatch_id", F.posexplode("token_span_ids").alias("k", "s")).select("id", "microbatch_id", "k", "s.doc_id", "s.start_idx", "s.end_idx", F.coalesce(start, F.lit(0)).alias("doc_start"))
    tokens = documents.select("doc_id", "tokens").groupBy("doc_id").agg(F.min(F.coalesce("tokens", F.array().cast("array<int>"))).alias("tokens"))
    packed = with_eod(F.col("tokens"), length) if policy == batches.ISOLATING else F.col("tokens")
    found = wanted.join(tokens, "doc_id").select("id", "microbatch_id", "k", "doc_id", "start_idx", "end_idx", F.slice(packed, F.col("doc_start") + 1, F.greatest(F.col("end_idx") - F.col("start_idx"), F.lit(0))).alias("ids"))
    sizes = ledger.select("id", F.size("token_span_ids").alias("n"))
    gathered = found.groupBy("id", "microbatch_id").agg(F.sort_array(F.collect_list(F.struct("k", "doc_id", "start_idx", "end_idx", "ids"))).alias("p")).join(sizes, "id").where(F.size("p") == F.col("n"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    spans = F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start_idx"].alias("start_idx"), x["end_idx"].alias("end_idx")))
    rows = gathered.select("id", "microbatch_id", ids.alias("ids"), spans.alias("spans")).where(F.size("ids") <= length)
    rows = rows.select("id", "microbatch_id", F.concat("ids", F.array_repeat(F.lit(PAD), F.lit(length) - F.size("ids"))).alias("input_ids"), "spans")
    return batches.build(rows, F.col("microbatch_id")).select("id", "loss_mask_hash", "batch_hash")


def replay(ledger: DataFrame, documents: DataFrame, length: int = 2048, policy: str = "structure-preserving") -> DataFrame:
    """``id``, ``status``: ``same``, ``changed``, or ``missing`` where the documents are not there to rebuild the batch from."""
    made = rebuild(ledger, documents, length, policy).select("id", F.col("batch_hash").alias("made"))
    told = ledger.select("id", F.col("batch_hash").alias("recorded")).join(made, "id", "full_outer")
    return told.select("id", F.when(F.col("made").isNull(), "missing").when(F.col("made") == F.col("recorded"), "same").otherwise("changed").alias("status"))


def step_gaps(ledger: DataFrame) -> DataFrame:
    """Steps recorded more than once, and gaps before a step, of each run, branch and rank: ``run_id``, ``branch_id``, ``rank``, ``global_step``, ``copies``, ``gap``.

    The step before is found in chunks of 4,096 steps and, for the first of a
    chunk, from the last of the chunks before, so that a hot run is spread.
    """
    counts = ledger.groupBy("run_id", "branch_id", "rank", "global_step").agg(F.count("*").alias("copies")).withColumn("chunk", F.floor(F.col("global_step") / 4096))
    keys = ["run_id", "branch_id", "rank"]
    ends = counts.groupBy(*keys, "chunk").agg(F.max("global_step").alias("last"))
    earlier = ends.withColumn("earlier", F.lag("last").over(Window.partitionBy(*keys).orderBy("chunk"))).drop("last")
    own = counts.withColumn("before", F.lag("global_step").over(Window.partitionBy(*keys, "chunk").orderBy("global_step")))
    joined = own.join(earlier, [*keys, "chunk"])
    gap = F.col("global_step") - F.coalesce("before", "earlier") - 1
    return joined.select(*keys, "global_step", "copies", F.coalesce(gap, F.lit(0)).cast("long").alias("gap")).where("copies > 1 or gap > 0")


def branch_history(ledger: DataFrame, parent: str, child: str, offset: int) -> DataFrame:
    """A forked branch's history: the parent's rows up to the fork, then its own."""
    before = ledger.where((F.col("branch_id") == parent) & (F.col("id") <= offset))
    return before.unionByName(ledger.where(F.col("branch_id") == child))


def forks(ledger: DataFrame) -> DataFrame:
    """``run_id``, ``branch_id``, ``first_step``, ``first_id``, ``rows`` of each branch other than the main one."""
    return ledger.where(F.col("branch_id") != "br_main").groupBy("run_id", "branch_id").agg(F.min("global_step").alias("first_step"), F.min("id").alias("first_id"), F.count("*").alias("rows"))


def missing_states(state_names: Column) -> Column:
    """Names a checkpoint lacks, in their fixed order."""
    return F.array_except(F.array(*map(F.lit, REQUIRED_STATES)), F.coalesce(state_names, F.array().cast("array<string>")))


def checkpoint_id(step: Column, every: int = 5) -> Column:
    return F.when(step % every == 0, F.concat(F.lit("ckpt_"), step.cast("string")))


def lane_agreement(ledger: DataFrame, shards: DataFrame, lane_of) -> DataFrame:
    """Recorded lanes beside the lanes of the shards served: ``agrees``, ``rows``; a row agrees if one of its shards is of its lane."""
    served = ledger.select("id", lane_of(F.col("mixture_lane")).alias("lane"), F.explode("shard_ids").alias("shard_id"))
    own = shards.groupBy("shard_id").agg(F.max_by("capability_lane", "ingested_at").alias("l")).select("shard_id", lane_of(F.col("l")).alias("shard_lane"))
    told = served.join(own, "shard_id").groupBy("id").agg(F.max((F.col("lane").eqNullSafe(F.col("shard_lane"))).cast("int")).alias("agrees"))
    return told.groupBy((F.col("agrees") == 1).alias("agrees")).agg(F.count("*").alias("rows"))


def numbered(rows: DataFrame, by: str, order: str, chunk: Column, name: str) -> DataFrame:
    """``rows`` with their number (from 0) within ``by`` in the order of ``order``; ``chunk`` must not fall as ``order`` grows. Counts of chunks first, then places within a chunk."""
    keyed = rows.withColumn("_chunk", chunk)
    sizes = keyed.groupBy(by, "_chunk").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    placed = keyed.withColumn("_k", F.row_number().over(Window.partitionBy(by, "_chunk").orderBy(order)) - 1).join(before, [by, "_chunk"])
    return placed.withColumn(name, (F.col("_before") + F.col("_k")).cast("long")).drop("_chunk", "_before", "_k")


def training_steps(schedule: DataFrame, shards: DataFrame, documents: DataFrame, start: int, length: int = 512) -> DataFrame:
    """Consumption rows of a scheduled run: each step serves the next shard of its own lane, one microbatch for each packed sequence.

    ``schedule`` has ``step`` and ``lane``; ``shards`` has ``shard_id`` and
    ``lane``; steps of a lane go around its shards. Sequences of all steps are
    kept, not the first alone.
    """
    from millrace.operators import packing

    sizes = shards.groupBy("lane").agg(F.count("*").alias("n"))
    members = numbered(shards, "lane", "shard_id", F.substring("shard_id", 1, 8), "k")
    turns = numbered(schedule, "lane", "step", F.floor(F.col("step") / 4096), "turn").join(sizes, "lane").withColumn("k", F.pmod("turn", "n"))
    served = turns.join(members, ["lane", "k"]).select("step", "lane", "shard_id")
    packed = packing.pack(documents.join(served.select("shard_id").distinct(), "shard_id", "left_semi"), batches.ISOLATING, length)
    rows = served.join(packed, "shard_id")
    name = F.concat(F.lit("b_"), (F.col("step") + start).cast("string"), F.when(F.col("seq_no") > 0, F.concat(F.lit("_"), F.col("seq_no").cast("string"))).otherwise(F.lit("")))
    built = batches.build(rows, name)
    return built.select((F.col("step") + start).alias("global_step"), checkpoint_id(F.col("step") + start).alias("checkpoint_id"), "microbatch_id", F.col("sample_ids").alias("packed_sample_ids"), F.array("shard_id").alias("shard_ids"), F.col("spans").alias("token_span_ids"), "loss_mask_hash", F.col("lane").alias("mixture_lane"), "batch_hash", "utilization", "input_ids", "labels", "loss_mask")
