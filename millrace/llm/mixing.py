"""Problem 4: mixing sources to target weights.

A stage's tokens are dealt into slots of equal size. The golden-ratio sequence
maps each slot to a point in [0, 1), and the cumulative shares map the point to
a lane, so that every stretch of the schedule holds every lane close to its
share. Slots are ranked within their lane; the lane's shards, in a shuffled
order that is run through again up to ``max_repeats`` times, form a stream that
is cut into blocks of the same size; block k meets the lane's slot of rank k. A
row is the piece of a shard that lies in one block.

Where a lane's repeats do not suffice for its share of the total, ``when_short``
says what gives way: ``keep`` takes all the lane may give and leaves the other
lanes their tokens (the total falls), ``fill`` deals what is missing to the
other lanes by their shares (the total stays as far as they can), ``scale``
takes less of all lanes (the shares stay). The schedule is made for what is
taken, so a short lane is spread over all of it and does not run dry.

Ranks and running sums go over two levels (sums of chunks first, then within
the chunk), so that no lane's slots or shards come together in one task.

Defined results: a shard recorded more than once counts once, by its latest
record with a positive ``token_count``; shards without such a count, or of no
lane the stage names, cannot be taken; lane names are compared without case,
spaces, ``-`` or ``_``, and through ``aliases``; an empty table gives an empty
selection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of one lane in the two families of stages.
ALIASES = {"general": "general_web", "reasoning": "math_reasoning"}
BLOCK_TOKENS = 4096
CHUNK_SLOTS = 1 << 14
ORDER_CHUNKS = 256
STAGE_ROWS_MOST = 10_000
WHEN_SHORT = ("keep", "fill", "scale")
GOLDEN = 0.6180339887498949


def lane_of(column: Column) -> Column:
    """The lane a written name means; null for null and blank."""
    plain = F.regexp_replace(F.lower(F.trim(column)), "[\\s_-]+", "_")
    for name, means in ALIASES.items():
        plain = F.when(plain == name, means).otherwise(plain)
    return F.when(plain != "", plain)


def distinct_shards(shards: DataFrame) -> DataFrame:
    """``shard_id``, ``lane``, ``tokens`` of each shard once."""
    latest = F.max_by(F.struct("token_count", "capability_lane"), F.struct((F.coalesce("token_count", F.lit(0)) > 0), F.col("ingested_at"), F.col("token_count"), F.col("capability_lane")))
    return (
        shards.where(F.col("shard_id").isNotNull())
        .groupBy("shard_id")
        .agg(latest.alias("r"))
        .select("shard_id", lane_of(F.col("r.capability_lane")).alias("lane"), F.greatest(F.coalesce("r.token_count", F.lit(0)), F.lit(0)).cast("long").alias("tokens"))
    )


def targets(stage_lanes: DataFrame) -> list[dict]:
    """The stages' lanes as rows on the driver: a fixed table of a few dozen rows, whose size is checked."""
    rows = stage_lanes.select("family", "stage", "pos", "lane", "share", "max_repeats").distinct().limit(STAGE_ROWS_MOST + 1).collect()
    if len(rows) > STAGE_ROWS_MOST:
        raise ValueError(f"stage_lanes has more than {STAGE_ROWS_MOST} rows")
    by: dict[tuple, list] = {}
    for r in sorted(rows, key=lambda r: (r.family, r.stage, r.pos)):
        by.setdefault((r.family, r.stage), []).append(r)
    found = []
    for (family, stage), lanes in by.items():
        total = sum(r.share or 0 for r in lanes)
        for r in lanes:
            lane = "_".join((r.lane or "").strip().lower().replace("-", " ").replace("_", " ").split())
            found.append({"family": family, "stage": stage, "named": r.lane, "lane": ALIASES.get(lane, lane), "share": (r.share or 0) / total if total else 0.0, "max_repeats": int(r.max_repeats or 0)})
    return found


def dealt_tokens(lanes: list[dict], held: dict[str, int], total: int, when_short: str = "keep") -> list[int]:
    """The tokens to take of each of a stage's lanes."""
    if when_short not in WHEN_SHORT:
        raise ValueError(f"unknown way {when_short!r}; known are {WHEN_SHORT}")
    goals = [s["share"] * total for s in lanes]
    most = [s["max_repeats"] * held.get(s["lane"], 0) for s in lanes]
    if when_short == "scale":
        part = min([1.0, *(m / g for m, g in zip(most, goals) if g > 0)])
        return [int(g * part) for g in goals]
    taken = [min(g, m) for g, m in zip(goals, most)]
    if when_short == "fill":
        # Each round, at least one more lane is full; the rest is dealt by the shares of those that are not.
        for _ in lanes:
            missing = total - sum(taken)
            free = [k for k in range(len(lanes)) if taken[k] < most[k] and goals[k] > 0]
            if missing < 1 or not free:
                break
            whole = sum(goals[k] for k in free)
            for k in free:
                taken[k] = min(most[k], taken[k] + missing * goals[k] / whole)
    return [int(t) for t in taken]


def slots(stages: list[dict], block: int, spark) -> DataFrame:
    """``family``, ``stage``, ``lane``, ``slot``, ``rank`` (from 0, within the lane) for stages with the ``take`` (tokens) of each lane."""
    ladder: dict[tuple, list] = {}
    for s in stages:
        ladder.setdefault((s["family"], s["stage"]), []).append(s)
    counts = {key: -(-sum(s["take"] for s in lanes) // block) for key, lanes in ladder.items()}
    points = spark.range(max(counts.values(), default=0)).select(F.col("id").alias("slot"), (F.col("id").cast("double") * GOLDEN + 0.5 - F.floor(F.col("id").cast("double") * GOLDEN + 0.5)).alias("point"))
    choices = []
    for (family, stage), lanes in ladder.items():
        total, upto = sum(s["take"] for s in lanes), sum(s["take"] for s in lanes)
        lane = F.lit(None).cast("string")
        for s in reversed([s for s in lanes if s["take"]]):
            lane = F.lit(s["lane"]) if upto == total else F.when(F.col("point") < upto / total, F.lit(s["lane"])).otherwise(lane)
            upto -= s["take"]
        choices.append(F.struct(F.lit(family).alias("family"), F.lit(stage).alias("stage"), F.lit(counts[family, stage]).alias("slots"), lane.alias("lane")))
    if not choices:
        return spark.createDataFrame([], "family string, stage string, lane string, slot long, rank long")
    dealt = points.select("slot", F.floor(F.col("slot") / CHUNK_SLOTS).alias("chunk"), F.explode(F.array(*choices)).alias("c")).select("slot", "chunk", "c.*").where("slot < slots").drop("slots")
    within = F.row_number().over(Window.partitionBy("family", "stage", "lane", "chunk").orderBy("slot")) - 1
    sums = dealt.groupBy("family", "stage", "lane", "chunk").agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("family", "stage", "lane").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("family", "stage", "lane", "chunk", earlier.alias("before"))
    ranked = dealt.withColumn("within", within).join(offsets, ["family", "stage", "lane", "chunk"])
    return ranked.select("family", "stage", "lane", "slot", (F.col("before") + F.col("within")).cast("long").alias("rank"))


def select_shards(shards: DataFrame, stage_lanes: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = 17, when_short: str = "keep") -> DataFrame:
    """The selection: ``family``, ``stage``, ``lane`` (as the stage names it), ``slot``, ``shard_id``, ``take`` (from 1), ``first_token`` (from 0, in the shard) and ``tokens`` of the piece."""
    spark = shards.sparkSession
    stages = targets(stage_lanes)
    once = distinct_shards(shards)
    # One row for each lane that a stage names, and the total: a few dozen numbers.
    names = sorted({s["lane"] for s in stages})
    own = F.coalesce(F.when(F.col("lane").isin(names), F.col("lane")), F.lit(""))
    sums = {r.lane: int(r.tokens) for r in once.groupBy(own.alias("lane")).agg(F.sum("tokens").alias("tokens")).collect()}
    total = sum(sums.values())
    by: dict[tuple, list] = {}
    for s in stages:
        by.setdefault((s["family"], s["stage"]), []).append(s)
    for lanes in by.values():
        for s, take in zip(lanes, dealt_tokens(lanes, sums, total, when_short)):
            s["take"] = take
    plan = [(s["family"], s["stage"], s["lane"], s["named"], sums[s["lane"]], -(-s["take"] // sums[s["lane"]]), s["take"]) for s in stages if s["take"]]
    goals = spark.createDataFrame(plan, "family string, stage string, lane string, named string, held long, takes int, wanted long")
    order = F.xxhash64(F.lit(seed), "shard_id")
    keyed = once.where("tokens > 0 and lane is not null").withColumn("order", order).withColumn("chunk", F.pmod("order", F.lit(ORDER_CHUNKS)))
    chunks = keyed.groupBy("lane", "chunk").agg(F.sum("tokens").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("lane").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = chunks.select("lane", "chunk", earlier.alias("before"))
    inner = F.coalesce(F.sum("tokens").over(Window.partitionBy("lane", "chunk").orderBy("order", "shard_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = keyed.withColumn("inner", inner).join(offsets, ["lane", "chunk"]).select("shard_id", "lane", "tokens", (F.col("before") + F.col("inner")).alias("start"))
    # The goals are the stages' lanes, of which there are at most STAGE_ROWS_MOST.
    copies = placed.join(F.broadcast(goals), "lane").withColumn("take", F.explode(F.sequence(F.lit(1), F.col("takes"))))
    first = (F.col("take") - 1).cast("long") * F.col("held") + F.col("start")
    after = F.least(first + F.col("tokens"), F.col("wanted"))
    ends = copies.withColumn("first", first).withColumn("after", after).where("first < after")
    pieces = ends.withColumn("rank", F.explode(F.sequence(F.floor(F.col("first") / block_tokens), F.floor((F.col("after") - 1) / block_tokens))))
    begin, end = F.greatest("first", F.col("rank") * block_tokens), F.least("after", (F.col("rank") + 1) * block_tokens)
    blocks = pieces.select("family", "stage", "lane", "named", "rank", "shard_id", "take", (begin - F.col("first")).alias("first_token"), (end - begin).alias("tokens"))
    taken = blocks.join(slots(stages, block_tokens, spark), ["family", "stage", "lane", "rank"])
    return taken.select("family", "stage", F.col("named").alias("lane"), "slot", "shard_id", "take", "first_token", "tokens")


def recorded_shares(ledger: DataFrame) -> DataFrame:
    """``stage``, ``lane``, ``recorded_tokens``, ``recorded_share`` of a ledger's steps, each step once by its latest id."""
    spans = F.aggregate(F.coalesce("token_span_ids", F.array()), F.lit(0).cast("long"), lambda a, s: a + F.greatest(s["end_idx"] - s["start_idx"], F.lit(0)))
    steps = ledger.select("run_id", "branch_id", "global_step", "rank", "id", F.col("curriculum_stage").alias("stage"), lane_of(F.col("mixture_lane")).alias("lane"), spans.alias("n"))
    once = steps.groupBy("run_id", "branch_id", "global_step", "rank").agg(F.max_by(F.struct("stage", "lane", "n"), "id").alias("r")).select("r.*")
    by = once.groupBy("stage", "lane").agg(F.sum("n").alias("recorded_tokens"))
    # One row for each stage and lane name.
    return by.withColumn("recorded_share", F.col("recorded_tokens") / F.sum("recorded_tokens").over(Window.partitionBy("stage")))


def shares(shards: DataFrame, stage_lanes: DataFrame, ledger: DataFrame, block_tokens: int = BLOCK_TOKENS, when_short: str = "keep") -> DataFrame:
    """Target, actual and recorded share of each lane of each stage, with the tokens taken and the most often a shard was."""
    stages = targets(stage_lanes)
    spark = shards.sparkSession
    rows = spark.createDataFrame([(s["family"], s["stage"], s["named"], s["lane"], s["share"], s["max_repeats"]) for s in stages], "family string, stage string, lane string, means string, target_share double, max_repeats int")
    taken = select_shards(shards, stage_lanes, block_tokens, when_short=when_short).groupBy("family", "stage", "lane").agg(F.sum("tokens").alias("tokens"), F.max("take").alias("most_takes"))
    told = recorded_shares(ledger).withColumnRenamed("lane", "means")
    of = Window.partitionBy("family", "stage")
    return (
        rows.join(taken, ["family", "stage", "lane"], "left")
        .join(told, ["stage", "means"], "left")
        .withColumn("tokens", F.coalesce("tokens", F.lit(0).cast("long")))
        .withColumn("actual_share", F.when(F.sum("tokens").over(of) > 0, F.col("tokens") / F.sum("tokens").over(of)))
        .select("family", "stage", "lane", "target_share", "tokens", "actual_share", "most_takes", "max_repeats", "recorded_tokens", "recorded_share")
    )
