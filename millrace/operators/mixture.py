"""Shares of lanes in stages, token allocations, quotas, and the lane of each step."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# ---- fixed values: planned budgets in tokens --------------------------------
TOTAL_BUDGET = 100_000_000_000
LANES = {"general_web": 0.42, "code": 0.23, "math_reasoning": 0.15, "indic": 0.10, "agentic": 0.05, "long_context": 0.05}
GENERAL_SUBMIX = {"D1_knowledge": 0.295, "D3_general_web": 0.246, "D2_literature": 0.230, "D4_community": 0.230}
INDIC_TIERS = {"verified_native": 0.55, "unverified_native": 0.20, "translated": 0.15, "synthetic": 0.10}
EFFORT_BANDS = {"low": 0.40, "medium": 0.35, "high": 0.15, "ultra": 0.10}
AGENTIC_SOURCES = {"sourced": 0.30, "synthesized": 0.70}
FLOORS = {"indic": 0.08, "agentic": 0.03, "math_reasoning": 0.10}
ANNEAL_RESERVE, WARMUP = 0.15, 0.04
# ---------------------------------------------------------------------------
#: A stage with more lanes is refused; steps of a schedule that are given on at a time.
LANES_MOST, STEPS_AT_A_TIME = 100_000, 8_192


def _of_stage() -> Window:
    return Window.partitionBy("family", "stage")


def stage_ratios(stage_lanes: DataFrame) -> DataFrame:
    """Each lane's share of its stage, adding up to 1 but for rounding to four places. A stage has a handful of lanes."""
    total = F.sum("share").over(_of_stage())
    return stage_lanes.select("family", "stage", "pos", "lane", F.bround(F.col("share") / total, 4).alias("ratio"))


def token_allocations(stage_lanes: DataFrame, tokens: int) -> DataFrame:
    """Whole tokens of each lane; the last lane of a stage takes what rounding leaves."""
    ratios = stage_ratios(stage_lanes)
    own = F.floor(F.lit(tokens) * F.col("ratio")).cast("long")
    before = F.coalesce(F.sum(own).over(_of_stage().orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.col("pos") == F.max("pos").over(_of_stage())
    return ratios.select("family", "stage", "pos", "lane", F.when(last, F.lit(tokens) - before).otherwise(own).alias("tokens"))


def target_quotas(stage_lanes: DataFrame, n: int) -> DataFrame:
    """Whole items of each lane out of ``n``, each rounded down."""
    return stage_lanes.select("family", "stage", "pos", "lane", F.floor(F.col("share") * n).cast("long").alias("quota"))


def known_stage(stage_lanes: DataFrame, family: str, stage: str) -> list:
    """The lanes of one stage on the driver, in order; a stage has a handful. An unknown stage is an error."""
    rows = stage_lanes.where((F.col("family") == family) & (F.lower("stage") == stage.lower())).orderBy("pos").limit(LANES_MOST + 1).collect()
    if not rows:
        raise ValueError(f"unknown stage {stage!r} of family {family!r}")
    if len(rows) > LANES_MOST:
        raise ValueError(f"stage {stage!r} has more than {LANES_MOST} lanes")
    return rows


def schedule(stage_lanes: DataFrame, steps: int, family: str | None = None, served: dict[str, int] | None = None, first_step: int = 0) -> DataFrame:
    """``family``, ``stage``, ``step``, ``lane``: the lane most behind its target at each step.

    With nothing served the first lane is taken; then the first lane with the
    greatest target less its share of what was served. The choice depends on all
    choices before it, so a stage is one loop that gives its steps on as it
    goes and holds a count for each lane only; stages run apart. ``served``
    resumes a schedule where its ledger ends.
    """
    lanes = stage_lanes if family is None else stage_lanes.where(F.col("family") == family)
    stages = lanes.groupBy("family", "stage").agg(F.sort_array(F.collect_list(F.struct("pos", "lane", "share"))).alias("l"))
    before = dict(served or {})

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                names, shares = [x["lane"] for x in row["l"]], [x["share"] or 0.0 for x in row["l"]]
                counts = [before.get(n, 0) for n in names]
                total = sum(counts)
                for start in range(0, steps, STEPS_AT_A_TIME):
                    chosen = []
                    for _ in range(start, min(steps, start + STEPS_AT_A_TIME)):
                        behind = [s - c / total for s, c in zip(shares, counts)] if total else None
                        best = behind.index(max(behind)) if behind else 0
                        counts[best] += 1
                        total += 1
                        chosen.append(names[best])
                    n = len(chosen)
                    yield pa.record_batch([pa.array([row["family"]] * n, pa.string()), pa.array([row["stage"]] * n, pa.string()), pa.array(range(first_step + start, first_step + start + n), pa.int64()), pa.array(chosen, pa.string())], names=["family", "stage", "step", "lane"])

    return stages.mapInArrow(run, "family string, stage string, step long, lane string")


def sample_batch(members: DataFrame, stage_lanes: DataFrame, family: str, stage: str, batch: int, seed: int = 42) -> DataFrame:
    """``lane``, ``draw``, ``item_id``: a batch drawn with replacement, each lane's part by its share.

    ``members`` has ``lane`` and ``item_id``. A draw is a hash of seed, lane and
    number, taken modulo the lane's size, so that a rerun gives the same batch.
    Members are numbered within hashed chunks, not in one window over a lane.
    """
    lanes = known_stage(stage_lanes, family, stage)
    spark = members.sparkSession
    total = sum(r.share for r in lanes)
    wanted = spark.createDataFrame([(r.lane, max(1, int(batch * r.share / total))) for r in lanes], "lane string, want int")
    keyed = members.where(F.col("item_id").isNotNull()).select("lane", "item_id", F.substring(F.md5("item_id"), 1, 2).alias("chunk"))
    sizes = keyed.groupBy("lane", "chunk").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("lane").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = keyed.withColumn("k", F.row_number().over(Window.partitionBy("lane", "chunk").orderBy("item_id")) - 1).join(before, ["lane", "chunk"]).select("lane", "item_id", (F.col("before") + F.col("k")).alias("number"))
    counts = sizes.groupBy("lane").agg(F.sum("n").alias("size"))
    draws = wanted.join(counts, "lane").select("lane", "size", F.explode(F.sequence(F.lit(1), F.least("want", F.col("size").cast("int")))).alias("draw"))
    draws = draws.withColumn("order", F.md5(F.concat_ws("|", F.lit(seed), "lane", "draw")))
    draws = draws.withColumn("number", F.pmod(F.conv(F.substring("order", 1, 15), 16, 10).cast("long"), F.col("size")))
    drawn = draws.join(numbered, ["lane", "number"]).select("lane", "draw", "item_id", "order")
    return drawn.orderBy("order", "lane", "draw").limit(batch).drop("order")


def served_shares(served: DataFrame, by: list[str], lane: str = "lane") -> DataFrame:
    """Count and share of each lane in each group of ``by``; groups have a handful of lanes."""
    counts = served.groupBy(*by, lane).agg(F.count("*").alias("served"))
    return counts.withColumn("share", F.col("served") / F.sum("served").over(Window.partitionBy(*(by or [F.lit(1)]))))


def floor_report(shares: DataFrame, lane: str = "lane") -> DataFrame:
    """Shares of protected lanes beside their floors, and whether each is met."""
    floors = F.create_map(*[F.lit(x) for pair in FLOORS.items() for x in pair])
    return shares.where(F.col(lane).isin(*FLOORS)).withColumn("floor", F.element_at(floors, F.col(lane))).withColumn("met", F.col("share") >= F.col("floor"))


def budget(spark: SparkSession, total: int = TOTAL_BUDGET) -> DataFrame:
    """``part``, ``name``, ``share``, ``tokens``: the planned budget, its parts' own splits, reserve and warm-up."""
    lanes = {k: round(total * v) for k, v in LANES.items()}
    rows = [("lane", k, v, lanes[k]) for k, v in LANES.items()]
    for part, of, split in (("general_web", "general_web", GENERAL_SUBMIX), ("indic", "indic", INDIC_TIERS), ("math_reasoning", "math_reasoning", EFFORT_BANDS), ("agentic", "agentic", AGENTIC_SOURCES)):
        whole = sum(split.values())
        rows += [(part, k, v / whole, round(lanes[of] * v / whole)) for k, v in split.items()]
    reserve = [("verified_native", lanes["indic"] * INDIC_TIERS["verified_native"]), ("agentic", lanes["agentic"]), ("high_and_ultra", lanes["math_reasoning"] * (EFFORT_BANDS["high"] + EFFORT_BANDS["ultra"]))]
    rows += [("anneal_reserve", k, ANNEAL_RESERVE, round(ANNEAL_RESERVE * v)) for k, v in reserve]
    rows.append(("warmup", "all", WARMUP, round(total * WARMUP)))
    return spark.createDataFrame(rows, "part string, name string, share double, tokens long")
