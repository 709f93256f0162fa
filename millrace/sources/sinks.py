"""Writing results: pools, manifests, ledgers and reports as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.ledger import CONSUMPTION, LEARNING, REQUIRED_STATES, append_numbered


def write_pools(curated: DataFrame, path: str) -> None:
    """Kept documents as JSON lines, a folder for each pool; a rerun replaces them."""
    kept = curated.where("drop_stage IS NULL").withColumn("pool", F.lower(F.split("domain", " ")[0]))
    kept.select(F.col("doc_id").alias("id"), "text", "domain", "pool").write.mode("overwrite").partitionBy("pool").json(path)


def write_manifests(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").json(path)


def read_manifests(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Manifests, one JSON object a file or a line, with a stated schema."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def append_ledger(spark: SparkSession, rows: DataFrame, path: str, order: list[str], schema: T.StructType = CONSUMPTION) -> None:
    """``rows`` appended to the ledger at ``path`` under ids that go on from its last. One writer at a time."""
    try:
        held = spark.read.schema(schema).parquet(path)
        held.limit(1).count()
    except Exception as problem:  # the first append finds no folder
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        held = spark.createDataFrame([], schema)
    numbered = append_numbered(held, rows, order)
    numbered.select(*[F.col(f.name).cast(f.dataType) if f.name in numbered.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]).write.mode("append").parquet(path)


def create_ledgers(spark: SparkSession, database: str = "default") -> None:
    """Both ledgers as empty tables, if they are not there yet."""
    for name, schema in (("microbatch_ledger", CONSUMPTION), ("learning_ledger", LEARNING)):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def export_jsonl(ledger: DataFrame, path: str) -> None:
    """A ledger as JSON lines in the order of ids, in as many files as it takes."""
    ledger.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").json(path)


def firewall_report(rules: DataFrame, audit: DataFrame) -> DataFrame:
    """One JSON row: the sorted rules and how many shards each reason met. The audit's rows are a table of their own."""
    lists = rules.agg(F.sort_array(F.collect_set(F.when(F.col("kind") == "dataset", F.col("blocked_id")))).alias("datasets"), F.sort_array(F.collect_set(F.when(F.col("kind") == "document", F.col("blocked_id")))).alias("documents"))
    counts = audit.groupBy("status", "reason").agg(F.count("*").alias("n")).agg(F.sort_array(F.collect_list(F.struct("status", "reason", "n"))).alias("audit"))
    return lists.join(counts).select(F.to_json(F.struct("datasets", "documents", "audit")).alias("json"))


def write_checkpoint(spark: SparkSession, payload: dict, path: str) -> None:
    """A checkpoint as one JSON object; an incomplete one is an error."""
    missing = [k for k in REQUIRED_STATES if k not in payload]
    if missing:
        raise ValueError(f"incomplete checkpoint, missing {missing}")
    import json

    spark.createDataFrame([(json.dumps(payload, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_checkpoint(spark: SparkSession, path: str) -> dict:
    """A checkpoint; FileNotFoundError if there is none, ValueError if it is incomplete."""
    import json

    try:
        rows = spark.read.text(path, wholetext=True).limit(2).collect()
    except Exception as problem:
        if "PATH_NOT_FOUND" in str(problem):
            raise FileNotFoundError(path) from None
        raise
    payload = json.loads(rows[0].value)
    missing = [k for k in REQUIRED_STATES if k not in payload]
    if missing:
        raise ValueError(f"incomplete checkpoint, missing {missing}")
    return payload


def log_contains(spark: SparkSession, path: str, mark: str) -> bool:
    """Whether a text log holds a mark anywhere."""
    return bool(spark.read.text(path).agg(F.bool_or(F.contains("value", F.lit(mark))).alias("found")).first().found)


def write_decisions(decisions: DataFrame, path: str) -> None:
    """Selection decisions as JSON lines; a rerun replaces them."""
    decisions.write.mode("overwrite").json(path)


def write_evidence(evidence: DataFrame, performance: DataFrame, folder: str) -> None:
    """``evidence`` as JSON and as Markdown, both from the same rows, and ``performance`` as JSON, each in a folder of ``folder``."""
    from millrace.operators.evidence import markdown

    evidence.coalesce(1).write.mode("overwrite").json(f"{folder}/evidence")
    markdown(evidence.sparkSession.read.schema(evidence.schema).json(f"{folder}/evidence")).coalesce(1).write.mode("overwrite").text(f"{folder}/evidence_md")
    performance.coalesce(1).write.mode("overwrite").json(f"{folder}/performance")


def write_fork(spark: SparkSession, parent: str, child: str, step: int, offset: int, path: str) -> None:
    """The record of a fork: both branches, the step and the ledger offset it begins after."""
    spark.createDataFrame([(parent, child, step, offset)], "parent_branch string, child_branch string, fork_step long, ledger_offset long").coalesce(1).write.mode("overwrite").json(path)


def read_lists(rows: DataFrame, column: str, kind: str) -> DataFrame:
    """``rows`` with a column of JSON text read as a list; text that is no such list gives null."""
    return rows.withColumn(column, F.from_json(column, kind))
