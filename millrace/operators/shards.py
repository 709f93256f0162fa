"""Shards: content hashes, manifests, the admission gate and the evaluation firewall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import tokenizer

# ---- fixed values ---------------------------------------------------------
CLEANING_NAME = "v5_cleaning_v1"
BLOCKED = ("eval_benchmark_v1", "gsm8k_eval", "mmlu_eval", "eval_003")
TAINTED = ("overlap", "tainted", "flagged", "true")
SYNTHETIC_LANES = [("code", "code-python", "commercial"), ("reasoning", "en-US", "permissive-v1"), ("indic", "hi-IN", "permissive-v1"), ("general", "en-US", "permissive-v1")]
# ---------------------------------------------------------------------------


def cleaning_hash() -> Column:
    return F.substring(F.sha2(F.lit(CLEANING_NAME), 256), 1, 16)


def synthetic_shards(spark: SparkSession, count: int = 24, docs: int = 5) -> DataFrame:
    """Document rows of deterministic shards whose lanes take turns: ``shard_id``, ``pos``, ``doc_id``, ``text``, ``tokens``, lane and provenance."""
    lanes = F.array(*[F.struct(F.lit(a).alias("lane"), F.lit(b).alias("script"), F.lit(c).alias("tier")) for a, b, c in SYNTHETIC_LANES])
    rows = spark.range(1, count + 1).select(F.format_string("shard_%04d", "id").alias("shard_id"), F.element_at(lanes, (F.pmod(F.col("id") - 1, F.lit(len(SYNTHETIC_LANES))) + 1).cast("int")).alias("l"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(docs))).alias("pos"))
    text = F.format_string("Synthetic training text for %s document %d in lane %s. Standard content with detailed logic patterns.", "shard_id", "pos", "l.lane")
    rows = rows.select("shard_id", "pos", F.format_string("doc_%s_%02d", "shard_id", "pos").alias("doc_id"), text.alias("text"), F.col("l.lane").alias("capability_lane"), F.col("l.script").alias("language_script"), F.col("l.tier").alias("license_provenance_tier"))
    return rows.withColumn("tokens", tokenizer.encode(F.col("text"), add_eod=True))


def latest_shards(shards: DataFrame) -> DataFrame:
    """Each shard once, by its latest record."""
    others = [c for c in shards.columns if c != "shard_id"]
    return shards.where(F.col("shard_id").isNotNull()).groupBy("shard_id").agg(F.max_by(F.struct(*others), F.struct("ingested_at", "content_hash")).alias("r")).select("shard_id", *[F.col(f"r.{c}").alias(c) for c in others])


def content_hashes(documents: DataFrame, shards: DataFrame) -> DataFrame:
    """``shard_id``, ``content_hash``, ``documents``, ``tokens``: SHA-256 over the shard's id, lane and overlap flag and each document's id and big-endian tokens, in order.

    A shard holds a bounded number of documents, so its bytes fit one row.
    """
    once = documents.select("shard_id", "pos", "doc_id", "tokens").distinct()
    body = F.concat(F.hex(F.encode("doc_id", "UTF-8")), F.array_join(F.transform("tokens", lambda t: F.lpad(F.hex(t), 8, "0")), ""))
    gathered = once.groupBy("shard_id").agg(F.sort_array(F.collect_list(F.struct("pos", "doc_id", body.alias("body")))).alias("d"), F.count("*").alias("documents"), F.sum(F.size("tokens")).alias("tokens"))
    flagged = shards.select("shard_id", "capability_lane", F.when(F.col("eval_overlap_status"), "True").otherwise("False").alias("flag"))
    head = F.hex(F.encode(F.concat("shard_id", F.coalesce("capability_lane", F.lit("")), "flag"), "UTF-8"))
    whole = F.concat(head, F.array_join(F.transform("d", lambda x: x["body"]), ""))
    return gathered.join(flagged, "shard_id").select("shard_id", F.sha2(F.unhex(whole), 256).alias("content_hash"), "documents", F.col("tokens").cast("long").alias("tokens"))


def manifests(documents: DataFrame, shards: DataFrame, tokenizer_hash: str | None = None) -> DataFrame:
    """One manifest row for each shard with documents."""
    once = documents.select("shard_id", "pos", "doc_id").distinct()
    ids = once.groupBy("shard_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "doc_id"))), lambda x: x["doc_id"]).alias("document_ids"))
    empty = F.array().cast("array<string>")
    return ids.join(shards, "shard_id").select(
        "shard_id",
        F.col("document_ids").alias("source_ids"),
        "document_ids",
        F.lit(tokenizer_hash or tokenizer.version_hash()).alias("tokenizer_hash"),
        "token_count",
        "language_script",
        "capability_lane",
        "license_provenance_tier",
        F.col("license_provenance_tier").alias("license_tier"),
        "cleaning_pipeline_hash",
        "dedup_status",
        F.lit("screened").alias("pii_screen_status"),
        "contamination_status",
        F.when(F.col("eval_overlap_status"), "overlap").otherwise("clear").alias("eval_overlap_status"),
        "content_hash",
        F.coalesce("parent_shard_ids", empty).alias("parent_shard_ids"),
        F.coalesce("parent_shard_ids", empty).alias("parent_manifest_ids"),
        F.lit(None).cast("boolean").alias("never_train_flag"),
    )


def register(rules: DataFrame, kind: str, blocked_id: str) -> DataFrame:
    """The rules with one more blocked dataset or document."""
    return rules.unionByName(rules.sparkSession.createDataFrame([(kind, blocked_id)], "kind string, blocked_id string")).distinct()


def firewall(manifest: DataFrame, rules: DataFrame) -> DataFrame:
    """``manifest`` with ``fw_status``, ``fw_reason`` and ``fw_doc_id``: flag first, then a blocked shard id, then a blocked document.

    Blocked documents are looked up by an exploded equi-join and combined per
    shard, so the registry may be of any size.
    """
    blocked = rules.where(F.col("blocked_id").isNotNull()).select("kind", "blocked_id").distinct()
    names = blocked.where("kind = 'dataset'").select(F.col("blocked_id").alias("shard_id"), F.lit(True).alias("_named"))
    docs = blocked.where("kind = 'document'").select(F.col("blocked_id").alias("_doc"))
    hits = manifest.select("shard_id", F.explode("document_ids").alias("_doc")).join(docs, "_doc").groupBy("shard_id").agg(F.min("_doc").alias("_doc"))
    flag = F.coalesce("never_train_flag", F.lit(False)) | F.lower("eval_overlap_status").isin(*TAINTED)
    named = F.coalesce("_named", F.lit(False)) | F.col("shard_id").isin(*BLOCKED)
    reason = F.when(flag, "never_train_flag").when(named, "registered_eval_shard_id").when(F.col("_doc").isNotNull(), "registered_eval_doc_id").otherwise("clean")
    joined = manifest.join(names, "shard_id", "left").join(hits, "shard_id", "left").withColumn("fw_reason", reason)
    return joined.withColumn("fw_status", F.when(F.col("fw_reason") == "clean", "admitted").otherwise("blocked")).withColumn("fw_doc_id", F.when(F.col("fw_reason") == "registered_eval_doc_id", F.col("_doc"))).drop("_named", "_doc")


def admission(manifest: DataFrame, rules: DataFrame, expected_hash: str | None = None, strict: bool = False) -> DataFrame:
    """``shard_id``, ``admitted``, ``reason``: tokenizer, firewall, contamination, deduplication, in this order. ``strict`` asks for a license and a clean lineage as well."""
    expected = expected_hash or tokenizer.version_hash()
    checked = firewall(manifest, rules)
    got = F.coalesce(F.substring("tokenizer_hash", 1, 8), F.lit("None"))
    reason = (
        F.when(~F.col("tokenizer_hash").eqNullSafe(F.lit(expected)), F.concat(F.lit(f"tokenizer_hash_mismatch (expected {expected[:8]}, got "), got, F.lit(")")))
        .when(F.col("fw_reason") != "clean", F.col("fw_reason"))
        .when(~F.col("contamination_status").eqNullSafe(F.lit("clean")), "contaminated")
        .when(~F.coalesce(F.contains("dedup_status", F.lit("passed")), F.lit(False)), "dedup_not_passed")
    )
    if strict:
        reason = reason.when(F.col("license_tier").isNull(), "license_missing").when(F.array_contains(F.coalesce("parent_shard_ids", F.array().cast("array<string>")), F.col("shard_id")), "lineage_loop")
    told = checked.withColumn("reason", F.coalesce(reason, F.lit("admitted")))
    return told.select("shard_id", (F.col("reason") == "admitted").alias("admitted"), "reason")


def audit(manifest: DataFrame, rules: DataFrame, expected_hash: str | None = None) -> DataFrame:
    """``shard_id``, ``status``, ``reason``, ``doc_id`` of each shard that came to the firewall; a wrong tokenizer is turned away before it."""
    expected = expected_hash or tokenizer.version_hash()
    return firewall(manifest.where(F.col("tokenizer_hash") == expected), rules).select("shard_id", F.col("fw_status").alias("status"), F.col("fw_reason").alias("reason"), F.col("fw_doc_id").alias("doc_id"))
