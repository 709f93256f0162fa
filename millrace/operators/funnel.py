"""The curation funnel: each document's first failed test, and the counts of all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions.normalize import normalize
from millrace.functions.scoring import passes_quality
from millrace.operators.dedup import THRESHOLD, exact_classes, near_duplicates

STAGES = ("language_filter", "exact_dedup", "near_dedup_minhash", "heuristic_quality", "fineweb_ml_quality", "syntax_task_filter")


def curate(documents: DataFrame, near: bool = False, full_normalize: bool = True, threshold: float = THRESHOLD) -> DataFrame:
    """Each document with ``drop_stage`` (null if kept) and, if kept, its text and metadata.

    The tests are applied in order and the first that fails counts. Copies are
    looked for among the documents that pass the first test only; near
    duplicates (off unless ``near``) among those left then.
    """
    raw = documents.select("doc_id", "text")
    english = raw.withColumn("english", X.is_english(F.col("text")))
    copies = exact_classes(english.where("english")).select("doc_id", (F.col("class_id") != F.col("doc_id")).alias("copy"))
    rows = english.join(copies, "doc_id", "left")
    if near:
        left = rows.where(F.col("english") & ~F.col("copy"))
        told = near_duplicates(left.select("doc_id", "text"), threshold=threshold).select("doc_id", (~F.col("kept")).alias("near"))
        rows = rows.join(told, "doc_id", "left")
    else:
        rows = rows.withColumn("near", F.lit(False))
    plain = normalize(F.col("text")) if full_normalize else X.clean_space(F.col("text"))
    # Each text is cleaned once and tested once: the tests are bound to it, so that no filter that is
    # pushed down repeats the cleaning for each of them.
    left = F.col("english") & ~F.coalesce("copy", F.lit(False)) & ~F.coalesce("near", F.lit(False))

    def tests(p: Column) -> Column:
        failed = F.when(~X.passes_heuristics(p), STAGES[3]).when(~passes_quality(p), STAGES[4]).when(~X.passes_task_filter(p), STAGES[5])
        return X.once(failed, lambda stage: F.struct(stage.alias("stage"), F.when(stage.isNull(), p).alias("plain")))

    told = rows.select("doc_id", "english", "copy", "near", F.when(left, X.once(plain, tests)).alias("t"))
    stage = F.when(~F.col("english"), STAGES[0]).when(F.coalesce("copy", F.lit(False)), STAGES[1]).when(F.coalesce("near", F.lit(False)), STAGES[2]).otherwise(F.col("t.stage"))

    def finished(c: Column) -> Column:
        return F.struct(c.alias("text"), X.domain(c).alias("d"), F.size(X.words(c)).alias("word_count"), F.length(c).alias("char_count"))

    kept = F.col("t.plain").isNotNull()
    done = told.select("doc_id", stage.alias("drop_stage"), F.when(kept, X.once(X.redact(F.col("t.plain")), finished)).alias("c"), F.col("t.plain").alias("plain"))
    return done.select("doc_id", "drop_stage", "c.text", "c.d.domain", "c.d.confidence", "c.word_count", "c.char_count", F.coalesce(F.col("c.text") != F.col("plain"), F.lit(False)).alias("redacted"))


def summary(curated: DataFrame) -> DataFrame:
    """One row of counts and shares; of an empty input, ``total_input_docs`` is 1, so that shares are defined."""
    dropped: list[Column] = [F.count_if(F.col("drop_stage") == s).alias(s) for s in STAGES]
    counts = curated.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("drop_stage").isNull()).alias("kept"),
        F.count_if(F.col("redacted")).alias("redacted_docs"),
        *dropped,
    )
    total = F.greatest(F.lit(1).cast("long"), F.col("n"))
    return counts.select(
        total.alias("total_input_docs"),
        F.col("kept").alias("retained_docs"),
        F.bround(F.col("kept") / total * 100, 2).alias("yield_percentage"),
        F.bround((total - F.col("kept")) / total * 100, 2).alias("noise_filtered_pct"),
        *STAGES,
        F.col("kept").alias("stage7_pii_redacted"),
        "redacted_docs",
    )


def domain_pools(curated: DataFrame) -> DataFrame:
    """Kept documents by domain and the pool file each goes to."""
    # The condition is on the counts: one on the rows would be pushed down and have the tests run twice.
    counts = curated.groupBy("domain").agg(F.count_if(F.col("drop_stage").isNull()).alias("documents")).where("documents > 0")
    return counts.select("domain", F.lower(F.split("domain", " ")[0]).alias("pool"), "documents")
