"""Streams give what the same operators give on the whole table."""

import hashlib

from millrace.plans import execution
from millrace.streaming import streams


def test_streams_match_batches(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"t{k % 4}", f"2025-01-01 00:{k:02d}:00") for k in range(20)], "doc_id long, text string, at string").selectExpr("doc_id", "text", "to_timestamp(at) AS ingested_at")
    path = str(tmp_path / "in")
    rows.repartition(4).write.parquet(path)
    stream = streams.read_stream(spark, path, rows.schema)
    first = streams.to_table(streams.first_copies(stream).select("text"), "first_copies_test")
    assert sorted(r.text for r in first.collect()) == ["t0", "t1", "t2", "t3"]
    counts = streams.counted_table(streams.lane_counts(streams.read_stream(spark, path, rows.schema), "text", "ingested_at"), "lane_counts_test", ["start", "end", "lane"])
    got = {(r.start.minute, r.lane): r.served for r in counts.collect()}
    assert got == {(10 * half, f"t{k}"): sum(n % 4 == k for n in range(10 * half, 10 * half + 10)) for half in (0, 1) for k in range(4)}


def test_stream_appends_once(spark, tmp_path):
    rows = spark.range(12).selectExpr("'r' AS run_id", "'br_main' AS branch_id", "id AS global_step", "0 AS rank")
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "ledger", "check"))
    rows.repartition(3).write.parquet(source)
    for _ in range(2):
        streams.append_stream(spark, streams.read_stream(spark, source, rows.schema), target, ["global_step"], checkpoint).awaitTermination()
    held = spark.read.parquet(target)
    assert held.count() == 12 and held.selectExpr("max(id)").first()[0] == 12


def test_a_batch_that_comes_again_replaces_its_own_rows(spark, tmp_path):
    rows = spark.range(12).selectExpr("'r' AS run_id", "'br_main' AS branch_id", "id AS global_step", "0 AS rank")
    source, target = str(tmp_path / "in"), str(tmp_path / "ledger")
    rows.repartition(3).write.parquet(source)
    # A lost checkpoint stands for a crash between the writing of a batch and its being noted.
    for name in ("first", "second"):
        streams.append_stream(spark, streams.read_stream(spark, source, rows.schema), target, ["global_step"], str(tmp_path / name)).awaitTermination()
        held = spark.read.parquet(target)
        assert sorted(r.id for r in held.collect()) == list(range(1, 13)) and held.select("global_step").distinct().count() == 12


def test_late_rows_of_windows_are_not_counted(spark, tmp_path):
    path = str(tmp_path / "in")
    for k, at in enumerate(("2025-01-02 00:00:00", "2025-01-02 00:05:00", "2025-01-01 00:00:00")):
        spark.createDataFrame([(k, "code", at)], "id long, lane string, at string").selectExpr("id", "lane", "to_timestamp(at) AS recorded_at").coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    counted = lambda delay, name: sorted((r.start.day, r.served) for r in streams.counted_table(streams.lane_counts(streams.read_stream(spark, path, schema), "lane", "recorded_at", delay=delay), name, ["start", "end", "lane"]).collect())
    assert counted("3 days", "on_time") == [(1, 1), (2, 2)]
    assert counted("1 hour", "late") == [(2, 2)]


def test_late_rows_of_later_files_are_kept(spark, tmp_path):
    """The first file is weeks ahead of the others, whose rows are all late; one text comes in every file."""
    path = str(tmp_path / "documents.parquet")
    for part in range(4):
        at = "2025-02-15" if part == 0 else "2025-01-06"
        rows = [(part * 10 + k, f"text {part} {k}" if k else "everywhere", f"{at} 00:00:00") for k in range(5)]
        spark.createDataFrame(rows, "doc_id long, text string, at string").selectExpr("doc_id", "text", "to_timestamp(at) AS ingested_at").coalesce(1).write.mode("append").parquet(path)
    texts = {"everywhere"} | {f"text {part} {k}" for part in range(4) for k in range(1, 5)}
    got = [r.digest for r in execution.stream_first_copies(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(hashlib.md5(t.encode()).hexdigest() for t in texts)
