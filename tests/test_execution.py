"""Tokenizer, shards, mixtures, selection, packing, batches and ledgers against golden values."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import batches, evidence, learning, ledger, mixture, packing, selection, shards, tokenizer
from millrace.sources import sinks

TARGETS = [("code", 0.30), ("reasoning", 0.45), ("indic", 0.10), ("general", 0.15)]


@pytest.fixture(scope="module")
def synthetic(spark):
    return shards.synthetic_shards(spark).cache()


@pytest.fixture(scope="module")
def shard_rows(synthetic):
    return synthetic.groupBy("shard_id").agg(F.first("capability_lane").alias("capability_lane"), F.lit(False).alias("eval_overlap_status"), F.sum(F.size("tokens")).cast("int").alias("token_count"), F.first("language_script").alias("language_script"), F.first("license_provenance_tier").alias("license_provenance_tier"), F.lit("x").alias("cleaning_pipeline_hash"), F.lit("passed_exact_and_near_dedup").alias("dedup_status"), F.lit("clean").alias("contamination_status"), F.lit("h").alias("content_hash"), F.array().cast("array<string>").alias("parent_shard_ids"))


def test_vocabulary_and_version():
    assert len(tokenizer.vocabulary()) + len(tokenizer.SPECIAL) == 279
    assert tokenizer.version_hash() == "80434dabb627f9e630a903559056b62c5fb3dfea1d658828793cee84ab00bec2"


def plain_bpe(text):
    held = {t: i for i, t in tokenizer.vocabulary().items()}
    ranks = {pair: k for k, pair in enumerate(tokenizer.MERGES) if pair[0] in held and pair[1] in held and pair[0] + pair[1] in held}
    parts = [bytes([b]) for b in text.encode()]
    while True:
        options = [(ranks[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        if not options:
            return [held[p] for p in parts]
        _, k = min(options)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_encode_matches_the_definition(spark):
    random.seed(3)
    texts = ["The quick brown fox jumps over 123 lazy dogs! Deterministic tokenizer test.", "<EOD>", "", None, "ersersthethering", "héllo नमस्ते"] + ["".join(random.choice("thernaiosdug ") for _ in range(40)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    rows = df.select("k", "t", tokenizer.encode(F.col("t")).alias("ids"), tokenizer.decode(tokenizer.encode(F.col("t"))).alias("back")).collect()
    for r in rows:
        assert list(r.ids) == plain_bpe(r.t or "")
        assert r.back == (r.t or "")


def test_decode_leaves_broken_bytes_out(spark):
    got = spark.createDataFrame([([0xE0 + 5, 0x61 + 5, 3, 9999],)], "ids array<int>").select(tokenizer.decode(F.col("ids")).alias("t")).first().t
    assert got == "a"


def test_content_hashes_are_golden(synthetic, shard_rows):
    got = {r.shard_id: r.content_hash[:16] for r in shards.content_hashes(synthetic, shard_rows).collect()}
    assert got["shard_0001"] == "e8276c60dff3af9c" and got["shard_0002"] == "0f9dbf35d1ee0a70" and got["shard_0024"] == "509f49ee988a3598"


def test_gate_and_firewall(spark, synthetic, shard_rows):
    rules = spark.createDataFrame([("dataset", "shard_0003"), ("document", "doc_shard_0005_02"), ("document", "doc_shard_0005_02"), (None, None)], "kind string, blocked_id string")
    rows = shard_rows.withColumn("eval_overlap_status", F.col("shard_id") == "shard_0001").withColumn("contamination_status", F.when(F.col("shard_id") == "shard_0007", "suspect").otherwise("clean")).withColumn("dedup_status", F.when(F.col("shard_id") == "shard_0008", "failed").otherwise("passed"))
    manifest = shards.manifests(synthetic, rows)
    got = {r.shard_id: r.reason for r in shards.admission(manifest, rules).collect()}
    assert [got[f"shard_{k:04d}"] for k in (1, 2, 3, 5, 7, 8)] == ["never_train_flag", "admitted", "registered_eval_shard_id", "registered_eval_doc_id", "contaminated", "dedup_not_passed"]
    wrong = shards.admission(manifest, rules, expected_hash="f" * 64).first().reason
    assert wrong == "tokenizer_hash_mismatch (expected ffffffff, got 80434dab)"
    assert shards.audit(manifest, rules, expected_hash="f" * 64).count() == 0


def test_schedule_is_golden(spark):
    df = spark.createDataFrame([("t", "s", k, lane, share, 9) for k, (lane, share) in enumerate(TARGETS)], "family string, stage string, pos int, lane string, share double, max_repeats int")
    got = [r.lane for r in mixture.schedule(df, 17).orderBy("step").collect()]
    assert got == "code reasoning general reasoning indic code reasoning reasoning code general reasoning code reasoning indic reasoning code general".split()
    again = [r.lane for r in mixture.schedule(df, 7, served={"code": 3, "reasoning": 5, "general": 2}).orderBy("step").collect()]
    assert len(again) == 7 and again[0] == "indic"


def test_allocations_are_golden(spark):
    shares = [("general_web", 0.55), ("code", 0.15), ("math_reasoning", 0.14), ("indic", 0.08), ("agentic", 0.03), ("long_context", 0.05)]
    df = spark.createDataFrame([("c", "seed", k, lane, share, 1) for k, (lane, share) in enumerate(shares)], "family string, stage string, pos int, lane string, share double, max_repeats int")
    assert [r.tokens for r in mixture.token_allocations(df, 100_000).orderBy("pos").collect()] == [55000, 15000, 14000, 8000, 3000, 5000]
    with pytest.raises(ValueError, match="unknown stage"):
        mixture.known_stage(df, "c", "nowhere")


def test_selection_precedence(spark):
    rows = [("a", 0.88, "code", False, False), ("b", 0.45, "code", False, False), ("c", 0.90, "general", True, False), ("d", 0.95, "reasoning", False, True), ("e", 0.55, "indic", True, False), ("f", 0.62, "indic", False, False), ("g", 0.70, "code", False, False), ("h", None, None, None, None)]
    df = spark.createDataFrame(rows, "candidate_id string, score double, lane string, lane_quota_full boolean, defer boolean")
    got = {r.candidate_id: (r.status, r.reason) for r in selection.decide(df).collect()}
    assert got["a"] == ("accepted", "quality_above_threshold") and got["b"] == ("rejected", "low_quality_score") and got["c"] == ("rejected", "quota_pressure")
    assert got["d"] == ("deferred", "deferred_for_later_stage") and got["e"] == got["f"] == ("protected-floor-rescued", "protected_floor_rescued") and got["g"][0] == "accepted" and got["h"][1] == "low_quality_score"


def test_quota_goes_by_score(spark):
    df = spark.createDataFrame([(f"c{k:03d}", (k % 7) / 10, "x", False) for k in range(60)], "candidate_id string, score double, lane string, defer boolean")
    full = selection.with_quota(df, spark.createDataFrame([("x", 25)], "lane string, quota long"))
    open_ = [r.score for r in full.where(~F.col("lane_quota_full")).collect()]
    assert len(open_) == 25 and min(open_) >= max(r.score for r in full.where("lane_quota_full").collect()) - 1e-9


def test_quota_parts_close_scores_exactly(spark):
    """Scores that lie within a thousandth of each other, equal ones by id, and a lane without quota."""
    rows = [(f"c{(k * 37) % 300:03d}", 0.8 + (k % 50) * 1e-6, "x" if k % 10 else "y", False) for k in range(300)]
    df = spark.createDataFrame(rows, "candidate_id string, score double, lane string, defer boolean")
    full = selection.with_quota(df, spark.createDataFrame([("x", 100)], "lane string, quota long"))
    want = [r[0] for r in sorted((r for r in rows if r[2] == "x"), key=lambda r: (-r[1], r[0]))[:100]] + [r[0] for r in rows if r[2] == "y"]
    assert sorted(r.candidate_id for r in full.where(~F.col("lane_quota_full")).collect()) == sorted(want)


def plain_pack(lengths, policy, size):
    bins = []
    for n in lengths:
        n = min(n, size)
        if policy == "best-fit":
            fit = [(size - sum(b), k) for k, b in enumerate(bins) if size - sum(b) >= n]
            if fit:
                bins[min(fit)[1]].append(n)
                continue
        elif bins and sum(bins[-1]) + n <= size:
            bins[-1].append(n)
            continue
        bins.append([n])
    return [sum(b) for b in bins]


@pytest.mark.parametrize("policy", ["greedy", "best-fit"])
def test_fit_policies_match_plain_loops(spark, policy):
    lengths = [40, 100, 128, 129, 1, 27, 60, 68, 0, 128, 90]
    df = spark.createDataFrame([("s", k, f"d{k}", list(range(5, 5 + n))) for k, n in enumerate(lengths)], "shard_id string, pos int, doc_id string, tokens array<int>")
    got = packing.pack(df.union(df), policy, 128).orderBy("seq_no").collect()
    assert [128 - r.padding_count for r in got if r.padding_count < 128] == [n for n in plain_pack(lengths, policy, 128) if n]
    assert all(len(r.input_ids) == 128 for r in got)


def test_chop_and_structure(spark):
    df = spark.createDataFrame([("s", 0, "a", [7] * 100), ("s", 1, "b", []), ("s", 2, "c", [8] * 100), ("s", 3, "d", [9] * 300)], "shard_id string, pos int, doc_id string, tokens array<int>")
    chop = packing.pack(df, "concat-chop", 128).orderBy("seq_no").collect()
    assert [len(r.spans) for r in chop] == [2, 2, 1, 1] and chop[0].sample_ids == ["a", "c"] and chop[-1].padding_count == 12
    kept = packing.pack(df, "structure-preserving", 128).orderBy("seq_no").collect()
    assert kept[-1].input_ids[-1] == tokenizer.EOD and kept[-1].padding_count == 0 and kept[0].input_ids[100] == tokenizer.EOD
    with pytest.raises(ValueError, match="unknown packing policy"):
        packing.pack(df, "other")


def test_golden_run(spark, synthetic):
    """Hashes of microbatches that were recorded elsewhere."""
    packed = packing.pack(synthetic, "structure-preserving", 512)
    built = batches.build(packed, F.concat(F.lit("b_"), (F.lit(843209) + F.substring("shard_id", 7, 4).cast("int")).cast("string")))
    got = {r.shard_id: r for r in built.select("shard_id", "microbatch_id", "batch_hash", "loss_mask_hash", "padding_count").collect()}
    assert got["shard_0001"].microbatch_id == "b_843210" and got["shard_0001"].batch_hash.startswith("5f1b204e3336")
    assert got["shard_0009"].batch_hash.startswith("4bf0a4db4203") and got["shard_0002"].batch_hash.startswith("982779d563bc")
    assert got["shard_0001"].loss_mask_hash == "2de6af5319cdb1a4bc7225b8bd1bf31f670b54f7bb85cdfb5bb07c58117e1ac1"


def test_masks(spark):
    df = spark.createDataFrame([([5, 6, 7, 0], [("a", 0, 2), ("b", 2, 3)])], "ids array<int>, spans array<struct<doc_id:string,start_idx:int,end_idx:int>>")
    seg = batches.segments(F.col("ids"), F.col("spans"))
    r = df.select(batches.labels(F.col("ids")).alias("l"), batches.position_ids(F.col("ids"), F.col("spans")).alias("p"), batches.attention_mask(F.col("ids"), seg, F.lit("structure-preserving")).alias("m"), batches.attention_mask(F.col("ids"), seg, F.lit("greedy")).alias("g")).first()
    assert r.l == [5, 6, 7, -100] and r.p == [0, 1, 0, 0]
    assert r.m == [[1, 0, 0, 0], [1, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 0]] and r.g[2] == [1, 1, 1, 0]


def test_replay_sees_tampering(spark, synthetic):
    packed = packing.pack(synthetic, "structure-preserving", 512)
    built = batches.build(packed, F.concat(F.lit("b_"), F.col("shard_id")))
    rows = built.select(F.substring("shard_id", 7, 4).cast("long").alias("id"), "microbatch_id", F.col("spans").alias("token_span_ids"), "batch_hash")
    assert {r.status for r in ledger.replay(rows, synthetic, 512).collect()} == {"same"}
    changed = rows.withColumn("batch_hash", F.when(F.col("id") == 3, "0").otherwise(F.col("batch_hash")))
    assert {r.id for r in ledger.replay(changed, synthetic, 512).where("status = 'changed'").collect()} == {3}
    tokens = synthetic.withColumn("tokens", F.when(F.col("doc_id") == "doc_shard_0004_01", F.reverse("tokens")).otherwise(F.col("tokens")))
    assert {r.id for r in ledger.replay(rows, tokens, 512).where("status = 'changed'").collect()} == {4}


def test_append_goes_on_without_gaps(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = spark.range(50).select(F.lit("r").alias("run_id"), F.lit("br_main").alias("branch_id"), F.col("id").alias("global_step"), F.lit(0).alias("rank"))
    sinks.append_ledger(spark, rows, path, ["global_step", "rank"])
    sinks.append_ledger(spark, rows.withColumn("global_step", F.col("global_step") + 50), path, ["global_step", "rank"])
    held = spark.read.parquet(path)
    assert [(r.id, r.global_step) for r in held.orderBy("id").collect()] == [(k + 1, k) for k in range(100)]
    assert ledger.step_gaps(held.where("global_step <> 10")).first().gap == 1
    assert ledger.max_offset(held.where("id < 0")).first().max_offset == 0
    assert ledger.flat_digest(held, 500, 600).first().digest == "empty"


def test_checkpoints(spark, tmp_path):
    whole = {k: {} for k in ledger.REQUIRED_STATES} | {"ledger_offset": 12345}
    sinks.write_checkpoint(spark, whole, str(tmp_path / "c"))
    assert sinks.read_checkpoint(spark, str(tmp_path / "c"))["ledger_offset"] == 12345
    with pytest.raises(ValueError, match="rng_state"):
        sinks.write_checkpoint(spark, {"model_state": {}}, str(tmp_path / "d"))
    with pytest.raises(FileNotFoundError):
        sinks.read_checkpoint(spark, str(tmp_path / "none"))
    missing = spark.range(1).select(ledger.missing_states(F.array(F.lit("model_state"), F.lit("optimizer_state"))).alias("m")).first().m
    assert missing == ["scheduler_state", "rng_state", "dataloader_state", "ledger_offset"]


@pytest.mark.parametrize("policy", packing.POLICIES)
def test_every_policy_replays(spark, policy):
    """Documents of many lengths, empty, with and without an end, longer than a sequence; then each kind of tampering."""
    lengths = [40, 100, 128, 129, 1, 27, 60, 300, 0, 128, 90]
    rows = [(f"s{k % 2}", k, f"d{k}", [5 + (7 * k + j) % 200 for j in range(n - (k % 3 == 0))] + [3] * (k % 3 == 0 and n > 0)) for k, n in enumerate(lengths)]
    documents = spark.createDataFrame(rows, "shard_id string, pos int, doc_id string, tokens array<int>")
    built = batches.build(packing.pack(documents, policy, 128).where(F.size("spans") > 0), F.concat_ws("_", "shard_id", "seq_no"))
    book = built.withColumn("id", F.monotonically_increasing_id()).select("id", "microbatch_id", F.col("spans").alias("token_span_ids"), "batch_hash").cache()
    assert {r.status for r in ledger.replay(book, documents, 128, policy).collect()} == {"same"}
    one = book.where(F.exists("token_span_ids", lambda s: s["end_idx"] - s["start_idx"] > 3)).first()
    only = lambda b, d: {r.id for r in ledger.replay(b, d, 128, policy).where("status = 'changed'").collect()}
    assert only(book.withColumn("batch_hash", F.when(F.col("id") == one.id, "0").otherwise(F.col("batch_hash"))), documents) == {one.id}
    moved = F.transform("token_span_ids", lambda s: s.withField("end_idx", s["end_idx"] - (s["end_idx"] - s["start_idx"] > 3).cast("int")))
    assert only(book.withColumn("token_span_ids", F.when(F.col("id") == one.id, moved).otherwise(F.col("token_span_ids"))), documents) == {one.id}
    name = next(s.doc_id for s in one.token_span_ids if s.end_idx - s.start_idx > 3)
    holders = {r.id for r in book.where(F.exists("token_span_ids", lambda s: (s["doc_id"] == name) & (s["end_idx"] - s["start_idx"] > 3))).collect()}
    assert only(book, documents.withColumn("tokens", F.when(F.col("doc_id") == name, F.transform("tokens", lambda t: t + 1)).otherwise(F.col("tokens")))) >= holders
    assert {r.status for r in ledger.replay(book, documents.limit(0), 128, policy).collect()} == {"missing"}


def test_attention_rows_are_the_sums_of_the_square_mask(spark):
    rows = [([5, 6, 7, 8, 9, 0, 0], [("a", 0, 2), ("e", 2, 2), ("b", 2, 5)], p) for p in packing.POLICIES] + [([0, 0], [], "greedy"), ([5], [("a", 0, 1)], "structure-preserving")]
    df = spark.createDataFrame(rows, "ids array<int>, spans array<struct<doc_id:string,start_idx:int,end_idx:int>>, policy string")
    ids, spans, policy = F.col("ids"), F.col("spans"), F.col("policy")
    seg = batches.segments(ids, spans)
    square = F.transform(batches.attention_mask(ids, seg, policy), lambda r: F.aggregate(r, F.lit(0), lambda a, x: a + x))
    for r in df.select(square.alias("m"), batches.attended(ids, batches.position_ids(ids, spans), seg, policy).alias("n")).collect():
        assert r.m == r.n


def test_long_schedules_and_many_lanes(spark):
    lanes = spark.createDataFrame([("f", "s", k, f"l{k}", 1 / 1001) for k in range(1001)], "family string, stage string, pos int, lane string, share double")
    assert len(mixture.known_stage(lanes, "f", "S")) == 1001
    two = spark.createDataFrame([("f", "s", 0, "a", 0.75), ("f", "s", 1, "b", 0.25)], "family string, stage string, pos int, lane string, share double")
    rows = mixture.schedule(two, 30_000).orderBy("step").collect()
    assert [r.step for r in rows] == list(range(30_000)) and sum(r.lane == "a" for r in rows) == 22_500
    served = {"a": sum(r.lane == "a" for r in rows[:777]), "b": sum(r.lane == "b" for r in rows[:777])}
    again = mixture.schedule(two, 100, served=served, first_step=777).orderBy("step").collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in rows[777:877]]


def test_digests_see_every_row(spark):
    rows = spark.range(1, 9001).select("id", F.concat(F.lit("h"), "id").alias("batch_hash"))
    whole = ledger.digest(rows, 0, 1 << 62).first().digest
    assert whole != ledger.digest(rows.where("id <> 4500"), 0, 1 << 62).first().digest and whole == ledger.digest(rows.repartition(7), 1, 9000).first().digest
    assert ledger.digest(rows, 0, 0).first().digest == "empty"


def test_learning_rows(spark):
    import math

    documents = spark.createDataFrame([([5, 5, 6],), (None,), ([],)], "tokens array<int>")
    losses = learning.surprises(documents)
    total = 3 + len(losses)
    assert abs(losses[5] - math.log(total / 3)) < 1e-12 and abs(losses[9] - math.log(total)) < 1e-12
    assert learning.average(learning.token_losses([5, -100, 6, 7], [1.0, 0.0, 1.0, 0.0], losses)) == round((losses[5] + losses[6]) / 2, 4)
    assert learning.average(learning.token_losses([-100], [0.0], losses)) == 0.0 and learning.hard_clusters(learning.token_losses([9] * 300, [1.0] * 300, losses)) == [0, 1]
    packed = spark.createDataFrame([("s", 0, "greedy", [5, 6, 0], [("d", 0, 2)]), ("s", 1, "greedy", [9, 0, 0], [("e", 0, 1)]), ("s", 2, "greedy", [0, 0, 0], [])], "shard_id string, seq_no int, policy string, input_ids array<int>, spans array<struct<doc_id:string,start_idx:int,end_idx:int>>")
    rows = learning.learn(packed, spark.createDataFrame([("s", "indic")], "shard_id string, lane string"), documents).orderBy("global_step").collect()
    assert [r.sample_id for r in rows] == ["d", "e", None] and [r.opus_score for r in rows] == [0.62] * 3 and rows[0].loss_delta == 0.0 and rows[1].loss_delta > 0 and rows[2].avg_token_loss == 0.0
    assert spark.range(1).select(learning.continued(F.array(F.lit(5)), 3).alias("c")).first().c == [5, 53, 152, 108]


def test_learning_ledger_goes_on(spark, tmp_path):
    path = str(tmp_path / "learning")
    rows = spark.range(3).select(F.col("id").alias("global_step"), F.lit("s").alias("shard_id"))
    for _ in range(2):
        sinks.append_ledger(spark, rows, path, ["global_step"], ledger.LEARNING)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4, 5, 6]


def test_each_check_of_evidence_can_fail(spark):
    """A run that keeps a rule, and one that breaks it, for every check."""
    row = lambda df: (r := df.first()) and r.result
    text = "code data"
    tokens = spark.range(1).select(tokenizer.encode(F.lit(text), add_eod=True).alias("t")).first().t
    docs = lambda t: spark.createDataFrame([("d", text, t)], "doc_id string, text string, tokens array<int>")
    assert row(evidence.tokenizer_integrity(docs(tokens))) == "PASS" and row(evidence.tokenizer_integrity(docs([*tokens[:-1], 7]))) == "FAIL"
    span = "array<struct<doc_id:string,start_idx:int,end_idx:int>>"
    book = lambda *r: spark.createDataFrame(r, f"id long, run_id string, branch_id string, rank int, global_step long, shard_ids array<string>, token_span_ids {span}, mixture_lane string")
    good = book((1, "r", "b", 0, 1, ["s"], [("d", 0, 2)], "code"), (2, "r", "b", 0, 2, ["s"], [("e", 0, 2)], "code"))
    rules = spark.createDataFrame([("document", "x"), ("dataset", "y")], "kind string, blocked_id string")
    assert row(evidence.evaluation_firewall(good, rules)) == "PASS"
    assert row(evidence.evaluation_firewall(book((1, "r", "b", 0, 1, ["s"], [("x", 0, 2)], "code")), rules)) == "FAIL" and row(evidence.evaluation_firewall(book((1, "r", "b", 0, 1, ["y"], None, "code")), rules)) == "FAIL"
    manifest = lambda s: spark.createDataFrame([(s,)], "shard_id string")
    assert row(evidence.manifest_coverage(good, manifest("s"))) == "PASS" and row(evidence.manifest_coverage(good, manifest("t"))) == "FAIL"
    packed = lambda spans, u=0.75: spark.createDataFrame([([5, 6, 7, 0], spans, u)], f"input_ids array<int>, spans {span}, utilization double")
    assert row(evidence.packing_correctness(packed([("d", 0, 2), ("e", 2, 3)]))) == "PASS"
    assert all(row(evidence.packing_correctness(packed(s))) == "FAIL" for s in ([("d", 0, 2)], [("d", 0, 2), ("e", 1, 3)], [("d", 1, 3)], None))
    assert row(evidence.utilization_recorded(packed([]))) == "PASS" and row(evidence.utilization_recorded(packed([], 0.9))) == "FAIL" and row(evidence.utilization_recorded(packed([], None))) == "FAIL"
    shares = lambda s: spark.createDataFrame([("indic", s, 0.08)], "lane string, share double, floor double")
    assert row(evidence.mixture_compliance(shares(0.1))) == "PASS" and row(evidence.mixture_compliance(shares(0.01))) == "FAIL" and row(evidence.mixture_compliance(shares(0.1).limit(0))) == "FAIL"
    asked = spark.createDataFrame([("a",), ("b",)], "candidate_id string")
    told = lambda *r: spark.createDataFrame(r, "candidate_id string, reason string, score double")
    assert row(evidence.selection_audit_trail(asked, told(("a", "quality_above_threshold", 0.9), ("b", "low_quality_score", 0.1)))) == "PASS"
    for wrong in (told(("a", "quality_above_threshold", 0.9)), told(("a", "quality_above_threshold", 0.2), ("b", "low_quality_score", 0.1)), told(("a", "quota_pressure", 0.9), ("b", None, 0.1)), told(("a", "quota_pressure", 0.9), ("a", "quota_pressure", 0.9), ("b", "quota_pressure", 0.9))):
        assert row(evidence.selection_audit_trail(asked, wrong)) == "FAIL"
    assert row(evidence.crash_recovery(good)) == "PASS" and row(evidence.crash_recovery(good.where("id = 1").union(good.where("id = 1")))) == "FAIL"
    assert row(evidence.crash_recovery(good.withColumn("global_step", F.col("global_step") * 2))) == "FAIL"
    shards_ = lambda lane: spark.createDataFrame([("s", lane, "2025-01-01")], "shard_id string, capability_lane string, ingested_at string")
    assert row(evidence.lanes_agree(good, shards_("code"), lambda c: c)) == "PASS" and row(evidence.lanes_agree(good, shards_("indic"), lambda c: c)) == "FAIL"
    learned = lambda *steps: spark.createDataFrame([(s,) for s in steps], "global_step long")
    assert row(evidence.learning_trace(good, learned(1, 2))) == "PASS" and row(evidence.learning_trace(good, learned(1))) == "FAIL"
    both = evidence.bundle([evidence.crash_recovery(good), evidence.learning_trace(good, learned(1))])
    assert {r.requirement: r.result for r in both.collect()} == {"crash_recovery": "PASS", "learning_trace": "FAIL"}


def test_sinks_write_what_they_are_given(spark, tmp_path):
    evidence_ = spark.createDataFrame([("replay", "PASS", "same=1")], "requirement string, result string, evidence string")
    sinks.write_evidence(evidence_, spark.createDataFrame([(3, 0.9)], "microbatches long, utilization double"), str(tmp_path))
    assert spark.read.json(str(tmp_path / "evidence")).first().result == "PASS" and "| Replay | PASS | same=1 |" in [r.value for r in spark.read.text(str(tmp_path / "evidence_md")).collect()]
    assert spark.read.json(str(tmp_path / "performance")).first().microbatches == 3
    sinks.write_fork(spark, "br_main", "br_b", 7, 11, str(tmp_path / "fork"))
    assert spark.read.json(str(tmp_path / "fork")).first().asDict() == {"parent_branch": "br_main", "child_branch": "br_b", "fork_step": 7, "ledger_offset": 11}
    sinks.write_decisions(spark.createDataFrame([("a", "accepted")], "candidate_id string, status string"), str(tmp_path / "decisions"))
    assert spark.read.json(str(tmp_path / "decisions")).count() == 1
    lists = spark.createDataFrame([("[1, 2]",), ("no",), (None,)], "v string")
    assert [r.v for r in sinks.read_lists(lists, "v", "array<int>").collect()] == [[1, 2], None, None]
    sinks.write_manifests(spark.createDataFrame([("s", ["d"])], "shard_id string, document_ids array<string>"), str(tmp_path / "manifests"))
    assert sinks.read_manifests(spark, str(tmp_path / "manifests"), spark.createDataFrame([], "shard_id string, document_ids array<string>").schema).first().document_ids == ["d"]
    spark.createDataFrame([("step 3 resumed",), ("end",)], "value string").write.text(str(tmp_path / "log"))
    assert sinks.log_contains(spark, str(tmp_path / "log"), "resumed") and not sinks.log_contains(spark, str(tmp_path / "log"), "forked")


def test_a_cluster_must_name_its_folder(monkeypatch):
    from types import SimpleNamespace

    from millrace.session import shared_folder

    held = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(held)


def test_queries_without_sql_are_named_in_the_readme():
    import os

    from millrace.plans import catalogue

    text = open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "README.md")).read()
    assert not [n for n in catalogue.queries() if n not in catalogue.oracle_sql() and f"`{n}`" not in text]


def test_markdown_comes_from_the_rows(spark):
    rows = spark.createDataFrame([("replay", "PASS", "same=1"), ("tokenizer_integrity", "FAIL", "x")], "requirement string, result string, evidence string")
    assert evidence.markdown(rows).first().markdown.splitlines()[2:] == ["| Replay | PASS | same=1 |", "| Tokenizer integrity | FAIL | x |"]
