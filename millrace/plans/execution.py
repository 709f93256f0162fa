"""Queries of the training-data execution system, with the SQL that each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import batches, evidence, learning, ledger, mixture, packing, selection, shards, tokenizer
from millrace.plans import curation
from millrace.sources.tables import read_table, spread
from millrace.streaming import streams

LANE_NAMES = {"general": "general_web", "reasoning": "math_reasoning"}
TOKENS, QUOTA, STEPS = 100_000, 1_000, 2_000
FIRST, LAST, STEP = 100, 400, 500_003
#: A delay longer than any table's time, so that no row of a whole table is late.
EVER = "36500 days"


def plain_lane(column):
    plain = F.regexp_replace(F.lower(F.trim(column)), "[\\s_-]+", "_")
    for name, means in LANE_NAMES.items():
        plain = F.when(plain == name, means).otherwise(plain)
    return plain


def _ledger(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "microbatch_ledger")


def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    return spread(read_table(spark, folder, "documents_tok", "shard_id", "pos", "doc_id", "tokens"))


def _digest(column):
    return F.md5(F.array_join(column, ","))


# ---- mixture ----------------------------------------------------------------


def stage_ratios(spark, folder):
    return mixture.stage_ratios(read_table(spark, folder, "stage_lanes"))


def token_allocations(spark, folder):
    return mixture.token_allocations(read_table(spark, folder, "stage_lanes"), TOKENS)


def target_quotas(spark, folder):
    return mixture.target_quotas(read_table(spark, folder, "stage_lanes"), QUOTA)


def lane_schedule(spark, folder):
    return mixture.schedule(read_table(spark, folder, "stage_lanes"), STEPS)


def sample_batch(spark, folder):
    members = shards.latest_shards(read_table(spark, folder, "shards")).select(plain_lane(F.col("capability_lane")).alias("lane"), F.col("shard_id").alias("item_id"))
    return mixture.sample_batch(members, read_table(spark, folder, "stage_lanes"), "curriculum", "seed", 256)


def token_budget(spark, folder):
    return mixture.budget(spark)


def served_shares(spark, folder):
    rows = ledger.latest_steps(_ledger(spark, folder)).select("curriculum_stage", plain_lane(F.col("mixture_lane")).alias("lane"))
    return mixture.served_shares(rows, ["curriculum_stage"])


def floor_report(spark, folder):
    return mixture.floor_report(served_shares(spark, folder))


# ---- tokenizer --------------------------------------------------------------


def tokenizer_encode(spark, folder):
    rows = spread(read_table(spark, folder, "documents_tok", "shard_id", "pos", "doc_id", "text"))
    ids = F.when(F.coalesce("text", F.lit("")) == "", F.array().cast("array<int>")).otherwise(tokenizer.encode(F.col("text"), add_eod=True))
    return rows.select("shard_id", "pos", "doc_id", _digest(ids).alias("digest"), F.size(ids).cast("long").alias("n"))


def tokenizer_round_trip(spark, folder):
    rows = spread(read_table(spark, folder, "documents", "doc_id", "text"))
    return rows.select("doc_id", (tokenizer.decode(tokenizer.encode(F.col("text"))) == F.coalesce("text", F.lit(""))).alias("same"))


# ---- shards -----------------------------------------------------------------


def synthetic_shards(spark, folder):
    return shards.synthetic_shards(spark)


def synthetic_texts(spark, folder):
    """The synthetic shards' documents without their ids of tokens."""
    return shards.synthetic_shards(spark).drop("tokens")


def shard_token_totals(spark, folder):
    return _tokens(spark, folder).distinct().groupBy("shard_id").agg(F.count("*").alias("documents"), F.sum(F.size("tokens")).cast("long").alias("tokens"))


def shard_hashes(spark, folder):
    own = shards.latest_shards(read_table(spark, folder, "shards"))
    return shards.content_hashes(_tokens(spark, folder), own).select("shard_id", "content_hash", "documents", "tokens")


def _manifests(spark, folder):
    return shards.manifests(_tokens(spark, folder).select("shard_id", "pos", "doc_id"), shards.latest_shards(read_table(spark, folder, "shards")))


def shard_manifests(spark, folder):
    return _manifests(spark, folder).select("shard_id", F.array_join("document_ids", ",").alias("document_ids"), "token_count", "license_tier", "eval_overlap_status", "dedup_status", "contamination_status")


def admission_gate(spark, folder):
    return shards.admission(_manifests(spark, folder), read_table(spark, folder, "firewall_rules"))


def firewall_audit(spark, folder):
    return shards.audit(_manifests(spark, folder), read_table(spark, folder, "firewall_rules"))


# ---- selection --------------------------------------------------------------


def _candidates(spark, folder):
    lanes = shards.latest_shards(read_table(spark, folder, "shards")).select("shard_id", plain_lane(F.col("capability_lane")).alias("lane"))
    texts = spread(read_table(spark, folder, "documents_tok", "shard_id", "pos", "doc_id", "text")).groupBy("doc_id").agg(F.min_by(F.struct("shard_id", "text"), F.struct("shard_id", "pos")).alias("r")).select("doc_id", "r.*")
    scored = texts.select("shard_id", F.col("doc_id").alias("candidate_id"), F.round(X.quality_score(X.clean_space(F.col("text"))), 9).alias("score"))
    return scored.join(lanes, "shard_id").select("candidate_id", "score", "lane", F.lit(False).alias("defer"))


def selection_decisions(spark, folder):
    quotas = mixture.target_quotas(read_table(spark, folder, "stage_lanes").where("family = 'curriculum' AND stage = 'mid'"), QUOTA)
    return selection.decide(selection.with_quota(_candidates(spark, folder), quotas))


def rejection_rates(spark, folder):
    return selection.rejection_rates(selection_decisions(spark, folder))


# ---- packing and batches ----------------------------------------------------


def _packed(spark, folder, policy):
    made = packing.pack(_tokens(spark, folder), policy, 2048)
    return made.select("shard_id", "seq_no", _digest(F.col("input_ids")).alias("digest"), F.size("spans").cast("long").alias("spans"), F.array_join("sample_ids", ",").alias("sample_ids"), F.col("padding_count").cast("long").alias("padding_count"))


def pack_pad_only(spark, folder):
    return _packed(spark, folder, "pad-only")


def pack_concat_chop(spark, folder):
    return _packed(spark, folder, "concat-chop")


def pack_greedy(spark, folder):
    return _packed(spark, folder, "greedy")


def pack_best_fit(spark, folder):
    return _packed(spark, folder, "best-fit")


def pack_structure_preserving(spark, folder):
    return _packed(spark, folder, "structure-preserving")


def _recorded(spark, folder):
    return spread(read_table(spark, folder, "packed_sequences", "shard_id", "seq_no", "policy", "input_ids", "spans").distinct())


def packing_utilization(spark, folder):
    return packing.utilization(_recorded(spark, folder))


def microbatches(spark, folder):
    built = batches.build(_recorded(spark, folder), batches.step_name(F.col("seq_no")))
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return built.select("shard_id", "seq_no", "policy", add("labels").alias("labels"), add("position_ids").alias("positions"), F.size(F.array_distinct(F.filter("segment_ids", lambda s: s > 0))).cast("long").alias("segments"), "loss_mask_hash")


def batch_hashes(spark, folder):
    return batches.build(_recorded(spark, folder), batches.step_name(F.col("seq_no"))).select("shard_id", "seq_no", "policy", "batch_hash")


def attention_pairs(spark, folder):
    """Pairs of places that attend to each other in each sequence, with documents kept apart or not."""
    built = batches.build(_recorded(spark, folder), batches.step_name(F.col("seq_no")))
    seen = batches.attended(F.col("input_ids"), F.col("position_ids"), F.col("segment_ids"), F.col("policy"))
    return built.select("shard_id", "seq_no", "policy", F.aggregate(seen, F.lit(0).cast("long"), lambda a, x: a + x).alias("pairs"))


# ---- ledgers ----------------------------------------------------------------


def ledger_range(spark, folder):
    rows = ledger.rows_between(_ledger(spark, folder), FIRST, LAST)
    return rows.select("id", "run_id", "branch_id", "global_step", "microbatch_id", "batch_hash", F.array_join("packed_sample_ids", ",").alias("samples"))


def ledger_at_step(spark, folder):
    return ledger.at_step(_ledger(spark, folder), STEP).select("id", "global_step", "branch_id", "batch_hash")


def ledger_max_offset(spark, folder):
    return ledger.max_offset(_ledger(spark, folder))


def ledger_latest_steps(spark, folder):
    return ledger.latest_steps(_ledger(spark, folder)).select("id")


def ledger_counts(spark, folder):
    return _ledger(spark, folder).groupBy("run_id", "branch_id").agg(F.count("*").alias("rows"), F.count_distinct("global_step").alias("steps"))


def ledger_step_gaps(spark, folder):
    return ledger.step_gaps(_ledger(spark, folder))


def ledger_forks(spark, folder):
    return ledger.forks(_ledger(spark, folder))


def branch_history(spark, folder):
    return ledger.branch_history(_ledger(spark, folder), "br_main", "br_resumed", LAST).select("id", "branch_id", "global_step")


def ledger_digest(spark, folder):
    return ledger.flat_digest(_ledger(spark, folder), FIRST, LAST)


def ledger_digest_whole(spark, folder):
    return ledger.digest(_ledger(spark, folder), 0, 1 << 62)


def lane_agreement(spark, folder):
    return ledger.lane_agreement(_ledger(spark, folder), read_table(spark, folder, "shards", "shard_id", "capability_lane", "ingested_at"), plain_lane)


def replay(spark, folder):
    return ledger.replay(_ledger(spark, folder), _tokens(spark, folder))


def training_run(spark, folder):
    """A scheduled run over the synthetic shards: each step's microbatch and hashes."""
    documents = shards.synthetic_shards(spark)
    lanes = documents.select("shard_id", F.col("capability_lane").alias("lane")).distinct()
    steps = mixture.schedule(read_table(spark, folder, "stage_lanes"), 17, "training").where("stage = 'reasoning-midtrain'").select("step", "lane")
    return ledger.training_steps(steps, lanes, documents, 843_210).drop("token_span_ids", "input_ids", "labels", "loss_mask")


def evidence_checks(spark, folder):
    own, packed = _ledger(spark, folder), spread(read_table(spark, folder, "packed_sequences", "shard_id", "seq_no", "policy", "input_ids", "spans", "utilization").distinct())
    documents = spread(read_table(spark, folder, "documents_tok", "shard_id", "pos", "doc_id", "text", "tokens"))
    candidates = _candidates(spark, folder)
    return evidence.bundle(
        [
            evidence.tokenizer_integrity(documents),
            evidence.evaluation_firewall(own, read_table(spark, folder, "firewall_rules")),
            evidence.manifest_coverage(own, _manifests(spark, folder)),
            evidence.packing_correctness(packed),
            evidence.mixture_compliance(floor_report(spark, folder)),
            evidence.selection_audit_trail(candidates, selection_decisions(spark, folder)),
            evidence.crash_recovery(own),
            evidence.replayed(own, documents),
            evidence.lanes_agree(own, read_table(spark, folder, "shards", "shard_id", "capability_lane", "ingested_at"), plain_lane),
            evidence.utilization_recorded(packed),
        ]
    )


def evidence_markdown(spark, folder):
    return evidence.markdown(evidence_checks(spark, folder))


def learning_ledger(spark, folder):
    lanes = shards.latest_shards(read_table(spark, folder, "shards")).select("shard_id", plain_lane(F.col("capability_lane")).alias("lane"))
    rows = learning.learn(_recorded(spark, folder), lanes, read_table(spark, folder, "documents_tok", "tokens"))
    return rows.select("global_step", "shard_id", "sample_id", "lane", "avg_token_loss", F.array_join("high_ppl_clusters", ",").alias("high_ppl_clusters"), "loss_delta", "opus_score", "model_phase", "usefulness_classification")


def performance(spark, folder):
    return evidence.performance(_ledger(spark, folder), _recorded(spark, folder))


# ---- streams ----------------------------------------------------------------


def stream_first_copies(spark, folder):
    schema = read_table(spark, folder, "documents", "text").schema
    found = streams.first_copies(_stream(spark, folder, "documents", schema))
    return streams.to_table(found.select(F.md5(F.coalesce("text", F.lit(""))).alias("digest")), "stream_first_copies")


def stream_lane_counts(spark, folder):
    schema = spark.read.parquet(f"{folder}/microbatch_ledger.parquet").select("mixture_lane", "recorded_at").schema
    rows = _stream(spark, folder, "microbatch_ledger", schema).withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    counted = streams.counted_table(streams.lane_counts(rows, "mixture_lane", "recorded_at", delay=EVER), "stream_lane_counts", ["start", "end", "lane"])
    return counted.select(F.unix_micros("start").alias("start"), "lane", "served")


def _stream(spark, folder, name, schema):
    """A table as a stream: its folder's files, or the one file, in turn."""
    import os

    path = f"{folder}/{name}.parquet"
    if os.path.isdir(path):
        return streams.read_stream(spark, path, schema)
    return streams.read_stream(spark, folder, schema, pattern=f"{name}.parquet")


QUERIES = {
    f.__name__: f
    for f in (
        stage_ratios, token_allocations, target_quotas, lane_schedule, sample_batch, token_budget, served_shares, floor_report,
        tokenizer_encode, tokenizer_round_trip,
        synthetic_shards, synthetic_texts, shard_token_totals, shard_hashes, shard_manifests, admission_gate, firewall_audit,
        selection_decisions, rejection_rates,
        pack_pad_only, pack_concat_chop, pack_greedy, pack_best_fit, pack_structure_preserving, packing_utilization, microbatches, batch_hashes, attention_pairs,
        ledger_range, ledger_at_step, ledger_max_offset, ledger_latest_steps, ledger_counts, ledger_step_gaps, ledger_forks, branch_history, ledger_digest, ledger_digest_whole, lane_agreement, replay, training_run,
        learning_ledger, evidence_checks, evidence_markdown, performance,
        stream_first_copies, stream_lane_counts,
    )
}


# ---- the same in SQL --------------------------------------------------------

_LANE = """CASE regexp_replace(lower(trim({0})), '[\\s_-]+', '_', 'g') WHEN 'general' THEN 'general_web' WHEN 'reasoning' THEN 'math_reasoning' ELSE regexp_replace(lower(trim({0})), '[\\s_-]+', '_', 'g') END"""
_SHARDS = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY ingested_at DESC, content_hash DESC) AS k_ FROM shards WHERE shard_id IS NOT NULL) WHERE k_ = 1)"
_ONCE = "(SELECT DISTINCT shard_id, pos, doc_id, tokens FROM documents_tok)"
_LATEST = "(SELECT * FROM microbatch_ledger WHERE id IN (SELECT max(id) FROM microbatch_ledger GROUP BY run_id, branch_id, global_step, rank))"
_SERVED = f"(SELECT curriculum_stage, lane, served, served / sum(served) OVER (PARTITION BY curriculum_stage) AS share FROM (SELECT curriculum_stage, {_LANE.format('mixture_lane')} AS lane, count(*) AS served FROM {_LATEST} GROUP BY ALL))"
_RATIOS = "(SELECT family, stage, pos, lane, round_even(share / sum(share) OVER (PARTITION BY family, stage), 4) AS ratio FROM stage_lanes)"
_MANIFESTS = f"(SELECT d.ids, s.* FROM (SELECT shard_id, list(doc_id ORDER BY pos, doc_id) AS ids FROM (SELECT DISTINCT shard_id, pos, doc_id FROM documents_tok) GROUP BY shard_id) d JOIN {_SHARDS} s USING (shard_id))"
_FIREWALL = f"""(SELECT m.*, CASE WHEN eval_overlap_status THEN 'never_train_flag'
    WHEN shard_id IN (SELECT blocked_id FROM firewall_rules WHERE kind = 'dataset') OR shard_id IN ({", ".join(f"'{b}'" for b in shards.BLOCKED)}) THEN 'registered_eval_shard_id'
    WHEN h.doc IS NOT NULL THEN 'registered_eval_doc_id' ELSE 'clean' END AS fw, h.doc
    FROM {_MANIFESTS} m LEFT JOIN (SELECT shard_id, min(doc_id) AS doc FROM documents_tok WHERE doc_id IN (SELECT blocked_id FROM firewall_rules WHERE kind = 'document') GROUP BY shard_id) h USING (shard_id))"""
_IDS = max(tokenizer.vocabulary()) + 1
_PACKED = "(SELECT DISTINCT shard_id, seq_no, policy, input_ids, spans FROM packed_sequences)"
_USED = "len(list_filter(input_ids, lambda t: t <> 0))"
_FIT = """placed AS (
        SELECT shard_id, k, doc_id, n, 0::BIGINT AS seq, 0::BIGINT AS start FROM docs WHERE k = 1
        UNION ALL SELECT d.shard_id, d.k, d.doc_id, d.n,
            CASE WHEN p.start + p.n + d.n > 2048 AND p.start + p.n > 0 THEN p.seq + 1 ELSE p.seq END,
            CASE WHEN p.start + p.n + d.n > 2048 THEN 0 ELSE p.start + p.n END
        FROM placed p JOIN docs d ON d.shard_id = p.shard_id AND d.k = p.k + 1)"""
_FIT_OUT = """SELECT shard_id, CAST(seq AS INTEGER) AS seq_no, md5(array_to_string(list_concat(flatten(list(ids ORDER BY k)), list_resize([]::INTEGER[], 2048 - sum(len(ids)), 0)), ',')) AS digest,
        count(*) AS spans, string_agg(doc_id, ',' ORDER BY k) AS sample_ids, CAST(2048 - sum(len(ids)) AS BIGINT) AS padding_count FROM placed JOIN docs USING (shard_id, k, doc_id) GROUP BY shard_id, seq HAVING sum(len(ids)) > 0"""
_DOCS = f"docs AS (SELECT shard_id, row_number() OVER (PARTITION BY shard_id ORDER BY pos, doc_id) AS k, doc_id, len(ids) AS n, ids FROM (SELECT shard_id, pos, doc_id, {{0}} AS ids FROM {_ONCE}))"
_EOD = "CASE WHEN len(e) > 2048 THEN list_append(e[1:2047], 3) ELSE e END"
_ENDED = "(SELECT shard_id, pos, doc_id, CASE WHEN len(tokens) > 0 AND tokens[-1] <> 3 THEN list_append(tokens, 3) ELSE tokens END AS e FROM {0})"

_CANDIDATES = f"""
    WITH texts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY shard_id, pos) AS k FROM documents_tok) WHERE k = 1),
         prepared AS (SELECT shard_id, doc_id, t, w, len(w) AS n FROM (SELECT shard_id, doc_id, t, {curation._WORDS} AS w FROM (SELECT shard_id, doc_id, {curation._CLEAN} AS t FROM texts))),
         scored AS (SELECT p.doc_id AS candidate_id, round({curation._SCORE}, 9) AS score, {_LANE.format("s.capability_lane")} AS lane FROM prepared p JOIN {_SHARDS} s USING (shard_id)),
         quotas AS (SELECT lane, max(CAST(floor(share * {QUOTA}) AS BIGINT)) AS quota FROM stage_lanes WHERE family = 'curriculum' AND stage = 'mid' GROUP BY lane),
         ranked AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY coalesce(score, 0) DESC, candidate_id) AS k FROM scored),
         told AS (SELECT r.*, coalesce(k > quota, false) AS quota_full, lane IN ({", ".join(f"'{p}'" for p in selection.PROTECTED)}) AND score >= {selection.RESCUE_FLOOR} AS rescued FROM ranked r LEFT JOIN quotas USING (lane)),
         reasons AS (SELECT *, CASE WHEN quota_full THEN CASE WHEN rescued THEN 'protected_floor_rescued' ELSE 'quota_pressure' END
             WHEN coalesce(score, 0) < {selection.THRESHOLD} THEN CASE WHEN rescued THEN 'protected_floor_rescued' ELSE 'low_quality_score' END ELSE 'quality_above_threshold' END AS reason FROM told),
         decisions AS (SELECT candidate_id, CASE reason WHEN 'protected_floor_rescued' THEN 'protected-floor-rescued' WHEN 'quality_above_threshold' THEN 'accepted' ELSE 'rejected' END AS status, reason, score, lane, reason = 'protected_floor_rescued' AS rescued_by_protected_floor FROM reasons)"""

ORACLES = {
    "stage_ratios": f"SELECT * FROM {_RATIOS}",
    "token_allocations": f"""WITH a AS (SELECT *, CAST(floor({TOKENS} * ratio) AS BIGINT) AS own, max(pos) OVER (PARTITION BY family, stage) AS last FROM {_RATIOS})
        SELECT family, stage, pos, lane, CASE WHEN pos = last THEN CAST({TOKENS} - coalesce(sum(own) OVER (PARTITION BY family, stage ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) ELSE own END AS tokens FROM a""",
    "target_quotas": f"SELECT family, stage, pos, lane, CAST(floor(share * {QUOTA}) AS BIGINT) AS quota FROM stage_lanes",
    "lane_schedule": f"""WITH RECURSIVE l AS (SELECT family, stage, list({{'lane': lane, 'share': share}} ORDER BY pos) AS l FROM stage_lanes GROUP BY family, stage),
        s AS (SELECT family, stage, l, 0::BIGINT AS step, 1::BIGINT AS best, list_transform(l, lambda x, i: CASE WHEN i = 1 THEN 1 ELSE 0 END) AS c FROM l
          UNION ALL SELECT family, stage, l, step + 1, b, list_transform(c, lambda x, i: CASE WHEN i = b THEN x + 1 ELSE x END) FROM (
            SELECT *, list_position(d, list_max(d)) AS b FROM (SELECT *, list_transform(l, lambda x, i: x.share - c[i] / (step + 1)) AS d FROM s WHERE step < {STEPS - 1})))
        SELECT family, stage, step, l[best].lane AS lane FROM s""",
    "served_shares": f"SELECT * FROM {_SERVED}",
    "floor_report": f"SELECT *, share >= floor AS met FROM (SELECT *, CASE lane {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}::DOUBLE' for k, v in mixture.FLOORS.items())} END AS floor FROM {_SERVED}) WHERE floor IS NOT NULL",
    "tokenizer_encode": "SELECT shard_id, pos, doc_id, md5(array_to_string(tokens, ',')) AS digest, CAST(len(tokens) AS BIGINT) AS n FROM documents_tok",
    "tokenizer_round_trip": "SELECT doc_id, true AS same FROM documents",
    "shard_token_totals": f"SELECT shard_id, count(*) AS documents, CAST(sum(len(tokens)) AS BIGINT) AS tokens FROM {_ONCE} GROUP BY shard_id",
    "shard_manifests": f"SELECT shard_id, array_to_string(ids, ',') AS document_ids, token_count, license_provenance_tier AS license_tier, CASE WHEN eval_overlap_status THEN 'overlap' ELSE 'clear' END AS eval_overlap_status, dedup_status, contamination_status FROM {_MANIFESTS}",
    "admission_gate": f"SELECT shard_id, reason = 'admitted' AS admitted, reason FROM (SELECT shard_id, CASE WHEN fw <> 'clean' THEN fw WHEN contamination_status IS DISTINCT FROM 'clean' THEN 'contaminated' WHEN NOT coalesce(contains(dedup_status, 'passed'), false) THEN 'dedup_not_passed' ELSE 'admitted' END AS reason FROM {_FIREWALL})",
    "firewall_audit": f"SELECT shard_id, CASE WHEN fw = 'clean' THEN 'admitted' ELSE 'blocked' END AS status, fw AS reason, CASE WHEN fw = 'registered_eval_doc_id' THEN doc END AS doc_id FROM {_FIREWALL}",
    "selection_decisions": f"{_CANDIDATES} SELECT * FROM decisions",
    "rejection_rates": f"{_CANDIDATES} SELECT lane, count(*) AS decisions, avg(CAST(status = 'rejected' AS INTEGER)) AS rejection_rate FROM decisions GROUP BY lane",
    "pack_pad_only": f"""SELECT shard_id, CAST(row_number() OVER (PARTITION BY shard_id ORDER BY pos, doc_id) - 1 AS INTEGER) AS seq_no, md5(array_to_string(list_resize(tokens, 2048, 0), ',')) AS digest, 1::BIGINT AS spans, doc_id AS sample_ids, CAST(2048 - least(2048, len(tokens)) AS BIGINT) AS padding_count FROM {_ONCE}""",
    "pack_concat_chop": f"""WITH d AS (SELECT shard_id, doc_id, pos, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS i FROM {_ONCE}),
        o AS (SELECT shard_id, doc_id, t, row_number() OVER (PARTITION BY shard_id ORDER BY pos, doc_id, i) - 1 AS a FROM d),
        q AS (SELECT shard_id, a // 2048 AS s, list(t ORDER BY a) AS ids, list(doc_id ORDER BY a) AS names FROM o GROUP BY shard_id, s),
        u AS (SELECT shard_id, s, doc_id, min(a) AS a FROM (SELECT *, a // 2048 AS s FROM o) GROUP BY shard_id, s, doc_id),
        v AS (SELECT shard_id, s, count(*) AS spans, string_agg(doc_id, ',' ORDER BY a) AS sample_ids FROM u GROUP BY shard_id, s)
        SELECT shard_id, CAST(s AS INTEGER) AS seq_no, md5(array_to_string(list_resize(ids, 2048, 0), ',')) AS digest, spans, sample_ids, CAST(2048 - len(ids) AS BIGINT) AS padding_count FROM q JOIN v USING (shard_id, s)""",
    "pack_greedy": f"WITH RECURSIVE {_DOCS.format('tokens[1:2048]')}, {_FIT} {_FIT_OUT}",
    "pack_structure_preserving": f"WITH RECURSIVE {_DOCS.replace(_ONCE, _ENDED.format(_ONCE)).format(_EOD)}, {_FIT} {_FIT_OUT}",
    "pack_best_fit": f"""WITH RECURSIVE {_DOCS.format('tokens[1:2048]')},
        placed AS (SELECT DISTINCT shard_id, 0::BIGINT AS k, []::BIGINT[] AS rooms, -1::BIGINT AS seq FROM docs
          UNION ALL SELECT shard_id, k, CASE WHEN m IS NULL THEN list_append(rooms, 2048 - n) ELSE list_transform(rooms, lambda r, i: CASE WHEN i = list_position(rooms, m) THEN r - n ELSE r END) END,
            CASE WHEN m IS NULL THEN len(rooms) ELSE list_position(rooms, m) - 1 END
          FROM (SELECT d.shard_id, d.k, d.n, p.rooms, list_min(list_filter(p.rooms, lambda r: r >= d.n)) AS m FROM placed p JOIN docs d ON d.shard_id = p.shard_id AND d.k = p.k + 1))
        {_FIT_OUT.replace(" HAVING sum(len(ids)) > 0", "").replace("USING (shard_id, k, doc_id)", "USING (shard_id, k)")}""",
    "sample_batch": f"""WITH lanes AS (SELECT lane, greatest(1, CAST(floor(256 * share / sum(share) OVER ()) AS BIGINT)) AS want FROM stage_lanes WHERE family = 'curriculum' AND stage = 'seed'),
        items AS (SELECT lane, item_id, row_number() OVER (PARTITION BY lane ORDER BY substr(md5(item_id), 1, 2), item_id) - 1 AS number, count(*) OVER (PARTITION BY lane) AS size FROM (SELECT {_LANE.format("capability_lane")} AS lane, shard_id AS item_id FROM {_SHARDS})),
        draws AS (SELECT lane, size, unnest(range(1, least(want, size) + 1)) AS draw FROM lanes JOIN (SELECT DISTINCT lane, size FROM items) USING (lane)),
        told AS (SELECT *, md5('42|' || lane || '|' || draw) AS h FROM draws)
        SELECT lane, CAST(draw AS INTEGER) AS draw, item_id FROM (SELECT lane, draw, h, ('0x' || substr(h, 1, 15))::BIGINT % size AS number FROM told) JOIN items USING (lane, number) ORDER BY h, lane, draw LIMIT 256""",
    "synthetic_texts": f"""WITH l(i, lane, script, tier) AS (VALUES {", ".join(f"({i}, '{a}', '{b}', '{c}')" for i, (a, b, c) in enumerate(shards.SYNTHETIC_LANES))})
        SELECT 'shard_' || lpad(s::VARCHAR, 4, '0') AS shard_id, CAST(d AS INTEGER) AS pos, 'doc_shard_' || lpad(s::VARCHAR, 4, '0') || '_' || lpad(d::VARCHAR, 2, '0') AS doc_id,
            'Synthetic training text for shard_' || lpad(s::VARCHAR, 4, '0') || ' document ' || d || ' in lane ' || lane || '. Standard content with detailed logic patterns.' AS text, lane AS capability_lane, script AS language_script, tier AS license_provenance_tier
        FROM range(1, 25) x(s), range(1, 6) y(d) JOIN l ON i = (s - 1) % {len(shards.SYNTHETIC_LANES)}""",
    "packing_utilization": f"SELECT policy, count(*) AS sequences, CAST(sum({_USED}) AS BIGINT) AS used, sum({_USED}) / sum(len(input_ids)) AS utilization FROM {_PACKED} GROUP BY policy",
    "microbatches": f"""SELECT shard_id, seq_no, policy, CAST(list_sum(list_transform(input_ids, lambda t: CASE WHEN t = 0 THEN -100 ELSE t END)) AS BIGINT) AS labels,
        CAST(coalesce(list_sum(list_transform(spans, lambda s: (s.end_idx - s.start_idx) * (s.end_idx - s.start_idx - 1) // 2)), 0) AS BIGINT) AS positions,
        CAST(len(list_filter(spans, lambda s: s.end_idx > s.start_idx)) AS BIGINT) AS segments,
        sha256('[' || array_to_string(list_transform(input_ids, lambda t: CASE WHEN t = 0 THEN '0.0' ELSE '1.0' END), ', ') || ']') AS loss_mask_hash FROM {_PACKED}""",
    "attention_pairs": f"""SELECT shard_id, seq_no, policy, CAST(CASE WHEN policy = 'structure-preserving' THEN coalesce(list_sum(list_transform(spans, lambda s: (s.end_idx - s.start_idx) * (s.end_idx - s.start_idx + 1) // 2)), 0) ELSE {_USED} * ({_USED} + 1) // 2 END AS BIGINT) AS pairs FROM {_PACKED}""",
    "ledger_range": f"SELECT id, run_id, branch_id, global_step, microbatch_id, batch_hash, array_to_string(packed_sample_ids, ',') AS samples FROM microbatch_ledger WHERE id BETWEEN {FIRST} AND {LAST} ORDER BY id",
    "ledger_at_step": f"SELECT id, global_step, branch_id, batch_hash FROM microbatch_ledger WHERE global_step = {STEP} AND branch_id = 'br_main' ORDER BY id DESC LIMIT 1",
    "ledger_max_offset": "SELECT CAST(coalesce(max(id), 0) AS BIGINT) AS max_offset FROM microbatch_ledger",
    "ledger_latest_steps": f"SELECT id FROM {_LATEST}",
    "ledger_counts": "SELECT run_id, branch_id, count(*) AS rows, count(DISTINCT global_step) AS steps FROM microbatch_ledger GROUP BY run_id, branch_id",
    "ledger_step_gaps": """WITH c AS (SELECT run_id, branch_id, rank, global_step, count(*) AS copies FROM microbatch_ledger GROUP BY ALL),
        g AS (SELECT *, CAST(coalesce(global_step - lag(global_step) OVER (PARTITION BY run_id, branch_id, rank ORDER BY global_step) - 1, 0) AS BIGINT) AS gap FROM c)
        SELECT run_id, branch_id, rank, global_step, copies, gap FROM g WHERE copies > 1 OR gap > 0""",
    "ledger_forks": "SELECT run_id, branch_id, min(global_step) AS first_step, min(id) AS first_id, count(*) AS rows FROM microbatch_ledger WHERE branch_id <> 'br_main' GROUP BY run_id, branch_id",
    "branch_history": f"SELECT id, branch_id, global_step FROM microbatch_ledger WHERE (branch_id = 'br_main' AND id <= {LAST}) OR branch_id = 'br_resumed'",
    "ledger_digest": f"SELECT substring(sha256(string_agg(batch_hash, '' ORDER BY id)), 1, 16) AS digest FROM microbatch_ledger WHERE id BETWEEN {FIRST} AND {LAST}",
    "lane_agreement": f"""WITH s AS (SELECT shard_id, {_LANE.format("l")} AS shard_lane FROM (SELECT shard_id, arg_max(capability_lane, ingested_at) AS l FROM shards GROUP BY shard_id)),
        r AS (SELECT id, {_LANE.format("mixture_lane")} AS lane, unnest(shard_ids) AS shard_id FROM microbatch_ledger),
        t AS (SELECT id, max(CASE WHEN lane IS NOT DISTINCT FROM shard_lane THEN 1 ELSE 0 END) AS a FROM r JOIN s USING (shard_id) GROUP BY id)
        SELECT a = 1 AS agrees, count(*) AS rows FROM t GROUP BY agrees""",
    "learning_ledger": f"""WITH ids AS (SELECT unnest(range({_IDS})) AS t), met AS (SELECT t, count(*) AS n FROM (SELECT unnest(tokens) AS t FROM documents_tok) WHERE t BETWEEN 0 AND {_IDS - 1} GROUP BY t),
        counts AS (SELECT t, coalesce(n, 0) + 1 AS n FROM ids LEFT JOIN met USING (t)), losses AS (SELECT t, ln((SELECT sum(n) FROM counts) / n) AS loss FROM counts),
        lanes AS (SELECT shard_id, {_LANE.format("capability_lane")} AS lane FROM {_SHARDS}),
        places AS (SELECT shard_id, seq_no, policy, t, row_number() OVER (PARTITION BY shard_id, seq_no, policy ORDER BY i) - 1 AS k FROM (SELECT shard_id, seq_no, policy, unnest(input_ids) AS t, generate_subscripts(input_ids, 1) AS i FROM {_PACKED}) WHERE t <> 0),
        surprise AS (SELECT p.*, coalesce(loss, (SELECT max(loss) FROM losses)) AS loss FROM places p LEFT JOIN losses USING (t)),
        means AS (SELECT shard_id, seq_no, policy, round(avg(loss), 4) AS m FROM surprise GROUP BY ALL),
        parts AS (SELECT shard_id, seq_no, policy, string_agg(c, ',' ORDER BY c) AS hard FROM (SELECT shard_id, seq_no, policy, k // {learning.CLUSTER} AS c FROM surprise GROUP BY ALL HAVING round(avg(loss), 4) >= {learning.HARD}) GROUP BY ALL),
        told AS (SELECT shard_id || '/' || policy AS shard_id, seq_no, p.spans[1].doc_id AS sample_id, lane, coalesce(m, 0) AS m, coalesce(hard, '') AS hard FROM {_PACKED} p LEFT JOIN lanes USING (shard_id) LEFT JOIN means USING (shard_id, seq_no, policy) LEFT JOIN parts USING (shard_id, seq_no, policy))
        SELECT CAST(seq_no AS BIGINT) AS global_step, shard_id, sample_id, lane, m AS avg_token_loss, hard AS high_ppl_clusters, coalesce(round(m - lag(m) OVER (PARTITION BY shard_id ORDER BY seq_no), 4), 0) AS loss_delta,
            CASE WHEN lane = 'indic' THEN 0.62::DOUBLE ELSE 0.85::DOUBLE END AS opus_score, '{learning.PHASE}' AS model_phase, CASE WHEN m >= {learning.HARD} THEN 'high_value' ELSE 'routine' END AS usefulness_classification FROM told""",
    "shard_hashes": f"""WITH d AS (SELECT shard_id, count(*) AS documents, CAST(sum(len(tokens)) AS BIGINT) AS tokens, string_agg(hex(encode(doc_id)) || array_to_string(list_transform(tokens, lambda t: lpad(hex(t), 8, '0')), ''), '' ORDER BY pos, doc_id) AS body FROM {_ONCE} GROUP BY shard_id)
        SELECT shard_id, sha256(unhex(hex(encode(shard_id || coalesce(capability_lane, '') || CASE WHEN eval_overlap_status THEN 'True' ELSE 'False' END)) || body)) AS content_hash, documents, d.tokens FROM d JOIN {_SHARDS} s USING (shard_id)""",
    "ledger_digest_whole": f"""WITH l0 AS (SELECT id, coalesce(batch_hash, '') AS h FROM microbatch_ledger), {", ".join(f"l{k + 1} AS (SELECT id // 4096 AS id, sha256(string_agg(h, '' ORDER BY id)) AS h FROM l{k} GROUP BY id // 4096)" for k in range(6))}
        SELECT coalesce(substring(min(h), 1, 16), 'empty') AS digest FROM l6""",
    "batch_hashes": f"""WITH p AS (SELECT *, array_to_string(list_transform(input_ids, lambda t: CASE WHEN t = 0 THEN '0.0' ELSE '1.0' END), ', ') AS mask,
            flatten(list_transform(spans, lambda s: range(greatest(s.end_idx - s.start_idx, 0)::BIGINT))) AS placed FROM {_PACKED})
        SELECT shard_id, seq_no, policy, sha256('{{"input_ids": [' || array_to_string(input_ids, ', ') || '], "loss_mask": [' || mask || '], "microbatch_id": "b_' || seq_no || '", "position_ids": [' ||
            array_to_string(list_concat(placed, list_resize([]::BIGINT[], len(input_ids) - len(placed), 0)), ', ') || '], "spans": [' ||
            array_to_string(list_transform(spans, lambda s: '{{"doc_id": "' || s.doc_id || '", "end_idx": ' || s.end_idx || ', "start_idx": ' || s.start_idx || '}}'), ', ') || ']}}') AS batch_hash FROM p""",
    "token_budget": f"""WITH l(name, share) AS (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in mixture.LANES.items())}), t AS (SELECT name, share, CAST(round({mixture.TOTAL_BUDGET} * share) AS BIGINT) AS tokens FROM l),
        s(part, name, w) AS (VALUES {", ".join(f"('{p}', '{k}', {v}::DOUBLE)" for p, d in (("general_web", mixture.GENERAL_SUBMIX), ("indic", mixture.INDIC_TIERS), ("math_reasoning", mixture.EFFORT_BANDS), ("agentic", mixture.AGENTIC_SOURCES)) for k, v in d.items())}),
        w AS (SELECT part, name, w / sum(w) OVER (PARTITION BY part) AS share FROM s)
        SELECT 'lane' AS part, name, share, tokens FROM t
        UNION ALL SELECT w.part, w.name, w.share, CAST(round(t.tokens * w.share) AS BIGINT) FROM w JOIN t ON t.name = w.part
        UNION ALL SELECT 'anneal_reserve', n, {mixture.ANNEAL_RESERVE}::DOUBLE, CAST(round({mixture.ANNEAL_RESERVE} * tokens * f) AS BIGINT) FROM (VALUES ('verified_native', 'indic', {mixture.INDIC_TIERS["verified_native"]}::DOUBLE), ('agentic', 'agentic', 1::DOUBLE), ('high_and_ultra', 'math_reasoning', {mixture.EFFORT_BANDS["high"] + mixture.EFFORT_BANDS["ultra"]}::DOUBLE)) v(n, lane, f) JOIN t ON t.name = v.lane
        UNION ALL SELECT 'warmup', 'all', {mixture.WARMUP}::DOUBLE, CAST(round({mixture.TOTAL_BUDGET} * {mixture.WARMUP}) AS BIGINT)""",
    "performance": f"""SELECT microbatches, tokens, seconds, CASE WHEN seconds > 0 THEN tokens / seconds END AS tokens_per_second, utilization FROM
        (SELECT count(*) AS microbatches, CAST(sum(coalesce(list_sum(list_transform(token_span_ids, lambda s: s.end_idx - s.start_idx)), 0)) AS BIGINT) AS tokens, epoch(max(recorded_at)) - epoch(min(recorded_at)) AS seconds FROM microbatch_ledger),
        (SELECT sum({_USED}) / sum(len(input_ids)) AS utilization FROM {_PACKED})""",
    "stream_first_copies": "SELECT DISTINCT md5(coalesce(text, '')) AS digest FROM documents",
    "stream_lane_counts": "SELECT epoch_us(time_bucket(INTERVAL '10 minutes', recorded_at)) AS start, mixture_lane AS lane, CAST(count(*) AS BIGINT) AS served FROM microbatch_ledger WHERE recorded_at IS NOT NULL GROUP BY ALL",
}
