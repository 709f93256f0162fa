"""Packing a shard's documents into sequences under five policies.

A shard holds a bounded number of documents, which makes it the unit of work:
padding alone is a projection, cutting a stream is a running sum, and the
policies that depend on what came before run over one shard's lengths only;
tokens are then sliced in the JVM.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.tokenizer import EOD, PAD

LENGTH = 512
POLICIES = ("pad-only", "concat-chop", "greedy", "best-fit", "structure-preserving")


def _next_fit(lengths: list[int], length: int) -> list[tuple[int, int]]:
    """(sequence, start) of each document: a new sequence begins when one does not fit the current."""
    out, seq, used, any_ = [], 0, 0, False
    for n in lengths:
        if used + n > length:
            seq, used = seq + (1 if used else 0), 0
        out.append((seq, used))
        used += n
        any_ = True
    return out if any_ else []


def _best_fit(lengths: list[int], length: int) -> list[tuple[int, int]]:
    """(sequence, start) of each document: the sequence with the least room that fits, the first of equals."""
    rooms: list[int] = []
    out = []
    for n in lengths:
        fitting = [(room, k) for k, room in enumerate(rooms) if room >= n]
        if fitting:
            room, k = min(fitting)
        else:
            rooms.append(length)
            room, k = length, len(rooms) - 1
        out.append((k, length - room))
        rooms[k] -= n
    return out


def with_eod(tokens: Column, length: int) -> Column:
    """Tokens that end with EOD, the ending kept when they are cut."""
    ended = F.when((F.size(tokens) > 0) & (F.element_at(tokens, -1) != EOD), F.array_append(tokens, EOD)).otherwise(tokens)
    return F.when(F.size(ended) > length, F.array_append(F.slice(ended, 1, length - 1), EOD)).otherwise(ended)


def _finish(parts: DataFrame, policy: str, length: int) -> DataFrame:
    """Sequences from parts (``shard_id``, ``seq_no``, ``k``, ``doc_id``, ``start_idx``, ``ids`` and, if not 0, ``doc_start``: the place of the first id in the document)."""
    if "doc_start" not in parts.columns:
        parts = parts.withColumn("doc_start", F.lit(0))
    gathered = parts.groupBy("shard_id", "seq_no").agg(F.sort_array(F.collect_list(F.struct("k", "doc_id", "start_idx", "ids", "doc_start"))).alias("p"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    spans = F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start_idx"].alias("start_idx"), (x["start_idx"] + F.size(x["ids"])).cast("int").alias("end_idx"), x["doc_start"].alias("doc_start")))
    rows = gathered.select("shard_id", "seq_no", ids.alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("names"), spans.alias("spans"))
    padding = F.lit(length) - F.size("ids")
    return rows.select(
        "shard_id",
        "seq_no",
        F.concat("ids", F.array_repeat(F.lit(PAD), padding)).alias("input_ids"),
        (F.array_distinct("names") if policy == "concat-chop" else F.col("names")).alias("sample_ids"),
        "spans",
        (F.size("ids") / F.lit(float(length))).alias("utilization"),
        F.lit(policy).alias("policy"),
        padding.cast("int").alias("padding_count"),
    )


def pack(documents: DataFrame, policy: str = "structure-preserving", length: int = LENGTH) -> DataFrame:
    """Sequences of ``length`` ids for each shard of ``documents`` (``shard_id``, ``pos``, ``doc_id``, ``tokens``); repeated rows count once."""
    if policy not in POLICIES:
        raise ValueError(f"unknown packing policy {policy!r}; known are {POLICIES}")
    once = documents.select("shard_id", "pos", "doc_id", F.coalesce("tokens", F.array().cast("array<int>")).alias("tokens")).distinct()
    if policy == "concat-chop":
        return _chop(once, length)
    ids = with_eod(F.col("tokens"), length) if policy == "structure-preserving" else F.slice("tokens", 1, length)
    cut = once.select("shard_id", "pos", "doc_id", ids.alias("ids"))
    if policy == "pad-only":
        number = F.row_number().over(Window.partitionBy("shard_id").orderBy("pos", "doc_id")) - 1
        return _finish(cut.select("shard_id", number.cast("int").alias("seq_no"), F.lit(0).alias("k"), "doc_id", F.lit(0).alias("start_idx"), "ids"), policy, length)
    place = _best_fit if policy == "best-fit" else _next_fit

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pos", "doc_id"]).reset_index(drop=True)
        placed = place(pdf["n"].tolist(), length)
        return pd.DataFrame({"shard_id": pdf["shard_id"], "doc_id": pdf["doc_id"], "pos": pdf["pos"], "seq_no": [s for s, _ in placed], "start_idx": [a for _, a in placed], "k": range(len(placed))})

    schema = "shard_id string, doc_id string, pos int, seq_no int, start_idx int, k int"
    lengths = cut.select("shard_id", "pos", "doc_id", F.size("ids").alias("n"))
    planned = lengths.groupBy("shard_id").applyInPandas(plan, schema)
    parts = planned.join(cut, ["shard_id", "pos", "doc_id"])
    made = _finish(parts, policy, length)
    # A sequence of nothing but empty documents is none.
    return made.where("utilization > 0") if policy != "best-fit" else made


def _chop(once: DataFrame, length: int) -> DataFrame:
    """One stream of tokens for each shard, cut every ``length``; a running sum tells where each document's parts fall."""
    n = F.size("tokens")
    before = F.coalesce(F.sum(n).over(Window.partitionBy("shard_id").orderBy("pos", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    order = F.row_number().over(Window.partitionBy("shard_id").orderBy("pos", "doc_id"))
    placed = once.where(n > 0).select("shard_id", "doc_id", "tokens", before.alias("at"), order.alias("k"))
    first, last = F.floor(F.col("at") / length), F.floor((F.col("at") + F.size("tokens") - 1) / length)
    parts = placed.select("*", F.explode(F.sequence(first, last)).alias("s"))
    start = F.greatest(F.col("at"), F.col("s") * length)
    end = F.least(F.col("at") + F.size("tokens"), (F.col("s") + 1) * length)
    sliced = F.slice("tokens", (start - F.col("at") + 1).cast("int"), (end - start).cast("int"))
    return _finish(parts.select("shard_id", F.col("s").cast("int").alias("seq_no"), F.col("k").cast("int").alias("k"), "doc_id", (start - F.col("s") * length).cast("int").alias("start_idx"), sliced.alias("ids"), (start - F.col("at")).cast("int").alias("doc_start")), "concat-chop", length)


def utilization(packed: DataFrame) -> DataFrame:
    """Sequences, used ids and utilization of each policy, counted from the ids themselves."""
    used = F.size(F.filter("input_ids", lambda t: t != PAD)).cast("long")
    return packed.groupBy("policy").agg(F.count("*").alias("sequences"), F.sum(used).alias("used"), (F.sum(used) / F.sum(F.size("input_ids").cast("long"))).alias("utilization"))
