"""Problem 5: filling fixed-capacity sequences with whole documents.

Bounded-space online best fit: a fixed number of bins is open in a task, found
through a bitset with one bit for each amount of free space. A document goes to
the open bin that it leaves the least room in; if none has room, a new bin is
opened, and beyond ``open_bins`` the fullest one closes first. One pass over
the rows with a bounded memory, so a task streams through any number of them.
With ``repack``, the items of the bins still open at the end of a task are put
in anew, the longest first, which is no online packing and so not the default.

Only a document longer than the capacity is split: into full sequences and a
rest that is packed as a document of its own.

Defined results: repeated rows count once; a null or empty token list takes no
room and appears in no sequence; an empty table gives no sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import checkpointed
from millrace.sources.tables import spread

CAPACITY, OPEN_BINS, PAD = 2048, 512, 0
#: So many hashes of repeated rows (8 bytes each) may be broadcast.
REPEATED_MOST = 2_000_000

SPAN = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("start_idx", T.IntegerType(), False),
        T.StructField("end_idx", T.IntegerType(), False),
        T.StructField("doc_start", T.IntegerType(), False),
    ]
)


class Bins:
    """Open bins in a bitset keyed by free space. ``put`` returns the bins that an item closed.

    An item is a tuple whose third entry is its length.
    """

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.by_room: dict[int, list[list]] = {}
        self.rooms = 0
        self.count = 0

    def _take(self, room: int) -> list:
        held = self.by_room[room]
        bin_ = held.pop()
        if not held:
            del self.by_room[room]
            self.rooms &= ~(1 << room)
        self.count -= 1
        return bin_

    def put(self, item, length: int) -> list[list]:
        if length == self.capacity:
            return [[item]]
        closed = []
        fitting = self.rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(room)
        else:
            if self.count >= self.most:
                closed.append(self._take((self.rooms & -self.rooms).bit_length() - 1))
            room, bin_ = self.capacity, []
        bin_.append(item)
        left = room - length
        if left == 0:
            closed.append(bin_)
        else:
            self.by_room.setdefault(left, []).append(bin_)
            self.rooms |= 1 << left
            self.count += 1
        return closed

    def rest(self, repack: bool = False) -> list[list]:
        """The bins still open at the end; with ``repack`` their items (a bounded number) are put in anew from the longest on."""
        if not repack:
            closed = [b for room in sorted(self.by_room) for b in self.by_room[room]]
            self.by_room, self.rooms, self.count = {}, 0, 0
            return closed
        items = sorted((i for room in sorted(self.by_room) for b in self.by_room[room] for i in b), key=lambda i: -i[2])
        again = Bins(self.capacity, max(1, len(items)))
        closed = [b for i in items for b in again.put(i, i[2])]
        closed += [b for room in sorted(again.by_room) for b in again.by_room[room]]
        self.by_room, self.rooms, self.count = {}, 0, 0
        return closed


def pack(df: DataFrame, keys: list[str] = ("shard_id", "pos", "doc_id"), id_col: str = "doc_id", tokens_col: str = "tokens", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, with_ids: bool = True, repack: bool = False) -> DataFrame:
    """Sequences of the distinct rows of ``df``: ``sequence_id``, ``sample_ids``, ``spans``, ``used``, ``utilization``, ``padding_count`` and, if wanted, ``input_ids``.

    Only hashes of the rows are brought together: a row whose hash no other has
    stays where it was read, and of the others the distinct ones are taken.
    Bins are filled within the partitions of the scan. Repeated hashes go to
    all tasks if there are at most ``REPEATED_MOST``; if there are more, whole
    rows are brought together instead, with the same distinct rows.
    """
    keys = list(dict.fromkeys([*keys, id_col]))
    rows = spread(df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{tokens_col}`").alias("_tokens"))).where(F.size("_tokens") > 0)
    rows = rows.withColumn("_hash", F.xxhash64(*[F.col(f"`{k}`") for k in keys], "_tokens"))
    shared = checkpointed(rows.groupBy("_hash").agg(F.count("*").alias("_n")).where("_n > 1").select("_hash"))
    if shared.count() <= REPEATED_MOST:
        # A hash that two different rows share does no harm: rows are compared whole here.
        several = rows.join(F.broadcast(shared), "_hash", "left_semi").distinct()
        rows = rows.join(F.broadcast(shared), "_hash", "left_anti").unionByName(several)
    else:
        rows = rows.distinct()
    rows = rows.select(F.col(f"`{id_col}`").cast("string").alias("_id"), F.size("_tokens").alias("_n"), *(["_tokens"] if with_ids else []))

    out = [
        T.StructField("sequence_id", T.StringType(), False),
        T.StructField("sample_ids", T.ArrayType(T.StringType()), False),
        T.StructField("spans", T.ArrayType(SPAN, False), False),
        T.StructField("used", T.IntegerType(), False),
        T.StructField("utilization", T.DoubleType(), False),
        T.StructField("padding_count", T.IntegerType(), False),
    ]
    if with_ids:
        out.append(T.StructField("input_ids", T.ArrayType(T.IntegerType(), False), False))
    schema = T.StructType(out)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        bins, made = Bins(capacity, open_bins), 0

        def emit(closed: list[list]) -> pa.RecordBatch:
            nonlocal made
            names, spans, used = [], [], []
            ids = np.full((len(closed), capacity), PAD, np.int32) if with_ids else None
            for k, items in enumerate(closed):
                at, own = 0, []
                for doc, start, n, values in items:
                    own.append({"doc_id": doc, "start_idx": at, "end_idx": at + n, "doc_start": start})
                    if with_ids:
                        ids[k, at : at + n] = values
                    at += n
                names.append(list(dict.fromkeys(s["doc_id"] for s in own)))
                spans.append(own)
                used.append(at)
            columns = [
                pa.array([f"seq_{part:06d}_{made + k:09d}" for k in range(len(closed))]),
                pa.array(names, arrow.field("sample_ids").type),
                pa.array(spans, arrow.field("spans").type),
                pa.array(used, pa.int32()),
                pa.array([u / capacity for u in used], pa.float64()),
                pa.array([capacity - u for u in used], pa.int32()),
            ]
            if with_ids:
                ends = pa.array(np.arange(len(closed) + 1, dtype=np.int32) * capacity)
                columns.append(pa.ListArray.from_arrays(ends, pa.array(ids.reshape(-1)), type=arrow.field("input_ids").type))
            made += len(closed)
            return pa.record_batch(columns, schema=arrow)

        closed: list[list] = []
        for batch in batches:
            names, lengths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if with_ids:
                lists = batch.column(2)
                offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for k, (name, n) in enumerate(zip(names, lengths)):
                for start in range(0, n, capacity):
                    m = min(capacity, n - start)
                    # A copy, so that an open bin does not hold its whole batch in memory.
                    values = flat[offsets[k] + start : offsets[k] + start + m].astype(np.int32) if with_ids else None
                    closed += bins.put((name, start, m, values), m)
                if len(closed) >= 256:
                    yield emit(closed)
                    closed = []
        closed += bins.rest(repack)
        for k in range(0, len(closed), 256):
            yield emit(closed[k : k + 256])

    return rows.mapInArrow(run, schema)


def recorded(df: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Distinct recorded sequences by policy, with what they really use: ids other than the padding, whatever their ``utilization`` says."""
    once = df.select("shard_id", "seq_no", "policy", "input_ids").where(F.col("input_ids").isNotNull()).distinct()
    used = F.size(F.filter("input_ids", lambda t: t != PAD)).cast("long")
    return once.select("policy", used.alias("used")).groupBy("policy").agg(F.count("*").alias("sequences"), F.sum("used").alias("used"))


def gain(documents: DataFrame, packed: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Utilization of this packing beside each recorded policy: ``policy``, ``sequences``, ``used``, ``utilization``, ``padding_count``, ``gain``.

    Ours is the row ``bounded_best_fit``, and with the open bins packed anew
    ``bounded_best_fit_repacked``; ``gain`` is the first one's utilization less the row's.
    """
    rows = recorded(packed, capacity)
    for name, again in (("bounded_best_fit", False), ("bounded_best_fit_repacked", True)):
        own = pack(documents, capacity=capacity, open_bins=open_bins, with_ids=False, repack=again)
        rows = rows.unionByName(own.agg(F.lit(name).alias("policy"), F.count("*").alias("sequences"), F.coalesce(F.sum("used"), F.lit(0)).cast("long").alias("used")))
    share = F.when(F.col("sequences") > 0, F.col("used") / (F.col("sequences") * capacity))
    rows = rows.withColumn("utilization", share).withColumn("padding_count", F.col("sequences") * capacity - F.col("used"))
    from pyspark.sql import Window

    # One row for each policy name: the window holds a handful of rows.
    best = F.max(F.when(F.col("policy") == "bounded_best_fit", F.col("utilization"))).over(Window.partitionBy(F.lit(1)))
    return rows.withColumn("gain", best - F.col("utilization"))
