"""Exact and near deduplication, in the order of ids.

Copies are found by a grouped minimum, which combines before the shuffle. Near
duplicates are looked for by shared buckets and confirmed by their shingles. A
pair is formed only with the first rows of a bucket that are still open: copies
of these go out with them, so that a bucket with a third of all rows costs what
its rows cost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import shingles
from millrace.session import checkpointed
from millrace.sources.tables import spread

PERMUTATIONS, THRESHOLD = 128, 0.8
# Share of pairs at the threshold that the buckets of a confirmed search may miss.
MISSED = 1e-4
_PRIME = (1 << 61) - 1
_WORD = r"[\p{L}\p{N}_]"
#: A text of more copies than this is joined by broadcast.
HOT = 200_000


def exact_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``class_id`` (the least id of the same text) and ``copies`` of each row with an id; null texts are copies of each other."""
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col), F.sha2(F.coalesce(F.concat(F.lit("t"), F.col(text_col)), F.lit("n")), 256).alias("_h"))
    sums = checkpointed(rows.groupBy("_h").agg(F.min(id_col).alias("class_id"), F.count("*").alias("copies")))
    # There are at most (rows / HOT) such texts, so they may go to every task; the others make no hot task.
    hot = F.broadcast(sums.where(F.col("copies") > HOT))
    rest = rows.join(hot.select("_h"), "_h", "left_anti").join(sums.where(F.col("copies") <= HOT), "_h")
    return rows.join(hot, "_h").unionByName(rest).select(id_col, "class_id", "copies")


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the first row of each text, by id. The ids that stay come from a grouped minimum, so a hot text makes no hot task."""
    kept = df.groupBy(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("_h"), F.col(text_col).isNull().alias("_n")).agg(F.min(id_col).alias(id_col)).select(id_col)
    return df.join(kept, id_col, "left_semi")


def signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", permutations: int = PERMUTATIONS, seed: int = 1) -> DataFrame:
    """``id_col`` and ``signature`` (least hash of the shingles under each permutation); rows without shingles have none.

    Shingles are hashed in the JVM; only their numbers reach NumPy.
    """
    return _signed(_hashed(spread(df.select(id_col, text_col)), id_col, text_col), permutations, seed)


def _hashed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col`` and ``h`` (the hashes of the shingles) of the rows that have any."""
    # A text has shingles if it has a word; asked of the shingles, the condition would have them made twice.
    return df.where(F.lower(F.col(text_col)).rlike(_WORD)).select(F.col(id_col), F.transform(shingles(F.col(text_col)), lambda s: F.xxhash64(s)).alias("h"))


def _signed(hashed: DataFrame, permutations: int, seed: int = 1) -> DataFrame:
    """``hashed`` with ``signature`` in place of its last column, the hashes."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 31, permutations, dtype=np.uint64)
    b = rng.integers(0, 1 << 61, permutations, dtype=np.uint64)
    others = hashed.columns[:-1]
    out = T.StructType([hashed.schema[c] for c in others] + [T.StructField("signature", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            lists = batch.column(len(others))
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            low = flat & np.uint64(0x3FFFFFFF)
            high = flat >> np.uint64(30) & np.uint64(0x3FFFFFFF)
            rows = np.empty((batch.num_rows, permutations), np.int64)
            for k in range(batch.num_rows):
                lo, hi = low[ends[k] : ends[k + 1]], high[ends[k] : ends[k + 1]]
                # A long text a piece at a time, so that the products stay small.
                best = np.full(permutations, _PRIME, np.uint64)
                for s in range(0, len(lo), 4096):
                    p = (a[:, None] * lo[None, s : s + 4096] + (a[::-1, None] * hi[None, s : s + 4096] % np.uint64(_PRIME)) + b[:, None]) % np.uint64(_PRIME)
                    best = np.minimum(best, p.min(1))
                rows[k] = best.view(np.int64)
            values = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * permutations), pa.array(rows.reshape(-1)))
            yield pa.record_batch([*batch.columns[:-1], values], names=[*others, "signature"])

    return hashed.mapInArrow(run, out)


def bands_for(threshold: float, permutations: int = PERMUTATIONS) -> tuple[int, int]:
    """Bands and rows that make false positives and false negatives least together."""
    grid = (np.arange(4000) + 0.5) / 4000
    best = None
    for rows in range(1, permutations + 1):
        bands = permutations // rows
        hit = 1 - (1 - grid**rows) ** bands
        cost = hit[grid < threshold].sum() + (1 - hit[grid >= threshold]).sum()
        if best is None or cost < best[0]:
            best = (cost, bands, rows)
    return best[1], best[2]


def sure_bands(threshold: float, permutations: int = PERMUTATIONS, missed: float = MISSED) -> tuple[int, int]:
    """The most selective bands that miss at most a share ``missed`` of the pairs at the threshold."""
    for rows in range(permutations, 0, -1):
        bands = permutations // rows
        if (1 - threshold**rows) ** bands <= missed:
            return bands, rows
    return permutations, 1


def buckets(signed: DataFrame, id_col: str, bands: int, rows: int) -> DataFrame:
    """``id_col`` and ``bucket``: one row for each band of each signature."""
    return signed.select(id_col, F.explode(_keys(bands, rows)).alias("bucket"))


def _keys(bands: int, rows: int) -> Column:
    return F.array(*[F.xxhash64(F.lit(k), F.slice("signature", k * rows + 1, rows)) for k in range(bands)])


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, permutations: int = PERMUTATIONS, bands: tuple[int, int] | None = None) -> DataFrame:
    """``id_col``, ``kept``, ``class_id`` of each row with an id; a row without shingles is like no other and kept.

    In the order of ids, a row is kept unless a kept row before it has a Jaccard
    similarity of ``threshold`` or more over the shingles; ``class_id`` is the
    least such kept row, or the row itself. Similar rows are looked for by
    buckets that miss next to none, and each is confirmed.

    A round compares the first open rows of each bucket with those after them.
    A row that is among the first in all its buckets and like none before it is
    kept, and the rows like it go. The first are one in the first round and
    four times more in each that follows, so that the copies of a hot bucket
    are met by one row, and different rows that share it need few rounds.
    """
    sets = checkpointed(_hashed(df, id_col, text_col).select(id_col, F.size("h").alias("n"), F.xxhash64(F.array_sort("h")).alias("x"), "h"))
    keys = F.array_distinct(_keys(*(bands or sure_bands(threshold, permutations))))
    members = checkpointed(_signed(sets, permutations).select(id_col, "n", "x", keys.alias("keys")))
    # Rows of the same shingles have the same likeness to all others: only the first goes in.
    twins = checkpointed(members.select(id_col, "n", "x").join(members.groupBy("n", "x").agg(F.min(id_col).alias("_first")), ["n", "x"]).select(id_col, "_first"))
    firsts = twins.where(F.col(id_col) == F.col("_first")).select(id_col)
    placed = members.join(firsts, id_col, "left_semi").select(id_col, "n", F.explode("keys").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("_c")).where("_c > 1").select("bucket")
    linked = checkpointed(placed.join(shared, "bucket"))
    # Only the shingles of rows that share a bucket are compared.
    held_sets = checkpointed(sets.select(id_col, "h").join(linked.select(id_col).distinct(), id_col, "left_semi"))

    def alike(front: DataFrame, rows: DataFrame, *conditions) -> DataFrame:
        """``a`` (of ``front``) and ``b`` (of ``rows``) that share a bucket, meet the conditions and are similar."""
        a = front.select("bucket", F.col(id_col).alias("a"), F.col("n").alias("na"))
        b = rows.withColumnRenamed(id_col, "b").withColumnRenamed("n", "nb")
        near = a.join(b, "bucket").where((F.col("a") < F.col("b")) & (F.least("na", "nb") / F.greatest("na", "nb") >= threshold))
        for condition in conditions:
            near = near.where(condition)
        pairs = near.select("a", "b").distinct()
        both = pairs.join(held_sets.select(F.col(id_col).alias("a"), F.col("h").alias("ha")), "a").join(held_sets.select(F.col(id_col).alias("b"), F.col("h").alias("hb")), "b")
        common = F.size(F.array_intersect("ha", "hb"))
        return both.where(common / (F.size("ha") + F.size("hb") - common) >= threshold).select("a", "b")

    open_rows, first, settled = linked, 1, None
    while not open_rows.isEmpty():
        place = F.row_number().over(Window.partitionBy("bucket").orderBy(id_col))
        front = checkpointed(open_rows.withColumn("_k", place).where(F.col("_k") <= first).drop("_k"))
        links = checkpointed(alike(front, open_rows))
        whole = open_rows.groupBy(id_col).agg(F.count("*").alias("_c")).join(front.groupBy(id_col).agg(F.count("*").alias("_f")), id_col).where("_c = _f").select(id_col)
        kept = checkpointed(whole.join(links.select(F.col("b").alias(id_col)), id_col, "left_anti"))
        gone = links.join(kept.withColumnRenamed(id_col, "a"), "a").groupBy(F.col("b").alias(id_col)).agg(F.min("a").alias("owner"))
        now = checkpointed(kept.select(id_col, F.lit(True).alias("kept"), F.col(id_col).alias("owner")).unionByName(gone.select(id_col, F.lit(False).alias("kept"), "owner")))
        settled = now if settled is None else checkpointed(settled.unionByName(now))
        open_rows = checkpointed(open_rows.join(now, id_col, "left_anti"))
        first *= 4
    alone = firsts.withColumn("kept", F.lit(True)).withColumn("owner", F.col(id_col))
    if settled is not None:
        # A row may have gone with a kept row that is not its least.
        held = linked.join(settled.where("kept").select(id_col), id_col, "left_semi")
        lost = linked.join(settled.where("NOT kept").select(id_col, "owner"), id_col)
        least = alike(held, lost, F.col("a") < F.col("owner")).groupBy(F.col("b").alias(id_col)).agg(F.min("a").alias("_least"))
        told = settled.join(least, id_col, "left").select(id_col, "kept", F.coalesce("_least", "owner").alias("owner"))
        alone = told.unionByName(alone.join(settled.select(id_col), id_col, "left_anti"))
    of_first = alone.select(F.col(id_col).alias("_first"), "kept", "owner")
    told = twins.join(of_first, "_first").select(id_col, (F.col("kept") & (F.col(id_col) == F.col("_first"))).alias("kept"), F.col("owner").alias("class_id"))
    bare = df.where(F.col(id_col).isNotNull() & ~F.coalesce(F.lower(F.col(text_col)).rlike(_WORD), F.lit(False))).select(id_col, F.lit(True).alias("kept"), F.col(id_col).alias("class_id"))
    return told.unionByName(bare)


def bucket_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, permutations: int = PERMUTATIONS, bands: tuple[int, int] | None = None) -> DataFrame:
    """As ``near_duplicates``, but a shared bucket of the layout of least total error decides, unconfirmed, as in the reference.

    Rounds settle all rows whose earlier neighbours are settled, and end when
    none is open.
    """
    n, r = bands or bands_for(threshold, permutations)
    members = checkpointed(buckets(signatures(df, id_col, text_col, permutations), id_col, n, r).distinct())
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    linked = checkpointed(members.join(shared, "bucket"))
    state = checkpointed(linked.select(id_col).distinct().withColumn("kept", F.lit(None).cast("boolean")).withColumn("class_id", F.lit(None).cast(df.schema[id_col].dataType)))
    while True:
        with_state = linked.join(state, id_col)
        told = with_state.groupBy("bucket").agg(F.min(F.when(F.col("kept"), F.col(id_col))).alias("first_kept"), F.min(F.when(F.col("kept").isNull(), F.col(id_col))).alias("first_open"))
        seen = (
            with_state.where(F.col("kept").isNull())
            .join(told, "bucket")
            .groupBy(id_col)
            .agg(F.min(F.when(F.col("first_kept") < F.col(id_col), F.col("first_kept"))).alias("owner"), F.min("first_open").alias("first_open"))
        )
        settled = seen.select(
            id_col,
            F.when(F.col("owner").isNotNull(), False).when(F.col("first_open") == F.col(id_col), True).alias("now"),
            F.when(F.col("owner").isNotNull(), F.col("owner")).when(F.col("first_open") == F.col(id_col), F.col(id_col)).alias("now_class"),
        )
        state = checkpointed(state.join(settled, id_col, "left").select(id_col, F.coalesce("kept", "now").alias("kept"), F.coalesce("class_id", "now_class").alias("class_id")))
        if state.where(F.col("kept").isNull()).isEmpty():
            break
    alone = members.select(id_col).distinct().join(state.select(id_col), id_col, "left_anti")
    return state.unionByName(alone.select(id_col, F.lit(True).alias("kept"), F.col(id_col).alias("class_id")))
