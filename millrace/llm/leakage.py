"""Problem 8: evaluation texts leaking into a corpus.

Each task turns its documents, some thousands at a time, into a shard with a
suffix array over words. Its suffixes are those that begin with a seed of words
of the evaluation items (no other can matter), in their full order as far as
the longest item reaches, which prefix doubling finds. Every suffix of every
item is looked up by binary search: first the range of places that share at
least a seed with it, then, word by word within that range, its longest
verbatim match and where it stands. Where a seed is shared, the item is laid
over the document, and the longest stretch is taken in which at most one word
in ``EXCHANGED`` differs.

The seed is as short as the definition demands: a stretch of ``n`` words with
``n // EXCHANGED`` words exchanged holds an unbroken run of at least
``(n - n // EXCHANGED) / (n // EXCHANGED + 1)`` words, so that no stretch that
counts is missed.

Items are a stated query set that goes to all tasks; the corpus is not shuffled
and is read once for each ``ITEM_CHARS`` characters of items, so once for any
usual set. ``without_leaks`` removes the documents found.

Defined results: words are compared without case, punctuation, spacing, line
breaks, invisible characters, markup and entities. Null and blank texts, and
items without words, match nothing. Repeated documents and items each give
their rows once for each ``doc_id``. Places are counted in words as compared.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.texts import map_texts

SHARE_NUM, SHARE_DEN = 2, 5
EXCHANGED = 8
#: Characters of items that are sent to the tasks at a time.
ITEM_CHARS = 20_000_000
#: Rows and characters of documents, and words, of a shard.
SHARD_ROWS, SHARD_CHARS, SHARD_WORDS = 4_096, 16_000_000, 2_000_000
#: Pairs of words that are compared at a time.
CELLS = 2_000_000

#: Code points without width, as first and last.
_UNSEEN = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFF9, 0xFFFB))
_INVISIBLE = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _UNSEEN) + "]")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
_INLINE = re.compile(r"</?(?:a|abbr|b|big|code|em|font|i|mark|s|small|span|strong|sub|sup|tt|u)(?:\s[^<>]*)?>", re.I)
#: Letters, digits and the combining marks that belong to them; no underscore, danda or other punctuation.
_MARKS = "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x300, 0x36F), (0x900, 0x963), (0x966, 0xDFF)))
_WORD = re.compile(f"[^\\W_]+(?:[{_MARKS}]|[^\\W_])*")
_ASCII_WORD = re.compile("[a-z0-9]+")


def words_of(text: str) -> list[str]:
    """The words of a text as they are compared."""
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(_INVISIBLE.sub("", text).lower())


def seed_of(words: int) -> int:
    """The longest run of unchanged words that every counting stretch of an item of so many words must hold."""
    least = -(-SHARE_NUM * words // SHARE_DEN)
    return max(1, min(-(-(n - n // EXCHANGED) // (n // EXCHANGED + 1)) for n in range(max(1, least), words + 1)))


class Items:
    """Items as arrays of word numbers, and all their suffixes as seeds."""

    def __init__(self, items: list[tuple[object, str]]):
        texts = [(i, w) for i, t in items if t and (w := words_of(t))]
        self.names = [i for i, _ in texts]
        self.words = {w: k for k, w in enumerate(dict.fromkeys(x for _, ws in texts for x in ws), 1)}
        self.arrays = [np.array([self.words[w] for w in ws], np.int64) for _, ws in texts]
        self.least = [-(-SHARE_NUM * len(a) // SHARE_DEN) for a in self.arrays]
        self.bits = max(1, len(self.words).bit_length())
        # A seed must fit one key of 63 bits; a shorter one only finds more places to look at.
        self.seeds = [min(seed_of(len(a)), 63 // self.bits) for a in self.arrays]
        by: dict[int, list] = {}
        for k, (a, s) in enumerate(zip(self.arrays, self.seeds)):
            keys = keys_of(a, s, self.bits)
            by.setdefault(s, []).append((keys, np.full(len(keys), k), np.arange(len(keys))))
        #: By seed length: seeds as keys, with the item and the place in it of each suffix.
        self.suffixes = {s: tuple(np.concatenate(x) for x in zip(*parts)) for s, parts in by.items()}
        self.longest = max(map(len, self.arrays), default=0)
        #: All items in a row, each closed by a word of no document, and where each begins.
        self.row = np.concatenate([np.append(a, -1) for a in self.arrays]) if self.arrays else np.empty(0, np.int64)
        self.begins = np.cumsum([0, *(len(a) + 1 for a in self.arrays)])[:-1]


def keys_of(words: np.ndarray, length: int, bits: int) -> np.ndarray:
    """The first ``length`` words of each suffix that has as many, as one number in the order of the words."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.int64)
    keys = np.zeros(n, np.int64)
    for k in range(length):
        keys = (keys << bits) | words[k : k + n]
    return keys


def ordered(words: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in the order of the suffixes of ``words`` that begin there, compared over at least ``depth`` words, by prefix doubling."""
    rank = words.astype(np.int64)
    reach = 1
    # Ranks of all places double what they compare; a place past the end ranks lowest.
    while reach < depth:
        further = np.zeros(len(rank), np.int64)
        if reach < len(rank):
            further[:-reach] = rank[reach:] + 1
        pair = rank * (int(rank.max(initial=0)) + 2) + further
        told, rank = np.unique(pair, return_inverse=True)
        reach *= 2
        if len(told) == len(rank):
            break
    return starts[np.argsort(rank[starts], kind="stable")]


class Shard:
    """A suffix array of the documents in hand. Word 0 is any that no item has; it parts documents too."""

    def __init__(self, words: np.ndarray, items: Items):
        self.words, self.items = words, items

        self.known = np.concatenate([[0], np.cumsum(words == 0)])
        self.all = self.suffixes(min(items.suffixes, default=1))

    def starts(self, length: int) -> np.ndarray:
        """The places from which ``length`` words of items stand in a row."""
        return np.flatnonzero(self.known[length:] == self.known[:-length]) if 0 < length <= len(self.words) else np.empty(0, np.int64)

    def suffixes(self, length: int) -> np.ndarray:
        """The starts, in the order of their suffixes, that begin with ``length`` words of items."""
        starts = self.starts(length)
        if not len(starts):
            return starts
        # Only the words that such suffixes reach, and the unknown word after them, take part in the sorting.
        reached = np.zeros(len(self.words) + 1, np.int64)
        reached[starts] += 1
        np.add.at(reached, np.minimum(starts + length + 1, len(self.words)), -1)
        kept = np.cumsum(reached[:-1]) > 0
        place = np.cumsum(kept) - 1
        return np.flatnonzero(kept)[ordered(self.words[kept], place[starts], self.items.longest)]

    def searched(self) -> Iterator[tuple[np.ndarray, ...]]:
        """By seed length: the ordered starts and, of each item suffix that shares a seed with the shard, its item, its place in it and its range of starts."""
        for length, (keys, which, at) in self.items.suffixes.items():
            starts = self.all[self.known[np.minimum(self.all + length, len(self.words))] == self.known[self.all]]
            starts = starts[starts + length <= len(self.words)]
            own = np.zeros(len(starts), np.int64)
            for k in range(length):
                own = (own << self.items.bits) | self.words[starts + k]
            low, high = np.searchsorted(own, keys, "left"), np.searchsorted(own, keys, "right")
            hit = np.flatnonzero(high > low)
            if len(hit):
                yield starts, which[hit], at[hit], low[hit], high[hit], length

    def longest(self, starts: np.ndarray, which: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each item suffix: how many words its longest verbatim match has, and where one starts. The range is narrowed by one word at a time."""
        matched, low, high = np.full(len(which), length), low.copy(), high.copy()
        query = self.items.begins[which] + at
        words = np.append(self.words, 0)
        active = np.arange(len(which))
        while len(active):
            want = self.items.row[query[active] + matched[active]]
            depth = matched[active]
            left = bisected(words, starts, low[active], high[active], depth, want, False)
            right = bisected(words, starts, left, high[active], depth, want, True)
            on = (right > left) & (want > 0)
            active = active[on]
            low[active], high[active] = left[on], right[on]
            matched[active] += 1
        return matched, starts[low]

    def places(self, document: np.ndarray) -> np.ndarray:
        """Rows (item, start of the item's first word in the shard, document) of all seed matches, each once."""
        found = []
        for starts, which, at, low, high, _ in self.searched():
            reps = high - low
            row = np.repeat(np.arange(len(reps)), reps)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(reps) - reps, reps)
            met = starts[low[row] + inside]
            found.append(np.unique(np.stack([which[row], met - at[row], document[met]], 1), axis=0))
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), np.int64)


def bisected(words: np.ndarray, starts: np.ndarray, low: np.ndarray, high: np.ndarray, depth: np.ndarray, want: np.ndarray, after: bool) -> np.ndarray:
    """For each range of ordered suffixes that share ``depth`` words: the first whose next word is not below (or, ``after``, is above) the wanted one."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) // 2
        next_ = words[np.minimum(starts[np.minimum(middle, len(starts) - 1)] + depth, len(words) - 1)]
        below = open_ & ((next_ <= want) if after else (next_ < want))
        low = np.where(below, middle + 1, low)
        high = np.where(open_ & ~below, middle, high)
    return low


def stretches(same: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of booleans: the length and the start of the longest stretch with at most one in EXCHANGED false and none outside.

    A stretch counts if its words less EXCHANGED times its false ones are not
    below zero: the longest part of a row with such a sum, found by one walk
    over the least sums so far and the largest sums to come.
    """
    rows, n = same.shape
    sums = np.concatenate([np.zeros((rows, 1), np.int64), np.cumsum(np.where(same, 1, np.where(inside, 1 - EXCHANGED, -EXCHANGED * (n + 1))), 1)], 1)
    least = np.minimum.accumulate(sums, 1)
    most = np.maximum.accumulate(sums[:, ::-1], 1)[:, ::-1]
    i, j, row = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.arange(rows)
    best, first = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for _ in range(2 * n + 2):
        live = (j <= n) & (i <= n)
        if not live.any():
            break
        ok = live & (least[row, np.minimum(i, n)] <= most[row, np.minimum(j, n)])
        longer = ok & (j - i > best)
        best, first = np.where(longer, j - i, best), np.where(longer, i, first)
        j, i = j + ok, i + (live & ~ok)
    return best, first


def runs(same: np.ndarray) -> np.ndarray:
    """The longest unbroken run of each row of booleans."""
    at = np.arange(1, same.shape[1] + 1)
    return (at - np.maximum.accumulate(np.where(same, 0, at), 1)).max(1, initial=0)


def leaks(shard: Shard, document: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, item, words of the longest stretch, its first word in the shard, words of the longest verbatim match) of each leak in a shard; ``document`` is each word's document, -1 for the words that part them."""
    words, items, places = shard.words, shard.items, shard.places(document)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    bounds = np.searchsorted(places[:, 0], np.arange(len(items.arrays) + 1))
    for k in np.unique(places[:, 0]):
        item, own = items.arrays[k], places[bounds[k] : bounds[k + 1], 1:]
        step = max(1, CELLS // len(item))
        for first in range(0, len(own), step):
            starts, docs = own[first : first + step].T
            at = starts[:, None] + np.arange(len(item))
            inside = (at >= 0) & (at < len(words))
            at = np.clip(at, 0, len(words) - 1)
            inside &= document[at] == docs[:, None]
            same = inside & (words[at] == item)
            length, begin = stretches(same, inside)
            for row in np.flatnonzero(length >= items.least[k]):
                d, n = int(docs[row]), int(length[row])
                if n > best.get((d, k), (0,))[0]:
                    best[d, k] = n, int(starts[row] + begin[row]), int(runs(same[row : row + 1])[0])
    for (d, k), (length, place, verbatim) in best.items():
        yield d, k, length, place, verbatim


def find_leaks(corpus: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Each leak: ``id_col``, ``item_col``, ``words`` of the longest stretch, ``item_words``, the stretch's ``first_word`` in the document, and ``verbatim`` words of the longest match without any exchange."""
    out = T.StructType(
        [T.StructField(id_col, corpus.schema[id_col].dataType), T.StructField(item_col, items.schema[item_col].dataType)]
        + [T.StructField(n, T.IntegerType(), False) for n in ("words", "item_words", "first_word", "verbatim")]
    )
    found = None
    for block in _blocks(items, item_col, item_text):
        part = _find(corpus, block, id_col, text_col, out)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return corpus.sparkSession.createDataFrame([], out)
    told = [F.col(n) for n in ("words", "item_words", "first_word", "verbatim")]
    best = found.groupBy(F.col(f"`{id_col}`"), F.col(f"`{item_col}`")).agg(F.max(F.struct("words", "verbatim", (-F.col("first_word")).alias("earlier"), *told[1:3])).alias("b"))
    return best.select(F.col(f"`{id_col}`"), F.col(f"`{item_col}`"), *[F.col(f"b.{n}") for n in ("words", "item_words", "first_word", "verbatim")])


def longest_matches(corpus: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The longest verbatim match of each item with any document: ``item_col``, ``verbatim`` words, ``item_first`` (its first word in the item), ``id_col`` and ``first_word`` (in the document); of equals the earliest in the item. Items that share no seed with the corpus have no row."""
    out = T.StructType(
        [T.StructField(item_col, items.schema[item_col].dataType), T.StructField(id_col, corpus.schema[id_col].dataType)] + [T.StructField(n, T.IntegerType(), False) for n in ("verbatim", "item_first", "first_word")]
    )

    def told(shard: Shard, keys: list, begins: np.ndarray) -> list:
        best: dict[int, tuple] = {}
        for found in shard.searched():
            _, which, at, *_ = found
            matched, where = shard.longest(*found)
            for k, a, n, place in zip(which.tolist(), at.tolist(), matched.tolist(), where.tolist()):
                if k not in best or (n, -a) > best[k][:2]:
                    best[k] = n, -a, place
        rows = []
        for k, (n, a, place) in best.items():
            d = int(np.searchsorted(begins, place, "right")) - 1
            rows.append((shard.items.names[k], keys[d], n, -a, place - int(begins[d])))
        return rows

    parts = [_mapped(corpus, block, id_col, text_col, out, told) for block in _blocks(items, item_col, item_text)]
    if not parts:
        return corpus.sparkSession.createDataFrame([], out).select(item_col, "verbatim", "item_first", id_col, "first_word")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    order = F.struct(F.col("verbatim"), (-F.col("item_first")).alias("a"), F.col("_far"))
    far = rows.withColumn("_far", -F.xxhash64(F.col(f"`{id_col}`")))
    best = far.groupBy(F.col(f"`{item_col}`")).agg(F.max_by(F.struct("verbatim", "item_first", F.col(f"`{id_col}`").alias("_id"), "first_word"), order).alias("b"))
    return best.select(F.col(f"`{item_col}`"), "b.verbatim", "b.item_first", F.col("b._id").alias(id_col), "b.first_word")


def without_leaks(corpus: DataFrame, leaks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``corpus`` without the documents that ``leaks`` names; all its columns and repeated rows stay."""
    named = leaks.select(F.col(f"`{id_col}`").alias("_leaked")).distinct()
    return corpus.join(named, F.col(f"`{id_col}`").eqNullSafe(F.col("_leaked")), "left_anti")


def _blocks(items: DataFrame, item_col: str, item_text: str) -> Iterator[list]:
    """The items on the driver, about ITEM_CHARS characters at a time; their size is counted first."""
    chosen = items.select(F.col(f"`{item_col}`").alias("i"), F.col(f"`{item_text}`").alias("t")).where(F.col("t").isNotNull()).distinct()
    size = chosen.agg(F.sum(F.length("t")).alias("n")).first().n or 0
    parts = -(-size // ITEM_CHARS)
    for k in range(parts):
        own = chosen if parts == 1 else chosen.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k)
        if rows := [(r.i, r.t) for r in own.collect()]:
            yield rows


def _find(corpus: DataFrame, block: list, id_col: str, text_col: str, out: T.StructType) -> DataFrame:
    def told(shard: Shard, keys: list, begins: np.ndarray) -> list:
        return [(keys[d], shard.items.names[k], n, len(shard.items.arrays[k]), at - int(begins[d]), run) for d, k, n, at, run in leaks(shard, parted(begins))]

    return _mapped(corpus, block, id_col, text_col, out, told)


def parted(begins: np.ndarray) -> np.ndarray:
    """Each word's document, -1 for the word that closes a document, from where the documents begin (and where the last ends)."""
    document = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    document[begins[1:] - 1] = -1
    return document


def _mapped(corpus: DataFrame, block: list, id_col: str, text_col: str, out: T.StructType, told) -> DataFrame:
    """The rows that ``told`` gives of each shard of the corpus (with the documents' keys, and where they begin) for a block of items."""
    shared = corpus.sparkSession.sparkContext.broadcast(block)

    def make():
        items = Items(shared.value)
        number = items.words.get

        def act(keys: list, texts: list) -> list:
            rows, parts, owners = [], [], []

            def search() -> None:
                if parts:
                    rows.extend(told(Shard(np.concatenate(parts), items), owners, np.cumsum([0, *map(len, parts)])))
                parts.clear()
                owners.clear()

            held = 0
            for key, text in zip(keys, texts):
                if not text:
                    continue
                own = words_of(text)
                parts.append(np.append(np.fromiter((number(w, 0) for w in own), np.int64, len(own)), 0))
                owners.append(key)
                held += len(own)
                if held >= SHARD_WORDS:
                    search()
                    held = 0
            search()
            return [list(x) for x in zip(*rows)] if rows else [[] for _ in out.fields]

        return act

    return map_texts(corpus, [id_col, text_col], text_col, out, make, SHARD_ROWS, SHARD_CHARS)
