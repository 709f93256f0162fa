"""Problem 7: encoding a corpus with a public byte-level BPE vocabulary.

``encode_documents`` encodes every text; ``decode_ids`` gives the text back. The
merges of a piece run over a doubly linked list of symbols with a priority queue
of merge ranks: the lowest rank, leftmost first, is popped; an entry whose
symbols have changed since is stale and skipped.

Defined results: a null and an empty text both give an empty list; strings that
look like special tokens are ordinary text; ids of repeated rows are repeated.
"""

from __future__ import annotations

import base64
import functools
import heapq
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm.texts import map_texts

#: A run of white space with the word after it; no piece of a byte-level pattern crosses from a word into white space.
CHUNK = re.compile(r"\s*\S+|\s+")
#: Texts by which a pattern is tried for that; one that fails is applied to whole texts.
PROBES = ("a b", "a  b", "a \n b", "a\n\nb ", " a", "1 2", "1,  2. b", "don't  'tis", "ab\tcd \t e", "- x -  y", "\u0939\u093f \u0928", "a.\n", "a .\n\n b")
#: Distinct chunks a worker remembers; beyond it the memory starts anew, with the same results.
REMEMBERED = 200_000
LONGEST_REMEMBERED = 64


def default_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The place of a public vocabulary: the folder in MILLRACE_TOKENIZERS if set, else the installed package's."""
    folder = os.environ.get("MILLRACE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class _Memory(dict):
    """Chunk -> ids, filled on demand."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        ids = self.encode(chunk)
        if len(chunk) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = ids
        return ids


class ByteBpe:
    """A byte-level BPE read from a file of base64 tokens and ranks."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.first = [self.ranks[bytes([b])] for b in range(256)]
        self.pieces = regex.compile(pattern).findall
        # Texts are taken apart before white space that a word follows, if the pattern never joins what stands on both sides.
        self.separable = all(self.pieces(t) == [p for c in CHUNK.findall(t) for p in self.pieces(c)] for t in PROBES)
        self.chunks = CHUNK.findall if self.separable else lambda text: [text] if text else []
        self.pair_ranks: dict[tuple[int, int], int | None] = {}
        self.piece_memory = _Memory(self._encode_piece)
        self.chunk_memory = _Memory(self._encode_chunk)

    def _pair(self, a: int, b: int) -> int | None:
        key = (a, b)
        try:
            return self.pair_ranks[key]
        except KeyError:
            found = self.pair_ranks[key] = self.ranks.get(self.tokens[a] + self.tokens[b])
            if len(self.pair_ranks) > 2_000_000:
                self.pair_ranks.clear()
            return found

    def merge(self, data: bytes) -> tuple[int, ...]:
        """The ids of one piece's bytes."""
        symbols = [self.first[b] for b in data]
        n = len(symbols)
        if n < 2:
            return tuple(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        after[-1] = -1
        pair = self._pair
        queue = [(rank, k, symbols[k], symbols[k + 1]) for k in range(n - 1) if (rank := pair(symbols[k], symbols[k + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, k, left, right = heapq.heappop(queue)
            m = after[k]
            if symbols[k] != left or m < 0 or symbols[m] != right:
                continue
            symbols[k], symbols[m] = rank, -1
            after[k] = follows = after[m]
            if follows >= 0:
                before[follows] = k
                if (r := pair(rank, symbols[follows])) is not None:
                    heapq.heappush(queue, (r, k, rank, symbols[follows]))
            if (p := before[k]) >= 0 and (r := pair(symbols[p], rank)) is not None:
                heapq.heappush(queue, (r, p, symbols[p], rank))
        return tuple(s for s in symbols if s >= 0)

    def _encode_piece(self, piece: str) -> tuple[int, ...]:
        return self.merge(piece.encode("utf-8", "replace"))

    def _encode_chunk(self, chunk: str) -> tuple[int, ...]:
        memory = self.piece_memory
        return tuple(chain.from_iterable(memory[p] for p in self.pieces(chunk)))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.chunk_memory.__getitem__, self.chunks(text))))

    def decode(self, ids) -> str:
        """Vocabulary strings joined; bytes that are no UTF-8 become U+FFFD, ids the vocabulary lacks nothing."""
        tokens = self.tokens
        return b"".join(tokens.get(i, b"") for i in ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def load(path: str, pattern: str) -> ByteBpe:
    """One vocabulary in each worker process."""
    return ByteBpe(path, pattern)


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """``id_col`` and ``ids`` of each row of ``df``; nothing is shuffled or left out."""
    path, split = vocabulary or default_vocabulary(), pattern or default_pattern()
    out = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def make():
        bpe = load(path, split)

        def act(keys: list, texts: list) -> list:
            from array import array

            flat, ends = array("i"), [0]
            look, apart = bpe.chunk_memory.__getitem__, bpe.chunks
            for text in texts:
                if text:
                    flat.extend(chain.from_iterable(map(look, apart(text))))
                ends.append(len(flat))
            values = pa.array(np.frombuffer(flat, dtype=np.int32) if flat else np.empty(0, np.int32))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, type=pa.list_(pa.field("element", pa.int32(), False)))
            return [keys, lists]

        return act

    return map_texts(df, [id_col, text_col], text_col, out, make)


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """``id_col``, ``n_ids`` and whether decoding the ids gives the text back (``same``), of each row in one pass; a null text counts as an empty one."""
    path, split = vocabulary or default_vocabulary(), pattern or default_pattern()
    out = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_ids", T.IntegerType(), False), T.StructField("same", T.BooleanType(), False)])

    def make():
        bpe = load(path, split)

        def act(keys: list, texts: list) -> list:
            ids = [bpe.encode(t) if t else [] for t in texts]
            return [keys, list(map(len, ids)), [bpe.decode(i) == (t or "") for i, t in zip(ids, texts)]]

        return act

    return map_texts(df, [id_col, text_col], text_col, out, make)


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """``id_col`` and ``text`` of each row; a null list gives an empty text."""
    path, split = vocabulary or default_vocabulary(), pattern or default_pattern()
    out = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches):
        bpe = load(path, split)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                yield pa.record_batch([part.column(0), pa.array([bpe.decode(x) if x else "" for x in part.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, out)
