"""Problem 9: cutting oversized texts at natural boundaries, with an overlap.

Every boundary of a text is joined to the start of the piece that would follow a
piece begun there: the piece reaches to the farthest boundary within the limit,
of the strongest kind that still fills half of it, and the next one begins about
``overlap`` ids before its end. Squaring that successor table (pointer doubling)
marks all pieces' starts in a logarithmic number of array operations, for one
text of any length.

Kinds of boundary, strongest first: paragraph, line, sentence, word, and, only
inside a word of more than ``WORD_MOST`` ids, between characters. White space
stays with the piece that follows it, so that the ids of a piece taken alone are
the same as within the text.

Defined results: null, empty and blank texts and texts of up to ``limit`` ids
are one piece (no text: none); pieces cover the whole text; repeated rows are
cut alike. Every piece has at most ``limit`` ids when encoded alone, but for a
single character that has more.
"""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.bpe import CHUNK, ByteBpe, default_pattern, default_vocabulary, load
from millrace.llm.texts import map_texts

LIMIT, OVERLAP, WORD_MOST = 2048, 128, 64
CHARACTER, WORD, SENTENCE, LINE, PARAGRAPH = range(5)
_ENDS_SENTENCE = re.compile(r"""[.!?…।॥。！？]["'”’»)\]]*$""")


def boundaries(text: str, bpe: ByteBpe) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each boundary: the ids before it, the characters before it, its kind. The first is the text's start, the last its end."""
    if not bpe.separable:
        raise ValueError("the pattern joins a word with the white space after it, so texts cannot be cut there")
    chunks = CHUNK.findall(text)
    encoded = list(map(bpe.chunk_memory.__getitem__, chunks))
    ids, chars, kinds = [0], [0], [PARAGRAPH]
    at_id = at_char = 0
    ended = False
    for chunk, own in zip(chunks, encoded):
        if at_id:
            blank = len(chunk) - len(chunk.lstrip())
            lines = chunk.count("\n", 0, blank)
            kind = PARAGRAPH if lines > 1 else LINE if lines else SENTENCE if ended else WORD
            ids.append(at_id)
            chars.append(at_char)
            kinds.append(kind)
        if len(own) > WORD_MOST:
            starts = dict.fromkeys(accumulate(len(c.encode("utf-8", "replace")) for c in chunk[:-1]))
            whole = {b: k for k, b in enumerate(starts, 1)}
            for k, b in enumerate(accumulate(len(bpe.tokens[i]) for i in own[:-1]), 1):
                if b in whole:
                    ids.append(at_id + k)
                    chars.append(at_char + whole[b])
                    kinds.append(CHARACTER)
        at_id += len(own)
        at_char += len(chunk)
        last = chunk[-4:]
        ended = last[-1] not in "abcdefghijklmnopqrstuvwxyz," and bool(_ENDS_SENTENCE.search(last))
    return np.array([*ids, at_id]), np.array([*chars, at_char]), np.array([*kinds, PARAGRAPH])


def cuts(ids: np.ndarray, kinds: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries at which the pieces start and end; ``ids`` and ``kinds`` as of ``boundaries``."""
    last = len(ids) - 1
    end = np.full(last + 1, -1)
    for kind in (PARAGRAPH, LINE, SENTENCE, WORD, CHARACTER):
        of = np.flatnonzero(kinds >= kind)
        far = of[np.maximum(np.searchsorted(ids[of], ids + limit, "right") - 1, 0)]
        fills = (ids[far] - ids >= limit / 2) if kind > CHARACTER else (far > np.arange(last + 1))
        end = np.where((end < 0) & fills, far, end)
    end = np.where(ids + limit >= ids[last], last, end)
    end = np.where(end < 0, np.minimum(np.arange(last + 1) + 1, last), end)
    goal = ids[end] - overlap
    right = np.clip(np.searchsorted(ids, goal), 0, last)
    left = np.maximum(right - 1, 0)
    following = np.where(goal - ids[left] <= ids[right] - goal, left, right)
    following = np.clip(following, np.arange(last + 1) + 1, end)
    following[end == last] = last
    reached = np.zeros(last + 1, bool)
    reached[0] = True
    jump = following
    while True:
        more = reached.copy()
        more[jump[reached]] = True
        if (more == reached).all():
            break
        reached, jump = more, jump[jump]
    reached[last] = False
    starts = np.flatnonzero(reached)
    return starts, end[starts]


def pieces_of(text: str, bpe: ByteBpe, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(first character, character after the last, ids) of each piece of ``text``."""
    ids, chars, kinds = boundaries(text, bpe)
    if ids[-1] <= limit:
        return [(0, len(text), int(ids[-1]))]
    room = limit
    while True:
        starts, ends = cuts(ids, kinds, room, min(overlap, room // 4))
        found = [(int(chars[s]), int(chars[e]), int(ids[e] - ids[s])) for s, e in zip(starts, ends)]
        # Inside a word the ids of a part may differ from those within the whole; only there they are counted anew.
        within = [k for k, (s, e) in enumerate(zip(starts, ends)) if CHARACTER in (kinds[s], kinds[e])]
        for k in within:
            a, b, _ = found[k]
            found[k] = (a, b, len(bpe.encode(text[a:b])))
        if all(found[k][2] <= limit for k in within) or room == 1:
            return found
        room -= max(1, room // 16)


def cut_plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """``id_col`` and ``pieces`` (an array of ``first``, ``after``, ``n_ids``) of each row whose text has more than ``limit`` bytes; no other can have more than one piece."""
    path, split = vocabulary or default_vocabulary(), pattern or default_pattern()
    piece = T.StructType([T.StructField(n, T.IntegerType(), False) for n in ("first", "after", "n_ids")])
    out = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("pieces", T.ArrayType(piece, False))])

    def make():
        bpe = load(path, split)

        def act(keys: list, texts: list) -> list:
            return [keys, [[{"first": a, "after": b, "n_ids": n} for a, b, n in pieces_of(t, bpe, limit, overlap)] for t in texts]]

        return act

    # A text has no more ids than bytes: one of at most `limit` bytes is a single piece, known without encoding it.
    return map_texts(df.where(F.octet_length(F.col(text_col)) > limit), [id_col, text_col], text_col, out, make)


def oversized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, **tokenizer) -> DataFrame:
    """Rows of ``df`` that must be cut: those whose plan has more than one piece."""
    return cut_plan(df, id_col, text_col, limit, overlap, **tokenizer).where(F.size("pieces") > 1)


def split_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, **tokenizer) -> DataFrame:
    """Pieces of every oversized text: ``id_col``, ``piece`` (from 0), ``first``, ``after`` (characters), ``n_ids``, ``text``."""
    path, split = tokenizer.get("vocabulary") or default_vocabulary(), tokenizer.get("pattern") or default_pattern()
    out = T.StructType(
        [T.StructField(id_col, df.schema[id_col].dataType)]
        + [T.StructField(n, T.IntegerType(), False) for n in ("piece", "first", "after", "n_ids")]
        + [T.StructField("text", T.StringType(), False)]
    )

    def make():
        bpe = load(path, split)

        def act(keys: list, texts: list) -> list:
            rows = [(key, k, a, b, n, t[a:b]) for key, t in zip(keys, texts) for cut in [pieces_of(t, bpe, limit, overlap)] if len(cut) > 1 for k, (a, b, n) in enumerate(cut)]
            return [list(x) for x in zip(*rows)] if rows else [[] for _ in range(6)]

        return act

    return map_texts(df.where(F.octet_length(F.col(text_col)) > limit), [id_col, text_col], text_col, out, make)
