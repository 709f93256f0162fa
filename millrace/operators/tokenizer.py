"""The frozen byte-level BPE as JVM expressions.

A text's bytes become one character each; the merges, in rank order, are plain
string replacements by private-use characters; the characters' codes are ids.
Replacing in rank order equals merging the least rank first, leftmost, because
the parts of a merge have lower ranks and no merge doubles a symbol.
"""

from __future__ import annotations

import functools
import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import once

# ---- fixed values ---------------------------------------------------------
VERSION = "v5.0.0-bpe-frozen"
SPECIAL = {"<PAD>": 0, "<BOS>": 1, "<EOS>": 2, "<EOD>": 3, "<UNK>": 4}
PAD, BOS, EOS, EOD, UNK = range(5)
FIRST_BYTE, FIRST_MERGE = 5, 261
MERGES = [
    (b"t", b"h"), (b"e", b"r"), (b"i", b"n"), (b"a", b"n"), (b"o", b"n"),
    (b"a", b"t"), (b"e", b"n"), (b"o", b"r"), (b"e", b"s"), (b"e", b"d"),
    (b"o", b"u"), (b"i", b"t"), (b"t", b"o"), (b"a", b"r"), (b"s", b"t"),
    (b"th", b"e"), (b"in", b"g"), (b"a", b"nd"), (b"t", b"ion"), (b"f", b"or"),
    (b"c", b"ode"), (b"d", b"ata"), (b"t", b"rain"), (b"s", b"hard"), (b"m", b"od"),
    (b"i", b"ndic"), (b"r", b"eason"), (b"t", b"ext"), (b"p", b"ack"), (b"l", b"ean"),
]
# ---------------------------------------------------------------------------

_PRIVATE = 0xE000


@functools.cache
def vocabulary() -> dict[int, bytes]:
    """Bytes of each id. A merge counts only if both its parts are tokens already and it is new."""
    held = {bytes([b]): FIRST_BYTE + b for b in range(256)}
    for left, right in MERGES:
        if left in held and right in held and left + right not in held:
            held[left + right] = len(held) + FIRST_BYTE
    return {i: t for t, i in held.items()}


def version_hash() -> str:
    """SHA-256 of the version, the special tokens and all pairs as they are written in Python."""
    return hashlib.sha256(f"VERSION:{VERSION};SPECIAL:{sorted(SPECIAL.items())};MERGES:{[(a.decode('latin1'), b.decode('latin1')) for a, b in MERGES]}".encode()).hexdigest()


@functools.cache
def _replacements() -> list[tuple[str, str]]:
    """Each merge as (two symbols, symbol), in rank order; symbols are the byte's character or a private-use one."""
    names = {t: chr(i - FIRST_BYTE) if i < FIRST_MERGE else chr(_PRIVATE + i - FIRST_MERGE) for i, t in vocabulary().items()}
    done = []
    for left, right in MERGES:
        if left in names and right in names and left + right in names and all(names[left + right] != c for _, c in done):
            done.append((names[left] + names[right], names[left + right]))
    return done


def encode(text: Column, add_eod: bool = False) -> Column:
    """Ids of a text; strings that look like special tokens are ordinary text. Null and empty texts give an empty list."""
    symbols = F.decode(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), "ISO-8859-1")
    for pair, symbol in _replacements():
        symbols = F.replace(symbols, F.lit(pair), F.lit(symbol))
    codes = F.transform(F.split(symbols, ""), F.ascii)
    ids = F.transform(codes, lambda c: F.when(c < 256, c + FIRST_BYTE).otherwise(c - _PRIVATE + FIRST_MERGE))
    ids = F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<int>")).otherwise(ids)
    return F.array_append(ids, EOD) if add_eod else ids


@F.pandas_udf(T.StringType())
def _decode_loosely(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def decode(ids: Column) -> Column:
    """The text of a list of ids; special and unknown ids say nothing, bytes that are no UTF-8 are left out.

    Well-formed bytes, the rule, are decoded in the JVM; only others reach Python.
    """
    table = F.array(*[F.lit(vocabulary()[i].hex()) for i in sorted(vocabulary())])
    parts = F.transform(F.filter(ids, lambda i: (i >= FIRST_BYTE) & (i < FIRST_BYTE + len(vocabulary()))), lambda i: F.get(table, i - FIRST_BYTE))
    raw = F.unhex(F.array_join(parts, ""))
    # Bound once: the bytes are joined a second time only where they are no UTF-8.
    text = once(raw, lambda r: F.try_validate_utf8(r.cast("string")))
    return F.coalesce(text, _decode_loosely(F.when(text.isNull(), raw)))
