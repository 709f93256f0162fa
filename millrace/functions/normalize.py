"""Full normalization: markup stripped, wrong decoding repaired, NFKC, control characters and white space cleaned.

Spark has no NFKC and no markup parser, so rows that need them go through one
Arrow-batched function; plain ASCII rows without angle brackets, the bulk of a
corpus in English, stay in the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import clean_space

_SILENT = frozenset({"script", "style"})


class _Texts(HTMLParser):
    """Collects the text nodes of a page, those of scripts and styles left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in _SILENT

    def handle_endtag(self, tag):
        self.silent -= tag in _SILENT and self.silent > 0

    def handle_data(self, data):
        if not self.silent:
            self.nodes.append(data)


def strip_markup(text: str) -> str:
    """Text nodes joined by a space, for a text that has both angle brackets."""
    if "<" not in text or ">" not in text:
        return text
    parser = _Texts()
    parser.feed(text)
    parser.close()
    return " ".join(parser.nodes)


def _byte(char: str) -> int | None:
    """The byte that a character stands for where bytes were read as Windows-1252 (or, where that has none, Latin-1)."""
    try:
        return char.encode("cp1252")[0]
    except UnicodeEncodeError:
        return ord(char) if ord(char) < 0x100 else None


#: Characters that bytes from 0x80 on become when they are read as Windows-1252.
_HIGH = {c: b for c in {bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0x100)} if (b := _byte(c)) is not None}
_RUN = re.compile("[" + "".join(map(re.escape, sorted(_HIGH))) + "]{2,}")


def repair(text: str) -> str:
    """``text`` with runs that are UTF-8 read as Windows-1252 decoded anew, again while that helps; what is no whole UTF-8 stays."""

    def decoded(m: re.Match) -> str:
        try:
            return bytes(map(_HIGH.__getitem__, m.group())).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    while (better := _RUN.sub(decoded, text)) != text:
        text = better
    return text


@F.pandas_udf(T.StringType())
def _stripped_nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", repair(strip_markup(t))))


def normalize(text: Column) -> Column:
    """A null or empty text gives an empty one."""
    marked = F.contains(text, F.lit("<")) & F.contains(text, F.lit(">"))
    plain = ~marked & ~text.rlike(r"[^\x00-\x7f]")
    # The function is given null for rows that do not need it.
    return clean_space(F.when(plain, text).otherwise(_stripped_nfkc(F.when(~plain, text))))
