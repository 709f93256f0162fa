"""Scalar text functions, Column to Column, all evaluated in the JVM.

A null text counts as an empty one wherever a number or a decision is asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ---------------------------------------------------------
# Thresholds of the curation filters.
MIN_WORDS, MAX_WORDS = 20, 5000
MIN_ALPHA, MAX_PUNCT, MAX_DIGIT, MAX_UPPER, MIN_UNIQUE, MIN_SENTENCE = 0.60, 0.30, 0.40, 0.60, 0.30, 5
QUALITY_THRESHOLD = 0.50
ASCII_LEAST_CHARS, ASCII_LEAST_SHARE = 30, 0.80
SHINGLE_WORDS = 5
# Characters that count as English, and as punctuation.
ASCII_CLASS = r"""[A-Za-z\t-\r\x1c-\x1f .,!?'"-]"""
PUNCT_CLASS = r"""[.,;:!?"'()\[\]{}<>\-/*+=@#$%^&]"""
# What redaction replaces.
EMAIL_PATTERN = r"(?i)[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
URL_PATTERN = r"(?i)http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
# Words that mark educational text.
EDU_KEYWORDS = [
    "because", "therefore", "however", "example", "result", "analysis",
    "study", "research", "method", "definition", "figure", "table", "section",
    "theory", "function", "system", "algorithm", "data", "process", "model",
]
# Domains, the substrings that mark them (the first domain that has one wins), and the confidence.
DOMAIN_RULES = [
    ("D2 Code and Mathematics", 0.85, ["def ", "class ", "import ", "function", "return", "int ", "const ", "math", "equation", "proof", "theorem"]),
    ("D1 Science", 0.80, ["abstract", "doi:", "arxiv", "methodology", "experiment", "hypothesis", "analysis", "dataset"]),
    ("D1 Knowledge", 0.82, ["wikipedia", "referred to as", "established in", "born", "century", "history of"]),
    ("D2 Literature", 0.75, ["chapter", "novel", "manual", "guide", "documentation", "section"]),
    ("D4 Community", 0.78, ["forum", "reddit", "posted by", "comment", "thread", "reply", "user"]),
]
DEFAULT_DOMAIN = ("D3 General Web", 0.70)
DOMAIN_CHARS = 1000
# White space of any script, spelled out so that every regular-expression engine agrees.
SPACE_CLASS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
CONTROL_CLASS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
# ---------------------------------------------------------------------------


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def once(column: Column, of: Callable[[Column], Column]) -> Column:
    """``of(column)`` with ``column`` evaluated once a row, however often ``of`` uses it."""
    return F.element_at(F.transform(F.array(column), of), 1)


def count_of(text: Column, char_class: str) -> Column:
    """How many characters of a text are of a class. Taking runs of them out at once makes far fewer matches than counting one by one."""
    return F.length(_text(text)) - F.length(F.regexp_replace(_text(text), f"{char_class}+", ""))


def words(text: Column) -> Column:
    """The words of a text whose only white space is single spaces; none for an empty text."""
    plain = _text(text)
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def share(part: Column, text: Column) -> Column:
    n = F.length(_text(text))
    return F.when(n > 0, part / n).otherwise(F.lit(0.0))


def is_english(text: Column) -> Column:
    """Long enough and mostly ASCII letters, white space and plain punctuation. A character ratio, not a language test."""
    n = F.length(_text(text))
    return (n >= ASCII_LEAST_CHARS) & (share(count_of(text, ASCII_CLASS), text) >= ASCII_LEAST_SHARE)


def clean_space(text: Column) -> Column:
    """Control characters deleted, runs of white space made one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(_text(text), CONTROL_CLASS, ""), SPACE_CLASS + "+", " "))


def heuristics(text: Column) -> dict[str, Column]:
    """Each heuristic test of a normalized text as a boolean of its own, so that reasons can be queried."""
    n_words = F.size(words(text))
    pieces = F.filter(F.split(_text(text), "[.!?]+"), lambda p: F.trim(p) != "")
    lowered = F.transform(words(text), F.lower)
    return {
        "min_words": n_words >= MIN_WORDS,
        "max_words": n_words <= MAX_WORDS,
        "alpha": share(count_of(text, r"\p{L}"), text) >= MIN_ALPHA,
        "punctuation": share(count_of(text, PUNCT_CLASS), text) <= MAX_PUNCT,
        "digits": share(count_of(text, r"\p{Nd}"), text) <= MAX_DIGIT,
        "uppercase": share(count_of(text, r"\p{IsUppercase}"), text) <= MAX_UPPER,
        "diversity": F.when(n_words > 0, F.size(F.array_distinct(lowered)) / n_words >= MIN_UNIQUE).otherwise(False),
        "sentence_length": F.when(F.size(pieces) > 0, n_words / F.size(pieces) >= MIN_SENTENCE).otherwise(True),
    }


def passes_heuristics(text: Column) -> Column:
    h = heuristics(text)
    return h["min_words"] & h["max_words"] & h["alpha"] & h["punctuation"]


def passes_task_filter(text: Column) -> Column:
    h = heuristics(text)
    return (F.size(words(text)) > 0) & h["digits"] & h["uppercase"] & h["diversity"] & h["sentence_length"]


def quality_score(text: Column) -> Column:
    """0.10 below 20 words, else 0.30 plus educational words and word length."""

    def of(w: Column) -> Column:
        n = F.size(w)
        marks = F.size(F.array_intersect(F.transform(w, F.lower), F.array(*map(F.lit, EDU_KEYWORDS))))
        letters = F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
        complexity = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (letters / n - 3.5) / 3.0))
        score = F.lit(0.30) + F.lit(0.40) * F.least(F.lit(1.0), marks / F.lit(5.0)) + F.lit(0.30) * complexity
        return F.when(n < 20, F.lit(0.10)).otherwise(F.least(F.lit(1.0), score))

    return once(words(text), of)


def redact(text: Column) -> Column:
    """E-mail addresses, then URLs, replaced by their placeholders."""
    return F.regexp_replace(F.regexp_replace(text, EMAIL_PATTERN, "[REDACTED_EMAIL]"), URL_PATTERN, "[REDACTED_URL]")


def domain(text: Column, chars: int | None = DOMAIN_CHARS) -> Column:
    """``domain`` and ``confidence`` as a struct, by the first rule with a substring in the text's first characters, or in all of it if ``chars`` is None."""
    head = F.lower(_text(text) if chars is None else F.substring(_text(text), 1, chars))
    found = F.struct(F.lit(DEFAULT_DOMAIN[0]).alias("domain"), F.lit(DEFAULT_DOMAIN[1]).alias("confidence"))
    for name, confidence, marks in reversed(DOMAIN_RULES):
        hit = F.lit(False)
        for m in marks:
            hit = hit | F.contains(head, F.lit(m))
        found = F.when(hit, F.struct(F.lit(name).alias("domain"), F.lit(confidence).alias("confidence"))).otherwise(found)
    return found


def pool_of(label: Column) -> Column:
    """The pool a long label belongs to."""
    named = F.lit("D3 General Web")
    for mark, pool in (("Community", "D4 Community"), ("Literature", "D2 Literature"), ("Code", "D2 Code and Mathematics"), ("Knowledge", "D1 Knowledge"), ("Science", "D1 Science")):
        named = F.when(F.contains(label, F.lit(mark)), pool).otherwise(named)
    return named


def shingles(text: Column, n: int = SHINGLE_WORDS) -> Column:
    """The set of runs of ``n`` words, or of the words themselves if there are fewer."""
    found = F.regexp_extract_all(F.lower(_text(text)), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))

    def runs(w: Column) -> Column:
        return F.when(F.size(w) < n, w).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " ")))

    # Bound as a lambda's variable, the words are found once and not anew for each run.
    return F.array_distinct(once(found, runs))


def strip_prompt(decoded: Column, prompt: Column) -> Column:
    """A decoded answer without the prompt it begins with."""
    return F.when(F.startswith(decoded, prompt), F.trim(F.substring(decoded, F.length(prompt) + 1, F.length(decoded)))).otherwise(decoded)


def effort_band(tokens: Column) -> Column:
    """Band of a reasoning trace by its length in tokens."""
    return F.when(tokens < 256, "low").when(tokens <= 1024, "medium").when(tokens <= 4096, "high").when(tokens.isNotNull(), "ultra")
