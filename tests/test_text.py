"""Scalar text functions against plain Python, and at their thresholds."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from millrace.functions import normalize as N
from millrace.functions import scoring
from millrace.functions import text as X


def values(spark, texts, column):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", column(F.col("t")).alias("v")).orderBy("k").collect()
    return [r.v for r in rows]


def test_english_needs_thirty_characters(spark):
    assert values(spark, ["a" * 29, "a" * 30, None, "", "a" * 24 + "é" * 6, "a" * 23 + "é" * 7], X.is_english) == [False, True, False, False, True, False]


def test_clean_space_matches_python(spark):
    texts = ["a\t\n b", "  x  ", "\x00a\x0bb\x7f", "a  b", "", None]

    def plain(t):
        t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", t or "")
        return re.sub(r"\s+", " ", t).strip()

    assert values(spark, texts, X.clean_space) == [plain(t) for t in texts]


def test_words_of_an_empty_text(spark):
    assert values(spark, ["", "a b", None], lambda c: F.size(X.words(c))) == [0, 2, 0]


def test_word_count_bounds(spark):
    texts = [" ".join(["word"] * n) for n in (19, 20, 5000, 5001)]
    assert values(spark, texts, lambda c: X.heuristics(c)["min_words"]) == [False, True, True, True]
    assert values(spark, texts, lambda c: X.heuristics(c)["max_words"]) == [True, True, True, False]


def test_quality_score_matches_python(spark):
    def plain(t):
        w = t.split()
        if len(w) < 20:
            return 0.10
        m = len({x.lower() for x in w} & set(X.EDU_KEYWORDS))
        return min(1.0, 0.30 + 0.40 * min(1.0, m / 5.0) + 0.30 * min(1.0, max(0.0, (sum(map(len, w)) / len(w) - 3.5) / 3.0)))

    texts = ["a b", "because therefore however example result analysis " * 5, "short " * 40, "Data process model of the " + "considerable " * 30]
    texts = [t.strip() for t in texts]
    assert values(spark, texts, X.quality_score) == pytest.approx([plain(t) for t in texts], abs=1e-12)


def test_first_domain_rule_wins(spark):
    got = values(spark, ["def f(): abstract", "the abstract", "a guide", "nothing", None, "x" * 1000 + "forum"], lambda c: X.domain(c)["domain"])
    assert got == ["D2 Code and Mathematics", "D1 Science", "D2 Literature", "D3 General Web", "D3 General Web", "D3 General Web"]
    # Marks are substrings: "int " stands in "point ".
    assert values(spark, ["a point guide"], lambda c: X.domain(c)["confidence"]) == [0.85]


def test_redact_swallows_the_dot_after_an_address(spark):
    assert values(spark, ["write to a.b@c.org. See HTTP://x.org/y now"], X.redact) == ["write to [REDACTED_EMAIL] See [REDACTED_URL] now"]


def test_shingles(spark):
    assert values(spark, ["a b c", "a b c d e f", "", None, "A a"], lambda c: F.array_sort(X.shingles(c))) == [["a", "b", "c"], ["a b c d e", "b c d e f"], [], [], ["a"]]


def test_normalize_matches_python(spark):
    texts = ["<p>a</p><script>no</script>b &amp; c", "ﬁne", "plain ascii  text", "a < b", None, ""]

    def plain(t):
        t = unicodedata.normalize("NFKC", N.strip_markup(t or ""))
        return re.sub(r"\s+", " ", re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", t)).strip()

    assert values(spark, texts, N.normalize) == [plain(t) for t in texts]


def test_scorers(spark):
    scoring.register("half", lambda c: F.lit(0.5))
    assert values(spark, ["x"], lambda c: scoring.passes_quality(c, name="half")) == [True]
    with pytest.raises(ValueError, match="unknown scorer"):
        scoring.score(F.col("t"), "none")


def test_small_helpers(spark):
    assert values(spark, ["D2 Code and Mathematics (x)", "other"], X.pool_of) == ["D2 Code and Mathematics", "D3 General Web"]
    assert spark.range(1).select(X.strip_prompt(F.lit("Q: hi"), F.lit("Q:")).alias("v")).first().v == "hi"
    got = spark.createDataFrame([(n,) for n in (255, 256, 1024, 1025, 4097)], "n int").select(X.effort_band(F.col("n")).alias("v")).collect()
    assert [r.v for r in got] == ["low", "medium", "medium", "high", "ultra"]
