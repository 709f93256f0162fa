"""A registry of scorers, so that a model can take a heuristic's place.

A scorer maps a Column of texts to a Column of scores in [0, 1]. Register an
iterator ``pandas_udf`` to load a model once in each worker.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import DOMAIN_CHARS, QUALITY_THRESHOLD, domain, pool_of, quality_score

SCORERS: dict[str, Callable[[Column], Column]] = {"heuristic": quality_score}


def register(name: str, scorer: Callable[[Column], Column]) -> None:
    SCORERS[name] = scorer


def score(text: Column, name: str = "heuristic") -> Column:
    if name not in SCORERS:
        raise ValueError(f"unknown scorer {name!r}; known are {sorted(SCORERS)}")
    return SCORERS[name](text)


def passes_quality(text: Column, threshold: float = QUALITY_THRESHOLD, name: str = "heuristic") -> Column:
    return score(text, name) >= threshold


#: Models that label the subject of a text: a Column of texts to a struct of ``label`` and ``score``, or null where they fail.
LABELLERS: dict[str, Callable[[Column], Column]] = {}


def register_labeller(name: str, labeller: Callable[[Column], Column]) -> None:
    LABELLERS[name] = labeller


def domain_of(text: Column, name: str | None = None, chars: int | None = DOMAIN_CHARS) -> Column:
    """``domain`` and ``confidence`` by a registered labeller of the text's first characters; by the rules where none is named or it gives nothing."""
    rules = domain(text, chars)
    if name is None:
        return rules
    if name not in LABELLERS:
        raise ValueError(f"unknown labeller {name!r}; known are {sorted(LABELLERS)}")
    told = LABELLERS[name](text if chars is None else F.substring(text, 1, chars))
    found = F.struct(pool_of(told["label"]).alias("domain"), told["score"].cast("double").alias("confidence"))
    return F.when(told["label"].isNotNull(), found).otherwise(F.struct(rules["domain"].alias("domain"), rules["confidence"].cast("double").alias("confidence")))
