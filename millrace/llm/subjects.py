"""Problem 6: the subject areas of each text.

Words get weights for the subjects in whose labelled rows they stand more often
than their language's rows would have it; a word may speak for several. A
stretch of text (between sentence ends, line breaks and marks of lists) leans
to the subjects its words lean to. A text's terms are, for each subject, the
share of its words in stretches that lean to it and the mean weight of all its
words. A chain of logistic classifiers, one for each subject in turn, reads
them together with source, metadata and structure and with the labels already
given, so that subjects that go together are learned; each link is calibrated
on rows it was not fitted to. The labels of a text are the most probable
combination that a beam search over the chain finds; no rule stands after it
but that junk (as problem 1 finds it) has no subject.

The model is fitted to at most ``TRAIN_ROWS`` labelled rows of at most
``TRAIN_CHARS`` characters, chosen by a hash of their id. Features of these
rows come from weights learned without their own half. All labelled rows have a
subject, so each is used a second time, thinned: as if neutral text had been
added to it until its subjects hold a smaller share, and with the labels it has
then, as a text is about what holds a fifth of it.

Defined results: null, empty and blank texts and junk have no subject; labels
of unknown subjects and of unknown rows are not used; without labels the words
of the subjects' descriptions are all there is to go by.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import quality
from millrace.llm.language import is_word, tokens
from millrace.llm.texts import map_texts

TRAIN_ROWS, TRAIN_CHARS = 4_000, 30_000
SUBJECTS_MOST = 200
BEAM = 8
FEW_SMALL = 0.08
#: What the leans of a stretch's words must add up to.
LEAST_LEAN = 0.6
REMEMBERED = 400_000
#: The feature that holds a subject's share of the words. A text is about a subject that holds FIFTH of it: a thinned row keeps its labels down to that, and from there on a missing label says nothing.
SHARE, FIFTH = 1, 0.2
#: How far thinned rows go down, as shares of what their subjects hold in the row itself.
THINNED = (0.0, 0.6)
#: A word speaks for a subject if at least this share of its rows is about it, at odds this many times those of its language's rows.
LEAST_CHANCE, LEAST_ODDS = 0.45, 4.0
#: A word of a description counts as this many labelled rows.
DESCRIPTION_ROWS = 3


class Terms:
    """Affinities of words to subjects, and the features of texts."""

    def __init__(self, subjects: list[str], weights: dict[str, np.ndarray], sources: dict[str, np.ndarray], domains: dict[str, np.ndarray]):
        self.subjects, self.weights, self.sources, self.domains = subjects, weights, sources, domains
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.rows = [np.zeros(len(self.subjects), np.float32)]
        self.small = [0]
        self.tables = None

    def number(self, token: str) -> int:
        if not is_word(token):
            if len(token) < 4:
                self.numbers[token] = 0
            return 0
        w = self.weights.get(token)
        # All words without an affinity share two rows: small words that bind sentences, and others.
        if w is None:
            k = self.numbers.get("\0common" if token in quality._COMMON else "\0other")
            if k is None:
                k = len(self.rows)
                self.rows.append(np.zeros(len(self.subjects), np.float32))
                self.small.append(int(token in quality._COMMON))
                self.numbers["\0common" if token in quality._COMMON else "\0other"] = k
                self.tables = None
        else:
            k = len(self.rows)
            self.rows.append(w)
            self.small.append(int(token in quality._COMMON))
            self.tables = None
        self.numbers[token] = k
        return k

    def terms_of(self, texts: list[str]) -> np.ndarray:
        """For each text: the shares of its words in stretches about each subject, the share in none, the mean weight of its words for each subject, its words and the share of small words."""
        get, make = self.numbers.get, self.number
        n = len(self.subjects)
        out = np.zeros((len(texts), 2 * n + 3), np.float32)
        for t, text in enumerate(texts):
            if not text:
                continue
            ids = np.array([0, *[k if (k := get(w)) is not None else make(w) for w in tokens(text)]], np.int64)
            if self.tables is None:
                self.tables = np.stack(self.rows), np.array(self.small, np.int64)
            weights, small = self.tables
            words = ids > 0
            total = int(words.sum())
            if not total:
                continue
            starts = np.flatnonzero(~words)
            sums = np.add.reduceat(weights[ids], starts, 0)
            sizes = np.add.reduceat(words.astype(np.int64), starts)
            best = sums.argmax(1)
            clear = sums[np.arange(len(sums)), best] >= LEAST_LEAN
            out[t, : n + 1] = np.bincount(np.where(clear, best, n), sizes, n + 1) / total
            out[t, n + 1 : 2 * n + 1] = sums.sum(0) / total
            out[t, -2] = total
            out[t, -1] = small[ids].sum() / total
        if len(self.numbers) > REMEMBERED:
            self.clear()
        return out

    def features(self, texts: list[str], sources: list, domains: list, tags: list) -> np.ndarray:
        """Rows x subjects x features."""
        return self.combined(self.terms_of(texts), sources, domains, tags)

    def combined(self, terms: np.ndarray, sources: list, domains: list, tags: list) -> np.ndarray:
        n, s = len(terms), len(self.subjects)
        share, weight = terms[:, :s], terms[:, s + 1 : 2 * s + 1]
        rest = np.sort(share, 1)
        zero = np.zeros(s, np.float32)
        source = np.stack([self.sources.get(x, zero) for x in sources]) if n else np.zeros((0, s))
        domain = np.stack([self.domains.get(x, zero) for x in domains]) if n else np.zeros((0, s))
        tagged = np.array([[float(name in (x or "").lower()) for name in self.subjects] for x in tags], np.float32).reshape(n, s)
        top, second = rest[:, -1:], rest[:, -2:-1] if s > 1 else np.zeros((n, 1))
        other = np.where(share == top, second, top)
        few = np.broadcast_to((terms[:, -2:-1] < 30).astype(np.float32), share.shape)
        made = [np.ones_like(share), share, np.minimum(share, 0.25) * 4, np.log(share + 0.02), other, np.broadcast_to(terms[:, s : s + 1], share.shape), source, domain, tagged, np.broadcast_to(terms[:, -1:], share.shape), few, weight]
        return np.stack(made, 2).astype(np.float64)


def thinned(terms: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows as if neutral text had been added to each, and the labels they have then."""
    n, s = labels.shape
    left = (THINNED[0] + (THINNED[1] - THINNED[0]) * (np.arange(n) * 0.6180339887498949 % 1.0))[:, None].astype(np.float32)
    out = terms.copy()
    out[:, :s] *= left
    out[:, s] = 1 - out[:, :s].sum(1)
    out[:, s + 1 : 2 * s + 1] *= left
    return out, labels * (out[:, :s] >= FIFTH)


def language_of(words: set[str]) -> str:
    """The language whose small words a text has most of; empty if it has hardly any."""
    most, lang = max((sum(w in words for w in ws), lang) for lang, ws in quality.COMMON.items())
    return lang if most >= 2 else ""


def affinities(subjects: list[str], words: list[set[str]], labels: np.ndarray, descriptions: dict[str, str], leave: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Weight of each word for each subject: how much more often it stands in the subject's rows than that language's rows would have it, where that is sure."""
    s = len(subjects)
    use = labels / np.maximum(1, labels.sum(1, keepdims=True))
    languages = [language_of(ws) for ws in words]
    keep = [k for k in range(len(words)) if leave is None or not leave[k]]
    overall = 1 + (use[keep].sum(0) if keep else np.zeros(s))
    overall /= overall.sum()
    base = {}
    for lang in set(languages):
        own = [k for k in keep if languages[k] == lang]
        base[lang] = (use[own].sum(0) + 8 * overall) / (len(own) + 8) if lang else overall
    counts: dict[str, np.ndarray] = {}
    expected: dict[str, np.ndarray] = {}
    for k in keep:
        for w in words[k]:
            if w not in counts:
                counts[w], expected[w] = np.zeros(s), np.zeros(s)
            counts[w] += use[k]
            expected[w] += base[languages[k]]
    for name, text in descriptions.items():
        for w in {w for w in tokens(text or "") if is_word(w) and len(w) > 3} - quality._COMMON:
            held = counts.setdefault(w, np.zeros(s))
            held[subjects.index(name)] += DESCRIPTION_ROWS
            expected[w] = expected.get(w, np.zeros(s)) + DESCRIPTION_ROWS * overall
    weights = {}
    for w, c in counts.items():
        n = c.sum()
        if n < 1.5 or w in quality._COMMON:
            continue
        # Few rows prove little: two more are thought to lie as its languages' rows do.
        usual = expected[w] / expected[w].sum()
        p = (c + 2 * usual) / (n + 2)
        telling = (p >= LEAST_CHANCE) & (p * (1 - usual) >= LEAST_ODDS * usual * (1 - p))
        if telling.any():
            weights[w] = np.where(telling, np.log(p / usual), 0).astype(np.float32)
    return weights


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression by Newton's steps."""
    w = np.zeros(x.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


class Chain:
    """Links in order of the subjects' frequency; each sees the features of its subject and the labels of the links before it."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray):
        self.order = np.argsort(-y.sum(0), kind="stable")
        self.links, self.scales = [], []
        for k, s in enumerate(self.order):
            own = self.inputs(x[:, s], y[:, self.order[:k]])
            # Labels may be incomplete: a row much of which is about the subject is no proof against it.
            sure = (y[:, s] > 0) | (x[:, s, SHARE] < FIFTH)
            w = logistic(own[~held & sure], y[~held & sure, s])
            raw = own @ w
            use = held & sure if (held & sure).sum() > 20 else sure
            scale = logistic(np.stack([np.ones(use.sum()), raw[use]], 1), y[use, s], 0.1) if y[use, s].any() else np.array([0.0, 1.0])
            if scale[1] <= 0:
                scale = np.array([0.0, 1.0])
            self.links.append(w)
            self.scales.append(scale)

    @staticmethod
    def inputs(x: np.ndarray, before: np.ndarray) -> np.ndarray:
        given = np.concatenate([before, np.minimum(before.sum(1, keepdims=True), 2)], 1)
        return np.concatenate([x, given], 1)

    def decode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """The most probable combination of labels of each row, and the probability of each label given those before it."""
        n, s, _ = x.shape
        labels, scores = np.zeros((n, 1, 0)), np.zeros((n, 1))
        chances = np.zeros((n, 1, 0))
        for k in range(s):
            b = labels.shape[1]
            own = np.repeat(x[:, self.order[k]], b, 0)
            raw = self.inputs(own, labels.reshape(n * b, k)) @ self.links[k]
            p = 1 / (1 + np.exp(-np.clip(self.scales[k][0] + self.scales[k][1] * raw, -30, 30)))
            p = np.clip(p.reshape(n, b), 1e-9, 1 - 1e-9)
            both = np.concatenate([scores + np.log(1 - p), scores + np.log(p)], 1)
            grown = np.concatenate([np.concatenate([labels, np.full((n, b, 1), v)], 2) for v in (0.0, 1.0)], 1)
            told = np.concatenate([np.concatenate([chances, p[:, :, None]], 2)] * 2, 1)
            best = np.argsort(-both, 1, kind="stable")[:, :beam]
            scores = np.take_along_axis(both, best, 1)
            labels = np.take_along_axis(grown, best[:, :, None], 1)
            chances = np.take_along_axis(told, best[:, :, None], 1)
        out, chance = np.zeros((n, s)), np.zeros((n, s))
        out[:, self.order], chance[:, self.order] = labels[:, 0], chances[:, 0]
        return out, chance


def hinted(rows: list, labels: np.ndarray) -> dict:
    """Smoothed share of each subject for each source or domain, less its share overall."""
    base = labels.mean(0) if len(labels) else 0
    sums: dict = {}
    for r, y in zip(rows, labels):
        held = sums.setdefault(r, [np.zeros(labels.shape[1]), 0])
        held[0] += y
        held[1] += 1
    return {r: ((c + 5 * base) / (n + 5) - base).astype(np.float32) for r, (c, n) in sums.items() if r is not None}


class Model:
    def __init__(self, terms: Terms, chain: Chain | None):
        self.terms, self.chain = terms, chain


def fit(rows: list[tuple], descriptions: dict[str, str]) -> Model:
    """A model from rows (text, source, domain, tags, [subjects]) and the subjects' descriptions."""
    subjects = sorted(descriptions)
    place = {s: k for k, s in enumerate(subjects)}
    rows = [r for r in rows if r[0] and any(s in place for s in r[4])]
    labels = np.zeros((len(rows), len(subjects)))
    for k, r in enumerate(rows):
        for s in r[4]:
            if s in place:
                labels[k, place[s]] = 1
    words = [{w for w in tokens(r[0]) if is_word(w)} for r in rows]
    sources, domains = hinted([r[1] for r in rows], labels), hinted([r[2] for r in rows], labels)
    final = Terms(subjects, affinities(subjects, words, labels, descriptions), sources, domains)
    if len(rows) < 40:
        return Model(final, None)
    part = np.arange(len(rows)) % 2
    x, thin = None, None
    less = np.zeros_like(labels)
    for half in (0, 1):
        own = Terms(subjects, affinities(subjects, words, labels, descriptions, part == half), sources, domains)
        at = np.flatnonzero(part == half)
        terms, where = own.terms_of([rows[k][0] for k in at]), ([rows[k][1] for k in at], [rows[k][2] for k in at], [rows[k][3] for k in at])
        made, (few, less[at]) = own.combined(terms, *where), thinned(terms, labels[at])
        if x is None:
            x, thin = np.zeros((len(rows), *made.shape[1:])), np.zeros((len(rows), *made.shape[1:]))
        x[at], thin[at] = made, own.combined(few, *where)
    held = np.arange(len(rows)) % 5 == 4
    return Model(final, Chain(np.concatenate([x, thin]), np.concatenate([labels, less]), np.concatenate([held, held])))


def labelled(model: Model, texts: list, sources: list, domains: list, tags: list) -> list[list[tuple[str, float, float]]]:
    """(subject, share of the text, probability) of each text."""
    subjects = model.terms.subjects
    texts = [t or "" for t in texts]
    x = model.terms.features(texts, sources, domains, tags)
    share, small = x[:, :, 1], x[:, 0, 9] if len(subjects) else None
    terms_words = np.array([len(t) for t in texts])
    if model.chain is None:
        chosen, chance = (share >= FIFTH).astype(float), share
    else:
        chosen, chance = model.chain.decode(x)
    out = []
    for k in range(len(texts)):
        # Junk is what problem 1 calls so; it is asked about texts with subjects and few small words.
        doubtful = len(subjects) and chosen[k].any() and small[k] < FEW_SMALL
        if not terms_words[k] or (doubtful and quality.describe(texts[k])[-1] == "junk"):
            out.append([])
            continue
        out.append([(subjects[s], float(share[k, s]), float(chance[k, s])) for s in np.flatnonzero(chosen[k] > 0)])
    return out


def training_rows(documents: DataFrame, labels: DataFrame) -> list[tuple]:
    """At most TRAIN_ROWS labelled rows with their subjects, by a hash of their id."""
    by = labels.where(F.col("doc_id").isNotNull() & F.col("subject").isNotNull()).groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    # Bounded: the ids chosen are at most TRAIN_ROWS.
    chosen = by.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(TRAIN_ROWS)
    texts = documents.select("doc_id", "text", "source", F.col("metadata")["domain"].alias("domain"), F.col("metadata")["tags"].alias("tags")).where(F.length("text").between(1, TRAIN_CHARS))
    rows = texts.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").collect()
    return [(r.text, r.source, r.domain, r.tags, r.subjects) for r in rows]


def classify(documents: DataFrame, subjects: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``subject``, ``share``, ``probability``: each subject of each row of ``documents``."""
    rows = subjects.where(F.col("subject").isNotNull()).limit(SUBJECTS_MOST + 1).collect()
    if len(rows) > SUBJECTS_MOST:
        raise ValueError(f"more than {SUBJECTS_MOST} subjects")
    model = fit(training_rows(documents, labels), {r.subject: r.description for r in rows})
    shared = documents.sparkSession.sparkContext.broadcast((model.terms.subjects, model.terms.weights, model.terms.sources, model.terms.domains, model.chain))
    out = T.StructType([T.StructField(id_col, documents.schema[id_col].dataType), T.StructField("subject", T.StringType()), T.StructField("share", T.DoubleType()), T.StructField("probability", T.DoubleType())])
    columns = documents.select(F.col(f"`{id_col}`"), "text", "source", F.col("metadata")["domain"].alias("domain"), F.col("metadata")["tags"].alias("tags"))

    def make():
        names, weights, sources, domains, chain = shared.value
        own = Model(Terms(names, weights, sources, domains), chain)

        def act(keys: list, texts: list, where: list, domain: list, tags: list) -> list:
            rows = [(key, *f) for key, found in zip(keys, labelled(own, texts, where, domain, tags)) for f in found]
            return [list(x) for x in zip(*rows)] if rows else [[], [], [], []]

        return act

    return map_texts(columns, [id_col, "text", "source", "domain", "tags"], "text", out, make)


def composition(documents: DataFrame, subjects: DataFrame, labels: DataFrame) -> DataFrame:
    """``subject``, ``documents``, ``share`` (of all rows, which may have several subjects), with the row ``none`` for texts without one."""
    from pyspark.sql import Window

    found = classify(documents, subjects, labels)
    by = found.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    # All rows, those without a subject too; each row's subjects are few.
    rows = documents.select("doc_id").join(by, "doc_id", "left").select(F.explode(F.when(F.size("subjects") > 0, F.array_append("subjects", "*")).otherwise(F.array(F.lit("none"), F.lit("*")))).alias("subject"))
    counts = rows.groupBy("subject").agg(F.count("*").alias("documents"))
    # One row for each subject: a handful.
    whole = F.max(F.when(F.col("subject") == "*", F.col("documents"))).over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("share", F.col("documents") / whole).where("subject <> '*'")
