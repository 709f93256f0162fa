"""Problem 2: the language of each text, and of each stretch of it.

Words are vectors of hashed character n-grams weighted by TF-IDF; a stretch
(what stands between sentence ends, line breaks and markup) is the sum of its
words, made unit length, and is compared by cosine with several centroids of
each language. The languages are those that the labels of a bounded sample of
rows name; the centroids are clustered from these rows, after rows that lie
nearer to another label's others than to their own label's have been left out,
because labels may be wrong. A stretch is rejected if it lies farther from all
centroids of its nearest language than nearly all stretches of that language's
own rows of its size do, or nearest to the centroids of texts labelled as
having no language (source code and the like). Confidences are calibrated on
the sample: what share of stretches with such a lead over the next language
were of the language.

As dot products are linear in the words, each distinct word is scored once in a
worker and remembered, with a projection of its vector on fixed random signs.
From that the length of a sum is estimated (standard error one eighth); wherever
the estimate leaves the rejection open, the length is counted from the n-grams.

Defined results: null, empty and blank texts and texts without letters have no
language; repeated rows are repeated; with no labelled rows at all the
centroids come from the built-in seed words alone.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import quality
from millrace.llm.texts import map_texts

NONE = "zxx"
#: Codes that say nothing of the language.
SILENT = ("", "und", "unk", "mul", "mis", "xx", "none", "null", "unknown", "n/a", "na", "qaa")
#: Codes of the same language, and codes that say that there is none.
CODES = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "hin": "hi", "mar": "mr", "ben": "bn", "tam": "ta", "zxx": NONE, "code": NONE}

#: Bounds of the training sample: rows of each label, and characters of a row. Rows are chosen by a hash of their id.
SAMPLE_ROWS, SAMPLE_CHARS = 200, 6_000
DIMENSIONS, PROJECTION = 16384, 32
CLUSTERS, CLUSTERS_NONE = 4, 6
LEAST_SHARE = 0.1
BLOCK_LETTERS = 40
NEARER = 0.85
#: The cosine that this share of a language's own stretches do not reach, of which a stretch must reach this part; sizes (letters) up to which stretches are measured together; how many times the projection's standard error an estimate must clear.
REJECTED, NEAR, SIZES, CLEAR = 0.005, 0.7, (20, 40, 80, 160), 3.0
REMEMBERED = 300_000

_MARKS = quality._MARKS
_TOKEN = re.compile(rf"<[^<>]+>|\S+@\S+|https?://\S+|[^\W\d_](?:[{_MARKS}]|[^\W\d_])*|[\n.!?।॥:|;]+")


def label_of(column: Column) -> Column:
    """The language a label names (NONE for code and the like), or null if it says nothing."""
    main = F.split(F.lower(F.trim(column)), "[-_ ]").getItem(0)
    known = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    return F.when(~main.isin(*SILENT) & main.rlike("^[a-z]{2,8}$"), F.coalesce(known[main], main))


def ngrams(word: str) -> list[int]:
    marked = f"^{word}$"
    found = [zlib.crc32(marked[k : k + n].encode()) % DIMENSIONS for n in (1, 2, 3, 4) for k in range(len(marked) - n + 1)]
    return found


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def is_word(token: str) -> bool:
    return token[0] not in "<\n.!?।॥:|;h" and "@" not in token or (token[0] == "h" and "://" not in token and "@" not in token)


class Model:
    """Centroids (rows), the language of each, inverse document frequencies, the least cosine by language and size, and the calibration of leads."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, languages: list[str]):
        self.idf, self.centroids, self.languages = idf, centroids, languages
        self.names = [*sorted(set(languages) - {NONE}), NONE]
        self.least = np.zeros((len(self.names), len(SIZES) + 1), np.float32)
        self.sure = np.array([0.0, 2.0])

    def confidence(self, lead: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.sure[0] + self.sure[1] * lead, -30, 30)))


def fit(rows: list[tuple[str, str]]) -> Model:
    """A model from (label, text) rows; labels as ``label_of`` gives them. Without any rows, from the seed words."""
    rows = rows or [(lang, " ".join(ws)) for lang, ws in quality.COMMON.items() for _ in range(2)]
    memory: dict[str, np.ndarray] = {}

    def count(text: str, into: np.ndarray) -> None:
        for w in tokens(text):
            if is_word(w):
                if w not in memory:
                    memory[w] = np.array(ngrams(w))
                np.add.at(into, memory[w], 1)

    # Filled in place: the matrix is the largest thing the driver holds.
    matrix = np.zeros((len(rows), DIMENSIONS), np.float32)
    for k, (_, text) in enumerate(rows):
        count(text, matrix[k])
    labels = np.array([label for label, _ in rows])
    labels[matrix.sum(1) == 0] = NONE
    seen = np.array([np.count_nonzero(matrix[:, k : k + 512], 0) for k in range(0, DIMENSIONS, 512)]).reshape(-1)
    idf = np.log((1 + len(matrix)) / (1 + seen)).astype(np.float32) + np.float32(0.1)
    matrix *= idf
    matrix /= np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None] + np.float32(1e-9)
    names = sorted(set(labels))
    own = labels.copy()
    for _ in range(3):
        sums = np.stack([matrix[own == n].sum(0) for n in names])
        lengths = np.sqrt(np.einsum("ij,ij->i", sums, sums))
        near = matrix @ sums.T
        # To its own label's rows a row is compared without itself.
        alike = near / (lengths + 1e-9)
        for k, n in enumerate(names):
            at = np.flatnonzero(own == n)
            alike[at, k] = (near[at, k] - 1) / np.sqrt(np.maximum(lengths[k] ** 2 - 2 * near[at, k] + 1, 1e-9))
        own = np.where(np.array(names)[alike.argmax(1)] == labels, labels, "")
    centroids, of = [], []
    for n in names:
        members = matrix[own == n]
        if len(members) >= 2 or n == NONE and len(members):
            for c in clustered(members, CLUSTERS_NONE if n == NONE else CLUSTERS):
                centroids.append(c)
                of.append(str(n))
    if not centroids:
        return fit([])
    model = Model(idf, np.stack(centroids).astype(np.float32), of)
    del matrix
    calibrate(model, [r for r, kept in zip(rows, own) if kept])
    return model


def calibrate(model: Model, rows: list[tuple[str, str]]) -> None:
    """The least cosines and the confidences, from the stretches of labelled rows."""
    scorer = Scorer(model, exact=True)
    held: dict[tuple, list] = {}
    leads, right = [], []
    for (label, _), blocks in zip(rows, scorer.languages_of([t for _, t in rows])):
        for k, top, second, letters in blocks:
            if label == NONE or label not in model.names:
                continue
            is_own = model.names[k] == label
            leads.append((top - second) / (abs(top) + 1e-9))
            right.append(float(is_own))
            if is_own:
                held.setdefault((k, int(np.searchsorted(SIZES, letters))), []).append(top)
    for k in range(len(model.names) - 1):
        told = 0.0
        # A size without stretches takes the least of the size below it.
        for size in range(len(SIZES) + 1):
            cosines = held.get((k, size), [])
            if len(cosines) >= 20:
                told = max(told, float(np.quantile(cosines, REJECTED)))
            model.least[k, size] = NEAR * told
    if 0 < sum(right) < len(right):
        x, y = np.stack([np.ones(len(leads)), np.array(leads)], 1), np.array(right)
        w = np.zeros(2)
        for _ in range(20):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2), x.T @ (p - y) + 0.01 * w)
        if w[1] > 0:
            model.sure = w


def unit(v: np.ndarray) -> np.ndarray:
    return v / (np.linalg.norm(v) + 1e-9)


def clustered(members: np.ndarray, k: int) -> list[np.ndarray]:
    """Unit centroids of a spherical k-means; the first ones are the means of parts of like distance from the mean of all."""
    k = max(1, min(k, len(members) // 8))
    order = np.argsort(members @ unit(members.mean(0)), kind="stable")
    centroids = np.stack([unit(members[part].mean(0)) for part in np.array_split(order, k)])
    for _ in range(8):
        which = (members @ centroids.T).argmax(1)
        centroids = np.stack([unit(members[which == c].mean(0)) if (which == c).any() else centroids[c] for c in range(k)])
    counts = np.bincount((members @ centroids.T).argmax(1), minlength=k)
    return [c for c, n in zip(centroids, counts) if n >= 2] or [unit(members.mean(0))]


class Scorer:
    """A model with the scores of the words met so far."""

    def __init__(self, model: Model, exact: bool = False):
        self.model, self.exact = model, exact
        self.signs = np.random.default_rng(7).choice(np.array([-1, 1], np.float32), (DIMENSIONS, PROJECTION)) / np.sqrt(np.float32(PROJECTION))
        self.columns = np.concatenate([model.centroids.T, self.signs], 1) * model.idf[:, None]
        self.languages = model.names
        self.of = [[k for k, n in enumerate(model.languages) if n == lang] for lang in self.languages]
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.grams = [np.empty(0, np.int16)]
        self.scores = np.zeros((1 << 14, self.columns.shape[1]), np.float32)
        self.letters = np.zeros(1 << 14, np.int32)
        self.used = 1

    def number(self, token: str) -> int:
        if not is_word(token):
            if len(token) < 4:
                self.numbers[token] = 0
            return 0
        k = self.used
        if k == len(self.letters):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        found = np.array(ngrams(token), np.int16)
        self.grams.append(found)
        self.scores[k] = self.columns[found].sum(0)
        self.letters[k] = len(token)
        self.used = k + 1
        self.numbers[token] = k
        return k

    def ids(self, text: str) -> np.ndarray:
        get, make = self.numbers.get, self.number
        return np.array([k if (k := get(t)) is not None else make(t) for t in tokens(text)], np.int64)

    def length_of(self, ids: np.ndarray) -> float:
        """The length of the vector of words, counted from their n-grams."""
        told, counts = np.unique(np.concatenate([self.grams[k] for k in ids.tolist()]), return_counts=True)
        return float(np.linalg.norm(counts * self.model.idf[told])) + 1e-9

    def languages_of(self, texts: list[str]) -> list[list[tuple[int, float, float, int]]]:
        """For each text, its blocks with letters: (place of the language or -1 if rejected, cosine, cosine of the next language, letters).

        A block is a stretch of at least BLOCK_LETTERS letters or the least number of stretches that hold as many together.
        """
        parts, sizes = [], []
        found: list[list] = []

        def flush() -> None:
            if not parts:
                return
            ids = np.concatenate(parts)
            starts = np.flatnonzero(ids == 0)
            letters = np.add.reduceat(self.letters[ids], starts).tolist()
            blocks, held, k = [], [], 0
            for n in sizes:
                mine, sum_ = [], 0
                for j in range(k, k + n):
                    if sum_ >= BLOCK_LETTERS or not mine:
                        mine.append(j)
                        sum_ = 0
                    sum_ += letters[j]
                if sum_ < BLOCK_LETTERS and len(mine) > 1:
                    mine.pop()
                blocks += mine
                held.append(len(mine))
                k += n
            at = starts[blocks]
            sums = np.add.reduceat(self.scores[ids], at, 0)
            size = np.add.reduceat(self.letters[ids], at)
            n = len(self.model.languages)
            length = np.linalg.norm(sums[:, n:], axis=1) + 1e-9
            ends = np.append(starts, len(ids))[np.array(blocks, np.int64) + 1]
            by = np.full((len(at), len(self.languages)), -1.0, np.float32)
            for c, columns in enumerate(self.of):
                if columns:
                    by[:, c] = sums[:, columns].max(1)
            by /= length[:, None]
            rows = np.arange(len(by))
            # A block goes to its text's main language unless another is clearly nearer.
            of = np.repeat(np.arange(len(held)), held)
            whole = np.zeros((len(held), by.shape[1]))
            np.add.at(whole, of, by * size[:, None])
            main = whole.argmax(1)[of]
            first = by.argmax(1)
            first = np.where(by[rows, main] >= NEARER * by[rows, first], main, first)
            least = self.model.least[first, np.searchsorted(SIZES, size)]
            top = by[rows, first]
            # The estimate of the length may be wrong by a few standard errors; where that matters, it is counted.
            error = CLEAR * (0.5 / PROJECTION) ** 0.5
            doubtful = self.exact | ((top * (1 - error) < least) & (least <= top * (1 + error)))
            for k in np.flatnonzero(doubtful & (size > 0)):
                by[k] *= length[k] / self.length_of(ids[at[k] : ends[k]])
            top = by[rows, first]
            by[rows, first] = -1.0
            made = list(zip(np.where((top < least) & (not self.exact), -1, first).tolist(), top.tolist(), by.max(1).tolist(), size.tolist()))
            k = 0
            for n in held:
                found.append([r for r in made[k : k + n] if r[3]])
                k += n
            parts.clear()
            sizes.clear()
            if self.used > REMEMBERED:
                self.clear()

        held = 0
        for t in texts:
            ids = np.concatenate([[0], self.ids(t)]) if t else np.zeros(1, np.int64)
            parts.append(ids)
            sizes.append(int((ids == 0).sum()))
            held += len(ids)
            if held > 50_000:
                flush()
                held = 0
        flush()
        return found


    def placed(self, text: str, wanted: set[str]) -> list[tuple[int, int, str, float]]:
        """(first character, character after the last, language, confidence) of the stretches of ``wanted`` languages, neighbours of one language joined."""
        lowered = text.lower()
        if len(lowered) != len(text):
            lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        breaks = [m.end() for m in _TOKEN.finditer(lowered) if not is_word(m.group())]
        edges = [0, *breaks, len(text)]
        out: list[list] = []
        for a, b, blocks in zip(edges, edges[1:], self.languages_of([text[a:b] for a, b in zip(edges, edges[1:])])):
            if b <= a:
                continue
            lang = self.languages[blocks[0][0]] if blocks and blocks[0][0] >= 0 else None
            n = sum(x[3] for x in blocks)
            if lang in wanted and n >= BLOCK_LETTERS or (lang in wanted and not out):
                sure = float(self.model.confidence((blocks[0][1] - blocks[0][2]) / (abs(blocks[0][1]) + 1e-9)))
                if out and out[-1][2] == lang:
                    out[-1][1], out[-1][3], out[-1][4] = b, out[-1][3] + sure * n, out[-1][4] + n
                else:
                    out.append([a, b, lang, sure * n, n])
            elif out:
                out[-1][1] = b
        return [(a, b, lang, held / max(1, n)) for a, b, lang, held, n in out]


def summary(model: Model, stretches: list[tuple]) -> tuple[list[tuple[str, float, float]], float]:
    """(language, share of the letters, confidence), the largest first, and the share of letters of no language."""
    total = sum(s[3] for s in stretches)
    if not total:
        return [], 0.0
    by: dict[int, list[float]] = {}
    for k, top, second, n in stretches:
        held = by.setdefault(k, [0.0, 0.0])
        held[0] += n
        held[1] += n * (top - second) / (abs(top) + 1e-9)
    none = sum(by[k][0] for k in (-1, len(model.names) - 1) if k in by) / total
    rows = [(model.names[k], held[0] / total, float(model.confidence(held[1] / held[0]))) for k, held in by.items() if 0 <= k < len(model.names) - 1]
    return sorted(rows, key=lambda r: (-r[1], r[0])), none


def sample(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "lang") -> list[tuple[str, str]]:
    """At most about SAMPLE_ROWS labelled rows of each label with texts of 20 to SAMPLE_CHARS characters, by a hash of the id."""
    rows = df.select(label_of(F.col(label_col)).alias("label"), F.col(text_col).alias("t"), F.abs(F.xxhash64(F.lit(3), F.col(id_col))).alias("h")).where(F.col("label").isNotNull() & F.length("t").between(20, SAMPLE_CHARS))
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    keep = F.lit(False)
    for label, n in counts.items():
        share = min(1.0, SAMPLE_ROWS * (3 if label in (NONE, "en") else 1) / n)
        keep = keep | ((F.col("label") == label) & ((F.col("h") % 1_000_000) < int(1_000_000 * share)))
    return [(r.label, r.t) for r in rows.where(keep).select("label", "t").orderBy("label", "t").collect()]


#: The least confidence and share of the letters of a second language in a list or table.
SURE, LEAST_LISTED = 0.95, 0.25
FOUND = T.ArrayType(T.StructType([T.StructField("lang", T.StringType(), False), T.StructField("share", T.DoubleType(), False), T.StructField("confidence", T.DoubleType(), False)]), False)


def judged(model: Model, text: str, blocks: list[tuple], label: str | None) -> tuple[str | None, list[tuple[str, float, float]]]:
    """The kind of a text (``text``, ``none`` for source code, junk and what no language is near, null without letters) and its languages of a tenth of the letters or more.

    The label decides nothing; a text in one language that its label names
    only needs no second look. Of any other, the statistics of problem 1 tell
    whether it is natural language. Words of lists and tables stand without
    what binds sentences and tell languages apart less surely, so that a second
    language must hold more of them.
    """
    if not blocks:
        return None, []
    found, none = summary(model, blocks)
    found = [f for f in found if f[1] >= LEAST_SHARE]
    if none > 0.5 or not found:
        return "none", []
    if len(found) == 1 and found[0][0] == label and none < 0.1:
        return "text", found
    told = dict(zip((n for n, _ in quality.STATS), quality.describe(text)))
    if told["body"] == "junk" or (told["body"] is None and told["code_share"] > 0.5):
        return "none", []
    if told["body"] in ("list", "table"):
        found = found[:1] + [f for f in found[1:] if f[2] >= SURE and f[1] >= LEAST_LISTED]
    return "text", found


def _model(df: DataFrame, id_col: str, text_col: str, label_col: str | None, model: Model | None) -> Model:
    return model or fit(sample(df, text_col, id_col, label_col) if label_col else [])


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", model: Model | None = None) -> DataFrame:
    """``id_col``, ``kind``, ``main``, ``confidence`` and ``languages`` of each row of ``df``.

    Without a ``model``, one is fitted to a bounded sample of ``df``'s labelled rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(_model(df, id_col, text_col, label_col, model))
    out = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("kind", T.StringType()), T.StructField("main", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("languages", FOUND)])
    rows = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), label_of(F.col(f"`{label_col}`")).alias("_label"))

    def make():
        scorer = Scorer(shared.value)

        def act(keys: list, texts: list, labels: list) -> list:
            told = [judged(scorer.model, t, b, label) for t, b, label in zip(texts, scorer.languages_of(texts), labels)]
            return [keys, [k for k, _ in told], [f[0][0] if f else None for _, f in told], [f[0][2] if f else None for _, f in told], [[{"lang": a, "share": b, "confidence": c} for a, b, c in f] for _, f in told]]

        return act

    return map_texts(rows, [id_col, text_col, "_label"], text_col, out, make)


def segments(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", model: Model | None = None) -> DataFrame:
    """The stretches of each text in more than one language: ``id_col``, ``segment`` (from 0), ``first``, ``after`` (characters), ``lang``, ``confidence``. Neighbouring stretches of one language are joined."""
    shared = df.sparkSession.sparkContext.broadcast(_model(df, id_col, text_col, label_col, model))
    out = T.StructType([T.StructField(id_col, df.schema[id_col].dataType)] + [T.StructField(n, T.IntegerType(), False) for n in ("segment", "first", "after")] + [T.StructField("lang", T.StringType(), False), T.StructField("confidence", T.DoubleType(), False)])
    rows = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), label_of(F.col(f"`{label_col}`")).alias("_label"))

    def make():
        scorer = Scorer(shared.value)

        def act(keys: list, texts: list, labels: list) -> list:
            rows = []
            for key, text, blocks, label in zip(keys, texts, scorer.languages_of(texts), labels):
                kind, found = judged(scorer.model, text, blocks, label)
                if kind != "text" or len(found) < 2:
                    continue
                for k, (a, b, lang, sure) in enumerate(scorer.placed(text, {f[0] for f in found})):
                    rows.append((key, k, a, b, lang, sure))
            return [list(x) for x in zip(*rows)] if rows else [[] for _ in out.fields]

        return act

    return map_texts(rows, [id_col, text_col, "_label"], text_col, out, make)


def mislabelled(documents: DataFrame, shards: DataFrame, model: Model | None = None) -> DataFrame:
    """``unit``, ``unit_id``, ``lang``: documents whose label is missing, says nothing or is wrong, or that hold two languages; shards whose label is not the language of most of their documents.

    One pass over the texts gives both the documents' rows and their votes for
    their shard; only those few words are shuffled, by document or shard.
    """
    shared = documents.sparkSession.sparkContext.broadcast(_model(documents, "doc_id", "text", "lang", model))
    out = T.StructType([T.StructField(n, T.StringType()) for n in ("unit", "unit_id", "lang")])
    rows = documents.select(F.col("doc_id").cast("string").alias("id"), "text", label_of(F.col("lang")).alias("label"), "shard_id")

    def make():
        scorer = Scorer(shared.value)

        def act(keys: list, texts: list, labels: list, owners: list) -> list:
            rows = []
            for key, text, blocks, label, owner in zip(keys, texts, scorer.languages_of(texts), labels, owners):
                kind, found = judged(scorer.model, text, blocks, label)
                if kind == "text" and (len(found) > 1 or found[0][0] != label):
                    rows += [("document", key, f[0]) for f in found]
                if kind and owner is not None:
                    rows.append(("shard", owner, found[0][0] if found else NONE))
            return [list(x) for x in zip(*rows)] if rows else [[], [], []]

        return act

    told = map_texts(rows, ["id", "text", "label", "shard_id"], "text", out, make)
    counted = told.groupBy("unit", "unit_id", "lang").agg(F.count("*").alias("n"))
    gathered = counted.groupBy("unit", "unit_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "lang"))).alias("votes"))
    once = shards.where(F.col("shard_id").isNotNull()).groupBy("shard_id").agg(F.max_by("language_script", "ingested_at").alias("script"), F.lit(True).alias("known"))
    joined = gathered.join(once.select(F.lit("shard").alias("unit"), F.col("shard_id").alias("unit_id"), label_of(F.col("script")).alias("label"), "known"), ["unit", "unit_id"], "left")
    top = F.col("votes")[0]["lang"]
    langs = F.when(F.col("unit") == "document", F.transform("votes", lambda v: v["lang"])).when(F.col("known") & (top != NONE) & ~F.col("label").eqNullSafe(top), F.array(top))
    return joined.select("unit", "unit_id", F.explode(langs).alias("lang"))
