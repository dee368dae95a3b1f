"""Toxicity by a convolutional text classifier, trained in numpy.

A word is the sum of hashed embeddings, its own and those of its first five and three letters. Filters of several
widths slide over the words; the greatest value of each filter in the text feeds a logistic output. Embeddings
start from each bucket's log-odds between the labels, so that little data suffices.

Training draws at most TRAIN_ROWS labelled documents of at most TRAIN_CHARS characters from outside the held-out
third. Two halves score each other; on these scores a threshold is set for each language (told by the letters
of the text, never by a column), or for all together where a language has fewer than FEW toxic rows. A score is
the model's log-odds, shifted so that the threshold of the text's language stands at 0.7.

Scoring covers whole texts in blocks of words that overlap by the widest filter, so memory stays bounded and the
maxima are exact. A null or empty text has no words and gets the score of a text of padding. Rows that repeat
each other get the same score. With no labelled rows the model is untrained and scores every text alike, below
the threshold.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgraft.llm.common import table, under_own_names
from lexgraft.llm.learn import held_out, sampled

BUCKETS, DIM, FILTERS, WIDTHS, PREFIXES = 1 << 15, 8, 6, (1, 2, 3), (5, 3)
TRAIN_ROWS, TRAIN_CHARS, STEPS, FEW = 6000, 20_000, 24_000, 15
THRESHOLD = 0.7
BLOCK = 1 << 15
CACHE = 1 << 18
# Letters that tell a language in these alphabets; texts without them are one group.
LETTERS = {"de": "äöüß", "es": "ñóíúá", "fr": "éèêàçùâîô"}
_BLANK = bytes.maketrans((string.punctuation + string.digits).encode(), b" " * len(string.punctuation + string.digits))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_BLANK).split()


def language(text: str | None) -> int:
    """Number of the group whose letters are most frequent: 0 if there are none."""
    low = (text or "").lower()
    counts = [sum(map(low.count, letters)) for letters in LETTERS.values()]
    return 1 + int(np.argmax(counts)) if any(counts) else 0


class Vocabulary(dict):
    """Buckets of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        letters = word.decode()
        parts = (word, *(f"^{letters[:n]}".encode() for n in PREFIXES))
        self[word] = found = tuple(xxhash.xxh32_intdigest(p) % (BUCKETS - 1) + 1 for p in parts)
        return found

    def ids(self, words: list[bytes]) -> np.ndarray:
        """(words, 1 + prefixes); padded with bucket 0 to the widest filter."""
        found = np.array([self[w] for w in words], np.int32).reshape(-1, 1 + len(PREFIXES))
        return np.vstack([found, np.zeros((max(0, max(WIDTHS) - len(found)), 1 + len(PREFIXES)), np.int32)])


class Model:
    def __init__(self, seed: int = 0):
        pick = np.random.default_rng(seed)
        self.e = np.zeros((BUCKETS, DIM), np.float32)
        self.e[1:] = pick.normal(0, 0.05, (BUCKETS - 1, DIM))
        self.w = [pick.normal(0, 0.1, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.b = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.v = pick.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
        self.c = -2.0
        self.shift = np.zeros(1 + len(LETTERS))

    def start(self, rows: list[np.ndarray], y: np.ndarray) -> None:
        """First embedding axis from the log-odds of the buckets; one filter of each width reads it."""
        counts = np.zeros((2, BUCKETS))
        for ids, label in zip(rows, y, strict=True):
            counts[label, np.unique(ids)] += 1
        n = np.bincount(y, minlength=2)
        odds = np.log((counts[1] + 0.5) / (n[1] + 1)) - np.log((counts[0] + 0.5) / (n[0] + 1))
        seen = counts.sum(axis=0)
        self.e[:, 0] = np.clip(odds * np.sqrt(seen / (seen + 4)), -2, 4) / (1 + len(PREFIXES))
        self.e[0] = 0
        self.c = float(np.log((n[1] + 0.5) / (n[0] + 0.5)))
        for k, w in enumerate(self.w):
            w[0, 0, 0] = 1.0
            self.b[k][0] = -1.0
            self.v[k * FILTERS] = 1.0

    def embedded(self, ids: np.ndarray) -> np.ndarray:
        x = self.e[ids[:, 0]]
        for col in range(1, ids.shape[1]):
            x += self.e[ids[:, col]]
        return x

    def maxima(self, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each width the greatest value of each filter, and where it is."""
        x, out = self.embedded(ids), []
        for w in self.w:
            k = len(w)
            z = x[: len(x) - k + 1] @ w[0]
            for o in range(1, k):
                z += x[o : len(x) - k + 1 + o] @ w[o]
            at = z.argmax(axis=0)
            out.append((z[at, np.arange(FILTERS)], at))
        return out

    def train(self, rows: list[np.ndarray], y: np.ndarray, seed: int = 0) -> Model:
        if not 0 < y.sum() < len(y):
            return self
        self.start(rows, y)
        pick, rate, g2 = np.random.default_rng(seed), 0.08, [np.full_like(p, 1e-2) for p in (self.e, *self.w, *self.b, self.v)]
        ge, gw, gb, gv = g2[0], g2[1 : 1 + len(WIDTHS)], g2[1 + len(WIDTHS) : -1], g2[-1]
        for _ in range(int(np.clip(STEPS // len(y), 2, 12))):
            for i in pick.permutation(len(y)):
                ids, found = rows[i], self.maxima(rows[i])
                a = np.concatenate([np.maximum(m + b, 0) for (m, _), b in zip(found, self.b, strict=True)])
                g = 1 / (1 + np.exp(-(a @ self.v + self.c))) - y[i]
                if abs(g) < 0.02:
                    continue
                da = g * self.v * (a > 0)
                dv = g * a + 1e-4 * self.v
                gv += dv * dv
                self.v -= rate * dv / np.sqrt(gv)
                self.c -= 0.02 * g
                for k, (_, at) in enumerate(found):
                    d = da[k * FILTERS : (k + 1) * FILTERS]
                    if not d.any():
                        continue
                    gb[k] += d * d
                    self.b[k] -= rate * d / np.sqrt(gb[k])
                    for o in range(WIDTHS[k]):
                        pair = ids[at + o]
                        x = self.embedded(pair)
                        dx = d[:, None] * self.w[k][o].T
                        dw = (d[:, None] * x).T + 1e-4 * self.w[k][o]
                        gw[k][o] += dw * dw
                        self.w[k][o] -= rate * dw / np.sqrt(gw[k][o])
                        for col in range(pair.shape[1]):
                            np.add.at(ge, pair[:, col], dx * dx)
                            np.add.at(self.e, pair[:, col], -rate * dx / np.sqrt(ge[pair[:, col]]))
                self.e[0] = 0
        return self

    def logit(self, words: list[bytes], vocabulary: Vocabulary) -> float:
        """Of one whole text, block after block."""
        best, over = None, max(WIDTHS) - 1
        for at in range(0, max(1, len(words) - over), BLOCK):
            found = np.concatenate([m for m, _ in self.maxima(vocabulary.ids(words[at : at + BLOCK + over]))])
            best = found if best is None else np.maximum(best, found)
        return float(np.maximum(best + np.concatenate(self.b), 0) @ self.v + self.c)

    def score(self, text: str | None, vocabulary: Vocabulary) -> float:
        z = self.logit(words_of(text), vocabulary) + self.shift[language(text)]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The logit that parts the labels with the highest F1: the middle of the best gap."""
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    i = int(np.argmax(f1))
    return float((z[order[i]] + (z[order[i + 1]] if i + 1 < len(z) else z[order[i]] - 1)) / 2)


def fit(texts: list[str], labels: list[int], seed: int = 0) -> Model:
    vocabulary, y = Vocabulary(), np.array(labels, np.int64)
    words = [words_of(t) for t in texts]
    rows = [vocabulary.ids(w) for w in words]
    half = np.random.default_rng(seed).permutation(len(y)) % 2
    z = np.zeros(len(y))
    for k in (0, 1):
        part = Model(seed).train([rows[i] for i in np.flatnonzero(half != k)], y[half != k], seed)
        for i in np.flatnonzero(half == k):
            z[i] = part.logit(words[i], vocabulary)
    model = Model(seed).train(rows, y, seed)
    if not 0 < y.sum() < len(y):
        return model
    group, middle = np.array([language(t) for t in texts]), np.log(THRESHOLD / (1 - THRESHOLD))
    model.shift[:] = middle - best_cut(z, y)
    for k in range(len(model.shift)):
        if y[group == k].sum() >= FEW:
            model.shift[k] = middle - best_cut(z[group == k], y[group == k])
    return model


def trained(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    text = F.col(text_col).cast("string")
    rows = sampled(docs.filter(F.length(text) <= TRAIN_CHARS), labels, label, TRAIN_ROWS, [text.alias("t")], id_col)
    return fit([r.t for r in rows], [r.y for r in rows])


@under_own_names
def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with all columns and the score of the whole text."""
    carried = docs.sparkSession.sparkContext.broadcast(model)  # about 1 MB, whatever the corpus
    place = docs.columns.index(text_col)
    kept = [c for c in docs.columns if c != name]
    places = [docs.columns.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, model = Vocabulary(), carried.value
        for batch in batches:
            found = pa.array([model.score(t.as_py(), vocabulary) for t in batch.column(place)], pa.float64())
            columns = [batch.column(i) for i in places]
            yield pa.RecordBatch.from_arrays([*columns, found], [*kept, name])

    schema = docs.select(*kept).schema.add(name, "double")
    return docs.mapInArrow(run, schema)


def keep_civil(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is below the threshold; all columns stay."""
    model = trained(docs, labels, label, id_col, text_col)
    name = "__toxic" + "_" * max(map(len, docs.columns))  # longer than any column's
    return scored(docs, model, id_col, text_col, name).filter(F.col(name) < THRESHOLD).drop(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = trained(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, model)
    return out.select("doc_id", held_out("doc_id"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op1_toxicity": op1_toxicity}
SQL: dict[str, str] = {}
