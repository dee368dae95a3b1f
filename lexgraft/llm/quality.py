"""Quality by a sparse rule ensemble over statistics of a text.

The statistics are Spark column expressions over the whole text. On at most TRAIN_ROWS labelled documents of any
length from outside the held-out third (drawn by a hash of their ids; the driver sees their statistics only),
gradient-boosted shallow trees are grown in numpy; every path from a root is a conjunctive rule. A logistic regression
with an L1 penalty weighs the rules (proximal gradient; the penalty is chosen on a fifth of the rows); most get weight
0. What is left is compiled into one Spark column expression, so scoring is a projection.

Results: null texts count as empty; texts of any length are taken whole; an empty table gives an empty one; columns of
any name stay, but for one that is called as the score; an empty text has all statistics 0 and the score that the
rules give it; rows that repeat each other get the same score. With fewer than two labels to learn from every score is
the base rate (0.5 without any row).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgraft.llm.common import WORD, table, under_own_names
from lexgraft.llm.learn import held_out, sampled

TRAIN_ROWS = 8000
TREES, DEPTH, RATE, BINS, LEAST = 40, 3, 0.3, 24, 5
THRESHOLD = 0.5


def sizes(text: Column) -> tuple[Column, Column]:
    """Characters and words of a non-null text."""
    return F.length(text), F.regexp_count(text, F.lit(WORD))


def statistics(text: Column, n: Column, words: Column) -> dict[str, Column]:
    """Statistics of a non-null text of n characters and so many words; shares are of these."""
    per = lambda count, of: F.when(of > 0, count / of).otherwise(0.0)
    seen = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return {
        "chars": F.log1p(n.cast("double")),
        "word_chars": per(n, words),
        "capitals": per(seen(r"\p{Lu}"), n),
        "symbols": per(seen(r"[#$%&*@^~_+=<>{}\[\]\\/]"), words),
        "bars": per(n - F.length(F.replace(text, F.lit("|"), F.lit(""))), words),
        "calls": per(seen("[!?]"), words),
        "stops": per(seen(r"[.,;:]"), words),
        "digits": per(seen(r"[0-9]"), n),
        "repeats": per(seen(r"(?<![^\s])(\S++)(?=\s\1(?:\s|$))"), words),
        "breaks": per(n - F.length(F.replace(text, F.lit("\n"), F.lit(""))), words),
        "links": per(seen(r"https?:|www\.|@"), words),
    }


@dataclass
class Rules:
    """score = logistic(bias + sum of the weights of the rules that hold)."""

    bias: float = 0.0
    #: (weight, ((name, is it above?, value), ..))
    rules: list = field(default_factory=list)

    def column(self, stats: dict[str, Column]) -> Column:
        z = F.lit(float(self.bias))
        for weight, tests in self.rules:
            holds = F.lit(True)
            for name, above, value in tests:
                holds = holds & ((stats[name] > value) if above else (stats[name] <= value))
            z = z + F.when(holds, F.lit(float(weight))).otherwise(0.0)
        return 1 / (1 + F.exp(-z))

    def predict(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        z = np.full(len(x), float(self.bias))
        for weight, tests in self.rules:
            z += weight * holds(x, tests, names)
        return 1 / (1 + np.exp(-z))


def holds(x: np.ndarray, tests: tuple, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, above, value in tests:
        at = x[:, names.index(name)]
        out &= (at > value) if above else (at <= value)
    return out


def paths(x: np.ndarray, y: np.ndarray, names: list[str]) -> list[tuple]:
    """All paths of boosted trees on the logistic loss; thresholds are quantiles of the statistics."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    z, found = np.full(len(y), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), {}

    def grow(at: np.ndarray, tests: tuple, g: np.ndarray, h: np.ndarray, depth: int) -> None:
        if tests:
            found.setdefault(tests)
        best = (1e-6, None)
        if depth < DEPTH:
            for j, values in enumerate(cuts):
                bins = np.searchsorted(values, x[at, j], "left")  # bin b: above values[b - 1], not above values[b]
                gs, hs, ns = (np.cumsum(np.bincount(bins, w, len(values) + 1))[:-1] for w in (g[at], h[at], None))
                total_g, total_h, n = g[at].sum(), h[at].sum(), len(at)
                gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                gain[(ns < LEAST) | (n - ns < LEAST)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), (j, float(values[int(gain.argmax())])))
        if best[1] is None:
            z[at] += RATE * g[at].sum() / (h[at].sum() + 1)
            return
        j, value = best[1]
        low = x[at, j] <= value
        grow(at[low], (*tests, (names[j], False, value)), g, h, depth + 1)
        grow(at[~low], (*tests, (names[j], True, value)), g, h, depth + 1)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        grow(np.arange(len(y)), (), y - p, p * (1 - p), 0)
    return list(found)


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated proximal gradient."""
    n, k = a.shape
    step = 4 * n / (np.linalg.norm(a.T @ a, 2) + n)
    w, b, v, c, t = np.zeros(k), 0.0, np.zeros(k), 0.0, 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-np.clip(a @ v + c, -30, 30))) - y
        new = v - step * (a.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b, t_2 = c - step * r.mean(), (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t_2 * (new - w), new_b + (t - 1) / t_2 * (new_b - b)
        w, b, t = new, new_b, t_2
    return w, b


def fit(x: np.ndarray, y: np.ndarray, names: list[str]) -> Rules:
    if not len(y):
        return Rules()
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    if not 0 < y.sum() < len(y):
        return Rules(math.log(rate / (1 - rate)))
    found = paths(x, y.astype(float), names)
    a = np.array([holds(x, tests, names) for tests in found], float).T.reshape(len(y), -1)
    check = np.arange(len(y)) % 5 == 4
    best = (np.inf, 0.01)
    for penalty in (0.03, 0.01, 0.003, 0.001, 0.0003):
        w, b = lasso(a[~check], y[~check], penalty)
        p = np.clip(1 / (1 + np.exp(-(a[check] @ w + b))), 1e-6, 1 - 1e-6)
        loss = -np.mean(np.where(y[check] == 1, np.log(p), np.log(1 - p)))
        best = min(best, (loss, penalty))
    w, b = lasso(a, y, best[1])
    kept = sorted((float(v), tests) for v, tests in zip(w, found, strict=True) if abs(v) > 1e-4)
    return Rules(float(b), kept)


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Rules:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    stats = statistics(text, *sizes(text))
    rows = sampled(docs, labels, label, TRAIN_ROWS, [c.cast("double").alias(f"__{n}") for n, c in stats.items()], id_col)
    x = np.array([[r[f"__{n}"] for n in stats] for r in rows]).reshape(len(rows), len(stats))
    return fit(x, np.array([r.y for r in rows], np.int64), list(stats))


@under_own_names
def scored(docs: DataFrame, rules: Rules, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with all columns and the score of the whole text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = [F.col(c) for c in docs.columns if c != name]
    # columns of their own at each step: what is used many times would else be worked out at every use
    n, words = sizes(text)
    sized = docs.select(*kept, n.alias("__n"), words.alias("__words"))
    stats = statistics(text, F.col("__n"), F.col("__words"))
    inner = sized.select(*kept, *(c.cast("double").alias(f"__{n}") for n, c in stats.items()))
    return inner.withColumn(name, rules.column({n: F.col(f"__{n}") for n in stats})).drop(*(f"__{n}" for n in stats))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, trained(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out("doc_id"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op2_quality": op2_quality}
SQL: dict[str, str] = {}
