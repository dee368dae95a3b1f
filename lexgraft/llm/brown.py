"""Language-model scores from Brown classes.

Exchange clustering puts the words of a dictionary, the TABLE most frequent tokens of the training documents, into
CLASSES classes. The TOP most frequent ones begin: they are moved, one by one, to the class that raises the
likelihood of the class bigrams most. Then all words of the dictionary that occur SUPPORT times or more are exchanged
in ROUNDS rounds: Spark counts how often each class comes before and after each word, and words go to their best class
while the others stay (all beyond TOP, then every second word; a round that doesn't raise the likelihood is undone).
What is rarer belongs to one of FORMS classes by its last two bytes. A text's probability is the product over its
tokens of P(class | class before) * P(token | class): class bigrams are interpolated with class frequencies by how
often the class before was seen; a token has (c + 1) / (T + V + 1) of its class (T tokens, V kinds). An end stands
before the first token.

Counts cover all training documents: partial counts by task, summed by Spark. Words of the dictionary travel to the
workers; the rest of each text meets its counts in a join. The driver sees the dictionary with its classes and at
most (TOP + FORMS)^2 bigrams, whatever the corpus; the words' contexts stay in Spark. A text of any length is scored
whole. Columns other than the three that `score` names play no part.

Results: a null text counts as empty, and consists of one end; rows that repeat each other get the same scores;
with no training document all counts are 0 and the base score is 0.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgraft.llm.common import LOWER, crc_mod, dropped, table, written

END = b"\n"
TOP, CLASSES, FORMS, TABLE, SWEEPS, ROUNDS, SUPPORT = 800, 64, 32, 200_000, 6, 3, 5
#: Words, and codes of pairs, that a task counts at once.
FLUSH, PAIRS = 300_000, 6_000_000
#: Class bigrams count as much as class frequencies once the class before was seen so often.
HALF = 5.0


def tokens_of(text: str | None) -> list[bytes]:
    return [*(text or "").encode().translate(LOWER).split(), END]


def form(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % FORMS


def counted(docs: DataFrame) -> DataFrame:
    """(word, c) over docs (text), as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "c"])

        c: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                c.update(tokens_of(text.as_py()))
                if len(c) > FLUSH:
                    yield batch_of(c)
                    c = Counter()
        yield batch_of(c)

    parts = docs.select("text").mapInArrow(run, "word binary, c long")
    return written(parts.groupBy("word").agg(F.sum("c").alias("c")), "counts")


def frequent(counts: DataFrame) -> list[tuple[bytes, int]]:
    """The tokens from the least count on that leaves at most TABLE of them, the most frequent first."""
    least, total = 1 << 62, 0
    for r in counts.groupBy("c").count().orderBy(F.desc("c")).toLocalIterator():
        total += r["count"]
        if total > TABLE:
            break
        least = r.c
    rows = counts.filter(F.col("c") >= least).toArrow()
    return sorted(zip(rows["word"].to_pylist(), rows["c"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))


def encoded(docs: DataFrame, words: list[tuple[bytes, int]]) -> DataFrame:
    """(units) over docs (text), as a written table: an end, then the units of the text's tokens.

    Units are the places of the dictionary's words, and len(words) + form for all others.
    """
    carried = docs.sparkSession.sparkContext.broadcast({w: i for i, (w, _) in enumerate(words)})  # at most TABLE tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = carried.value
        first = len(place)
        for batch in batches:
            rows = [np.array([place[w] if w in place else first + form(w) for w in [END, *tokens_of(t.as_py())]], np.int32) for t in batch.column(0)]
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, np.concatenate([*rows, np.zeros(0, np.int32)]))], ["units"])

    return written(docs.select("text").mapInArrow(run, "units array<int>"), "encoded")


def neighbours(units: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The units that stand next to each other within a text, as int64: left ones, right ones."""
    flat, lengths = units.flatten().to_numpy(zero_copy_only=False).astype(np.int64), units.value_lengths().to_numpy(zero_copy_only=False)
    within = np.ones(max(len(flat) - 1, 0), bool)
    within[np.cumsum(lengths)[:-1] - 1] = False
    return flat[:-1][within], flat[1:][within]


def class_bigrams(texts: DataFrame, own: np.ndarray, k: int) -> np.ndarray:
    """How often each of k classes follows each other one; own: the class of each unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(k * k, np.int64)
        for batch in batches:
            u, v = neighbours(batch.column(0))
            sums += np.bincount(own[u] * k + own[v], minlength=k * k)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], ["pair", "n"])

    rows = texts.mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(k * k)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(k, k)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def likelihood(m: np.ndarray) -> float:
    """Log likelihood of the class bigrams, but for what doesn't depend on the classes."""
    return float(_xlogx(m).sum() - _xlogx(m.sum(axis=0)).sum() - _xlogx(m.sum(axis=1)).sum())


def without(m: np.ndarray, own: int, after: np.ndarray, before: np.ndarray, same: float) -> np.ndarray:
    """Class bigrams m without a word of class own: its bigrams to and from each class, and with itself."""
    m = m.copy()
    m[own] -= after
    m[:, own] -= before
    m[own, own] -= same
    return m


def gains(m: np.ndarray, after: np.ndarray, before: np.ndarray, same: float, classes: int) -> np.ndarray:
    """What the likelihood gains, up to a constant, if a word that m is without enters each of the first classes."""
    f, c = _xlogx, np.arange(classes)
    a, b = np.flatnonzero(after), np.flatnonzero(before)
    rows, cols = m[:classes, a], m[b, :classes]
    rows = (f(rows + after[a]) - f(rows)) * (a[None, :] != c[:, None])
    cols = (f(cols + before[b][:, None]) - f(cols)) * (b[:, None] != c[None, :])
    corner, ours = m[c, c], after[c] + before[c] + same
    out, into = m.sum(axis=1)[c] + before[c], m.sum(axis=0)[c] + after[c]
    totals = f(out + after.sum() + same) - f(out) + f(into + before.sum() + same) - f(into)
    return rows.sum(axis=1) + cols.sum(axis=0) + f(corner + ours) - f(corner) - totals


def better(m: np.ndarray, old: int, after: np.ndarray, before: np.ndarray, same: float, classes: int) -> int:
    """The class that a word of class old goes to: the best one; old if that is as good. m is with the word."""
    gain = gains(without(m, old, after, before, same), after, before, same, classes)
    return int(gain.argmax()) if old >= classes or gain.max() > gain[old] + 1e-9 else old


def exchange(n: np.ndarray, top: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit: the first `top` move among `classes`, one by one, the others keep a class of their own each."""
    own = np.concatenate([np.arange(top) % classes, classes + np.arange(len(n) - top)])
    k = classes + len(n) - top
    member = np.zeros((len(n), k))
    member[np.arange(len(n)), own] = 1
    m = member.T @ n @ member
    for _ in range(sweeps):
        moved = 0
        for w in range(top):
            old, same = own[w], n[w, w]
            member[w, old] = 0
            after, before = n[w] @ member, n[:, w] @ member  # to and from each class, without w itself
            new = better(m, old, after, before, same, classes)
            member[w, new] = 1
            if new != old:
                moved += 1
                own[w] = new
                m = without(without(m, old, after, before, same), new, -after, -before, -same)
        if not moved:
            break
    return own


def contexts(texts: DataFrame, own: np.ndarray, k: int, moving: np.ndarray) -> DataFrame:
    """(word, slots: array of (slot, n)) for each unit that is moving: how often class s comes after it (slot s),
    before it (slot k + s), and itself after itself (slot 2 * k, not counted in the others)."""
    wide = 2 * k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(codes: list[np.ndarray]) -> pa.RecordBatch:
            code, n = np.unique(np.concatenate([*codes, np.zeros(0, np.int64)]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((code // wide).astype(np.int32)), pa.array((code % wide).astype(np.int32)), pa.array(n.astype(np.int64))], ["word", "slot", "n"])

        codes: list[np.ndarray] = []
        for batch in batches:
            u, v = neighbours(batch.column(0))
            twin, left, right = (u == v) & moving[u], (u != v) & moving[u], (u != v) & moving[v]
            codes += [u[left] * wide + own[v[left]], v[right] * wide + k + own[u[right]], u[twin] * wide + 2 * k]
            if sum(map(len, codes)) > PAIRS:
                yield batch_of(codes)
                codes = []
        yield batch_of(codes)

    parts = texts.mapInArrow(run, "word int, slot int, n long").repartition("word")  # counts of whole chunks: one shuffle serves both groupings
    return parts.groupBy("word", "slot").agg(F.sum("n").alias("n")).groupBy("word").agg(F.collect_list(F.struct("slot", "n")).alias("slots"))


def exchanged(texts: DataFrame, own: np.ndarray, m: np.ndarray, moving: np.ndarray) -> np.ndarray:
    """Classes of all units after each that is moving has gone to the class that is best while all others stay."""
    k = len(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, lists, new = batch.column(0).to_numpy(), batch.column(1), []
            pair = lists.flatten()
            slot, n = pair.field(0).to_numpy(zero_copy_only=False), pair.field(1).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            for w, s, c in zip(word.tolist(), np.split(slot, ends[:-1]), np.split(n, ends[:-1]), strict=True):
                all_of_it = np.zeros(2 * k + 1)
                all_of_it[s] = c
                new.append(better(m, int(own[w]), all_of_it[:k], all_of_it[k : 2 * k], float(all_of_it[-1]), CLASSES))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(new, pa.int32())], ["word", "class"])

    rows = contexts(texts, own, k, moving).mapInArrow(run, "word int, class int").toArrow()  # at most TABLE rows
    out = own.copy()
    out[rows["word"].to_numpy()] = rows["class"].to_numpy()
    return out


def clustered(texts: DataFrame, words: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, class bigrams): the first TOP words one by one, then all words with SUPPORT in rounds.

    The first round takes the words beyond TOP out of their forms. Each later one moves every second word, so that
    words that belong together don't pass each other by, and stands if it raises the likelihood.
    """
    top, k, known = min(TOP, len(words)), CLASSES + FORMS, sum(c >= SUPPORT for _, c in words)
    units = np.array([*range(top), *(top + form(w) for w, _ in words[top:]), *range(top, top + FORMS)], np.int64)
    n = class_bigrams(texts, units, top + FORMS)
    own = np.concatenate([exchange(n, top)[:top], CLASSES + np.arange(FORMS)])[units]
    m = class_bigrams(texts, own, k)
    for turn in range(ROUNDS):
        place = np.arange(len(units))
        moving = (place < known) & ((place % 2 == turn % 2) if turn else (place >= top))
        new = exchanged(texts, own, m, moving)
        after = class_bigrams(texts, new, k)
        if not turn or likelihood(after) > likelihood(m):
            own, m = new, after
    return own, m


class Model:
    """What the workers need: the dictionary's classes and counts, and the log10 tables of classes."""

    def __init__(self, words: list[tuple[bytes, int]], own: np.ndarray, m: np.ndarray, kinds: np.ndarray, tokens: np.ndarray):
        self.place = {w: i for i, (w, _) in enumerate(words)}
        self.classes = own[: len(words)]
        times = np.array([c for _, c in words], float)
        self.logs = np.log10(times + 1)
        t, v = (np.bincount(self.classes, x, CLASSES + FORMS).astype(float) for x in (times, np.ones(len(words))))
        t[CLASSES:] += tokens
        v[CLASSES:] += kinds
        self.emit = np.log10(t + v + 1)
        seen = m.sum(axis=1, keepdims=True)
        flat = (m.sum(axis=0) + 1) / (m.sum() + len(m))
        self.step = np.log10((m + HALF * flat) / (seen + HALF))

    def parts(self, text: str | None) -> tuple[int, int, float, float, Counter]:
        """Tokens, known ones of the dictionary, their sum of log10(c + 1), the rest of the score, other words."""
        words = tokens_of(text)
        at = np.array([self.place.get(w, -1) for w in words])
        rest = np.flatnonzero(at < 0)
        own = np.where(at >= 0, self.classes[at] if len(self.classes) else 0, 0)
        others = [words[i] for i in rest.tolist()]
        own[rest] = [CLASSES + form(w) for w in others]
        end = self.classes[self.place[END]] if END in self.place else CLASSES + form(END)
        steps = self.step[np.concatenate([[end], own[:-1]]), own].sum() - self.emit[own].sum()
        return len(words), len(words) - len(rest), float(self.logs[at[at >= 0]].sum()), float(steps), Counter(others)


def fit(train: DataFrame) -> tuple[Model, DataFrame, int, int]:
    """(model, counts, N, V) of the training documents (text)."""
    counts = counted(train)
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()[0]
    words = frequent(counts)
    texts = encoded(train, words)
    own, m = clustered(texts, words)
    dropped(texts)
    last = F.crc32(F.substring("word", -2, 2)) % FORMS
    others = counts.filter(F.col("c") < words[-1][1]) if words else counts
    forms = others.groupBy(last.alias("form")).agg(F.count("*").alias("kinds"), F.sum("c").alias("tokens")).collect()
    kinds, tokens = np.zeros(FORMS), np.zeros(FORMS)
    for r in forms:
        kinds[r.form], tokens[r.form] = r.kinds, r.tokens
    return Model(words, own, m, kinds, tokens), counts, int(sums.n or 0), int(sums.v)


def score(docs: DataFrame, held_out: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all rows of docs; those where the boolean column held_out is not true are the training set."""
    ready = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(held_out).alias("held_out"))
    model, counts, n, v = fit(ready.filter(~F.coalesce("held_out", F.lit(False))))
    carried = docs.sparkSession.sparkContext.broadcast(model)  # at most TABLE tokens and a table of classes
    kinds = ready.select("id").schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = carried.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [model.parts(t.as_py()) for t in part.column(1)]
                columns = [pa.array([f[i] for f in found], pa.int64() if i < 2 else pa.float64()) for i in range(4)]
                rest = [pa.array([list(f[4]) for f in found], pa.list_(pa.binary())), pa.array([list(f[4].values()) for f in found], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *columns, *rest], ["id", "held_out", "n_tokens", "known", "logs", "steps", "words", "times"])

    parts = ready.mapInArrow(run, f"id {kinds}, held_out boolean, n_tokens long, known long, logs double, steps double, words array<binary>, times array<int>")
    parts = written(parts.withColumn("row", F.monotonically_increasing_id()), "parts")
    others = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    met = others.join(counts, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more_logs"))
    out = parts.drop("words", "times").join(met, "row", "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        (logs + F.col("steps")).alias("score"),
    )


def op5_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs.withColumn("held_out", crc_mod("doc_id", 7) == 2), "held_out")


QUERIES = {"op5_brown": op5_brown}
SQL: dict[str, str] = {}
