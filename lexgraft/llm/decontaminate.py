"""Benchmark decontamination by SimHash of item-sized windows.

Texts are lower-cased and cut into words of letters and digits; shingles are 5 words (an item of fewer words is
one shingle). A shingle's weight grows with its rarity in the benchmark; one that no item holds weighs most.
Every window of a document that is as long as some item and holds one of the benchmark's shingles gets a weighted
fingerprint of 64 bits (a window without such a shingle is like no item at all). The window and an item whose
fingerprints differ in at most RADIUS bits agree in one of eight blocks up to RADIUS // 8 bits: tables of the
items by block value find all of them. Each of these pairs is then verified by its exact weighted-shingle
similarity, 2 * common weight / (weight of the window + weight of the item), which must reach `threshold`.

The benchmark is the query set: it is read in parts of at most PART_WORDS words, the documents pass by in blocks.

Results: one row for each document and item that meet, with the best window (highest similarity, then first).
Null and empty texts and items meet nothing; rows that repeat a document give a row each; a document shorter
than an item is one window.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgraft.llm.common import table, under_own_names, written

RADIUS = 23
BLOCKS = 8
PART_WORDS = 500_000
#: Windows that are worked on at once.
SPAN = 4096
FOUND = "doc_id long, item_id long, start long, n_words long, hamming int, similarity double"
_WORD = re.compile(r"[^\W_]+")
_DISTANCE = np.array([[(a ^ b).bit_count() for b in range(256)] for a in range(256)], np.uint8)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(words: list[str], k: int) -> np.ndarray:
    """Hashes of the k-word shingles."""
    data, digest = [w.encode() for w in words], xxhash.xxh64_intdigest
    return np.array([digest(b" ".join(data[i : i + k])) for i in range(len(data) - k + 1)], np.uint64)


class Index:
    """The items of one part of the benchmark, by length in words."""

    def __init__(self, items: list[tuple[int, str]], width: int = 5):
        known = [(i, w) for i, t in items if (w := words_of(t))]
        self.hashes = [shingles(w, min(width, len(w))) for _, w in known]
        self.ids = [i for i, _ in known]
        frequency = Counter(h for x in self.hashes for h in set(x.tolist()))
        self.top = float(np.log1p(len(known)) + 1)
        self.keys = np.array(sorted(frequency), np.uint64)
        self.weights = np.array([np.log((1 + len(known)) / (1 + frequency[k])) + 1 for k in self.keys.tolist()])
        self.gate = np.zeros(1 << 16, bool)
        self.gate[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.lengths: dict[tuple[int, int], list[int]] = {}
        for n, (_, w) in enumerate(known):
            self.lengths.setdefault((min(width, len(w)), len(w)), []).append(n)
        self.widths = sorted({k for k, _ in self.lengths})
        self.counts = [Counter(x.tolist()) for x in self.hashes]
        self.sums = [float(self.weigh(x).sum()) for x in self.hashes]
        self.prints = np.array([self.fingerprints(x, np.array([0]), len(x))[0] for x in self.hashes], np.uint64)

    def weigh(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.weights[at], self.top)

    def seeds(self, h: np.ndarray) -> np.ndarray:
        """Places of the shingles that some item holds."""
        some = np.flatnonzero(self.gate[(h & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, h[some]), len(self.keys) - 1)
        return some[self.keys[at] == h[some]]

    def fingerprints(self, h: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """Weighted fingerprints of the windows of `size` shingles at the sorted starts."""
        low, high = starts[0], starts[-1] + size
        bits = np.unpackbits(h[low:high].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        signed = np.where(bits == 1, 1.0, -1.0) * self.weigh(h[low:high])[:, None]
        sums = np.vstack([np.zeros((1, 64)), np.cumsum(signed, axis=0)])
        over = sums[starts - low + size] - sums[starts - low] > 1e-9
        return np.packbits(over, axis=1, bitorder="little").view("<u8")[:, 0]

    def similarity(self, h: np.ndarray, item: int) -> float:
        mine, its = Counter(h.tolist()), self.counts[item]
        common = [k for k in mine if k in its]
        if not common:
            return 0.0
        weight = self.weigh(np.array(common, np.uint64))
        shared = float(sum(w * min(mine[k], its[k]) for k, w in zip(common, weight, strict=True)))
        return 2 * shared / (float(self.weigh(h).sum()) + self.sums[item])

    def matches(self, text: str | None, threshold: float) -> list[tuple[int, int, int, int, float]]:
        """(item id, start, words, bits that differ, similarity): the best window for each item that is met."""
        words, best = words_of(text), {}
        for k in self.widths:
            h = shingles(words, k)
            seeds = self.seeds(h)
            if not len(seeds):
                continue
            for (width, length), members in self.lengths.items():
                if width != k:
                    continue
                size = min(length - k + 1, len(h))
                spread = np.unique((seeds[:, None] - np.arange(size)[None, :]).ravel()) if len(seeds) * size <= SPAN * 64 else np.arange(len(h))
                starts = spread[(spread >= 0) & (spread <= len(h) - size)]
                cuts = np.flatnonzero(np.diff(starts // SPAN)) + 1
                for part in np.split(starts, cuts):
                    if len(part):
                        self.meet(h, part, size, k, np.array(members), threshold, best)
        return [(self.ids[i], s, n, d, x) for i, (x, s, n, d) in sorted(best.items())]

    def meet(self, h: np.ndarray, starts: np.ndarray, size: int, k: int, members: np.ndarray, threshold: float, best: dict) -> None:
        prints = self.fingerprints(h, starts, size)
        mine = prints.view(np.uint8).reshape(-1, 8)
        its = self.prints[members].view(np.uint8).reshape(-1, 8)
        likely = np.zeros((len(starts), len(members)), bool)
        for b in range(BLOCKS):
            reach = _DISTANCE[:, its[:, b]] <= RADIUS // BLOCKS  # block value x item
            likely |= reach[mine[:, b]]
        at, item = np.nonzero(likely)
        differ = np.bitwise_count(prints[at] ^ self.prints[members[item]])
        for a, i, d in zip(at[differ <= RADIUS].tolist(), members[item[differ <= RADIUS]].tolist(), differ[differ <= RADIUS].tolist(), strict=True):
            start = int(starts[a])
            x = self.similarity(h[start : start + size], i)
            if x >= threshold and (i not in best or (-x, start) < (-best[i][0], best[i][1])):
                best[i] = (x, start, size + k - 1, d)


def parts(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in lists of about PART_WORDS words at most (a longer item is a list of its own)."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL").orderBy("item_id", "text")
    part, size = [], 0
    for r in rows.toLocalIterator():
        n = len(words_of(r.text))
        if part and size + n > PART_WORDS:
            yield part
            part, size = [], 0
        part.append((r.item_id, r.text))
        size += n
    if part:
        yield part


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, n_words, hamming, similarity) for each document and item that meet."""
    spark, out = docs.sparkSession, None
    for part in parts(benchmark, item_col, item_text):
        items = spark.sparkContext.broadcast(part)  # at most PART_WORDS words

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            index = Index(items.value)
            for batch in batches:
                found = [(key.as_py(), *m) for key, text in zip(batch.column(0), batch.column(1), strict=True) for m in index.matches(text.as_py(), threshold)] if index.ids else []
                types = [pa.int64()] * 4 + [pa.int32(), pa.float64()]
                columns = list(zip(*found, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "start", "n_words", "hamming", "similarity"])

        one = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, FOUND)
        out = one if out is None else written(out.unionByName(one), "leaks")
    return out if out is not None else spark.createDataFrame([], FOUND)


@under_own_names
def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, text_col: str = "text") -> DataFrame:
    """The rows of docs that meet no item; all columns stay. Each row is judged by its own text, whatever its id."""
    spark, place = docs.sparkSession, docs.columns.index(text_col)
    for n, part in enumerate(parts(benchmark, "item_id", "text")):
        items = spark.sparkContext.broadcast(part)  # at most PART_WORDS words

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            index = Index(items.value)
            for batch in batches:
                clean = [not (index.ids and index.matches(text.as_py(), threshold)) for text in batch.column(place)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = (written(docs, "clean") if n else docs).mapInArrow(run, docs.schema)
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op6_decontaminate": op6_decontaminate}
SQL: dict[str, str] = {}
