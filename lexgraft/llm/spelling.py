"""Spelling variants: words one edit apart, found by composing finite-state machines.

The minimised acceptor of the vocabulary is composed with a transducer that inserts, deletes or replaces one code
point, and with the acceptor again; every path from the start to the end of that machine is a pair of words. Before
its edit, a path moves along the same arcs of both acceptors; after it, along arcs with equal symbols,
and pairs of states without a common ending are remembered. An inserted symbol never equals the next one, so each
pair has one path.

The machine is enumerated by the states that its start leads to. A path whose edit is not among the first code
points reads them on both sides, so it stays within the part of the acceptor behind that prefix; all other
paths read the last code points on both sides, so they stay within such a part of the mirrored acceptor. Each
part is built and minimised in the task that enumerates it. A part of over `most` words is split: the paths whose
edit is at its very first code point keep all others, so they go by what is left without it, at most the alphabet of each;
the rest goes on by the next code point. So no part holds more than `most` words, whatever the vocabulary.

Results: a null text has no words and a null id is the empty string. Repeated rows count again. Words of any length
are compared whole. Ties of the nearest word go by code points. An empty table has no words. Only the named
columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgraft.llm.common import dropped, table, written

SMALL, CAPITAL = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of a part of the acceptor.
MOST = 4_000
PAIR = "a string, n_a long, b string, n_b long"


def words(docs: DataFrame, least: int = 5, often: int = 3, spoil: int | None = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n). In documents where `spoil` divides its hash, a run of letters lacks the code point that the hash names."""
    low = F.translate(F.col(text_col).cast("string"), CAPITAL, SMALL)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(low, F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("run"))
    word = F.col("run")
    if spoil:
        h = F.crc32(F.concat_ws(":", "id", "run"))
        at = F.pmod(h, F.length("run")).cast("int")
        word = F.when(h % spoil == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(word)
    return runs.select(word.alias("word")).filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= often)


class Acceptor:
    """The minimal deterministic acceptor of sorted, distinct words."""

    def __init__(self, sorted_words: list[str]) -> None:
        self.final: list[bool] = []
        self.arcs: list[dict[str, int]] = []
        self.dead: set[tuple[int, int]] = set()
        known: dict[tuple, int] = {}
        # the states along the last word, which later words may still leave: (symbol, final, arcs)
        path: list[list] = [["", False, {}]]

        def close(depth: int) -> None:
            while len(path) > depth:
                symbol, final, arcs = path.pop()
                key = (final, *arcs.items())
                if key not in known:
                    known[key] = len(self.final)
                    self.final.append(final)
                    self.arcs.append(arcs)
                path[-1][2][symbol] = known[key]

        last = ""
        for word in sorted_words:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            close(same + 1)
            path.extend([c, False, {}] for c in word[same:])
            path[-1][1] = True
            last = word
        close(1)
        self.start = len(self.final)
        self.final.append(path[0][1])
        self.arcs.append(path[0][2])

    def both(self, p: int, q: int) -> Iterator[tuple[str, int, int]]:
        left, right = self.arcs[p], self.arcs[q]
        for c in left if len(left) <= len(right) else right:
            if c in left and c in right:
                yield c, left[c], right[c]

    def endings(self, p: int, q: int, but: str = "") -> Iterator[str]:
        """What both states accept; not what begins with `but`."""
        if (p, q) in self.dead:
            return
        if self.final[p] and self.final[q]:
            yield ""
        path: list[str] = []
        open_ = [[p, q, self.both(p, q), self.final[p] and self.final[q]]]
        while open_:
            top = open_[-1]
            for c, a, b in top[2]:
                if (a, b) in self.dead or (c == but and len(open_) == 1):
                    continue
                path.append(c)
                ends = self.final[a] and self.final[b]
                if ends:
                    yield "".join(path)
                open_.append([a, b, self.both(a, b), ends])
                break
            else:
                open_.pop()
                if open_:
                    path.pop()
                    open_[-1][3] |= top[3]
                if not top[3] and (open_ or not but):
                    self.dead.add((top[0], top[1]))

    def one_edit_apart(self) -> Iterator[tuple[str, str]]:
        """All pairs of accepted words that one edit parts, each once."""
        path: list[str] = []
        open_ = [(self.start, iter(self.arcs[self.start].items()))]
        yield from self.edits(self.start, "")
        while open_:
            for c, state in open_[-1][1]:
                path.append(c)
                if len(self.arcs[state]):
                    yield from self.edits(state, "".join(path))
                open_.append((state, iter(self.arcs[state].items())))
                break
            else:
                open_.pop()
                if path:
                    path.pop()

    def edits(self, state: int, before: str) -> Iterator[tuple[str, str]]:
        arcs = list(self.arcs[state].items())
        for i, (x, p) in enumerate(arcs):
            for y, q in arcs[i + 1 :]:
                for s in self.endings(p, q):
                    yield before + x + s, before + y + s
            for s in self.endings(p, state, x):
                yield before + s, before + x + s


def enumerated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each part; rows come sorted by key and word, in the mirrored parts mirrored."""

    def part(key: str, mirrored: bool, front: int, known: dict[str, int]) -> Iterator[pa.RecordBatch]:
        found = []
        for a, b in Acceptor(sorted(known)).one_edit_apart() if len(known) > 1 else ():
            pair = a, known[a], b, known[b]
            if mirrored:
                pair = a[::-1], known[a], b[::-1], known[b]
                if pair[0][:front] == pair[2][:front]:
                    continue  # the other side has it
            found.append(pair)
            if len(found) == 1 << 14:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], ["a", "n_a", "b", "n_b"])
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], ["a", "n_a", "b", "n_b"])

    now, known = None, {}
    for batch in batches:
        for key, mirrored, front, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now and now[0] != key:
                yield from part(*now, known)
                known = {}
            now = key, mirrored, front
            known[word] = n
    if now:
        yield from part(*now, known)


def near_pairs(vocabulary: DataFrame, least: int = 5, most: int = MOST) -> DataFrame:
    """(a, n_a, b, n_b): each pair of words of vocabulary (word, n) that are one edit apart, once; a table.

    All words have `least` code points or more.
    """
    front = (least - 1) // 2
    side = lambda mirrored, word, depth: vocabulary.select(F.lit(mirrored).alias("mirrored"), F.lit(depth).alias("depth"), word.alias("word"), "n")
    rows = side(False, F.col("word"), front).unionByName(side(True, F.reverse("word"), least - front))
    rows = rows.withColumn("key", F.concat_ws(" ", "mirrored", F.substr("word", F.lit(1), F.col("depth"))))
    parts, scratch = [], []
    while True:
        crowded = written(rows.groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") > most).select("key"), "crowded")
        scratch.append(crowded)
        if crowded.isEmpty():
            parts.append(rows)
            break
        parts.append(rows.join(crowded, "key", "left_anti"))
        rows = written(rows.join(crowded, "key"), "crowded_rows")
        scratch.append(rows)
        # edits at the next code point: what is left without it, or the word that lacks it
        place, rest = F.col("depth"), F.concat(F.substr("word", F.lit(1), F.col("depth")), F.substr("word", F.col("depth") + 2))
        left = F.array_distinct(F.array(F.when(F.length("word") > place, rest).otherwise(F.col("word")), F.col("word")))
        parts.append(rows.withColumn("left", F.explode(left)).withColumn("key", F.concat_ws(" ", "mirrored", "depth", "left")).drop("left"))
        rows = rows.withColumn("depth", place + 1).filter(F.length("word") >= F.col("depth"))
        rows = rows.withColumn("key", F.concat_ws(" ", "mirrored", F.substr("word", F.lit(1), F.col("depth"))))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    dealt = every.select("key", "mirrored", F.lit(front).alias("front"), "word", "n").repartition("key").sortWithinPartitions("key")
    pairs = dealt.mapInArrow(enumerated, PAIR)
    out = written(pairs if len(parts) == 1 else pairs.dropDuplicates(["a", "b"]), "near_pairs")
    dropped(*scratch)
    return out


def variants(vocabulary: DataFrame, least: int = 5, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of vocabulary (word, n)."""
    vocabulary = written(vocabulary, "vocabulary")
    pairs = near_pairs(vocabulary, least, most)
    near = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    large = -F.col("best.less") >= 2 * F.col("n")
    known = vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(large, F.col("best.near")).alias("form"), F.when(large, -F.col("best.less")).alias("form_n"))
    known = written(known, "forms")
    # n at least doubles along forms, so that they end; each round doubles the steps taken
    links = written(known.filter("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "links")
    while not links.filter("moved").isEmpty():
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        old, links = links, written(links.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "links")
        dropped(old)
    out = written(known.join(links.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
    dropped(vocabulary, pairs, known, links)
    return out


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(words(table(spark, sf_dir, "documents")))


QUERIES = {"op11_spelling": op11_spelling}
SQL: dict[str, str] = {}
