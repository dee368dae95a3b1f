"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash and may be taken up to `most` times, one pass after the other.
A copy's virtual finish time is the number of words that its source has sent up to its end, divided by the
source's target. The copies of all sources are range-sorted by finish time, and the stream is cut once, at the
word where the running total reaches the budget. As the targets add up to the budget, that is at virtual time 1;
so that no source misses its target by a document, the copy that a source is sending at that time has two parts,
one with the words up to it and one with those after.

Running totals never meet in one task: rows are dealt by ranges of the order, sums are taken for each range, and
only those few rows (as many as partitions and sources) are summed up on their own.

Results: a null text has no words; a null source is a source of its own, after all others; documents without
words are never sent (taken 0), and nothing is taken of an empty table. Rows that repeat each other are rows of
their own, sent one after the other; ties of the hash go by the row's number. Very long texts are cut like others.
Columns with clashing names do no harm: mix() returns only its own, mixed_documents() replaces `taken`.
One row for each source comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgraft.llm.common import WORD, dropped, table, under_own_names, written

#: Up to so many sources, their table is broadcast.
FEW_SOURCES = 10_000


def cyclic(weights: Sequence[float] = (3.0, 1.0, 2.0)) -> Callable[[list], list[float]]:
    """Weights by rank of the source: code point order, null last, repeating."""
    return lambda names: [weights[i % len(weights)] for i in range(len(names))]


def fill(sizes: list[int], weights: list[float], budget: float, most: float) -> list[float]:
    """Targets in proportion to weights; what is over most * size is shared out again among the others."""
    targets, left, free = [0.0] * len(sizes), budget, [i for i in range(len(sizes)) if sizes[i] > 0]
    while free:
        total = math.fsum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / total > most * sizes[i]]
        if not full:
            for i in free:
                targets[i] = left * weights[i] / total
            break
        for i in full:
            targets[i] = float(most * sizes[i])
        left -= math.fsum(targets[i] for i in full)
        free = [i for i in free if i not in set(full)]
    return targets


def sized(docs: DataFrame, row: Column, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Thin rows: row (its number), id, source, size, and the place in the shuffled order."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    place = F.xxhash64(F.col(id_col).cast("string"), text)
    return docs.select(row.alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), place.alias("place"))


def targets(thin: DataFrame, weigh: Callable[[list], list[float]], share: float = 1.5, most: int = 2) -> tuple[DataFrame, int]:
    """((number, name, source_size, target) of each source, the budget); weigh gets the names by code point, null last."""
    sums = [(r.source, int(r.size)) for r in thin.groupBy("source").agg(F.sum("size").alias("size")).collect()]
    sums.sort(key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [n for _, n in sums]
    shares = fill(sizes, weigh([s for s, _ in sums]), share * sum(sizes), most)
    rows = [(i, s, n, t) for i, ((s, n), t) in enumerate(zip(sums, shares, strict=True))]
    found = thin.sparkSession.createDataFrame(rows, "number int, name string, source_size long, target double")
    return F.broadcast(found) if len(rows) <= FEW_SOURCES else found, math.floor(share * sum(sizes) + 1e-6)


def running(df: DataFrame, order: list[str], words: str, name: str, by: list[str]) -> DataFrame:
    """df range-sorted by `order`, with `name`, the running total of `words`, for each value of the columns `by`.

    The range's number is written with its rows; within a range a window adds up, and so do the ranges' sums.
    """
    dealt = written(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), name)
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*by, "__range").agg(F.sum(words).alias("__sum"))
    sums = sums.select(*by, "__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumn(name, F.sum(words).over(within)).join(sums, [*by, "__range"])
    out = out.withColumn(name, F.col(name) + F.col("__before")).drop("__before", "__sum", "__range")
    out.scratch = dealt.scratch
    return out


def stream(known: DataFrame, most: int = 2) -> DataFrame:
    """All copies, in parts where virtual time 1 falls within one: row, id, size, source_size, target, place, copy, upto, words, finish.

    known has the rows of sized() with their source's number, source_size and target.
    """
    placed = running(known, ["number", "place", "row"], "size", "end", ["number"])
    copies = placed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(most))))
    copies = copies.withColumn("end", F.col("end") + (F.col("copy") - 1) * F.col("source_size")).withColumn("met", F.floor(F.col("target") + 1e-6))
    start, met = F.col("end") - F.col("size"), F.col("met")
    part = lambda words, upto: F.struct(words.cast("long").alias("words"), upto.cast("long").alias("upto"))
    parts = F.when((start < met) & (met < F.col("end")), F.array(part(met - start, met), part(F.col("end") - met, F.col("end")))).otherwise(F.array(part(F.col("size"), F.col("end"))))
    finish = F.when(F.col("target") > 0, F.col("part.upto") / F.col("target")).otherwise(F.lit(0.0))
    copies = copies.withColumn("part", F.explode(parts))
    out = copies.select("row", "id", "size", "source_size", "target", "place", "copy", "part.upto", "part.words", finish.alias("finish"))
    out.scratch = placed.scratch
    return out


def mix(docs: DataFrame, weigh: Callable[[list], list[float]] | None = None, share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row: Column | None = None) -> DataFrame:
    """What the mix takes of each row of docs: row, id_col, size, source_size, target, taken; a table.

    row: the row's number, if docs has one already.
    """
    thin = written(sized(docs, F.monotonically_increasing_id() if row is None else row, id_col, text_col, source_col), "sized")
    shares, budget = targets(thin, weigh or cyclic(), share, most)
    known = thin.join(shares, F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")
    copies = stream(known, most)
    # the one cut: where the running total of the sorted stream reaches the budget
    sent = running(copies.withColumn("all", F.lit(0)), ["finish", "place", "row", "copy", "upto"], "words", "total", ["all"])
    words = F.greatest(F.lit(0), F.least("words", F.lit(budget) - (F.col("total") - F.col("words"))))
    taken = sent.groupBy("row", F.col("id").alias(id_col), "size", "source_size", "target").agg(F.sum(words).cast("long").alias("taken"))
    taken = written(taken, "taken")
    dropped(thin, copies, sent)
    return taken


@under_own_names
def mixed_documents(docs: DataFrame, weigh: Callable[[list], list[float]] | None = None, share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs of which the mix takes words, with all columns and `taken` (words, repeats counted)."""
    numbered = written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    sums = mix(numbered, weigh, share, most, id_col, text_col, source_col, F.col("__row")).filter("taken > 0")
    sums = sums.select(F.col("row").alias("__row"), F.col("taken").alias("__taken"))
    rest = [c for c in docs.columns if c != "taken"]
    return numbered.join(sums.hint("merge"), "__row").select(*rest, F.col("__taken").alias("taken"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("row")


QUERIES = {"op3_mixing": op3_mixing}
SQL: dict[str, str] = {}
