"""Interaction audit of filters: what each filter removes in every order, and what it would remove elsewhere.

A document's failures are bits of a mask. Documents are counted by part and mask, so all that is left of a
part of any size is a contingency tensor with two places, pass and fail, on an axis for each filter. A step of
an order is a contraction of that tensor: earlier filters select pass on their axes, the filter itself fail,
later ones all. The tensors of many parts are contracted at once, by one einsum for each filter and set of
earlier filters.

Repeated texts are found by their SHA-256: rows are counted by digest before they meet, so a text that a third
of all rows share is a handful of counts.

Results: a null text is empty; a null part is the part of the empty string. A row without an id neither counts
as an earlier copy nor fails as a later one. Rows that repeat an id are counted each; as their ids are equal,
none of them is a copy of the other. A document with several labels is good or toxic if any of them says so;
labels with null ids are left out. Whole texts are read, however long. An empty table has no parts. Only the
named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgraft.llm.common import SPACE, table

COUNTS = ("n", "good", "toxic")
PASS, FAIL, ALL = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])
#: So many parts are contracted at once.
PARTS = 64


def few_words(words: Column, text: Column) -> Column:
    return F.size(words) < 50


def repeated_words(words: Column, text: Column) -> Column:
    return 100 * F.size(F.array_distinct(words)).cast("long") < 65 * F.size(words).cast("long")


def capitals(words: Column, text: Column) -> Column:
    return 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long") > 5 * F.length(text).cast("long")


def symbols(words: Column, text: Column) -> Column:
    return text.rlike("[#$%&*|]")


#: Failure conditions on the words and the text; a letter without one stands for a repeated text.
FILTERS: dict[str, Callable[[Column, Column], Column] | None] = {"A": few_words, "B": repeated_words, "C": capitals, "D": symbols, "E": None}


def masks(docs: DataFrame, filters: Mapping[str, Callable | None] = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Thin rows: id, part, digest of the text, and mask, where bit i is set if filter i fails (copies not yet)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    fails = [F.when(test(F.col("words"), F.col("text")), 1 << i).otherwise(0) for i, test in enumerate(filters.values()) if test]
    return rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(fails, F.lit(0)).alias("mask"))


def cells(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Callable | None] = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: how many rows of a part fail just these filters, and the labelled ones among them."""
    said = lambda label: F.max(F.when(F.col(label) == 1, 1).otherwise(0))
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    rows = masks(docs, filters, id_col, text_col, part_col).join(known, "id", "left").na.fill(0, ["good", "toxic"])
    kind = ["digest", "part", "mask", "good", "toxic"]
    again = sum(1 << i for i, test in enumerate(filters.values()) if test is None)
    # rows of an id, then of a text: at most one row for each part and pair of labels stands for all copies of a text
    ids = rows.groupBy("id", *kind).agg(F.count("*").alias("n"))
    texts = ids.groupBy(*kind).agg(F.sum("n").alias("all"), F.min("id").alias("least"), F.min_by(F.col("n"), "id").alias("at_least"), F.sum(F.when(F.col("id").isNull(), F.col("n"))).alias("no_id"))
    texts = texts.withColumn("first", F.min("least").over(Window.partitionBy("digest")))
    no_id = F.coalesce("no_id", F.lit(0))
    late = F.when(F.col("least").isNull(), 0).otherwise(F.col("all") - no_id - F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0))
    met = texts.select("part", "mask", "good", "toxic", "all", late.alias("late"))
    both = F.array(F.struct(F.col("mask"), (F.col("all") - F.col("late")).alias("n")), F.struct((F.col("mask") + again).alias("mask"), F.col("late").alias("n")))
    split = met.select("part", "good", "toxic", F.explode(both if again else F.array(F.struct("mask", F.col("all").alias("n")))).alias("cell"))
    return split.groupBy("part", "cell.mask").agg(F.sum("cell.n").alias("n"), F.sum(F.col("cell.n") * F.col("good")).alias("good"), F.sum(F.col("cell.n") * F.col("toxic")).alias("toxic")).filter("n > 0")


def contracted(tensors: np.ndarray, chosen: list[np.ndarray]) -> np.ndarray:
    """Of (counts, parts, 2, 2, ...): the sums where each axis passes, fails or does either, as (counts, parts)."""
    axes = "abcdefghijklmnopqrstuvw"[: len(chosen)]
    return np.einsum(f"xy{axes},{','.join(axes)}->xy", tensors, *chosen)


def steps(tensors: np.ndarray, letters: str) -> dict[str, np.ndarray]:
    """For each order, step and part: the counts of audit(), in that nesting; filter_order and step have no parts."""
    k = len(letters)
    select = lambda early, at, late: [PASS if i in early else at if i == f else late for i in range(k)]
    orders, removed = list(permutations(range(k))), {}
    for f in range(k):
        for early in {frozenset(o[: o.index(f)]) for o in orders}:
            removed[f, early] = contracted(tensors, select(early, FAIL, ALL))
    f_all, f_only, value = [], [], []
    for f in range(k):
        f_all.append(removed[f, frozenset()][0])
        f_only.append(contracted(tensors[:1], select(set(range(k)) - {f}, FAIL, PASS))[0])
        value.append(sum(n[0] * factorial(len(early)) * factorial(k - 1 - len(early)) for (g, early), n in removed.items() if g == f))
    kept = {}
    out = {c: [] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")}
    for order in orders:
        for at, f in enumerate(order):
            now = frozenset(order[: at + 1])
            if now not in kept:
                kept[now] = contracted(tensors[:1], [PASS if i in now else ALL for i in range(k)])[0]
            gone = removed[f, frozenset(order[:at])]
            for c, n in zip(out, (kept[now], gone[0], f_all[f] - gone[0], f_only[f], gone[1], gone[2], value[f]), strict=True):
                out[c].append(n)
    return {"filter_order": np.array(["".join(letters[i] for i in o) for o in orders for _ in o]), "step": np.array([i + 1 for o in orders for i in range(k)], np.int32)} | {c: np.stack(n) for c, n in out.items()}


def audit(counts: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """One row for each part of cells(), order of the filters and step.

    part, filter_order, step; kept after the step, removed here, redundant (fails here, removed earlier),
    unique_fails (fails nothing else), good_lost, toxic_lost, shapley (removed, summed over all orders).
    """
    shape = (2,) * len(letters)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), PARTS):
                some = batch.iloc[at : at + PARTS]
                flat = np.zeros((len(COUNTS), len(some), 1 << len(letters)), np.int64)
                for i, found in enumerate(some["cells"]):
                    for cell in found:
                        flat[:, i, cell["mask"]] = [cell[c] for c in COUNTS]
                # bit i of the mask is axis i
                found = steps(flat.reshape(len(COUNTS), len(some), *shape).transpose(0, 1, *range(1 + len(letters), 1, -1)), letters)
                rows, parts = len(found["step"]), len(some)
                yield pd.DataFrame({"part": np.tile(some["part"].to_numpy(), rows)} | {c: np.repeat(v, parts) if v.ndim == 1 else v.reshape(-1) for c, v in found.items()})

    whole = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))  # at most 2 ** filters of each
    return whole.mapInPandas(run, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


QUERIES = {"op12_audit": op12_audit}
SQL = {
    "op12_audit": r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM texts),
masks AS (SELECT doc_id, part,
    CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask FROM split),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM masks LEFT JOIN known USING (doc_id) GROUP BY part, mask),
filters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM filters a, filters b, filters c, filters d, filters e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
places AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS early FROM orders, (VALUES (1), (2), (3), (4), (5)) s(step)),
steps AS (SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (early | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & early = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & early <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & early = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & early = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM cells, places GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM steps
"""
}
