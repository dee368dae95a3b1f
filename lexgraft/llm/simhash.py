"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into radius // 2 + 1 segments. Of two fingerprints that differ in at most
`radius` bits, some segment differs in at most one bit, so the two share a variant of that segment with
one bit taken out. Every fingerprint emits its 64 variants (one for each bit); equal variants are joined
and each pair is verified on all 64 bits.

Copies collapse first: everything after the fingerprints works on distinct ones. The pairs of buckets of up
to SMALL fingerprints are compared one by one. In larger buckets all are first linked to the bucket's least
fingerprint where near enough; those that still hold more than one component go on to a join of pairs of
different components. No link between components is lost, and large groups of near copies never become all
their pairs.

Results: nulls count as empty texts, which have fingerprint zero and link like any other. Rows that repeat
a doc_id keep a row each. A null doc_id is never a component's name unless all ids in it are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgraft.llm.common import LOWER, components, hamming, table, under_own_names, written

BLOCK = 1 << 14
SMALL = 64


def fingerprint(text: str | None, width: int) -> int:
    """Unsigned fingerprint of one whole text, in blocks of bounded memory."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(width, len(words))
    starts = np.concatenate([[0], ends[: len(words) - k] + 1]).tolist()
    stops = ends[k - 1 :].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), BLOCK):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.int64())], ["id", "fp"])

    ready = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return ready.mapInArrow(run, "id long, fp long")


def segments(radius: int) -> list[tuple[int, int]]:
    n = radius // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def linked(radius: int) -> Column:
    """Whether fp and fp_2 are near, and key is the first variant that they share: so a pair is found once."""
    differ, bit = F.col("fp").bitwiseXOR(F.col("fp_2")), F.lit(64)
    for low, high in reversed(segments(radius)):
        part = F.shiftrightunsigned(differ, low).bitwiseAND((1 << (high - low)) - 1)
        bit = F.when(F.bit_count(part) <= 1, low + F.bit_count(F.greatest(part, F.lit(1)) - 1)).otherwise(bit)
    return (F.bit_count(differ) <= radius) & (F.col("key").bitwiseAND(63) == bit)


def variants(radius: int) -> list[Column]:
    """For each of the 64 bits: its segment without it, and the bit's number in the lowest six."""
    out = []
    for low, high in segments(radius):
        segment = F.shiftrightunsigned("fp", low).bitwiseAND((1 << (high - low)) - 1)
        for bit in range(low, high):
            value = segment.bitwiseAND(F.lit(((1 << (high - low)) - 1) & ~(1 << (bit - low))))
            out.append(F.shiftleft(value.cast("long"), 6).bitwiseOR(F.lit(bit).cast("long")))
    return out


def clusters(prints: DataFrame, radius: int = 4) -> DataFrame:
    """(id, fp, component): component is the least id that is reached over links of at most radius bits."""
    if not 2 <= radius <= 15:
        raise ValueError("radius must be from 2 to 15: beyond, segments are too short to select by")
    prints = written(prints, "prints")
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    keyed = distinct.select("fp", F.explode(F.array(*variants(radius))).alias("key"))
    bucket = Window.partitionBy("key")
    shared = keyed.withColumn("lead", F.min("fp").over(bucket)).withColumn("size", F.count("fp").over(bucket)).filter("size > 1")
    shared = written(shared, "shared")
    small, large = shared.filter(F.col("size") <= SMALL).select("key", "fp"), shared.filter(F.col("size") > SMALL)
    direct = small.join(small.select("key", F.col("fp").alias("fp_2")), "key").filter((F.col("fp") < F.col("fp_2")) & linked(radius))
    led = large.filter((F.col("fp") != F.col("lead")) & (hamming("fp", "lead") <= radius))
    label = components(direct.select(F.col("fp").alias("u"), F.col("fp_2").alias("v")).union(led.select("fp", "lead")))
    known = large.select("key", "fp").join(label.withColumnRenamed("node", "fp"), "fp", "left")
    known = known.select("key", "fp", F.coalesce("label", "fp").alias("label"))
    open_ = known.withColumn("low", F.min("label").over(bucket)).withColumn("high", F.max("label").over(bucket))
    open_ = written(open_.filter("low <> high").select("key", "fp", "label"), "open")
    other = open_.select("key", F.col("fp").alias("fp_2"), F.col("label").alias("label_2"))
    pairs = open_.join(other, "key").filter((F.col("fp") < F.col("fp_2")) & (F.col("label") != F.col("label_2")) & linked(radius))
    top = components(pairs.select(F.col("label").alias("u"), F.col("label_2").alias("v")))
    # distinct fingerprint -> label of the first pass -> label of the second
    one = written(distinct.join(label.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label")), "labelled")
    two = one.join(top.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left")
    two = written(two.select("fp", "first", F.coalesce("top", "label").alias("label")), "labelled")
    least = written(two.groupBy("label").agg(F.min("first").alias("component")), "least")
    named = written(two.select("fp", "label").join(least, "label").select("fp", "component"), "named")
    return prints.join(named, "fp").select("id", "fp", "component")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id_col, fingerprint, component_id) for each row of docs; see the module's text."""
    found = clusters(fingerprints(docs, width, id_col, text_col), radius)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@under_own_names
def keep_one(docs: DataFrame, width: int = 5, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, the one with the least id (null ids last); all columns stay.

    Rows are told apart by a number of their own, so null and repeated ids are rows like any other.
    """
    numbered = written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found = clusters(fingerprints(numbered, width, "__row", text_col), radius)
    ids = numbered.select(F.col("__row").alias("id"), F.col(id_col).alias("own"))
    least = F.min(F.struct(F.col("own").isNull().alias("none"), "own", "id")).alias("place")
    kept = found.join(ids, "id").groupBy("component").agg(least).select(F.col("place.id").alias("__row"))
    return numbered.join(written(kept, "kept"), "__row", "left_semi").drop("__row")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op8_simhash": op8_simhash}
SQL: dict[str, str] = {}
