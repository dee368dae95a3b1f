"""Near-duplicates by SimHash fingerprints, verified and completed by the exact Jaccard similarity of their sets of shingles.

Two texts are near copies if the sets of their shingles (`width` words, a shorter text is one shingle) have a Jaccard
similarity of `threshold` or more. Of each group that such links connect the row with the least id stays.

1. Equal sets collapse to their first row (empty and null texts have the empty set).
   Each other set has a fingerprint of 64 bits. Fingerprints that share a variant of a segment with one bit taken out and
   differ in RADIUS bits or fewer name a pair; pairs that have the similarity are links, and what they connect is one group.
   Sets at the threshold differ in up to 17 bits, out of reach of such variants, so all links between different groups
   that fingerprints can't show are found by steps 2 to 5; pairs within a group are not verified again.
2. A set's keys are ordered: hashes of 62 bits, with those of crowded buckets after all others. All shingles of all
   texts are counted, in 2^17 buckets of their hashes; a bucket far above the mean holds a passage that many texts
   share. Any fixed order is exact; the counts only decide how many candidates there are. Two sets of the given
   similarity share a key of their prefixes; length and places rule pairs out.
3. A key that one prefix alone holds leads nowhere: keys are counted first, in PASSES passes by their hashes, and only
   the rows of shared keys go on.
4. Groups of up to SMALL sets that share a key are compared pair by pair. In larger ones all are first tried with the
   least; those that still hold more than one component go on to a join of pairs of different components.
5. A parity bitmap of 1,024 bits rules most pairs out, a finer one of two bits a key or more those of large sets; the
   rest are verified on all keys of both texts. These are joined to the pairs in as many parts as the pairs ask for, so
   that what is on disk at once follows the texts, however many pairs there are. No link between components is lost.

Results: rows are told apart by their id and a hash of their text, so null and repeated ids are rows like any other;
among rows of the same id the one whose text has the least hash stays, of rows with the same id and text one; null
ids come after all others. An empty table stays empty; very long texts are taken whole; other columns, of any name, stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgraft.llm import simhash
from lexgraft.llm.common import LOWER, components, dropped, hamming, under_own_names, written
from lexgraft.llm.lines import BLOOM, KEY
from lexgraft.llm.lines import keys as row_keys

SMALL, PASSES = 64, 2
#: Shingles are counted in 2 ** BUCKET_BITS cells.
BUCKET_BITS = 17
FLAG = 1 << 62
#: Fingerprints that differ in so many bits or fewer name a pair.
RADIUS = 4
#: Bits of the coarse parity bitmap. A part of the verification joins 1 / SHARE as many keys to pairs as all texts have.
COARSE, SHARE = 1024, 8


def keys_of(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes (62 bits) of the shingles of one whole text."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(width, len(words))
    starts, stops, digest = np.concatenate([[0], ends[: len(words) - k] + 1]).tolist(), ends[k - 1 :].tolist(), xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], 42) >> 2 for a, b in zip(starts, stops, strict=True)), np.int64, len(starts)))


def fingerprint(keys: np.ndarray) -> int:
    """The signed fingerprint of a set of keys: a bit is 1 if over half of the mixed keys have it; in blocks of bounded memory."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(keys), simhash.BLOCK):
        mixed = keys[at : at + simhash.BLOCK].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        ones += np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(keys), bitorder="little").view("<i8")[0])


def bucket(keys: np.ndarray) -> np.ndarray:
    return (keys & ((1 << BUCKET_BITS) - 1)).astype(np.int64)


def ordered(keys: np.ndarray, crowded: np.ndarray) -> np.ndarray:
    """The keys with those of crowded buckets flagged, and so after all others."""
    last = crowded[bucket(keys)]
    return np.concatenate([keys[~last], keys[last] | FLAG])


def parities(keys: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap of so many bits, a power of two, as longs: a bit is the parity of the number of keys that fall on it."""
    odd = (np.bincount(keys & (bits - 1), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def mapped(rows: DataFrame, found: Callable[[str | None], tuple], schema: str) -> DataFrame:
    """rows (.., text) without the text, and with what found(text) gives for the columns of schema."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
    types = [kinds[c.strip().split(" ")[1]] for c in schema.split(",")]
    kept = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                got = list(zip(*(found(t.as_py()) for t in part.column("text")), strict=True))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array(list(c), t) for c, t in zip(got, types, strict=True))], [*kept, *names])

    before = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "text")
    return rows.mapInArrow(run, f"{before}, {schema}")


def crowded(rows: DataFrame, width: int) -> np.ndarray:
    """For each bucket whether it holds far more shingles than the mean; every shingle of every text is counted."""
    cells = 1 << BUCKET_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(cells, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                np.add.at(sums, bucket(keys_of(text.as_py(), width)), 1)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], ["bucket", "n"])

    found = rows.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # one row a cell
    sums = np.zeros(cells)
    sums[found["bucket"].to_numpy()] = found["n"].to_numpy()
    mean = sums.mean()
    return sums > mean + 8 * np.sqrt(mean) + 4


def prefixes(rows: DataFrame, width: int, t: float, full: np.ndarray) -> DataFrame:
    """rows (id, m1, m2, text) with h1, h2, n, fp, prefix, odd, fine: a hash of 128 bits of the set of keys, its size, its
    fingerprint, its prefix, its parity bitmap of COARSE bits, and of two bits a key or more where that is larger (else null)."""
    carried = rows.sparkSession.sparkContext.broadcast(full)  # a boolean a cell

    def found(text: str | None) -> tuple:
        keys = keys_of(text, width)
        n, whole = len(keys), xxhash.xxh3_128_intdigest(keys.tobytes())
        size = n - int(np.ceil(n * t - 1e-9)) + 1 if n else 0
        bits = 1 << (2 * n - 1).bit_length() if n else 0
        fine = parities(keys, bits) if bits > COARSE else None
        return (whole >> 64) - (1 << 63), (whole & ((1 << 64) - 1)) - (1 << 63), n, fingerprint(keys), ordered(keys, carried.value)[:size], parities(keys, COARSE), fine

    return mapped(rows, found, "h1 long, h2 long, n int, fp long, prefix array<long>, odd array<long>, fine array<long>")


def near(x: str, y: str, t: float) -> Column:
    """Whether the pair may be similar, by the sizes of its sets and the places of the key that they share."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    need = F.ceil((nx + ny) * (t / (1 + t)) - 1e-9)
    return (F.least(nx, ny) >= t * F.greatest(nx, ny) - 1e-9) & (F.least(nx - F.col(f"{x}.pos"), ny - F.col(f"{y}.pos")) >= need)


def verified(rows: DataFrame, distinct: DataFrame, pairs: DataFrame, width: int, t: float) -> DataFrame:
    """The pairs (u, v, ..) whose texts have the similarity."""
    # the keys of one text alone flip bits: no more may differ than the similarity allows
    own = pairs.columns
    side = lambda c, odd: distinct.select(F.col("row").alias(c), F.col("n").alias(f"n_{c}"), F.col(odd).alias(f"odd_{c}"))
    both = lambda odd: pairs.select(*own).join(side("u", odd), "u").join(side("v", odd), "v")
    differ = F.aggregate(F.zip_with("odd_u", "odd_v", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    n = F.col("n_u") + F.col("n_v")
    alike = differ <= n - 2 * F.ceil(n * (t / (1 + t)) - 1e-9)
    coarse = pairs = written(both("odd").filter(alike).select(*own, "n_u", "n_v"), "likely")
    if not pairs.filter(2 * F.greatest("n_u", "n_v") > COARSE).isEmpty():
        finer = both("fine").withColumns({"odd_u": folded("odd_u", "odd_v"), "odd_v": folded("odd_v", "odd_u")})
        pairs = written(finer.filter(F.col("odd_u").isNull() | F.col("odd_v").isNull() | alike).select(*own, "n_u", "n_v"), "likely")
        dropped(coarse)
    wanted = pairs.select(F.col("u").alias("row")).union(pairs.select("v")).distinct()
    wanted = written(distinct.select("row", *KEY).join(wanted, "row"), "wanted")
    # numbers are never negative: the optimizer makes Bloom filters only of a side that has some condition
    met = rows.join(wanted.filter("row >= 0"), list(KEY))
    # of rows with the same id and text one is read; the join has put them together
    met = met.withColumn("copy", F.row_number().over(Window.partitionBy(*KEY).orderBy(*KEY))).filter("copy = 1").select("row", "text")
    sets = written(mapped(met, lambda text: (keys_of(text, width),), "keys array<long>"), "sets", BLOOM)
    common = F.size(F.array_intersect("mine", "keys"))
    asked, held = pairs.agg(F.sum("n_u")).first()[0] or 0, distinct.agg(F.sum("n")).first()[0] or 1
    found, parts = None, max(1, -(-SHARE * asked // held))
    for k in range(parts):
        part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)) == k  # noqa: E731, B023
        some = pairs.select(*own).filter(part("u"))
        # conditions and Bloom filters: no other sets are shuffled
        mine = sets.filter(part("row")).select(F.col("row").alias("u"), F.col("keys").alias("mine"))
        other = sets.join(written(some.select(F.col("v").alias("row")).distinct(), "wanted").filter("row >= 0"), "row") if parts > 1 else sets
        both = some.join(mine, "u").join(other.select(F.col("row").alias("v"), "keys"), "v")
        more = written(both.filter(common >= t * (F.size("mine") + F.size("keys") - common) - 1e-9).select(*own), "verified", BLOOM)
        found = more if found is None else found.union(more)
    dropped(pairs, wanted, sets)
    return found


def folded(odd: str, other: str) -> Column:
    """The bitmap in as few bits as the other has: halves of one are laid upon each other. Sizes of pairs differ by a factor of two at most."""
    half = F.size(odd) / 2
    first, second = F.slice(odd, F.lit(1), half.cast("int")), F.slice(odd, (half + 1).cast("int"), half.cast("int"))
    return F.when(F.size(odd) > F.size(other), F.zip_with(first, second, lambda a, b: a.bitwiseXOR(b))).otherwise(F.col(odd))


def named_by_prints(distinct: DataFrame) -> DataFrame:
    """(u, v): pairs of sets whose fingerprints are equal or near, a table.

    Sets of one fingerprint meet its first; of the distinct ones those that share a variant meet each other, in buckets
    of more than SMALL the bucket's least. So near copies make pairs in proportion to their number.
    """
    prints = written(distinct.filter("n > 0").select("row", "fp").withColumn("first", F.min("row").over(Window.partitionBy("fp"))), "prints")
    keyed = prints.filter("row = first").select("row", "fp", F.explode(F.array(*simhash.variants(RADIUS))).alias("key"))
    bucket = Window.partitionBy("key")
    shared = keyed.withColumn("lead", F.min(F.struct("fp", "row")).over(bucket)).withColumn("size", F.count("fp").over(bucket)).filter("size > 1")
    shared = written(shared, "shared")
    small, large = shared.filter(F.col("size") <= SMALL).select("key", "row", "fp"), shared.filter(F.col("size") > SMALL)
    direct = small.join(small.select("key", F.col("row").alias("row_2"), F.col("fp").alias("fp_2")), "key").filter((F.col("fp") < F.col("fp_2")) & simhash.linked(RADIUS))
    led = large.filter((F.col("fp") != F.col("lead.fp")) & (hamming("fp", "lead.fp") <= RADIUS))
    pairs = prints.filter("row <> first").select(F.col("first").alias("u"), F.col("row").alias("v"))
    pairs = pairs.union(direct.select("row", "row_2")).union(led.select("lead.row", "row"))
    pairs = written(pairs.distinct(), "named")
    dropped(prints, shared)
    return pairs


def shared_rows(distinct: DataFrame) -> DataFrame:
    """(key, x: (row, n, pos)) of the keys that more than one prefix holds, with the group's lead and size; a table."""
    keyed = distinct.select("row", "n", F.posexplode("prefix").alias("pos", "key"))
    often = None
    for k in range(PASSES):
        some = keyed.filter(F.pmod("key", F.lit(PASSES)) == k).groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
        some = written(some, "often")
        often = some if often is None else often.union(some)
    # sizes are above 1: the condition asks for a Bloom filter on the prefixes before they are shuffled
    met = keyed.join(often.filter("size > 1"), "key").select("key", F.struct("row", "n", "pos").alias("x"), "size")
    met = written(met, "keyed", BLOOM)
    lead = met.groupBy("key").agg(F.min("x").alias("lead"))
    return written(met.join(lead, "key"), "shared")


def labelled(rows: DataFrame, distinct: DataFrame, width: int, t: float) -> DataFrame:
    """(row, id, m1, m2, label) of each distinct set: the label is one row of its component."""
    group = Window.partitionBy("key")
    named = named_by_prints(distinct)
    links = verified(rows, distinct, named, width, t)
    dropped(named)
    one = components(links)
    shared = shared_rows(distinct)
    small, large = shared.filter(F.col("size") <= SMALL).select("key", "x"), shared.filter(F.col("size") > SMALL)
    direct = small.join(small.select("key", F.col("x").alias("y")), "key").filter((F.col("x.row") < F.col("y.row")) & near("x", "y", t))
    led = large.select("key", F.col("lead").alias("x"), F.col("x").alias("y")).filter((F.col("x.row") < F.col("y.row")) & near("x", "y", t))
    pairs = written(direct.union(led).select(F.col("x.row").alias("u"), F.col("y.row").alias("v")).distinct(), "pairs")
    # what fingerprints have connected needs no other proof
    side = lambda c: one.select(F.col("node").alias(c), F.col("label").alias(f"l_{c}"))
    apart = pairs.join(side("u"), "u", "left").join(side("v"), "v", "left").filter("l_u IS NULL OR l_v IS NULL OR l_u <> l_v").select("u", "v")
    label = components(links.union(verified(rows, distinct, apart, width, t))).withColumnRenamed("node", "row")
    known = large.select("key", "x", F.col("x.row").alias("row")).join(label, "row", "left").select("key", "x", F.coalesce("label", "row").alias("label"))
    open_ = known.withColumn("low", F.min("label").over(group)).withColumn("high", F.max("label").over(group))
    open_ = written(open_.filter("low <> high").select("key", "x", "label"), "open")
    other = open_.select("key", F.col("x").alias("y"), F.col("label").alias("label_2"))
    more = open_.join(other, "key").filter((F.col("x.row") < F.col("y.row")) & (F.col("label") != F.col("label_2")) & near("x", "y", t))
    more = written(more.select(F.col("x.row").alias("u"), F.col("y.row").alias("v"), "label", "label_2").distinct(), "pairs")
    top = components(verified(rows, distinct, more, width, t).select(F.col("label").alias("u"), F.col("label_2").alias("v")))
    one = distinct.select("row", *KEY).join(label, "row", "left").select("row", *KEY, F.coalesce("label", "row").alias("label"))
    two = one.join(top.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left")
    found = written(two.select("row", *KEY, F.coalesce("top", "label").alias("label")), "labelled")
    dropped(shared, pairs, open_, more)
    return found


@under_own_names
def keep_one(docs: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, the one with the least id; all columns stay."""
    # a null id comes after all others here, whatever number stands for it
    own = [F.col(id_col).isNull().alias("none"), *row_keys(docs, id_col, text_col)]
    rows = docs.select(*own[1:], F.col(text_col).cast("string").alias("text"))
    sets = prefixes(docs.select(*own, F.col(text_col).cast("string").alias("text")), width, threshold, crowded(rows, width))
    # the first row of equal sets stands for all: no other of them can be the least of its component
    place = F.struct("none", *KEY)
    sets = sets.groupBy("h1", "h2").agg(F.min(F.struct(place.alias("place"), "n", "fp", "prefix", "odd", "fine")).alias("s"))
    distinct = written(sets.select(F.monotonically_increasing_id().alias("row"), "s.place.none", *(F.col(f"s.place.{k}") for k in KEY), "s.n", "s.fp", "s.prefix", "s.odd", "s.fine"), "distinct")
    found = labelled(rows, distinct, width, threshold).join(distinct.select("row", "none"), "row")
    kept = found.groupBy("label").agg(F.min(place).alias("place")).select(*(F.col(f"place.{k}").alias(f"__{k}") for k in KEY))
    kept = written(kept, "kept")
    dropped(distinct)
    met = docs.select("*", *(c.alias(f"__k{i}") for i, c in enumerate(own[1:]))).join(kept, [F.col(f"__k{i}") == F.col(f"__{k}") for i, k in enumerate(KEY)])
    # of rows with the same id and text one stays; the join has put them together
    names = [f"__k{i}" for i in range(len(KEY))]
    return met.withColumn("__copy", F.row_number().over(Window.partitionBy(*names).orderBy(*names))).filter("__copy = 1").select(*docs.columns)
