"""Line dedup by an exact set-similarity join, in DataFrame operations only.

A line is its set of lower-cased words. A line is removed if an earlier line of the corpus has a Jaccard
similarity of `threshold` or more with it. Earlier goes by document id (null first), then by a hash of the text
where rows share an id, then by line number. Lines of fewer than `min_words` words are never compared and never
removed; lines without words never are in any case.

1. Equal sets collapse to their first line; all others of a set are removed.
2. Sets so small that one more word would make them too unlike (fewer than 4 words at 0.8) resemble equal sets only,
   which have met. Of the others, words are ordered by rarity. Every word of every distinct set is counted, in 2^21 buckets of its hash, so the
   table of rarities has a fixed size (2 MB) for any corpus; within a rarity the hash decides. Any fixed order is
   exact, the counts only decide how many candidates there are. A word whose bucket counts 1 is in one set only
   and leads to nobody.
3. Two sets of the given similarity share a word of their prefixes. The words before the first one that they share
   are in one of the sets alone, so the two places of that word add up to no more than the difference that the
   similarity allows. Length, these places and a parity bitmap (a lower bound of the difference) rule pairs out.
4. One earlier witness removes a line. Sets are first tried with the earliest one that has the same most frequent
   word in its prefix; a set that is proved to repeat it needs no other witness and asks no more, but still
   serves as one. So a group of near copies makes pairs in proportion to its size, and each set is one row, whatever
   its words. Then every set that is still open meets all earlier sets of its words' groups.
5. Pairs are verified on the sets of whole hashes of 64 bits.

Results: a null text stays null and counts no lines; empty texts stay; a text whose lines all go becomes empty.
Rows that share an id or have none are told apart by their texts; of rows with the same id and the same text one
keeps its lines and the others are removed line by line like any repetition; which one, if their other columns differ,
is left to Spark. An empty table gives an empty
one. Very long lines and texts are worked on whole. Other columns, of any name, stay; n_lines and n_removed are
replaced by dedup() only.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgraft.llm.common import SPACE, dropped, table, under_own_names, written

#: Asks for a Bloom filter of the wanted sets on the scan of all sets, before their words are shuffled.
BLOOM = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}
#: The word counts have 2 ** BUCKET_BITS cells; they come together in chunks of 2 ** CHUNK_BITS.
BUCKET_BITS, CHUNK_BITS = 21, 12
#: A rarity is 4 * log2(count), so 36 stands for words in 512 sets or more, whose rows tell which set is earlier; rounds of leaders.
RARITY_SHIFT, HOT, LEADERS = 56, 36, 2
#: Stands for a null id: before all others.
NO_ID = -(1 << 63)
KEY = ("id", "m1", "m2")
#: The rows of the prefixes are joined in so many passes, by their words, so that as small a part is on disk at once.
PASSES = 3


def keys(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """What tells a row's document apart: its id, and its text by a hash of 128 bits."""
    text = F.col(text_col).cast("string")
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("m1"), F.xxhash64(F.lit(1), text).alias("m2")]


def long_enough(min_words: int) -> str:
    """Pattern of a line of at least so many words."""
    word = f"[^{SPACE[1:-2]}]"
    return rf"(?:{word}+{SPACE}){{{max(min_words, 1) - 1}}}{word}"


def hashed_words(line: Column) -> Column:
    """The sorted distinct hashes of a line's lower-cased words."""
    low = F.lower(line)
    odd = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\x0b")) | F.contains(line, F.lit("\x0c")) | F.contains(line, F.lit("\r"))
    parts = F.when(odd, F.split(low, SPACE)).otherwise(F.split(low, " "))  # a single blank needs no pattern
    return F.sort_array(F.array_remove(F.array_distinct(F.transform(parts, lambda w: F.xxhash64(w))), F.xxhash64(F.lit(""))))


def distinct_sets(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """(set: its number, id, m1, m2, line, codes) of the first line of each distinct set of words, as a table."""
    # a text is hashed once, before it is cut: not again for each of its lines
    texts = docs.select(*keys(docs, id_col, text_col), F.col(text_col).cast("string").alias("text"))
    lines = texts.select(*KEY, F.posexplode(F.split("text", "\n")).alias("line", "words"))
    lines = lines.filter(F.col("words").rlike(long_enough(min_words))).select(*KEY, "line", hashed_words(F.col("words")).alias("codes"))
    lines = lines.withColumns({"h1": F.xxhash64("codes"), "h2": F.xxhash64(F.lit(1), "codes")})
    # each task keeps one line of a set before the shuffle, so a line that is everywhere is no group of its own
    first = F.row_number().over(Window.partitionBy("h1", "h2").orderBy(*KEY, "line"))
    lines = lines.withColumn("first", first).filter("first = 1")
    return written(lines.select(F.monotonically_increasing_id().alias("set"), *KEY, "line", "codes"), "sets")


def rarities(sets: DataFrame) -> DataFrame:
    """One row with an array: the rarity of each bucket of words, by how many sets hold a word of it."""
    bucket = lambda c: c.bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)).cast("int")
    ones = sets.select(F.explode("codes").alias("c")).select(bucket(F.col("c")).alias("bucket"), F.lit(1).alias("n"))
    none = sets.sparkSession.range(1 << BUCKET_BITS).select(F.col("id").cast("int").alias("bucket"), F.lit(0).alias("n"))
    counts = ones.unionAll(none).groupBy("bucket").agg(F.sum("n").alias("n"))
    rarity = F.least(F.floor(4 * F.log2(F.greatest("n", F.lit(1)))), F.lit(126)).cast("tinyint")
    cells = F.sort_array(F.collect_list(F.struct("bucket", rarity.alias("rarity"))))["rarity"]
    chunks = counts.groupBy(F.shiftright("bucket", CHUNK_BITS).alias("chunk")).agg(cells.alias("cells"))
    return chunks.agg(F.flatten(F.sort_array(F.collect_list(F.struct("chunk", "cells")))["cells"]).alias("rarities"))


def prefixes(sets: DataFrame, t: float) -> DataFrame:
    """(set, id, n, b1, b2, prefix): size, parity bitmap of 128 bits and the rarest words of each set, each with its rarity, as a table."""
    place, low = (1 << BUCKET_BITS) - 1, (1 << RARITY_SHIFT) - 1
    ranked = F.expr(f"sort_array(transform(codes, c -> (coalesce(cast(get(rarities, cast(c & {place}L AS int)) AS bigint), 0L) << {RARITY_SHIFT}) | (c & {low}L)))")
    # a word flips one of 128 bits: one of 64, as the six bits from 40 on say (a shift takes six), in the bitmap of its hash's sign
    bits = [F.expr(f"aggregate(codes, 0L, (a, c) -> if(c {sign} 0L, a ^ (1L << cast(c >> 40 AS int)), a))") for sign in ("<", ">=")]
    # a set of n words resembles no other of n + 1 unless n is at least t / (1 - t); equal sets have met already
    least = math.ceil(t / (1 - t) - 1e-9) if t < 1 else 1 << 30
    known = sets.filter(F.size("codes") >= least).withColumn("rarities", rarities(sets).scalar())
    n = F.size("codes")
    return written(known.select("set", "id", n.alias("n"), bits[0].alias("b1"), bits[1].alias("b2"), F.slice(ranked, F.lit(1), (n - F.ceil(n * t - 1e-9) + 1).cast("int")).alias("prefix")), "prefixes")


def rows_of(sets: DataFrame, *more: str) -> DataFrame:
    """(code, id, set, n, pos, b1, b2, *more): a row for each word of each prefix that more than one set can hold."""
    rows = sets.select("set", "id", "n", "b1", "b2", *more, F.posexplode("prefix").alias("pos", "code"))
    return rows.filter(F.col("code") >= 1 << RARITY_SHIFT).select("code", "id", "set", "n", "pos", "b1", "b2", *more)


def near(x: str, y: str, t: float) -> Column:
    """Whether the filters leave the pair of rows x and y: by length, places and bitmap."""
    at = lambda r, c: F.col(f"{r}.{c}")
    nx, ny = at(x, "n"), at(y, "n")
    most = nx + ny - 2 * F.ceil((nx + ny) * (t / (1 + t)) - 1e-9)  # words in one of the sets alone
    length = F.least(nx, ny) >= t * F.greatest(nx, ny) - 1e-9
    return length & (at(x, "pos") + at(y, "pos") <= most) & (sum(F.bit_count(at(x, b).bitwiseXOR(at(y, b))) for b in ("b1", "b2")) <= most)


def repeated(sets: DataFrame, pairs: DataFrame, t: float) -> DataFrame:
    """(set): of each pair (a, b) that has the similarity, the later one, as a table."""
    pairs = written(pairs.distinct(), "pairs")
    wanted = written(pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct(), "wanted")
    # numbers are never negative: the optimizer makes Bloom filters only of a side that has some condition
    met = sets.join(wanted.filter("set >= 0"), "set").select("set", F.struct(*KEY, "line").alias("place"), "codes")
    met = written(met, "met", BLOOM)
    one = pairs.join(met.select(F.col("set").alias("a"), F.col("place").alias("place_a"), F.col("codes").alias("mine")), "a")
    two = one.join(met.select(F.col("set").alias("b"), F.col("place").alias("place_b"), "codes"), "b")
    both = F.size(F.array_intersect("mine", "codes"))
    alike = two.filter(both >= t * (F.size("mine") + F.size("codes") - both) - 1e-9)
    found = written(alike.select(F.when(F.col("place_a") < F.col("place_b"), F.col("b")).otherwise(F.col("a")).alias("set")).distinct(), "repeated")
    dropped(pairs, wanted, met)
    return found


def led(sets: DataFrame, prefixed: DataFrame, t: float) -> DataFrame:
    """(set): sets that repeat the earliest set of their group, by LEADERS leaders a group, as a table.

    A set's group is the most frequent word of its prefix, so each set is one row, however many of its words are frequent.
    That need not be the first word that two sets share, so its places rule nothing out.
    """
    rows = prefixed.select(F.element_at("prefix", -1).alias("code"), "id", "set", "n", F.lit(0).alias("pos"), "b1", "b2")
    rows = rows.filter(F.col("code") >= 1 << RARITY_SHIFT)
    found = tried = None
    for _ in range(LEADERS):
        rest = rows if tried is None else rows.join(tried, "set", "left_anti")
        lead = written(rest.groupBy("code").agg(F.min(F.struct("id", "set", "n", "pos", "b1", "b2")).alias("y"), F.count("*").alias("many")).filter("many > 1").drop("many"), "leaders")
        x = rest.select("code", F.struct("id", "set", "n", "pos", "b1", "b2").alias("x"))
        pairs = x.join(lead, "code").filter((F.col("x.set") != F.col("y.set")) & near("x", "y", t))
        more = repeated(sets, pairs.select(F.col("x.set").alias("a"), F.col("y.set").alias("b")), t)
        found = more if found is None else found.union(more)
        done = more.union(lead.select("y.set"))
        tried = done if tried is None else tried.union(done)
    return written(found.distinct(), "led")


def met(known: DataFrame, t: float, n: int) -> DataFrame:
    """(a, b): the pairs that the filters leave among the words of pass n, if the later set is still open; a table.

    Only words that many sets hold have rows with ids: of the others either of a pair may be open. Rows of the same
    id meet both ways. Verification tells which is the later.
    """
    rows = rows_of(known, "open").filter(F.pmod(F.col("code"), F.lit(PASSES)) == n)
    word = (F.col("code").bitwiseAND(F.lit((1 << 32) - 1)) - (1 << 31)).cast("int")  # 32 bits of its hash
    many = F.when(F.col("code") >= HOT << RARITY_SHIFT, F.col("id"))
    rows = rows.select(word.alias("word"), F.struct("set", many.alias("id"), "n", "pos", "b1", "b2", "open").alias("x"))
    other = rows.select(F.col("word").alias("word_2"), F.col("x").alias("y"))
    either = (F.col("x.set") < F.col("y.set")) & (F.col("x.open") | F.col("y.open"))
    asks = F.when(F.col("x.id") != F.col("y.id"), (F.col("x.id") < F.col("y.id")) & F.col("y.open")).otherwise(either)
    pairs = rows.join(other, (F.col("word") == F.col("word_2")) & asks & near("x", "y", t))
    return written(pairs.select(F.col("x.set").alias("a"), F.col("y.set").alias("b")).distinct(), "met")


def first_lines(docs: DataFrame, t: float = 0.8, min_words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, m1, m2, line): the compared lines that stay, each the first of its kind, as a table."""
    sets = distinct_sets(docs, min_words, id_col, text_col)
    prefixed = prefixes(sets, t)
    settled = led(sets, prefixed, t)
    known = prefixed.join(settled.withColumn("open", F.lit(False)), "set", "left").withColumn("open", F.coalesce("open", F.lit(True)))
    more = repeated(sets, reduce(DataFrame.union, (met(known, t, n) for n in range(PASSES))), t)
    stay = sets.select("set", *KEY, "line").join(settled.union(more), "set", "left_anti")
    stay = written(stay.select(*KEY, "line"), "stay")
    dropped(sets, prefixed, settled, more)
    return stay


def cleaned(docs: DataFrame, t: float, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """docs with __text, the text without the removed lines, and __lines, __left, the lines before and after."""
    stay = first_lines(docs, t, min_words, id_col, text_col)
    stay = stay.groupBy(*(F.col(k).alias(f"__{k}") for k in KEY)).agg(F.collect_list("line").alias("__stay"))
    known = docs.select("*", *(k.alias(f"__k{i}") for i, k in enumerate(keys(docs, id_col, text_col))))
    met = known.join(stay, [F.col(f"__k{i}") == F.col(f"__{k}") for i, k in enumerate(KEY)], "left")
    # of rows with the same id and text the first has the lines; the join has put them together
    own = [f"__k{i}" for i in range(len(KEY))]
    met = met.withColumn("__copy", F.row_number().over(Window.partitionBy(*own).orderBy(*own)))
    met = met.withColumn("__all", F.split(F.col(text_col).cast("string"), "\n"))
    short = F.expr(f"filter(sequence(0, size(__all) - 1), i -> NOT get(__all, i) RLIKE {quoted(long_enough(min_words))})")
    mine = F.when((F.col("__copy") == 1) & F.col("__stay").isNotNull(), F.col("__stay")).otherwise(F.array().cast("array<int>"))
    met = met.withColumn("__kept", F.sort_array(F.concat(mine, short)))
    none = F.col(text_col).isNull()
    left = F.when(none, 0).otherwise(F.size("__kept"))
    lines = F.when(none, 0).otherwise(F.size("__all"))
    text = F.when(none | (F.size("__kept") == F.size("__all")), F.col(text_col).cast("string")).otherwise(F.array_join(F.transform("__kept", lambda i: F.get("__all", i)), "\n"))
    return met.select(*docs.columns, text.alias("__text"), lines.alias("__lines"), left.alias("__left"))


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\") + "'"


@under_own_names
def dedup(docs: DataFrame, t: float = 0.8, min_words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with its columns, text_col without the removed lines, and n_lines, n_removed (int)."""
    met = cleaned(docs, t, min_words, id_col, text_col)
    columns = [(F.col("__text") if c == text_col else F.col(c)).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return met.select(*columns, F.col("__lines").alias("n_lines"), (F.col("__lines") - F.col("__left")).alias("n_removed"))


@under_own_names
def without_repeats(docs: DataFrame, t: float = 0.8, min_words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with just its columns, text_col without the removed lines."""
    return cleaned(docs, t, min_words, id_col, text_col).select(*(F.col("__text").alias(c) if c == text_col else F.col(c) for c in docs.columns))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op4_lines": op4_lines}
SQL: dict[str, str] = {}
