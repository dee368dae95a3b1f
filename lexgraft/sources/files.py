"""Entries and lexicons as files: JSON lines, XML dumps, exception lists; written to shared scratch and read back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "entry_id long, lemma string, pos string, glosses array<string>, relations array<struct<target:string,type:string>>"
#: Bytes of compressed files of which a join may make a broadcast.
SMALL = 1_000_000
PAGE = "title string, ns long, revision struct<text:string>"


def scratch(spark: SparkSession) -> str:
    """A new folder in the cluster's checkpoint folder; one of our own where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lexgraft-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/files-{uuid.uuid4().hex}"


def stamp(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """The files under a folder: how many, their bytes, the time of the last change."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, n, size, last = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True), 0, 0, 0
    while found.hasNext():
        file = found.next()
        n, size, last = n + 1, size + file.getLen(), max(last, file.getModificationTime())
    return n, size, last


def write_entries(entries: DataFrame, path: str) -> None:
    """K1: one JSON object a line."""
    entries.write.json(path)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries from JSON lines, fields by name."""
    return spark.read.schema(ENTRY).json(path)


def read_dump(spark: SparkSession, path: str, language: str = "English") -> DataFrame:
    """(title, pos, n, gloss) of one language's sections of an XML dump's pages, in order."""
    pages = spark.read.format("xml").option("rowTag", "page").schema(PAGE).load(path).filter("ns = 0")
    section = F.regexp_extract("revision.text", rf"(?s)(?:^|\n)==\s*{language}\s*==\n(.*?)(?:\n==[^=]|$)", 1)
    parts = pages.select("title", F.explode(F.split(section, r"(?:^|\n)===(?!=)")).alias("part"))
    named = parts.select("title", F.lower(F.trim(F.regexp_extract("part", r"^\s*([A-Za-z ]+?)\s*===", 1))).alias("pos"), F.regexp_extract_all("part", F.lit(r"(?m)^# (.*)$"), F.lit(1)).alias("glosses"))
    return named.filter("pos <> ''").select("title", "pos", F.posexplode("glosses").alias("n", "gloss"))


def read_exceptions(spark: SparkSession, path: str) -> DataFrame:
    """(surface, base) of irregular forms, a line each."""
    words = F.split("value", " ")
    return spark.read.text(path).select(words[0].alias("surface"), words[1].alias("base"))


def write_exceptions(pairs: DataFrame, path: str) -> None:
    """K5: lines of irregular forms (surface, pos, base) in a folder for each part of speech.

    Each file is sorted, and so are the files of a folder by their numbers: ranges of the whole order.
    """
    lines = pairs.select("pos", F.concat_ws(" ", "surface", "base").alias("line")).distinct()
    lines.repartitionByRange("pos", "line").sortWithinPartitions("pos", "line").write.partitionBy("pos").text(path)


#: Letters of the parts of speech in lexicon files.
LETTERS = {"noun": "n", "verb": "v", "adjective": "a", "adverb": "r"}


def letter(pos: str | Column) -> Column:
    return F.create_map(*[F.lit(x) for p in LETTERS.items() for x in p])[F.col(pos)]


def part_of_speech(letter: Column) -> Column:
    return F.create_map(*[F.lit(x) for p, c in LETTERS.items() for x in (c, p)])[letter]


def padded(number: Column, least: int) -> Column:
    """A number's digits, at least so many; longer ones stay whole (lpad would cut them)."""
    return F.lpad(number, F.greatest(F.lit(least), F.length(number)), F.lit("0"))


def write_lexicon(path: str, synset: DataFrame, sense: DataFrame, edge: DataFrame, exception: DataFrame) -> None:
    """S3: a lexicon as text: data, index, senses and exceptions, each sorted, in a folder for each part of speech.

    A data line holds the synset, its letter, a count and that many lemmas with their numbers, a count and that many
    pointers of four fields (symbol, target, letter, places of the words), a bar and the gloss. An index line holds a
    lemma, its letter, a count of senses, a count and that many symbols, and the synsets in the order of senses.
    """
    spelled = F.replace("lemma", F.lit(" "), F.lit("_"))
    lemmas = sense.groupBy("synset_id").agg(F.array_sort(F.collect_set(F.replace("lemma", F.lit(" "), F.lit("_")))).alias("lemmas"))
    fields = F.concat_ws(" ", "pointer", F.col("dst").cast("string"), letter("other"), F.when(F.col("level") == "synset", "0000").otherwise(F.concat(padded(F.hex(F.col("ord").cast("long")), 2), F.lit("01"))))
    kinds = synset.select(F.col("synset_id").alias("dst"), F.col("pos").alias("other"))
    out = edge.join(kinds, "dst").groupBy(F.col("src").alias("synset_id")).agg(F.array_sort(F.collect_list(fields)).alias("pointers"), F.array_sort(F.collect_set("pointer")).alias("symbols"))
    whole = synset.join(lemmas, "synset_id").join(out, "synset_id", "left").withColumn("pointers", F.coalesce("pointers", F.array().cast("array<string>")))
    numbered = F.transform("lemmas", lambda w, i: F.concat(w, F.lit(" "), F.lower(F.hex(i))))
    data = F.concat_ws(" ", F.col("synset_id").cast("string"), letter("pos"), F.hex(F.size("lemmas")), F.array_join(numbered, " "), padded(F.size("pointers").cast("string"), 3), F.when(F.size("pointers") > 0, F.array_join("pointers", " ")), F.lit("|"), "gloss")
    text = lambda df, name: df.repartitionByRange("pos", "line").sortWithinPartitions("pos", "line").write.partitionBy("pos").text(f"{path}/{name}")
    text(whole.select("pos", data.alias("line")), "data")
    symbols = sense.join(out, "synset_id").select("lemma", "pos", F.explode("symbols").alias("symbol")).groupBy("lemma", "pos").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))
    ids = sense.groupBy("lemma", "pos").agg(F.array_sort(F.collect_list(F.struct("sense_rank", "synset_id"))).alias("ids")).join(symbols, ["lemma", "pos"], "left")
    symbols = F.coalesce("symbols", F.array().cast("array<string>"))
    index = F.concat_ws(" ", spelled, letter("pos"), F.size("ids").cast("string"), F.size(symbols).cast("string"), F.when(F.size(symbols) > 0, F.array_join(symbols, " ")), F.array_join(F.transform("ids", lambda s: s["synset_id"].cast("string")), " "))
    text(ids.select("pos", index.alias("line")), "index")
    text(sense.select("pos", F.concat_ws(" ", F.concat(spelled, F.lit("%"), letter("pos")), F.col("synset_id").cast("string"), F.col("sense_rank").cast("string")).alias("line")), "senses")
    write_exceptions(exception, f"{path}/exceptions")


def read_lexicon(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """S3: the four tables synset, sense, edge and exception of the files that write_lexicon describes.

    Fields are found by the counts before them. Senses come from the index; check() holds them against the others.
    """
    lines = lambda name: spark.read.text(f"{path}/{name}")
    number = lambda c: F.conv(c, 16, 10).cast("int")
    field = lambda c, i: F.get(F.col(c), F.lit(i) if isinstance(i, int) else i)
    halves = F.split("value", r" \| ?", 2)
    data = lines("data").select(F.split(halves[0], " ").alias("f"), halves[1].alias("gloss")).withColumn("words", number(field("f", 2)))
    data = data.select(field("f", 0).cast("long").alias("synset_id"), part_of_speech(field("f", 1)).alias("pos"), F.slice("f", F.lit(4), 2 * F.col("words")).alias("lemmas"), field("f", 3 + 2 * F.col("words")).cast("int").alias("n"), F.expr("slice(f, 5 + 2 * words, size(f))").alias("rest"), "gloss")
    pointer = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.slice("rest", 4 * i + 1, 4))
    edge = data.filter("n > 0").select(F.col("synset_id").alias("src"), F.explode(pointer).alias("p"))
    edge = edge.select("src", field("p", 1).cast("long").alias("dst"), field("p", 0).alias("pointer"), F.when(field("p", 3) == "0000", "synset").otherwise("word").alias("level"), number(F.substring(field("p", 3), F.lit(1), F.length(field("p", 3)) - 2)).alias("ord"))
    index = lines("index").select(F.split("value", " ").alias("f")).withColumn("senses", field("f", 2).cast("int")).withColumn("kinds", field("f", 3).cast("int"))
    ids = F.slice("f", 5 + F.col("kinds"), F.col("senses"))
    sense = index.select(F.replace(field("f", 0), F.lit("_"), F.lit(" ")).alias("lemma"), part_of_speech(field("f", 1)).alias("pos"), F.posexplode(ids).alias("at", "id"))
    words = F.split("value", " ")
    return {
        "synset": data.select("synset_id", "pos", "gloss"),
        "sense": sense.select("lemma", "pos", F.col("id").cast("long").alias("synset_id"), (F.col("at") + 1).cast("int").alias("sense_rank")),
        "edge": edge,
        "exception": lines("exceptions").select(words[0].alias("surface"), "pos", F.explode(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))).alias("base")),
    }


def check(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> DataFrame:
    """(what, id): pointers and senses to synsets that the data don't hold, and senses that the index and the list of senses don't share."""
    ids = tables["synset"].select(F.col("synset_id").alias("id"))
    lost = lambda df, what: df.distinct().join(ids, "id", "left_anti").select(F.lit(what).alias("what"), F.col("id").cast("string").alias("id"))
    listed = spark.read.text(f"{path}/senses").select(F.col("value").alias("id"))
    known = tables["sense"].select(F.concat_ws(" ", F.concat(F.replace("lemma", F.lit(" "), F.lit("_")), F.lit("%"), letter("pos")), F.col("synset_id").cast("string"), F.col("sense_rank").cast("string")).alias("id"))
    other = listed.exceptAll(known).union(known.exceptAll(listed)).select(F.lit("sense listed once").alias("what"), "id")
    return lost(tables["edge"].select(F.col("dst").alias("id")), "pointer").union(lost(tables["sense"].select(F.col("synset_id").alias("id")), "sense")).union(other)


def write_vectors(vectors: DataFrame, buckets: int = 64) -> str:
    """Vectors (word, vec) as a table in the scratch folder, in buckets of their words; its name.

    Joins on the word read it without an exchange, and a filter on words reads their buckets only.
    """
    spark, name = vectors.sparkSession, f"vectors_{uuid.uuid4().hex}"
    vectors.repartition(buckets, "word").write.bucketBy(buckets, "word").sortBy("word").option("path", scratch(spark)).saveAsTable(name)
    return name


def kept(df: DataFrame) -> DataFrame:
    """df as a table in the scratch folder, read again: its lineage is cut and it is computed once.

    Files of few bytes may hold many rows, so above SMALL bytes they are no reason to send a table to all tasks.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return back if stamp(df.sparkSession, path)[1] <= SMALL else back.hint("merge")
