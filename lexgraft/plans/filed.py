"""Round trips through files, and the loop over rounds, as queries over the derived lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgraft.functions import text as T
from lexgraft.operators import lookup
from lexgraft.plans import rules as R
from lexgraft.sources import files
from lexgraft.sources import tables as S


def entries(spark, d) -> DataFrame:
    links = S.relation(spark, d).groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("target", "type"))).alias("relations"))
    rows = S.entry(spark, d).join(links, "entry_id", "left")
    return rows.select("entry_id", "lemma", "pos", F.array("gloss").alias("glosses"), "relations")


def read_entries_jsonl(spark, d) -> DataFrame:
    """Entries written as JSON lines and read back."""
    path = files.scratch(spark)
    files.write_entries(entries(spark, d), path)
    rows = files.read_entries(spark, path)
    return rows.select("entry_id", "lemma", "pos", F.col("glosses")[0].alias("gloss"), F.array_join(F.transform("relations", lambda r: r["target"]), ",").alias("targets"))


def write_entries_jsonl(spark, d) -> DataFrame:
    """K1: the written lines, as they stand in the files."""
    path = files.scratch(spark)
    files.write_entries(entries(spark, d), path)
    return spark.read.text(path).select(F.get_json_object("value", "$.entry_id").cast("long").alias("entry_id"), F.col("value").alias("line"))


def read_dump_entries(spark, d) -> DataFrame:
    """Pages of an XML dump, made of the marked-up glosses, read back as entries."""
    raw = S.raw(spark, d)
    body = F.concat(F.lit("==English==\n==="), F.initcap("pos"), F.lit("===\n# "), "raw", F.lit("\n# second of "), "lemma", F.lit("\n==French==\n===Noun===\n# other"))
    pages = raw.select(F.col("entry_id").cast("string").alias("title"), F.lit(0).alias("ns"), F.struct(body.alias("text")).alias("revision"))
    path = files.scratch(spark)
    pages.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(path)
    return files.read_dump(spark, path).select(F.col("title").cast("long").alias("entry_id"), "pos", "n", "gloss")


def exceptions_in(spark, d) -> DataFrame:
    """Irregular forms written as lines and read back."""
    path = files.scratch(spark)
    S.exception(spark, d).select(F.concat_ws(" ", "surface", "base").alias("value")).write.text(path)
    return files.read_exceptions(spark, path)


def load_lexicon(spark, d) -> DataFrame:
    """S3: the four tables of a lexicon, written as files of counted fields and read back; glosses by digest.

    t says which table a row is of. What the reference check finds is a row too.
    """
    x, path = R.made(spark, d, "lexicon"), files.scratch(spark)
    files.write_lexicon(path, x.synset, x.sense, x.edge, x.exception)
    tables = files.read_lexicon(spark, path)
    row = lambda t, t_name, **c: t.select(F.lit(t_name).alias("t"), *(F.expr(c.get(k, f"cast(null as {kind})")).cast(kind).alias(k) for k, kind in (("a", "long"), ("b", "long"), ("p", "string"), ("q", "string"), ("r", "string"), ("n", "int"))))
    out = row(tables["synset"], "synset", a="synset_id", q="pos", r="md5(gloss)").unionByName(row(tables["sense"], "sense", a="synset_id", p="lemma", q="pos", n="sense_rank"))
    out = out.unionByName(row(tables["edge"], "edge", a="src", b="dst", p="pointer", q="level", n="ord")).unionByName(row(tables["exception"], "exception", p="surface", q="pos", r="base"))
    return out.unionByName(row(files.check(spark, path, tables), "fault", p="what", q="id"))


def share(a, b):
    """The share of a's words that b has too."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))


def pluggable_similarity(spark, d, similarity=share) -> DataFrame:
    """V6: the best sense under any similarity of two lists of words; each gloss is cut into words once."""
    words = lambda df: df.withColumn("words", T.gloss_words(F.lower("gloss"))).drop("gloss")
    senses = S.sense(spark, d).join(words(S.synset(spark, d).select("synset_id", "gloss")).withColumnRenamed("words", "other"), "synset_id")
    met = words(S.entry(spark, d)).join(senses, ["lemma", "pos"])
    return lookup.best(met.withColumn("score", F.round(similarity(F.col("words"), F.col("other")), 6)), "entry_id").select("entry_id", "synset_id", "score")


QUERIES = {f.__name__: f for f in (read_entries_jsonl, write_entries_jsonl, read_dump_entries, exceptions_in, load_lexicon, pluggable_similarity)}

_WORDS = r"list_distinct(list_filter(list_transform(string_split_regex(trim(lower({g})), '\s+'), lambda t: regexp_extract(t, '^[[:punct:]]*([^[:punct:]\s]+)[[:punct:]]*$', 1)), lambda t: t <> ''))"
SQL = {
    "read_entries_jsonl": "SELECT e.entry_id, e.lemma, e.pos, e.gloss, string_agg(r.target, ',' ORDER BY r.target) AS targets FROM entry e LEFT JOIN relation r USING (entry_id) GROUP BY ALL",
    "read_dump_entries": "SELECT entry_id, pos, 0 AS n, raw AS gloss FROM raw UNION ALL SELECT entry_id, pos, 1, 'second of ' || lemma FROM raw",
    "exceptions_in": "SELECT surface, base FROM exception",
    "load_lexicon": """SELECT 'synset' AS t, synset_id AS a, NULL::BIGINT AS b, NULL::VARCHAR AS p, pos AS q, md5(gloss) AS r, NULL::INTEGER AS n FROM synset
        UNION ALL SELECT 'sense', synset_id, NULL, lemma, pos, NULL, sense_rank FROM sense UNION ALL SELECT 'edge', src, dst, pointer, level, NULL, ord FROM edge UNION ALL SELECT 'exception', NULL, NULL, surface, pos, base, NULL FROM exception""",
    "pluggable_similarity": f"""WITH ew AS MATERIALIZED (SELECT entry_id, lemma, pos, {_WORDS.format(g='gloss')} AS a FROM entry), sw AS MATERIALIZED (SELECT synset_id, {_WORDS.format(g='gloss')} AS b FROM synset),
        s AS (SELECT entry_id, synset_id, sense_rank, round(len(list_intersect(a, b)) / greatest(len(a), 1), 6) AS score FROM ew JOIN sense n USING (lemma, pos) JOIN sw USING (synset_id))
        SELECT entry_id, synset_id, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY score DESC, sense_rank, synset_id) = 1""",
}
