"""Looking lemmas up in the lexicon: equi, semi and anti joins, in fallback order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexgraft.functions import text as T


def exact(keys: DataFrame, sense: DataFrame) -> DataFrame:
    """keys (.., lemma, pos) with synset_id and sense_rank of each sense."""
    return keys.join(sense, ["lemma", "pos"])


def key_forms(keys: DataFrame, exception: DataFrame) -> DataFrame:
    """(key_id, pos, lemma, branch): the lemma's spellings (0), their stems (1), compound stems (2), irregular bases (3)."""
    spelled = keys.select("key_id", "pos", F.explode(T.lemma_variants(F.col("lemma"))).alias("lemma"))
    stems = spelled.select("key_id", "pos", "lemma", T.stems(F.col("lemma"), F.col("pos")).alias("stems"))
    one = stems.select("key_id", "pos", F.explode("stems").alias("lemma"), F.lit(1).alias("branch"))
    many = stems.filter((F.size("stems") == 0) & F.col("lemma").contains(" ")).select("key_id", "pos", F.explode(T.compound_stems(F.col("lemma"), F.col("pos"))).alias("lemma"), F.lit(2).alias("branch"))
    odd = spelled.join(exception.withColumnRenamed("surface", "lemma"), ["lemma", "pos"]).select("key_id", "pos", F.col("base").alias("lemma"), F.lit(3).alias("branch"))
    return spelled.select("key_id", "pos", "lemma", F.lit(0).alias("branch")).unionByName(one).unionByName(many).unionByName(odd)


def fuzzy(keys: DataFrame, sense: DataFrame, exception: DataFrame) -> DataFrame:
    """(key_id, synset_id, branch, sense_rank): every sense that some form of the key reaches, by its first branch."""
    found = key_forms(keys, exception).join(sense, ["lemma", "pos"])
    return found.groupBy("key_id", "synset_id").agg(F.min(F.struct("branch", "sense_rank")).alias("m")).select("key_id", "synset_id", "m.*")


def known(keys: DataFrame, sense: DataFrame, exception: DataFrame) -> DataFrame:
    """(key_id) of the keys that are a lemma themselves, by a stem or by an irregular form (no spellings, no compounds)."""
    forms = keys.select("key_id", "pos", F.explode(F.concat(F.array("lemma"), T.stems(F.col("lemma"), F.col("pos")))).alias("lemma"))
    odd = keys.join(exception.withColumnRenamed("surface", "lemma"), ["lemma", "pos"]).select("key_id", "pos", F.col("base").alias("lemma"))
    return forms.unionByName(odd).join(sense, ["lemma", "pos"], "left_semi").select("key_id").distinct()


def first_sense(keys: DataFrame, sense: DataFrame, exception: DataFrame) -> DataFrame:
    """(key_id, synset_id): the first sense of the first branch that has any."""
    best = F.min(F.struct("branch", "sense_rank", "synset_id")).alias("m")
    return fuzzy(keys, sense, exception).groupBy("key_id").agg(best).select("key_id", F.col("m.synset_id").alias("synset_id"))


def one_hop(nodes: DataFrame, edge: DataFrame, pointers: tuple[str, ...] = ("@", "@i", "&", "^")) -> DataFrame:
    """(synset_id, near): neighbours in both directions over the given pointers."""
    some = edge.filter(F.col("pointer").isin(*pointers))
    both = some.select("src", "dst").unionByName(some.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return nodes.join(both, nodes.synset_id == both.src).select("synset_id", F.col("dst").alias("near")).distinct()


def best(scored: DataFrame, key: str, least: float = 0.0) -> DataFrame:
    """The row of each key with the greatest score above least; ties by sense_rank, then synset_id."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "sense_rank", "synset_id"))
    return scored.filter(F.col("score") > least).withColumn("rn", rank).filter("rn = 1").drop("rn")
