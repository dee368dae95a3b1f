"""The lexicon and the dictionary entries as DataFrames, derived from the star schema and the documents.

Everything grows with the given tables; glosses are whole texts. A lemma has a bounded number of senses: a part's
own lemma is shared by eight parts at most (a block of 512 keys has 64 names), a word has one sense for each first
word of a type. SQL holds the same definitions for DuckDB, as a list of CTEs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgraft.sources import files

#: Ids of synsets of one part of speech start here.
BASE = {"noun": 0, "adjective": 1_000_000_000_000, "verb": 2_000_000_000_000, "adverb": 3_000_000_000_000}
#: The types of links between entries.
RELATION_TYPES = ("SYNONYM", "ANTONYM", "HYPERNYM", "HYPONYM", "HOLONYM", "MERONYM", "COORDINATE_TERM", "TROPONYM", "SEE_ALSO", "DERIVED_TERM", "ETYMOLOGICALLY_RELATED_TERM", "DESCENDANT", "CHARACTERISTIC_WORD_COMBINATION")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size(spark: SparkSession, sf_dir: str, name: str) -> Column:
    """The table's number of rows, as a subquery of the plan."""
    return table(spark, sf_dir, name).agg(F.count("*")).scalar()


def whole(text: str) -> Column:
    """A text on one line."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def part_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, lemma, adj, noun, kind, grp) of each part; the block's number is spelled in letters."""
    name, grp = F.split(F.lower("p_name"), " "), F.lower("p_type")
    block = F.translate(F.floor(F.col("p_partkey") / 512).cast("string"), "0123456789", "abcdefghij")
    lemma = F.concat(name[0], F.lit(" "), name[1], block)
    rows = table(spark, sf_dir, "part")
    if files.stamp(spark, f"{sf_dir}/part.parquet")[1] > files.SMALL:
        rows = rows.hint("merge")
    return rows.select(F.col("p_partkey").alias("key"), lemma.alias("lemma"), name[0].alias("adj"), name[1].alias("noun"), F.concat_ws(" ", grp, F.replace(F.lower("p_brand"), F.lit("#"), F.lit(""))).alias("kind"), grp.alias("grp"))


def word_senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lemma, pos, grp, key): the first part of each group for each word that names it."""
    parts, out = part_words(spark, sf_dir), None
    for word, pos in (("noun", "noun"), ("grp", "noun"), ("adj", "adjective"), ("grp", "adjective"), ("noun", "verb"), ("adj", "adverb")):
        lemma = F.concat(F.col(word), F.lit("ly")) if pos == "adverb" else F.col(word)
        rows = parts.select(lemma.alias("lemma"), F.lit(pos).alias("pos"), "grp", "key")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("lemma", "pos", "grp").agg(F.min("key").alias("key"))


def based(pos: str = "pos") -> Column:
    """Where the ids of the row's part of speech start."""
    return F.create_map(*[F.lit(x) for p in BASE.items() for x in p])[F.col(pos)]


def sense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lemma, pos, synset_id, sense_rank): parts by their lemmas, and their words once for each group."""
    full = part_words(spark, sf_dir).select("lemma", F.lit("noun").alias("pos"), F.col("key").alias("synset_id"))
    words = word_senses(spark, sf_dir).select("lemma", "pos", (F.col("key") + based()).alias("synset_id"))
    rank = F.row_number().over(Window.partitionBy("lemma", "pos").orderBy("synset_id"))
    return full.unionByName(words).distinct().withColumn("sense_rank", rank)


def synset(spark: SparkSession, sf_dir: str, senses: DataFrame | None = None) -> DataFrame:
    """(synset_id, pos, gloss): the gloss is a whole document. senses: those of sense(), where they are known."""
    docs = table(spark, sf_dir, "documents").select("doc_id", whole("text").alias("gloss"))
    return synset_text(spark, sf_dir, senses).join(docs, "doc_id").select("synset_id", "pos", "gloss")


def synset_text(spark: SparkSession, sf_dir: str, senses: DataFrame | None = None) -> DataFrame:
    """(synset_id, pos, doc_id): the document whose text a synset's gloss is."""
    ids = (sense(spark, sf_dir) if senses is None else senses).select("synset_id", "pos").distinct()
    place = (F.col("synset_id") - based()) * F.create_map(*[F.lit(x) for p in (("noun", 1), ("adjective", 3), ("verb", 5), ("adverb", 7)) for x in p])[F.col("pos")]
    return ids.withColumn("doc_id", place % size(spark, sf_dir, "documents"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, lemma, pos, gloss): a whole document, for the lemma of a part."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"), (F.col("doc_id") * 7 % size(spark, sf_dir, "part")).alias("key"), whole("text").alias("gloss"))
    return docs.join(part_words(spark, sf_dir).select("key", "lemma"), "key").select("entry_id", "lemma", F.lit("noun").alias("pos"), "gloss")


# The shapes of the marked-up glosses, by key modulo their number: part of speech, gloss with {words} of the part.
SHAPES = (
    ("noun", "{{{{context|{grp}|{noun}|lang=en}}}} A [[{noun}]] that is [[{adj}|{adj}ish]]"),
    ("verb", 'To quickly [[{noun}]] the {adj}; "to {noun} it"'),
    ("adjective", "not {adj}; opposed to {grp}"),
    ("adverb", "In a {adj} manner"),
    ("noun", "{{{{synonym of|{noun}}}}} {{{{soplink|{adj}|{noun}}}}}"),
    ("noun", "A {noun} of the {grp} {noun}; {adj} ({kind}"),
    ("noun", "One who {{{{term|{noun}}}}} {{{{unknown|x}}}} “{adj}”"),
    ("adjective", "Of or relating to {noun}, {adj}, {kind}"),
    ("noun", "{{{{informal form of|{noun}}}}} of {adj} {grp}"),
    ("adjective", "{{{{diminutive of|{adj}}}}}"),
    ("noun", "{{{{feminine of|{grp}}}}} and {adj}"),
    ("noun", "{{{{alternative spelling of|{noun}}}}}"),
    ("verb", "to not {noun}, to {noun} badly"),
    ("noun", "lack of {noun}; absence of {grp}"),
    ("noun", "{grp}; a {grp}; the {grp}"),
    ("verb", "to {noun}; to {grp}; {noun}"),
    ("noun", "Any member of the {cap}"),
    ("noun", "A {noun} that is {adj} and {grp}"),
    ("verb", "to {adj}ly {noun} a {grp}"),
    ("adjective", "{adj}, {grp}, {adj}"),
    ("noun", "A {noun} who has {grp}"),
    ("noun", "any of various {grp} {noun} which are {adj}; {grp}"),
    ("noun", "In the {adj} style, a [[{grp}]] of {noun}"),
    ("adjective", "pertaining to the {adj} {noun}"),
    ("noun", "{noun}, formerly someone who has {adj}"),
    ("noun", "Now {grp}. The {noun} of a {grp} {noun}, {adj}"),
    ("adverb", "{adj}ly; in an {adj} way, of {noun}"),
    ("noun", "{{{{form of|plural|{noun}}}}} {{{{synonym of|{grp}}}}} and {adj}"),
    ("adjective", "not zz{adj}; opposed to {adj} and {noun}"),
    ("noun", "any {grp} x-{noun} that is {adj}"),
    ("adjective", "of, or relating to a {noun}; {adj}"),
    ("adjective", "{adj}, {adj}-like, {grp}, {noun} or so"),
)


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, lemma, pos, raw): marked-up glosses, one for each part; of four lemmas the lexicon knows one."""
    parts = part_words(spark, sf_dir).withColumn("cap", F.initcap("noun"))
    text, pos, shape = F, F, F.col("key") % len(SHAPES)
    for i, (p, form) in enumerate(SHAPES):
        pieces = [F.lit(x) if isinstance(x, str) else F.col(x[0]) for x in cut(form)]
        text, pos = text.when(shape == i, F.concat(*pieces)), pos.when(shape == i, F.lit(p))
    lemma = F.when(F.floor(F.col("key") / len(SHAPES)) % 4 == 0, F.col("lemma")).otherwise(F.concat(F.lit("neo"), "lemma"))
    return parts.select(F.col("key").alias("entry_id"), lemma.alias("lemma"), pos.alias("pos"), text.alias("raw"))


def cut(shape: str) -> list:
    """The pieces of a shape: texts, and names of columns as one-tuples."""
    from string import Formatter

    out = []
    for text, name, _, _ in Formatter().parse(shape):
        out += [text] * bool(text) + ([(name,)] if name else [])
    return out


def relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, type, target, target_sense): links of every fifth marked-up entry, three of them synonyms."""
    links = part_words(spark, sf_dir).filter("key % 5 = 0").select(F.col("key").alias("entry_id"), F.explode(F.array(*map(F.lit, range(1, 7)))).alias("step"))
    kind = F.when(F.col("step") <= 3, RELATION_TYPES[0]).otherwise(F.element_at(F.array(*map(F.lit, RELATION_TYPES[1:])), ((F.col("entry_id") + F.col("step")) % 12 + 1).cast("int")))
    links = links.select("entry_id", kind.alias("type"), ((F.col("entry_id") + F.col("step")) % size(spark, sf_dir, "part")).alias("key"), "step")
    met = links.join(part_words(spark, sf_dir).select("key", "noun", "grp", "lemma"), "key")
    target = F.when(F.col("step") == 1, F.col("noun")).when(F.col("step") == 2, F.col("grp")).otherwise(F.col("lemma"))
    return met.select("entry_id", "type", target.alias("target"), F.when(F.col("step") > 3, F.concat(target, F.lit(".1"))).alias("target_sense"))


def exception(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(surface, pos, base): irregular plurals of the nouns."""
    nouns = part_words(spark, sf_dir).select(F.col("noun").alias("base")).distinct()
    return nouns.select(F.concat("base", F.lit("en")).alias("surface"), F.lit("noun").alias("pos"), "base")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): hypernym edges from orders over customers and nations to regions."""
    t = lambda name: table(spark, sf_dir, name)
    edge = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"))
    return (
        edge(t("orders"), "O", "o_orderkey", "C", "o_custkey")
        .unionByName(edge(t("customer"), "C", "c_custkey", "N", "c_nationkey"))
        .unionByName(edge(t("nation"), "N", "n_nationkey", "R", "n_regionkey"))
    )


def edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, pointer, level, ord): hypernyms (@) from a part to its type's first, its group's first and the first
    of all (an instance hypernym, @i); among words of adjectives and verbs to the word's first group (& and @);
    antonyms (!) of every other adjective; member meronyms (%m) of a group's first; pertainyms (\\); derivations (+)."""
    parts = part_words(spark, sf_dir)
    row = lambda df, src, dst, pointer, level="synset", ord_=0: df.filter(src != dst).select(src.alias("src"), dst.alias("dst"), F.lit(pointer).alias("pointer"), F.lit(level).alias("level"), F.lit(ord_).alias("ord"))
    kind = parts.groupBy("grp", "kind").agg(F.min("key").alias("k"))
    grp = parts.groupBy("grp").agg(F.min("key").alias("g"))
    up = row(parts.join(kind, ["grp", "kind"]), F.col("key"), F.col("k"), "@")
    mid = row(kind.join(grp, "grp"), F.col("k"), F.col("g"), "@")
    top = row(grp.withColumn("t", parts.agg(F.min("key")).scalar()), F.col("g"), F.col("t"), "@i")
    words = word_senses(spark, sf_dir).withColumn("id", F.col("key") + based())
    first = words.groupBy("lemma", "pos").agg(F.min("id").alias("f"))
    met = words.join(first, ["lemma", "pos"])
    like = row(met.filter("pos = 'adjective'"), F.col("id"), F.col("f"), "&")
    verb = row(met.filter("pos = 'verb'"), F.col("id"), F.col("f"), "@")
    adjectives = words.filter("pos = 'adjective'").select("grp", "id").distinct()
    anti = row(adjectives.withColumn("other", F.lead("id").over(Window.partitionBy("grp").orderBy("id"))).withColumn("n", F.row_number().over(Window.partitionBy("grp").orderBy("id"))).filter("n % 2 = 1 AND other IS NOT NULL"), F.col("id"), F.col("other"), "!", "word", 1)
    member = row(parts.filter("key % 3 = 0").join(grp, "grp"), F.col("g"), F.col("key"), "%m")
    noun = words.filter("pos = 'noun'").select("grp", F.col("key").alias("n"), F.col("id").alias("noun_id"))
    pert = row(words.filter("pos = 'adjective'").join(noun, (words.grp == noun.grp) & (F.col("key") == F.col("n"))).select("id", "noun_id").distinct(), F.col("id"), F.col("noun_id"), "\\", "word", 1)
    same = parts.groupBy("lemma").agg(F.min("key").alias("f")).join(parts, "lemma")
    plus = row(same, F.col("key"), F.col("f"), "+", "word", 2)
    out = up
    for df in (mid, top, like, verb, anti, member, pert, plus):
        out = out.unionByName(df)
    return out.distinct()


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word): every word of the documents, the lexicon and the marked-up glosses."""
    from lexgraft.functions import text as T

    words = lambda df, c: df.select(F.explode(T.gloss_words(F.lower(c))).alias("word"))
    known = words(table(spark, sf_dir, "documents"), "text").unionByName(words(raw(spark, sf_dir).withColumn("raw", T.clean_gloss(F.col("raw"))), "raw"))
    return known.unionByName(words(sense(spark, sf_dir), "lemma")).distinct()


def place(word: str | Column, n: int | Column) -> Column:
    """The number of a word's vector among n: its hash."""
    return F.conv(F.substring(F.md5(word), 1, 12), 16, 10).cast("long") % n


def word_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, vec): every word of the vocabulary has the vector at its hash."""
    known = vocabulary(spark, sf_dir).withColumn("vec_id", place("word", size(spark, sf_dir, "embeddings")))
    return known.join(table(spark, sf_dir, "embeddings"), "vec_id").select("word", F.col("embedding").alias("vec"))


def hashed_vectors(spark: SparkSession, sf_dir: str):
    """The same for texts whose words the vocabulary holds: a word's vector is found by its hash alone."""
    from lexgraft.operators.similarity import HashVectors

    units, n = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "embeddings").count()
    return HashVectors(units.select("vec_id", F.col("embedding").alias("vec")), lambda w: place(w, F.lit(n)))


def _shaped() -> str:
    def sql(shape: str) -> str:
        return " || ".join("'" + x.replace("'", "''") + "'" if isinstance(x, str) else x[0] for x in cut(shape))

    cases = "\n    ".join(f"WHEN {i} THEN {sql(shape)}" for i, (_, shape) in enumerate(SHAPES))
    pos = ", ".join(f"'{p}'" for p, _ in SHAPES)
    return f"""raw AS (SELECT key AS entry_id, CASE WHEN (key // {len(SHAPES)}) % 4 = 0 THEN lemma ELSE 'neo' || lemma END AS lemma, [{pos}][key % {len(SHAPES)} + 1] AS pos,
  CASE key % {len(SHAPES)} {cases} END AS raw FROM (SELECT *, upper(left(noun, 1)) || substr(noun, 2) AS cap FROM parts))"""


_GLOSS_WORDS = r"list_distinct(list_filter(list_transform(string_split_regex(trim(lower({g})), '\s+'), lambda t: regexp_extract(t, '^[[:punct:]]*([^[:punct:]\s]+)[[:punct:]]*$', 1)), lambda t: t <> ''))"
_CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({g},
  '[“”]', '"', 'g'), '\{{\{{soplink\|([^{{}}|]*)\|([^{{}}|]*)\|([^{{}}|]*)\}}\}}', '\1\2\3', 'g'), '\{{\{{soplink\|([^{{}}|]*)\|?([^{{}}|]*)\}}\}}', '\1\2', 'g'),
  '\{{\{{(?:taxlink|term|w|unsupported|gloss)\|([^{{}}|]*)(?:\|[^{{}}]*)?\}}\}}', '\1', 'g'),
  '\{{\{{non-gloss definition\|([^{{}}|]*)(?:\|[^{{}}]*)?\}}\}}', '\1', 'g'),
  '\{{\{{[^{{}}]*\}}\}}', ' ', 'g'), '\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]', '\1', 'g'))"""
_TYPES = ", ".join(f"'{t}'" for t in RELATION_TYPES[1:])
SQL = (
    r"""
parts AS (SELECT p_partkey AS key, split_part(lower(p_name), ' ', 1) || ' ' || split_part(lower(p_name), ' ', 2) || translate((p_partkey // 512)::VARCHAR, '0123456789', 'abcdefghij') AS lemma,
  split_part(lower(p_name), ' ', 1) AS adj, split_part(lower(p_name), ' ', 2) AS noun, lower(p_type) || ' ' || replace(lower(p_brand), '#', '') AS kind, lower(p_type) AS grp FROM part),
n_docs AS (SELECT count(*) AS n FROM documents), n_parts AS (SELECT count(*) AS n FROM part), n_vecs AS (SELECT count(*) AS n FROM embeddings),
dtext AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS gloss FROM documents),
bases AS (SELECT * FROM (VALUES ('noun', 0::BIGINT, 1), ('adjective', 1000000000000, 3), ('verb', 2000000000000, 5), ('adverb', 3000000000000, 7)) b(pos, base, step)),
wsense AS (SELECT lemma, pos, grp, min(key) AS key FROM (
    SELECT noun AS lemma, 'noun' AS pos, grp, key FROM parts UNION ALL SELECT grp, 'noun', grp, key FROM parts UNION ALL SELECT adj, 'adjective', grp, key FROM parts
    UNION ALL SELECT grp, 'adjective', grp, key FROM parts UNION ALL SELECT noun, 'verb', grp, key FROM parts UNION ALL SELECT adj || 'ly', 'adverb', grp, key FROM parts) GROUP BY lemma, pos, grp),
words AS (SELECT lemma, pos, grp, key, key + base AS id FROM wsense JOIN bases USING (pos)),
sense AS (SELECT lemma, pos, synset_id, row_number() OVER (PARTITION BY lemma, pos ORDER BY synset_id)::INTEGER AS sense_rank FROM (
    SELECT lemma, 'noun' AS pos, key AS synset_id FROM parts UNION SELECT lemma, pos, id FROM words)),
synset AS (SELECT s.synset_id, s.pos, d.gloss FROM (SELECT DISTINCT synset_id, pos FROM sense) s JOIN bases b USING (pos) CROSS JOIN n_docs JOIN dtext d ON d.doc_id = (s.synset_id - b.base) * b.step % n_docs.n),
entry AS (SELECT d.doc_id AS entry_id, p.lemma, 'noun' AS pos, d.gloss FROM dtext d CROSS JOIN n_parts JOIN parts p ON p.key = d.doc_id * 7 % n_parts.n),
"""
    + _shaped()
    + r""",
relation AS (SELECT l.entry_id, l.type, CASE l.step WHEN 1 THEN p.noun WHEN 2 THEN p.grp ELSE p.lemma END AS target, CASE WHEN l.step > 3 THEN p.lemma || '.1' END AS target_sense FROM (
    SELECT key AS entry_id, step, CASE WHEN step <= 3 THEN 'SYNONYM' ELSE ["""
    + _TYPES
    + r"""][(key + step) % 12 + 1] END AS type, (key + step) % n_parts.n AS other FROM parts CROSS JOIN n_parts CROSS JOIN generate_series(1, 6) g(step) WHERE key % 5 = 0) l JOIN parts p ON p.key = l.other),
exception AS (SELECT DISTINCT noun || 'en' AS surface, 'noun' AS pos, noun AS base FROM parts),
tree AS (
  SELECT 'O' || o_orderkey AS src, 'C' || o_custkey AS dst FROM orders
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation),
kinds AS (SELECT grp, kind, min(key) AS k FROM parts GROUP BY grp, kind), grps AS (SELECT grp, min(key) AS g FROM parts GROUP BY grp),
wfirst AS (SELECT w.pos, w.id, min(w.id) OVER (PARTITION BY lemma, pos) AS f FROM words w),
edge AS MATERIALIZED (SELECT DISTINCT * FROM (
  SELECT key AS src, k AS dst, '@' AS pointer, 'synset' AS level, 0 AS ord FROM parts JOIN kinds USING (grp, kind)
  UNION ALL SELECT k, g, '@', 'synset', 0 FROM kinds JOIN grps USING (grp)
  UNION ALL SELECT g, (SELECT min(key) FROM parts), '@i', 'synset', 0 FROM grps
  UNION ALL SELECT id, f, CASE pos WHEN 'verb' THEN '@' ELSE '&' END, 'synset', 0 FROM wfirst WHERE pos IN ('adjective', 'verb')
  UNION ALL SELECT id, other, '!', 'word', 1 FROM (SELECT id, lead(id) OVER (PARTITION BY grp ORDER BY id) AS other, row_number() OVER (PARTITION BY grp ORDER BY id) AS n FROM (SELECT DISTINCT grp, id FROM words WHERE pos = 'adjective')) WHERE n % 2 = 1 AND other IS NOT NULL
  UNION ALL SELECT g, key, '%m', 'synset', 0 FROM parts JOIN grps USING (grp) WHERE key % 3 = 0
  UNION ALL SELECT a.id, n.id, '\', 'word', 1 FROM words a JOIN words n ON a.grp = n.grp AND a.key = n.key WHERE a.pos = 'adjective' AND n.pos = 'noun'
  UNION ALL SELECT key, min(key) OVER (PARTITION BY lemma), '+', 'word', 2 FROM parts) WHERE src <> dst),
word_vector AS (SELECT w.word, e.embedding AS vec FROM (SELECT DISTINCT unnest("""
    + _GLOSS_WORDS.format(g="g")
    + """) AS word FROM (SELECT text AS g FROM documents UNION ALL SELECT """
    + _CLEAN.format(g="raw")
    + """ FROM raw UNION ALL SELECT lemma FROM sense)) w CROSS JOIN n_vecs JOIN embeddings e ON e.vec_id = ('0x' || left(md5(w.word), 12))::BIGINT % n_vecs.n)
"""
)
