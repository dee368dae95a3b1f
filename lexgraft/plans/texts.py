"""Entry preparation and gloss functions as queries over the derived entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexgraft.functions import text as T
from lexgraft.plans.rules_sql import stems as _stems
from lexgraft.sources import tables as S

POS = {"noun": "noun", "proper noun": "noun", "measure word": "noun", "verb": "verb", "adjective": "adjective", "adverb": "adverb"}


def per_raw(column):
    """A query that shows one text function over all marked-up glosses."""
    return lambda spark, d: S.raw(spark, d).select("entry_id", column(F.col("raw")).alias("out"))


def joined(column):
    return per_raw(lambda g: F.array_join(column(g), "~"))


def pos_normalise(spark, d) -> DataFrame:
    """Kinds of nouns become noun; other parts of speech and null are dropped."""
    named = S.raw(spark, d).select("entry_id", F.when(F.col("entry_id") % 8 == 0, "proper noun").when(F.col("entry_id") % 8 == 4, "measure word").when(F.col("entry_id") % 8 == 5, "particle").otherwise(F.col("pos")).alias("given"))
    pos = F.create_map(*[F.lit(x) for pair in POS.items() for x in pair])[F.col("given")]
    return named.select("entry_id", pos.alias("pos")).filter("pos IS NOT NULL")


def sense_explode(spark, d) -> DataFrame:
    """A row for each sense of an entry, with its id and label."""
    senses = F.posexplode(T.sub_definitions(F.col("raw"), ";")).alias("n", "gloss")
    rows = S.raw(spark, d).select("entry_id", "lemma", "pos", senses)
    return rows.select(F.concat_ws(":", "lemma", F.concat_ws("-", "entry_id", "n")).alias("id"), F.concat_ws(".", "lemma", F.substring("pos", 1, 1), F.col("n").cast("string")).alias("label"), "gloss")


def gloss_lines(spark, d) -> DataFrame:
    """A raw gloss for each line, in order."""
    docs = S.table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "gloss")).select("doc_id", "line", F.length("gloss").alias("n"), F.md5("gloss").alias("digest"))


def lang_filter(spark, d) -> DataFrame:
    """Entries of one language; the filter reaches the scan."""
    return S.table(spark, d, "documents").filter("lang = 'en'").select("doc_id", "source", "n_chars")


def lemma_normalise(spark, d) -> DataFrame:
    """E5: spaces become underscores, the part of speech capitals."""
    return S.raw(spark, d).select("entry_id", F.replace("lemma", F.lit(" "), F.lit("_")).alias("lemma"), F.upper("pos").alias("pos"))


def entry_dedup(spark, d) -> DataFrame:
    """The least entry for each lemma and part of speech stays."""
    return S.raw(spark, d).groupBy("lemma", "pos").agg(F.min("entry_id").alias("entry_id"))


def combined_gloss(spark, d) -> DataFrame:
    """Cleaned glosses, distinct, in first-seen order, and the ordered map from raw to clean; equal raw ones are one key."""
    raw = F.array_distinct(F.split("raw", ";"))
    cleaned = F.map_from_entries(F.transform(raw, lambda g: F.struct(g, T.clean_gloss(g))))
    rows = S.raw(spark, d).select("entry_id", cleaned.alias("glosses"))
    parts, pairs = F.array_distinct(F.map_values("glosses")), F.transform(F.map_entries("glosses"), lambda e: F.concat_ws(" => ", e["key"], e["value"]))
    return rows.select("entry_id", F.array_join(parts, " ").alias("gloss"), F.size(parts).alias("n"), F.array_join(pairs, " | ").alias("glosses"))


def relations_parse(spark, d) -> DataFrame:
    """Typed links of each entry, as an array and back to rows."""
    links = S.relation(spark, d).groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("target", "type", "target_sense"))).alias("relations"))
    return links.select("entry_id", F.explode_outer("relations").alias("r")).select("entry_id", F.col("r.type").alias("type"), F.col("r.target").alias("target"), F.col("r.target_sense").alias("target_sense"))


def annotation_values(spark, d) -> DataFrame:
    """T5: type and value of the leading templates; of one type the last wins."""
    bodies = S.raw(spark, d).select("entry_id", F.posexplode(T.leading_annotations(F.col("raw"))).alias("n", "body"))
    values = bodies.select("entry_id", "n", T.annotation_value(F.col("body")).alias("v"))
    return values.groupBy("entry_id", F.col("v.type").alias("type")).agg(F.max_by("v.value", "n").alias("value"))


def extended(spark, d) -> DataFrame:
    """A gloss and the lemmas of its synset."""
    lemmas = S.sense(spark, d).groupBy("synset_id").agg(F.array_sort(F.collect_set("lemma")).alias("lemmas"))
    return S.synset(spark, d).join(lemmas, "synset_id").select("synset_id", T.extended_gloss(F.col("gloss"), F.col("lemmas")).alias("gloss"))


def gloss_words(spark, d) -> DataFrame:
    """The words of a gloss."""
    return S.entry(spark, d).select("entry_id", F.array_join(T.gloss_words(F.col("gloss")), " ").alias("words"))


def stopword_filter(spark, d) -> DataFrame:
    """Words of the glosses that are not in the stop list, with their counts."""
    words = S.entry(spark, d).select(F.explode(T.gloss_words(F.col("gloss"))).alias("word"))
    return words.filter(~F.lower("word").isin(*T.STOP)).groupBy("word").agg(F.count("*").alias("n"))


#: Endings that the lemmas get, by part of speech.
SURFACES = {"noun": ("s", "es", "ches", "men", "ies", ""), "verb": ("s", "ies", "es", "ed", "ing", ""), "adjective": ("er", "est", "s", "ier", "", "men"), "adverb": ("s", "er", "", "es", "ing", "men")}


def surfaces(spark, d) -> DataFrame:
    """Inflected forms of lemmas, of several endings; some don't belong to their part of speech."""
    ends = F.create_map(*[x for p, e in SURFACES.items() for x in (F.lit(p), F.array(*map(F.lit, e)))])[F.col("pos")]
    # 24 shapes of six endings each: by the number of the shape alone every one would have a single ending
    end = F.element_at(ends, (F.floor(F.col("entry_id") / 7) % 6 + 1).cast("int"))
    return S.raw(spark, d).select("entry_id", "pos", F.concat("lemma", end).alias("surface"))


def stems(spark, d) -> DataFrame:
    """Base forms by ending and part of speech."""
    return surfaces(spark, d).select("entry_id", F.explode(T.stems(F.col("surface"), F.col("pos"))).alias("stem"))


def compound_stems(spark, d) -> DataFrame:
    """Combinations of the words' stems."""
    return surfaces(spark, d).select("entry_id", F.explode(T.compound_stems(F.col("surface"), F.col("pos"))).alias("stem"))


def lemma_variants(spark, d) -> DataFrame:
    """Spelling variants of a lemma."""
    lemma = F.when(F.col("entry_id") % 3 == 0, F.replace("lemma", F.lit(" "), F.lit("_"))).when(F.col("entry_id") % 3 == 1, F.replace("lemma", F.lit(" "), F.lit("-"))).otherwise(F.col("lemma"))
    return S.raw(spark, d).select("entry_id", F.explode(T.lemma_variants(lemma)).alias("variant"))


def entry_valid(spark, d) -> DataFrame:
    """Entries whose lemma and gloss may be written."""
    return S.entry(spark, d).select("entry_id", T.entry_valid(F.col("lemma"), F.col("gloss")).alias("valid"))


def sub_definitions(spark, d) -> DataFrame:
    """Parts of a gloss in order."""
    rows = S.raw(spark, d).select("entry_id", F.posexplode(T.sub_definitions(F.col("raw"), "[;,]")).alias("n", "part"))
    return rows.select("entry_id", "n", "part")


def vocabulary(spark, d) -> DataFrame:
    """Distinct words of entry and lexicon glosses without stop words."""
    words = lambda df: df.select(F.explode(T.gloss_words(F.col("gloss"))).alias("word"))
    return words(S.entry(spark, d)).unionByName(words(S.synset(spark, d))).filter(~F.lower("word").isin(*T.STOP)).distinct()


def stable_synset_id(spark, d) -> DataFrame:
    """A name for each new synset that later rounds can point to."""
    return S.raw(spark, d).select("entry_id", F.md5(F.concat_ws("|", "pos", "lemma", F.col("entry_id").cast("string"))).alias("synset_id"))


def pointer_counts(spark, d) -> DataFrame:
    """Pointer types of a synset plus its word-level targets."""
    n = F.countDistinct(F.when(F.col("level") == "synset", F.col("pointer"))) + F.count(F.when(F.col("level") == "word", 1))
    return S.edge(spark, d).groupBy("src").agg(n.alias("n"))


def sense_counts(spark, d) -> DataFrame:
    """Senses of a lemma over all parts of speech."""
    return S.sense(spark, d).groupBy("lemma").agg(F.count("*").alias("n"))


def gloss_multimap(spark, d) -> DataFrame:
    """Synsets of a gloss."""
    ids = F.array_sort(F.collect_set("synset_id"))
    return S.synset(spark, d).groupBy("gloss").agg(F.array_join(ids.cast("array<string>"), " ").alias("ids"))


QUERIES = {
    "clean_gloss": per_raw(T.clean_gloss),
    "strip_annotations": per_raw(T.strip_annotations),
    "is_slang": per_raw(T.is_slang),
    "leading_annotations": joined(T.leading_annotations),
    "linked_terms": joined(T.linked_terms),
    "gloss_without_examples": per_raw(T.without_examples),
    "balance_parens": per_raw(T.balance_parens),
    "extended_gloss": extended,
} | {f.__name__: f for f in (pos_normalise, sense_explode, gloss_lines, lang_filter, lemma_normalise, entry_dedup, combined_gloss, relations_parse, annotation_values, gloss_words, stopword_filter, stems, compound_stems, lemma_variants, entry_valid, sub_definitions, vocabulary, stable_synset_id, pointer_counts, sense_counts, gloss_multimap)}


_CLEAN = S._CLEAN
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOP)
_WORDS = r"list_distinct(list_filter(list_transform(string_split_regex(trim({g}), '\s+'), lambda t: regexp_extract(t, '^[[:punct:]]*([^[:punct:]\s]+)[[:punct:]]*$', 1)), lambda t: t <> ''))"
_SURFACES = f"surfaces AS (SELECT entry_id, lemma, pos, lemma || (CASE pos {' '.join(f'WHEN {p!r} THEN {list(e)}' for p, e in SURFACES.items())} END)[(entry_id // 7) % 6 + 1] AS surface FROM raw)"


SQL = {
    "clean_gloss": f"SELECT entry_id, {_CLEAN.format(g='raw')} AS out FROM raw",
    "strip_annotations": r"SELECT entry_id, trim(regexp_replace(raw, '\{\{[^{}]*\}\}', '', 'g')) AS out FROM raw",
    "is_slang": "SELECT entry_id, len(list_filter(regexp_extract_all(raw, '\\{\\{context\\|([^{}]*)\\}\\}', 1), lambda b: list_has_any(string_split(b, '|'), [" + ", ".join(f"'{s}'" for s in T.SLANG) + "]))) > 0 AS out FROM raw",
    "leading_annotations": r"SELECT entry_id, array_to_string(regexp_extract_all(regexp_extract(raw, '^\s*((?:\{\{[^{}]*\}\}\s*)*)', 1), '\{\{([^{}]*)\}\}', 1), '~') AS out FROM raw",
    "linked_terms": r"SELECT entry_id, array_to_string(list_transform(regexp_extract_all(regexp_extract(raw, '((?:\[\[[^\[\]]*\]\]\s*)+)', 1), '\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]', 1), lambda t: regexp_replace(t, '[.,;:!?]+$', '')), '~') AS out FROM raw",
    "gloss_without_examples": """SELECT entry_id, regexp_replace(raw, ';\\s*"[^"]*"', '', 'g') AS out FROM raw""",
    "balance_parens": "SELECT entry_id, repeat('(', greatest((length(raw) - length(replace(raw, ')', ''))) - (length(raw) - length(replace(raw, '(', ''))), 0)) || raw || repeat(')', greatest((length(raw) - length(replace(raw, '(', ''))) - (length(raw) - length(replace(raw, ')', ''))), 0)) AS out FROM raw",
    "extended_gloss": "SELECT s.synset_id, trim(s.gloss || ' ' || l.lemmas) AS gloss FROM synset s JOIN (SELECT synset_id, string_agg(lemma, ' ' ORDER BY lemma) AS lemmas FROM (SELECT DISTINCT synset_id, lemma FROM sense) GROUP BY synset_id) l USING (synset_id)",
    "pos_normalise": "SELECT entry_id, CASE entry_id % 8 WHEN 0 THEN 'noun' WHEN 4 THEN 'noun' ELSE pos END AS pos FROM raw WHERE entry_id % 8 <> 5",
    "sense_explode": r"""WITH p AS (SELECT entry_id, lemma, pos, list_filter(list_transform(string_split(raw, ';'), lambda x: regexp_replace(trim(x), '[.,;:!?]+$', '')), lambda x: x <> '') AS parts FROM raw),
        q AS (SELECT entry_id, lemma, pos, unnest(parts) AS gloss, generate_subscripts(parts, 1) - 1 AS n FROM p)
        SELECT lemma || ':' || entry_id || '-' || n AS id, lemma || '.' || left(pos, 1) || '.' || n AS label, gloss FROM q""",
    "gloss_lines": r"""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), q AS (SELECT doc_id, unnest(parts) AS gloss, (generate_subscripts(parts, 1) - 1)::INTEGER AS line FROM p)
        SELECT doc_id, line, length(gloss)::INTEGER AS n, md5(gloss) AS digest FROM q""",
    "lang_filter": "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en'",
    "lemma_normalise": "SELECT entry_id, replace(lemma, ' ', '_') AS lemma, upper(pos) AS pos FROM raw",
    "entry_dedup": "SELECT lemma, pos, min(entry_id) AS entry_id FROM raw GROUP BY lemma, pos",
    "combined_gloss": f"""WITH r AS (SELECT entry_id, string_split(raw, ';') AS all_parts FROM raw), o AS (SELECT entry_id, list_filter(all_parts, lambda x, i: list_position(all_parts, x) = i) AS raws FROM r),
        p AS (SELECT entry_id, raws, list_transform(raws, lambda g: {_CLEAN.format(g='g')}) AS parts FROM o),
        q AS (SELECT entry_id, raws, parts AS every, list_filter(parts, lambda x, i: list_position(parts, x) = i) AS parts FROM p)
        SELECT entry_id, array_to_string(parts, ' ') AS gloss, len(parts)::INTEGER AS n, array_to_string(list_transform(raws, lambda x, i: x || ' => ' || every[i]), ' | ') AS glosses FROM q""",
    "relations_parse": "SELECT entry_id, type, target, target_sense FROM relation",
    "annotation_values": r"""WITH b AS (SELECT entry_id, regexp_extract_all(regexp_extract(raw, '^\s*((?:\{\{[^{}]*\}\}\s*)*)', 1), '\{\{([^{}]*)\}\}', 1) AS bodies FROM raw),
        u AS (SELECT entry_id, string_split(unnest(bodies), '|') AS args, generate_subscripts(bodies, 1) AS n FROM b),
        v AS (SELECT entry_id, n, args[1] AS type, list_filter(list_slice(args, CASE args[1] WHEN 'surname' THEN 1 WHEN 'form of' THEN 3 ELSE 2 END, len(args)), lambda a: NOT contains(a, '=') AND NOT contains(a, '{'))[1] AS value FROM u)
        SELECT entry_id, type, max_by(value, n) AS value FROM v GROUP BY entry_id, type""",
    "gloss_words": f"""WITH p AS (SELECT entry_id, list_filter(list_transform(string_split_regex(trim(gloss), '\\s+'), lambda t: regexp_extract(t, '^[[:punct:]]*([^[:punct:]\\s]+)[[:punct:]]*$', 1)), lambda t: t <> '') AS w FROM entry)
        SELECT entry_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS words FROM p""",
    "stopword_filter": f"WITH w AS (SELECT unnest({_WORDS.format(g='gloss')}) AS word FROM entry) SELECT word, count(*) AS n FROM w WHERE lower(word) NOT IN ({_STOP}) GROUP BY word",
    "stems": f"WITH {_SURFACES} SELECT entry_id, unnest({_stems('surface')}) AS stem FROM surfaces",
    "compound_stems": f"""WITH {_SURFACES}, p AS (SELECT entry_id, pos, split_part(surface, ' ', 1) AS a, split_part(surface, ' ', 2) AS b FROM surfaces),
        q AS (SELECT entry_id, CASE WHEN len({_stems('a')}) > 0 THEN {_stems('a')} ELSE [a] END AS x, CASE WHEN len({_stems('b')}) > 0 THEN {_stems('b')} ELSE [b] END AS y FROM p),
        r AS (SELECT entry_id, unnest(x) AS x, y FROM q)
        SELECT entry_id, x || ' ' || y AS stem FROM (SELECT entry_id, x, unnest(y) AS y FROM r)""",
    "lemma_variants": """WITH v AS (SELECT entry_id, CASE entry_id % 3 WHEN 0 THEN replace(lemma, ' ', '_') WHEN 1 THEN replace(lemma, ' ', '-') ELSE lemma END AS l FROM raw)
        SELECT entry_id, unnest(CASE WHEN contains(l, '_') THEN [l, replace(l, '_', ' '), replace(l, '_', '-')] WHEN contains(l, '-') THEN [l, replace(l, '-', ' ')] WHEN contains(l, ' ') THEN [l, replace(l, ' ', '-')] ELSE [l] END) AS variant FROM v""",
    "entry_valid": r"SELECT entry_id, regexp_matches(replace(lemma, ' ', '_'), '^[\w''-]+[A-Za-z0-9]$') AND length(lemma) < 47 AND length(gloss) BETWEEN 3 AND 250 AND NOT regexp_matches(gloss, '[^\x00-\x7F]') AS valid FROM entry",
    "sub_definitions": r"""WITH p AS (SELECT entry_id, list_filter(list_transform(string_split_regex(raw, '[;,]'), lambda x: regexp_replace(trim(x), '[.,;:!?]+$', '')), lambda x: x <> '') AS parts FROM raw)
        SELECT entry_id, (generate_subscripts(parts, 1) - 1)::INTEGER AS n, unnest(parts) AS part FROM p""",
    "vocabulary": f"WITH w AS (SELECT unnest({_WORDS.format(g='gloss')}) AS word FROM (SELECT gloss FROM entry UNION ALL SELECT gloss FROM synset)) SELECT DISTINCT word FROM w WHERE lower(word) NOT IN ({_STOP})",
    "stable_synset_id": "SELECT entry_id, md5(pos || '|' || lemma || '|' || entry_id) AS synset_id FROM raw",
    "pointer_counts": "SELECT src, count(DISTINCT CASE WHEN level = 'synset' THEN pointer END) + count(CASE WHEN level = 'word' THEN 1 END) AS n FROM edge GROUP BY src",
    "sense_counts": "SELECT lemma, count(*) AS n FROM sense GROUP BY lemma",
    "gloss_multimap": "SELECT gloss, string_agg(synset_id::VARCHAR, ' ' ORDER BY synset_id) AS ids FROM synset GROUP BY gloss",
}
