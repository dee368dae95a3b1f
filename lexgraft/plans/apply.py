"""Bringing accepted proposals into the lexicon: routes, caps, quotas, slots, edges, spellings, rendered lines, the next version."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexgraft.functions import text as T
from lexgraft.operators import lookup, quota, similarity
from lexgraft.plans import rules as R
from lexgraft.sources import files
from lexgraft.sources import tables as S

# Symbols of pointers; hypernyms and merges have none. Limits of a lemma, a synset and a file.
SYMBOLS = {"antonym": "!", "pertainym": "\\", "derived": "\\", "similar to": "&", "member meronym": "%m", "part meronym": "%p", "domain topic": ";c", "derivationally related": "+"}
SENSES, POINTERS, SLOTS = 99, 500, 15
SET_VALUED = ("member meronym", "part meronym", "domain topic")
NEW = 4_000_000_000_000


def routed(ops: DataFrame, sense: DataFrame) -> DataFrame:
    """(entry_id, lemma, pos, gloss, route) for each matched entry."""
    flags = ops.groupBy("entry_id", "lemma", "pos", "gloss").agg(*(F.max(F.col("op") == op).alias(name) for op, name in (("lexicalise", "lex"), ("merge", "merged"), ("hypernym", "under"))))
    counts = sense.groupBy("lemma").agg(F.count("*").alias("senses"))
    met = flags.join(counts, "lemma", "left")
    bad = ~T.entry_valid(F.col("lemma"), F.col("gloss"), F.col("merged") | F.col("lex")) | (F.coalesce("senses", F.lit(0)) > SENSES)
    route = F.when(bad, "drop").when(F.col("lex"), "exception").when(F.col("merged"), "merge").when(F.col("pos").isin("adjective", "adverb"), "modifier").when(F.col("under"), "new synset")
    return met.select("entry_id", "lemma", "pos", "gloss", F.coalesce(route, F.raise_error(F.lit("a noun or verb without a hypernym")).cast("string")).alias("route"))


def capped(rows: DataFrame, sense: DataFrame) -> DataFrame:
    """rows (entry_id, lemma, ..) while a lemma has at most SENSES senses before the new one, old and added."""
    base = sense.groupBy("lemma").agg(F.count("*").alias("base"))
    rank = F.row_number().over(Window.partitionBy("lemma").orderBy("entry_id"))
    # no lemma has room for more, so a crowded one is cut before it is shuffled
    return rows.withColumn("rn", rank).filter(F.col("rn") <= SENSES + 1).join(base, "lemma", "left").filter(F.coalesce("base", F.lit(0)) + F.col("rn") - 1 <= SENSES).drop("base", "rn")


def pointers(edge: DataFrame) -> DataFrame:
    """(target, base): pointer types of a synset and its word-level targets."""
    n = F.count_distinct(F.when(F.col("level") == "synset", F.col("pointer"))) + F.count(F.when(F.col("level") == "word", 1))
    return edge.groupBy(F.col("src").alias("target")).agg(n.alias("base"))


def slotted(rows: DataFrame, sense: DataFrame) -> DataFrame:
    """rows (entry_id, lemma, pos, ..) with slot and file_id: the free numbers of a lemma's file, in the order of entries."""
    own = Window.partitionBy(F.lower("lemma"), "pos").orderBy("entry_id")
    numbered = rows.withColumn("low", F.lower("lemma")).withColumn("rn", F.row_number().over(own))
    names = numbered.select("low", "pos").distinct()
    free = names.withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(SLOTS))))
    used = sense.select(F.lower("lemma").alias("low"), "pos", F.col("sense_rank").alias("slot")).distinct()
    free = free.join(used, ["low", "pos", "slot"], "left_anti").withColumn("rn", F.row_number().over(Window.partitionBy("low", "pos").orderBy("slot")))
    mark = F.when(F.col("lemma").rlike("[0-9]$"), '"').otherwise("")
    return numbered.join(free, ["low", "pos", "rn"]).drop("low", "rn").withColumn("file_id", F.concat(F.replace("lemma", F.lit(" "), F.lit("_")), mark, F.col("slot").cast("string")))


class Applied:
    """What becomes of the operations of a round (entry_id, rule, op, target, how, score) on a lexicon x."""

    def __init__(self, x: R.Lexicon, accepted: DataFrame):
        self.x, self.accepted = x, accepted

    @cached_property
    def ops(self) -> DataFrame:
        """The accepted operations with their entries: entry_id, lemma, pos, raw, gloss, rule, op, target, how, score."""
        return files.kept(self.accepted.join(self.x.entries, "entry_id"))

    @cached_property
    def where(self) -> DataFrame:
        return files.kept(routed(self.ops, self.x.sense))

    @cached_property
    def merges(self) -> DataFrame:
        """(target, lemma, entry_id): one entry for each synset and lemma."""
        rows = self.ops.filter("op = 'merge'").join(self.where.filter("route = 'merge'").select("entry_id"), "entry_id", "left_semi")
        return rows.groupBy("target", "lemma").agg(F.min("entry_id").alias("entry_id"))

    @cached_property
    def merged(self) -> DataFrame:
        """(synset_id, lemma): lemmas that a merge adds to a synset, unless it holds them."""
        return self.merges.select(F.col("target").alias("synset_id"), "lemma").join(self.x.sense, ["synset_id", "lemma"], "left_anti")

    @cached_property
    def links(self) -> DataFrame:
        """(entry_id, symbol, target) of accepted operations and of the domains of matched entries, before quotas."""
        domains = R.domain_links(self.x).select("entry_id", F.lit("domain topic").alias("op"), "target")
        rows = self.accepted.select("entry_id", "op", "target")
        rows = rows.unionByName(domains.join(rows.select("entry_id").distinct(), "entry_id", "left_semi"))
        symbol = F.create_map(*[F.lit(v) for p in SYMBOLS.items() for v in p])[F.col("op")]
        return files.kept(rows.select("entry_id", symbol.alias("symbol"), "target").filter("symbol IS NOT NULL AND target IS NOT NULL").distinct())

    @cached_property
    def fitting(self) -> DataFrame:
        """Entries of new synsets while their lemmas have room."""
        return files.kept(capped(self.where.filter("route = 'new synset'"), self.x.sense))

    @cached_property
    def edges(self) -> DataFrame:
        """(entry_id, symbol, target): pointers of new synsets that their targets have room for; a hypernym's symbol is @.

        Nouns and verbs come before modifiers, then entries in order, each with its hypernym first. An entry whose
        hypernym is full takes nothing. A related synset with a lemma of too many senses gets no pointer.
        """
        under = self.accepted.filter("op = 'hypernym'").groupBy("entry_id").agg(F.min("target").alias("target")).join(self.fitting.select("entry_id"), "entry_id", "left_semi")
        crowded = self.x.sense.groupBy("lemma").agg(F.count("*").alias("n")).filter(F.col("n") > SENSES).join(self.x.sense, "lemma").select(F.col("synset_id").alias("target")).distinct()
        place = under.select("entry_id", F.lit(0).alias("place")).union(self.where.filter("route = 'modifier'").select("entry_id", F.lit(1)))
        related = self.links.join(place, "entry_id").join(crowded, "target", "left_anti")
        row = lambda df, seq, symbol, needed: df.select(F.col("entry_id").alias("owner"), "place", F.lit(seq).alias("seq"), symbol.alias("symbol"), "target", F.lit(needed).alias("needed"))
        every = row(under.withColumn("place", F.lit(0)), 0, F.lit("@"), True).unionByName(row(related, 1, F.col("symbol"), False))
        return quota.allocate(every, pointers(self.x.edge), POINTERS).select(F.col("owner").alias("entry_id"), "symbol", "target")

    @cached_property
    def under(self) -> DataFrame:
        """(entry_id, lemma, pos, gloss, target): new nouns and verbs that their hypernyms have room for."""
        return self.fitting.drop("route").join(self.edges.filter("symbol = '@'").select("entry_id", "target"), "entry_id")

    @cached_property
    def new(self) -> DataFrame:
        return files.kept(slotted(self.under, self.x.sense))

    @cached_property
    def modifiers(self) -> DataFrame:
        return self.where.filter("route = 'modifier'").select("entry_id", "lemma", "pos", "gloss")

    @cached_property
    def related(self) -> DataFrame:
        return self.edges.filter("symbol <> '@'")

    @cached_property
    def exceptions(self) -> DataFrame:
        """(surface, pos, base) of accepted spellings of which the lexicon knows one side; that one is the base.

        Bases of odd characters, and those that the surface's endings lead to, are left out.
        """
        value = self.spellings.join(self.where.filter("route = 'exception'").select("entry_id", "lemma", "pos"), "entry_id")
        pairs = value.select("pos", F.replace("lemma", F.lit(" "), F.lit("_")).alias("surface"), F.col("word").alias("base")).distinct()
        pairs = pairs.filter(F.col("base").rlike(T.LEMMA) & (F.length("base") < 47) & ~F.array_contains(T.stems(F.col("surface"), F.col("pos")), F.col("base")))
        side = lambda name: lookup.known(pairs.select(F.concat_ws("|", "pos", name).alias("key_id"), "pos", F.replace(name, F.lit("_"), F.lit(" ")).alias("lemma")).distinct(), self.x.sense, self.x.exception).withColumn(f"{name}_known", F.lit(True))
        for name in ("surface", "base"):
            pairs = pairs.withColumn("key_id", F.concat_ws("|", "pos", name)).join(side(name), "key_id", "left").drop("key_id").fillna(False, f"{name}_known")
        one = pairs.filter("surface_known <> base_known")
        flip = lambda a, b: F.when(F.col("base_known"), F.col(a)).otherwise(F.col(b))
        return one.select(flip("surface", "base").alias("surface"), "pos", flip("base", "surface").alias("base")).distinct()

    @cached_property
    def spellings(self) -> DataFrame:
        """(entry_id, word): the words whose spellings accepted operations are."""
        return self.accepted.filter("op = 'lexicalise'").select("entry_id", F.col("how").alias("word"))

    def delta(self) -> dict[str, DataFrame]:
        """The rows that this round adds to the tables of the lexicon, the texts that none of its glosses was before, and the
        entries that it has matched."""
        made = self.new.select("entry_id", "lemma", "pos", "gloss").unionByName(self.modifiers).withColumn("synset_id", F.col("entry_id") + NEW)
        merged = self.merged.join(self.x.glossed.select("synset_id", "pos"), "synset_id").select("lemma", "pos", "synset_id")
        fresh = made.select("lemma", "pos", "synset_id").union(merged).distinct().join(self.x.sense, ["lemma", "pos", "synset_id"], "left_anti")
        last = self.x.sense.groupBy("lemma", "pos").agg(F.max("sense_rank").alias("last"))
        place = F.row_number().over(Window.partitionBy("lemma", "pos").orderBy("synset_id"))
        rank = (F.coalesce("last", F.lit(0)) + place).cast("int").alias("sense_rank")
        word = F.col("symbol").isin("!", "\\", "+")
        edges = self.edges.join(made.select("entry_id", "synset_id"), "entry_id")
        edges = edges.select(F.col("synset_id").alias("src"), F.col("target").alias("dst"), F.col("symbol").alias("pointer"), F.when(word, "word").otherwise("synset").alias("level"), word.cast("int").alias("ord"))
        return {
            "synset": made.select("synset_id", "pos", similarity.digest("gloss").alias("digest")),
            "text": made.select(similarity.digest("gloss").alias("digest"), "gloss").dropDuplicates(["digest"]).join(self.x.gloss_texts.select("digest"), "digest", "left_anti"),
            "sense": fresh.join(last, ["lemma", "pos"], "left").select("lemma", "pos", "synset_id", rank),
            "edge": edges.join(self.x.edge, edges.columns, "left_anti"),
            "exception": self.exceptions.join(self.x.exception, ["surface", "pos", "base"], "left_anti"),
            "matched": self.where.select("entry_id", "route"),
        }


def applied(spark, d) -> Applied:
    return R.made(spark, d, "accepted", Applied)


def route_by_operation(spark, d) -> DataFrame:
    """Where the accepted operations of an entry go; a noun or verb that has nothing to hang on is an error."""
    return applied(spark, d).where.select("entry_id", "route")


def merge_dedup(spark, d) -> DataFrame:
    """One entry for each synset and lemma."""
    return applied(spark, d).merges


def sense_cap(spark, d) -> DataFrame:
    """Entries of new synsets while their lemmas have room."""
    return applied(spark, d).fitting.select("entry_id", "lemma")


def pointer_cap(spark, d) -> DataFrame:
    """I4: pointers of new synsets, hypernyms and others, while their targets have room, base pointers counted."""
    return applied(spark, d).edges


def lemma_slot(spark, d) -> DataFrame:
    """File ids of new nouns and verbs; numbers that the lexicon uses are passed over."""
    a = applied(spark, d)
    return slotted(a.where.filter("route = 'new synset'"), a.x.sense).select("entry_id", "file_id")


def relation_edges(spark, d) -> DataFrame:
    """Operations as pointers; hypernyms and merges have no symbol."""
    return applied(spark, d).links


def joined(links: DataFrame) -> DataFrame:
    return links.groupBy("entry_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(",", F.col("target").cast("string"), "symbol"))), " ").alias("links"))


def attach_new_synset(spark, d) -> DataFrame:
    """New noun and verb synsets under their hypernyms after I3, I4 and I5, with the pointers of I6 that found room."""
    a = applied(spark, d)
    return a.new.join(joined(a.related), "entry_id", "left").select("entry_id", "target", "file_id", F.coalesce("links", F.lit("")).alias("links"))


def attach_modifier(spark, d) -> DataFrame:
    """I8: new adjective and adverb synsets with relation pointers only; without any they are written all the same."""
    a = applied(spark, d)
    return a.modifiers.join(a.related, "entry_id", "left").select("entry_id", "lemma", "pos", "symbol", "target")


def merge_lemmas(spark, d) -> DataFrame:
    """Lemmas that a merge adds to a synset, unless it holds them."""
    return applied(spark, d).merged


def new_synset_lines(spark, d) -> DataFrame:
    """K3: a line for each new noun or verb: file id, hypernym, other pointers, gloss, frames of verbs."""
    rows = attach_new_synset(spark, d).join(applied(spark, d).x.entries.select("entry_id", "pos", "gloss"), "entry_id")
    frames = F.when(F.col("pos") == "verb", " frames: 1, 2").otherwise("")
    links = F.when(F.col("links") == "", "").otherwise(F.concat(F.lit(" "), "links"))
    return rows.select("entry_id", F.concat(F.lit("{ "), "file_id", F.lit(" "), F.col("target").cast("string"), F.lit(",@"), links, frames, F.lit(" ("), T.balance_parens(F.col("gloss")), F.lit(") }")).alias("line"))


def new_modifier_lines(spark, d) -> DataFrame:
    """K4: lines of new modifiers: lemma, pointers, gloss, no hypernym."""
    a = applied(spark, d)
    rows = a.modifiers.join(joined(a.related), "entry_id", "left")
    return rows.select("entry_id", F.concat(F.lit("{ "), F.replace("lemma", F.lit(" "), F.lit("_")), F.lit(" "), F.coalesce("links", F.lit("")), F.lit(" ("), T.balance_parens(F.col("gloss")), F.lit(") }")).alias("line"))


def exception_pairs(spark, d) -> DataFrame:
    """Irregular forms of accepted spellings."""
    return applied(spark, d).exceptions


def exceptions_out(spark, d) -> DataFrame:
    """K5: old and new irregular forms, written as sorted lines in a folder for each part of speech and read back."""
    a, path = applied(spark, d), files.scratch(spark)
    files.write_exceptions(a.x.exception.unionByName(a.exceptions), path)
    return spark.read.text(path).select("pos", F.col("value").alias("line"))


def stable(pos: str = "pos") -> F.Column:
    return F.md5(F.concat_ws("|", pos, "lemma", F.col("entry_id").cast("string")))


def enriched_lexicon(spark, d) -> DataFrame:
    """K6: the senses of the next version by round: those of the lexicon, merged lemmas, new synsets by stable names."""
    a = applied(spark, d)
    old = a.x.sense.select("lemma", "pos", F.col("synset_id").cast("string").alias("synset"), F.lit(0).alias("round"))
    merged = a.merged.join(a.x.glossed.select("synset_id", "pos"), "synset_id").select("lemma", "pos", F.col("synset_id").cast("string").alias("synset"), F.lit(1).alias("round"))
    new = a.new.select("entry_id", "lemma", "pos").unionByName(a.modifiers.select("entry_id", "lemma", "pos"))
    return old.unionByName(merged).unionByName(new.select("lemma", "pos", stable().alias("synset"), F.lit(1).alias("round")))


def operations_log(spark, d) -> DataFrame:
    """K2: nine columns for an operation on a synset, six for one on a text, tab separated."""
    a = applied(spark, d)
    x = a.x
    ops = a.ops
    # lemmas and glosses of the targets only; a gloss is found by the document, so that no other is shuffled
    wanted = files.kept(ops.filter("target IS NOT NULL").select(F.col("target").alias("synset_id")).distinct())
    lemmas = x.sense.join(wanted, "synset_id", "left_semi").groupBy(F.col("synset_id").alias("target")).agg(F.array_join(F.array_sort(F.collect_set("lemma")), ",").alias("lemmas"))
    glosses = S.synset(spark, d, x.sense.join(wanted, "synset_id", "left_semi"))
    texts = glosses.select(F.col("synset_id").alias("target"), F.col("gloss").alias("other")).join(lemmas, "target")
    reason = F.concat(F.lit('{"rule":'), F.col("rule").cast("string"), F.lit(',"heuristic":"'), "how", F.lit('"}'))
    nine = ops.join(texts, "target").select("entry_id", F.concat_ws("\t", "lemma", "pos", F.col("entry_id").cast("string"), "gloss", "op", F.col("target").cast("string"), "lemmas", "other", reason).alias("line"))
    six = ops.filter("target IS NULL").withColumn("word", F.col("how")).select("entry_id", F.concat_ws("\t", "lemma", "pos", F.col("entry_id").cast("string"), "gloss", "op", "word").alias("line"))
    return nine.unionByName(six)


#: Why an operation was proposed; the score has six places.
def reason() -> F.Column:
    score = F.col("score").cast("decimal(9,6)").cast("string")
    return F.create_map(F.lit("heuristic"), F.col("how"), F.lit("rule"), F.col("rule").cast("string"), F.lit("score"), score)


def proposal_record(spark, d) -> DataFrame:
    """C4: operations of an entry over all rules, with their reasons; of single-valued ones the last rule's stands, set-valued ones add up."""
    rows = R.proposals(spark, d)
    last = F.row_number().over(Window.partitionBy("entry_id", "op").orderBy(F.desc("rule"), F.desc_nulls_last("target")))
    one = rows.filter(~F.col("op").isin(*SET_VALUED)).withColumn("rn", last).filter("rn = 1").drop("rn")
    return one.unionByName(rows.filter(F.col("op").isin(*SET_VALUED))).select("entry_id", "op", "target", F.to_json(reason()).alias("reason"))


def remaining_entries(spark, d) -> DataFrame:
    """Entries that no rule has a proposal for, whatever the sink does with the others."""
    return R.made(spark, d, "lexicon").entries.join(R.first_match(spark, d), "entry_id", "left_anti").select("entry_id", "lemma")


def augment_after_match(spark, d) -> DataFrame:
    """Domain links of matched entries only."""
    return R.domain_links(R.made(spark, d, "lexicon")).join(R.first_match(spark, d), "entry_id", "left_semi")


def operation_counts(spark, d) -> DataFrame:
    """A5: how often each rule's operation was accepted, most frequent first."""
    return R.first_match(spark, d).groupBy("rule", "op").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule", "op")


def round_stats(spark, d) -> DataFrame:
    """Entries, those with an accepted proposal, those that are written."""
    a = applied(spark, d)
    written = a.new.select("entry_id").union(a.modifiers.select("entry_id")).union(a.merges.select("entry_id"))
    tentative = a.accepted.agg(F.count_distinct("entry_id")).scalar()
    return a.x.entries.agg(F.count("*").alias("processed")).withColumn("tentative", tentative).withColumn("final", written.agg(F.count_distinct("entry_id")).scalar())


def vote_ties(spark, d) -> DataFrame:
    """A3: the synset that an entry's synonyms vote for, by votes or, among equals, by similarity."""
    one = R.made(spark, d, "round")
    return one.voted(one.of(2), True).select("entry_id", "synset_id", "n", "ties", "how")


def candidate_multimap(spark, d) -> DataFrame:
    """A10: the rules that name a lemma for an entry, joined with commas."""
    named = R.made(spark, d, "round").named.select("entry_id", "rule", F.col("word").alias("lemma"), F.concat_ws(":", F.col("rule").cast("string"), "kind").alias("by"))
    named = R.made(spark, d, "lexicon").spread(named)
    return named.groupBy("entry_id", "lemma").agg(F.array_join(F.array_sort(F.collect_set("by")), ",").alias("by"))


def noun_ngram_candidates(spark, d) -> DataFrame:
    """Terms from a matching noun on, longer ones first, as far as the lexicon has nouns."""
    return known_terms(spark, d, (10, 13))


def adj_noun_candidates(spark, d) -> DataFrame:
    """Terms after of or relating to, longer ones first, as far as the lexicon has nouns."""
    return known_terms(spark, d, (15,))


def known_terms(spark, d, numbers: tuple[int, ...]) -> DataFrame:
    named = R.made(spark, d, "round").named.filter(F.col("rule").isin(*numbers))
    return R.made(spark, d, "lexicon").spread(named).join(R.made(spark, d, "lexicon").sense.filter("pos = 'noun'").select(F.col("lemma").alias("word")), "word", "left_semi").select("entry_id", "rule", "kind", "ord", F.col("word").alias("lemma"))


def organism_member(spark, d) -> DataFrame:
    """Of a genus the first member meronym under the root, and that one's first hypernym."""
    return R.made(spark, d, "round").members()


def near_duplicate_guard(spark, d) -> DataFrame:
    """Candidates that are no sense of the entry's lemma, nor within two hops of one."""
    one = R.made(spark, d, "round")
    pairs = one.free(one.found.select("entry_id", "rule", "synset_id").distinct()).select("entry_id", "rule", "synset_id")
    return one.x.spread(pairs).select("entry_id", "synset_id").distinct()


def person_closure(spark, d) -> DataFrame:
    """Lemmas whose first sense is a person, and those that always are."""
    x = R.made(spark, d, "lexicon")
    return R.person_data(x)[1].union(spark.createDataFrame([(w,) for w in R.ALWAYS_PERSON], "lemma string")).distinct()


def bounded_closure(spark, d) -> DataFrame:
    """Lemmas of first senses up to three levels under the root, with the greatest depth."""
    x = R.made(spark, d, "lexicon")
    return x.rooted.join(x.sense.filter("sense_rank = 1 AND pos = 'noun'"), "synset_id").select("lemma", "synset_id", "depth")


def read_lexicon_lines(spark, d) -> DataFrame:
    """Rendered lines written as text and read back: file id, lemma, number of pointers, gloss."""
    path = files.scratch(spark)
    new_synset_lines(spark, d).select("line").write.text(path)
    id_ = F.regexp_extract("value", r"^\{ (\S+) ", 1)
    return spark.read.text(path).select(id_.alias("file_id"), F.regexp_replace(id_, '"?[0-9]+$', "").alias("lemma"), F.regexp_count("value", F.lit(r" [0-9]+,\S")).alias("links"), F.regexp_extract("value", r" \((.*)\) \}$", 1).alias("gloss"))


QUERIES = {f.__name__: f for f in (route_by_operation, merge_dedup, sense_cap, pointer_cap, lemma_slot, relation_edges, attach_new_synset, attach_modifier, merge_lemmas, new_synset_lines, new_modifier_lines, enriched_lexicon, operations_log, proposal_record, remaining_entries, augment_after_match, operation_counts, round_stats, vote_ties, candidate_multimap, noun_ngram_candidates, adj_noun_candidates, organism_member, near_duplicate_guard, person_closure, bounded_closure, read_lexicon_lines, exception_pairs, exceptions_out)}

from lexgraft.plans.apply_sql import SQL  # noqa: E402
