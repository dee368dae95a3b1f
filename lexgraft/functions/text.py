"""Gloss and annotation functions: plain Column expressions, no Python in the data path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Template families and what stands for them, slang labels, the stop list, words too general for hypernyms.
JOINED, FIRST = "soplink", ("taxlink", "term", "w", "unsupported", "gloss")
SLANG = ("informal", "euphemistic", "slang", "internet slang", "vulgar", "offensive", "pejorative", "ethnic slug")
STOP = tuple(
    (
        "a about above after again against all am an and any are aren't as at be because been before being below between both but by "
        "can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't "
        "have haven't having he he'd he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is "
        "isn't it it's its itself let's me more most mustn't my myself no nor not of off on once only or other ought our ours ourselves "
        "out over own same shan't she she'd she'll she's should shouldn't so some such than that that's the their theirs them themselves "
        "then there there's these they they'd they'll they're they've this those through to too under until up very was wasn't we we'd "
        "we'll we're we've were weren't what what's when when's where where's which while who who's whom why why's with won't would "
        "wouldn't you you'd you'll you're you've your yours yourself yourselves"
    ).split(" ")
)
SOURCE_TAG = "<ref name=SOED/>"


def clean_gloss(gloss: Column) -> Column:
    """Templates by their family, links to their last part, straight quotes, no source tag, trimmed."""
    g = F.replace(F.regexp_replace(gloss, r"[“”]", '"'), F.lit(SOURCE_TAG), F.lit(""))
    joined = F.regexp_extract_all(g, F.lit(r"\{\{" + JOINED + r"\|[^{}]*\}\}"), F.lit(0))
    g = F.aggregate(joined, g, lambda a, t: F.replace(a, t, F.replace(F.regexp_extract(t, r"\|([^{}]*)\}\}$", 1), F.lit("|"), F.lit(""))))
    g = F.regexp_replace(g, r"\{\{(?:" + "|".join(FIRST) + r")\|([^{}|]*)(?:\|[^{}]*)?\}\}", "$1")
    g = F.regexp_replace(g, r"\{\{non-gloss definition\|([^{}|]*)(?:\|[^{}]*)?\}\}", "$1")
    g = F.regexp_replace(g, r"\{\{[^{}]*\}\}", " ")
    g = F.regexp_replace(g, r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", "$1")
    return F.trim(g)


def strip_annotations(gloss: Column) -> Column:
    return F.trim(F.regexp_replace(gloss, r"\{\{[^{}]*\}\}", ""))


def is_slang(gloss: Column) -> Column:
    bodies = F.regexp_extract_all(gloss, F.lit(r"\{\{context\|([^{}]*)\}\}"), F.lit(1))
    return F.exists(bodies, lambda b: F.arrays_overlap(F.split(b, r"\|"), F.array(*map(F.lit, SLANG))))


def leading_annotations(gloss: Column) -> Column:
    """Bodies of the templates at the very start; an unclosed one ends the run."""
    run = F.regexp_extract(gloss, r"^\s*((?:\{\{[^{}]*\}\}\s*)*)", 1)
    return F.regexp_extract_all(run, F.lit(r"\{\{([^{}]*)\}\}"), F.lit(1))


def annotation_value(body: Column) -> Column:
    """(type, value) of a template's body: its first argument (surname: the type, form of: the second); k=v are passed over."""
    args = F.split(body, r"\|")
    start = F.when(args[0] == "surname", 0).when(args[0] == "form of", 2).otherwise(1)
    rest = F.filter(F.slice(args, start + 1, F.greatest(F.size(args), F.lit(1))), lambda a: ~a.contains("=") & ~a.contains("{"))
    return F.struct(args[0].alias("type"), F.get(rest, F.lit(0)).alias("value"))


def linked_terms(gloss: Column, offset: int = 0) -> Column:
    """The first run of links from an offset on that only white space parts; punctuation at their ends is cut."""
    run = F.regexp_extract(F.substring(gloss, offset + 1, 1 << 30) if offset else gloss, r"((?:\[\[[^\[\]]*\]\]\s*)+)", 1)
    return F.transform(F.regexp_extract_all(run, F.lit(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]"), F.lit(1)), lambda t: F.regexp_replace(t, r"[.,;:!?]+$", ""))


def without_examples(gloss: Column) -> Column:
    return F.regexp_replace(gloss, r';\s*"[^"]*"', "")


def extended_gloss(gloss: Column, lemmas: Column) -> Column:
    """A gloss, then its lemmas, each with a space before it."""
    return F.trim(F.concat(gloss, F.lit(" "), F.array_join(lemmas, " ")))


def gloss_words(gloss: Column) -> Column:
    """Distinct cores of the tokens that are punctuation, letters or digits, punctuation."""
    core = F.transform(F.split(F.trim(gloss), r"\s+"), lambda t: F.regexp_extract(t, r"^\p{Punct}*([^\p{Punct}\s]+)\p{Punct}*$", 1))
    return F.array_distinct(F.filter(core, lambda t: t != ""))


def lemma_variants(lemma: Column) -> Column:
    swap = lambda a, b: F.replace(lemma, F.lit(a), F.lit(b))
    return F.when(lemma.contains("_"), F.array(lemma, swap("_", " "), swap("_", "-"))).when(lemma.contains("-"), F.array(lemma, swap("-", " "))).when(lemma.contains(" "), F.array(lemma, swap(" ", "-"))).otherwise(F.array(lemma))


#: Endings of regular forms and what they stand for, by part of speech; adverbs have none.
ENDINGS = {
    "noun": (("ses", "s"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"), ("s", "")),
    "verb": (("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", "")),
    "adjective": (("er", ""), ("est", ""), ("er", "e"), ("est", "e")),
}


def stems(word: Column, pos: Column) -> Column:
    """Possible base forms of a word by the endings of its part of speech."""
    cut = lambda end, base: F.when(word.endswith(end), F.concat(word.substr(F.lit(1), F.length(word) - len(end)), F.lit(base)))
    forms = F.array().cast("array<string>")
    for p, rules in ENDINGS.items():
        forms = F.when(pos == p, F.array(*(cut(*r) for r in rules))).otherwise(forms)
    return F.array_distinct(F.filter(forms, lambda f: f.isNotNull() & (F.length(f) > 0)))


def compound_stems(lemma: Column, pos: Column) -> Column:
    """All combinations of the words' stems; a word without stems stands for itself."""
    def step(acc: Column, options: Column) -> Column:
        return F.flatten(F.transform(acc, lambda a: F.transform(options, lambda o: F.when(a == "", o).otherwise(F.concat_ws(" ", a, o)))))

    options = F.transform(F.split(lemma, " "), lambda w: F.when(F.size(stems(w, pos)) > 0, stems(w, pos)).otherwise(F.array(w)))
    return F.aggregate(options, F.array(F.lit("")), step)


def balance_parens(gloss: Column) -> Column:
    count = lambda c: F.length(gloss) - F.length(F.replace(gloss, F.lit(c), F.lit("")))
    missing = count(")") - count("(")
    return F.concat(F.repeat(F.lit("("), F.greatest(missing, F.lit(0))), gloss, F.repeat(F.lit(")"), F.greatest(-missing, F.lit(0))))


#: Letters, digits, underscores, hyphens and apostrophes, at the end a letter or digit.
LEMMA = r"^[\w'-]+[A-Za-z0-9]$"


def valid_lemma(lemma: Column) -> Column:
    """Of the characters of LEMMA, spaces counting as underscores; shorter than 47."""
    return F.replace(lemma, F.lit(" "), F.lit("_")).rlike(LEMMA) & (F.length(lemma) < 47)


def entry_valid(lemma: Column, gloss: Column, exempt: Column | None = None) -> Column:
    """Whether an entry may be written; merged and lexicalised ones (exempt) need no gloss of 3 to 250 ASCII characters."""
    fits = F.length(gloss).between(3, 250) & ~gloss.rlike(r"[^\x00-\x7F]")
    return valid_lemma(lemma) & (fits if exempt is None else fits | exempt)


def following(text: Column) -> Column:
    """The words up to clause punctuation."""
    return F.filter(F.split(F.regexp_extract(text, r"^([^,.;:]*)", 1), " "), lambda w: w != "")


def noun_ngrams(words: Column) -> Column:
    """From a term with up to two words after it: the longer terms first, then later words, then the first."""
    n = F.size(words)
    gram = lambda i, k: F.when(n >= i + k - 1, F.array_join(F.slice(words, i, k), " "))
    return F.array_distinct(F.filter(F.array(gram(1, 3), gram(1, 2), gram(3, 1), gram(2, 1), gram(1, 1)), lambda g: g.isNotNull()))


def adjective_ngrams(words: Column) -> Column:
    """Three words, two pairs, then the words without stop words."""
    n = F.size(words)
    gram = lambda i, k: F.when(n >= i + k - 1, F.array_join(F.slice(words, i, k), " "))
    return F.array_distinct(F.filter(F.array(gram(1, 3), gram(1, 2), gram(2, 2), gram(1, 1), gram(2, 1), gram(3, 1)), lambda g: g.isNotNull() & ~g.isin(*STOP)))


def sub_definitions(gloss: Column, by: str) -> Column:
    parts = F.transform(F.split(gloss, by), lambda p: F.regexp_replace(F.trim(p), r"[.,;:!?]+$", ""))
    return F.filter(parts, lambda p: p != "")
