import re

from lexgraft.functions import text as T
from lexgraft.operators import graph, lookup, similarity
from pyspark.sql import functions as F


def shown(spark, function, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, g string")
    return [r.out for r in df.select("i", function(F.col("g")).alias("out")).orderBy("i").collect()]


def test_glosses_literally(spark):
    texts = ["{{soplink|a|b}} x", "[[a|b]] and [[c]]", "{{term|word|lang=en}} {{other|z}}", "“q”", "open {{", "", None, "{{non-gloss definition|used to}}"]
    assert shown(spark, T.clean_gloss, texts) == ["ab x", "b and c", "word", '"q"', "open {{", "", None, "used to"]
    assert shown(spark, T.strip_annotations, ["{{a}} b {{c}}", "{{a"]) == ["b", "{{a"]
    assert shown(spark, T.leading_annotations, ["{{a|b}} {{c}} d {{e}}", "x {{a}}", "{{open"]) == [["a|b", "c"], [], []]
    assert shown(spark, T.is_slang, ["{{context|slang|lang=en}} x", "{{context|rare}}", "slang"]) == [True, False, False]
    assert shown(spark, T.is_slang, ["{{context|informal}}", "{{context|US|ethnic slug}}", "{{context|obscene}}"]) == [True, True, False]
    assert shown(spark, T.clean_gloss, ["{{soplink|a|b|c|d}}<ref name=SOED/> x"]) == ["abcd x"]
    assert shown(spark, T.linked_terms, ["see [[a]] [[b|c,]] or [[d]]", "none"]) == [["a", "c"], []]
    assert shown(spark, T.balance_parens, ["(a", "a))", "ok"]) == ["(a)", "((a))", "ok"]
    assert shown(spark, T.without_examples, ['a; "b c"; d']) == ["a; d"]
    assert shown(spark, T.gloss_words, ["(One) two-three, one One  é"]) == [["One", "one", "é"]]
    stems = lambda pos: lambda g: T.stems(g, F.lit(pos))
    assert shown(spark, stems("noun"), ["boxes", "men", "flies", "s", "glass", "baking"]) == [["box", "boxe"], ["man"], ["fly", "flie"], [], ["glas"], []]
    assert shown(spark, stems("verb"), ["baked", "tries", "going", "men", "s"]) == [["bake", "bak"], ["trie", "try", "tri"], ["goe", "go"], [], []]
    assert shown(spark, stems("adjective"), ["finer", "tallest", "boxes", None]) == [["fin", "fine"], ["tall", "talle"], [], []]
    assert shown(spark, stems("adverb"), ["faster", "boxes"]) == [[], []]
    assert shown(spark, lambda g: T.compound_stems(g, F.lit("verb")), ["takes offed", "x y"]) == [["take offe", "take off", "tak offe", "tak off"], ["x y"]]
    assert shown(spark, T.lemma_variants, ["a_b", "a-b", "a b", "ab"]) == [["a_b", "a b", "a-b"], ["a-b", "a b"], ["a b", "a-b"], ["ab"]]
    valid = lambda g: T.entry_valid(F.lit("x" * 46), g)
    assert shown(spark, valid, ["ab", "abc", "a" * 250, "a" * 251, "aé "]) == [False, True, True, False, False]


def test_closure_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    start = spark.createDataFrame([("a",), ("d",)], "root string")
    got = {(r.root, r.node): r.hops for r in graph.closure(start, edges).collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 2, ("a", "d"): 3, ("d", "d"): 0}
    assert graph.closure(start, edges, 1).count() == 3


def test_first_sense_falls_back(spark):
    sense = spark.createDataFrame([("box", "noun", 7, 1), ("box", "noun", 9, 2), ("mouse", "noun", 3, 1)], "lemma string, pos string, synset_id long, sense_rank int")
    odd = spark.createDataFrame([("mice", "noun", "mouse")], "surface string, pos string, base string")
    keys = spark.createDataFrame([(1, "box", "noun"), (2, "boxes", "noun"), (3, "mice", "noun"), (4, "none", "noun")], "key_id long, lemma string, pos string")
    assert {r.key_id: r.synset_id for r in lookup.first_sense(keys, sense, odd).collect()} == {1: 7, 2: 7, 3: 3}


def test_tiling():
    assert similarity.tiling("abcdef", "xxabcdefyy", 3) == 1.0
    assert similarity.tiling("abcxyz", "xyzabc", 3) == 1.0
    assert similarity.tiling("abcd", "abxcd", 3) == 0.0
    assert similarity.tiling("", "a", 3) == 0.0
    import random

    def plain(a, b, least):  # every pair of places, again and again
        free_a, free_b, marked = [True] * len(a), [True] * len(b), 0
        while True:
            top, found = least - 1, None
            for i in range(len(a)):
                for j in range(len(b)):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                        n += 1
                    if n > top:
                        top, found = n, (i, j)
            if found is None:
                return marked / len(a)
            i, j = found
            free_a[i : i + top], free_b[j : j + top] = [False] * top, [False] * top
            marked += top

    pick = random.Random(1)
    for _ in range(200):
        a, b = ("".join(pick.choices("ab", k=pick.randint(1, 25))) for _ in range(2))
        assert similarity.tiling(a, b, 3) == plain(a, b, 3)


def test_sums_of_hashed_vectors_shuffle_no_vector(spark):
    import numpy as np

    pick = np.random.default_rng(3)
    table = [(i, pick.normal(size=4).tolist()) for i in range(9)] + [(9, [0.0] * 4), (3, [1.0, 0.0, 0.0, 0.0]), (10, None), (11, [1.0, None, 0.0, 0.0]), (12, [1.0])]
    units = spark.createDataFrame(table, "vec_id long, vec array<double>")
    texts = spark.createDataFrame([(i, " ".join(f"w{j}" for j in pick.integers(0, 16, 12))) for i in range(40)] + [(40, None), (41, ""), (42, "w9 w15")], "id int, gloss string")
    unit = {}
    for i, v in table:
        if v and len(v) == 4 and None not in v and any(v):
            unit[i] = unit.get(i, 0) + np.array(v) / np.linalg.norm(v)
    want = {}
    for r in texts.collect():
        known = [unit[k] for k in {int(w[1:]) for w in (r.gloss or "").split()} if k in unit]
        if known:
            want[r.id] = np.sum(known, axis=0)
    place = lambda w: F.substring(w, 2, 9).cast("long")
    for limit in (100, 4):  # at once, and in parts
        df = similarity.HashVectors(units, place, 4, limit).of(texts, "id")
        got = {r.id: r for r in df.collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k].vec, want[k], atol=1e-12) and abs(got[k].norm - np.linalg.norm(want[k])) < 1e-9 for k in want)
        if limit == 100:
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_texts_without_a_run_of_the_left_ones_are_not_shuffled(spark, monkeypatch):
    rows, real = [], similarity.kept
    monkeypatch.setattr(similarity, "kept", lambda df: rows.append(df.count()) or real(df))
    left = spark.createDataFrame([(1, "The quick brown fox jumps"), (2, "two words"), (3, None), (4, "")], "id long, text string")
    texts = ["a QUICK  brown fox jumped", "quick brown dog", "Two words", "two words more", "", None, "brown fox jumps\tover", " the quick brown "]
    right = spark.createDataFrame(list(enumerate([*texts, *(f"other {k} words here" for k in range(200))])), "id long, text string")
    got = {(r.left_id, r.right_id): r.score for r in similarity.tiling_pairs(left, right).collect()}
    split = lambda t: re.split(r"\s+", t.lower())
    runs = lambda t: {" ".join(w[i : i + 3]) for w in [split(t)] for i in range(max(1, len(w) - 2))}
    want = {(a.id, b.id): similarity.tiling(a.text, b.text, 5) for a in left.collect() for b in right.collect() if a.text is not None and b.text is not None and runs(a.text) & runs(b.text)}
    assert got == want and len(want) > 4
    assert rows[-1] < 12  # the others went before
