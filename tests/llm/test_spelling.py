import random
import re
import zlib
from collections import Counter

import pandas as pd
import pytest

from lexgraft.llm import spelling


def counted(docs, least=5, often=3):
    found = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= least and n >= often}


def one_edit(x, y):
    x, y = sorted((x, y), key=len)
    if len(y) - len(x) > 1 or x == y:
        return False
    i = 0
    while i < len(x) and x[i] == y[i]:
        i += 1
    return x[i + 1 :] == y[i + 1 :] if len(x) == len(y) else x[i:] == y[i + 1 :]


def brute(known):
    by_length = {}
    for w in known:
        by_length.setdefault(len(w), []).append(w)
    near = {w: [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if one_edit(w, v)] for w in known}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-known[v], v), default=None)
        form[w] = best if best and known[best] >= 2 * known[w] else None
    out = []
    for w in known:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, known[w], len(near[w]), known[form[w]] if form[w] else None))
    return sorted(out)


def got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_acceptor_is_minimal_and_its_pairs_are_all():
    pick = random.Random(3)
    for alphabet, size in (("ab", 6), ("abc", 5), ("abcdef", 4)):
        known = sorted({"".join(pick.choice(alphabet) for _ in range(pick.randrange(size + 1))) for _ in range(200)})
        found = list(spelling.Acceptor(known).one_edit_apart())
        assert len(found) == len({frozenset(p) for p in found})
        assert {frozenset(p) for p in found} == {frozenset((x, y)) for x in known for y in known if one_edit(x, y)}
    whole = ["".join((a, b, c)) for a in "abc" for b in "abc" for c in "abc"]
    assert len(spelling.Acceptor(whole).final) == 4


def test_query(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    want = brute(counted(zip(docs.doc_id, docs.text, strict=True)))
    assert any(w[1] for w in want)
    assert got(spelling.op11_spelling(spark, sf)) == want


@pytest.mark.parametrize("most", [2, 30, 10_000])
def test_crowded_parts_are_split(spark, most):
    pick = random.Random(most)
    known = {}
    for i in range(400):
        w = ("prefix" if i % 3 else "") + "".join(pick.choice("abé") for _ in range(pick.randrange(5, 9))) + ("suffix" if i % 2 else "")
        known[w] = pick.randrange(3, 60)
    vocabulary = spark.createDataFrame(list(known.items()), "word string, n long")
    assert got(spelling.variants(vocabulary, most=most)) == brute(known)


def test_nulls_repeats_long_words_ties_chains_and_clashing_names(spark):
    long = "aB" * 3000
    docs = [(1, None), (2, ""), (None, "Colour colour COLOUR color color color"), (3, "123 --"), (4, f"{long} {long}x {long} {long}x {long} {long}x")]
    docs += [(9, "spelled spelled spelled spelld spelld spelld")] * 3 + [(10, "Étés×abc " * 4), (10, "étés×abc " * 4)]
    chain = (("aaaaa", 3), ("aaaab", 6), ("aaabb", 12), ("aabbb", 24), ("abbbb", 48), ("bbbbb", 96), ("aaaaaa", 6))
    docs += [(20 + i, f"{w} " * n) for i, (w, n) in enumerate(chain)]
    df = spark.createDataFrame([(i, t, "w", 7, "z") for i, t in docs], "doc_id long, text string, word string, n int, run string")
    want = brute(counted(docs))
    assert {r[2] for r in want if r[0] in ("aaaab", "abbbb")} == {"bbbbb"}
    assert [r[1] for r in want if r[0] == "aaaaa"] == ["aaaaaa"]  # of two that are as frequent, the smaller
    assert got(spelling.variants(spelling.words(df))) == want
    assert spelling.variants(spelling.words(df.limit(0))).count() == 0
