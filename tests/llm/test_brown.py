import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd

from lexgraft.llm import brown


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def base(rows, held):
    c = Counter(t for k, text in rows if not held(k) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    out = []
    for k, text in rows:
        ts = tokens(text)
        out.append((k, held(k), len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts)))
    return out


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(a[:5]) == tuple(b[:5])
        assert abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5]))


def test_query(spark, sf, monkeypatch):
    monkeypatch.setattr(brown, "TABLE", 3000)  # so that the join has something to do
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    rows = list(zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True))
    out = brown.op5_brown(spark, sf).collect()
    same(out, base(rows, lambda k: zlib.crc32(str(k).encode()) % 7 == 2))
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_at_most_one(spark):
    df = spark.createDataFrame([("a b c a b d the the cat",), ("the dog a b",), (None,)], "text string")
    model, counts, n, v = brown.fit(df)
    words = {r.word: r.c for r in counts.collect()}
    assert n == 9 + 4 + 3 and v == len(words)
    for before in range(len(model.step)):
        assert abs((10 ** model.step[before]).sum() - 1) < 1e-9
    own = {w: int(model.classes[model.place[bytes(w)]]) for w in words}
    for c in set(own.values()):
        assert sum(words[w] + 1 for w in words if own[w] == c) / 10 ** model.emit[c] < 1


def likelihood(n, own):
    member = np.eye(own.max() + 1)[own]
    return brown.likelihood(member.T @ n @ member)


def test_gains_are_those_of_the_likelihood():
    pick = np.random.default_rng(3)
    n = pick.poisson(0.7, (12, 12)).astype(float)
    own = pick.integers(0, 4, 12)
    member = np.eye(6)[own]
    m = member.T @ n @ member
    for w in range(12):
        rest = member.copy()
        rest[w] = 0
        after, before = n[w] @ rest, n[:, w] @ rest
        got = brown.gains(brown.without(m, own[w], after, before, n[w, w]), after, before, n[w, w], 5)
        tried = [np.concatenate([own[:w], [c], own[w + 1 :], [5]]) for c in range(5)]
        wide = np.pad(n, (0, 1))
        want = np.array([likelihood(wide, t) for t in tried])
        assert np.allclose(got - got[0], want - want[0])
        best = brown.better(m, int(own[w]), after, before, n[w, w], 5)
        assert want[best] >= want.max() - 1e-6


TEXTS = [("a b c a b d the the cat",), ("the dog a b \u00e9 rare1",), (None,), ("",), ("b b b " * 40,), ("cat dog cat the d c rare2 a",)] * 2


def plain_units(texts, place):
    for (text,) in texts:
        words = [w.encode() if w else brown.END for w in [None, *tokens(text)]]
        yield words, [place.get(w, len(place) + brown.form(w)) for w in words]


def test_a_round_moves_words_as_a_plain_version_does(spark, monkeypatch):
    monkeypatch.setattr(brown, "PAIRS", 50)
    df = spark.createDataFrame(TEXTS, "text string").repartition(3)
    words = sorted(Counter(w for t in TEXTS for w in tokens(t[0]) if w not in ("rare1", "rare2")).items(), key=lambda x: (-x[1], x[0] or ""))
    words = [(w.encode() if w else brown.END, c) for w, c in words]
    k, size = brown.CLASSES + brown.FORMS, len(words) + brown.FORMS
    n = np.zeros((size, size))
    for _, units in plain_units(TEXTS, {w: i for i, (w, _) in enumerate(words)}):
        np.add.at(n, (units[:-1], units[1:]), 1)
    own = np.concatenate([np.arange(len(words)) % 3, brown.CLASSES + np.arange(brown.FORMS)])
    member = np.eye(k)[own]
    m = member.T @ n @ member
    texts = brown.encoded(df, words)
    assert (brown.class_bigrams(texts, own, k) == m).all()
    moving = np.arange(size) % 2 == 0
    moving[len(words) :] = False
    want = own.copy()
    for w in np.flatnonzero(moving):
        rest = member.copy()
        rest[w] = 0
        want[w] = brown.better(m, int(own[w]), n[w] @ rest, n[:, w] @ rest, n[w, w], brown.CLASSES)
    got = brown.exchanged(texts, own, m, moving)
    assert got.tolist() == want.tolist() and got.tolist() != own.tolist()


def test_score_against_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(brown, "TABLE", 6)
    monkeypatch.setattr(brown, "TOP", 3)
    rows = [(i, t[0], i % 5 == 4) for i, t in enumerate([*TEXTS, ("never seen a the",)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    train = [(t,) for _, t, held in rows if not held]
    model, _, total, kinds = brown.fit(df.filter("NOT held").select("text"))
    c = Counter(w.encode() if w else brown.END for t in train for w in tokens(t[0]))
    assert len(model.place) <= 6 and total == sum(c.values()) and kinds == len(c)
    own = lambda w: int(model.classes[model.place[w]]) if w in model.place else brown.CLASSES + brown.form(w)
    k = brown.CLASSES + brown.FORMS
    m, t = np.zeros((k, k)), np.zeros(k)
    for words, _ in plain_units(train, model.place):
        for a, b in zip(words, words[1:], strict=False):
            m[own(a), own(b)] += 1
    for w, n in c.items():
        t[own(w)] += n + 1
    flat = (m.sum(axis=0) + 1) / (m.sum() + k)
    got = {r.doc_id: r.score for r in brown.score(df, "held").collect()}
    for i, text, _ in rows:
        words, want = next(plain_units([(text,)], model.place))[0], 0.0
        for a, b in zip(words, words[1:], strict=False):
            want += math.log10((m[own(a), own(b)] + brown.HALF * flat[own(b)]) / (m[own(a)].sum() + brown.HALF))
            want += math.log10((c[b] + 1) / (t[own(b)] + 1))
        assert abs(got[i] - want) < 1e-8 * max(1, abs(want))


def test_held_out_text_is_likelier_than_with_the_first_words_alone(spark, sf, monkeypatch):
    def held(rounds):
        monkeypatch.setattr(brown, "ROUNDS", rounds)
        return sum(r.score for r in brown.op5_brown(spark, sf).filter("held_out").collect())

    assert held(3) > held(0)


def test_exchange_raises_the_likelihood_to_that_of_the_hidden_classes():
    pick = np.random.default_rng(0)
    n = np.zeros((24 + brown.FORMS, 24 + brown.FORMS))
    hidden = np.repeat(np.arange(4), 6)
    pick.shuffle(hidden)
    for a in range(24):
        for b in range(24):
            n[a, b] = pick.poisson(40 if hidden[b] == (hidden[a] + 1) % 4 else 1)
    forms = 6 + np.arange(brown.FORMS)
    start = np.concatenate([np.arange(24) % 6, forms])
    truth = np.concatenate([hidden, forms])
    own = brown.exchange(n, 24, classes=6, sweeps=20)
    assert likelihood(n, own) > likelihood(n, start)
    assert likelihood(n, own) > likelihood(n, truth) - 0.1 * (likelihood(n, truth) - likelihood(n, start))


def test_nulls_ties_empty_tables_and_clashing_names(spark):
    rows = [(1, "A b, c"), (2, None), (3, ""), (3, ""), (None, "x " * 5000), (9, "b, É é"), (4, "\x0b\x1f z")]
    df = spark.createDataFrame([(*r, k % 3 == 0, 1, b"w") for k, r in enumerate(rows)], "doc_id long, text string, held boolean, row int, word binary")
    held = {k: i % 3 == 0 for i, (k, _) in enumerate(rows)} | {3: False}
    df = df.withColumn("held", df.held & ((df.doc_id != 3) | df.doc_id.isNull()))
    same(brown.score(df, "held").collect(), base(rows, held.__getitem__))
    assert brown.score(df.limit(0), "held").count() == 0
    all_held = brown.score(df.withColumn("held", brown.F.lit(True)), "held").collect()
    assert all(r.train_tokens == 0 and r.base_score == 0 and math.isfinite(r.score) for r in all_held)
