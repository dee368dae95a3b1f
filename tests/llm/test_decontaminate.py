import random

import numpy as np
import pandas as pd

from lexgraft.llm import decontaminate as d


def dice(a, b, weight):
    from collections import Counter

    x, y = Counter(a), Counter(b)
    total = sum(weight(h) * n for c in (x, y) for h, n in c.items())
    return 2 * sum(weight(h) * min(n, y[h]) for h, n in x.items()) / total if total else 0.0


def brute(rows, items, threshold=0.8):
    """Every window of every document against every item, by shingle similarity alone."""
    index = d.Index(items)
    weight = lambda h: float(index.weigh(np.array([h], np.uint64))[0])
    out = set()
    for key, text in rows:
        words = d.words_of(text)
        for item, t in items:
            its = d.words_of(t)
            if not its or not words:
                continue
            k = min(5, len(its))
            mine, other = d.shingles(words, k).tolist(), d.shingles(its, k).tolist()
            size = min(len(other), len(mine))
            keys = set(other)
            if size and any(dice(mine[s : s + size], other, weight) >= threshold for s in range(len(mine) - size + 1) if keys & set(mine[s : s + size])):
                out.add((key, item))
    return out


def test_query(spark, sf):
    docs, bench = pd.read_parquet(f"{sf}/documents.parquet"), pd.read_parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in d.op6_decontaminate(spark, sf).collect()}
    assert got == brute(list(zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True)), list(zip(bench.item_id.tolist(), bench.text.tolist(), strict=True)))
    assert got


def test_edited_passages_short_items_nulls_and_clashing_names(spark):
    pick = random.Random(2)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(pick.choices(vocabulary, k=pick.randint(20, 60)))) for i in range(12)] + [(50, "just three words"), (51, None), (52, ""), (53, "Same SAME same same same same")]
    rows = []
    for k in range(60):
        words = items[k % 12][1].split()
        for _ in range(k % 3):
            words[pick.randrange(len(words))] = "edited"
        rows.append((k, " ".join(pick.choices(vocabulary, k=40)) + ", " + ", ".join(words).upper() + ". " + " ".join(pick.choices(vocabulary, k=30))))
    rows += [(100, None), (101, ""), (102, "Just three words"), (103, "well, just THREE words."), (104, "same " * 40), (105, items[0][1]), (105, items[0][1]), (106, " ".join(items[1][1].split()[:-1]))]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, item_id int, start int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in d.leaks(df, bench).collect()}
    assert got == brute(rows, items)
    assert {(105, 0), (102, 50), (103, 50), (106, 1)} <= got and len(got) > 25
    kept = d.clean(df, bench)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, _ in rows if k not in {k for k, _ in got})
    assert d.leaks(df.limit(0), bench).count() == 0 and d.leaks(df, bench.limit(0)).count() == 0


def test_parts_of_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(d, "PART_WORDS", 30)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(20))) for i in range(5)]
    df = spark.createDataFrame([(i, f"before {t} after") for i, t in items], "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.start, r.n_words, r.hamming, r.similarity) for r in d.leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i, 1, 20, 0, 1.0) for i in range(5)}


def test_block_tables_find_every_fingerprint_within_the_radius():
    pick = np.random.default_rng(1)
    for bits in range(0, d.RADIUS + 1):
        x = pick.integers(0, 2, 64, dtype=np.uint8)
        y = x.copy()
        y[pick.choice(64, bits, replace=False)] ^= 1
        a, b = np.packbits(x), np.packbits(y)
        assert (d._DISTANCE[a, b] <= d.RADIUS // d.BLOCKS).any()


def test_clean_judges_rows_that_share_an_id_or_have_none_by_their_own_texts(spark, monkeypatch):
    items = [(i, " ".join(f"i{i}w{j}" for j in range(20))) for i in range(3)]
    rows = [(None, f"before {items[0][1]} after"), (None, "a clean text without an id"), (None, None), (1, f"{items[2][1]} and more"), (1, "a clean text with the same id"), (2, "clean")]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for words in (d.PART_WORDS, 25):
        monkeypatch.setattr(d, "PART_WORDS", words)
        out = d.clean(df, bench)
        assert out.columns == df.columns
        assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, (r for i, r in enumerate(rows) if i not in (0, 3))))
