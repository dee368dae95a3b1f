import math
import random

import numpy as np
import pandas as pd

from lexgraft.llm import topk


def brute(rows, asked, k=5):
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for key, q in sound:
        if not asked(key):
            continue
        found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in sound if i != key and len(v) == len(q))
        out += [(key, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def test_query(spark, sf):
    rows = pd.read_parquet(f"{sf}/embeddings.parquet")
    want = brute([(int(i), [float(x) for x in v]) for i, v in zip(rows.vec_id, rows.embedding, strict=True)], lambda i: i % 50 == 0)
    assert got(topk.op7_topk(spark, sf)) == want


def test_lengths_ties_signs_broken_vectors_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET_ROWS", 7)  # both decide how rows are dealt, in the driver
    monkeypatch.setattr(topk, "QUERY_ROWS", 9)
    pick = random.Random(4)
    rows = []
    for i in range(300):
        size = 10 ** pick.uniform(-2, 1)
        base = [1.0, 0.5, -0.2, 0.1] if i % 2 else [pick.gauss(0, 1) for _ in range(4)]
        rows.append((i, [size * (x + pick.gauss(0, 0.05)) for x in base]))
    rows += [(300, rows[5][1]), (301, rows[5][1]), (302, [0.0] * 4), (303, [-1.0, -1.0, -1.0, -1.0]), (304, None), (305, []), (306, [1.0, None, 1.0, 1.0]), (307, [float("nan")] * 4), (308, [float("inf")] * 4), (310, [1.0, 2.0]), (320, [2.0, 1.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, score int")
    asked = topk.F.col("vec_id") % 10 == 0
    assert got(topk.top_k(df, asked)) == brute(rows, lambda i: i % 10 == 0)
    assert topk.top_k(df.limit(0), asked).count() == 0
    assert got(topk.top_k(df.filter("vec_id in (0, 1, 2)"), asked)) == brute(rows[:3], lambda i: i % 10 == 0)


def test_a_list_for_each_row_of_a_repeated_id_and_long_products(spark):
    pick = random.Random(9)
    rows = [(i, [pick.gauss(0, 1) for _ in range(3)]) for i in range(60)] + [(50, [3.0, -1.0, 0.5]), (0, [1.0, 1.0, 1.0]), (0, [1.0, 1.0, 1.0])]
    rows += [(100, [float(2**20 + 1) / 256, 2.0**21, 0.0]), (101, [2.0**22 + 1 / 256, 2.0**21, -1.0]), (102, [2.0**22 + 2 / 256, 2.0**21, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = got(topk.top_k(df, topk.F.col("vec_id") % 50 == 0))
    assert out == brute(rows, lambda i: i % 50 == 0)
    assert [sum(r[0] == i for r in out) for i in (0, 50, 100)] == [15, 10, 5] and max(r[3] for r in out) > 2**53


def test_search_prunes_and_misses_nothing():
    pick = np.random.default_rng(0)
    for spread in (0.3, 1.0, 3.0):
        x = np.floor(200 * pick.normal(size=(3000, 12)) * pick.uniform(0.2, 2, size=(3000, 1)))
        q = np.floor(200 * (pick.normal(size=(40, 12)) * spread + x[:40]))
        ids, key = np.arange(3000), np.arange(5000, 5040)
        for best in (np.full(40, -np.inf), np.sort(x @ q.T, axis=0)[-9].astype(float)):
            out = topk.search(q, key, best, x, ids, 5)
            for i, k in enumerate(key.tolist()):
                products = x @ q[i]
                order = np.lexsort((ids, -products))[:5]
                assert [(s, n) for a, n, s, m in out if a == k and n is not None] == [(int(products[j]), j) for j in order.tolist()]
            made = sum(m for _, n, _, m in out if n is None)
            assert made < 0.7 * 40 * 3000


def test_query_makes_fewer_products_than_pairs(spark):
    """In the workers: the products column counts what they have made."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = topk.top_k(vectors, topk.F.col("vec_id") % 50 == 0).select("query_id", "products").distinct().toPandas()
    assert found["products"].sum() < 0.25 * len(found) * vectors.count()


def test_query_equals_sql(spark, sf):
    from tests import oracle

    oracle.compare(spark, oracle.connect(sf), sf, topk.op7_topk, topk.SQL["op7_topk"])
