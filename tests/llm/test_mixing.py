import re

import pandas as pd
import xxhash

from lexgraft.llm import mixing


def shares(sizes, weights, budget, most):
    """Targets by bisection on the common level, another way than the operator's."""
    low, high = 0.0, 1e12
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(most * n, mid * w) for n, w in zip(sizes, weights, strict=True)) < budget else (low, mid)
    return [min(most * n, low * w) for n, w in zip(sizes, weights, strict=True)]


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def hashed(key, text):
    h = 42 if key is None else xxhash.xxh64_intdigest(str(key).encode(), 42)
    h = xxhash.xxh64_intdigest((text or "").encode(), h)
    return h - (1 << 64) * (h >> 63)


def queue(rows, most=2, share=1.5):
    """(sizes, targets by source, words taken by position): a weighted fair queue that sends one word after the other's turn."""
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    size = [words(t) for _, t, _ in rows]
    of = {s: [i for i, r in enumerate(rows) if r[2] == s] for s in sources}
    sizes = [sum(size[i] for i in of[s]) for s in sources]
    want = shares(sizes, [(3, 1, 2)[k % 3] for k in range(len(sources))], share * sum(sizes), most)
    packets = []
    for s, target in zip(sources, want, strict=True):
        sent, line = 0, sorted(of[s], key=lambda i: (hashed(*rows[i][:2]), i))
        for copy in range(most):
            for i in line:
                for cut in ([int(target + 1e-6)] if sent < int(target + 1e-6) < sent + size[i] else []) + [sent + size[i] if size[i] else sent]:
                    packets.append((cut / target if target > 1e-9 else 0.0, hashed(*rows[i][:2]), i, copy, cut, cut - sent))
                    sent = cut
    left, taken = int(share * sum(sizes) + 1e-6), [0] * len(rows)
    for *_, i, _, _, n in sorted(packets):
        took = min(n, left)
        taken[i] += took
        left -= took
    return sizes, dict(zip(sources, want, strict=True)), taken


def same(df, rows):
    """What is taken of each id, rows that share one together, as the queue takes it; and near the targets."""
    got = [(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in df.collect()]
    sizes, targets, taken = queue(rows)
    order = lambda x: (x[0] is None, x)
    assert sorted(((k, n, t) for k, n, _, _, t in got), key=str) == sorted(((rows[i][0], words(rows[i][1]), taken[i]) for i in range(len(rows))), key=str)
    assert sorted({(n, round(t, 2)) for _, _, n, t, _ in got}) == sorted({(n, round(t, 2)) for n, t in zip(sizes, targets.values(), strict=True)})
    for s, target in targets.items():
        took = sum(t for t, r in zip(taken, rows, strict=True) if r[2] == s)
        assert abs(took - target) <= len(targets) + 1, order
    assert all(0 <= t <= 2 * n for _, n, _, _, t in got)
    return taken


def test_query_equals_a_sequential_queue(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    rows = list(zip(docs.doc_id.tolist(), docs.text.tolist(), docs.source.tolist(), strict=True))
    same(mixing.op3_mixing(spark, sf), rows)
    one, two = (sorted(map(tuple, mixing.op3_mixing(spark, sf).collect())) for _ in range(2))
    assert one == two


ROWS = [(1, "a b c", "x"), (2, None, "x"), (3, "", "y"), (4, "one", "z"), (5, "t " * 500, None), (6, "q r", None), (7, "a b c", "x"), (None, "a " * 9, "z"), (8, "long " * 30_000, "w")]


def test_nulls_one_word_sources_and_clashing_names(spark):
    df = spark.createDataFrame([(k, t, s, 1, 2, 3) for k, t, s in ROWS], "doc_id long, text string, source string, taken int, row int, size int")
    taken = same(mixing.mix(df), ROWS)
    assert mixing.mix(df.limit(0)).count() == 0
    kept = mixing.mixed_documents(df)
    assert set(kept.columns) == set(df.columns)
    assert sorted(((r.doc_id, r.taken, r.row, r["size"]) for r in kept.collect()), key=str) == sorted(((ROWS[i][0], n, 2, 3) for i, n in enumerate(taken) if n), key=str)


def test_repeated_rows_add_up_to_the_target(spark):
    rows = [(1, "a b c", "x")] * 3 + [(2, "d e f g", "y")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = same(mixing.mix(df), rows)
    kept = mixing.mixed_documents(df).collect()
    assert sorted(r.taken for r in kept) == sorted(n for n in taken if n)


def test_the_stream_is_cut_once_at_the_budget(spark, sf):
    taken = mixing.op3_mixing(spark, sf).toPandas()
    assert taken.taken.sum() == int(1.5 * taken["size"].sum())
