import re

import pandas as pd
import xxhash

from lexgraft.llm import simhash


def plain(text, width):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, width=4, radius=4):
    prints = [plain(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), k), k)
    return sorted((k, f"{prints[i]:016x}", least[top(i)]) for i, (k, _) in enumerate(rows))


def found(df):
    return sorted((r.doc_id, r.fingerprint, r.component_id) for r in df.select("doc_id", "fingerprint", "component_id").collect())


def test_query_equals_brute_force(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    rows = list(zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True))
    assert found(simhash.op8_simhash(spark, sf)) == brute(rows)


def test_long_chains_nulls_and_clashing_names(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(words[: 60 - k // 3])) for k in range(30)] + [(100, None), (101, ""), (102, " \t\n"), (103, "One two"), (104, "one TWO"), (105, "é É"), (50, "one two")]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, fp string, component long")
    assert found(simhash.near_duplicates(df)) == brute(rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = simhash.keep_one(df, width=4)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute(rows)})


def test_every_pair_within_the_radius_is_found(spark):
    import random

    pick = random.Random(5)
    prints = []
    for k in range(60):
        base = pick.getrandbits(64)
        prints.append(base)
        for bits in range(1, 7):
            x = base
            for b in pick.sample(range(64), bits):
                x ^= 1 << b
            prints.append(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, fp long")
    for radius in (2, 4, 7):
        parent = list(range(len(prints)))
        for i in range(len(prints)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= radius:
                    a, b = parent[i], parent[j]
                    parent = [min(a, b) if p in (a, b) else p for p in parent]
        assert {(r.id, r.component) for r in simhash.clusters(df, radius).collect()} == set(enumerate(parent))


def test_keep_one_decides_by_row(spark):
    rows = [(None, "no id and one copy"), (None, "no id and one copy"), (None, "a text of its own"), (1, "the same id"), (1, "another text"), (2, "THE same id")]
    out = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, (rows[0], rows[2], rows[3], rows[4])))
