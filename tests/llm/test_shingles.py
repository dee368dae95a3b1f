import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lexgraft.llm import shingles


def plain(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def hashed(text):
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) * (h >> 63)


def brute(rows, width=5, t=0.8):
    """Places of the rows that stay; every pair is compared."""
    sets = [plain(text, width) for _, text in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-9:
                parent[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least.setdefault(top(i), []).append((k is None, k or 0, hashed(rows[i][1]), i))
    return sorted(min(x)[3] for x in least.values())


def kept(spark, rows):
    df = spark.createDataFrame([(k, t, i, "n") for i, (k, t) in enumerate(rows)], "doc_id long, text string, place int, n string").coalesce(1)
    out = shingles.keep_one(df)
    assert out.columns == df.columns
    return sorted(r.place for r in out.collect())


def near_copies(pick, kinds, copies, passage=""):
    rows = []
    for k in range(kinds):
        base = [f"k{k}w{i}" for i in range(pick.randint(8, 120))]
        for _ in range(copies):
            words = list(base)
            for _ in range(pick.randint(0, 1 + len(words) // 40)):
                words[pick.randrange(len(words))] = f"e{pick.randrange(10**6)}"
            rows.append((len(rows), " ".join([passage, *words])))
    return rows


def test_near_copies_down_to_the_threshold(spark):
    rows = near_copies(random.Random(1), 30, 6)
    assert len(brute(rows)) < 150
    assert kept(spark, rows) == brute(rows)


def test_large_groups_common_passages_nulls_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(shingles, "SMALL", 3)
    passage = " ".join(f"common{i}" for i in range(25))
    rows = near_copies(random.Random(2), 12, 8, passage)
    rows += [(None, rows[0][1]), (None, "only this one has no id"), (None, "and this is another one"), (None, "AND this is another one")]
    rows += [(7, "an id that is there twice with another text"), (500, None), (501, ""), (502, " \n"), (503, "One two"), (504, "one TWO")]
    assert kept(spark, rows) == brute(rows)
    assert kept(spark, rows[:0]) == []


def test_stage_of_the_pipeline_takes_copies_that_four_bits_miss(spark, sf):
    import corpus_pipeline as cp

    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-4], "x", "y", "z", "u"])), (3, " ".join(words[:30]))]
    out = dict(cp.STAGES)["near_dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    assert sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_fingerprints_name_near_copies_and_the_exact_join_only_the_rest(spark, monkeypatch):
    asked, check = [], shingles.verified
    monkeypatch.setattr(shingles, "verified", lambda rows, distinct, pairs, width, t: asked.append({(r.u, r.v) for r in pairs.select("u", "v").collect()}) or check(rows, distinct, pairs, width, t))
    rows = near_copies(random.Random(4), 10, 5) + [(900 + k, " ".join([*(f"long{i}" for i in range(400)), f"end{k}"])) for k in range(6)]
    assert kept(spark, rows) == brute(rows)
    by_prints, by_sets = asked[0], asked[1]
    # long copies that differ in their last word alone are linked by fingerprints and not verified again
    assert len(by_prints) >= 5 and by_sets and not by_prints & by_sets


def test_a_fingerprint_is_the_majority_of_each_bit(monkeypatch):
    import numpy as np

    from lexgraft.llm import simhash

    keys = shingles.keys_of(" ".join(f"w{i}" for i in range(500)), 5)
    mixed = [(int(k) * 0x9E3779B97F4A7C15) % (1 << 64) for k in keys]
    want = sum(1 << b for b in range(64) if 2 * sum(m >> b & 1 for m in mixed) > len(mixed))
    assert shingles.fingerprint(keys) % (1 << 64) == want
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert shingles.fingerprint(keys) % (1 << 64) == want and shingles.fingerprint(np.zeros(0, np.int64)) == 0


def test_large_sets_that_are_not_alike_are_ruled_out_before_their_keys_are_joined(spark, monkeypatch):
    wanted, write = [], shingles.written
    monkeypatch.setattr(shingles, "written", lambda df, name, conf=None: wanted.append(df.count()) or write(df, name, conf) if name == "wanted" else write(df, name, conf))
    common = [f"c{i}" for i in range(1800)]
    docs = spark.createDataFrame([(k, " ".join(common + [f"k{k}w{i}" for i in range(1200)])) for k in range(5)], "id long, text string")
    rows = docs.select("id", F.xxhash64("text").alias("m1"), F.lit(0).cast("long").alias("m2"), "text")
    distinct = write(shingles.prefixes(rows, 5, 0.8, np.zeros(1 << shingles.BUCKET_BITS, bool)).withColumn("row", F.col("id")), "distinct")
    pairs = spark.createDataFrame([(a, b) for a in range(5) for b in range(a)], "u long, v long")
    assert shingles.verified(rows, distinct, pairs, 5, 0.8).count() == 0
    assert wanted == [0]  # 1,024 bits can't tell sets of 3,000 keys apart


def test_pairs_are_verified_in_parts_and_bitmaps_of_two_sizes_meet(spark, monkeypatch):
    made, write = [], shingles.written
    monkeypatch.setattr(shingles, "written", lambda df, name, conf=None: made.append(name) or write(df, name, conf))
    monkeypatch.setattr(shingles, "SHARE", 20)
    rows = near_copies(random.Random(5), 12, 6)
    base = [f"long{i}" for i in range(4110)]  # 4,094 and 4,106 keys: 8,192 and 16,384 bits
    rows += [(900, " ".join(base)), (901, " ".join(base[:4098])), (902, " ".join(base[:2000]))]
    assert kept(spark, rows) == brute(rows)
    assert made.count("verified") > 4  # three calls of one part each before
