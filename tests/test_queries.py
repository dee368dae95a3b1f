import numpy as np
import pytest
from pyspark.sql import functions as F

from lexgraft.operators import similarity
from lexgraft.plans import registry, rules
from lexgraft.sources import files, tables
from tests import oracle

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, db, name):
    # the smallest table has few synsets of one gloss and lemma
    oracle.compare(spark, db, sf, QUERIES[name], SQL[name], name not in ("gloss_equi_join",))


def plain_tiling(a, b, least=5):
    """Share of a in the longest common runs of free characters, one after the other, by all pairs of places."""
    a, b = (np.frombuffer(t.lower().encode("utf-32-le"), np.uint32).astype(np.int64) for t in (a, b))
    free_a, free_b, marked = np.ones(len(a), bool), np.ones(len(b), bool), 0
    while len(a) and len(b):
        same = (a[:, None] == b[None, :]) & free_a[:, None] & free_b[None, :]
        run = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a) - 1, -1, -1):
            run[i, :-1] = np.where(same[i], run[i + 1, 1:] + 1, 0)
        n = run.max()
        if n < least:
            break
        i, j = np.argwhere(run == n)[0]
        free_a[i : i + n], free_b[j : j + n] = False, False
        marked += n
    return marked / len(a) if len(a) else 0.0


def test_tiling_pairs_by_brute_force(spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    texts = {r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    lines = {x for t in texts for x in t.split("\n")}
    runs = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    held = [(i.item_id, i.text, runs(i.text)) for i in items]
    want = sorted((i, plain_tiling(t, x)) for x in lines for i, t, r in held if runs(x) & r)
    got = sorted((r.left_id, r.score) for r in QUERIES["tiling_similarity_pairs"](spark, sf).collect())
    assert got and got == want


def test_vectors_are_read_by_bucket(spark):
    vectors = spark.createDataFrame([(f"w{i}", [float(i)]) for i in range(300)], "word string, vec array<double>")
    name = files.write_vectors(vectors, 16)
    one = spark.table(name).filter("word = 'w7'")
    assert [r.vec for r in one.collect()] == [[7.0]]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    auto = "spark.sql.sources.bucketing.autoBucketedScan.enabled"  # prunes files alike, but doesn't say so in the plan
    spark.conf.set(auto, "false")
    try:
        assert "SelectedBucketsCount: 1 out of 16" in plan(spark.table(name).filter("word = 'w7'"))
    finally:
        spark.conf.unset(auto)
    wanted = spark.createDataFrame([(f"w{i}",) for i in range(0, 400, 3)], "word string").repartition(16, "word")
    met = spark.table(name).hint("merge").join(wanted, "word")
    assert plan(met).count("Exchange hashpartitioning") == 1 and met.count() == 100


def test_lexicon_files_whose_references_are_broken(spark):
    synset = spark.createDataFrame([(1, "noun", "a | b"), (2, "verb", "")], "synset_id long, pos string, gloss string")
    sense = spark.createDataFrame([("x y", "noun", 1, 1), ("z", "verb", 2, 1), ("z", "verb", 1, 2)], "lemma string, pos string, synset_id long, sense_rank int")
    edge = spark.createDataFrame([(1, 2, "!", "word", 1), (2, 1, "@", "synset", 0), (2, 1, "+", "word", 2)], "src long, dst long, pointer string, level string, ord int")
    odd = spark.createDataFrame([("xs", "noun", "x")], "surface string, pos string, base string")
    path = files.scratch(spark)
    files.write_lexicon(path, synset, sense, edge, odd)
    back = files.read_lexicon(spark, path)
    for name, df in (("synset", synset), ("sense", sense), ("edge", edge), ("exception", odd)):
        assert sorted(map(tuple, back[name].select(df.columns).collect())) == sorted(map(tuple, df.collect()))
    assert files.check(spark, path, back).count() == 0
    broken = back | {"synset": back["synset"].filter("synset_id = 2"), "sense": back["sense"].filter("lemma = 'z'")}
    assert sorted(map(tuple, files.check(spark, path, broken).collect())) == [("pointer", "1"), ("sense", "1"), ("sense listed once", "x_y%n 1 1")]


def test_lexicon_files_of_synsets_with_many_pointers(spark):
    synset = spark.range(1, 1205).selectExpr("id AS synset_id", "'noun' AS pos", "'g' AS gloss")
    sense = spark.range(1, 1205).selectExpr("concat('w', id) AS lemma", "'noun' AS pos", "id AS synset_id", "1 AS sense_rank")
    edge = spark.range(2, 1205).selectExpr("1L AS src", "id AS dst", "'%m' AS pointer", "'synset' AS level", "0 AS ord").union(spark.sql("SELECT 2L, 3L, '!', 'word', 300"))
    path = files.scratch(spark)
    files.write_lexicon(path, synset, sense, edge, spark.createDataFrame([("xs", "noun", "x")], "surface string, pos string, base string"))
    back = files.read_lexicon(spark, path)
    assert sorted(map(tuple, back["edge"].collect())) == sorted(map(tuple, edge.collect()))
    assert files.check(spark, path, back).count() == 0


def test_large_tables_of_small_files_are_not_broadcast(spark, tmp_path, monkeypatch):
    rows = spark.range(1000).select("id", F.lit(7).alias("x"))
    plan = lambda other: spark.range(1000).join(other, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(files.kept(rows))
    monkeypatch.setattr(files, "SMALL", 100)
    assert "SortMergeJoin" in plan(files.kept(rows).select("id").distinct())
    spark.range(1000).selectExpr("id AS p_partkey", "'a b' AS p_name", "'t' AS p_type", "'Brand#1' AS p_brand").write.parquet(str(tmp_path / "part.parquet"))
    assert "SortMergeJoin" in plan(tables.part_words(spark, str(tmp_path)).withColumnRenamed("key", "id"))


def test_files_of_exceptions_are_sorted(spark, tmp_path):
    odd = spark.createDataFrame([(f"s{i * 37 % 100:02d}", ("noun", "verb")[i % 2], "b") for i in range(100)] + [("s00", "noun", "b")], "surface string, pos string, base string")
    files.write_exceptions(odd, str(tmp_path / "exc"))
    for pos in ("noun", "verb"):
        parts = [p.read_text().splitlines() for p in sorted((tmp_path / "exc" / f"pos={pos}").glob("part-*"))]
        lines = [line for part in parts for line in part]
        assert len(lines) == 50 and lines == sorted(lines)


def test_a_cascade_scores_fewer_rows_and_gives_the_same(spark, sf):
    every = rules.made(spark, sf, "round")
    want = sorted(map(tuple, rules.stands(rules.proposals(spark, sf)).collect()))
    got, rounds = rules.cascade(rules.made(spark, sf, "lexicon"), every)
    assert sorted(map(tuple, got.collect())) == want
    assert sum(r.rows.count() for r in rounds) < 0.9 * every.rows.count()


def test_nearest_by_tiles(spark):
    pick = np.random.default_rng(5)
    rows = lambda n: [(i, v.tolist()) for i, v in enumerate(np.round(pick.normal(size=(n, 3)), 1))]
    left, right = rows(70), rows(90) + [(90, [0.0, 0.0, 0.0])]
    frame = lambda r, key: spark.createDataFrame([(i, (v, float(np.linalg.norm(v)))) for i, v in r], f"{key} long, v struct<vec: array<double>, norm: double>")
    got = {r.key: (r.id, r.score) for r in similarity.nearest(frame(left, "key"), frame(right, "id"), 16).collect()}
    for i, a in left:
        cos = [(-round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 6), j) for j, b in right if np.linalg.norm(b) and np.linalg.norm(a)]
        best = min(cos, default=(0, None))
        assert got.get(i) == ((best[1], -best[0]) if best[0] < 0 else None)
    plan = similarity.nearest(frame(left, "key"), frame(right, "id"), 16)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_written_lines_are_the_entries(spark, sf):
    import json

    got = [json.loads(r.line) for r in QUERIES["write_entries_jsonl"](spark, sf).collect()]
    want = {r.entry_id: (r.lemma, r.pos, r.gloss, r.targets or "") for r in QUERIES["read_entries_jsonl"](spark, sf).collect()}
    assert {r["entry_id"]: (r["lemma"], r["pos"], *r["glosses"], ",".join(x["target"] for x in r.get("relations", ()))) for r in got} == want



def test_entries_of_one_form_are_asked_once_and_propose_the_same(spark, sf, tmp_path):
    import os

    for name in oracle.TABLES:
        if name != "part":
            os.symlink(f"{sf}/{name}.parquet", tmp_path / f"{name}.parquet")
    part = spark.read.parquet(f"{sf}/part.parquet").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(2))))
    part.withColumn("p_partkey", F.col("p_partkey") + 1024 * F.col("copy")).drop("copy").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    x, plain = rules.Lexicon(spark, str(tmp_path)), rules.Lexicon(spark, str(tmp_path))
    plain.alike = plain.entries.select("entry_id", F.col("entry_id").alias("form"))
    assert x.forms.count() < 0.7 * x.entries.count() == 0.7 * plain.forms.count()
    one, every = (rules.Round(y, (1, 2, 3, 13)) for y in (x, plain))
    own = lambda df: df.filter("rule <> 2").count()
    assert 0 < own(one.found) < 0.7 * own(every.found)
    said = lambda y, r: sorted(map(tuple, y.spread(rules.proposed(r)).collect()), key=repr)
    want = said(plain, every)
    assert said(x, one) == want and {r[1] for r in want} == {1, 2, 3, 13}
