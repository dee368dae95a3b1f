import pandas as pd

import corpus_pipeline as cp
from lexgraft.llm import toxicity
from lexgraft.llm.common import table
from tests.llm import test_decontaminate, test_lines, test_mixing, test_shingles


def test_every_stage_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    benchmark = pd.read_parquet(f"{sf}/benchmark.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    frames = [docs.toPandas()]
    for name, stage in cp.STAGES:
        out = cp.written(stage(spark, docs, sf), name)
        assert out.columns == docs.columns + ["taken"] * (name == "mixing")
        docs = out
        frames.append(out.toPandas())
    start, civil, lines, kinds, clean, mixed = frames
    pairs = lambda f: list(zip(f.doc_id.tolist(), f.text.tolist(), strict=True))
    scores = toxicity.scored(table(spark, sf, "documents"), toxicity.trained(table(spark, sf, "documents"), labels)).toPandas()
    assert set(civil.doc_id) == set(scores[scores.score < 0.7].doc_id) and len(civil) < len(start)
    want = test_lines.brute(pairs(civil))
    assert dict(pairs(lines)) == {k: want[i] for i, (k, _) in enumerate(pairs(civil))}
    assert (lines.n_chars == lines.text.str.len()).all()
    rows = pairs(lines)
    assert sorted(kinds.doc_id) == sorted(rows[i][0] for i in test_shingles.brute(rows))
    leaks = {k for k, _ in test_decontaminate.brute(pairs(kinds), pairs(benchmark.rename(columns={"item_id": "doc_id"})))}
    assert set(clean.doc_id) == set(kinds.doc_id) - leaks
    rows = list(zip(clean.doc_id.tolist(), clean.text.tolist(), clean.source.tolist(), strict=True))
    taken = test_mixing.queue(rows)[2]
    assert dict(zip(mixed.doc_id, mixed.taken, strict=True)) == {r[0]: n for r, n in zip(rows, taken, strict=True) if n}


def test_nulls_repeats_and_clashing_names_through_the_stages(spark, sf):
    docs = table(spark, sf, "documents").limit(60)
    more = [(None, "a text without an id\nand a line", "en", None, 5), (None, None, None, None, None), (1, "", "en", "web", 0), (7, "same words here again and again", "en", "web", 3), (7, "same words here again and again", "en", "web", 3)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    docs = docs.selectExpr("*", "1 AS n_lines", "'x' AS n_removed", "2 AS size", "3 AS score", "4 AS line", "5 AS row")
    for name, stage in cp.STAGES:
        columns = docs.columns
        docs = cp.written(stage(spark, docs, sf), name)
        assert docs.columns == columns + ["taken"] * (name == "mixing")
    assert docs.count() > 5 and {tuple(r) for r in docs.select("n_lines", "n_removed", "size", "score", "line", "row").distinct().collect()} == {(1, "x", 2, 3, 4, 5)}


def test_run_gives_the_last_stage(spark, sf):
    out = cp.run(spark, sf)
    assert out.columns == [*table(spark, sf, "documents").columns, "taken"]
    assert out.count() > 50 and out.filter("taken <= 0").count() == 0


def test_empty_documents(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
