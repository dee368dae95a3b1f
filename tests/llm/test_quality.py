import numpy as np
import pandas as pd

from lexgraft.llm import quality as q
from tests.llm.test_toxicity import held_out_measures


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    out = q.op2_quality(spark, sf).toPandas()
    assert sorted(out.doc_id) == sorted(pd.read_parquet(f"{sf}/documents.parquet").doc_id)
    assert out.score.between(0, 1).all() and ((out.score >= 0.5) == (out.predicted == 1)).all()
    auc, right = held_out_measures(out, pd.read_parquet(f"{sf}/labels.parquet"), "quality")
    assert auc > 0.95 and right > 0.93


def test_rules_are_sparse_and_compile_to_the_same_scores(spark):
    pick = np.random.default_rng(1)
    names = list("abcd")
    x = pick.random((600, 4))
    y = ((x[:, 0] > 0.6) & (x[:, 1] <= 0.5)).astype(int)
    rules = q.fit(x, y, names)
    assert ((rules.predict(x, names) >= 0.5) == y).mean() > 0.97
    assert 0 < len(rules.rules) < len(q.paths(x, y.astype(float), names))
    df = spark.createDataFrame(pd.DataFrame(x, columns=names))
    got = df.select(rules.column({n: df[n] for n in names}).alias("s")).toPandas().s
    assert np.allclose(got, rules.predict(x, names))


def test_nulls_no_labels_repeats_and_clashing_names(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "The The The. " * 20_000), (5, "é 中文 !!!")]
    df = spark.createDataFrame([(*r, 0.5, 1.0) for r in rows], "doc_id long, text string, score double, __chars double")
    labels = spark.createDataFrame([(3, 1), (3, 0), (1, None), (None, 1), (2, 0), (5, 0), (77, 0)], "doc_id long, quality int")
    for given in (labels, labels.limit(0)):
        out = q.scored(df, q.trained(df, given)).collect()
        assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
        assert out[0].score == out[1].score and out[2].score == out[3].score
    assert {r.score for r in q.scored(df, q.trained(df, labels.limit(0))).collect()} == {0.5}
    assert q.scored(df.limit(0), q.Rules()).count() == 0
