import numpy as np
import pandas as pd

from lexgraft.llm import toxicity as t


def held_out_measures(out, labels, column):
    got = out.merge(labels, on="doc_id")
    got = got[got.held_out]
    y, s, p = got[column].to_numpy(), got.score.to_numpy(), got.predicted.to_numpy()
    rank = pd.Series(s).rank().to_numpy()
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    return auc, (p == y).mean()


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    out = t.op1_toxicity(spark, sf).toPandas()
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    assert sorted(out.doc_id) == sorted(docs.doc_id)
    assert out.score.between(0, 1).all() and ((out.score >= 0.7) == (out.predicted == 1)).all()
    auc, right = held_out_measures(out, pd.read_parquet(f"{sf}/labels.parquet"), "toxic")
    assert auc > 0.9 and right > 0.93


def test_blocks_equal_the_whole_text(monkeypatch):
    model, v = t.Model(3), t.Vocabulary()
    model.b = [b + 1 for b in model.b]
    for n in (0, 1, 2, 3, 50, 257):
        words = [f"w{i * i % 37}".encode() for i in range(n)]
        whole = model.logit(words, v)
        monkeypatch.setattr(t, "BLOCK", 16)
        assert abs(model.logit(words, v) - whole) < 1e-5
        monkeypatch.undo()


def test_learns_phrases_and_thresholds():
    pick = np.random.default_rng(0)
    common = [f"c{i}" for i in range(200)]
    texts, y = [], []
    for i in range(600):
        words = list(pick.choice(common, 60))
        words[10:12] = ["you", "rotten"] if i % 4 == 0 else ["rotten", "fruit"] if i % 4 == 1 else ["you", "and"]
        texts.append(" ".join(words))
        y.append(int(i % 4 == 0))
    model, v = t.fit(texts[:400], y[:400]), t.Vocabulary()
    got = np.array([model.score(x, v) >= t.THRESHOLD for x in texts[400:]])
    assert (got == np.array(y[400:], bool)).mean() > 0.97


def test_nulls_no_labels_repeats_and_clashing_names(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "You IDIOT!!", "b"), (3, "You IDIOT!!", "b"), (None, "x " * 100_000, "c"), (5, "é 中文", None)]
    df = spark.createDataFrame([(*r, 0.5, 1) for r in rows], "doc_id long, text string, lang string, score double, y int")
    labels = spark.createDataFrame([(3, 1), (3, 0), (1, None), (None, 1), (77, 0), (2, 0)], "doc_id long, toxic int")
    for given in (labels, labels.limit(0)):
        out = t.scored(df, t.trained(df, given)).collect()
        assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
        assert out[0].score == out[1].score and out[2].score == out[3].score
        assert sorted(out[0].asDict()) == ["doc_id", "lang", "score", "text", "y"]
    kept = t.keep_civil(df, labels.limit(0))
    assert kept.columns == df.columns and kept.count() == 6
    assert t.keep_civil(df.limit(0), labels).count() == 0
