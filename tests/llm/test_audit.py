import re
from itertools import permutations

import pandas as pd
import pytest

from lexgraft.llm import audit
from tests import oracle

COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute(docs, labels):
    """Filters that run one after the other, in each order."""
    fails = []
    for i, text, _ in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails.append({
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
        })
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out, value = {}, {}
    for part in {s or "" for _, _, s in docs}:
        rows = [k for k, d in enumerate(docs) if (d[2] or "") == part]
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order):
                gone = [k for k in left if fails[k][f]]
                left = [k for k in left if not fails[k][f]]
                only = sum(fails[k][f] and sum(fails[k].values()) == 1 for k in rows)
                value[part, f] = value.get((part, f), 0) + len(gone)
                out[part, "".join(order), step + 1] = [len(left), len(gone), sum(fails[k][f] for k in rows) - len(gone), only, sum(docs[k][0] in good for k in gone), sum(docs[k][0] in toxic for k in gone)]
    return sorted((*k, *v, value[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_query_equals_sql(spark, sf):
    oracle.compare(spark, oracle.connect(sf), sf, audit.op12_audit, audit.SQL["op12_audit"])


def test_query_equals_filters_run_in_turn(spark, sf):
    docs, labels = pd.read_parquet(f"{sf}/documents.parquet"), pd.read_parquet(f"{sf}/labels.parquet")
    want = brute(list(zip(docs.doc_id, docs.text, docs.source, strict=True)), list(zip(labels.doc_id, labels.quality, labels.toxic, strict=True)))
    assert got(audit.op12_audit(spark, sf)) == want


def test_nulls_repeats_long_texts_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(audit, "PARTS", 2)  # decides in the driver's closure how many parts meet in one contraction
    long = " ".join(f"w{i}" for i in range(60_000))
    docs = [(1, None, None), (2, "", "a"), (3, "  \t", "a"), (None, "", "a"), (None, "x y", "b"), (4, "x y", "b"), (4, "x y", "b"), (5, "x y", "c")]
    docs += [(6, long, "c"), (7, long, "d"), (8, long + " $", None), (9, "UP and " * 40, "d"), (10, " ".join("Ünï%d" % i for i in range(55)), "e"), (2, "other", "a"), (2, "", "a")]
    docs += [(100 + i, "copy", "abcde"[i % 5]) for i in range(50)]
    labels = [(4, 1, 0), (4, 0, 1), (5, 1, 1), (None, 1, 1), (7, 1, None), (2, 1, 0), (77, 1, 1)]
    df = spark.createDataFrame([(i, t, s, 1, 2, 3, "z") for i, t, s in docs], "doc_id long, text string, source string, mask int, n int, good int, part string")
    known = spark.createDataFrame([(*r, 9) for r in labels], "doc_id long, quality int, toxic int, id int")
    assert got(audit.audit(audit.cells(df, known))) == brute(docs, labels)
    assert audit.audit(audit.cells(df.limit(0), known)).count() == 0
    assert got(audit.audit(audit.cells(df, known.limit(0)))) == brute(docs, [])


@pytest.mark.parametrize("letters", ["AD", "C"])
def test_other_filters(spark, sf, letters):
    some = {c: audit.FILTERS[c] for c in letters}
    counts = audit.cells(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), some)
    out = audit.audit(counts, letters).toPandas()
    assert len(out) == out["part"].nunique() * len(letters) * len(set(permutations(letters)))
    total = counts.toPandas().groupby("part")["n"].sum()
    first = out[out["step"] == 1].set_index("part")
    assert ((first["kept"] + first["removed"]) == total.reindex(first.index)).all()
