"""Columns of docs that bear the private names of the operators stay as they are."""

import pytest

from lexgraft.llm import decontaminate, lines, mixing, quality, shingles, simhash, toxicity

PRIVATE = "__all __before __copy __id __kept __left __lines __n __own_id __range __row __stay __sum __taken __text __toxic __wanted __words __y".split()
OTHERS = [*PRIVATE, "__k0", "__k1", "__k2", "__chars", "__own0", "__own1", "label", "row", "key", "id", "size", "place", "copy", "a.b", "n_lines", "taken"]
TEXTS = ["one two three four five six", "one two three four five six", "some other words that stand here alone", "a line\na line\nlast", "", None]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "s", *(f"{c}{i}" for c in OTHERS)) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in OTHERS))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(6)], "doc_id long, quality int, toxic int")


def kept(df, but=()):
    names = df.columns
    assert [c for c in names if names.count(c) > 1] == [] and set(OTHERS) - set(but) <= set(names)
    rows = df.select("doc_id", *(f"`{c}`" for c in OTHERS if c not in but)).collect()
    assert rows and all(r[1:] == tuple(f"{c}{r[0]}" for c in OTHERS if c not in but) for r in rows)
    return {r[0] for r in rows}


def test_lines(docs):
    assert kept(lines.without_repeats(docs)) == set(range(6))
    assert kept(lines.dedup(docs), ["n_lines"]) == set(range(6))


def test_shingles(docs):
    assert kept(shingles.keep_one(docs)) >= {0, 2, 3}


def test_simhash(docs):
    assert kept(simhash.keep_one(docs)) >= {0, 2}


def test_mixing(docs):
    assert kept(mixing.mixed_documents(docs), ["taken"]) <= set(range(4))


def test_toxicity(docs, labels):
    assert kept(toxicity.keep_civil(docs, labels.withColumn("toxic", labels.toxic * 0))) == set(range(6))
    kept(toxicity.scored(docs, toxicity.trained(docs, labels)))


def test_quality(docs, labels):
    assert kept(quality.scored(docs, quality.trained(docs, labels))) == set(range(6))


def test_decontamination(spark, docs):
    benchmark = spark.createDataFrame([(1, "some other words that stand here alone")], "item_id long, text string")
    assert kept(decontaminate.clean(docs, benchmark)) == {0, 1, 3, 4, 5}
