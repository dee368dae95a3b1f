import hashlib
import re

import pandas as pd

from lexgraft.sources import tables


def test_every_word_has_the_vector_at_its_hash(spark, sf):
    docs, vectors = pd.read_parquet(f"{sf}/documents.parquet"), pd.read_parquet(f"{sf}/embeddings.parquet")
    by_id = dict(zip(vectors.vec_id, vectors.embedding, strict=True))
    got = {r.word: list(r.vec) for r in tables.word_vector(spark, sf).collect()}
    words = {w for t in docs.text for w in re.findall(r"(?<!\S)[a-z]+(?!\S)", t.lower())}
    assert words and words <= set(got)
    for w, vec in got.items():
        assert vec == list(by_id[int(hashlib.md5(w.encode()).hexdigest()[:12], 16) % len(by_id)])


def test_glosses_are_whole_texts(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    want = {k: re.sub(r"[ \t\n\x0b\f\r]+", " ", t).strip(" ") for k, t in zip(docs.doc_id, docs.text, strict=True)}
    assert {r.entry_id: r.gloss for r in tables.entry(spark, sf).collect()} == want
