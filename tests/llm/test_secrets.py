import hashlib
import random
import re
import string

import pandas as pd

from lexgraft.llm import secrets


def base(text):
    text = text or ""
    spans = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            spans.append((m.start(), 0, m.end()))
    for i, p, n in ((1, r"AKIA[A-Z0-9]+", 16), (2, r"[0-9a-f]+", 32)):
        spans += [(m.start(), i, m.end()) for m in re.finditer(p, text) if len(m[0]) >= n]
    spans.sort()
    line = ",".join(f"{secrets.KINDS[i]}:{a}:{b}" for a, i, b in spans)
    return (*(sum(k == i for _, k, _ in spans) for i in range(3)), hashlib.sha256(line.encode()).hexdigest()), set(filter(None, line.split(",")))


def check(rows, out):
    assert len(out) == len(rows)
    by = {k: base(t) for k, t in rows}
    for r in out:
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == by[r.doc_id][0], r.doc_id
        spans = [x for x in r.spans.split(",") if x]
        assert by[r.doc_id][1] <= set(spans)
        assert sum(x.startswith("random:") for x in spans) == r.n_random
        keys = [(int(x.split(":")[1]), secrets.KINDS.index(x.split(":")[0])) for x in spans]
        assert keys == sorted(keys)


def test_query(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    out = secrets.op9_secrets(spark, sf).collect()
    check(list(zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True)), out)


def test_forms_nulls_offsets_and_clashing_names(spark):
    texts = [
        None,
        "",
        "token: secret : longvalue12 é token=abcdefgh",
        "😀😀 PassWord = 'abc.def-123/x' apikey:\"short\" API_KEY:  == token=" + "a" * 8,
        "AKIAAKIA12 AKIA" + "A1" * 8 + " xAKIA123456789012",
        "f" * 31 + " " + "0a" * 20 + "g" + "0123456789abcdef" * 2,
        "K tokenK=abcdefgh ſecret=abcdefgh",
        "api_key=password=secretsecret " * 300,
    ]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(k, t, "c", 1) for k, t in rows], "doc_id long, text string, base string, n_hex int")
    check(rows, secrets.scan(df).collect())
    assert secrets.scan(df.limit(0)).count() == 0


def test_random_strings_are_told_from_words(spark):
    pick = random.Random(1)
    alphabets = [string.ascii_letters + string.digits, string.hexdigits[:16], string.ascii_uppercase + "234567", string.ascii_letters + string.digits + "+/"]
    rows = [(k, "see " + "".join(pick.choices(alphabets[k % 4], k=pick.randint(32, 64))) + " end") for k in range(200)]
    rows += [(1000 + k, "a " + "".join(pick.choice(["path", "Name", "file", "Line", "2024", "text", "Value"]) for _ in range(8)) + " b") for k in range(200)]
    rows += [(2000 + k, "averyverylongordinarywordwithoutdigits " + "1" * 40 + " " + "abc123" * 8) for k in range(20)]
    out = {r.doc_id: r.n_random for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(out[k] > 0 for k in range(200)) >= 190
    assert sum(out[1000 + k] > 0 for k in range(200)) <= 60
    assert not any(out[2000 + k] for k in range(20))
