import re
from collections import Counter

import pandas as pd
import pytest
import xxhash

from lexgraft.llm import lines


@pytest.fixture(autouse=True)
def small_tables(monkeypatch):
    monkeypatch.setattr(lines, "BUCKET_BITS", 13)


def place(row):
    """The order of rows: id, null first, then the hash of the text."""
    h = xxhash.xxh64_intdigest((row[1] or "").encode(), 42)
    return row[0] is not None, row[0] or 0, h - (1 << 64) * (h >> 63)


def brute(rows, t=0.8, min_words=1):
    """text by position of the row, with the lines that an earlier one is like taken out; quadratic on purpose."""
    kept, seen = {}, []
    for i in sorted(range(len(rows)), key=lambda i: place(rows[i])):
        text = rows[i][1]
        if text is None:
            kept[i] = None
            continue
        left = []
        for line in text.split("\n"):
            found = re.findall(r"[^\x20\x09-\x0D]+", line.lower())
            s = set(found)
            if len(found) < max(min_words, 1):
                left.append(line)
                continue
            if not any(len(s & o) >= t * len(s | o) - 1e-9 for o in seen):
                left.append(line)
            seen.append(s)
        kept[i] = "\n".join(left)
    return kept


def same(df, rows, **how):
    want = brute(rows, **how)
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in lines.dedup(df, **how).collect())
    n = lambda text: 0 if text is None else len(text.split("\n"))
    words = lambda line: len(re.findall(r"[^\x20\x09-\x0D]+", line))
    left = lambda old, new: n(old) - (0 if new == "" and words(old) else n(new))  # noqa: E731  no line is left of a text that became empty
    assert got == Counter((k, want[i], n(text), left(text, want[i])) for i, (k, text) in enumerate(rows))


def test_query_equals_brute_force(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    rows = list(zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True))
    same(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), rows)
    got = lines.op4_lines(spark, sf).collect()
    want = brute(rows)
    assert {r.doc_id: r.text for r in got} == {k: want[i] for i, (k, _) in enumerate(rows)}
    assert sum(r.n_removed for r in got) > 100


def test_chains_of_edits_nulls_and_clashing_names(spark):
    base = [f"word{i}" for i in range(30)]
    rows = [(k, " ".join(base[k : k + 20]) + "\nshort\nshort\n\tOne two  THREE") for k in range(10)]
    rows += [(20 + k, " ".join(w if i != k else f"other{k}" for i, w in enumerate(base))) for k in range(30)]
    rows += [(70, None), (71, ""), (72, "\n\n"), (None, "one two three"), (73, "ha ha\nha ha ha"), (75, "x " * 3000 + "y"), (76, "a\x0bb\x0cc\rd  e"), (77, "É È\né è")]
    df = spark.createDataFrame([(k, t, 7, "n") for k, t in rows], "doc_id long, text string, n_lines int, line string")
    assert lines.dedup(df).columns == ["doc_id", "text", "line", "n_lines", "n_removed"]
    same(df, rows)
    same(df, rows, min_words=2)
    assert lines.dedup(df.limit(0)).count() == 0
    same_columns = lines.without_repeats(df)
    assert same_columns.columns == df.columns and {r.n_lines for r in same_columns.collect()} == {7}


def test_shared_and_missing_ids_and_repeated_rows(spark):
    rows = [(None, "p q\na b c d e"), (None, "a b c d e\nr s"), (5, "p1 q1\na1 b1 c1 d1 e1"), (5, "a1 b1 c1 d1 e1\nr1 s1")]
    rows += [(6, "one row here\nthe other line of it")] * 3 + [(None, None), (None, None), (7, "url\nurl"), (8, "url")]
    same(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_one_line_of_very_many_words(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " more"), (3, " ".join(f"w{i}" for i in range(40_000)))]
    same(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_groups_with_more_kinds_than_leaders(spark, monkeypatch):
    import random

    for hot in (lines.HOT, 8, 20):  # with 8 words in four sets have leaders
        monkeypatch.setattr(lines, "HOT", hot)
        pick = random.Random(3)
        rows = []
        for k in range(160):
            words = ["commonrareword"] + [f"g{k % 12}w{i}" for i in range(20)]
            for _ in range(pick.randint(0, 3)):
                words[pick.randint(1, 20)] = f"e{pick.randint(0, 400)}"
            rows.append((k if k % 3 else 7, " ".join(words)))
        same(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_near_copies_of_a_hot_line_make_few_pairs(spark, monkeypatch):
    base = [f"b{i}" for i in range(60)]
    rows = [(k, " ".join(f"x{k}" if i == k % 60 else w for i, w in enumerate(base))) for k in range(400)]
    made, real = [], lines.repeated

    def counting(sets, pairs, t):
        made.append(pairs.count())
        return real(sets, pairs, t)

    monkeypatch.setattr(lines, "repeated", counting)
    monkeypatch.setattr(lines, "HOT", 28)  # the group of 400 is one that has leaders
    same(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    assert sum(made) < 20 * len(rows)


def test_leaders_are_asked_once_by_a_set_of_many_frequent_words(spark, monkeypatch):
    base = [f"b{i}" for i in range(60)]
    rows = [(k, " ".join(f"x{k}" if i == k % 60 else w for i, w in enumerate(base))) for k in range(400)]
    made, real = [], lines.repeated

    def counting(sets, pairs, t):
        made.append(pairs.count())
        return real(sets, pairs, t)

    monkeypatch.setattr(lines, "repeated", counting)
    monkeypatch.setattr(lines, "HOT", 28)
    sets = lines.distinct_sets(spark.createDataFrame(rows, "doc_id long, text string"), 1, "doc_id", "text")
    found = lines.led(sets, lines.prefixes(sets, 0.8), 0.8).count()
    assert len(made) == lines.LEADERS and sum(made) <= len(rows)  # one row a set, not one for each of its frequent words
    assert found > 0.9 * len(rows)


def test_a_text_is_hashed_before_it_is_cut_into_lines(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(lines, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()))
    lines.distinct_sets(spark.createDataFrame([(1, "a b\nc d")], "doc_id long, body string"), 1, "doc_id", "body")
    above, below = plans[0].split("Generate ", 1)
    assert "xxhash64(body" not in above and "xxhash64(body" in below
