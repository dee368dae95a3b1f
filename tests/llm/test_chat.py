import hashlib

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from lexgraft.llm import chat


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def want(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss)


def got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_query(spark, sf):
    rows = pd.read_parquet(f"{sf}/conversations.parquet").sort_values(["conv_id", "turn"])
    by = {k: want(list(zip(g.role, g.text.fillna(""), strict=True))) for k, g in rows.groupby("conv_id")}
    by[-1] = want([("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")])
    assert got(chat.op10_chat(spark, sf)) == by


PIECES = st.lists(st.sampled_from(["<", "|", "\\", "[", "]", "/", "s>", "INST", "turn", "<|end|>", "<|text|>", "<\\|end|>", "[\\/INST]", "</s>", " ", "\n", "é", "😀", "é", "a"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "<|text|>"]), PIECES), max_size=5))
def test_round_trip(turns):
    text, spans = chat.render(turns)
    assert chat.turns_of(text) == turns
    code = chat.tokenizer(chat.TOKENIZER).encode(text, add_special_tokens=False)
    offsets = np.array(code.offsets, np.int64).reshape(-1, 2)
    mask = chat.masked(offsets[:, 0], offsets[:, 1], spans)
    assert chat.loss_texts(text, offsets[:, 0], offsets[:, 1], mask) == [t for r, t in turns if r == "assistant" and t]


def test_nulls_ties_and_clashing_names(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a"), (1, 1, "assistant", "b"), (None, None, None, "x"), (2, 5, "assistant", "z" * 200_000), (2, None, "assistant", ""), (1, 0, "user", None)]
    df = spark.createDataFrame([(*r, "f", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, n_turns int")
    out = got(chat.read_back(chat.format_conversations(df)))
    assert out == {1: want([("user", ""), ("user", ""), ("assistant", "a"), ("assistant", "b")]), None: want([("", "x")]), 2: want([("assistant", ""), ("assistant", "z" * 200_000)])}
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
