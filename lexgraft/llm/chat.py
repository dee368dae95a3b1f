"""Chat formatting with a loss mask that is aligned by offsets.

A conversation is rendered whole: each turn is TURN role TEXT text END. The three markers are special tokens of
the tokenizer, so no token ever reaches over a marker. Control strings inside roles and texts (markers such as
`<|...|>`, `<s>`, `</s>`, `[INST]`, `[/INST]`) get one backslash after their first character, and those that
already have backslashes there one more; taking one away restores the text exactly.

The rendered string is encoded once with offsets. The sorted spans of assistant texts are intersected with the
sorted token spans by binary search; those tokens make up the loss mask.

Results: rows of a conversation are ordered by turn (null first), then role and text; null roles and texts count
as empty; a null conv_id is a conversation of its own; an empty table gives an empty one. A conversation is one
unit of work, as its rendering is one string.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgraft.llm.common import table

# The template's markers and the forms of control strings.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = re.compile(r"([<\[])(\\*)(\||/?s>|/?INST\])")
ESCAPED = re.compile(r"([<\[])\\(\\*)(\||/?s>|/?INST\])")
RENDERED = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
FORMATTED = "conv_id long, n_turns long, formatted string, token_ids array<int>, starts array<int>, ends array<int>, loss_mask array<boolean>"
_loaded: dict = {}


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def tokenizer(path: str):
    """The tokenizer with the markers as special tokens and offsets that keep white space; once for each worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, processors

        t = Tokenizer.from_file(path)
        t.post_processor = processors.ByteLevel(trim_offsets=False)
        t.add_special_tokens([TURN, TEXT, END])
        _loaded[path] = t
    return _loaded[path]


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The rendered conversation and the spans (start, end) of its assistant texts, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        at += len(head)
        if role == "assistant":
            spans.append((at, at + len(body)))
        at += len(body) + len(END)
        parts += [head, body, END]
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def masked(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which of the sorted token spans lie in one of the sorted spans."""
    change = np.zeros(len(starts) + 1, np.int64)
    low, high = np.searchsorted(ends, spans[:, 0], "right"), np.searchsorted(starts, spans[:, 1], "left")
    some = high > low
    np.add.at(change, low[some], 1)
    np.add.at(change, high[some], -1)
    return np.cumsum(change[:-1]) > 0


def turns_of(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(a), unescape(b)) for a, b in RENDERED.findall(formatted)]


def loss_texts(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """What the masked tokens cover: one piece for each unbroken run of them, unescaped."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [unescape(formatted[starts[a] : ends[b - 1]]) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def format_conversations(rows: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """One row for each conversation of rows (conv_id, turn, role, text); see FORMATTED."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("token_ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_()))])
        t = tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for key, turns in zip(batch.column(0)[at : at + 256].to_pylist(), batch.column(1)[at : at + 256].to_pylist(), strict=True):
                    text, spans = render([(x["role"], x["text"]) for x in turns])
                    code = t.encode(text, add_special_tokens=False)
                    offsets = np.array(code.offsets, np.int64).reshape(-1, 2)
                    mask = masked(offsets[:, 0], offsets[:, 1], spans)
                    out.append({"conv_id": key, "n_turns": len(turns), "formatted": text, "token_ids": code.ids, "starts": offsets[:, 0].tolist(), "ends": offsets[:, 1].tolist(), "loss_mask": mask.tolist()})
                yield pa.RecordBatch.from_pylist(out, schema)

    return whole.mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the output of format_conversations holds, read from that output alone."""
    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in kinds.split(", ")]
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                key, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                starts, ends, mask = (np.asarray(batch.column(k)[i].values.to_numpy(zero_copy_only=False)) for k in (2, 3, 4))
                turns, loss = turns_of(text), "".join(loss_texts(text, starts, ends, mask))
                spoken = "".join(f"{a}\n{b}\n" for a, b in turns)
                out.append((key, len(turns), hashlib.sha256(spoken.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), len(starts), int(mask.sum())))
            columns = list(zip(*out, strict=True)) or [[] for _ in names]
            types = [pa.string() if "sha256" in n else pa.int64() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    return formatted.select("conv_id", "formatted", "starts", "ends", "loss_mask").mapInArrow(run, kinds)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(rows.unionByName(extra)))


QUERIES = {"op10_chat": op10_chat}
SQL: dict[str, str] = {}
