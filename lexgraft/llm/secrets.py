"""Secret scan, in DataFrame operations only: fixed forms, and strings that pass a battery of randomness tests.

Base spans: assignments to a password-like name, access key ids and long hex runs, each kind leftmost and
non-overlapping. Positions come from the lengths of what lies between the matches.

Method spans ("random"): every run of at least MIN_LENGTH characters of encoded data gets an encoding by the
kinds of characters it holds. Against the encoding's uniform distribution it is tested by chi-squared over the
alphabet, by runs above and below the alphabet's middle, and by serial correlation; the combined p-value is
three times the least. Words and paths give tiny p-values. Within each class of length (powers of two) the
Benjamini-Hochberg procedure at `rate` declares strings not random; among those declared so at most that share
is expected to be random after all. What is left counts as secret. p-values are rounded up to a grid of 1/50 of
a power of ten, so the procedure needs only the counts of grid cells: at most 41 x 1,501 rows for any corpus.

Results: a null text counts as empty; no match gives counts of 0 and the digest of an empty string; rows that
repeat each other get the same result; offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgraft.llm.common import table, written

# The forms of the base spans. Runs too short to count can't hide longer ones in the last two.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

MIN_LENGTH = 20
RUN = rf"[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}"
# Encodings and their alphabets; the first that fits a string is taken.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (
    (r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", DIGITS + "abcdef"),
    (r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", DIGITS + "ABCDEF"),
    (r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", UPPER + "234567"),
    (r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", LOWER + DIGITS),
    (r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+$", UPPER + DIGITS),
    (r"^(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    (r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    (r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
)
GRID = 50
CELLS = 30 * GRID


def found(text: str, pattern: str, kind: str, group: int, least: int) -> Column:
    """Array of (kind, start, end, value) of the pattern's matches whose group has `least` characters."""
    t = F.col(text)
    whole, value = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.regexp_extract_all(t, F.lit(pattern), F.lit(group))
    lengths = F.transform(F.arrays_zip(F.split(t, pattern).alias("a"), whole.alias("b")), lambda p: F.struct(F.length(p["a"]).alias("gap"), F.coalesce(F.length(p["b"]), F.lit(0)).alias("own")))

    def step(a: Column, p: Column) -> Column:
        start = a["at"] + p["gap"]
        return F.struct((start + p["own"]).alias("at"), F.concat(a["starts"], F.array(start)).alias("starts"))

    starts = F.aggregate(lengths, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), step)["starts"]
    spans = F.transform(
        F.arrays_zip(F.slice(starts, F.lit(1), F.size(whole)).alias("s"), whole.alias("w"), value.alias("v")),
        lambda p: F.struct(F.lit(kind).alias("kind"), p["s"].alias("start"), (p["s"] + F.length(p["w"])).alias("end"), p["v"].alias("value")),
    )
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    return F.when(t.rlike(pattern), F.filter(spans, lambda s: F.length(s["value"]) >= least)).otherwise(none)


def tail(z: Column) -> Column:
    """Upper tail of the normal distribution for z >= 0: an upper bound, 13 % off at 0, 2 % at 1; at least 1e-30."""
    z = F.greatest(F.lit(0.0), F.least(z, F.lit(11.0)))
    return F.greatest(F.lit(1e-30), F.least(F.lit(1.0), F.exp(-z * z / 2) * F.lit(2 * 0.7978845608028654) / (3 * z + F.sqrt(z * z + 8))))


def battery(value: Column) -> Column:
    """p-value that the string was drawn evenly from its encoding's alphabet; null if it has no encoding."""

    def one(alphabet: str) -> Column:
        k, n = len(alphabet), F.length(value)
        at = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
        counts = F.transform(F.split(F.lit(alphabet), ""), lambda c: n - F.length(F.replace(value, c, F.lit(""))))
        squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)
        uneven = (squares * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        pairs = F.zip_with(F.slice(at, F.lit(1), n - 1), F.slice(at, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        turns = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + ((p["a"] < k / 2) != (p["b"] < k / 2)).cast("double"))
        runs = F.abs(turns - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        mid = (k - 1) / 2
        product = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["a"] - mid) * (p["b"] - mid))
        serial = F.abs(product) / ((k * k - 1) / 12) / F.sqrt((n - 1).cast("double"))
        return F.least(F.lit(1.0), 3 * F.least(tail(uneven), 2 * tail(runs), 2 * tail(serial)))

    p = F.lit(None).cast("double")
    for form, alphabet in reversed(ENCODINGS):
        p = F.when(value.rlike(form), one(alphabet)).otherwise(p)
    return p


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, base, tried): the base spans by start and kind, and the tested strings (start, end, class, cell)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    base = F.concat(found("text", ASSIGN, "assign", 2, 8), found("text", ACCESS, "access", 0, 16), found("text", HEX, "hex", 0, 32))
    tried = F.transform(
        found("text", RUN, "random", 0, MIN_LENGTH),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.floor(F.log2(F.length(s["value"]))).cast("int").alias("class"), battery(s["value"]).alias("p")),
    )
    cell = lambda s: F.floor(-F.log10(s["p"]) * GRID).cast("int")
    tried = F.transform(F.filter(tried, lambda s: s["p"].isNotNull()), lambda s: F.struct(s["start"], s["end"], s["class"], F.least(cell(s), F.lit(CELLS)).alias("cell")))
    return docs.select("id", F.transform(base, lambda s: F.struct(s["start"].alias("start"), order(s["kind"]).alias("order"), s["end"].alias("end"))).alias("base"), tried.alias("tried"))


def order(kind: Column) -> Column:
    out = F.lit(len(KINDS) - 1)
    for i, k in enumerate(KINDS[:-1]):
        out = F.when(kind == k, i).otherwise(out)
    return out


def thresholds(tried: DataFrame, rate: float) -> dict[int, int]:
    """For each class of length the least cell that Benjamini-Hochberg at `rate` declares not random."""
    cells = tried.select(F.explode("tried").alias("t")).groupBy("t.class", "t.cell").count()
    out, by = {}, {}
    for r in cells.collect():  # at most 41 x 1,501 rows
        by.setdefault(r["class"], {})[r["cell"]] = r["count"]
    for length, counts in by.items():
        total, rank = sum(counts.values()), 0
        for cell in sorted(counts, reverse=True):
            rank += counts[cell]
            if 10 ** (-cell / GRID) <= rate * rank / total:
                out[length] = cell
    return out


def rejected(s: Column, cut: dict[int, int]) -> Column:
    """Whether the string is declared not random."""
    out = F.lit(False)
    for length, cell in cut.items():
        out = out | ((s["class"] == length) & (s["cell"] >= cell))
    return out


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, with commas between."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["order"] + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rate: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    rows = written(scanned(docs, id_col, text_col), "scanned")
    cut = thresholds(rows, rate)
    random = F.filter("tried", lambda s: ~rejected(s, cut))
    random = F.transform(random, lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("order"), s["end"].alias("end")))
    count = lambda i: F.size(F.filter("base", lambda s: s["order"] == i)).cast("long")
    return rows.select(
        F.col("id").alias(id_col),
        *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:-1])),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", random)).alias("spans"),
        F.size(random).cast("long").alias("n_random"),
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op9_secrets": op9_secrets}
SQL: dict[str, str] = {}
