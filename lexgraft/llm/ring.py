"""Sharding on a consistent-hash ring with virtual nodes and bounded loads; law: bytes.

Every shard has `nodes` points on a ring of 64-bit hashes. A document's key is the hash of its text, so equal
texts have one place; its shard is the owner of the next point clockwise, as long as that shard has room. Keys
overflowing a full shard continue clockwise to the next point of a shard with room.

Who overflows doesn't depend on the order of arrival. All keys stand in one order: first texts whose rows hold
over 1 / FINE of a shard's share, by falling size, then all others by a second hash, in BINS steps. The first kind is
at most FINE for each shard, whatever the corpus; they are placed one by one in the driver, each where all
its rows fit. If they fit nowhere, the rows, numbered by id, fill one shard after the other clockwise. The others
are summed by arc of the ring and step, a table of at most arcs x steps cells at any size; the steps are
replayed on it with a shard closed from the step on in which it reaches the level, and the level is the least at which
every key finds a shard. What comes out is a route from arc and step to shard, which each row looks up.

So each shard holds its even share of bytes to within a step or, where larger, a document; one more shard
takes rows from all others, and what moves besides is what their lower level sends on.

Results: a null text has no bytes but keeps its overhead; a null id is an id of its own, before all others. Rows
that repeat each other are rows of their own, one after the other. Very long texts are whole; one that is
over the level stands alone. An empty table gives no rows. sharded() reads the named columns only; documents_in_shards()
keeps columns of any name and replaces `shard` and `slot`.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgraft.llm.common import dropped, table, written
from lexgraft.llm.mixing import running

NODES = 64
BINS = 512
FINE = 512
OVERHEAD = 16


@dataclass
class Ring:
    points: np.ndarray
    owner: np.ndarray
    shards: int

    def arcs(self, keys: np.ndarray) -> np.ndarray:
        """The number of the next point clockwise."""
        return np.searchsorted(self.points, keys) % len(self.points)

    def clockwise(self, arc: int) -> np.ndarray:
        """Shards in the order in which a key on this arc meets them, repeats included."""
        return np.concatenate([self.owner[arc:], self.owner[:arc]])

    def route(self, is_open: np.ndarray) -> np.ndarray:
        """For each arc, the owner of the next point whose shard is open."""
        n = len(self.owner)
        at = np.where(is_open[self.owner], np.arange(n), 2 * n)
        ahead = np.minimum.accumulate(at[::-1])[::-1]
        return self.owner[np.where(ahead < n, ahead, at.min())]


def ring(shards: int, nodes: int = NODES) -> Ring:
    points = [(int.from_bytes(blake2b(f"{s}:{v}".encode(), digest_size=8).digest(), "little", signed=True), s) for s in range(shards) for v in range(nodes)]
    points.sort()
    return Ring(np.array([p for p, _ in points], np.int64), np.array([s for _, s in points], np.int32), shards)


def even_level(total: int, alone: list[int], shards: int) -> float:
    """What a shard has to hold if documents larger than that take a shard each."""
    alone, level = sorted(alone, reverse=True), total / shards
    for i, size in enumerate(alone[: shards - 1]):
        if size <= level:
            break
        total -= size
        level = total / (shards - i - 1)
    return level


def place_large(at: Ring, large: list[tuple[int, int, int]], level: float) -> tuple[list[tuple[int, int, int, int]], np.ndarray]:
    """((key, first, last, shard) of each run of rows, the shards' loads) for texts (key, bytes, rows), largest first."""
    loads, out = np.zeros(at.shards, np.int64), []
    for key, size, rows in sorted(large, key=lambda x: (-x[1], x[0])):
        order = at.clockwise(int(at.arcs(np.array([key]))[0]))
        fits = np.flatnonzero(loads[order] + size <= level)
        if len(fits):
            runs = [(0, rows, int(order[fits[0]]))]
        elif rows == 1:
            runs = [(0, 1, int(order[np.argmin(loads[order])]))]
        else:
            each, clockwise = size // rows, list(dict.fromkeys(order.tolist()))
            room, left = {}, rows
            for s in clockwise:
                room[s] = max(0, min(left, int((level - loads[s]) // each)))
                left -= room[s]
            while left > 0:  # under a row for each shard
                s = min(clockwise, key=lambda s: loads[s] + each * room[s])
                room[s] += 1
                left -= 1
            runs, first = [], 0
            for s in filter(room.get, clockwise):
                runs.append((first, first + room[s], s))
                first += room[s]
        for first, last, s in runs:
            loads[s] += size * (last - first) // rows
            out.append((key, first, last - 1, s))
    return out, loads


def replay(at: Ring, loads: np.ndarray, steps: list[tuple[int, np.ndarray, np.ndarray]], level: float) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]] | None:
    """The loads, and the routes with the step from which each holds; None if all shards close before the last step."""
    loads = loads.astype(float)
    is_open = loads < level
    if not is_open.any():
        return None
    routes = [(0, at.route(is_open))]
    for step, arcs, sizes in steps:
        if not is_open.any():
            return None
        loads += np.bincount(routes[-1][1][arcs], weights=sizes, minlength=at.shards)
        closed = is_open & (loads >= level)
        if closed.any():
            is_open &= ~closed
            if is_open.any():
                routes.append((step + 1, at.route(is_open)))
    return loads, routes


def place_small(at: Ring, loads: np.ndarray, cells: pd.DataFrame, total: int) -> list[tuple[int, np.ndarray]]:
    """Routes at the least level at which all of cells (arc, bin, size) find a shard."""
    steps = [(int(b), g["arc"].to_numpy(), g["size"].to_numpy(float)) for b, g in cells.sort_values(["bin", "arc"]).groupby("bin")]
    low, high = 0.0, max(total / at.shards, float(loads.min()) + 1)
    best = replay(at, loads, steps, high)
    for _ in range(40):
        middle = (low + high) / 2
        found = replay(at, loads, steps, middle)
        low, high, best = (middle, high, best) if found is None else (low, middle, found)
    return best[1]


def keyed(docs: DataFrame, at: Ring, id_col: str, text_col: str, row: Column) -> DataFrame:
    """Thin rows: row, id, size, text_crc32, key (its place on the ring), arc, bin (its step)."""

    @F.pandas_udf("int")
    def arc(keys: pd.Series) -> pd.Series:
        return pd.Series(at.arcs(keys.to_numpy()).astype(np.int32))

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    thin = docs.select(row.alias("row"), F.col(id_col).alias("id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"))
    return thin.withColumns({"arc": arc("key"), "bin": F.pmod(F.xxhash64("key"), F.lit(BINS)).cast("int")})


def sharded(docs: DataFrame, shards: int = 40, nodes: int = NODES, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None) -> DataFrame:
    """row, id_col, size, text_crc32, home (the shard without bounds), shard, slot (gapless from 0 in each shard)."""
    spark, at = docs.sparkSession, ring(shards, nodes)
    thin = written(keyed(docs, at, id_col, text_col, F.monotonically_increasing_id() if row is None else row), "keyed")
    total = thin.agg(F.sum("size")).first()[0] or 0
    groups = thin.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    large = [tuple(r) for r in groups.filter(F.col("size") * (FINE * shards) > total).collect()]  # fewer than FINE * shards, as their sizes add up to the total at most
    runs, loads = place_large(at, large, even_level(total, [size for _, size, rows in large if rows == 1], shards))
    whole = {key for key, _, _ in large} - {key for key, first, _, _ in runs if first}
    table_of = lambda found, schema: F.broadcast(spark.createDataFrame(found, schema))
    keys = table_of([(k,) for k, _, _ in large], "key long")
    cells = thin.join(keys, "key", "left_anti").groupBy("arc", "bin").agg(F.sum("size").alias("size")).toArrow().to_pandas()
    routes = place_small(at, loads, cells, total)
    since, shard_of = np.array([s for s, _ in routes]), np.stack([r for _, r in routes])

    @F.pandas_udf("int")
    def routed(arcs: pd.Series, bins: pd.Series) -> pd.Series:
        epoch = np.searchsorted(since, bins.to_numpy(), side="right") - 1
        return pd.Series(shard_of[epoch, arcs.to_numpy()].astype(np.int32))

    @F.pandas_udf("int")
    def home(arcs: pd.Series) -> pd.Series:
        return pd.Series(at.owner[arcs.to_numpy()])

    cut = [(k,) for k, _, _ in large if k not in whole]
    numbered, scratch = thin.withColumn("number", F.lit(0).cast("long")), [thin]
    if cut:
        numbered = numbered.join(table_of(cut, "key long"), "key", "left_anti")
        some = running(thin.join(table_of(cut, "key long"), "key", "left_semi").withColumn("one", F.lit(1)), ["key", "id", "row"], "one", "number", ["key"])
        numbered = numbered.unionByName(some.withColumn("number", F.col("number") - 1).drop("one"))
        scratch.append(some)
    held = table_of(runs, "key long, first long, last long, held int").withColumnRenamed("key", "held_key")
    found = numbered.join(held, (F.col("key") == F.col("held_key")) & F.col("number").between(F.col("first"), F.col("last")), "left")
    found = found.select("row", "id", "size", "text_crc32", "key", home("arc").alias("home"), F.coalesce("held", routed("arc", "bin")).alias("shard"), F.lit(1).alias("one"))
    placed = running(found, ["shard", "key", "id", "row"], "one", "slot", ["shard"])
    out = written(placed.select("row", F.col("id").alias(id_col), "size", "text_crc32", "home", "shard", (F.col("slot") - 1).alias("slot")), "shards")
    dropped(placed, *scratch)
    return out


def documents_in_shards(docs: DataFrame, shards: int = 40, nodes: int = NODES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with all columns, their shard and their slot in it."""
    packed = written(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row")), "packed")
    plan = sharded(packed.select(F.col(f"doc.`{id_col}`").alias("id"), F.col(f"doc.`{text_col}`").alias("text"), "row"), shards, nodes, "id", "text", F.col("row"))
    rest = [F.col(f"doc.`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    return packed.join(plan.select("row", "shard", "slot"), "row").select(*rest, "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 40, **kwargs) -> None:
    """Parquet under shard=...: files of a shard hold ranges of slots, each in order."""
    placed = documents_in_shards(docs, shards, **kwargs)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op13_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharded(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home")


QUERIES = {"op13_ring": op13_ring}
SQL: dict[str, str] = {}
