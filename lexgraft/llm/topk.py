"""Exact top-k inner products by norm-bucketed retrieval.

Components become floor(scale * x). All vectors are range-sorted by length, the longest first, into buckets of
about BUCKET_ROWS; the buckets are visited in levels of growing size, from the longest down. Between levels each
query's k best so far are merged, and its k-th best product goes along to the next one:

- A bucket whose longest vector can't reach that product with any query of a block isn't sent to the block at all
  (blocks hold queries that need about the same length).
- Within a bucket, tile by tile, best / (|q| * l) with the tile's greatest length l is the local cosine threshold.
  Above 1 the tile is skipped. A high one prunes by coordinates: with the largest coordinates of the query as focus,
  so many that what is left of it is shorter than half the threshold, the cosine is at most the focus's part plus
  the product of both rests. A low one prunes by length: candidates shorter than best / |q| are passed over.
- What is left is verified by exact products of whole numbers.

Queries are a stated set: block by block they meet every bucket that may matter, in a cogroup.

Results: vectors that are null, empty or hold a null or a component that is not finite take no part; ties go to
the smaller id; rows that repeat an id are candidates each, except to queries that have that id, and queries each, so
that such a query_id has a list of k for each of its rows; products are exact whole numbers (one of 2**63 or more is
an error); vectors of
other dimensions than the query's are never its candidates; an empty table gives an empty result. Long vectors
are taken whole. Other columns, of any name, play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgraft.llm.common import dropped, table, written

BUCKET_ROWS, QUERY_ROWS, TILE, CHUNK = 2_000, 4_000, 250, 500
#: Ends of the levels, as shares of all buckets.
LEVELS = (1 / 64, 1 / 16, 1 / 4, 1)
#: From this local threshold on coordinates prune; below, lengths do.
STEEP = 0.1
SLACK = 1e-7
#: Up to here sums of products of whole numbers are exact as doubles.
EXACT = 2.0**53
FOUND = "query long, vec_id long, score long, products long"


def whole(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v: array<long>, length, asked): scaled and floored, without vectors that take no part."""
    v = F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    sound = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.filter(sound & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce("__query", F.lit(False)).alias("asked"))
    return kept.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))


def near_enough(unit: np.ndarray, lengths: np.ndarray, directions: np.ndarray, local: np.ndarray) -> np.ndarray:
    """Whether each candidate (rows) can reach each query (columns) by its coordinates, at the queries' local thresholds."""
    order = np.argsort(-np.abs(directions), axis=1)
    squares = np.take_along_axis(directions**2, order, axis=1)
    rest = np.sqrt(np.maximum(0.0, 1 - np.cumsum(squares, axis=1)))  # of the query, after so many coordinates
    width = np.argmax(rest <= np.maximum(local[:, None] / 2, SLACK), axis=1) + (rest.min(axis=1) > np.maximum(local / 2, SLACK)) * directions.shape[1]
    focus = np.zeros_like(directions)
    np.put_along_axis(focus, order, (np.arange(directions.shape[1])[None, :] <= width[:, None]).astype(float), axis=1)
    left = np.sqrt(np.maximum(0.0, 1 - (focus * directions**2).sum(axis=1)))
    most = unit @ (directions * focus).T + np.sqrt(np.maximum(0.0, 1 - unit**2 @ focus.T)) * left[None, :]
    return most * (lengths / lengths[0])[:, None] >= local[None, :] - SLACK


def search(queries: np.ndarray, q_ids: np.ndarray, best: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, names: np.ndarray | None = None) -> list[tuple]:
    """(query, id, product, None) of what may be among the k best, and (query, None, None, products made).

    names: what the queries are called in the result, their ids if left out.

    best: each query's k-th best product so far, minus infinity if there is none. Products are exact below 2**63.
    """
    names, whole_queries = q_ids if names is None else names, queries
    lengths = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
    order = np.lexsort((ids, -lengths))
    whole_vectors, ids, lengths = vectors[order], ids[order], lengths[order]
    queries, vectors = queries.astype(float), whole_vectors.astype(float)
    unit, out = vectors / np.maximum(lengths, 1e-12)[:, None], []
    for c in range(0, len(q_ids), CHUNK):
        q, key, limit = queries[c : c + CHUNK], q_ids[c : c + CHUNK], best[c : c + CHUNK].copy()
        size = np.sqrt((q**2).sum(axis=1))
        direction = q / np.maximum(size, 1e-12)[:, None]
        kept, made = [np.zeros((0, 2), np.int64)] * len(key), np.zeros(len(key), np.int64)
        for a in range(0, len(ids), TILE):
            b = slice(a, a + TILE)
            reach = size * lengths[a]
            local = np.where((limit > 0) & (reach > 0), limit / np.maximum(reach, 1e-12), np.where((limit > 0) & (reach == 0), np.inf, -np.inf))
            likely = np.tile(local[None, :] <= 1 + SLACK, (len(ids[b]), 1))
            steep, flat = np.flatnonzero((local >= STEEP) & (local <= 1 + SLACK)), np.flatnonzero((local > 0) & (local < STEEP))
            if len(steep):
                likely[:, steep] = near_enough(unit[b], lengths[b], direction[steep], local[steep])
            if len(flat):
                likely[:, flat] = lengths[b][:, None] * size[flat][None, :] >= limit[flat][None, :] * (1 - SLACK)
            likely &= ids[b][:, None] != key[None, :]
            for i in np.flatnonzero(likely.any(axis=0)).tolist():
                at = np.flatnonzero(likely[:, i])
                made[i] += len(at)
                product = vectors[b][at] @ q[i] if reach[i] < EXACT else whole_vectors[b][at].astype(object) @ whole_queries[c + i].astype(object)
                rows = np.concatenate([kept[i], np.stack([product.astype(np.int64), ids[b][at]], axis=1)])
                kept[i] = rows[np.lexsort((rows[:, 1], -rows[:, 0]))[:k]]
                if len(kept[i]) == k:
                    limit[i] = max(limit[i], float(kept[i][-1, 0]))
        for i in np.flatnonzero(made).tolist():
            name = int(names[c + i])
            out += [(name, int(x), int(s), None) for s, x in kept[i]] + [(name, None, None, int(made[i]))]
    return out


def visited(rows: DataFrame, asked: DataFrame, blocks: int, k: int) -> DataFrame:
    """FOUND: what the queries (query, id, v, length, best, block) find in the buckets of rows."""
    limits = rows.groupBy("bucket").agg(F.max("length").alias("longest")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    needs = asked.groupBy("block").agg(F.min(F.coalesce("need", F.lit(-1.0))).alias("need"))
    pairs = limits.join(needs, "block").filter(F.col("longest") * (1 + SLACK) >= F.col("need")).select("bucket", "block")
    pairs = written(pairs, "pairs")
    one = rows.join(pairs, "bucket").select("bucket", "block", "id", "v")
    two = asked.join(pairs, "block").select("bucket", "block", "query", F.col("id").alias("query_id"), F.col("v").alias("q"), "best")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            sizes = left.v.map(len).to_numpy(), right.q.map(len).to_numpy()
            for d in np.unique(sizes[1]):
                a, b = left[sizes[0] == d], right[sizes[1] == d]
                if len(a):
                    limit = b.best.to_numpy(dtype=float, na_value=np.nan)
                    found += search(np.stack(b.q.to_numpy()), b.query_id.to_numpy(), np.where(np.isnan(limit), -np.inf, limit), np.stack(a.v.to_numpy()), a.id.to_numpy(), k, b["query"].to_numpy())
        columns = list(zip(*found, strict=True)) or [()] * 4
        return pd.DataFrame({name: pd.array(list(c), dtype="Int64") for name, c in zip(["query", "vec_id", "score", "products"], columns, strict=True)})

    return one.groupBy("bucket", "block").cogroup(two.groupBy("bucket", "block")).applyInPandas(run, FOUND)


def ranged(df: DataFrame, n: int, *order: Column | str, name: str) -> tuple[DataFrame, int]:
    """(df as a table with column `name`: n ranges at most of the order, however many partitions they have; their number)."""
    dealt = written(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), name)
    parts = (dealt.agg(F.max("__part").alias("p")).collect()[0].p or 0) + 1
    number = F.floor(F.col("__part") * min(n, parts) / parts).cast("int")
    out = dealt.withColumn(name, number).drop("__part")
    out.scratch = dealt.scratch
    return out, min(n, parts)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, products) for each row of vectors that is_query holds for, against all other rows.

    products: how many exact products the query has cost.
    """
    kept = whole(vectors.withColumn("__query", is_query), id_col, vector_col, scale)
    sums = kept.agg(F.count("*").alias("n"), F.sum(F.col("asked").cast("long")).alias("m")).collect()[0]
    n, m = sums.n, sums.m or 0
    rows, last = ranged(kept, max(1, -(-n // BUCKET_ROWS)), F.desc("length"), "id", name="bucket")
    queries = written(rows.filter("asked").select(F.monotonically_increasing_id().alias("query"), "id", "v", "length"), "queries")
    blocks, begin, found, made = max(1, -(-m // QUERY_ROWS)), 0, None, None
    by = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    for end in sorted({-(-int(last * 64 * share) // 64) or 1 for share in LEVELS}):
        if found is None:
            asked = queries.withColumn("best", F.lit(None).cast("long"))
        else:
            kth = found.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("best"))
            asked = queries.join(kth, "query", "left")
        need = F.when((F.col("best") > 0) & (F.col("length") > 0), F.col("best") / F.col("length"))
        asked, most = ranged(asked.withColumn("need", need), blocks, "need", "id", name="block")
        met = written(visited(rows.filter((F.col("bucket") >= begin) & (F.col("bucket") < end)), asked, most, k), "met")
        new = met.filter("vec_id IS NOT NULL").select("query", "vec_id", "score")
        new = new if found is None else found.union(new)
        old, found = found, written(new.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).drop("rank"), "found")
        costs = met.filter("products IS NOT NULL").groupBy("query").agg(F.sum("products").alias("products"))
        costs = written(costs if made is None else made.union(costs).groupBy("query").agg(F.sum("products").alias("products")), "products")
        dropped(asked, met, *([] if old is None else [old, made]))
        made, begin = costs, end
    ranked = found.withColumn("rank", F.row_number().over(by)).join(queries.select("query", F.col("id").alias("query_id")), "query")
    return ranked.join(made, "query").select("query_id", "rank", "vec_id", "score", "products")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0).drop("products")


#: In DuckDB: every query against all rows.
SQL = {
    "op7_topk": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), n AS (
    SELECT *, row_number() OVER () AS query FROM v WHERE vec_id % 50 = 0
), s AS (
    SELECT q.query, q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
    FROM n q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
    SELECT query_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
}
QUERIES = {"op7_topk": op7_topk}
