"""A bounded sample of labelled documents, alike at every size of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgraft.llm.common import crc_mod


def sampled(docs: DataFrame, labels: DataFrame, label: str, most: int, wanted: list, id_col: str = "doc_id") -> list:
    """Rows (y, *wanted) of up to `most` labelled documents outside the held-out third, by a hash of their ids.

    A document with several labels has their greatest; null ids and labels are left out. The ids are drawn from
    the labels alone, so the documents need no shuffle: the drawn ids, `most` at most, are broadcast.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & (crc_mod(id_col, 3) != 1))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max(label).cast("int").alias("__y"))
    drawn = F.broadcast(known.orderBy(F.xxhash64("__id"), "__id").limit(most))
    rows = docs.select(F.col(id_col).alias("__own_id"), F.struct(*wanted).alias("__wanted")).join(drawn, F.col("__own_id") == F.col("__id")).select(F.col("__y").alias("y"), "__id", "__wanted.*")
    return sorted(rows.collect(), key=lambda r: r["__id"])


def held_out(column: str):
    return (crc_mod(column, 3) == 1).alias("held_out")
