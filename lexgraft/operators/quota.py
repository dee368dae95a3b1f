"""Room shared by many takers: edges that are accepted in one order while their targets have room."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexgraft.sources.files import kept

ORDER = ("place", "owner", "seq", "symbol", "target")


def allocate(edges: DataFrame, taken: DataFrame, limit: int) -> DataFrame:
    """Of edges (owner, place, seq, symbol, target, needed) those that get room, as one pass over (place, owner, seq, symbol, target) grants it.

    A target has room for limit - base edges (taken: target, base; 0 if missing). An owner whose needed edge gets
    none takes no room at all. Owners have one needed edge at most, their first.

    All that one target's edges must know of another is where that one is full: after which edge. For targets wanted
    more often than they have room this place is taken between two bounds: the edge that fills it if all owners that may
    stand do, and the one that does if those alone stand of which it is sure. A needed edge asks in any case. Each round
    makes bounds from those before, until both agree everywhere; the first open owner is decided by each at least. A
    round ranks only `limit` edges of a target, which are cut before they are shuffled, and writes the bounds alone.
    """
    at = F.struct(F.lit(1).alias("within"), *ORDER)
    kinds = dict(edges.dtypes)
    #: Before and after all edges.
    end = lambda n: F.struct(F.lit(n).alias("within"), *(F.lit(None).cast(kinds[c]).alias(c) for c in ORDER))
    room = edges.groupBy("target").agg(F.count("*").alias("wanted")).join(taken, "target", "left")
    room = room.select("target", "wanted", F.greatest(F.lit(0), F.lit(limit) - F.coalesce("base", F.lit(0))).alias("room"))
    full = kept(room.filter("wanted > room").select("target", "room"))
    if full.isEmpty():
        return edges.select("owner", "place", "seq", "symbol", "target", "needed")
    # the owners whose needed edge is at such a target: which one, and from which place on
    tied = edges.filter("needed").join(full.select("target"), "target", "left_semi").select("owner", F.col("target").alias("held"), at.alias("since"))
    asked = kept(edges.join(full.select("target"), "target", "left_semi").join(tied, "owner", "left").select("target", at.alias("at"), "needed", "held", "since"))
    bounds = kept(full.select("target", end(0).alias("low"), end(2).alias("high")))
    while True:
        met = asked.join(held(bounds), "held", "left")
        before = lambda bound: F.col("needed") | F.col("held").isNull() | (F.col("since") <= F.col(bound))
        # (low: all that may stand are counted; high: all that are sure)
        counts = F.array_compact(F.array(F.when(before("held_high"), "low"), F.when(before("held_low"), "high")))
        rows = met.select("target", F.explode(counts).alias("bound"), "at")
        rank = F.row_number().over(Window.partitionBy("target", "bound").orderBy("at"))
        first = rows.withColumn("rank", rank).filter(F.col("rank") <= limit).join(full, "target").filter("rank <= room")
        last = lambda bound: F.when(F.col(f"{bound}_n") < F.col("room"), end(2)).otherwise(F.coalesce(f"{bound}_at", end(0))).alias(bound)
        of = lambda bound: [F.count_if(F.col("bound") == bound).alias(f"{bound}_n"), F.max(F.when(F.col("bound") == bound, F.col("at"))).alias(f"{bound}_at")]
        ends = full.join(first.groupBy("target").agg(*of("low"), *of("high")), "target", "left").fillna(0, ["low_n", "high_n"])
        bounds = kept(ends.select("target", last("low"), last("high")))
        if bounds.filter("low <> high").isEmpty():
            break
    where = bounds.select("target", F.col("low").alias("last"))
    stands = edges.join(tied.join(held(bounds), "held").select("owner", F.col("since") <= F.col("held_low")).toDF("owner", "stands"), "owner", "left").filter(F.coalesce("stands", F.lit(True)))
    return stands.join(where, "target", "left").filter(F.col("last").isNull() | (at <= F.col("last"))).select("owner", "place", "seq", "symbol", "target", "needed")


def held(bounds: DataFrame) -> DataFrame:
    """The bounds by the target that holds an owner's needed edge."""
    return bounds.select(F.col("target").alias("held"), F.col("low").alias("held_low"), F.col("high").alias("held_high"))
