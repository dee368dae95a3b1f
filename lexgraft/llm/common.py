"""What the operators of this subpackage share: input tables, shared scratch tables, tokens, components."""

from __future__ import annotations

import atexit
import functools
import inspect
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII capitals to small letters, on UTF-8 bytes; no byte of a longer sequence is touched.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Java pattern of a word: what stands between space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder for scratch tables; one of our own only where the session names none and has one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="lexgraft-")
        atexit.register(shutil.rmtree, path, True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, name: str, conf: dict[str, str] | None = None) -> DataFrame:
    """df as a table in the shared folder, read again: its lineage is cut and its rows outlive executors.

    conf: settings that hold while it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    conf = {CLEAN_UP: "true"} | (conf or {})  # the shuffle files go as soon as the table is there
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df.select("*").write.option("compression", "zstd").parquet(path)  # planned under these settings
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def under_own_names(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """operator(docs, ..) with the columns of docs under names of their own, so that none clashes with its private ones.

    The result has them back under theirs; what it adds replaces columns of the same name.
    """
    kind = inspect.signature(operator)

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        given = kind.bind(docs, *args, **kwargs)
        given.apply_defaults()
        names, own = docs.columns, [f"__own{i}" for i in range(len(docs.columns))]
        given.arguments["docs"] = docs.toDF(*own)
        for which in ("id_col", "text_col", "source_col"):
            if which in given.arguments:
                given.arguments[which] = own[names.index(given.arguments[which])]
        out = operator(*given.args, **given.kwargs)
        back, added = dict(zip(own, names, strict=True)), {c for c in out.columns if c not in own}
        return out.select(*(F.col(c).alias(back.get(c, c)) for c in out.columns if back.get(c, "") not in added))

    return run


def crc_mod(column: str, by: int) -> Column:
    """crc32 of the value as text, modulo by; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % by, F.lit(0))


def hamming(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): the least node that can be reached, for each node of edges (u, v: long).

    Labels go along the links to the least neighbour and then jump to their own label's label, so that
    the number of rounds follows the logarithm of a chain's length. Each round is a written table. Both
    joins have plain shuffles on either side, so a node with very many links can be split.
    """
    links = written(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    if links.isEmpty():
        return links.select(F.col("u").alias("node"), F.col("v").alias("label"))
    labels = written(links.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("label")), "labels")
    for _ in range(rounds):
        told = links.join(labels.select(F.col("node").alias("u"), "label"), "u").groupBy(F.col("v").alias("node")).agg(F.min("label").alias("heard"))
        near = labels.select("node", "label").join(told, "node").select("node", F.least("label", "heard").alias("label"), F.col("label").alias("old"))
        near = written(near, "labels")
        jump = near.join(near.select(F.col("node").alias("label"), F.col("label").alias("next")), "label")
        old, labels = labels, written(jump.select("node", F.least("label", "next").alias("label"), "old"), "labels")
        dropped(old, near)
        if labels.filter("label <> old").limit(1).count() == 0:
            return labels.select("node", "label")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
