"""Shared plumbing: table access, scratch tables in the cluster's shared folder, connected components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local-mode session may lack it; then a temporary folder is made once per session.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="newsloom-"))
    return sc.getCheckpointDir().rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/newsloom-{uuid.uuid4().hex}"
        self.n = 0

    def cut(self, df: DataFrame, *partition_by: str) -> DataFrame:
        """Writes ``df`` and returns it as read back."""
        self.n += 1
        path = f"{self.root}/t{self.n}"
        # small row groups: a writer holds one in the executor's heap
        writer = df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20)
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        if path := getattr(df, "_scratch_path", None):
            self._delete(path)

    def drop_after(self, n: int, *kept: DataFrame) -> None:
        """Deletes the tables written after the first ``n``, but those kept: for when nothing that is still to run reads them."""
        stay = {getattr(df, "_scratch_path", None) for df in kept}
        for k in range(n + 1, self.n + 1):
            if (path := f"{self.root}/t{k}") not in stay:
                self._delete(path)

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of finished plans now rather than at some later collection.

        Py4J lets go of what Python has dropped in a thread of its own that looks once a second; before that, Java keeps the plans.
        """
        gc.collect()
        time.sleep(1.2)
        self.spark.sparkContext._jvm.System.gc()


@contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """Within it, writes hand Python workers so many rows at a time: whole texts are long rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def partitioned_joins(spark: SparkSession):
    """Within it, joins take rows as they are partitioned by some of the keys, rather than shuffle them by all."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list as (node, root), root the least node; isolated nodes have no row.

    Alternating large-star and small-star rounds: the number of edges never grows, and each round at least
    shortens every path by a constant factor. Each round is a written table, so nothing is recomputed when an
    executor is lost. Null ends are dropped; an empty list gives an empty result.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    e = scratch.cut(e)
    state = None
    while True:
        row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).head()
        now = (row["n"], row["h"])
        if now == state or not row["n"]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        state = now
        least = (
            e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            .groupBy("a").agg(F.min("b").alias("lo"))
            .select(F.col("a").alias("b"), F.least("a", "lo").alias("lo"))
        )
        large = e.join(least, "b").select("a", F.col("lo").alias("b")).where("a <> b").distinct()
        lo = large.groupBy("a").agg(F.min("b").alias("lo"))
        small = large.join(lo, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("lo").alias("b")), F.struct(F.col("b").alias("a"), F.col("lo").alias("b")),
        )).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        following = scratch.cut(small)
        scratch.drop(e)
        e = following
