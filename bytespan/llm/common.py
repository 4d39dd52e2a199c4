"""What several operators share: shared-storage checkpoints, salted joins, column names that clash with nothing."""

from __future__ import annotations

import gc
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: With this Spark deletes a query's shuffle files when the query ends; what saved() writes is all that stays of it.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="bytespan-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, wherever they run: Spark serves it to them as a zip file, once a session."""
    context, name = spark.sparkContext, "bytespan_workers.zip"
    if any(name in f for f in context.listFiles):
        return
    root = Path(__file__).resolve().parents[1]
    made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='bytespan-')}/bytespan_workers", "zip", root.parent, root.name)
    context.addPyFile(made)


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it again.

    Unlike persisted blocks these files outlive any executor. A later run with
    the same inputs writes new files; none is read by name again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/bytespan/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete saved() tables after their last use, and let the driver's JVM collect finished queries, since only then
    does Spark delete their shuffle files. Nothing that is still to run may read them."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    if session := SparkSession.getActiveSession():
        session._jvm.System.gc()


def small(df: DataFrame, most: int = 500_000) -> DataFrame:
    """A saved table of short rows, marked for broadcast if it was counted to have at most so many; else as it is, to be joined by a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def tasks(df: DataFrame) -> int:
    """The session's number of shuffle partitions, for stages whose work isn't in proportion to their bytes: a number
    that is given is not coalesced."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df, in any case, doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def salted(small: DataFrame, salts: int, name: str) -> DataFrame:
    """Each row of small once for every salt, so that rows of a hot key on the other side can be spread."""
    return small.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def salt_of(salts: int, *cols: Column | str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the undirected graph of edges (a, b): the smallest node that can be reached.

    Every round lets each node point to the smallest neighbour of its
    neighbourhood and then halves the pointers' paths, so the number of rounds
    follows the logarithm of the longest path. Rounds are written to shared
    storage; only a count of changes comes to the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = saved(both.filter(F.col("a") != F.col("b")))
    labels = held = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("up"))
        hop = labels.select(F.col("node").alias("up"), F.col("component").alias("far"))
        # a pointer's own target also learns of the smaller label, so that long chains collapse
        tell = step.groupBy(F.col("old").alias("node")).agg(F.min("up").alias("told"))
        step = step.join(hop, "up").select("node", "old", F.least("up", "far").alias("new")).join(tell, "node", "left")
        step = saved(step.select("node", "old", F.least("new", "told").alias("component")))
        changed = step.filter(F.col("old") != F.col("component")).limit(1).count()
        discard(held)
        labels, held = step.select("node", "component"), step
        if not changed:
            discard(both)
            return labels
