"""Connected components and degrees over edge tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shuffle_files_go


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names. Only a local master, whose executors are
    the driver, may do without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="muniscope-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{_own(spark, root)}/{tag}-{uuid.uuid4().hex}"


def _own(spark: SparkSession, root: str) -> str:
    return f"{root.rstrip('/')}/muniscope/{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Delete every intermediate table this application has written, once its results have been read or stored."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own(spark, root))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shared_table(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared checkpoint folder and read again: a short lineage that outlives executors."""
    spark = df.sparkSession
    path = shared_folder(spark, tag)
    with shuffle_files_go(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of shared tables that nothing will read any more."""
    for df in tables:
        spark = df.sparkSession
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/muniscope/" in folder:  # never a source table
                jpath(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath(folder), True)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node each node reaches. Labels spread along edges and then
    jump to their label's label, so rounds grow with the logarithm of the longest path."""
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = shared_table(pairs.union(pairs.select("b", "a")).distinct(), "edges")
    first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_least"))
    labels = shared_table(first.select("node", F.least("node", "_least").alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        closer = labels.join(near, labels["node"] == near["a"]).select("node", "component", F.least("component", "near").alias("next"))
        up = labels.select(F.col("node").alias("_n"), F.col("component").alias("_up"))
        jumped = F.least("next", F.coalesce("_up", "next"))
        moved = closer.join(up, closer["next"] == up["_n"], "left").select(
            "node", jumped.alias("component"), (jumped != F.col("component")).alias("moved")
        )
        moved = shared_table(moved, "labels")
        discard(labels)
        labels = moved.select("node", "component")
        if not moved.where("moved").limit(1).count():
            discard(both)
            return labels


def suppress_large(edges: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Edges of components with at most ``most`` nodes."""
    small = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most)
    keep = labels.join(small, "component").select(F.col("node").alias("a"))
    return edges.join(keep, "a", "left_semi")


def degree_centrality(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(vertex, degree, centrality) of a bipartite graph's vertices, by distinct edges."""
    e = edges.select(F.concat(F.lit(f"{left}:"), left).alias("l"), F.concat(F.lit(f"{right}:"), right).alias("r")).distinct()
    ends = e.select(F.explode(F.array("l", "r")).alias("vertex"))
    degree = ends.groupBy("vertex").agg(F.count(F.lit(1)).alias("degree"))
    total = degree.agg(F.count(F.lit(1)).alias("n"))
    return degree.withColumn("centrality", F.col("degree") / (total.scalar() - 1))
