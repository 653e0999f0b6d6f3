"""Shared pieces of the corpus operators: table access, shared files, Arrow helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship_package, shuffle_files_go

#: Rows in an Arrow batch; with whole texts in a row this bounds a Python worker's memory.
ARROW_ROWS = 256
ARROW_BYTES = 8 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_arrow(spark: SparkSession) -> None:
    """Keep Arrow batches small in rows and bytes, so that long texts cannot fill a worker."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder all executors share (spark.checkpoint.dir).

    Only a local master, whose executors are the driver, may do without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="muniscope-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/muniscope/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    The write's shuffle files go when it is done."""
    spark = df.sparkSession
    path = shared_dir(spark, tag)
    with shuffle_files_go(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing will read any more."""
    for df in tables:
        spark = df.sparkSession
        own = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/muniscope/".split(":", 1)[-1].lstrip("/")
        jvm = spark.sparkContext._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if own in folder:  # never a source table
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores before it: a column that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_keyed(docs: DataFrame, name: str = "doc_id") -> tuple[DataFrame, str]:
    """``docs`` with a column of type long that names each row, and that column's name.

    Where every row has an id (column ``name``) of its own, that is the key. Else ids say nothing of rows: they are numbered
    in a written copy, so that every later pass sees the same numbers. Results are the same either way."""
    key = free_name(docs, "_row")
    doc_id = F.col(name).cast("long")
    per_id = docs.groupBy(doc_id.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    if per_id.where("k IS NULL OR n > 1").limit(1).count():
        return materialise(docs.withColumn(key, F.monotonically_increasing_id()), "rows"), key
    return docs.withColumn(key, doc_id), key


#: A group of more than this share of all rows is hot; so there are at most HOT_SHARE of them.
HOT_SHARE = 1_000


def join_groups(rows: DataFrame, groups: DataFrame, key: list[str], size: str, total: int) -> DataFrame:
    """Inner join of rows with the one row their group has; ``size`` is the group's number of rows of ``total``.

    Hot groups, at most HOT_SHARE, are broadcast, so their rows stay where they are; all others are joined
    by a shuffle in which no key has more than a HOT_SHARE-th of the rows."""
    hot = F.col(size) * HOT_SHARE >= F.lit(total)
    few = F.broadcast(groups.where(hot))
    met = rows.join(few, key)
    rest = rows.join(F.broadcast(groups.where(hot).select(*key)), key, "left_anti").join(groups.where(~hot), key)
    return met.unionByName(rest)


def utf8(column: str = "text"):
    """The column's UTF-8 bytes; null is the empty text."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def record_batch(schema: pa.Schema, *columns: Iterable) -> pa.RecordBatch:
    arrays = [
        c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def give_back() -> None:
    """Return freed memory to the system at a task's end: a Python worker lives on for tasks that need less."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def map_rows(df: DataFrame, rows, schema: str | StructType) -> DataFrame:
    """mapInArrow over ``rows(batch) -> RecordBatch | iterator of them``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = rows(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
        give_back()

    bound_arrow(df.sparkSession)
    return df.mapInArrow(run, schema)
