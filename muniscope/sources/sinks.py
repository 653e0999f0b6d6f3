"""Snapshots, digests and logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def digest(df: DataFrame) -> str:
    """A content digest that does not depend on row order or partitions: row hashes are summed by prefix.

    Equal for equal multisets of rows."""
    row = F.sha2(F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(8)]
    sums = df.agg(F.count(F.lit(1)).alias("n"), *parts)
    return sums.select(F.sha2(F.concat_ws("|", *sums.columns), 256)).first()[0]


def write_snapshot(df: DataFrame, path: str, order: list[str]) -> bool:
    """Sorted Parquet as a new version under ``path``; False if the newest version has that content already.

    A version is written in full under a name of its own and then named in ``path/current``, by a rename of one
    file. Readers (read_snapshot) see the version named there, the old one or the new one, at any moment."""
    spark = df.sparkSession
    fs, jpath = _file_system(spark, path)
    now = digest(df)
    pointer = _pointer(spark, path)
    if pointer and pointer[1] == now:
        return False
    version = f"v-{uuid.uuid4().hex}"
    df.orderBy(*order).write.parquet(f"{path}/{version}")
    # Names of pointers count up; the highest one that exists is current, so that no name is taken away.
    number = (pointer[2] if pointer else 0) + 1
    aside = f"{path}/.{version}"
    out = fs.create(jpath(aside))
    out.write(f"{version} {now}".encode())
    out.close()
    if not fs.rename(jpath(aside), jpath(f"{path}/current-{number:012d}")):
        raise RuntimeError(f"{path} was changed by another writer")
    return True


def drop_old_snapshots(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all versions but the newest ``keep``, which a reader may still have open; the number deleted."""
    fs, jpath = _file_system(spark, path)
    pointers = sorted(f.getPath().getName() for f in fs.listStatus(jpath(path)) if f.getPath().getName().startswith("current-"))
    old = pointers[:-keep]
    for name in old:
        version = spark.read.text(f"{path}/{name}").first()[0].split(" ")[0]
        fs.delete(jpath(f"{path}/{name}"), False)
        fs.delete(jpath(f"{path}/{version}"), True)
    return len(old)


def _pointer(spark: SparkSession, path: str) -> tuple[str, str, int] | None:
    """(version, digest, number) of the newest snapshot."""
    fs, jpath = _file_system(spark, path)
    if not fs.exists(jpath(path)):
        return None
    names = sorted(f.getPath().getName() for f in fs.listStatus(jpath(path)) if f.getPath().getName().startswith("current-"))
    if not names:
        return None
    version, found = spark.read.text(f"{path}/{names[-1]}").first()[0].split(" ")
    return version, found, int(names[-1].rpartition("-")[2])


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    pointer = _pointer(spark, path)
    if not pointer:
        raise FileNotFoundError(f"no snapshot at {path}")
    return spark.read.parquet(f"{path}/{pointer[0]}")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; dates and times in ISO form, nulls empty, quotes doubled."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", '""').option(
        "timestampFormat", "yyyy-MM-dd'T'HH:mm:ss"
    ).csv(path)


def content_cache(images: DataFrame, path: str) -> DataFrame:
    """Images stored once under their md5: appends what is not there yet and returns (md5, image) of all."""
    named = images.select(F.md5("image").alias("md5"), "image")
    insert_if_new(named, path, "md5")
    return images.sparkSession.read.parquet(path)


def backup_before(spark: SparkSession, path: str, tables: list[str]) -> str | None:
    """Copy the folder of tables once before it gets a table it does not have; the copy's path, or None."""
    fs, jpath = _file_system(spark, path)
    if not fs.exists(jpath(path)) or all(fs.exists(jpath(f"{path}/{t}")) for t in tables):
        return None
    aside = f"{path.rstrip('/')}.backup-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    jvm.org.apache.hadoop.fs.FileUtil.copy(fs, jpath(path), fs, jpath(aside), False, conf)
    return aside


def append_audited(actions: DataFrame, log: str, audit: str, actor: str) -> None:
    """Append actions to their log and one line for each to the audit log, with an id of its own."""
    append(actions, log)
    line = F.to_json(F.struct(*actions.columns))
    append(actions.select(F.uuid().alias("audit_id"), F.lit(actor).alias("actor"), F.current_timestamp().alias("at"), line.alias("detail")), audit)


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path
    return jpath(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; NaN is an error, not a value."""
    doubles = [c for c, t in df.dtypes if t in ("double", "float")]
    for c in doubles:
        df = df.withColumn(c, F.when(F.isnan(c), F.raise_error(F.lit(f"NaN in {c}")).cast("double")).otherwise(F.col(c)))
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _file_system(spark, path)
    return fs.exists(jpath(path))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upsert_view(log: DataFrame, key: list[str], at: str) -> DataFrame:
    """The latest row of each key of an append-only log."""
    rest = [c for c in log.columns if c not in key]
    newest = log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(at, *(c for c in rest if c != at))).alias("v"))
    return newest.select(*key, "v.*")


def insert_if_new(new: DataFrame, log_path: str, key: str) -> DataFrame:
    """Append the rows whose key is not on record; returns them. Of rows that share a key the one whose other columns have the
    least hash enters, so a batch that runs again takes the same one."""
    spark = new.sparkSession
    fs, jpath = _file_system(spark, log_path)
    rest = [c for c in new.columns if c != key]
    fresh = new.dropDuplicates([key])
    if rest:
        fresh = new.groupBy(key).agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("_v")).select(key, "_v.*").select(*new.columns)
    if fs.exists(jpath(log_path)):
        fresh = fresh.join(spark.read.parquet(log_path).select(key), key, "left_anti")
    fresh.write.mode("append").parquet(log_path)
    return fresh


def review_sessions(log: DataFrame, session: str, at: str, kind: str) -> DataFrame:
    """(session, hours): sessions with a start and an end after it, from a log of both; others are still open."""
    when = {k: F.min(F.when(F.col(kind) == k, F.col(at))).alias(k) for k in ("start", "end")}
    both = log.groupBy(session).agg(*when.values()).where("`end` >= start")
    seconds = F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))
    return both.select(session, (seconds / 3_600_000_000).alias("hours"))


def referenced_only(files: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files that are referenced, references without a file)."""
    return files.join(names, "name", "left_semi"), names.join(files.select("name"), "name", "left_anti")
