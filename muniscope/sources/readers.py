"""Streaming sources: pages of records that a run can resume, and files that are new or have changed."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..session import ship_package
from .corpus import MEDIA
from .files import file_system

#: Tries after the first one, and seconds before the first of them, doubled each time.
RETRIES, FIRST_WAIT = 5, 2.0


class Busy(Exception):
    """The server is busy or failed for now; ``wait`` is what it asks for, in seconds."""

    def __init__(self, wait: float | None = None):
        super().__init__("busy")
        self.wait = wait


def with_retry(call: Callable, retries: int = RETRIES, first: float = FIRST_WAIT, sleep: Callable[[float], None] = time.sleep):
    """``call()``, again after growing waits while it raises Busy or a passing OSError; the last error is raised."""
    for attempt in range(retries + 1):
        try:
            return call()
        except (Busy, ConnectionError, TimeoutError, BlockingIOError) as failed:
            if attempt == retries:
                raise
            asked = getattr(failed, "wait", None)
            sleep(asked if asked is not None else first * 2**attempt)


@dataclass
class Page(InputPartition):
    path: str


@dataclass
class Listed(InputPartition):
    files: list[tuple[str, int, int]]


def rows_of_page(text: str, key: str) -> list[dict]:
    """The records of a page: ``{"Total...": "[...]"}``, or a plain list. Rows without ``key`` (the totals) are left out."""
    data = json.loads(text)
    if isinstance(data, dict):
        inner = next((k for k in data if k.startswith("Total")), None)
        data = json.loads(data[inner]) if inner and isinstance(data[inner], str) else data[inner] if inner else []
    return [r for r in data if r.get(key) is not None]


class _PageReader(DataSourceStreamReader):
    """Offset: how many pages have been read, in order of their names."""

    def __init__(self, schema, options):
        self.columns = schema.names
        self.path, self.key = options["path"], options["key"]
        self.most = int(options.get("pagespertrigger", 1))
        self.at = 0

    def _names(self) -> list[str]:
        from pyarrow import fs

        system, folder = file_system(self.path)
        found = system.get_file_info(fs.FileSelector(folder))
        return sorted(f.path for f in found if f.is_file and f.base_name.startswith("page-"))

    def initialOffset(self):
        return {"pages": 0}

    def latestOffset(self):
        return {"pages": min(self.at + self.most, len(self._names()))}

    def partitions(self, start, end):
        self.at = max(self.at, end["pages"])
        return [Page(p) for p in self._names()[start["pages"] : end["pages"]]]

    def commit(self, end):
        self.at = max(self.at, end["pages"])

    def read(self, partition):
        system, _ = file_system(self.path)

        def fetch() -> str:
            with system.open_input_stream(partition.path) as page:
                return page.read().decode()

        for r in rows_of_page(with_retry(fetch), self.key):
            yield tuple(None if r.get(c) is None else str(r[c]) for c in self.columns)


class PagedRecords(DataSource):
    """``readStream.format("paged_records")``: JSON pages ``page-*`` of a folder, every column text.

    Options: path, key (the column that totals rows lack), pagesPerTrigger."""

    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def schema(self):
        raise ValueError("paged_records needs a schema")

    def streamReader(self, schema):
        return _PageReader(schema, {k.lower(): v for k, v in self.options.items()})


class _FileReader(DataSourceStreamReader):
    """Offset: the latest time of change that was listed, in nanoseconds, and a digest of all files up to it.

    A batch lists the files that are newer. Where the digest of the others is not the one of before (a file has
    changed, gone, or come with an old time), all are listed; whoever reads drops what was there (see changed_files)."""

    def __init__(self, options):
        self.path = options["path"]
        self.kinds = tuple(f".{k}" for k in options.get("kinds", ",".join(MEDIA)).split(","))

    def _found(self) -> list[tuple[str, int, int]]:
        from pyarrow import fs

        system, folder = file_system(self.path)
        found = system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        return sorted((f.path, f.size, f.mtime_ns) for f in found if f.is_file and f.base_name.lower().endswith(self.kinds))

    def initialOffset(self):
        return {"modified": 0, "digest": _digest([])}

    def latestOffset(self):
        found = self._found()
        return {"modified": max([0, *(at for _, _, at in found)]), "digest": _digest(found)}

    def partitions(self, start, end):
        found = [f for f in self._found() if f[2] <= end["modified"]]
        old = [f for f in found if f[2] <= start["modified"]]
        listed = found if _digest(old) != start["digest"] else [f for f in found if f[2] > start["modified"]]
        return [Listed(listed[i : i + LISTED]) for i in range(0, len(listed), LISTED)]

    def read(self, partition):
        yield from partition.files


#: Files in one task's list.
LISTED = 5000


def _digest(files: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256("\n".join(f"{p}\t{n}\t{at}" for p, n, at in files).encode()).hexdigest()


class ChangedFiles(DataSource):
    """``readStream.format("changed_files")``: (path, length, modified) of media files below ``path``, some more than once."""

    @classmethod
    def name(cls) -> str:
        return "changed_files"

    def schema(self):
        return "path string, length long, modified long"

    def streamReader(self, schema):
        return _FileReader({k.lower(): v for k, v in self.options.items()})


def paged_records(spark: SparkSession, path: str, schema: str, key: str, pages: int = 1) -> DataFrame:
    """A stream of the records of pages, ``pages`` of them a batch; its checkpoint knows which have been read."""
    ship_package(spark)
    spark.dataSource.register(PagedRecords)
    return spark.readStream.format("paged_records").schema(schema).option("key", key).option("pagesPerTrigger", pages).load(path)


@F.pandas_udf(T.BinaryType())
def content_of(path: pd.Series) -> pd.Series:
    """The bytes of files by path or URI."""

    def one(p: str) -> bytes:
        system, at = file_system(p)

        def fetch() -> bytes:
            with system.open_input_stream(at) as f:
                return f.read()

        return with_retry(fetch)

    return path.map(one)


def changed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified, content), a stream of media files: each once, and again when its length or time of change is another.

    What has been read is state by (path, length, modified), a small row a file, kept for as long as the stream runs.
    Contents are read, in tasks, of new files only."""
    ship_package(spark)
    spark.dataSource.register(ChangedFiles)
    listed = spark.readStream.format("changed_files").load(path).dropDuplicates(["path", "length", "modified"])
    scheme = f"{path.split('://')[0]}://" if "://" in path else ""
    return listed.withColumn("content", content_of(F.concat(F.lit(scheme), "path")))
