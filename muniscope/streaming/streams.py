"""Incremental counterparts of the batch queries, over file sources with checkpoints."""

from __future__ import annotations

import bisect
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..session import ship_package


def file_stream(spark: SparkSession, folder: str, names: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a folder whose names fit a pattern."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", names)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def first_seen(stream: DataFrame, key: list[str], at: str, delay: str) -> DataFrame:
    """Rows whose key has not come before within the delay; older state is dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


def window_counts(stream: DataFrame, at: str, width: str, slide: str | None, delay: str, *keys: str) -> DataFrame:
    w = F.window(at, width, slide) if slide else F.window(at, width)
    out = stream.withWatermark(at, delay).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def sessions(stream: DataFrame, at: str, gap: str, delay: str, key: str) -> DataFrame:
    out = stream.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _by_state(stream: DataFrame, key: str, processor: StatefulProcessor, out: str) -> DataFrame:
    """Rows (key, item, us, kind) through a processor whose timers run on event time."""
    spark = stream.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return stream.groupBy(key).transformWithState(processor, out, "Append", "EventTime")


class Attempts(StatefulProcessor):
    """State of a key: the seconds of its last rows, as far as they fit the window, and the timer that ends them."""

    def __init__(self, seconds: int, limit: int):
        self.seconds, self.limit = seconds, limit

    def init(self, handle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", "times array<long>, timer long")

    def handleInputRows(self, key, rows, timerValues):
        times, timer = self.times.get() if self.times.exists() else ([], None)
        times = list(times)
        for second, item in sorted((r["us"] // 1_000_000, r["item"]) for r in rows):
            bisect.insort(times, second)
            low = bisect.bisect_left(times, second - self.seconds)
            n = bisect.bisect_right(times, second) - low
            yield Row(item=item, key=key[0], attempts=n, limited=n >= self.limit)
        times = times[bisect.bisect_left(times, times[-1] - self.seconds) :]
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = (times[-1] + self.seconds + 1) * 1000
        self.handle.registerTimer(timer)
        self.times.update((times, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.times.clear()
        return iter([])

    def close(self) -> None:
        pass


def sliding_attempts(stream: DataFrame, key: str, item: str, at: str, seconds: int, limit: int) -> DataFrame:
    """(item, key, attempts, limited): a row's number of its key's rows in the seconds before it, itself included.

    The stream has a watermark on ``at``. A key's state is the times of its last ``seconds``; when the watermark has
    passed them, a timer takes the key away. Rows of one batch go by time and item."""
    rows = stream.select(F.col(key).alias("key"), F.col(item).alias("item"), F.unix_micros(at).alias("us"), at)
    found = _by_state(rows, "key", Attempts(seconds, limit), "item long, key long, attempts long, limited boolean")
    return found.select(F.col("item").alias(item), F.col("key").alias(key), "attempts", "limited")


class TokenLife(StatefulProcessor):
    """State of a key: when its token ends. Issuing sets it, revoking and the timer at its end take it away."""

    def __init__(self, lifetime: int):
        self.lifetime = lifetime

    def init(self, handle) -> None:
        self.handle = handle
        self.ends = handle.getValueState("ends", "us long, timer long")

    def _forget(self, timer: int | None) -> None:
        if timer is not None:
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows, timerValues):
        ends, timer = self.ends.get() if self.ends.exists() else (None, None)
        before = timer
        for us, item, kind in sorted((r["us"], r["item"], r["kind"]) for r in rows):
            if kind == "issue":
                ends = us + self.lifetime * 1_000_000
            elif kind == "revoke":
                ends = None
            elif kind == "use":
                yield Row(item=item, key=key[0], live=ends is not None and us < ends)
        timer = None if ends is None else ends // 1000 + 1
        if timer != before:
            self._forget(before)
            if timer is not None:
                self.handle.registerTimer(timer)
        if ends is None:
            self.ends.clear()
        else:
            self.ends.update((ends, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.ends.clear()
        return iter([])

    def close(self) -> None:
        pass


def token_uses(stream: DataFrame, key: str, item: str, at: str, kind: str, lifetime: int) -> DataFrame:
    """(item, key, live): every use of a key's token, and whether it was issued, not revoked and less than
    ``lifetime`` seconds old. ``kind`` is issue, revoke or use; rows of one batch go by time and item.

    The stream has a watermark on ``at``; a token's state goes with its end."""
    rows = stream.select(F.col(key).alias("key"), F.col(item).alias("item"), F.unix_micros(at).alias("us"), F.col(kind).alias("kind"), at)
    found = _by_state(rows, "key", TokenLife(lifetime), "item long, key long, live boolean")
    return found.select(F.col("item").alias(item), F.col("key").alias(key), "live")


def state_rows(spark: SparkSession, checkpoint: str, variable: str) -> int:
    """How many keys a processor's state variable has now."""
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable).load().count()


def live_tokens(tokens: DataFrame, revoked: DataFrame, key: str, expires: str, at: str) -> DataFrame:
    """Tokens, a table or a stream, that have not expired when they are used and that nobody revoked."""
    return tokens.where(F.col(at) < F.col(expires)).join(revoked.select(key).distinct(), key, "left_anti")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, then stop; a second run goes on from the checkpoint."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).option("path", path)
    q.trigger(availableNow=True).start().awaitTermination()


def run_until_idle(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append batch after batch until the source has nothing new; for sources that hand out a part at a time."""
    q = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).option("path", path).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    q.trigger(availableNow=True).start().awaitTermination()


def merge_new(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch: append rows whose key is not on record. A batch run again adds nothing."""

    def each(batch: DataFrame, _: int) -> None:
        from ..sources.sinks import insert_if_new

        insert_if_new(batch, path, key)

    return each


def state_log(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch: one folder per batch, so that a batch run again replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return each
