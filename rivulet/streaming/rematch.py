"""Matching again as streams arrive, and the state around schedules and caches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor


def _version(sink: str, number: int) -> str:
    return f"{sink}/version={number:020d}"


def _versions(spark: SparkSession, sink: str) -> list[int]:
    """The numbers of the versions that are whole, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sink)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{sink}/version=*/_SUCCESS"))
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in done)


def current(spark: SparkSession, sink: str, schema=None) -> DataFrame:
    """The state after the last batch."""
    whole = _versions(spark, sink)
    if not whole:
        if schema is None:
            raise FileNotFoundError(f"no batch has been merged at {sink}")
        return spark.createDataFrame([], schema)
    return spark.read.parquet(_version(sink, whole[-1]))


def on_arrival(spark: SparkSession, source: str, schema, winners: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, key: str = "name", value: str = "m", max_files: int | None = None):
    """Matches the files that have arrived at ``source`` in few micro-batches, and merges each batch's ``winners`` (a key and a struct) into
    those of earlier batches: of each key the smallest struct stays.

    Batch n makes version n of the state out of the version before it and replaces a version n that a failed run may have left, so a batch that is
    repeated leaves the same state, and readers see whole versions only (``current``). The last two versions are kept.
    """
    reader = spark.readStream.schema(schema)
    arrived = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(source)

    def each(batch: DataFrame, number: int) -> None:
        found = winners(batch).select(key, value)
        before = [n for n in _versions(spark, sink) if n < number]
        if before:
            found = found.unionByName(spark.read.parquet(_version(sink, before[-1])))
        found.groupBy(key).agg(F.min(value).alias(value)).write.mode("overwrite").parquet(_version(sink, number))
        for old in before[:-1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(_version(sink, old))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return arrived.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def slot_claims(events: DataFrame, slot: str = "slot", day: str = "day", at: str | None = None, late: str = "1 day") -> DataFrame:
    """The first claim of each slot and day, in batches or, with an event time, in streams."""
    if events.isStreaming:
        return events.withWatermark(at, late).dropDuplicatesWithinWatermark([slot, day])
    first = events.groupBy(slot, day).agg(F.min(F.struct(F.col(at).alias("_at"), F.struct(*events.columns).alias("row"))).getField("row").alias("first"))
    return first.select(*(F.col(f"first.{c}") for c in events.columns))


def due(now_minutes, slot_minutes, within_s: int = 30):
    """Whether a schedule's slot is now, both as minutes of the day."""
    return F.abs(now_minutes - slot_minutes) * 60 <= within_s


class _Latest(StatefulProcessor):
    """Of each key the newest value, gone once it is older than the time to live."""

    def __init__(self, schema: T.StructType, at: str, ttl_ms: int):
        self.schema, self.at, self.ttl_ms = schema, at, ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.schema)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        frames = [r for r in rows if len(r)]
        if self.held.exists():
            frames.insert(0, pd.DataFrame([self.held.get()], columns=self.schema.names))
        frames = [f.assign(**{self.at: pd.to_datetime(f[self.at], utc=True).dt.tz_localize(None)}) for f in frames]
        every = pd.concat(frames, ignore_index=True).sort_values([self.at, *(c for c in self.schema.names if c != self.at)], kind="stable")
        newest = every.iloc[[-1]][self.schema.names]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(int(timer[0]) if isinstance(timer, tuple) else int(timer))
        value = newest.iloc[0]
        self.held.update(tuple(x.to_pydatetime() if isinstance(x, pd.Timestamp) else x.item() if hasattr(x, "item") else x for x in value))
        self.handle.registerTimer(int(value[self.at].value // 1_000_000) + self.ttl_ms)
        yield newest.assign(alive=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        gone = pd.DataFrame([self.held.get()], columns=self.schema.names)
        gone[self.at] = pd.to_datetime(gone[self.at], utc=True).dt.tz_localize(None)
        self.held.clear()
        yield gone.assign(alive=False)

    def close(self) -> None:
        pass


def latest_within(probes: DataFrame, key: str, at: str, ttl_minutes: float, late: str = "0 seconds") -> DataFrame:
    """Streaming: the newest row of each key with ``alive``: true when it arrives, false once event time has passed it by ``ttl_minutes``.

    A newer row of the key starts the time anew, so the window rolls with each key. Takes the RocksDB state store. Equal times: the row
    whose other columns come last.
    """
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in probes.schema])
    out = T.StructType([*schema, T.StructField("alive", T.BooleanType())])
    processor = _Latest(schema, at, int(ttl_minutes * 60_000))
    return probes.withWatermark(at, late).groupBy(key).transformWithStateInPandas(processor, out, "Update", "EventTime")
