"""Incremental jobs with Structured Streaming; each runs over what is there and ends."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..functions.rules import MEDIA, normalised_source_api
from ..sources.shared import ship, work_dir
from .batches import BatchLog

MOST_SOURCES = 500
#: Statuses that an idle generation is abandoned in.
UNFINISHED = ("building", "recovering", "ready")
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _folder(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/{uuid.uuid4().hex}"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _put(batch: DataFrame, sink: str, number: int) -> None:
    """Writes a micro-batch under its number, so a batch that is tried again replaces what it wrote."""
    batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")


def _taken(spark: SparkSession, sink: str, schema: str, before: int | None = None) -> DataFrame:
    """What the batches (those before one) have written; nothing if there are none."""
    found = spark.read.schema(f"{schema}, batch int").parquet(sink)
    return (found if before is None else found.where(F.col("batch") < before)).drop("batch")


def _begin(spark: SparkSession, sink: str, schema: str) -> str:
    spark.createDataFrame([], schema).write.parquet(f"{sink}/batch=-1")
    return sink


def _stream(spark: SparkSession, path: str, files: int):
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


@contextmanager
def _states(spark: SparkSession):
    """State in RocksDB: it may outgrow memory, and timers need it."""
    was = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if was is None else spark.conf.set(_PROVIDER, was)


def acquire(spark: SparkSession, staged: DataFrame, known: DataFrame, most: int, folder: str | None = None) -> DataFrame:
    """Keys of `staged` (key, extension, size) that are eligible and not known, each ingested once.

    Which keys earlier batches had is kept as streaming state by key, so a batch reads its own files, the known keys and
    the state of its own keys, never the sink. Of a key the row that comes first is taken. folder: where to work; its
    state goes on if the stream is started there again.
    """
    folder = folder or _folder(spark)
    schema = "key string, size long"
    if not _exists(spark, f"{folder}/known"):
        known.select("key").distinct().write.parquet(f"{folder}/known")
        _begin(spark, f"{folder}/sink", schema)
    staged.select("key", "extension", "size").repartition(4).write.mode("append").parquet(f"{folder}/staged")
    eligible = _stream(spark, f"{folder}/staged", 1).where(F.col("extension").isin(*MEDIA) & (F.col("size") > 0) & (F.col("size") <= most))
    fresh = eligible.join(spark.read.parquet(f"{folder}/known"), "key", "left_anti").select("key", "size").dropDuplicates(["key"])
    with _states(spark):
        fresh.writeStream.foreachBatch(lambda batch, number: _put(batch, f"{folder}/sink", number)).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()
    return _taken(spark, f"{folder}/sink", schema)


def upsert_sources(spark: SparkSession, raw: DataFrame, most: int = MOST_SOURCES) -> DataFrame:
    """(folded, source, position): normalised names, of those that differ in case only the one of the least position; more than `most` is refused.

    The first row of each name is streaming state, an aggregate that is combined before it is shuffled. A batch puts the names that it
    changed over the list that the batch before left, of `most` rows at most, so nothing reaches the driver but a count.
    """
    folder = _folder(spark)
    raw.select("position", "value").repartitionByRange(3, "position").write.parquet(f"{folder}/raw")
    schema = "folded string, source string, position long"
    lists = f"{folder}/lists"
    spark.createDataFrame([], schema).write.parquet(f"{lists}/-1")

    def merge(batch: DataFrame, number: int) -> None:
        held = batch.sparkSession.read.schema(schema).parquet(f"{lists}/{number - 1}")
        if batch.limit(most + 1).count() <= most:
            merged = held.join(batch, "folded", "left_anti").unionByName(batch)
            merged.write.mode("overwrite").parquet(f"{lists}/{number}")
            if batch.sparkSession.read.schema(schema).parquet(f"{lists}/{number}").count() <= most:
                last[0] = number
                return
        raise ValueError(f"more than {most} sources")

    last = [-1]
    named = _stream(spark, f"{folder}/raw", 1).select("position", normalised_source_api(F.col("value")).alias("source")).where("source <> ''")
    first = named.groupBy(F.lower("source").alias("folded")).agg(F.min(F.struct("position", "source")).alias("first")).select("folded", "first.source", "first.position")
    with _states(spark):
        first.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{lists}/{last[0]}")


def checkpoint_index(spark: SparkSession, index: DataFrame, successes: DataFrame, every: int) -> DataFrame:
    """(key, ext, size) of `index` merged with `successes` (key, ext, size, position), `every` rows or fewer a micro-batch.

    Each batch is a checkpoint: a version of the sink, which readers follow and which puts small batches together. Of a key the row of the greatest
    position wins, whatever batch it came in, and any row over that of the index.
    """
    from ..sources.readers import merged_index

    folder = _folder(spark)
    rows = successes.select("key", "ext", "size", "position")
    parts = max(1, -(-rows.count() // every))
    rows.repartitionByRange(parts, "position").write.parquet(f"{folder}/successes")
    log = BatchLog(spark, f"{folder}/sink", "key string, ext string, size long, position long")
    done = _stream(spark, f"{folder}/successes", 1).writeStream.foreachBatch(lambda batch, number: log.add(batch, number))
    done.option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()
    return merged_index(index.select("key", "ext", "size", F.lit(0).cast("long").alias("position")), log.read())


def fingerprint_changes(spark: SparkSession, stored: DataFrame, remote: DataFrame, pixels: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, phash, computed) of the rows of `remote`, batch by batch over the change feed.

    New and changed rows get the fingerprint of their pixels, unchanged ones keep theirs. pixels(keys) gives the
    images (key, width, height, pixels) of a table of keys; a key without one, or with too large a one, stays without a fingerprint.
    """
    from ..operators.fingerprint import fingerprint_stills
    from ..operators.reconcile import reconciled

    folder = _folder(spark)
    reconciled(stored, remote).where("change <> 'gone'").repartition(3).write.parquet(f"{folder}/feed")
    schema = "key string, phash long, computed boolean"
    sink = _begin(spark, f"{folder}/sink", schema)

    def work(batch: DataFrame, number: int) -> None:
        missing = batch.where("phash is null").select("key")
        made = fingerprint_stills(pixels(missing)).select("key", "phash", F.lit(True).alias("computed"))
        kept = batch.where("phash is not null").select("key", "phash", F.lit(False).alias("computed"))
        without = missing.join(made, "key", "left").select("key", "phash", F.coalesce("computed", F.lit(False)).alias("computed"))
        _put(kept.unionByName(without), sink, number)

    _stream(spark, f"{folder}/feed", 10).writeStream.foreachBatch(work).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()
    return _taken(spark, sink, schema)


class IdleTimer(StatefulProcessor):
    """Keeps the last event of a generation and a timer `ttl` seconds after it; when the timer fires the state goes, and an unfinished generation comes out."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "u long, seq long, status string, at long")

    def handleInputRows(self, key, rows, timerValues):
        if not key[0]:  # rows that move time on
            yield from ()
            return
        held = self.last.get()
        best = held
        for pdf in rows:
            for r in zip(pdf["u"].tolist(), pdf["seq"].tolist(), pdf["status"].tolist(), pdf["at"].tolist()):
                best = r if best is None or r[:2] > tuple(best)[:2] else best
        if best is not held:
            if held is not None:
                self.handle.deleteTimer((held[3] + self.ttl) * 1000)
            self.handle.registerTimer((best[3] + self.ttl) * 1000)
            self.last.update(tuple(best))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        _, _, status, at = self.last.get()
        self.last.clear()
        if status in UNFINISHED:
            yield pd.DataFrame({"generation": [key[0]], "status": [status], "at": [at]})

    def close(self) -> None:
        pass


def idle_generations(spark: SparkSession, states: DataFrame, now: int, ttl: int, late: int, folder: str | None = None) -> DataFrame:
    """(generation, status, at) whose last event leaves it unfinished and idle for `ttl` seconds when event time reaches `now`.

    Each generation has a timer in event time, set anew by a later event; its state goes when it fires, so state holds the generations
    of the last `ttl` seconds only. Events may be `late` seconds behind the newest one; older ones are dropped. An event without a time counts as
    of `now`. A last row without a generation moves event time on to `now`; generations without a name are left out. folder: where to work, as for acquire().
    """
    folder = folder or _folder(spark)
    at = F.coalesce("updated_at", "created_at", F.lit(now))
    events = states.select("generation", "status", "seq", at.alias("at"), F.coalesce("updated_at", F.lit(-1)).cast("long").alias("u")).where("generation <> ''")
    clock = spark.createDataFrame([(None, "clock", 0, now + late, -1)], "generation string, status string, seq long, at long, u long")
    schema = "generation string, status string, at long"
    ship(spark)
    if not _exists(spark, f"{folder}/sink"):
        _begin(spark, f"{folder}/sink", schema)
    for part in (events.repartition(3), clock.coalesce(1)):
        part.write.mode("append").parquet(f"{folder}/events")
        stream = _stream(spark, f"{folder}/events", 10).withColumn("time", F.timestamp_seconds("at")).withWatermark("time", f"{late} seconds")
        fired = stream.groupBy(F.coalesce("generation", F.lit("")).alias("generation")).transformWithStateInPandas(IdleTimer(ttl), T.StructType.fromDDL(schema), "Append", "EventTime")
        with _states(spark):
            fired.writeStream.outputMode("append").foreachBatch(lambda batch, number: _put(batch, f"{folder}/sink", number)).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()
    return _taken(spark, f"{folder}/sink", schema)
