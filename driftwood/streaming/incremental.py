"""Structured Streaming forms: intake, windowed usage, sessions, streaks.

Each takes a streaming (or batch) DataFrame and returns one; ``drained`` runs a
stream over what is there and writes it to the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graphs import shared_folder


def file_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table as a stream of files.

    Without ``files_per_batch`` all files there now are one batch.  A history
    is drained so: its files may be in any order, and a watermark that an
    earlier batch has set would leave out rows behind it.
    """
    table = spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    # a folder may hold one file too, so the file itself must bear the table's name in the table's folder
    files = table.inputFiles()
    is_file = len(files) == 1 and unquote(files[0]).split("/")[-2:] == path.rstrip("/").split("/")[-2:]
    source = spark.readStream.schema(table.schema)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    return source.option("pathGlobFilter", name).parquet(folder) if is_file else source.parquet(path)


def event_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """``file_stream`` with ts as a timestamp with a time zone, as watermarks need."""
    return file_stream(spark, path, files_per_batch).withColumn("ts", F.col("ts").cast("timestamp"))


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which state with timers needs."""
    key, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, rocks)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def usage(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, event_type, n, volume by tumbling windows; rows later than ``late`` are left out."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("volume"))
    return counted.select(F.col("window.start").alias("window_start"), "event_type", "n", "volume")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """user_id, session_start, session_end, n: runs of a user's events without a pause of ``gap``."""
    counted = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def first_seen(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key: NEW items of an intake; no key is forgotten, however late it comes again."""
    return events.dropDuplicates(keys)


def failure_streaks(events: DataFrame) -> DataFrame:
    """user_id, streak, last_event after every batch: failures since the last success, in order of (ts, event_id).

    Batches may come in any order of ts: the state of a user has the last row,
    the last success, and the failures after it, which a success that comes
    late can still cut off.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, passed, times, ids = None, None, [], []
        if state.exists:
            last_ts, last_id, passed_ts, passed_id, times, ids = state.get
            last = (last_ts, last_id)
            passed = None if passed_ts is None else (passed_ts, passed_id)
        failed = list(zip(times, ids))
        for rows in batches:
            at = list(zip(rows["ts"].astype("datetime64[us]").astype("int64").tolist(), rows["event_id"].tolist()))
            wrong = (rows["event_type"] == "error").tolist()
            last = max([*at, *[last] * (last is not None)])
            passed = max([x for x, w in zip(at, wrong) if not w] + [passed] * (passed is not None), default=None)
            failed = [x for x in failed + [x for x, w in zip(at, wrong) if w] if passed is None or x > passed]
        state.update((*last, *(passed or (None, None)), [x[0] for x in failed], [x[1] for x in failed]))
        yield pd.DataFrame({"user_id": [key[0]], "streak": [len(failed)], "last_event": [last[1]]})

    kept = "last_ts long, last_id long, passed_ts long, passed_id long, times array<long>, ids array<long>"
    return events.groupBy("user_id").applyInPandasWithState(fold, "user_id long, streak long, last_event long", kept, "update", "NoTimeout")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for the data there now (trigger availableNow), as a table in the shared folder."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/driftwood/stream-{uuid.uuid4().hex}"
    out = f"{folder}/table"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    else:
        write = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)
