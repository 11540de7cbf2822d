"""Streams of events: counts by window, and the verdict that a key's events of the last hour remember."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..session import shared_folder, ship

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
HOUR = 3_600_000_000


def read_events(spark: SparkSession, path: str, schema: str = EVENTS) -> DataFrame:
    """Event files (a folder or a pattern) as a stream; files that come later are read in later batches. Times without a zone are taken in the session's."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """began, event_type, n, most: a window's counts, given once it is older than the watermark. Events later than `late` are dropped."""
    each = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return each.agg(F.count("*").alias("n"), F.max("value").alias("most")).select(F.col("window.start").cast("timestamp_ntz").alias("began"), "event_type", "n", "most")


def remembered(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """key, event_id, ts, remembered: the last verdict of the key's events in the hour before each event (ts, verdict in the input).

    A key's state holds the verdicts of the last hour and the allowed lateness only, so an event that comes late is answered by
    its own time. A key's state lies in one task by nature; its events come in batches, not whole.
    """
    ship(events.sparkSession)

    def answer(name, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        times, verdicts = (list(x) for x in state.get) if state.exists else ([], [])
        # A key has few rows: plain arrays, as each of pandas' sorts and joins takes longer than all of them.
        parts = [(b["event_id"].to_numpy(), b["micros"].to_numpy(np.int64), b["verdict"].to_numpy(object)) for b in batches]
        ids, micros, said = (np.concatenate(x) for x in zip(*parts))
        told = pd.notna(said)
        at, verdict = np.array([*times, *micros[told].tolist()], np.int64), np.array([*verdicts, *said[told].tolist()], object)
        order = np.argsort(at, kind="stable")
        at, verdict = at[order], verdict[order]
        order = np.argsort(micros, kind="stable")
        ids, micros = ids[order], micros[order]
        last = np.searchsorted(at, micros, "left") - 1  # the last verdict before each event
        found = last >= 0
        found[found] = micros[found] - at[last[found]] <= HOUR
        answers = np.full(len(ids), None, object)
        answers[found] = verdict[last[found]]
        mark = state.getCurrentWatermarkMs() * 1000
        live = at >= mark - HOUR
        state.update((at[live].tolist(), verdict[live].tolist()))
        state.setTimeoutTimestamp(max(int(micros[-1]) // 1000, mark // 1000) + HOUR // 1000 + 1)
        yield pd.DataFrame({key: name[0], "event_id": ids, "micros": micros, "remembered": answers})

    kind = events.schema[key].dataType.simpleString()
    slim = events.withWatermark("ts", late).select(key, "event_id", "ts", F.unix_micros("ts").alias("micros"), "verdict")
    return slim.groupBy(key).applyInPandasWithState(
        answer, f"{key} {kind}, event_id long, micros long, remembered string", "times array<long>, verdicts array<string>", "append", GroupStateTimeout.EventTimeTimeout
    ).select(key, "event_id", F.timestamp_micros("micros").cast("timestamp_ntz").alias("ts"), "remembered")


#: What an event's line of JSON holds; a line that does not fit is damaged.
LINE = "event_id long, ts timestamp_ntz, event_type string, value double"


def parsed(lines: DataFrame, schema: str = LINE, text_col: str = "line") -> DataFrame:
    """lines with `event` (null for a damaged line). A line is damaged if it is no JSON object, a field is of another type, or the
    first field (the id) is missing."""
    first = schema.split()[0]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    read = lines.withColumn("_e", F.from_json(text_col, f"{schema}, _bad string", options))
    whole = F.col("_e").isNotNull() & F.col("_e._bad").isNull() & F.col(f"_e.{first}").isNotNull()
    return read.withColumn("event", F.when(whole, F.col("_e").dropFields("_bad"))).drop("_e")


def run_with_dead_letters(lines: DataFrame, schema: str = LINE, text_col: str = "line", folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The good events of a stream of lines, and the damaged lines as they came with the batch that had them.

    Each batch is written to a folder of its number, which a repeated batch replaces, so a restart repeats no rows.
    """
    spark = lines.sparkSession
    folder = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        told = parsed(batch, schema, text_col)
        told.where("event is not null").select("event.*").write.mode("overwrite").parquet(f"{folder}/events/batch={number}")
        told.where("event is null").select(text_col).write.mode("overwrite").parquet(f"{folder}/damaged/batch={number}")

    lines.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    events = spark.read.schema(f"{schema}, batch long").option("basePath", f"{folder}/events").parquet(f"{folder}/events/batch=*")
    damaged = spark.read.schema(f"{text_col} string, batch long").option("basePath", f"{folder}/damaged").parquet(f"{folder}/damaged/batch=*")
    return events.drop("batch"), damaged


def run_available(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """What a stream gives for the files that are there now, written as Parquet; a folder given again goes on where it stopped."""
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
