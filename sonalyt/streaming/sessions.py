"""Stateful folds over event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.folders import new_path

OUT = "user_id long, seq long, events long, finals long, total_value double, longest_gap_us long"
STATE = "seq long, events long, finals long, total_value double, longest_gap_us long, last_us long"


def _step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Counters of a session after a micro-batch; rows in arrival order of event time, a late one never moves the clock back."""
    seq, n, finals, total, gap, last = state.get if state.exists else (0, 0, 0, 0.0, 0, -1)
    rows = pd.concat(list(parts)).sort_values(["us", "event_id"])
    for us, value, final in zip(rows["us"], rows["value"], rows["is_final"], strict=True):
        if last >= 0:
            gap = max(gap, int(us) - last)
        last = max(last, int(us))
        n, finals, total = n + 1, finals + bool(final), total + float(value)
    seq += 1
    state.update((seq, n, finals, total, gap, last))
    yield pd.DataFrame([(key[0], seq, n, finals, total, gap)], columns=[c.split()[0] for c in OUT.split(", ")])


def fold(events: DataFrame) -> DataFrame:
    """events: a stream of user_id, event_id, us, value, is_final; a row of counters for each session that a micro-batch touches."""
    return events.groupBy("user_id").applyInPandasWithState(_step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def _stream(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, since the source takes no path of a single file


def _drain(stream: DataFrame, schema: str) -> DataFrame:
    """Writes a stream out until its input is used up and returns what was written; the shared folder holds its log and rows."""
    spark = stream.sparkSession
    out = new_path(spark, "stream")
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/rows")


def fold_stored(spark: SparkSession, path: str) -> DataFrame:
    """Runs the fold over stored events as a stream and returns each session's last counters."""
    rows = _stream(spark, path).where("user_id is not null and ts is not null")
    rows = rows.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value", (F.col("event_type") == "purchase").alias("is_final"))
    last = _drain(fold(rows), OUT).groupBy("user_id")
    return last.agg(*[F.max_by(c, "seq").alias(c) for c in ("events", "finals", "longest_gap_us")], F.round(F.max_by("total_value", "seq"), 4).alias("total_value"))


def windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window and event type of a stream with ts; a window is given out when the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"))


def windows_stored(spark: SparkSession, path: str, **how) -> DataFrame:
    """Runs windows() over stored events as a stream until they are used up."""
    rows = _stream(spark, path).select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    counted = windows(rows, **how).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "events")
    return _drain(counted, "window_start string, event_type string, events long")


def timed_out(events: DataFrame, grace: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """Sessions of a stream with user_id, ts and value that end when nothing came for `grace`; each is given out and its state let go when the watermark is past its end."""
    ended = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", grace).alias("w")).agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return ended.select("user_id", F.col("w.start").alias("began"), "events", "total")


def sessions_stored(spark: SparkSession, path: str, **how) -> DataFrame:
    """Runs timed_out() over stored events as a stream until they are used up."""
    rows = _stream(spark, path).where("ts is not null").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    told = timed_out(rows, **how).withColumn("began", F.date_format("began", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return _drain(told, "user_id long, began string, events long, total double")
