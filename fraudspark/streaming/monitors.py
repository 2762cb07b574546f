"""The fraud monitor as streams: scoring, counts over time, sessions, joins, alert states."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fraudspark.operators.scoring import create_alerts, current_status, score
from fraudspark.streaming.sinks import append_rows, finish


def file_stream(
    spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def scored_alerts(features: DataFrame, entity_type: str, *, from_level: str = "HIGH") -> DataFrame:
    """Alerts for entities as they arrive."""
    return create_alerts(score(features, entity_type), F.current_timestamp(), from_level=from_level)


def alerts_per_window(alerts: DataFrame, *, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Alerts by severity in tumbling windows of event time."""
    counted = alerts.withWatermark("created_at", delay).groupBy(F.window("created_at", size), "severity").agg(
        F.count("*").alias("n_alerts"), F.sum("score").alias("total_score")
    )
    return counted.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "severity", "n_alerts", "total_score"
    )


def event_bursts(
    events: DataFrame, key: str, ts: str, *, size: str = "30 days", slide: str = "1 day", delay: str = "1 day"
) -> DataFrame:
    """Events per entity in sliding windows."""
    counted = events.withWatermark(ts, delay).groupBy(F.window(ts, size, slide), key).agg(F.count("*").alias("n_events"))
    return counted.select(F.col("window.start").alias("window_start"), key, "n_events")


def sessions(events: DataFrame, key: str, ts: str, *, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Runs of activity of an entity without a pause longer than `gap`."""
    counted = events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n_events"))
    return counted.select(
        key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n_events"
    )


def closed_sessions(arrivals: Iterable[DataFrame], path: str, key: str, ts: str, *, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions over all `arrivals`, also those open when the last one ends.

    Each arrival is landed in `path` and read by a run from the checkpoint of the one before. At last a mark without a
    key is landed, far enough behind the latest event that the watermark passes the end of every session.
    Rows without a key or a time are in no session.
    """
    spark, schema, latest = None, None, None
    for arrived in arrivals:
        spark, schema = arrived.sparkSession, arrived.schema
        arrived.write.mode("append").parquet(f"{path}/landed")
        last = arrived.agg(F.max(ts)).first()[0]
        latest = last if latest is None or (last is not None and last > latest) else latest
        _sessions_run(spark, path, schema, key, ts, gap, delay)
    if spark is None:
        raise ValueError("no arrivals")
    if latest is not None:
        after = F.lit(latest) + F.expr(f"INTERVAL {gap}") + F.expr(f"INTERVAL {delay}") + F.expr("INTERVAL 1 SECOND")
        mark = [(after if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
        spark.range(1).select(*mark).write.mode("append").parquet(f"{path}/landed")
        _sessions_run(spark, path, schema, key, ts, gap, delay)
    kept = sessions(file_stream(spark, f"{path}/landed", schema), key, ts, gap=gap, delay=delay).schema
    return spark.read.schema(kept).parquet(f"{path}/rows").filter(F.col(key).isNotNull())


def _sessions_run(spark: SparkSession, path: str, schema: StructType, key: str, ts: str, gap: str, delay: str) -> None:
    found = sessions(file_stream(spark, f"{path}/landed", schema), key, ts, gap=gap, delay=delay)
    finish(append_rows(found, f"{path}/rows", f"{path}/checkpoint"))


def without_repeats(events: DataFrame, keys: list[str], ts: str, *, delay: str = "1 day") -> DataFrame:
    """Drop records that arrive again within the overlap of incremental loads."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def followed_by(
    first: DataFrame, second: DataFrame, key: str, first_ts: str, second_ts: str, *, within: str = "30 days", delay: str = "1 day"
) -> DataFrame:
    """Pairs of a `first` and a later `second` at the same key within a time."""
    left = first.withWatermark(first_ts, delay).alias("f")
    right = second.withWatermark(second_ts, delay).alias("s")
    same = F.col(f"f.{key}") == F.col(f"s.{key}")
    later = F.col(f"s.{second_ts}").between(F.col(f"f.{first_ts}"), F.col(f"f.{first_ts}") + F.expr(f"INTERVAL {within}"))
    return left.join(right, same & later).drop(F.col(f"s.{key}"))


# --- alert states -----------------------------------------------------------------------------

def alert_states(changes: DataFrame) -> DataFrame:
    """The state of each alert after each batch of changes(alert_id, status, changed_at, change_id).

    An aggregate that stays in the JVM: the latest valid status is a maximum, so a hot alert is added up in
    parts and the order of arrival does not matter.
    """
    return current_status(changes)
