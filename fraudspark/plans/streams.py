"""Streaming queries (SM): the given tables replayed as streams, run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudspark.plans.registry import query
from fraudspark.plans.roles import Roles
from fraudspark.plans.scoring import scored_sql, status_changes
from fraudspark.session import scratch_path
from fraudspark.streaming import monitors, sinks


def event_stream(r: Roles):
    """The events table as a stream, with event time as a timestamp."""
    schema = r.table("events").schema
    stream = monitors.file_stream(r.spark, r.folder, schema, "events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def plain_time(df, *columns: str):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("sm01_scored_alerts", f"""
    SELECT entity_type || ':' || entity_id AS entities, risk_level AS severity, risk_score AS score, 'ACTIVE' AS status
    FROM ({scored_sql("inspection")}) WHERE risk_score >= 50""")
def sm01(r: Roles):
    key = F.col("event_id")
    features = event_stream(r).select(
        key.alias("id"), (key % 10 / 10.0).alias("inspection_failure_rate"), (F.col("user_id") % 5).alias("inspection_avoidance_indicators"),
        (F.col("event_type") == "error").alias("document_fraud_indicators"), (key % 3).alias("inspector_red_flags"),
        (key % 8).alias("compliance_gaming_score"),
    )
    alerts = sinks.run_append(monitors.scored_alerts(features, "inspection"))
    return alerts.select(F.array_join("entities", ",").alias("entities"), "severity", F.round("score", 6).alias("score"), "status")


@query("sm02_alerts_per_window", """
    SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
           CASE WHEN value > 75 THEN 'CRITICAL' WHEN value > 50 THEN 'HIGH' ELSE 'LOW' END AS severity, count(*) AS n_alerts, round(sum(value), 4) AS total_score
    FROM events GROUP BY ALL""")
def sm02(r: Roles):
    severity = F.when(F.col("value") > 75, "CRITICAL").when(F.col("value") > 50, "HIGH").otherwise("LOW")
    alerts = event_stream(r).select(F.col("ts").alias("created_at"), severity.alias("severity"), F.col("value").alias("score"))
    out = sinks.run_updates(monitors.alerts_per_window(alerts), ["window_start", "window_end", "severity"])
    return plain_time(out, "window_start", "window_end").withColumn("total_score", F.round("total_score", 4))


@query("sm03_event_bursts", """
    SELECT user_id, CAST(CAST(ts AS DATE) - CAST(i AS INTEGER) AS TIMESTAMP) AS window_start, count(*) AS n_events FROM events, range(7) t(i) GROUP BY ALL""")
def sm03(r: Roles):
    bursts = monitors.event_bursts(event_stream(r), "user_id", "ts", size="7 days")
    return plain_time(sinks.run_updates(bursts, ["window_start", "user_id"]), "window_start")


@query("sm04_sessions", """
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g),
    q AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOURS AS session_end, count(*) AS n_events FROM n GROUP BY user_id, no)
    SELECT * FROM q""")
def sm04(r: Roles):
    # The events arrive in two parts, so sessions go on over a restart; none is left open.
    events = r.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    ends = events.agg(F.min("ts").cast("double").alias("a"), F.max("ts").cast("double").alias("b")).first()
    early = F.col("ts") < F.timestamp_seconds(F.lit((ends["a"] + ends["b"]) / 2))
    done = monitors.closed_sessions([events.filter(early), events.filter(~early)], scratch_path(r.spark, "sessions"), "user_id", "ts", gap="2 hours")
    return plain_time(done, "session_start", "session_end")


@query("sm05_without_repeats", "SELECT event_id, user_id, event_type FROM events")
def sm05(r: Roles):
    twice = event_stream(r).union(event_stream(r))
    kept = monitors.without_repeats(twice, ["event_id"], "ts")
    return sinks.run_append(kept.select("event_id", "user_id", "event_type"))


@query("sm06_followed_by", """
    SELECT c.user_id AS bin, c.event_id AS complaint_id, p.event_id AS permit_id FROM events c JOIN events p ON c.user_id = p.user_id
    AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 6 HOURS WHERE c.event_type = 'error' AND p.event_type = 'purchase'""")
def sm06(r: Roles):
    of = lambda kind, name: event_stream(r).filter(F.col("event_type") == kind).select(
        F.col("user_id").alias("bin"), F.col("event_id").alias(f"{name}_id"), F.col("ts").alias(f"{name}_ts")
    )
    pairs = monitors.followed_by(of("error", "complaint"), of("purchase", "permit"), "bin", "complaint_ts", "permit_ts", within="6 hours")
    return sinks.run_append(pairs.select("bin", "complaint_id", "permit_id"))


@query("sm07_alert_states", """
    WITH l AS (SELECT user_id AS alert_id, CASE event_type WHEN 'signup' THEN 'ACTIVE' WHEN 'view' THEN 'INVESTIGATING' WHEN 'purchase' THEN 'RESOLVED'
                      WHEN 'error' THEN 'FALSE_POSITIVE' END AS status, ts, event_id FROM events)
    SELECT alert_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS changed_at, count(*) AS n_changes FROM l WHERE status IS NOT NULL GROUP BY 1""")
def sm07(r: Roles):
    # The log in several files, so states are carried over several batches.
    path = scratch_path(r.spark, "changes")
    changes = status_changes(r).withColumn("changed_at", F.col("changed_at").cast("timestamp"))
    changes.repartition(3, "change_id").write.parquet(path)
    stream = monitors.file_stream(r.spark, path, changes.schema, files_per_batch=1)
    states = sinks.run_updates(monitors.alert_states(stream), ["alert_id"])
    return plain_time(states, "changed_at")


@query("sm09_stream_upsert", """
    SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY 1""")
def sm09(r: Roles):
    path = scratch_path(r.spark, "upsert")
    events = r.table("events").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    events.repartition(4, "event_id").write.parquet(f"{path}/in")
    stream = monitors.file_stream(r.spark, f"{path}/in", events.schema, files_per_batch=1)
    sinks.finish(sinks.upsert_rows(stream, f"{path}/table", f"{path}/checkpoint", ["user_id"], ["ts", "event_id"]))
    return plain_time(sinks.EntityTable(r.spark, f"{path}/table", ["user_id"], ["ts", "event_id"]).read(), "ts")
