"""Batch forms of the streaming operators, and the pipeline."""

from ...pipeline import run_pipeline
from ...session import checkpoint, new_folder
from ...sinks import committed_tables, read_evidence_table, write_evidence_tables
from ...streaming import streams as ST
from ..oracle import scored_sql, view_sql
from ..registry import query
from .common import A, F, classified, evidence, events


@query("session_activity", view_sql(["exec_events"], """
, g AS (SELECT *, CASE WHEN b IS NULL OR epoch_us(ts) - epoch_us(b) > 1800000000 THEN 1 ELSE 0 END AS opens FROM (
  SELECT endpoint_id, "user", ts, event_id, lag(ts) OVER (PARTITION BY endpoint_id, "user" ORDER BY ts, event_id) AS b FROM exec_events WHERE ts IS NOT NULL)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY endpoint_id, "user" ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT endpoint_id, "user", min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS records FROM s GROUP BY endpoint_id, "user", n"""))
def _(spark, sf):
    return ST.session_activity(evidence(spark, sf, "exec_events"))


@query("stream_score_batch", scored_sql("scored", """
SELECT event_id, score - CASE WHEN concern AND source_count > 1 THEN 2 ELSE 0 END AS score FROM scored WHERE evidence_kind <> 'SESSION_EVENT'"""))
def _(spark, sf):
    return ST.stream_score(events(spark, sf), evidence(spark, sf, "artifacts")).filter(
        "evidence_kind <> 'SESSION_EVENT'").select(
            "event_id", F.col("classification.score").cast("bigint").alias("score"))


@query("download_then_run", view_sql(["exec_events", "downloads"], """
SELECT d.page_id, e.event_id FROM downloads d JOIN (
  SELECT DISTINCT event_id, endpoint_id, ts, unnest(list_filter(string_split_regex(concat_ws(' ', executable, full_command_line), '\\s+'),
    lambda x: starts_with(x, '/') AND length(x) > 1)) AS path FROM exec_events WHERE ts IS NOT NULL) e
  ON e.endpoint_id = d.endpoint_id AND e.path = d.target_path AND e.ts >= d.downloaded_at AND e.ts <= d.downloaded_at + INTERVAL 24 HOUR"""))
def _(spark, sf):
    return ST.stream_download_then_run(evidence(spark, sf, "downloads"),
                                       evidence(spark, sf, "exec_events")).select(
        "page_id", "event_id")


@query("split_late", view_sql(["exec_events"], """
SELECT event_id, coalesce(ts < TIMESTAMP '2024-01-15' - INTERVAL 2 HOUR, false) AS late FROM exec_events"""))
def _(spark, sf):
    good, late = ST.split_late(evidence(spark, sf, "exec_events"), "2 HOURS", as_of="2024-01-15")
    return good.select("event_id", F.lit(False).alias("late")).unionByName(
        late.select("event_id", F.lit(True).alias("late")))


@query("run_pipeline", scored_sql("groups", """
SELECT 'events' AS name, count(*) AS n FROM (SELECT DISTINCT investigation_id, endpoint_id, source, source_record_id FROM exec_events)
UNION ALL SELECT 'artifacts', count(*) FROM artifacts"""))
def _(spark, sf):
    out = run_pipeline({"events": events(spark, sf), "artifacts": evidence(
        spark, sf, "artifacts"), "downloads": evidence(spark, sf, "downloads")},
        with_threads=False)
    return out["events"].select(F.lit("events").alias("name")).unionByName(
        out["artifacts"].select(F.lit("artifacts").alias("name"))).groupBy("name").agg(
            F.count("*").alias("n"))


@query("write_evidence_tables", scored_sql("groups", """
SELECT 'event' AS kind, s.event_id AS id, g.category, g.priority, g.score, CAST(NULL AS BIGINT) AS rows FROM scored s
JOIN groups g ON s.investigation_id = g.investigation_id AND s.endpoint_id = g.endpoint_id AND s.akey = g.akey
UNION ALL SELECT 'table', 'events', NULL, NULL, NULL, count(*) FROM scored
UNION ALL SELECT 'table', 'activity', NULL, NULL, NULL, count(*) FROM groups"""))
def _(spark, sf):
    """Events with their group's triage and the commit log, read back after a second attempt that stops half-way."""
    rows, folder = checkpoint(classified(spark, sf)), new_folder(spark, "evidence")
    groups = checkpoint(A.activity_groups(rows))       # four writes read it
    tables = {"events": A.with_group_triage(rows, groups), "activity": groups}
    write_evidence_tables(tables, folder, run_id="r")
    broken = groups.withColumn("occurrences", F.raise_error(F.lit("stopped")).cast("bigint"))
    try:
        write_evidence_tables(tables | {"activity": broken}, folder, run_id="r")
    except Exception as stopped:
        if "stopped" not in str(stopped):
            raise
    none = F.lit(None)
    return read_evidence_table(spark, folder, "r", "events").select(
        F.lit("event").alias("kind"), F.col("event_id").cast("string").alias("id"), "group_triage.category",
        "group_triage.priority", F.col("group_triage.score").cast("bigint").alias("score"),
        none.cast("bigint").alias("rows")).unionByName(
            committed_tables(spark, folder, "r").select(
                F.lit("table").alias("kind"), F.col("name").alias("id"), none.cast("string").alias("category"),
                none.cast("string").alias("priority"), none.cast("bigint").alias("score"), "rows"))
