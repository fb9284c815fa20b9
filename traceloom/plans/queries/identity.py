"""Identity, references, source bookkeeping."""

from ...operators import events as E
from ..oracle import view_sql
from ..registry import query
from .common import F, evidence, events


@query("dedupe_events", view_sql(["exec_events"], """
SELECT investigation_id, endpoint_id, source, source_record_id, event_id, copies FROM (
  SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY investigation_id, endpoint_id, source, source_record_id) AS copies
  FROM exec_events WINDOW w AS (PARTITION BY investigation_id, endpoint_id, source, source_record_id
  ORDER BY ts ASC NULLS LAST, event_id)) WHERE rn = 1"""))
def _(spark, sf):
    return E.dedupe_events(events(spark, sf)).select(
        "investigation_id", "endpoint_id", "source", "source_record_id", "event_id", "copies")


_REF = """
SELECT event_id, prefix || '-' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0')
  ELSE CAST(n AS VARCHAR) END AS reference FROM (
  SELECT *, row_number() OVER (PARTITION BY investigation_id, prefix ORDER BY evidence_kind,
    ts ASC NULLS LAST, source_record_id, endpoint_id, source, event_id) AS n FROM (
    SELECT *, CASE evidence_kind WHEN 'EXECUTION_EVIDENCE' THEN 'EXEC' WHEN 'COMMAND_HISTORY' THEN 'CMD'
      WHEN 'SESSION_EVENT' THEN 'SESS' ELSE 'EVT' END AS prefix FROM exec_events))"""


@query("assign_event_references", view_sql(["exec_events"], _REF))
def _(spark, sf):
    return E.assign_event_references(events(spark, sf)).select("event_id", "reference")


@query("assign_artifact_references", view_sql(["artifacts"], """
SELECT collection_order, 'ART-' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS reference
FROM (SELECT *, row_number() OVER (PARTITION BY investigation_id ORDER BY collection_order, endpoint_id, path) AS n FROM artifacts)"""))
def _(spark, sf):
    return E.assign_artifact_references(evidence(spark, sf, "artifacts")).select(
        "collection_order", "reference")


@query("newest_events", view_sql(["exec_events"], """
SELECT investigation_id, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY investigation_id ORDER BY ts DESC NULLS LAST, endpoint_id, source, source_record_id) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY investigation_id, endpoint_id, source, source_record_id ORDER BY ts ASC NULLS LAST, event_id) AS rn
    FROM exec_events) WHERE rn = 1) WHERE n <= 500"""))
def _(spark, sf):
    return E.dedupe_events(events(spark, sf), newest=500).select("investigation_id", "event_id")


_STATUS = """
SELECT investigation_id, name, CASE WHEN name = 'process accounting' THEN 'NOT_ENABLED' ELSE 'AVAILABLE' END AS status
FROM (SELECT DISTINCT investigation_id FROM exec_events) CROSS JOIN (
  SELECT DISTINCT source AS name FROM exec_events UNION ALL SELECT 'process accounting')"""


def sources(events_df):
    """A source-status table: every source seen anywhere, in every investigation."""
    names = events_df.select(F.array_union(F.collect_set("source"), F.array(
        F.lit("process accounting"))).alias("names"))
    held = events_df.select("investigation_id").distinct()
    listed = held.withColumn("name", F.explode(F.lit(names.scalar())))
    return listed.withColumn(
        "status", F.when(F.col("name") == "process accounting", "NOT_ENABLED").otherwise(
            "AVAILABLE")).withColumn("detail", F.lit("read from collected files")).withColumn(
        "event_count", F.lit(0).cast("bigint")).withColumn("truncated", F.lit(False)).withColumn(
        "location", F.lit(None).cast("string"))


@query("source_statistics", view_sql(["exec_events"], f"""
, st AS ({_STATUS})
SELECT investigation_id, queried, available, event_count, undated_event_count, false AS truncated FROM (
  SELECT investigation_id, count(*) AS queried, count(*) FILTER (status = 'AVAILABLE') AS available FROM st GROUP BY ALL)
JOIN (SELECT investigation_id, count(*) AS event_count, count(*) FILTER (ts IS NULL) AS undated_event_count
      FROM exec_events GROUP BY ALL) USING (investigation_id)"""))
def _(spark, sf):
    held = events(spark, sf)
    return E.source_statistics(held, sources(held))


@query("events_per_source", view_sql(["exec_events"], f"""
, st AS ({_STATUS})
SELECT investigation_id, name, status, (SELECT count(*) FROM exec_events e
  WHERE e.investigation_id = st.investigation_id AND e.source = st.name) AS events FROM st"""))
def _(spark, sf):
    held = events(spark, sf)
    return E.events_per_source(held, sources(held))


@query("union_sources", view_sql(["exec_events"], """
SELECT source, count(*) AS events, min(ts) AS first_seen FROM exec_events GROUP BY ALL"""))
def _(spark, sf):
    held = events(spark, sf)
    parts = [held.filter(F.col("evidence_kind") == kind) for kind in (
        "EXECUTION_EVIDENCE", "COMMAND_HISTORY", "SESSION_EVENT")]
    return E.union_sources(*parts).groupBy("source").agg(
        F.count("*").alias("events"), F.min("ts").alias("first_seen"))
