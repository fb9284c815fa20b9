"""Streams over the given tables, run to their end and compared with what the batch rules say of the same rows."""

from ...streaming import streams as ST
from ...streaming.replay import replay
from ..oracle import view_sql
from ..registry import query
from ..views import table
from .common import F, evidence

_STALE = 30 * 86_400


def _closing(df, **values):
    """One row after all others, so that the watermark passes them; it has no partner and waits itself."""
    names = ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes)
    return df.sparkSession.createDataFrame([tuple(values.get(c) for c in df.columns)], names)


def _packed(spark):
    """Settings for packed rows: few partitions, as opening and keeping one costs more than its rows, and few rows a batch."""
    most = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    return {"spark.sql.shuffle.partitions": str(most), "spark.sql.execution.arrow.maxRecordsPerBatch": "200"}


def _far(spark, df, moment):
    """A moment past every window after the last row of ``df``."""
    return df.agg((F.max(moment) + F.expr("INTERVAL 100 DAYS")).alias("m")).first()["m"]


@query("stream_hash_changes", view_sql(["ledger"], """
SELECT endpoint_id, path, seq, size_bytes, CASE WHEN ph IS NULL THEN 'first_recorded' WHEN pa <> algorithm THEN 'algorithm_mismatch'
  WHEN ph = hash THEN 'unchanged' ELSE 'altered' END AS status, ph AS previous_hash, CAST(pt AS TIMESTAMP) AS previous_ts FROM (
  SELECT *, lag(hash) OVER w AS ph, lag(algorithm) OVER w AS pa, lag(ts) OVER w AS pt FROM ledger
  WINDOW w AS (PARTITION BY endpoint_id, path ORDER BY ts, seq, hash, algorithm, size_bytes))"""))
def _(spark, sf):
    seen = evidence(spark, sf, "ledger").withColumn("ts", F.col("ts").cast("timestamp"))
    last = _closing(seen, endpoint_id="", path="", ts=_far(spark, seen, "ts"))
    return replay(spark, {"seen": (seen, "ts")}, lambda s: ST.stream_hash_changes(s["seen"]).select(
        "endpoint_id", "path", "seq", "size_bytes", "status", "previous_hash", "previous_ts"),
                  closing={"seen": last}, settings=_packed(spark))


@query("stream_first_runs", view_sql(["exec_events", "downloads"], """
, named AS (SELECT investigation_id, endpoint_id, ts, source_record_id, event_id, unnest(list_filter(string_split_regex(
    concat_ws(' ', executable, full_command_line), '\\s+'), lambda x: starts_with(x, '/') AND length(x) > 1)) AS target_path
  FROM exec_events WHERE ts IS NOT NULL),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY investigation_id, endpoint_id, target_path
  ORDER BY ts, source_record_id, event_id) AS place FROM named) WHERE place = 1)
SELECT page_id, event_id, round((epoch_us(f.ts) - epoch_us(downloaded_at)) / 3600000000.0, 6) AS gap
FROM downloads JOIN firsts f USING (investigation_id, endpoint_id, target_path)
WHERE epoch_us(f.ts) - epoch_us(downloaded_at) <= 86400000000"""))
def _(spark, sf):
    got, ran = evidence(spark, sf, "downloads"), evidence(spark, sf, "exec_events")
    last = _closing(ran, investigation_id="", endpoint_id="", event_id="", executable="/", full_command_line="/end",
                    ts=_far(spark, ran, "ts"))
    return replay(spark, {"got": (got, "downloaded_at"), "ran": (ran, "ts")},
                  lambda s: ST.stream_first_runs(s["got"], s["ran"]), closing={"ran": last}).select(
        "page_id", "event_id", F.round("gap_hours", 6).alias("gap"))


@query("stream_endpoint_health", f"""
WITH beats AS (SELECT o_custkey, CAST(o_orderdate AS TIMESTAMP) AS ts,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'revoked' ELSE 'active' END AS status FROM orders),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY ts DESC, status DESC) AS place FROM beats) WHERE place = 1)
SELECT c_custkey AS endpoint_id, CASE WHEN ts IS NULL THEN CASE WHEN c_mktsegment = 'MACHINERY' THEN 'revoked' ELSE 'never_seen' END
    WHEN status = 'revoked' THEN 'revoked' WHEN (SELECT max(ts) FROM beats) - ts > INTERVAL {_STALE} SECOND THEN 'stale'
    ELSE 'healthy' END AS state
FROM customer LEFT JOIN newest ON o_custkey = c_custkey""")
def _(spark, sf):
    hosts = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("endpoint_id"), F.when(F.col("c_mktsegment") == "MACHINERY", "revoked").otherwise(
            "active").alias("status"), F.lit(None).cast("timestamp").alias("last_seen"))
    beats = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("endpoint_id"), F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "revoked").otherwise("active").alias("status"))
    told = replay(spark, {"beats": (beats, "ts")}, lambda s: ST.stream_endpoint_health(
        s["beats"], hosts, stale_seconds=_STALE))
    return told.groupBy("endpoint_id").agg(F.max_by("state", "change").alias("state"))


@query("stream_dedupe", view_sql(["exec_events"], """
SELECT investigation_id, endpoint_id, source, source_record_id, 1 AS n FROM exec_events WHERE ts IS NOT NULL GROUP BY ALL"""))
def _(spark, sf):
    rows = evidence(spark, sf, "exec_events")
    once = replay(spark, {"rows": (rows, "ts")}, lambda s: ST.stream_dedupe(s["rows"], watermark="400 days"))
    return once.groupBy("investigation_id", "endpoint_id", "source", "source_record_id").agg(F.count("*").alias("n"))


@query("stream_session_activity", view_sql(["exec_events"], """
, g AS (SELECT *, CASE WHEN b IS NULL OR epoch_us(ts) - epoch_us(b) > 1800000000 THEN 1 ELSE 0 END AS opens FROM (
  SELECT endpoint_id, "user", ts, event_id, lag(ts) OVER (PARTITION BY endpoint_id, "user" ORDER BY ts, event_id) AS b FROM exec_events WHERE ts IS NOT NULL)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY endpoint_id, "user" ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT endpoint_id, "user", min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS records FROM s GROUP BY endpoint_id, "user", n"""))
def _(spark, sf):
    rows = evidence(spark, sf, "exec_events")
    last = _closing(rows, endpoint_id="", user="", ts=_far(spark, rows, "ts"))
    return replay(spark, {"rows": (rows, "ts")}, lambda s: ST.stream_session_activity(s["rows"]), closing={"rows": last})
