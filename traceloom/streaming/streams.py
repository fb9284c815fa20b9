"""Streaming forms of scoring, deduplication, hash changes, health, sweeps and sequences."""

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from .. import functions as X
from .. import vocab as V
from ..operators.ordering import last_value_so_far, previous_value
from ..operators.scoring import artifact_lookup, classify_linked
from . import states
from .states import DigestsInOrder, FirstRun, HostStates, pack, unpack

# What keeps state goes to its workers whole: the one that starts a stream does not see the package.
cloudpickle.register_pickle_by_value(states)

#: Keys keep their state in so many buckets; a bucket is one value of the state store.
BUCKETS = 1024


def _bucket(keys, buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")


def stream_score(events: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Classified events of a stream, joined with a static artifact table.

    Corroboration across sources needs the whole collection, so each event
    counts one source here; the batch run over the stored events adds the rest.
    """
    keyed = events.withColumn("npath", X.normalize_path("executable")).withColumn(
        "source_count", F.lit(1))
    joined = keyed.join(artifact_lookup(artifacts), ["investigation_id", "endpoint_id", "npath"],
                        "left").drop("npath")
    return classify_linked(joined)


def _milliseconds(interval: str | None) -> int | None:
    return None if interval is None else int(pd.Timedelta(interval).total_seconds() * 1000)


def split_undated(events: DataFrame):
    """``(dated, undated)``: undated records take no part in event time."""
    return events.filter("ts IS NOT NULL"), events.filter("ts IS NULL")


def split_late(events: DataFrame, delay: str, *, as_of=None):
    """``(on_time, late)`` by age, so that late rows go to a table of their own."""
    now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    edge = now - F.expr(f"INTERVAL {delay}")
    old = F.coalesce(F.col("ts") < edge, F.lit(False))
    return events.filter(~old), events.filter(old)


def stream_dedupe(events: DataFrame, *, watermark="1 hour") -> DataFrame:
    """First arrival per (case, host, source, record id) within the watermark; dated rows only."""
    dated, _ = split_undated(events)
    return dated.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(
        ["investigation_id", "endpoint_id", "source", "source_record_id"])


def stream_hash_changes(observations: DataFrame, *, delay="1 hour", forget_after: str | None = None,
                        buckets: int = BUCKETS) -> DataFrame:
    """Each dated observation with the one before it at the same path, and what changed.

    The streaming form of :func:`~traceloom.operators.ledger.hash_history`, with the same order. Rows wait in the state
    of their path until the watermark has passed them, so whatever order they arrive in (within ``delay``) they are
    compared in order of time. State is the last digest of a path and what still waits; ``forget_after`` drops it when
    a path has been quiet for so long. Paths share ``buckets`` of state, whose number is fixed
    for a stream; rows go to it packed by bucket. Rows later than the watermark are dropped where it has moved their
    bucket on; :func:`split_late` keeps them apart.
    """
    dated, _ = split_undated(observations)
    known = [c for c in ("seq", "hash", "algorithm", "size_bytes") if c in dated.columns]
    kinds = dict(dated.dtypes)
    numbers = [c for c in known if kinds[c] in ("tinyint", "smallint", "int", "bigint")]
    rows = dated.withWatermark("ts", delay).select(
        _bucket(["endpoint_id", "path"], buckets), "endpoint_id", "path", F.unix_micros("ts").alias("micros"),
        *[F.col(c).cast("long" if c in numbers else "string").alias(c) for c in known])
    told = rows.mapInArrow(pack, "bucket int, first long, rows binary").groupBy("bucket").transformWithState(
        DigestsInOrder(known, numbers, _milliseconds(forget_after)), "rows binary", "append", "EventTime").mapInArrow(
            unpack, f"endpoint_id {kinds['endpoint_id']}, path {kinds['path']}, micros long, "
            + ", ".join(f"{c} {'long' if c in numbers else 'string'}" for c in known)
            + ", previous_micros long, previous_hash string, previous_algorithm string")
    return told.select(
        "endpoint_id", "path", F.timestamp_micros("micros").alias("ts"), *[F.col(c).cast(kinds[c]).alias(c) for c in known],
        X.compare_hash("previous_hash", "previous_algorithm", "hash", "algorithm").alias("status"),
        "previous_hash", F.timestamp_micros("previous_micros").alias("previous_ts"))


def last_seen(heartbeats: DataFrame) -> DataFrame:
    """Latest heartbeat per host (update mode); partial aggregation absorbs a chatty host."""
    return heartbeats.groupBy("endpoint_id").agg(F.max("ts").alias("last_seen"))


def stream_endpoint_health(heartbeats: DataFrame, endpoints: DataFrame | None = None, *,
                           stale_seconds=V.STALE_AFTER_SECONDS, clock="ts", delay="0 seconds",
                           buckets: int = BUCKETS) -> DataFrame:
    """Each change of a host's state: ``never_seen``, ``healthy``, ``stale``, ``revoked``; ``change`` counts them per host.

    ``heartbeats(endpoint_id, ts, status)``; ``endpoints(endpoint_id, status, last_seen)`` is what is known before.
    A host is stale ``stale_seconds`` after its newest heartbeat, in the time of column ``clock``: the heartbeats' own,
    or the time they were received, by which a heartbeat that is replayed late finds its host stale. A heartbeat that
    is no newer changes nothing. A known host that never sent one is told as ``never_seen`` once the clock runs.
    """
    beats = heartbeats.filter(F.col("ts").isNotNull() & F.col(clock).isNotNull()).select(
        _bucket(["endpoint_id"], buckets), "endpoint_id", F.col(clock).alias("clock"), F.unix_micros("ts").alias("micros"), "status")
    kind = dict(beats.dtypes)["endpoint_id"]
    known = None if endpoints is None else endpoints.select(F.col("endpoint_id").cast(kind), "status", F.unix_micros(
        F.col("last_seen").cast("timestamp")).alias("micros")).groupBy(_bucket(["endpoint_id"], buckets)).agg(
            F.collect_list(F.struct("endpoint_id", "micros", "status")).alias("hosts")).groupBy("bucket")
    told = beats.withWatermark("clock", delay).groupBy("bucket").transformWithState(
        HostStates(stale_seconds * 1000),
        f"endpoint_id {kind}, change long, state string, seen long, moment long",
        "append", "EventTime", known)
    return told.select("endpoint_id", "change", "state", F.timestamp_micros("seen").alias("last_seen"),
                       F.timestamp_micros("moment").alias("as_of"))


def stream_sweep_tasks(updates: DataFrame, *, stale_seconds=V.STALE_AFTER_SECONDS):
    """Tasks dispatched and then silent: ``queued`` again, or ``abandoned`` at the limit."""
    def step(key, frames, state):
        if state.hasTimedOut:
            attempts, limit = state.get
            state.remove()
            yield pd.DataFrame({"task_id": [key[0]], "new_status": [
                V.ABANDONED if attempts >= limit else V.QUEUED]})
            return
        for frame in frames:
            last = frame.sort_values("ts").iloc[-1]
            if last["status"] == V.DISPATCHED:
                state.update((int(last["attempts"]), int(last["max_attempts"])))
                state.setTimeoutDuration(stale_seconds * 1000)
            elif state.exists:
                state.remove()

    return updates.groupBy("task_id").applyInPandasWithState(
        step, "task_id string, new_status string", "attempts int, max_attempts int", "append",
        GroupStateTimeout.ProcessingTimeTimeout)


def stream_download_then_run(downloads: DataFrame, events: DataFrame, *,
                             max_hours=V.DOWNLOAD_TO_EXECUTION_HOURS, before_hours=0,
                             watermark="2 hours") -> DataFrame:
    """Downloads whose path an event names within the interval, as a stream-stream join."""
    line = F.col("command_line") if "command_line" in events.columns else F.lit(None).cast("string")
    runs = events.withWatermark("ts", watermark).select(
        F.col("endpoint_id").alias("run_endpoint"), F.col("event_id"), F.col("ts").alias("ran_at"),
        F.explode(F.array_distinct(X.paths_named_by_event(
            F.col("executable"), F.col("full_command_line"), line))).alias("run_path"))
    got = downloads.withWatermark("downloaded_at", watermark)
    return got.join(runs, F.expr(
        f"endpoint_id = run_endpoint AND target_path = run_path "
        f"AND ran_at >= downloaded_at - INTERVAL {int(before_hours)} HOURS "
        f"AND ran_at <= downloaded_at + INTERVAL {int(max_hours)} HOURS")).drop(
            "run_endpoint", "run_path")


def stream_first_runs(downloads: DataFrame, events: DataFrame, *, max_hours=V.DOWNLOAD_TO_EXECUTION_HOURS,
                      delay="2 hours", buckets: int = BUCKETS) -> DataFrame:
    """At most one row per download: the first dated event that names its path, unless that is over ``max_hours`` later.

    The rule of :func:`~traceloom.operators.cross_source.link_downloads` over a stream: per host and path the state
    holds the first run and the downloads that still wait. A download is told when the watermark has passed both it and
    the first run, and let go when ``max_hours`` have passed without one.
    """
    line = F.col("command_line") if "command_line" in events.columns else F.lit(None).cast("string")
    scope = [c for c in ("investigation_id", "endpoint_id") if c in downloads.columns and c in events.columns]
    rest = [c for c in downloads.columns if c not in (*scope, "target_path", "downloaded_at")]
    got = downloads.filter("downloaded_at IS NOT NULL AND coalesce(target_path, '') <> ''").select(
        *scope, F.col("target_path").alias("path"), F.col("downloaded_at").cast("timestamp").alias("at"),
        F.lit(None).cast("string").alias("event_id"), F.lit(None).cast("string").alias("record"),
        F.to_json(F.struct(*rest)).alias("download") if rest else F.lit("{}").alias("download"))
    runs = events.filter("ts IS NOT NULL").select(
        *scope, F.explode(F.array_distinct(X.paths_named_by_event(
            F.col("executable"), F.col("full_command_line"), line))).alias("path"), F.col("ts").alias("at"), "event_id",
        (F.col("source_record_id") if "source_record_id" in events.columns else F.col("event_id")).alias("record"),
        F.lit(None).cast("string").alias("download"))
    keys = [*scope, "path"]
    told = got.unionByName(runs).withColumns({"micros": F.unix_micros("at"), "bucket": _bucket(keys, buckets)}).withWatermark(
        "at", delay).groupBy("bucket").transformWithState(
            FirstRun(keys, int(max_hours * 3_600_000)), ", ".join(f"{k} string" for k in keys)
            + ", downloaded long, download string, event_id string, ran long", "append", "EventTime")
    kinds = ", ".join(f"`{c}` {k}" for c, k in downloads.dtypes if c in rest)
    own = [F.from_json("download", kinds).getField(c).alias(c) for c in rest]
    timed = told.withColumns({"downloaded_at": F.timestamp_micros("downloaded"), "ran_at": F.timestamp_micros("ran")})
    return timed.select(*scope, F.col("path").alias("target_path"), "downloaded_at", *own, "event_id", "ran_at",
                        X.gap_hours("downloaded_at", "ran_at").alias("gap_hours"))


def stream_session_activity(events: DataFrame, *, watermark="1 hour") -> DataFrame:
    """Sittings per host and user: records at most thirty minutes apart."""
    gap = f"{V.ADJACENT_SECONDS} seconds 1 microsecond"
    dated, _ = split_undated(events)
    return dated.withWatermark("ts", watermark).groupBy(
        F.session_window("ts", gap), "endpoint_id", "user").agg(
            F.count("*").alias("records"), F.max("ts").alias("last_seen")).select(
                "endpoint_id", "user", F.col("session_window.start").alias("first_seen"),
                "last_seen", "records")


def session_activity(events: DataFrame) -> DataFrame:
    """The batch form: gaps are found across even slices, so one busy user is not one task."""
    dated, _ = split_undated(events)
    keys = ["endpoint_id", "user"]
    order = [F.col("ts"), F.col("event_id")]
    spaced = previous_value(dated.select(*keys, "ts", "event_id"), keys, order, F.col("ts"),
                            "before")
    opens = F.col("before").isNull() | (
        F.unix_micros("ts") - F.unix_micros("before") > V.ADJACENT_SECONDS * 1_000_000)
    marked = last_value_so_far(spaced, keys, order, F.when(opens, F.col("ts")), "first_seen")
    return marked.groupBy(*keys, "first_seen").agg(
        F.max("ts").alias("last_seen"), F.count("*").alias("records"))
