"""One ordered view of everything observed. Undated entries stay undated."""

from pyspark.sql import DataFrame, functions as F

from .. import vocab as V
from .activity import label
from .events import union_sources
from .ordering import first_rows, number_rows

COLUMNS = ("investigation_id", "endpoint_id", "kind", "ts", "title", "detail", "source",
           "classification", "reference_kind", "reference_id")


def _entry(df, kind, ts, title, detail, source, classification, reference_kind, reference_id):
    def lit(value):
        return value if not isinstance(value, str) else F.lit(value)
    endpoint = F.col("endpoint_id") if "endpoint_id" in df.columns else F.lit(None).cast("string")
    values = (F.col("investigation_id"), endpoint, lit(kind), ts.cast("timestamp"), lit(title),
              lit(detail), lit(source), lit(classification), lit(reference_kind),
              reference_id.cast("string"))
    return df.select(*[v.alias(n) for v, n in zip(values, COLUMNS)])


def _or(df, column, default="event_id"):
    return (F.coalesce(F.col(column), F.col(default)) if column in df.columns
            else F.col(default))


def _text(df, column, default=None):
    return F.col(column) if column in df.columns else F.lit(default).cast("string")


def build_timeline(events: DataFrame, artifacts: DataFrame | None = None,
                   processes: DataFrame | None = None, findings: DataFrame | None = None,
                   transitions: DataFrame | None = None, *,
                   newest: int | None = None) -> DataFrame:
    """Events, file times, process starts, findings and state changes in one shape.

    ``newest`` keeps that many entries per investigation: the latest dated ones,
    and undated ones only while room is left. ``None`` keeps everything.
    """
    parts = [_entry(
        events, F.coalesce(F.col("evidence_kind"), F.lit(V.EXECUTION_EVIDENCE)), F.col("ts"),
        F.coalesce(label(), F.lit("unnamed process")), _text(events, "evidence_strength"),
        F.col("source"), _text(events, "classification_text", V.HISTORICAL_EVIDENCE),
        "execution_event", _or(events, "reference"))]
    if artifacts is not None:
        parts.append(_entry(
            artifacts, V.ARTIFACT_OBSERVATION, F.col("modified"),
            F.concat("filename", F.lit(" last modified")),
            F.concat(F.lit("file time of "), "path"), F.col("source"),
            F.when(F.col("collection_status") == V.COLLECTED, V.OBSERVED).otherwise(V.UNAVAILABLE),
            "artifact", _or(artifacts, "reference", "path")))
    if processes is not None:
        parts.append(_entry(
            processes, V.PROCESS_SNAPSHOT, F.col("started_at"),
            F.concat(F.coalesce("name", F.lit("unnamed process")), F.lit(" running (PID "),
                     F.col("pid").cast("string"), F.lit(")")),
            "in the current process snapshot", "process_snapshot", V.CURRENT_OBSERVATION,
            "process", F.col("pid")))
    if findings is not None:
        parts.append(_entry(findings, V.FINDING, F.col("ts"), F.col("title"),
                            F.col("explanation"), "correlation", F.col("classification"),
                            "finding", F.col("reference")))
    if transitions is not None:
        parts.append(_entry(
            transitions, V.INVESTIGATION_STATE, F.col("ts"),
            F.concat(F.lit("Investigation state: "), "state"), F.col("detail"), "workstation",
            V.OBSERVED, "transition", F.col("state")))
    merged = union_sources(*parts)
    if newest is None:
        return merged
    order = [F.col("ts").desc_nulls_last(), F.col("kind"), F.col("title"), F.col("reference_id"),
             F.col("endpoint_id")]
    return number_rows(merged, ["investigation_id"], order, "_n").filter(
        F.col("_n") <= newest).drop("_n")


def in_time_order(timeline: DataFrame) -> DataFrame:
    return timeline.orderBy("investigation_id", F.col("ts").asc_nulls_last(), "kind",
                            "reference_id")


def timeline_statistics(timeline: DataFrame) -> DataFrame:
    return timeline.groupBy("investigation_id", "kind").agg(
        F.count("*").alias("entries"), F.count_if(F.col("ts").isNull()).alias("undated"))


def significant_events(groups: DataFrame, findings: DataFrame, artifacts: DataFrame,
                       transitions: DataFrame | None = None, *, limit: int | None = None,
                       order="oldest") -> DataFrame:
    """Urgent activity, findings worth reading, absent artifacts and state changes.

    Adds ``position``; ``limit`` keeps a page of the first so many per investigation.
    """
    urgent = groups.filter(F.col("classification.priority").isin(V.PRIORITY_1, V.PRIORITY_2))
    parts = [
        _entry(urgent, F.col("evidence_kind"), F.coalesce("last_seen", "first_seen"),
               F.coalesce(label(), F.lit("unnamed activity")), F.col("classification.reason"),
               F.array_join("sources", ", "), F.col("classification.category"),
               "execution_event", _or(urgent, "reference", "group_id")),
        _entry(findings.filter(F.col("triage") != V.NOT_HARMFUL), V.FINDING, F.col("ts"),
               F.concat_ws(": ", "reference", "title"), F.col("why"), "correlation",
               F.col("classification"), "finding", F.col("reference")),
        _entry(artifacts.filter(F.col("collection_status") == V.MISSING), V.ARTIFACT_OBSERVATION,
               F.col("modified"), F.concat("filename", F.lit(" named by evidence but absent")),
               F.concat(F.lit("nothing at "), "path"), F.col("source"), V.UNAVAILABLE, "artifact",
               _or(artifacts, "reference", "path"))]
    if transitions is not None:
        parts.append(_entry(
            transitions, V.INVESTIGATION_STATE, F.col("ts"),
            F.concat(F.lit("Investigation state: "), "state"), F.col("detail"), "workstation",
            V.OBSERVED, "transition", F.col("state")))
    by_time = F.col("ts").asc_nulls_last() if order == "oldest" else F.col("ts").desc_nulls_last()
    order = [by_time, F.col("kind"), F.col("title"), F.col("reference_id"), F.col("endpoint_id")]
    if limit is None:
        return number_rows(union_sources(*parts), ["investigation_id"], order, "position")
    return first_rows(union_sources(*parts), ["investigation_id"], order, limit, "position")
