"""The event projection, identity, references and source bookkeeping."""

from pyspark.sql import Column, DataFrame, functions as F

from .. import functions as X
from .. import vocab as V
from .ordering import first_per_key, number_rows

EVENT_COLUMNS = {
    "investigation_id": "string", "endpoint_id": "string", "event_id": "string",
    "ts": "timestamp", "timestamp_text": "string", "last_seen": "timestamp",
    "process_name": "string", "executable": "string", "parent_process": "string",
    "parent_pid": "bigint", "pid": "bigint", "command_line": "string", "interpreter": "string",
    "user": "string", "source": "string", "source_record_id": "string", "hash": "string",
    "classification": "string", "collection_status": "string", "provenance": "string",
    "evidence_strength": "string", "raw": "map<string,string>", "evidence_kind": "string",
    "full_command_line": "string", "command_source": "string",
    "command_reconstruction_status": "string", "command_evidence_strength": "string",
    "normalized_command": "string", "execution_confirmed": "boolean",
    "systemd_unit": "string", "field_provenance": "map<string,string>",
    "unavailable": "map<string,string>", "extra": "map<string,string>",
}


def text_map(values: dict) -> Column:
    """A map of the non-null values of a name -> Column dict."""
    if not values:
        return F.create_map().cast("map<string,string>")
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
                        for k, v in values.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def build_event(df: DataFrame, *, source, record_id, ts, kind=V.EXECUTION_EVIDENCE,
                confirmed=False, classification=V.HISTORICAL_EVIDENCE, evidence_strength="",
                provenance="", observed=None, derived=None, unavailable=None, raw=None,
                extra=None, last_seen=None, timestamp_text=None, status=None, strength=None,
                command_from=None, systemd_unit=None, event_id=None) -> DataFrame:
    """Every event column, present whether or not the source had a value for it.

    ``observed`` and ``derived`` map field names to Columns; ``unavailable`` maps
    a field to the reason it is absent (a null reason means it is not absent).
    ``command_from`` overrides (command line, image, name) for the command fields.
    """
    observed, derived = observed or {}, derived or {}
    unavailable = {k: (v if isinstance(v, Column) else F.lit(v))
                   for k, v in (unavailable or {}).items()}
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)      # noqa: E731
    fields = {**observed, **derived}
    get = lambda name: fields.get(name, F.lit(None).cast("string"))
    line, image, name = command_from or (get("command_line"), get("executable"),
                                         get("process_name"))
    source, when = as_col(source), as_col(ts).cast("timestamp")
    staged = df.select(
        *df.columns,
        X.describe_command(line, image, name, source, status=status,
                           strength=strength).alias("_command"))
    reason = X.command_unavailable_reason(F.col("_command.command_reconstruction_status"), source)
    policy = unavailable.get("command_line", F.lit(None).cast("string"))
    gaps = {**unavailable,
            "full_command_line": F.when(reason.isNotNull(), F.concat_ws(". ", reason, policy))}
    origin = {**{k: F.lit(V.OBSERVED) for k in observed},
              **{k: F.lit(V.DERIVED) for k in derived}}
    for key, why in unavailable.items():
        origin[key] = F.when(why.isNotNull(), V.UNAVAILABLE).otherwise(
            origin.get(key, F.lit(None).cast("string")))
    values = {
        "investigation_id": F.col("investigation_id") if "investigation_id" in df.columns
        else F.lit(None), "endpoint_id": F.col("endpoint_id"),
        **{k: v for k, v in fields.items() if k in EVENT_COLUMNS},
        "ts": when, "timestamp_text": as_col(timestamp_text) if timestamp_text is not None
        else F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
        "last_seen": F.coalesce(as_col(last_seen).cast("timestamp"), when)
        if last_seen is not None else when,
        "source": source, "source_record_id": as_col(record_id),
        "classification": as_col(classification), "collection_status": F.lit(V.AVAILABLE),
        "provenance": as_col(provenance), "evidence_strength": as_col(evidence_strength),
        "raw": text_map(raw or {}), "extra": text_map(extra or {}),
        "evidence_kind": as_col(kind), "execution_confirmed": as_col(confirmed),
        "systemd_unit": systemd_unit if systemd_unit is not None else F.lit(None),
        "field_provenance": text_map(origin), "unavailable": text_map(gaps),
        "event_id": F.coalesce(as_col(event_id), F.concat(source, F.lit(":"), as_col(record_id)))
        if event_id is not None else F.concat(source, F.lit(":"), as_col(record_id)),
        **{k: F.col(f"_command.{k}") for k in (
            "full_command_line", "normalized_command", "command_source",
            "command_reconstruction_status", "command_evidence_strength")},
    }
    return staged.select(*[values.get(k, F.lit(None)).cast(t).alias(k)
                           for k, t in EVENT_COLUMNS.items()])


def dedupe_events(events: DataFrame, *, newest: int | None = None):
    """One event per (case, host, source, record id): the earliest dated one. Adds ``copies``.

    ``newest`` optionally keeps only the latest so many dated events per investigation.
    """
    keys = ["investigation_id", "endpoint_id", "source", "source_record_id"]
    tie = [F.col(c) for c in ("event_id", "executable", "full_command_line")
           if c in events.columns]
    order = [F.col("ts"), *tie]
    counts = events.withColumn("copies", F.lit(1))
    rest = [c for c in counts.columns if c not in keys and c != "copies"]
    parts = [p.alias(f"o{i}") for i, p in enumerate(
        p for c in order for p in (c.isNull(), c))]
    kept = (counts.groupBy(*keys)
            .agg(F.min_by(F.struct(*rest), F.struct(*parts)).alias("_row"),
                 F.sum("copies").alias("copies"))
            .select(*keys, "_row.*", "copies").select(*events.columns, "copies"))
    if newest is None:
        return kept
    ranked = number_rows(kept, ["investigation_id"],
                         [F.col("ts").desc_nulls_last(), *[F.col(k) for k in keys[1:]]], "_newest")
    return ranked.filter(F.col("_newest") <= newest).drop("_newest")


def reference_prefix(kind) -> Column:
    chosen = F.lit(V.OTHER_PREFIX)
    for name, prefix in V.REFERENCE_PREFIX.items():
        chosen = F.when(F.col(kind) == name, F.lit(prefix)).otherwise(chosen)
    return chosen


def padded(prefix, number, width=4) -> Column:
    """``EXEC-0007``; wider numbers keep all their digits."""
    digits = number.cast("string")
    return F.concat(prefix, F.lit("-"), F.when(
        F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits))


def assign_event_references(events: DataFrame) -> DataFrame:
    """A short stable ``reference`` per event, numbered per investigation and prefix."""
    ready = events.withColumn("_prefix", reference_prefix("evidence_kind"))
    order = [F.col("evidence_kind").asc_nulls_first(), F.col("ts").asc_nulls_last(),
             F.col("source_record_id").asc_nulls_first(), F.col("endpoint_id").asc_nulls_first(),
             F.col("source").asc_nulls_first(), F.col("event_id").asc_nulls_first()]
    numbered = number_rows(ready, ["investigation_id", "_prefix"], order, "_n")
    return numbered.withColumn("reference", padded(F.col("_prefix"), F.col("_n"))).drop(
        "_prefix", "_n")


def assign_artifact_references(artifacts: DataFrame, order="collection_order") -> DataFrame:
    numbered = number_rows(artifacts, ["investigation_id"],
                           [F.col(order), F.col("endpoint_id"), F.col("path")], "_n")
    return numbered.withColumn("reference", padded(F.lit("ART"), F.col("_n"))).drop("_n")


def number_findings(findings: DataFrame, order) -> DataFrame:
    numbered = number_rows(findings, ["investigation_id"], order, "_n")
    return numbered.withColumn("reference", padded(F.lit("F"), F.col("_n"))).drop("_n")


def source_status(spark, rows) -> DataFrame:
    """The "where was looked" table from ``(investigation, name, status, detail, count, ...)``."""
    return spark.createDataFrame(
        rows, "investigation_id string, name string, status string, detail string, "
              "event_count bigint, truncated boolean, location string")


def source_statistics(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources queried and available, and dated, undated and total events, per investigation."""
    looked = sources.groupBy("investigation_id").agg(
        F.count("*").alias("queried"),
        F.count_if(F.col("status") == V.AVAILABLE).alias("available"),
        F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("truncated"))
    held = events.groupBy("investigation_id").agg(
        F.count("*").alias("event_count"),
        F.count_if(F.col("ts").isNull()).alias("undated_event_count"))
    return looked.join(held, "investigation_id", "full_outer").select(
        "investigation_id",
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in (
            "queried", "available", "event_count", "undated_event_count")],
        F.coalesce("truncated", F.lit(False)).alias("truncated"))


def events_per_source(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Each source's status with the events it contributed (zero when none)."""
    counts = events.groupBy("investigation_id", F.col("source").alias("name")).agg(
        F.count("*").alias("events"))
    return sources.select("investigation_id", "name", "status").join(
        counts, ["investigation_id", "name"], "left").withColumn(
            "events", F.coalesce("events", F.lit(0)))


def union_sources(*tables: DataFrame) -> DataFrame:
    """All per-source event tables as one."""
    first, *others = tables
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def unique_artifacts(artifacts: DataFrame) -> DataFrame:
    """First record per (case, host, path) in collection order, keyed on the normalized path."""
    keyed = artifacts.withColumn("npath", X.normalize_path("path"))
    return first_per_key(keyed, ["investigation_id", "endpoint_id", "npath"],
                         [F.col("collection_order"), F.col("path")])
