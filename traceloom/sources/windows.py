"""Windows host records: event XML, prefetch names, UserAssist values."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import functions as X
from .. import vocab as V
from ..operators.events import build_event
from .lines import ENDPOINT_IN_PATH, once, scope

EVENT_SCHEMA = (
    "System struct<EventID:string,EventRecordID:string,TimeCreated:struct<_SystemTime:string>>,"
    "EventData struct<Data:array<struct<_VALUE:string,_Name:string>>>")
_OPT_IN = "collected only on request; arguments can carry credentials"
_MASKED = "credential-like values were masked before storage"


def read_event_xml(spark: SparkSession, path) -> DataFrame:
    """``(endpoint_id, System, EventData)`` from exported event logs.

    An export is a bare run of ``<Event>`` elements, so files are split at the
    closing tag by the reader and each element is parsed on its own.
    """
    raw = spark.read.option("lineSep", "</Event>").option("recursiveFileLookup", "true").text(path)
    start = F.regexp_replace("value", r"(?s)^.*?(?=<Event[\s>])", "")
    return parse_event_xml(raw.filter(F.col("value").rlike(r"<Event[\s>]")).select(
        F.regexp_extract(F.col("_metadata.file_path"), ENDPOINT_IN_PATH, 1).alias("endpoint_id"),
        F.concat(start, F.lit("</Event>")).alias("xml")))


def parse_event_xml(records: DataFrame, column="xml") -> DataFrame:
    return once(records, scope(records), {"_e": F.from_xml(F.col(column), EVENT_SCHEMA)}).select(
        *scope(records), "_e.System", "_e.EventData")


def _data(name) -> Column:
    """The last ``Data`` element with this name."""
    hits = F.filter("EventData.Data", lambda d: d["_Name"] == name)
    return F.nullif(F.try_element_at(hits, F.lit(-1))["_VALUE"], F.lit(""))


def _base(path: Column) -> Column:
    return F.nullif(X.path_basename(path), F.lit(""))


def parse_process_creation(records: DataFrame, *, window=None,
                           include_command_lines=False) -> DataFrame:
    """Event 4688. Absent arguments have one of two reasons, told apart."""
    rows = records.filter(F.col("System.EventID") == "4688").select(
        *scope(records), F.col("System.EventRecordID").alias("rid"),
        F.col("System.TimeCreated._SystemTime").alias("when"), _data("NewProcessName").alias("image"),
        _data("NewProcessId").alias("pid"), _data("ProcessId").alias("ppid"),
        _data("ParentProcessName").alias("parent"), _data("SubjectDomainName").alias("domain"),
        _data("SubjectUserName").alias("who"), _data("CommandLine").alias("line"),
        _data("TokenElevationType").alias("elevation"))
    rows = rows.withColumn("ts", X.parse_timestamp("when")).filter(X.in_window("ts", window))
    given = F.col("line") if include_command_lines else F.lit(None).cast("string")
    masked, name = X.redact_command_line(given), _base(F.col("image"))
    return build_event(
        rows, source="Windows Security 4688", record_id=F.col("rid"), ts=F.col("ts"),
        timestamp_text=F.col("when"), confirmed=True,
        evidence_strength="the system recorded the process creation", provenance="Security log",
        observed={"process_name": name, "executable": F.col("image"),
                  "pid": X.parse_int_any_base("pid"), "parent_pid": X.parse_int_any_base("ppid"),
                  "parent_process": F.col("parent"), "user": X.account_name("domain", "who"),
                  "command_line": masked["text"]},
        derived={"interpreter": X.interpreter_for(name, "image")},
        unavailable={"command_line_secrets": F.when(masked["was_redacted"], _MASKED),
                     "command_line": F.when(F.col("line").isNull(),
                                            "the host does not log command lines")
                     .when(masked["text"].isNull(), _OPT_IN)},
        raw={"TokenElevationType": F.col("elevation")})


def parse_sysmon(records: DataFrame, *, window=None, include_command_lines=False) -> DataFrame:
    """Sysmon event 1, with the parent image and the image digest."""
    rows = records.filter(F.col("System.EventID") == "1").select(
        *scope(records), F.col("System.EventRecordID").alias("rid"),
        F.coalesce(_data("UtcTime"), F.col("System.TimeCreated._SystemTime")).alias("when"),
        _data("Image").alias("image"), _data("ProcessId").alias("pid"),
        _data("ParentProcessId").alias("ppid"), _data("ParentImage").alias("parent"),
        _data("User").alias("who"), _data("Hashes").alias("hashes"),
        _data("CommandLine").alias("line"))
    rows = rows.withColumn("ts", X.parse_timestamp("when")).filter(X.in_window("ts", window))
    given = F.col("line") if include_command_lines else F.lit(None).cast("string")
    masked, name = X.redact_command_line(given), _base(F.col("image"))
    return build_event(
        rows, source="Sysmon Event 1", record_id=F.col("rid"), ts=F.col("ts"),
        timestamp_text=F.col("when"), confirmed=True,
        evidence_strength="the sensor recorded the process creation", provenance="Sysmon log",
        observed={"process_name": name, "executable": F.col("image"),
                  "pid": X.parse_int_any_base("pid"), "parent_pid": X.parse_int_any_base("ppid"),
                  "parent_process": F.col("parent"), "user": F.col("who"),
                  "hash": X.extract_sha256("hashes"), "command_line": masked["text"]},
        derived={"interpreter": X.interpreter_for(name, "image")},
        unavailable={"command_line_secrets": F.when(masked["was_redacted"], _MASKED),
                     "command_line": F.when(masked["text"].isNull(), _OPT_IN)},
        raw={"Hashes": F.col("hashes")})


def parse_powershell_blocks(records: DataFrame, *, window=None, text_limit: int | None = None) -> DataFrame:
    """Event 4104. A block numbered above one is only part of a script; ``text_limit`` cuts its text on request."""
    script = F.trim(_data("ScriptBlockText"))
    script = script if text_limit is None else F.substring(script, 1, text_limit)
    rows = once(records.filter(F.col("System.EventID") == "4104"), scope(records), {
        "rid": F.col("System.EventRecordID"), "when": F.col("System.TimeCreated._SystemTime"), "script": script,
        "path": _data("Path"), "block": _data("ScriptBlockId"), "number": _data("MessageNumber")})
    rows = once(rows, [c for c in rows.columns if c != "script"], {"m": X.redact_command_line("script")})
    rows = rows.withColumn("ts", X.parse_timestamp("when")).filter(X.in_window("ts", window))
    whole = F.col("number").isNull() | (F.col("number") == "1")
    return build_event(
        rows, source="PowerShell 4104", record_id=F.col("rid"), ts=F.col("ts"),
        timestamp_text=F.col("when"), confirmed=True,
        evidence_strength="the block was compiled to run", provenance="PowerShell log",
        observed={"command_line": F.col("m.text"), "process_name": F.lit("powershell"),
                  "executable": F.col("path")}, derived={"interpreter": F.lit("powershell")},
        status=F.when(whole, V.EXACT).otherwise(V.PARTIAL), strength=V.MODERATE,
        unavailable={"command_line_secrets": F.when(F.col("m.was_redacted"), _MASKED),
                     "pid": "the record carries no process id",
                     "parent_pid": "the record carries no parent"},
        raw={"ScriptBlockId": F.col("block"), "MessageNumber": F.col("number")})


def parse_prefetch_listing(inventory: DataFrame, *, window=None) -> DataFrame:
    """``NAME.EXE-HASH.pf`` names and times; file bodies are not read."""
    rows = inventory.filter(F.lower("name").endswith(".pf")).filter(
        X.in_window("modified", window)).withColumn(
            "image", F.coalesce(F.nullif(F.regexp_extract("name", r"^(.*)-[^-]*\z", 1), F.lit("")),
                                "name"))
    return build_event(
        rows, source="Windows Prefetch", record_id=F.col("name"), ts=F.col("modified"),
        confirmed=True, evidence_strength="has run on this volume at least once",
        provenance=F.col("path"), observed={"process_name": F.col("image")},
        derived={"interpreter": X.interpreter_for("image", F.lit(None).cast("string"))},
        unavailable={"executable": "an image name, not a path", "pid": "not recorded",
                     "parent_pid": "not recorded", "command_line": "not recorded",
                     "user": "not recorded"},
        raw={"prefetch_file": F.col("name"), "size_bytes": F.col("size_bytes")})


def parse_userassist(values: DataFrame, *, window=None) -> DataFrame:
    """``values(endpoint_id, guid, name, value BINARY)``: run count at 4, last run at 60."""
    rows = values.filter(F.octet_length("value") >= 68).select(
        *scope(values), "guid", "name", X.rot13("name").alias("decoded"),
        X.little_endian("value", 4, 4).alias("runs"),
        X.filetime_to_ts(X.little_endian("value", 60, 8)).alias("ts")).filter(
            "ts IS NOT NULL").filter(X.in_window("ts", window))
    base = _base(F.col("decoded"))
    return build_event(
        rows, source="UserAssist", record_id=F.concat_ws(":", "guid", "name"), ts=F.col("ts"),
        confirmed=True, evidence_strength="launched through the shell by the user",
        provenance=F.concat(F.lit("UserAssist "), "guid"),
        observed={"executable": F.col("decoded"), "process_name": base},
        derived={"interpreter": X.interpreter_for(base, "decoded")},
        unavailable={"pid": "not recorded", "parent_pid": "not recorded",
                     "command_line": "not recorded"},
        raw={"guid": F.col("guid")}, extra={"run_count": F.col("runs")})
