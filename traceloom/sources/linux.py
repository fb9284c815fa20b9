"""Linux host records: journal, shell history, audit log, accounting, login sessions."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import functions as X
from .. import vocab as V
from ..operators.events import build_event
from ..operators.ordering import previous_value
from .lines import read_lines, scope, sliced, words
from .ranges import SPLIT, read_fixed_records

_JOURNAL = ("__CURSOR", "__REALTIME_TIMESTAMP", "_BOOT_ID", "_PID", "_UID", "_COMM", "_EXE",
            "_SYSTEMD_UNIT", "_CMDLINE")
_OPT_IN = "collected only on request; arguments can carry credentials"
_MASKED = "credential-like values were masked before storage"


def _journal_rows(lines: DataFrame) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in (*_JOURNAL, "_bad"))
    parsed = lines.filter(F.trim("value") != "").withColumn("j", F.from_json(
        "value", schema, {"columnNameOfCorruptRecord": "_bad"}))
    moment = F.col("j.__REALTIME_TIMESTAMP").try_cast("bigint")
    broken = F.col("j._bad").isNotNull() | ~F.startswith(F.ltrim("value"), F.lit("{"))
    has_exe = F.coalesce(F.col("j._EXE"), F.lit("")) != ""
    return parsed.withColumn("_micros", moment).withColumn(
        "_malformed", broken | (has_exe & moment.isNull())).withColumn("_exe_ok", has_exe)


def journal_status(lines: DataFrame) -> DataFrame:
    """Lines scanned and lines that could not be read, per host."""
    return _journal_rows(lines).groupBy(*scope(lines)).agg(
        F.count("*").alias("scanned"), F.count_if("_malformed").alias("malformed"))


def parse_journal(lines: DataFrame, *, window=None, include_command_lines=False) -> DataFrame:
    """One event per (host, boot, pid, image) with first and last time and the last fields."""
    rows = _journal_rows(lines).filter(~F.col("_malformed") & F.col("_exe_ok"))
    rows = rows.filter(X.in_window(F.timestamp_micros("_micros"), window))
    keys = [*scope(lines), "boot", "pid_text", "exe"]
    grouped = rows.select(
        *scope(lines), F.col("j._BOOT_ID").alias("boot"), F.col("j._PID").alias("pid_text"),
        F.col("j._EXE").alias("exe"), "_micros", "line_no", "j").groupBy(*keys).agg(
            F.min("_micros").alias("first"), F.max("_micros").alias("last"),
            F.count("*").alias("n"), F.max_by("j", F.struct("_micros", "line_no")).alias("j"))
    name = F.coalesce(F.nullif(F.col("j._COMM"), F.lit("")), X.path_basename("exe"))
    line = F.col("j._CMDLINE") if include_command_lines else F.lit(None).cast("string")
    masked = X.redact_command_line(line)
    return build_event(
        grouped, source="systemd journal", record_id=F.col("j.__CURSOR"),
        ts=F.timestamp_micros("first"), last_seen=F.timestamp_micros("last"), confirmed=True,
        evidence_strength="running when it wrote to the journal",
        provenance=F.concat(F.lit("systemd-journald, boot "), "boot"),
        observed={"process_name": name, "executable": F.col("exe"),
                  "pid": F.when(F.col("pid_text").rlike("^[0-9]+$"),
                                F.col("pid_text").try_cast("bigint")),
                  "user": F.col("j._UID"), "command_line": masked["text"]},
        derived={"interpreter": X.interpreter_for(name, "exe")},
        systemd_unit=F.col("j._SYSTEMD_UNIT"),
        unavailable={"parent_process": "the journal records no parent process",
                     "parent_pid": "the journal records no parent pid",
                     "command_line_secrets": F.when(masked["was_redacted"], _MASKED),
                     "command_line": F.when(masked["text"].isNull(), _OPT_IN)},
        raw={"_BOOT_ID": F.col("boot"), "_UID": F.col("j._UID")},
        extra={"journal_record_count": F.col("n")})


def read_journal(spark: SparkSession, path, *, window=None, include_command_lines=False):
    return parse_journal(read_lines(spark, path, numbered=False), window=window,
                         include_command_lines=include_command_lines)


def parse_shell_history(lines: DataFrame, *, window=None) -> DataFrame:
    """Typed commands. A ``#epoch`` line dates the next plain command; zsh lines date themselves."""
    keys = [*scope(lines), "file"]
    text = F.regexp_replace("value", f"^{V.WS}+|{V.WS}+\\z", "")
    rows = sliced(lines, keys).withColumn("_text", text).filter("_text <> ''").withColumn(
        "_stamp", F.nullif(F.regexp_extract("_text", V.BASH_STAMP, 1), F.lit("")).try_cast("bigint")
    ).withColumn("_zsh", F.col("value").rlike(V.ZSH_ENTRY))
    zsh = rows.filter("_zsh").select(
        *keys, "line_no", F.regexp_extract("value", V.ZSH_ENTRY, 1).try_cast("bigint").alias("epoch"),
        F.regexp_extract("value", V.ZSH_ENTRY, 3).alias("command"))
    plain = previous_value(rows.filter("NOT _zsh"), keys, [], F.col("_stamp"), "epoch",
                           sliced=True).filter("_stamp IS NULL").select(
        *keys, "line_no", "epoch", F.col("value").alias("command"))
    shell = (F.when(F.col("file").contains("zsh"), "zsh")
             .when(F.col("file").contains("fish"), "fish").otherwise("bash"))
    both = plain.unionByName(zsh).withColumn("ts", F.timestamp_seconds("epoch")).filter(
        F.col("ts").isNull() | X.in_window("ts", window)).withColumn("shell", shell)
    cleaned = F.regexp_replace("command", f"^{V.WS}+|{V.WS}+\\z", "")
    ready = both.withColumn("_m", X.redact_command_line(cleaned)).withColumn(
        "masked", F.col("_m.text")).withColumn(
        "program", F.nullif(X.first_word(F.coalesce("masked", F.lit(""))), F.lit("")))
    source = F.concat("shell", F.lit(" history"))
    none = F.lit(None).cast("string")
    return build_event(
        ready, source=source, record_id=F.concat_ws(":", "file", F.col("line_no").cast("string")),
        ts=F.col("ts"), kind=V.COMMAND_HISTORY, confirmed=False,
        evidence_strength="entered into a shell; not shown to have run", provenance=F.col("file"),
        observed={"command_line": F.col("masked"), "process_name": F.col("program")},
        derived={"interpreter": F.col("shell"), "executable": none},
        command_from=(F.col("masked"), none, F.col("program")), status=V.EXACT, strength=V.STRONG,
        unavailable={"timestamp": F.when(F.col("ts").isNull(), "the shell stored no time"),
                     "command_line_secrets": F.when(F.col("_m.was_redacted"), _MASKED),
                     "pid": "history records no process id",
                     "parent_pid": "history records no process id",
                     "executable": "history records typed text, not a resolved path"},
        raw={"shell": F.col("shell")})


def read_shell_history(spark: SparkSession, path, *, window=None) -> DataFrame:
    return parse_shell_history(read_lines(spark, path), window=window)


def _audit_rows(lines: DataFrame) -> DataFrame:
    take = lambda pattern: F.nullif(F.regexp_extract("value", pattern, 1), F.lit(""))
    rows = lines.filter(F.contains("value", F.lit("type=SYSCALL"))
                        & F.contains("value", F.lit("exe=")))
    return rows.select(
        *scope(lines), *[c for c in ("file",) if c in lines.columns],
        take(r'\bexe="([^"]+)"').alias("exe"), take(r"\bpid=([0-9]+)").alias("pid"),
        take(r"\bppid=([0-9]+)").alias("ppid"), take(r"\buid=([0-9]+)").alias("uid"),
        take(r'\bcomm="([^"]+)"').alias("comm"),
        take(r"\bmsg=audit\(([0-9]+)\.[0-9]+:[0-9]+\)").try_cast("bigint").alias("seconds"),
        take(r"\bmsg=audit\([0-9]+\.[0-9]+:([0-9]+)\)").alias("serial"))


def audit_status(lines: DataFrame) -> DataFrame:
    return _audit_rows(lines).groupBy(*scope(lines)).agg(
        F.count("*").alias("scanned"),
        F.count_if(F.col("seconds").isNull() | F.col("exe").isNull()).alias("malformed"))


def parse_audit_execve(lines: DataFrame, *, window=None) -> DataFrame:
    """Kernel audit records of an image being executed."""
    rows = _audit_rows(lines).filter("seconds IS NOT NULL AND exe IS NOT NULL").withColumn(
        "ts", F.timestamp_seconds("seconds")).filter(X.in_window("ts", window))
    name = F.coalesce("comm", X.path_basename("exe"))
    return build_event(
        rows, source="kernel audit log", record_id=F.concat(F.lit("audit:"), "serial"),
        ts=F.col("ts"), confirmed=True, evidence_strength="the kernel recorded the execution",
        provenance=F.col("file") if "file" in rows.columns else "audit.log",
        observed={"process_name": name, "executable": F.col("exe"),
                  "pid": F.col("pid").try_cast("bigint"),
                  "parent_pid": F.col("ppid").try_cast("bigint"), "user": F.col("uid")},
        derived={"interpreter": X.interpreter_for(name, "exe")},
        unavailable={"command_line": "arguments are in separate records",
                     "parent_process": "only the parent pid is recorded"},
        raw={"audit_serial": F.col("serial")})


def read_audit_execve(spark: SparkSession, path, *, window=None) -> DataFrame:
    return parse_audit_execve(read_lines(spark, path, numbered=False), window=window)


def parse_process_accounting(lines: DataFrame) -> DataFrame:
    """Rows of four words or more: the name first, the user fourth from the end."""
    rows = lines.withColumn("w", words()).filter(F.size("w") >= 4)
    name = F.element_at("w", 1)
    return build_event(
        rows, source="process accounting",
        record_id=F.concat(F.lit("pacct:"), (F.col("line_no") - 1).cast("string")),
        ts=F.lit(None).cast("timestamp"), confirmed=True,
        evidence_strength="the kernel recorded the exit", provenance="pacct",
        observed={"process_name": name, "user": F.element_at("w", -4)},
        derived={"interpreter": X.interpreter_for(name, F.lit(None).cast("string"))},
        unavailable={"timestamp": "no absolute time in this listing",
                     "executable": "a command name, not a path",
                     "pid": "no process id in this listing"},
        raw={"line": F.col("value")})


def read_process_accounting(spark: SparkSession, path) -> DataFrame:
    return parse_process_accounting(read_lines(spark, path))


def _text_at(offset, width):
    raw = F.make_valid_utf8(F.substring("rec", offset + 1, width).cast("string"))
    return F.substring_index(raw, "\u0000", 1)


def _signed32(value):
    return F.when(value >= 2 ** 31, value - 2 ** 32).otherwise(value)


def parse_login_sessions(files: DataFrame, *, window=None) -> DataFrame:
    """``files(endpoint_id, content)``: small files as rows; a file of odd size is refused."""
    size = V.UTMP_RECORD_BYTES
    whole = files.filter((F.octet_length("content") % size == 0) & (F.octet_length("content") > 0))
    starts = F.sequence(F.lit(0), (F.octet_length("content") / size).cast("int") - 1)
    recs = whole.select(*scope(files), "content", F.explode(starts).alias("n")).select(
        *scope(files), (F.col("n") * size).cast("bigint").alias("offset"),
        F.col("content").substr(F.col("n") * size + 1, F.lit(size)).alias("rec"))
    return parse_login_records(recs, window=window)


def parse_login_records(recs: DataFrame, *, window=None) -> DataFrame:
    """``recs(endpoint_id, offset, rec)``: records of fixed size, each with its place in its file."""
    kinds = F.create_map(*[F.lit(x) for kv in V.SESSION_RECORD_TYPES.items() for x in kv])
    rows = recs.select(
        *scope(recs), "offset", X.little_endian("rec", 0, 2).cast("int").alias("kind"),
        _signed32(X.little_endian("rec", 4, 4)).alias("pid"), _text_at(8, 32).alias("line"),
        _text_at(44, 32).alias("who"), _text_at(76, 256).alias("host"),
        _signed32(X.little_endian("rec", 340, 4)).alias("seconds"))
    rows = rows.withColumn("kind_name", F.try_element_at(kinds, F.col("kind"))).withColumn(
        "ts", F.timestamp_seconds("seconds")).filter(
            "who <> '' AND kind_name IS NOT NULL").filter(X.in_window("ts", window))
    return build_event(
        rows, source="login sessions (wtmp)",
        record_id=F.concat(F.lit("wtmp:"), F.col("offset").cast("string")), ts=F.col("ts"),
        kind=V.SESSION_EVENT, confirmed=False, evidence_strength="session context only",
        provenance="wtmp",
        observed={"user": F.col("who"), "pid": F.nullif("pid", F.lit(0)),
                  "process_name": F.col("kind_name")},
        unavailable={"executable": "sessions, not images", "command_line": "sessions, not commands"},
        extra={"session_line": F.col("line"), "session_host": F.nullif("host", F.lit(""))})


def read_login_sessions(spark: SparkSession, path, *, window=None, split=SPLIT) -> DataFrame:
    """Files of fixed-size records, read in ranges of ``split`` bytes; a file of odd size is refused."""
    recs = read_fixed_records(spark, str(path), V.UTMP_RECORD_BYTES, split=split).withColumn(
        "endpoint_id", F.regexp_extract("path", r"endpoint=([^/]+)", 1)).drop("path")
    return parse_login_records(recs, window=window)
