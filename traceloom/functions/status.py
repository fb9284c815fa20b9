"""Small decisions over a record's own fields."""

from pyspark.sql import Column, functions as F

from .. import vocab as V
from .paths import _col

__all__ = ["finding_priority", "record_limitations", "finding_source_step", "execution_state",
           "recognition_state", "next_task_state", "swept_task_state", "endpoint_health",
           "provenance_statement", "suggested_review", "describe_predicate", "priority_rank",
           "category_rank"]


def _rank(value: Column, ranks: dict) -> Column:
    chosen = F.lit(max(ranks.values()))
    for name, rank in ranks.items():
        chosen = F.when(value == name, F.lit(rank)).otherwise(chosen)
    return chosen


def priority_rank(priority) -> Column:
    return _rank(_col(priority), V.PRIORITY_RANK)


def category_rank(category) -> Column:
    return _rank(_col(category), V.CATEGORY_RANK)


def finding_priority(triage, reference_kinds, corroborated) -> Column:
    """Investigate-first only when an execution record and an artifact support one statement."""
    triage, kinds, corroborated = _col(triage), _col(reference_kinds), _col(corroborated)
    both = F.array_contains(kinds, "execution_event") & F.array_contains(kinds, "artifact")
    return (F.when(triage == V.NOT_HARMFUL, V.PRIORITY_3)
            .when(triage == V.POTENTIALLY_HARMFUL,
                  F.when(both & corroborated, V.PRIORITY_1).otherwise(V.PRIORITY_2))
            .otherwise(F.when(corroborated, V.PRIORITY_2).otherwise(V.PRIORITY_3)))


def record_limitations(status, source, ts, unavailable) -> Column:
    """Gaps in a record. They are stated; they never raise priority."""
    status, source = _col(status), _col(source)
    return F.array_compact(F.array(
        F.when(status.isin(V.EXECUTABLE_ONLY, V.NOT_AVAILABLE),
               F.concat(F.lit("Arguments were not captured by "), source)),
        F.when(status == V.PARTIAL,
               F.concat(F.lit("Only part of the command was captured by "), source)),
        F.when(_col(ts).isNull(), F.lit("No time is recorded for this entry")),
        F.when(F.map_contains_key(_col(unavailable), "command_line_secrets"),
               F.lit("Credential-like values were masked before storage"))))


def finding_source_step(reference_kinds) -> Column:
    kinds = _col(reference_kinds)
    has = lambda kind: F.array_contains(kinds, kind)      # noqa: E731
    return (F.when(has("execution_event") | has("telemetry_source"), "EXECUTION HISTORY")
            .when(has("artifact"), "ARTIFACTS").when(has("process"), "PROCESSES"))


def execution_state(confirmed_sources, kinds) -> Column:
    """``struct<state, sources>`` from the confirming sources and the kinds of a record set."""
    sources, kinds = F.array_sort(F.array_compact(_col(confirmed_sources))), _col(kinds)
    state = (F.when(F.size(sources) > 0, "CONFIRMED")
             .when(F.array_contains(kinds, V.COMMAND_HISTORY), "NOT ESTABLISHED")
             .when(F.array_contains(kinds, V.PROCESS_SNAPSHOT), "CURRENT ONLY")
             .otherwise("NOT ESTABLISHED"))
    return F.struct(state.alias("state"), sources.alias("sources"))


def recognition_state(recognized) -> Column:
    recognized = _col(recognized)
    return (F.when(recognized.isNull(), "NOT APPLICABLE")
            .when(recognized, "RECOGNIZED").otherwise("UNKNOWN"))


def next_task_state(ok, result, attempts, max_attempts) -> Column:
    """``struct<status, delay_seconds, error_code>`` once an endpoint reports a task."""
    ok, result, attempts = F.coalesce(_col(ok), F.lit(True)), _col(result), _col(attempts)
    too_large = F.octet_length(result) > V.MAX_RESULT_BYTES
    good = ok & result.isNotNull() & ~F.coalesce(too_large, F.lit(False))
    spent = attempts >= _col(max_attempts)
    delays = F.array(*[F.lit(d) for d in V.RETRY_DELAYS])
    at = F.greatest(F.lit(1), F.least(attempts, F.lit(len(V.RETRY_DELAYS)))).cast("int")
    return F.struct(
        F.when(good, V.SUCCEEDED).when(spent, V.ABANDONED).otherwise(V.QUEUED).alias("status"),
        F.when(~good & ~spent, F.element_at(delays, at)).alias("delay_seconds"),
        F.when(good, F.lit(None).cast("string"))
        .when(ok & F.coalesce(too_large, F.lit(False)), "result_too_large")
        .otherwise("collector_failed").alias("error_code"))


def swept_task_state(status, dispatched_at, attempts, max_attempts, as_of) -> Column:
    """What becomes of a dispatched task nobody reported on; other tasks keep their status."""
    status = _col(status)
    silent = (F.unix_micros(_col(as_of)) - F.unix_micros(_col(dispatched_at))
              >= V.STALE_AFTER_SECONDS * 1_000_000)
    return (F.when((status == V.DISPATCHED) & silent,
                   F.when(_col(attempts) >= _col(max_attempts), V.ABANDONED).otherwise(V.QUEUED))
            .otherwise(status))


def endpoint_health(status, last_seen, as_of) -> Column:
    last = _col(last_seen)
    age = F.unix_micros(_col(as_of)) - F.unix_micros(last)
    return (F.when(_col(status) == "revoked", "revoked")
            .when(last.isNull(), "never_seen")
            .when(age > V.STALE_AFTER_SECONDS * 1_000_000, "stale").otherwise("healthy"))


def provenance_statement(provenance, tool, image_path, image_sha256) -> Column:
    digest = _col(image_sha256)
    return (F.when(_col(provenance) == "REAL",
                   F.concat(F.lit("Read by "), _col(tool), F.lit(" from the image at "),
                            _col(image_path),
                            F.when(digest.isNotNull(), F.concat(F.lit(", SHA-256 "), digest))
                            .otherwise(F.lit(", digest not recorded")),
                            F.lit("; the image was not changed.")))
            .when(_col(provenance) == "FIXTURE",
                  F.lit("From a recorded or made-up fixture; says nothing about a real machine."))
            .otherwise(F.lit("No memory evidence; its absence supports no conclusion.")))


def suggested_review(recognized, recognized_name, naming_count, download_count) -> Column:
    steps = F.array_compact(F.array(
        F.when(~F.coalesce(_col(recognized), F.lit(False)),
               F.lit("Find out what this file is and who or what placed it.")),
        F.when(F.coalesce(_col(recognized), F.lit(False)),
               F.concat(F.lit("Compare the digest with the published one for "),
                        F.coalesce(_col(recognized_name), F.lit("this software")), F.lit("."))),
        F.when(F.coalesce(_col(naming_count), F.lit(0)) > 0,
               F.lit("Read the commands that name this path in full.")),
        F.when(F.coalesce(_col(download_count), F.lit(0)) > 0,
               F.lit("Check the download source and whether it was intended."))))
    return steps


def describe_predicate(predicate: dict) -> str:
    """Readable text of a predicate dict, for labels."""
    kind = predicate["type"]
    if kind == "comparison":
        value = predicate["value"]
        shown = f"[{', '.join(map(str, value))}]" if isinstance(value, list) else str(value)
        return " ".join((predicate["field"], predicate["operator"], shown))
    if kind == "not":
        return "NOT " + describe_predicate(predicate["operand"])
    return "(" + f" {kind.upper()} ".join(map(describe_predicate, predicate["operands"])) + ")"
