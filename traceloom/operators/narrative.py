"""Sentences assembled from counts, each with the evidence it rests on; briefs per subject."""

from pyspark.sql import Column, DataFrame, functions as F

from .. import functions as X
from .. import vocab as V
from .activity import label
from .events import union_sources
from .ordering import first_rows

MAX_CITED = 30
MAX_RELATED = 12
_EMPTY = "array<string>"


def _n(column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column,
                      F.lit(0)).cast("string")


def record_counts(groups: DataFrame, artifacts: DataFrame, findings: DataFrame,
                  limitations: DataFrame, leads: DataFrame) -> DataFrame:
    """Separately named totals per investigation."""
    def occurrences(condition):
        return F.sum(F.when(condition, F.col("occurrences")).otherwise(0))
    kind, priority = F.col("evidence_kind"), F.col("classification.priority")
    category = F.col("classification.category")
    total = groups.groupBy("investigation_id").agg(
        F.count("*").alias("distinct_activity"),
        occurrences(kind == V.EXECUTION_EVIDENCE).alias("execution_source_records"),
        occurrences(kind == V.COMMAND_HISTORY).alias("command_history_records"),
        occurrences(kind == V.SESSION_EVENT).alias("session_records"),
        occurrences(F.col("execution_confirmed")).alias("execution_confirmed_records"),
        occurrences(priority == V.PRIORITY_1).alias("priority_1"),
        occurrences(priority == V.PRIORITY_2).alias("priority_2"),
        occurrences(priority == V.PRIORITY_3).alias("priority_3"),
        occurrences(category == V.POTENTIALLY_HARMFUL).alias("harmful"),
        occurrences(category == V.NEEDS_REVIEW).alias("review"),
        occurrences(category == V.NOT_HARMFUL).alias("not_harmful"))
    for name, table in (("artifacts", artifacts), ("findings", findings),
                        ("collection_limitations", limitations), ("leads", leads)):
        count = table.groupBy("investigation_id").agg(F.count("*").alias(name))
        total = total.join(count, "investigation_id", "left").withColumn(
            name, F.coalesce(name, F.lit(0)))
    return total.withColumn("package_records", sum(
        (F.col(c) for c in ("execution_source_records", "command_history_records",
                            "session_records", "artifacts", "findings")), F.lit(0)))


def source_names(sources: DataFrame) -> DataFrame:
    """Per investigation: available and unavailable source names, sorted."""
    name = F.col("name")
    good = F.col("status") == V.AVAILABLE
    return sources.groupBy("investigation_id").agg(
        F.count("*").alias("sources"), F.count_if(good).alias("available"),
        F.sort_array(F.collect_set(F.when(good, name))).alias("available_names"),
        F.sort_array(F.collect_set(F.when(~good, F.concat(
            name, F.lit(" ("), F.col("status"), F.lit(")"))))).alias("unavailable_names"))


def _statement(df, section, position, text, ids=None) -> DataFrame:
    cited = F.array().cast(_EMPTY) if ids is None else F.coalesce(ids, F.array().cast(_EMPTY))
    return df.select("investigation_id", F.lit(section).alias("section"),
                     F.lit(position).alias("position") if isinstance(position, int) else position,
                     text.alias("statement"), cited.alias("evidence_ids"))


def _cited(rows: DataFrame, keys, column="id") -> DataFrame:
    """The first ``MAX_CITED`` distinct ids per key, sorted."""
    distinct = rows.filter(F.col(column).isNotNull()).select(*keys, column).distinct()
    return first_rows(distinct, keys, [F.col(column)], MAX_CITED).groupBy(*keys).agg(
        F.array_sort(F.collect_list(column)).alias("ids"))


def case_summary(counts: DataFrame, sources: DataFrame, leads: DataFrame,
                 lead_refs: DataFrame, findings: DataFrame, limitations: DataFrame,
                 threads: DataFrame | None = None,
                 recognized: DataFrame | None = None) -> DataFrame:
    """``(investigation_id, section, position, statement, evidence_ids)`` over seven sections.

    ``lead_refs(investigation_id, priority, lead_id, id)`` are the references of each lead.
    """
    names = source_names(sources)
    base = counts.join(names, "investigation_id", "left")
    parts = [_statement(base, "scope", 1, F.concat(
        _n("distinct_activity"), F.lit(" distinct activities from "), _n("available"),
        F.lit(" of "), _n("sources"), F.lit(" telemetry sources, with "), _n("artifacts"),
        F.lit(" artifacts.")))]
    parts.append(_statement(base.filter(F.size("unavailable_names") > 0), "scope", 2, F.concat(
        F.lit("Not every source could be read: "),
        F.array_join(F.slice("unavailable_names", 1, 6), "; "),
        F.lit(". Nothing follows from what they would have held."))))
    first = leads.filter(F.col("priority") == V.PRIORITY_1)
    refs = _cited(lead_refs, ["investigation_id", "lead_id"])
    shown = first_rows(first, ["investigation_id"], [F.col("lead_id")], 5).join(
        refs, ["investigation_id", "lead_id"], "left")
    parts.append(_statement(shown, "priority", F.substring("lead_id", 6, 9).cast("int").alias(
        "position"), F.concat(
        "title", F.lit(": "), _n("activity_count"), F.lit(" command(s) across "),
        _n("record_count"), F.lit(" record(s), "),
        F.when(F.col("execution_confirmed"), "recorded as having run.").otherwise(
            "not established as having run.")), F.col("ids")))
    none = base.join(first.select("investigation_id").distinct(), "investigation_id", "left_anti")
    parts.append(_statement(none, "priority", 1, F.lit(
        "No priority-1 activity was identified in what was collected.")))
    second = leads.filter(F.col("priority") == V.PRIORITY_2).groupBy("investigation_id").agg(
        F.count("*").alias("n"), F.count_if(~F.col("execution_confirmed")).alias("typed"))
    two = _cited(lead_refs.filter(F.col("priority") == V.PRIORITY_2), ["investigation_id"])
    parts.append(_statement(
        second.join(two, "investigation_id", "left"), "review", 1, F.concat(
            _n("n"), F.lit(" pattern(s) require review"), F.when(F.col("typed") > 0, F.concat(
                F.lit(", "), _n("typed"), F.lit(" of them from command history alone."))
            ).otherwise(".")), F.col("ids")))
    if recognized is not None:
        held = recognized.groupBy("investigation_id").agg(
            F.count_if("recognition.recognized").alias("known"), F.count("*").alias("all"))
        parts.append(_statement(held.filter("known > 0"), "recognition", 1, F.concat(
            _n("known"), F.lit(" of "), _n("all"),
            F.lit(" artifacts are accounted for by metadata; that is not a finding of safety."))))
        loose = recognized.filter(F.col("recognition.basis_codes") == F.array(
            F.lit("trusted_system_location")))
        total = loose.groupBy("investigation_id").agg(F.count("*").alias("n")).join(
            _cited(loose, ["investigation_id"], "reference"), "investigation_id", "left")
        parts.append(_statement(total, "recognition", 2, F.concat(
            _n("n"), F.lit(" file(s) in system directories are claimed by no package.")),
            F.col("ids")))
    if threads is not None:
        lead_thread = threads.groupBy("investigation_id").agg(
            F.count("*").alias("n"), F.min_by(F.struct("title", "activity_count"),
                                              "thread_number").alias("t"))
        parts.append(_statement(lead_thread, "threads", 1, F.concat(
            _n("n"), F.lit(" thread(s) were formed, the first being \""), F.col("t.title"),
            F.lit("\" across "), _n(F.col("t.activity_count")), F.lit(" activities."))))
    split = findings.groupBy("investigation_id").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("priority") == p).alias(p) for p in
                                   V.PRIORITY_RANK])
    levels = F.array_join(F.array_compact(F.array(*[
        F.when(F.col(p) > 0, F.concat(_n(p), F.lit(f" at {p.replace('_', ' ').lower()}")))
        for p in V.PRIORITY_RANK])), ", ")
    parts.append(_statement(
        split.join(_cited(findings, ["investigation_id"], "reference"), "investigation_id", "left"),
        "findings", 1, F.concat(_n("n"), F.lit(" finding(s): "), levels, F.lit(".")),
        F.col("ids")))
    limits = limitations.groupBy("investigation_id").agg(F.count("*").alias("n"))
    parts.append(_statement(limits, "limitations", 1, F.concat(
        _n("n"), F.lit(" collection limitation(s) bound any conclusion."))))
    return union_sources(*parts)


def conclusion(counts: DataFrame, sources: DataFrame,
               threads: DataFrame | None = None) -> DataFrame:
    """A plain reading of the counts, one text per investigation."""
    base = counts.join(source_names(sources), "investigation_id", "left")
    if threads is not None:
        base = base.join(threads.groupBy("investigation_id").agg(F.count("*").alias("threads")),
                         "investigation_id", "left")
    else:
        base = base.withColumn("threads", F.lit(0))
    plural = F.when(F.col("leads") == 1, "").otherwise("s")
    return base.select("investigation_id", F.concat_ws(
        " ",
        F.when(F.col("priority_1") > 0, F.concat(_n("priority_1"), F.lit(
            " records are ranked investigate-first."))).otherwise(
            "Nothing combined enough signals to rank investigate-first."),
        F.when(F.col("priority_2") > 0, F.concat(
            _n("priority_2"), F.lit(" records across "), _n("leads"), F.lit(" distinct pattern"),
            plural, F.lit(" warrant review."))),
        F.when(F.col("threads") > 0, F.concat(_n("threads"), F.lit(
            " groups of related activity read as threads."))),
        F.concat(F.lit("The remaining "), _n("priority_3"), F.lit(" records are informational.")),
        F.when(F.size("unavailable_names") > 0, F.concat(
            F.array_join("unavailable_names", ", "), F.lit(" could not be read."))),
        F.when(F.coalesce("available", F.lit(0)) == 0, F.lit(
            "No historical source was available."))).alias("conclusion"))


def summary_text(counts: DataFrame, sources: DataFrame) -> DataFrame:
    base = counts.join(source_names(sources), "investigation_id", "left")
    return base.select("investigation_id", F.concat_ws(
        " ",
        F.when(F.coalesce("available", F.lit(0)) > 0, F.concat(
            F.lit("Collected from "), F.array_join("available_names", ", "), F.lit(".")))
        .otherwise("No historical telemetry was available."),
        F.concat(_n("execution_source_records"), F.lit(" execution-source, "),
                 _n("command_history_records"), F.lit(" command-history and "),
                 _n("session_records"), F.lit(" session records cover "),
                 _n("distinct_activity"), F.lit(" distinct activities.")),
        F.concat(_n("execution_confirmed_records"), F.lit(" records establish execution.")),
        F.concat(_n("priority_1"), F.lit(" investigate first, "), _n("priority_2"),
                 F.lit(" merit review, "), _n("priority_3"), F.lit(" are informational.")),
        F.concat(_n("harmful"), F.lit(" carry a concern signal, "), _n("review"),
                 F.lit(" are uncertain, "), _n("not_harmful"), F.lit(" show nothing of concern.")),
        F.concat(_n("findings"), F.lit(" findings over "), _n("artifacts"),
                 F.lit(" artifacts; "), _n("collection_limitations"),
                 F.lit(" collection limitations."))).alias("summary"))


FIXED_LIMITATIONS = (
    "A process snapshot records the present only.",
    "Each historical source records something different and says what it proves.",
    "A digest compares bytes; it does not prove authenticity.",
    "Only selected files and files the evidence names were inspected.",
    "Live collection changes a host and is not an atomic snapshot.",
    "Unavailable, skipped and truncated fields stay explicit.",
    "Findings are rule-based triage, not verdicts.",
)


def report_limitations(facts: DataFrame) -> DataFrame:
    """Fixed and conditional statements, one row each.

    ``facts(investigation_id, available, execution_truncated, undated,
    processes_truncated, command_lines_collected, missing_artifacts)``.
    """
    items = [F.lit(text) for text in FIXED_LIMITATIONS] + [
        F.when(F.col("available") == 0, "No historical source was collected here.").otherwise(
            "Absence of an event does not show that a program did not run."),
        F.when(F.col("execution_truncated"), F.lit("Older events were not read.")),
        F.when(F.col("undated") > 0, F.concat(_n("undated"), F.lit(" records carry no time."))),
        F.when(F.col("processes_truncated"), F.lit("The process snapshot was truncated.")),
        F.when(~F.col("command_lines_collected"), F.lit("Command lines were not collected.")),
        F.when(F.col("missing_artifacts") > 0, F.concat(
            _n("missing_artifacts"), F.lit(" named artifacts were absent.")))]
    return facts.select("investigation_id", F.posexplode(F.array_compact(F.array(*items))).alias(
        "position", "statement"))


# --- briefs ---------------------------------------------------------------------------
def _lines(rows: DataFrame, keys, order, text, name) -> DataFrame:
    """The first ``MAX_RELATED`` text lines per key as one array."""
    few = first_rows(rows.withColumn("_t", text), keys, order, MAX_RELATED, "_at")
    return few.groupBy(*keys).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_at", "_t"))), lambda s: s["_t"]).alias(name))


def _section(title, lines, nothing) -> Column:
    return F.struct(F.lit(title).alias("title"), F.when(F.size(lines) > 0, F.col(lines)).otherwise(
        F.array(F.lit(nothing))).alias("lines"))


def _part(title, lines) -> Column:
    return F.struct(F.lit(title).alias("title"), lines.alias("lines"))


def activity_facts(records: DataFrame) -> DataFrame:
    """Per activity: what confirms it, its users, its first records and its references."""
    by = ["group_id"]
    confirmed = F.when(F.col("execution_confirmed"), F.col("source"))
    facts = records.groupBy(*by).agg(
        F.collect_set(confirmed).alias("confirmed_sources"),
        F.collect_set("evidence_kind").alias("kinds"), F.count("*").alias("records"))
    order = [F.col("ts").asc_nulls_last(), F.col("event_id")]
    ident = F.coalesce("reference", "event_id") if "reference" in records.columns else F.col("event_id")
    seen = _lines(records, by, order, F.concat_ws(
        "  ", ident, F.coalesce(F.col("ts").cast("string"), F.lit("undated")), "source"),
        "occurrence_lines")
    ids = _lines(records, by, order, ident, "evidence_ids")
    people = records.filter("user IS NOT NULL").select(*by, "user").distinct()
    users = _lines(people, by, [F.col("user")], F.concat(F.lit("Recorded for user "), "user"),
                   "user_lines")
    for extra in (seen, ids, users):
        facts = facts.join(extra, by, "left")
    return facts


_SCOPE = ["investigation_id", "endpoint_id"]


def _scope(df) -> list[str]:
    """Case and host; the host alone where a table was collected outside any case."""
    return [c for c in _SCOPE if c in df.columns]


def briefs(tables: dict[str, DataFrame], subject_type: str) -> DataFrame:
    """One row per subject of a type, for all subjects at once.

    ``tables`` holds ``groups``, ``records`` and, as the type needs, ``artifacts``,
    ``findings``, ``threads``, ``thread_members``, ``leads``, ``lead_members``,
    ``downloads``, ``connections``.
    """
    makers = {"activity": _activity_briefs, "execution_event": _event_briefs,
              "artifact": _artifact_briefs, "finding": _finding_briefs,
              "thread": _thread_briefs, "lead": _lead_briefs}
    if subject_type not in makers:
        raise ValueError(f"subject type must be one of {', '.join(sorted(makers))}")
    return makers[subject_type](tables)


def _identity(df) -> Column:
    return F.coalesce("reference", "event_id") if "reference" in df.columns else F.col("event_id")


def findings_citing(findings: DataFrame, cited: DataFrame, subjects: DataFrame, keys) -> DataFrame:
    """``finding_lines`` per key of ``subjects (investigation_id, id, *keys)``: the findings that cite its ids."""
    named = cited.select("investigation_id", "finding", "id").distinct().join(
        findings.select("investigation_id", F.col("reference").alias("finding"), "title"),
        ["investigation_id", "finding"])
    own = subjects.select("investigation_id", "id", *[c for c in keys if c != "investigation_id"]).distinct()
    rows = own.join(named, ["investigation_id", "id"]).select(*keys, "finding", "title").distinct()
    return _lines(rows, keys, [F.col("finding")], F.concat_ws("  ", "finding", "title"), "finding_lines")


def sessions_of_users(records: DataFrame) -> DataFrame:
    """``session_lines`` per activity: the sessions of the users it is recorded for, on the same host."""
    scope = _scope(records)
    sessions = records.filter((F.col("evidence_kind") == V.SESSION_EVENT) & F.col("user").isNotNull()).groupBy(
        *scope, "user").agg(F.count("*").alias("sessions"), F.min("ts").alias("from"), F.max("ts").alias("to"))
    people = records.filter("user IS NOT NULL").select("group_id", *scope, "user").distinct()
    rows = people.join(sessions, [*scope, "user"])
    text = F.concat_ws(" ", "user", F.lit("had"), F.col("sessions").cast("string"), F.lit("session record(s)"),
                       F.concat(F.lit("from "), F.col("from").cast("string")),
                       F.concat(F.lit("to "), F.col("to").cast("string")))
    return _lines(rows, ["group_id"], [F.col("user")], text, "session_lines")


def threads_of_groups(threads: DataFrame, members: DataFrame) -> DataFrame:
    """``thread_lines`` per activity: the thread it is part of."""
    keys = ["investigation_id", "root", "piece"]
    rows = members.select(*keys, "group_id").join(threads.select(*keys, "thread_number", "title"), keys)
    name = F.concat(F.lit("THREAD-"), F.lpad(F.col("thread_number").cast("string"), 3, "0"))
    return _lines(rows, ["group_id"], [F.col("thread_number")], F.concat_ws("  ", name, "title"), "thread_lines")


def mounts_over(paths: DataFrame, mounts: DataFrame) -> DataFrame:
    """``mount_lines`` per (case, host, path) of ``paths``: the mounts the path lies under, deepest first."""
    scope = _scope(mounts)
    points = mounts.select(*scope, F.col("mount_point").alias("up"), "device").distinct()
    above = paths.select(*_SCOPE, "path").distinct().withColumn("up", F.explode(X.path_ancestors("path")))
    rows = above.join(points, [*scope, "up"])
    return _lines(rows, [*_SCOPE, "path"], [F.length("up").desc(), F.col("device")],
                  F.concat_ws("  ", "up", "device"), "mount_lines")


def _with_lines(df: DataFrame, lines: DataFrame | None, keys, name) -> DataFrame:
    """Attach an array of lines; without its tables the column is null, and its section is left out."""
    return df.withColumn(name, F.lit(None).cast(_EMPTY)) if lines is None else df.join(
        lines, keys, "left").withColumn(name, F.coalesce(name, F.array().cast(_EMPTY)))


def _optional(title, lines, nothing) -> Column:
    return F.when(F.col(lines).isNotNull(), _section(title, lines, nothing))


def _state(df) -> DataFrame:
    state = X.execution_state("confirmed_sources", "kinds")
    return df.withColumn("execution_state", state["state"]).withColumn(
        "execution_sources", state["sources"])


def _activity_context(tables) -> DataFrame:
    groups = _state(tables["groups"].join(activity_facts(tables["records"]), "group_id", "left"))
    if "connections" in tables:
        sockets = tables["connections"].filter("process_name IS NOT NULL")
        net = _lines(sockets, _scope(sockets) + ["process_name"],
                     [F.col("remote_address"), F.col("status")],
                     F.concat_ws(" ", F.concat_ws(" -> ", "process_name", "remote_address"),
                                 "status"), "network_lines")
        groups = groups.join(net, _scope(sockets) + ["process_name"], "left")
    else:
        groups = groups.withColumn("network_lines", F.array().cast(_EMPTY))
    if "downloads" in tables:
        named = tables["downloads"].withColumnRenamed("target_path", "executable").filter(
            "executable IS NOT NULL")
        down = _lines(named, _scope(named) + ["executable"], [F.col("url")],
                      F.concat(F.lit("Downloaded from "), "url"), "browser_lines")
        groups = groups.join(down, _scope(named) + ["executable"], "left")
    else:
        groups = groups.withColumn("browser_lines", F.array().cast(_EMPTY))
    records = tables["records"]
    cited = None
    if "finding_evidence" in tables and "findings" in tables:
        cited = findings_citing(tables["findings"], tables["finding_evidence"], records.select(
            "investigation_id", _identity(records).alias("id"), "group_id"), ["group_id"])
    threads = None
    if "threads" in tables and "thread_members" in tables:
        threads = threads_of_groups(tables["threads"], tables["thread_members"])
    mounts = None
    if "mounts" in tables:
        images = groups.filter("executable IS NOT NULL").withColumnRenamed("executable", "path")
        mounts = mounts_over(images, tables["mounts"]).withColumnRenamed("path", "executable")
    groups = _with_lines(groups, cited, ["group_id"], "finding_lines")
    groups = _with_lines(groups, threads, ["group_id"], "thread_lines")
    groups = _with_lines(groups, mounts, [*_SCOPE, "executable"], "mount_lines")
    return _with_lines(groups, sessions_of_users(records), ["group_id"], "session_lines")


def _activity_briefs(tables) -> DataFrame:
    rows = _activity_context(tables)
    recognized = (F.col("recognition.recognized") if "recognition" in rows.columns
                  else F.lit(None).cast("boolean"))
    return rows.select(
        "investigation_id", F.lit("activity").alias("subject_type"),
        F.col("group_id").alias("subject_id"), label().alias("label"),
        F.col("classification.category").alias("category"),
        F.col("classification.presentation").alias("presentation"),
        F.col("classification.priority").alias("priority"), "execution_state",
        "execution_sources", X.recognition_state(recognized).alias("recognition_state"),
        F.concat(label(), F.lit(": recorded "), _n("occurrences"), F.lit(" time(s) by "),
                 F.array_join("sources", ", "), F.lit("; execution "),
                 F.lower("execution_state"), F.lit(".")).alias("summary"),
        F.array_compact(F.array(F.col("classification.reason"))).alias("known"),
        F.col("classification.unknowns").alias("unknown"),
        F.array_compact(F.array(
            _section("Occurrences", "occurrence_lines", "no record"),
            _section("Browser context", "browser_lines", "no download names this image"),
            _section("Network context", "network_lines", "no socket of this name"),
            _section("User and session context", "user_lines", "no user recorded"),
            _section("Sessions of these users", "session_lines", "no session recorded"),
            _optional("Findings that cite it", "finding_lines", "no finding cites it"),
            _optional("Thread", "thread_lines", "part of no thread"),
            _optional("Removable media", "mount_lines", "under no listed mount"))).alias("sections"),
        F.coalesce("evidence_ids", F.array().cast(_EMPTY)).alias("evidence_ids"),
        F.array_compact(F.array(F.col("classification.recommended_action"))).alias(
            "suggested_review"))


def _event_briefs(tables) -> DataFrame:
    """An event is briefed as the activity it belongs to, under its own reference."""
    records = tables["records"]
    ident = F.coalesce("reference", "event_id") if "reference" in records.columns else F.col("event_id")
    own = records.select("group_id", ident.alias("_id"))
    body = _activity_briefs(tables)
    return own.join(body.withColumnRenamed("subject_id", "group_id"), "group_id").withColumn(
        "subject_type", F.lit("execution_event")).withColumnRenamed("_id", "subject_id").select(
            *body.columns)


def _artifact_briefs(tables) -> DataFrame:
    from .cross_source import named_paths, paths_in_events
    from .events import unique_artifacts
    known = unique_artifacts(tables["artifacts"])
    naming = paths_in_events(tables["records"]).groupBy(*_SCOPE, "path").agg(
        F.sum("mentions").alias("naming"), F.min("first.event").alias("first_event"),
        F.bool_or("first.execution_confirmed").alias("ran"))
    rows = known.join(naming, [*_SCOPE, "path"], "left")
    same = known.filter("hash IS NOT NULL").groupBy(*_SCOPE, "hash").agg(
        (F.count("*") - 1).alias("same_hash"))
    rows = rows.join(same, [*_SCOPE, "hash"], "left")
    if "downloads" in tables:
        named = tables["downloads"].withColumnRenamed("target_path", "path")
        down = named.groupBy(*_scope(named), "path").agg(F.count("*").alias("download_count"),
                                       F.min("url").alias("url"))
        rows = rows.join(down, _scope(named) + ["path"], "left")
    else:
        rows = rows.withColumn("download_count", F.lit(0)).withColumn("url", F.lit(None))
    told = ["category", "presentation", "priority", "priority_rank", "category_rank"]
    judged = tables["groups"].select("group_id", *[F.col(f"classification.{c}").alias(c) for c in told])
    by_path = named_paths(tables["records"]).join(judged, "group_id").groupBy(*_SCOPE, "path").agg(
        F.min_by(F.struct(*told[:3]), F.struct("priority_rank", "category_rank", "group_id")).alias("judged"))
    rows = rows.join(by_path, [*_SCOPE, "path"], "left")
    cited = mounts = None
    ident = F.coalesce("reference", "path") if "reference" in rows.columns else F.col("path")
    if "finding_evidence" in tables and "findings" in tables:
        cited = findings_citing(tables["findings"], tables["finding_evidence"],
                                rows.withColumn("id", ident), [*_SCOPE, "path"])
    if "mounts" in tables:
        mounts = mounts_over(rows, tables["mounts"])
    rows = _with_lines(rows, cited, [*_SCOPE, "path"], "finding_lines")
    rows = _with_lines(rows, mounts, [*_SCOPE, "path"], "mount_lines")
    name = X.path_basename("path")
    recognized = (F.col("recognition.recognized") if "recognition" in rows.columns
                  else F.lit(None).cast("boolean"))
    title = (F.col("recognition.recognized_name") if "recognition" in rows.columns
             else F.lit(None).cast("string"))
    named = F.coalesce("naming", F.lit(0)) > 0
    return rows.select(
        "investigation_id", F.lit("artifact").alias("subject_type"), ident.alias("subject_id"),
        F.col("path").alias("label"), F.col("judged.category").alias("category"),
        F.col("judged.presentation").alias("presentation"),
        F.col("judged.priority").alias("priority"),
        F.when(F.col("ran"), "CONFIRMED").otherwise("NOT ESTABLISHED").alias("execution_state"),
        F.array().cast(_EMPTY).alias("execution_sources"),
        X.recognition_state(recognized).alias("recognition_state"),
        F.concat(name, F.lit(" at "), "path", F.lit("; "), _n("naming"),
                 F.lit(" record(s) name it.")).alias("summary"),
        F.array_compact(F.array(
            F.when(F.col("hash").isNotNull(), F.concat(F.lit("digest "), "hash")),
            F.when(F.col("size_bytes").isNotNull(), F.concat(_n("size_bytes"), F.lit(" bytes"))))
        ).alias("known"),
        F.array_compact(F.array(
            F.when(~F.coalesce(recognized, F.lit(False)), F.lit("what this file is")),
            F.when(~named, F.lit("whether it ever ran")),
            F.when(F.coalesce("download_count", F.lit(0)) == 0, F.lit("how it arrived")))).alias(
                "unknown"),
        F.array_compact(F.array(
            _part("Related activity", F.array(F.when(named, F.concat(
                _n("naming"), F.lit(" mention(s), first "), "first_event")).otherwise("none"))),
            _part("Related artifacts", F.array(F.concat(
                _n("same_hash"), F.lit(" other file(s) with this digest")))),
            _part("Browser context", F.array(F.coalesce("url", F.lit("none")))),
            _optional("Findings that cite it", "finding_lines", "no finding cites it"),
            _optional("Removable media", "mount_lines", "under no listed mount"))).alias("sections"),
        F.array_compact(F.array(ident, F.col("first_event"))).alias("evidence_ids"),
        X.suggested_review(recognized, title, F.col("naming"), F.col("download_count")).alias(
            "suggested_review"))


def _finding_briefs(tables) -> DataFrame:
    rows = tables["findings"]
    ids = F.transform("evidence_references", lambda r: r["id"])
    return rows.select(
        "investigation_id", F.lit("finding").alias("subject_type"),
        F.col("reference").alias("subject_id"), F.col("title").alias("label"),
        F.col("triage").alias("category"), F.lit(None).cast("string").alias("presentation"),
        "priority", F.lit(None).cast("string").alias("execution_state"),
        F.array().cast(_EMPTY).alias("execution_sources"),
        F.lit(None).cast("string").alias("recognition_state"),
        F.col("explanation").alias("summary"), F.array("why").alias("known"),
        F.col("unknowns").alias("unknown"),
        F.array(_part("Evidence this rests on", F.transform(
            "evidence_references", lambda r: F.concat_ws("  ", r["kind"], r["id"]))),
            _part("Confidence", F.array("confidence", F.concat(F.lit("Severity: "), "severity")))
        ).alias("sections"),
        F.array_sort(F.array_compact(ids)).alias("evidence_ids"),
        F.array_compact(F.array("recommended_action")).alias("suggested_review"))


def _members_state(members: DataFrame, records: DataFrame, keys) -> DataFrame:
    """What confirms any record of a set of activities."""
    look = members.select(*keys, "group_id").distinct()
    rows = records.select("group_id", "source", "evidence_kind", "execution_confirmed").groupBy(
        "group_id").agg(F.collect_set(F.when(F.col("execution_confirmed"), F.col("source"))).alias(
            "c"), F.collect_set("evidence_kind").alias("k"))
    merged = look.join(rows, "group_id").groupBy(*keys).agg(
        F.array_distinct(F.flatten(F.collect_set("c"))).alias("confirmed_sources"),
        F.array_distinct(F.flatten(F.collect_set("k"))).alias("kinds"))
    return _state(merged).drop("confirmed_sources", "kinds")


def _thread_briefs(tables) -> DataFrame:
    keys = ["investigation_id", "root", "piece"]
    members = tables["thread_members"]
    state = _members_state(members, tables["records"], keys)
    ids = _lines(members, keys, [F.col("place")], F.coalesce("reference", "group_id")
                 if "reference" in members.columns else F.col("group_id"), "evidence_ids")
    rows = tables["threads"].join(state, keys, "left").join(ids, keys, "left")
    return rows.select(
        "investigation_id", F.lit("thread").alias("subject_type"),
        F.concat(F.lit("THREAD-"), F.lpad(F.col("thread_number").cast("string"), 3, "0")).alias(
            "subject_id"), F.col("title").alias("label"), "category",
        F.lit(None).cast("string").alias("presentation"), "priority", "execution_state",
        "execution_sources", F.lit(None).cast("string").alias("recognition_state"),
        F.concat("title", F.lit(". "), F.coalesce("reason", F.lit("related")), F.lit(". "),
                 _n("activity_count"), F.lit(" activities, "), _n("record_count"),
                 F.lit(" record(s).")).alias("summary"),
        F.array_compact(F.array("reason")).alias("known"),
        F.array(F.lit("what connected these beyond shared words and timing")).alias("unknown"),
        F.array(_part("Commands", F.col("commands"))).alias("sections"),
        F.coalesce("evidence_ids", F.array().cast(_EMPTY)).alias("evidence_ids"),
        F.array(F.lit("Read the sequence in order.")).alias("suggested_review"))


def _lead_briefs(tables) -> DataFrame:
    keys = ["investigation_id", "evidence_kind", "priority", "pattern"]
    members = tables["lead_members"].withColumn("priority", F.col("classification.priority"))
    state = _members_state(members, tables["records"], keys)
    ids = _lines(members, keys, [F.col("activity_rank")], F.coalesce("reference", "group_id")
                 if "reference" in members.columns else F.col("group_id"), "evidence_ids")
    rows = tables["leads"].join(state, keys, "left").join(ids, keys, "left")
    return rows.select(
        "investigation_id", F.lit("lead").alias("subject_type"),
        F.col("lead_id").alias("subject_id"), F.col("title").alias("label"), "category",
        F.lit(None).cast("string").alias("presentation"), "priority", "execution_state",
        "execution_sources", F.lit(None).cast("string").alias("recognition_state"),
        F.concat("title", F.lit(". "), _n("activity_count"), F.lit(" command(s), "),
                 _n("record_count"), F.lit(" record(s).")).alias("summary"),
        F.col("why").alias("known"), F.col("unknowns").alias("unknown"),
        F.array(_part("Commands in this pattern", F.slice("commands", 1, MAX_RELATED))).alias(
            "sections"),
        F.coalesce("evidence_ids", F.array().cast(_EMPTY)).alias("evidence_ids"),
        F.array_compact(F.array("recommended_action")).alias("suggested_review"))
