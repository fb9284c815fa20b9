"""Scoring, grouping, ranking, summaries and leads."""

from ...operators import scoring as T
from ..oracle import npath, scored_sql, view_sql
from ..registry import query
from .common import A, F, X, classified, evidence, events, joined, ranked

_C = "classification"


@query("classify_events", scored_sql("scored", """
SELECT event_id, source_count, score, category, priority, presentation, signals FROM scored"""))
def _(spark, sf):
    return classified(spark, sf).select(
        "event_id", F.col("source_count").cast("bigint").alias("source_count"),
        F.col(f"{_C}.score").cast("bigint").alias("score"),
        f"{_C}.category", f"{_C}.priority", f"{_C}.presentation",
        joined(T.signal_names()).alias("signals"))


@query("concern_signals", scored_sql("scored", """
SELECT s.name AS signal, count(*) AS events, count(DISTINCT s.image) AS images FROM (
  SELECT unnest(string_split(signals, ',')) AS name, executable AS image FROM scored
  WHERE signals <> '') s
WHERE s.name NOT IN ('routine_command', 'system_location', 'managed_system_service', 'command_history_only')
GROUP BY ALL"""))
def _(spark, sf):
    wanted = list(T.V.CONCERN_WEIGHTS) + list(T.V.CORROBORATION_WEIGHTS)
    return (classified(spark, sf).select("executable", F.explode(T.signal_names()).alias("signal"))
            .filter(F.col("signal").isin(wanted)).groupBy("signal")
            .agg(F.count("*").alias("events"), F.countDistinct("executable").alias("images")))


@query("context_signals", scored_sql("scored", """
SELECT evidence_kind, coalesce(routine, '-') AS routine, sys AND writable IS NULL AS in_system, interp,
       systemd_unit IS NOT NULL AS managed, count(*) AS events, sum(score) AS total_score
FROM scored WHERE evidence_kind <> 'SESSION_EVENT' GROUP BY ALL"""))
def _(spark, sf):
    return (classified(spark, sf).filter("evidence_kind <> 'SESSION_EVENT'").groupBy(
        "evidence_kind",
        F.coalesce(F.regexp_replace(F.try_element_at(
            F.filter(F.col(f"{_C}.signals"), lambda s: s["name"] == "routine_command"),
            F.lit(1))["detail"], "^Recognised as ", ""), F.lit("-")).alias("routine"),
        T.has_signal("system_location").alias("in_system"),
        X.is_interpreter("executable", "process_name").alias("interp"),
        T.has_signal("managed_system_service").alias("managed"))
        .agg(F.count("*").alias("events"), F.sum(f"{_C}.score").alias("total_score")))


@query("score_and_category", scored_sql("scored", """
SELECT investigation_id, category, score, count(*) AS events FROM scored GROUP BY ALL"""))
def _(spark, sf):
    return classified(spark, sf).groupBy(
        "investigation_id", f"{_C}.category", F.col(f"{_C}.score").cast("bigint").alias("score")
    ).agg(F.count("*").alias("events"))


@query("priority_tier", scored_sql("scored", """
SELECT investigation_id, priority, count(*) AS events,
  count(*) FILTER (priority <> 'PRIORITY_3' AND concern) AS with_action FROM scored GROUP BY ALL"""))
def _(spark, sf):
    return classified(spark, sf).groupBy("investigation_id", f"{_C}.priority").agg(
        F.count("*").alias("events"),
        F.count_if(F.col(f"{_C}.recommended_action").isNotNull()).alias("with_action"))


@query("presentation", scored_sql("scored", """
SELECT endpoint_id, presentation, count(*) AS events FROM scored GROUP BY ALL"""))
def _(spark, sf):
    return classified(spark, sf).groupBy("endpoint_id", f"{_C}.presentation").agg(
        F.count("*").alias("events"))


@query("unknowns", scored_sql("scored", """
SELECT event_id, CASE WHEN evidence_kind = 'SESSION_EVENT' THEN 0 ELSE
  (CASE WHEN evidence_kind = 'COMMAND_HISTORY' THEN 1 ELSE 0 END)
  + (CASE WHEN interp AND cmd = '' THEN 1 ELSE 0 END)
  + (CASE WHEN cmd = '' AND command_reconstruction_status IN ('EXECUTABLE_ONLY', 'NOT_AVAILABLE')
     THEN 1 ELSE 0 END) END AS unknowns,
  (CASE WHEN command_reconstruction_status IN ('EXECUTABLE_ONLY', 'NOT_AVAILABLE') THEN 1 ELSE 0 END)
  + (CASE WHEN ts IS NULL THEN 1 ELSE 0 END) AS limitations
FROM scored"""))
def _(spark, sf):
    return classified(spark, sf).select(
        "event_id", F.size(f"{_C}.unknowns").alias("unknowns"),
        F.size(f"{_C}.limitations").alias("limitations"))


@query("image_corroboration", view_sql(["exec_events"], f"""
SELECT investigation_id, endpoint_id, {npath('executable')} AS npath, count(DISTINCT source) AS sources
FROM exec_events WHERE executable <> '' GROUP BY ALL"""))
def _(spark, sf):
    return T.link_image_facts(events(spark, sf), None).filter("executable <> ''").groupBy(
        "investigation_id", "endpoint_id", X.normalize_path("executable").alias("npath")).agg(
            F.max("source_count").cast("bigint").alias("sources"))


@query("activity_groups", scored_sql("groups", """
SELECT investigation_id, endpoint_id, evidence_kind, coalesce(full_command_line, executable, process_name) AS label,
  occurrences, undated_occurrences, first_seen, last_seen, execution_confirmed, sources,
  score, category, priority, signals FROM groups"""))
def _(spark, sf):
    return A.activity_groups(classified(spark, sf)).select(
        "investigation_id", "endpoint_id", "evidence_kind", A.label().alias("label"),
        "occurrences", "undated_occurrences", "first_seen", "last_seen", "execution_confirmed",
        joined(F.array_sort("sources")).alias("sources"),
        F.col(f"{_C}.score").cast("bigint").alias("score"), f"{_C}.category", f"{_C}.priority",
        joined(T.signal_names()).alias("signals"))


@query("rank_groups", scored_sql("ranked", """
SELECT investigation_id, activity_rank, endpoint_id, evidence_kind, label, score FROM ranked"""))
def _(spark, sf):
    return ranked(spark, sf).select(
        "investigation_id", "activity_rank", "endpoint_id", "evidence_kind",
        A.label().alias("label"), F.col(f"{_C}.score").cast("bigint").alias("score"))


@query("counts_by_kind", view_sql(["exec_events"], """
SELECT investigation_id,
  count(*) FILTER (evidence_kind = 'EXECUTION_EVIDENCE') AS execution_source_records,
  count(*) FILTER (evidence_kind = 'COMMAND_HISTORY') AS command_history_records,
  count(*) FILTER (evidence_kind = 'SESSION_EVENT') AS session_records
FROM exec_events GROUP BY ALL"""))
def _(spark, sf):
    return A.counts_by_kind(A.activity_groups(classified(spark, sf)))


_FACETS = " UNION ALL ".join(
    f"SELECT '{facet}' AS facet, '{value}' AS value" for facet, value in (
        ("category", "POTENTIALLY_HARMFUL"), ("category", "NEEDS_REVIEW"),
        ("category", "NOT_HARMFUL_ON_AVAILABLE_EVIDENCE"), ("priority", "PRIORITY_1"),
        ("priority", "PRIORITY_2"), ("priority", "PRIORITY_3")))


@query("triage_summary", scored_sql("groups", f"""
SELECT i.investigation_id, f.facet, f.value,
  coalesce(sum(g.occurrences), 0) AS records, count(g.akey) AS distinct_activity
FROM (SELECT DISTINCT investigation_id FROM groups) i CROSS JOIN ({_FACETS}) f
LEFT JOIN groups g ON g.investigation_id = i.investigation_id
  AND f.value = CASE f.facet WHEN 'category' THEN g.category ELSE g.priority END
GROUP BY ALL"""))
def _(spark, sf):
    return A.triage_summary(A.activity_groups(classified(spark, sf)))


@query("review_reasons", scored_sql("ranked", """
, why AS (SELECT *, CASE WHEN evidence_kind = 'COMMAND_HISTORY' THEN 'command_history_only'
   WHEN execution_confirmed AND command_reconstruction_status IN ('EXECUTABLE_ONLY', 'NOT_AVAILABLE')
   THEN 'arguments_unavailable' WHEN contains(signals, 'execution_from_writable_location') THEN 'unusual_path'
   WHEN contains(signals, 'remote_content_to_interpreter') OR contains(signals, 'encoded_powershell')
   THEN 'interpreter_context' ELSE 'unclassified' END AS reason FROM ranked WHERE category = 'NEEDS_REVIEW')
SELECT investigation_id, reason, count(*) AS activities, sum(occurrences) AS records,
  string_agg(CASE WHEN rn <= 5 THEN label END, ' | ' ORDER BY activity_rank) AS examples
FROM (SELECT *, row_number() OVER (PARTITION BY investigation_id, reason ORDER BY activity_rank) AS rn FROM why)
GROUP BY ALL"""))
def _(spark, sf):
    return A.review_reasons(ranked(spark, sf)).select(
        "investigation_id", "reason", "activities", "records",
        joined("examples", " | ").alias("examples"))


@query("routine_summary", scored_sql("ranked", """
, r AS (SELECT *, coalesce(process_name, executable, full_command_line) AS name FROM ranked
        WHERE category = 'NOT_HARMFUL_ON_AVAILABLE_EVIDENCE' AND priority = 'PRIORITY_3'),
names AS (SELECT investigation_id, name, min(activity_rank) AS at_rank FROM r GROUP BY ALL),
few AS (SELECT *, row_number() OVER (PARTITION BY investigation_id ORDER BY at_rank, name) AS rn FROM names)
SELECT r.investigation_id, count(*) AS activities, sum(occurrences) AS records,
  (SELECT string_agg(name, ' | ' ORDER BY rn) FROM few WHERE few.investigation_id = r.investigation_id AND rn <= 12) AS examples
FROM r GROUP BY r.investigation_id"""))
def _(spark, sf):
    return A.routine_summary(ranked(spark, sf)).select(
        "investigation_id", "activities", "records", joined("examples", " | ").alias("examples"))


@query("routine_buckets", scored_sql("ranked", """
, r AS (SELECT *, coalesce(routine, CASE WHEN contains(signals, 'managed_system_service') THEN 'managed system services'
   WHEN contains(signals, 'system_location') THEN 'operating-system images in system directories'
   ELSE 'other routine activity' END) AS bucket FROM ranked WHERE presentation = 'ROUTINE_RECOGNIZED'),
c AS (SELECT investigation_id, bucket, label, min(activity_rank) AS at_rank FROM r WHERE label IS NOT NULL GROUP BY ALL),
few AS (SELECT *, row_number() OVER (PARTITION BY investigation_id, bucket ORDER BY at_rank, label) AS rn FROM c),
shown AS (SELECT investigation_id, bucket, string_agg(label, ' | ' ORDER BY rn) AS commands FROM few WHERE rn <= 60 GROUP BY ALL)
SELECT r.investigation_id, r.bucket AS label, count(*) AS activities, sum(occurrences) AS occurrences, any_value(s.commands) AS commands
FROM r LEFT JOIN shown s ON s.investigation_id = r.investigation_id AND s.bucket = r.bucket GROUP BY ALL"""))
def _(spark, sf):
    return A.routine_buckets(ranked(spark, sf)).select(
        "investigation_id", "label", "activities", "occurrences",
        joined("commands", " | ").alias("commands"))


_LEADS = """
, m AS (SELECT *, array_to_string(list_sort(list_filter(string_split(signals, ','), lambda x: x IN (
    'remote_content_to_interpreter', 'download_to_writable_location', 'encoded_powershell',
    'execution_from_writable_location', 'image_absent_after_execution', 'installer_shaped_source'))), ',') AS pattern
  FROM ranked WHERE priority IN ('PRIORITY_1', 'PRIORITY_2')),
l AS (SELECT investigation_id, evidence_kind, priority, pattern, count(*) AS activity_count,
  sum(occurrences) AS record_count, bool_or(execution_confirmed) AS execution_confirmed,
  min(first_seen) AS first_seen, max(last_seen) AS last_seen, min(activity_rank) AS at_rank FROM m GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY investigation_id ORDER BY priority, record_count DESC, at_rank) AS n FROM l)
"""


@query("leads", scored_sql("ranked", _LEADS + """
SELECT investigation_id, 'LEAD-' || lpad(CAST(n AS VARCHAR), 3, '0') AS lead_id, evidence_kind, priority, pattern,
  activity_count, record_count, execution_confirmed, first_seen, last_seen FROM n"""))
def _(spark, sf):
    return A.leads(ranked(spark, sf)).select(
        "investigation_id", "lead_id", "evidence_kind", "priority",
        joined("pattern").alias("pattern"), "activity_count", "record_count",
        "execution_confirmed", "first_seen", "last_seen")


@query("all_leads", scored_sql("ranked", _LEADS + """
SELECT investigation_id, n AS position, evidence_kind, priority, pattern, record_count FROM n"""))
def _(spark, sf):
    return A.leads(ranked(spark, sf), top=None).select(
        "investigation_id", F.regexp_extract("lead_id", "[0-9]+", 0).cast("bigint").alias("position"),
        "evidence_kind", "priority", joined("pattern").alias("pattern"), "record_count")


@query("presentation_filter", scored_sql("groups", """
SELECT investigation_id, endpoint_id, coalesce(full_command_line, executable, process_name) AS label, occurrences
FROM groups WHERE presentation = 'NEEDS_ATTENTION'"""))
def _(spark, sf):
    return A.presentation_filter(A.activity_groups(classified(spark, sf)),
                                 "NEEDS_ATTENTION").select(
        "investigation_id", "endpoint_id", A.label().alias("label"), "occurrences")


@query("triage_back_to_events", scored_sql("groups", """
SELECT s.event_id, g.category, g.priority, g.score FROM scored s JOIN groups g
ON s.investigation_id = g.investigation_id AND s.endpoint_id = g.endpoint_id AND s.akey = g.akey"""))
def _(spark, sf):
    rows = classified(spark, sf)
    return A.triage_back_to_events(A.activity_records(rows), A.activity_groups(rows)).select(
        "event_id", "category", "priority", F.col("score").cast("bigint").alias("score"))


@query("search_activity", scored_sql("groups", """
SELECT g.investigation_id, g.endpoint_id, g.evidence_kind, coalesce(full_command_line, executable, process_name) AS label
FROM groups g WHERE contains(lower(concat_ws(' ', full_command_line, executable, process_name, evidence_kind, category, sources)), 'user1')
  OR EXISTS (SELECT 1 FROM scored s WHERE s.investigation_id = g.investigation_id AND s.endpoint_id = g.endpoint_id
             AND s.akey = g.akey AND contains(lower(s."user"), 'user1'))"""))
def _(spark, sf):
    rows = classified(spark, sf)
    return A.search_activity(A.activity_groups(rows), A.activity_records(rows), "User1 ").select(
        "investigation_id", "endpoint_id", "evidence_kind", A.label().alias("label"))
