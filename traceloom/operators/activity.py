"""Repeated records read as one activity, ranked, summarized and turned into leads.

A group row never holds its records: they stay in :func:`activity_records`,
keyed by ``group_id``, so an activity with a third of all records is one narrow
row here and an evenly spread set of rows there.
"""

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab as V
from .ordering import first_rows, number_rows
from .scoring import any_of, has_signal, signal_names

SCOPE = ["investigation_id", "endpoint_id"]


def activity_key() -> Column:
    """The whole command, else the image or name: two different commands never merge."""
    return F.coalesce(
        F.nullif(F.col("full_command_line"), F.lit("")),
        F.concat(F.lit("\u0001exe:"), F.coalesce(F.nullif(F.col("executable"), F.lit("")),
                                                 F.col("process_name"), F.lit(""))))


def group_id() -> Column:
    return F.md5(F.concat_ws("\u0002", *SCOPE, "evidence_kind", activity_key()))


def activity_records(classified: DataFrame) -> DataFrame:
    """Every record with the ``group_id`` of the activity it belongs to."""
    wanted = ["investigation_id", "endpoint_id", "reference", "event_id", "ts", "source",
              "source_record_id", "pid", "user", "full_command_line", "evidence_kind",
              "executable", "process_name", "execution_confirmed", "recognition"]
    return classified.select(group_id().alias("group_id"),
                             *[c for c in wanted if c in classified.columns])


def _order() -> Column:
    return F.struct(F.col("ts").isNull().alias("a"), F.col("ts").alias("b"),
                    F.col("source_record_id").alias("c"), F.col("event_id").alias("d"))


def activity_groups(classified: DataFrame) -> DataFrame:
    """One row per activity; the most urgent classification in it wins.

    Two aggregates: per (activity, source), which combines on the map side down
    to a handful of rows, then per activity over those. Rows this wide are
    aggregated by sorting, so the key that tells activities apart comes first.
    """
    shown = [c for c in ("full_command_line", "normalized_command", "executable", "process_name",
                         "command_reconstruction_status", "command_evidence_strength",
                         "reference", "recognition") if c in classified.columns]
    urgency = F.struct(F.col("classification.priority_rank").alias("p"),
                       F.col("classification.category_rank").alias("q"), _order().alias("o"))
    per_source = (
        classified.withColumn("group_id", group_id()).withColumn("activity_key", activity_key())
        .groupBy("group_id", "source", *SCOPE, "evidence_kind", "activity_key")
        .agg(F.count("*").alias("n"), F.count_if(F.col("ts").isNull()).alias("undated"),
             F.min("ts").alias("first"), F.max("ts").alias("last"),
             F.bool_or("execution_confirmed").alias("ran"),
             F.min(_order()).alias("ord"), F.min_by(F.struct(*shown), _order()).alias("head"),
             F.min(urgency).alias("urg"), F.min_by("classification", urgency).alias("cls")))
    groups = per_source.groupBy("group_id", *SCOPE, "evidence_kind", "activity_key").agg(
        F.sum("n").alias("occurrences"), F.sum("undated").alias("undated_occurrences"),
        F.min("first").alias("first_seen"), F.max("last").alias("last_seen"),
        F.coalesce(F.bool_or("ran"), F.lit(False)).alias("execution_confirmed"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "source"))),
                    lambda s: s["source"]).alias("sources"),
        F.min_by("head", "ord").alias("_head"), F.min_by("cls", "urg").alias("classification"))
    return groups.select(
        *SCOPE, "group_id", "evidence_kind", "activity_key",
        *[F.col(f"_head.{c}").alias(c) for c in shown], "occurrences", "undated_occurrences", "first_seen", "last_seen", "execution_confirmed",
        "sources", "classification")


def urgency_order() -> list[Column]:
    return [F.col("classification.priority_rank").asc(), F.col("classification.score").desc(),
            F.col("classification.category_rank").asc(),
            F.col("execution_confirmed").desc(), F.col("last_seen").desc_nulls_last(),
            F.col("endpoint_id").asc(), F.col("evidence_kind").asc(),
            F.col("activity_key").asc()]


def rank_groups(groups: DataFrame) -> DataFrame:
    """Adds ``activity_rank`` within the investigation, most urgent first."""
    return number_rows(groups, ["investigation_id"], urgency_order(), "activity_rank")


def label() -> Column:
    return F.coalesce(F.nullif(F.col("full_command_line"), F.lit("")),
                      F.nullif(F.col("executable"), F.lit("")), F.col("process_name"))


# --- summaries -------------------------------------------------------------------
def counts_by_kind(groups: DataFrame) -> DataFrame:
    total = lambda kind: F.sum(F.when(F.col("evidence_kind") == kind,      # noqa: E731
                                      F.col("occurrences")).otherwise(0))
    return groups.groupBy("investigation_id").agg(
        total(V.EXECUTION_EVIDENCE).alias("execution_source_records"),
        total(V.COMMAND_HISTORY).alias("command_history_records"),
        total(V.SESSION_EVENT).alias("session_records"))


def triage_summary(groups: DataFrame) -> DataFrame:
    """Records and distinct activities per category and per priority; absent keys count zero."""
    facets = ([("category", c) for c in V.CATEGORY_RANK]
              + [("priority", p) for p in V.PRIORITY_RANK])
    columns = []
    for facet, value in facets:
        hit = F.col(f"classification.{facet}") == value
        columns += [F.sum(F.when(hit, F.col("occurrences")).otherwise(0)).alias(f"r_{value}"),
                    F.count_if(hit).alias(f"g_{value}")]
    wide = groups.groupBy("investigation_id").agg(*columns)
    return wide.select("investigation_id", F.inline(F.array(*[
        F.struct(F.lit(facet).alias("facet"), F.lit(value).alias("value"),
                 F.col(f"r_{value}").alias("records"),
                 F.col(f"g_{value}").alias("distinct_activity"))
        for facet, value in facets])))


def review_reason() -> Column:
    """The first reason that fits; each uncertain activity is counted once."""
    return (F.when(F.col("evidence_kind") == V.COMMAND_HISTORY, "command_history_only")
            .when(F.col("execution_confirmed") & F.col("command_reconstruction_status").isin(
                V.EXECUTABLE_ONLY, V.NOT_AVAILABLE), "arguments_unavailable")
            .when(has_signal("execution_from_writable_location"), "unusual_path")
            .when(any_of([has_signal("remote_content_to_interpreter"),
                          has_signal("encoded_powershell")]), "interpreter_context")
            .otherwise("unclassified"))


def review_reasons(ranked: DataFrame, *, examples=5) -> DataFrame:
    uncertain = ranked.filter(F.col("classification.category") == V.NEEDS_REVIEW).withColumn(
        "reason", review_reason())
    keys = ["investigation_id", "reason"]
    totals = uncertain.groupBy(*keys).agg(F.count("*").alias("activities"),
                                          F.sum("occurrences").alias("records"))
    few = first_rows(uncertain.select(*keys, "activity_rank", label().alias("label")), keys,
                     [F.col("activity_rank")], examples).groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("activity_rank", "label"))),
                    lambda s: s["label"]).alias("examples"))
    described = F.create_map(*[F.lit(x) for kv in V.REVIEW_REASONS.items() for x in kv])
    return totals.join(few, keys).withColumn("description", described[F.col("reason")])


def routine_summary(ranked: DataFrame, *, examples=12) -> DataFrame:
    routine = ranked.filter((F.col("classification.category") == V.NOT_HARMFUL)
                            & (F.col("classification.priority") == V.PRIORITY_3))
    totals = routine.groupBy("investigation_id").agg(F.count("*").alias("activities"),
                                                     F.sum("occurrences").alias("records"))
    name = F.coalesce(F.col("process_name"), F.col("executable"), F.col("full_command_line"))
    names = routine.withColumn("name", name).filter(F.col("name").isNotNull()).groupBy(
        "investigation_id", "name").agg(F.min("activity_rank").alias("at"))
    few = first_rows(names, ["investigation_id"], [F.col("at"), F.col("name")], examples).groupBy(
        "investigation_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))),
                                            lambda s: s["name"]).alias("examples"))
    return totals.join(few, "investigation_id", "left")


def routine_label() -> Column:
    """Recognized software, else why triage called it routine."""
    recognition = F.col("recognition")
    return F.coalesce(
        F.when(recognition["recognized"], F.concat_ws(
            " ", recognition["recognized_name"], recognition["version"])),
        _first_signal_label())


def _first_signal_label() -> Column:
    """The earlier of a routine-command and a managed-service signal decides, then location."""
    telling = F.filter(F.col("classification.signals"), lambda s: s["name"].isin(
        "routine_command", "managed_system_service"))
    first = F.try_element_at(telling, F.lit(1))
    return (F.when(first["name"] == "routine_command",
                   F.regexp_replace(first["detail"], "^Recognised as ", ""))
            .when(first["name"] == "managed_system_service", "managed system services")
            .when(has_signal("system_location"), "operating-system images in system directories")
            .otherwise("other routine activity"))


def presentation_filter(groups: DataFrame, presentation=V.ROUTINE_RECOGNIZED) -> DataFrame:
    return groups.filter(F.col("classification.presentation") == presentation)


def routine_buckets(ranked: DataFrame, *, commands=60) -> DataFrame:
    """Routine activity by label, with counts and the first distinct commands."""
    bucket = (routine_label() if "recognition" in ranked.columns else _first_signal_label())
    routine = presentation_filter(ranked).withColumn("label", bucket)
    keys = ["investigation_id", "label"]
    totals = routine.groupBy(*keys).agg(F.count("*").alias("activities"),
                                        F.sum("occurrences").alias("occurrences"))
    distinct = routine.select(*keys, label().alias("command"), "activity_rank").filter(
        F.col("command").isNotNull()).groupBy(*keys, "command").agg(
            F.min("activity_rank").alias("at"))
    few = first_rows(distinct, keys, [F.col("at"), F.col("command")], commands).groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "command"))),
                    lambda s: s["command"]).alias("commands"))
    return totals.join(few, keys, "left")


# --- leads ------------------------------------------------------------------------
def _signature() -> Column:
    return F.array_sort(F.filter(signal_names(), lambda n: n.isin(list(V.PATTERN_SIGNALS))))


def lead_members(ranked: DataFrame) -> DataFrame:
    """Priority 1 and 2 activities with the pattern they show."""
    return ranked.filter(F.col("classification.priority").isin(V.PRIORITY_1, V.PRIORITY_2)
                         ).withColumn("pattern", _signature())


def leads(ranked: DataFrame, *, top: int | None = None, commands: int = 120) -> DataFrame:
    """One lead per (kind, priority, pattern), numbered per investigation.

    ``commands`` bounds the examples shown on the lead row only; every member is
    in :func:`lead_members`. ``top`` keeps a page of the first so many.
    """
    members = lead_members(ranked)
    keys = ["investigation_id", "evidence_kind", "priority", "pattern"]
    members = members.withColumn("priority", F.col("classification.priority"))
    body = members.groupBy(*keys).agg(
        F.count("*").alias("activity_count"), F.sum("occurrences").alias("record_count"),
        F.bool_or("execution_confirmed").alias("execution_confirmed"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.min("activity_rank").alias("_at"),
        F.min_by("classification", "activity_rank").alias("_first"))
    shown = members.select(*keys, label().alias("command"), "activity_rank").filter(
        F.col("command").isNotNull()).groupBy(*keys, "command").agg(
            F.min("activity_rank").alias("at"))
    few = first_rows(shown, keys, [F.col("at"), F.col("command")], commands).groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "command"))),
                    lambda s: s["command"]).alias("commands"))
    title = F.lit(V.PATTERN_TITLE_OTHER)
    titled = F.transform(F.col("pattern"), lambda n: F.try_element_at(
        F.create_map(*[F.lit(x) for kv in V.PATTERN_TITLES.items() for x in kv]), n))
    title = F.coalesce(F.try_element_at(F.array_compact(titled), F.lit(1)), title)
    full = body.join(few, keys, "left").select(
        *keys, title.alias("title"), F.col("_first.category").alias("category"),
        "activity_count", "record_count", "execution_confirmed", "first_seen", "last_seen",
        "commands", F.transform(F.filter("_first.signals", lambda s: s["weight"] > 0),
                                lambda s: s["detail"]).alias("why"),
        F.col("_first.unknowns").alias("unknowns"),
        F.col("_first.limitations").alias("limitations"),
        F.col("_first.recommended_action").alias("recommended_action"), "_at")
    order = [F.col("priority").asc(), F.col("record_count").desc(), F.col("_at").asc()]
    if top is None:
        numbered = number_rows(full, ["investigation_id"], order, "_n")
    else:
        numbered = first_rows(full, ["investigation_id"], order, top, "_n")
    digits = F.col("_n").cast("string")
    return numbered.withColumn("lead_id", F.concat(F.lit("LEAD-"), F.when(
        F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits))).drop("_at", "_n")


def lead_references(ranked: DataFrame, records: DataFrame, *, limit: int | None = None) -> DataFrame:
    """The evidence references of each lead pattern, in activity order; ``limit`` keeps the first so many."""
    members = lead_members(ranked).select(
        "investigation_id", "group_id", "evidence_kind",
        F.col("classification.priority").alias("priority"), "pattern", "activity_rank")
    cited = records.filter(F.col("reference").isNotNull()).select("group_id", "reference", "ts")
    joined = cited.join(members, "group_id")
    keys = ["investigation_id", "evidence_kind", "priority", "pattern"]
    order = [F.col("activity_rank"), F.col("ts").asc_nulls_last(), F.col("reference")]
    if limit is None:
        return number_rows(joined, keys, order, "position")
    return first_rows(joined, keys, order, limit, "position")


def triage_back_to_events(records: DataFrame, groups: DataFrame) -> DataFrame:
    """Each record with its activity's category, priority and score."""
    look = groups.select("group_id", "classification.category", "classification.priority",
                         "classification.score")
    return records.join(look, "group_id")


def with_group_triage(classified: DataFrame, groups: DataFrame) -> DataFrame:
    """Events with the ``group_id`` of their activity and ``group_triage``, what the activity as a whole was found to be."""
    triage = F.struct("classification.category", "classification.priority", "classification.score")
    return classified.withColumn("group_id", group_id()).join(
        groups.select("group_id", triage.alias("group_triage")), "group_id", "left")


def search_activity(groups: DataFrame, records: DataFrame, term: str) -> DataFrame:
    """Activities whose text, category, sources or users contain the term."""
    if not term:
        return groups
    needle = term.strip().lower()
    text = F.lower(F.concat_ws(" ", "full_command_line", "normalized_command", "executable",
                               "process_name", "evidence_kind", "classification.category",
                               "sources"))
    by_user = records.filter(F.lower("user").contains(needle)).select(
        "group_id").distinct().withColumn("_user", F.lit(True))
    return groups.join(by_user, "group_id", "left").filter(
        text.contains(needle) | F.col("_user")).drop("_user")
