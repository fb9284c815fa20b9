"""What the evidence supports, and where attention is worth spending.

Two judgements kept apart: the category never softens because a record is
common, and the priority comes from a sum over named signals. Signals need
structure (a fetch piped into an interpreter, an image in a writable directory);
a tool's name alone raises nothing, and neither does a missing argument list.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import functions as X
from .. import vocab as V
from .events import unique_artifacts

SIGNAL = "struct<name:string,weight:int,detail:string>"
_W = {**V.CONCERN_WEIGHTS, **V.CORROBORATION_WEIGHTS, **V.CONTEXT_WEIGHTS}


def _signal(name, detail, weight=None) -> Column:
    return F.struct(F.lit(name).alias("name"),
                    (weight if isinstance(weight, Column) else F.lit(
                        _W[name] if weight is None else weight)).cast("int").alias("weight"),
                    (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail"))


def _signals(items) -> Column:
    return F.array_compact(F.array(*[F.when(cond, sig) for cond, sig in items])).cast(
        f"array<{SIGNAL}>")


def link_image_facts(events: DataFrame, artifacts: DataFrame | None) -> DataFrame:
    """Attach ``source_count`` per image and the artifact at the image's path.

    Both joins look up a table with one row per key, so a left side that is
    skewed on one image is split by AQE without changing the result. Records
    without an image get a key of their own that no table holds, so that they
    do not all meet in one task.
    """
    alone = F.concat(F.lit("\u0000"), F.coalesce("event_id", F.lit("")))
    keyed = events.withColumn("npath", F.when(F.col("executable") != "",
                                              X.normalize_path("executable")).otherwise(alone))
    per_image = (keyed.filter(F.coalesce(F.col("executable") != "", F.lit(False)))
                 .select("investigation_id", "endpoint_id", "npath", "source").distinct()
                 .groupBy("investigation_id", "endpoint_id", "npath")
                 .agg(F.count("*").cast("int").alias("source_count"))
                 .filter(F.col("source_count") > 1))
    joined = keyed.join(per_image, ["investigation_id", "endpoint_id", "npath"], "left")
    joined = joined.withColumn("source_count", F.coalesce("source_count", F.lit(1)))
    if artifacts is None:
        none = F.lit(None).cast("string")
        return joined.withColumn("artifact_status", none).withColumn(
            "artifact_hash", none).withColumn("artifact_reference", none).drop("npath")
    return joined.join(artifact_lookup(artifacts), ["investigation_id", "endpoint_id", "npath"],
                       "left").drop("npath")


def artifact_lookup(artifacts: DataFrame) -> DataFrame:
    """What scoring needs to know about the artifact at each (case, host, normalized path)."""
    known = unique_artifacts(artifacts)
    return known.select(
        "investigation_id", "endpoint_id", "npath",
        F.col("collection_status").alias("artifact_status"),
        F.col("hash").alias("artifact_hash"),
        (F.coalesce(F.col("reference"), F.col("path")) if "reference" in known.columns
         else F.col("path")).alias("artifact_reference"))


def _facts(events: DataFrame, rules) -> DataFrame:
    """One boolean or text column per thing the rules look at, each regex run once."""
    have = set(events.columns)
    events = events.withColumn("_lower", F.lower(F.coalesce("executable", F.lit("")))).withColumn(
        "_forward", F.translate("_lower", "\\", "/"))
    spelled = {"forward": F.col("_forward")}
    null = F.lit(None).cast("string")
    command = F.coalesce(F.col("full_command_line"), F.lit(""))
    image = F.coalesce(F.col("executable"), F.lit(""))
    recognition = F.col("recognition") if "recognition" in have else None
    confident = (F.coalesce(recognition["recognized"], F.lit(False))
                 & recognition["confidence"].isin("HIGH", "MODERATE")) if recognition is not None \
        else F.lit(False)
    routine = null
    for pattern, description in reversed(V.ROUTINE_PATTERNS):
        routine = F.when(command.rlike(pattern), F.lit(description)).otherwise(routine)
    facts = {
        "_has_command": command != "",
        "_piped": command.rlike(V.FETCH_TO_INTERPRETER) | command.rlike(V.REMOTE_SCRIPT),
        "_installer": command.rlike(V.INSTALLER_URL),
        "_fetched": command.rlike(V.FETCH_TO_WRITABLE),
        "_encoded": command.rlike(V.ENCODED_POWERSHELL),
        "_writable": X.transient_location(image, **spelled),
        "_routine": routine,
        "_system": X.in_system_location(image, lowered=F.col("_lower"), **spelled),
        "_interpreter": X.is_interpreter(image, F.col("process_name")),
        "_missing": F.coalesce(F.col("artifact_status") == V.MISSING, F.lit(False)),
        "_hashed": F.coalesce((F.col("artifact_status") == V.COLLECTED)
                              & (F.col("artifact_hash") != ""), F.lit(False)),
        "_confirmed": F.coalesce(F.col("execution_confirmed"), F.lit(False)),
        "_recognized": confident,
        "_recognized_high": (confident & (recognition["confidence"] == "HIGH"))
        if recognition is not None else F.lit(False),
        "_recognized_name": F.coalesce(recognition["recognized_name"], F.lit("known software"))
        if recognition is not None else null,
        "_located_only": F.coalesce(recognition["basis_codes"] == F.array(
            F.lit("trusted_system_location")), F.lit(False))
        if recognition is not None else F.lit(False),
        "_managed": (F.coalesce(F.col("systemd_unit"), F.lit("")) != "")
        if "systemd_unit" in have else F.lit(False),
    }
    for index, rule in enumerate(rules):
        facts[f"_rule{index}"] = command.rlike(rule["pattern"])
    return events.select("*", *[c.alias(k) for k, c in facts.items()])


def concern_signals(rules=()) -> Column:
    """Structural concerns, before corroboration. Works on the columns of ``_facts``."""
    writable = F.col("_writable").isNotNull()
    return _signals([
        (F.col("_piped"), _signal("remote_content_to_interpreter",
                                  "remote content goes straight into an interpreter")),
        (F.col("_fetched"), _signal("download_to_writable_location",
                                    "a download is written to a writable location")),
        (F.col("_encoded"), _signal("encoded_powershell",
                                    "PowerShell was given an encoded command")),
        (writable, _signal("execution_from_writable_location", F.concat(
            F.lit("the image runs from the writable location "), F.col("_writable")))),
        (writable & F.col("_missing"), _signal("image_absent_after_execution",
                                               "the image is no longer at its path")),
        *[(F.col(f"_rule{i}"), _signal(r["name"], r.get("detail", r["name"]), r["weight"]))
          for i, r in enumerate(rules)],
    ])


def corroboration_signals() -> Column:
    """Only meaningful next to a concern."""
    return _signals([
        (F.col("_confirmed"), _signal("execution_confirmed", F.concat(
            F.col("source"), F.lit(" records that it ran")))),
        (F.col("source_count") > 1, _signal("corroborated_across_sources", F.concat(
            F.col("source_count").cast("string"), F.lit(" independent sources name this image")))),
        (F.col("_hashed"), _signal("artifact_correlated", F.concat(
            F.lit("a hashed artifact is at the same path: "), F.col("artifact_reference")))),
        (F.col("_piped") & F.col("_installer"),
         _signal("installer_shaped_source", "the URL is shaped like an install script")),
    ])


def context_signals() -> Column:
    """What lowers priority. It never changes the category on its own."""
    known_weight = (F.when(F.col("_interpreter") | ~F.col("_recognized_high"),
                           F.lit(_W["recognized_software"]))
                    .otherwise(F.lit(_W["recognized_software_high"])))
    place_weight = (F.when(F.col("_interpreter"), F.lit(_W["system_location_interpreter"]))
                    .otherwise(F.lit(_W["system_location"])))
    return _signals([
        (F.col("_routine").isNotNull(), _signal("routine_command", F.concat(
            F.lit("Recognised as "), F.col("_routine")))),
        (F.col("_recognized"), _signal("recognized_software", F.concat(
            F.lit("accounted for as "), F.col("_recognized_name")), known_weight)),
        (F.col("_system") & F.col("_writable").isNull(), _signal("system_location", F.concat(
            F.lit("the image is in a system directory: "),
            X.path_dirname(F.lower("executable"))), place_weight)),
        (F.col("_managed"), _signal("managed_system_service", F.concat(
            F.lit("run as the managed service "), F.col("systemd_unit")))
         ),
        (F.col("evidence_kind") == V.COMMAND_HISTORY, _signal(
            "command_history_only", "the text was entered; that does not establish that it ran")),
    ])


def unknowns() -> Column:
    no_arguments = F.col("command_reconstruction_status").isin(V.EXECUTABLE_ONLY, V.NOT_AVAILABLE)
    return F.array_compact(F.array(
        F.when(F.col("_located_only"), F.lit("what a system-directory file no package claims is")),
        F.when(F.col("evidence_kind") == V.COMMAND_HISTORY,
               F.lit("whether the command ran, succeeded, or ran then")),
        F.when(F.col("_interpreter") & ~F.col("_has_command"),
               F.lit("which script or arguments the interpreter was given")),
        F.when(~F.col("_has_command") & no_arguments, F.lit("the command line")),
    ))


def total_weight(signals) -> Column:
    return F.aggregate(signals, F.lit(0), lambda acc, s: acc + s["weight"])


def priority_tier(score) -> Column:
    return (F.when(score >= V.INVESTIGATE_FIRST_AT, V.PRIORITY_1)
            .when(score >= V.REVIEW_AT, V.PRIORITY_2).otherwise(V.PRIORITY_3))


def classify_events(events: DataFrame, artifacts: DataFrame | None = None, *,
                    rules=()) -> DataFrame:
    """Events with a ``classification`` struct.

    ``events`` may carry a ``recognition`` struct. ``rules`` adds concern signals:
    dicts with ``pattern``, ``name``, ``weight`` and optionally ``detail``.
    """
    return classify_linked(link_image_facts(events, artifacts), rules=rules)


def classify_linked(linked: DataFrame, *, rules=()) -> DataFrame:
    """The row-by-row part: needs ``source_count`` and the ``artifact_*`` columns."""
    if "systemd_unit" not in linked.columns:
        linked = linked.withColumn("systemd_unit", F.lit(None).cast("string"))
    facts = _facts(linked, rules)
    kept = [c for c in linked.columns]
    session = F.col("evidence_kind") == V.SESSION_EVENT
    empty = F.array().cast(f"array<{SIGNAL}>")
    two = facts.withColumn("_concern", concern_signals(rules)).withColumn(
        "_context", context_signals()).withColumn("_unknowns", unknowns())
    three = two.withColumn(
        "_signals", F.when(session, empty).otherwise(F.concat(
            F.col("_concern"),
            F.when(F.size("_concern") > 0, corroboration_signals()).otherwise(empty),
            F.col("_context"))))
    rating = three.withColumn("_score", total_weight(F.col("_signals"))).withColumn(
        "_worrying", ~session & F.exists("_concern", lambda s: s["weight"] > 0))
    category = (F.when(session, V.NOT_HARMFUL)
                .when(F.col("_worrying"), V.POTENTIALLY_HARMFUL)
                .when(F.col("_routine").isNotNull(), V.NOT_HARMFUL)
                .when(F.col("_system") & ~F.col("_interpreter"), V.NOT_HARMFUL)
                .otherwise(V.NEEDS_REVIEW))
    priority = F.when(session, V.PRIORITY_3).otherwise(priority_tier(F.col("_score")))
    rating = rating.select("*", category.alias("_category"), priority.alias("_priority"))
    category, priority = F.col("_category"), F.col("_priority")
    reason = (F.when(session, "A session record; it carries no command and no image.")
              .when(F.col("_worrying"), F.concat(
                  F.array_join(F.transform(F.filter("_concern", lambda s: s["weight"] > 0),
                                           lambda s: s["detail"]), "; "),
                  F.when(F.col("_confirmed"), F.lit("; the source records that it ran"))
                  .otherwise(F.lit("; nothing collected establishes that it ran"))))
              .when(F.col("_routine").isNotNull(), F.concat(
                  F.lit("Recognised as "), F.col("_routine"), F.lit("; no concern was found")))
              .when(F.col("_system") & ~F.col("_interpreter"),
                    F.lit("A system image in a system directory; no concern was found"))
              .when(F.col("_has_command"),
                    F.lit("The command is complete but neither routine nor concerning"))
              .when(F.col("evidence_kind") == V.EXECUTION_EVIDENCE, F.concat(
                  F.col("source"), F.lit(" records that "),
                  F.coalesce("executable", "process_name", F.lit("a process")),
                  F.lit(" ran, without its arguments")))
              .otherwise("Neither a command nor an image path is recorded"))
    action = (F.when(F.col("_worrying"),
                     "Read the whole command, then what was written there and what ran next")
              .when(category != V.NEEDS_REVIEW, F.lit(None).cast("string"))
              .when(F.col("_has_command"), "Decide whether the command fits this machine's use")
              .when(F.col("evidence_kind") == V.EXECUTION_EVIDENCE,
                    "Compare with the software expected on this machine"))
    presentation = (F.when(F.col("_worrying"), V.NEEDS_ATTENTION)
                    .when(category == V.NOT_HARMFUL, V.ROUTINE_RECOGNIZED)
                    .when(F.col("_recognized_high") & ~(F.col("_interpreter")
                                                        & ~F.col("_has_command")),
                          V.ROUTINE_RECOGNIZED)
                    .otherwise(V.FOR_REVIEW))
    limitations = X.record_limitations("command_reconstruction_status", "source", "ts",
                                       "unavailable")
    return rating.select(
        *kept,
        F.struct(
            category.alias("category"), X.category_rank(category).alias("category_rank"),
            F.col("_score").alias("score"), priority.alias("priority"),
            X.priority_rank(priority).alias("priority_rank"),
            presentation.alias("presentation"), reason.alias("reason"),
            F.col("_signals").alias("signals"), limitations.alias("limitations"),
            F.when(session, F.array().cast("array<string>")).otherwise(
                F.col("_unknowns")).alias("unknowns"),
            F.when(priority != V.PRIORITY_3, action).alias("recommended_action"),
        ).alias("classification"))


def signal_names(classification="classification") -> Column:
    return F.transform(F.col(f"{classification}.signals"), lambda s: s["name"])


def has_signal(name, classification="classification") -> Column:
    return F.exists(F.col(f"{classification}.signals"), lambda s: s["name"] == name)


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)
