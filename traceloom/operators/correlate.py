"""Execution records against the artifacts they name, and what could not be seen."""

from pyspark.sql import DataFrame, functions as F

from .. import functions as X
from .. import vocab as V
from ..session import checkpoint
from .events import union_sources, unique_artifacts
from .findings import all_findings, cite, finding
from .ordering import first_rows

SCOPE = ["investigation_id", "endpoint_id"]


def link_events_artifacts(events: DataFrame, artifacts: DataFrame) -> DataFrame:
    """One row per event with an absolute image: is an artifact there, and its digest."""
    named = events.filter(X.is_absolute("executable")).select(
        *SCOPE, _event_reference(events).alias("execution_event_id"), "source", "executable", "ts",
        X.normalize_path("executable").alias("npath"))
    known = unique_artifacts(artifacts).select(
        *SCOPE, "npath", F.col("hash").alias("artifact_hash"),
        (F.col("collection_status") == V.COLLECTED).alias("_there"))
    return named.join(known, [*SCOPE, "npath"], "left").select(
        *SCOPE, "execution_event_id", "source", "executable",
        F.coalesce("_there", F.lit(False)).alias("artifact_present"), "artifact_hash", "ts")


def _event_reference(events):
    return (F.coalesce(F.col("reference"), F.col("event_id")) if "reference" in events.columns
            else F.col("event_id"))


def image_sources(events: DataFrame) -> DataFrame:
    """Per (host, image): how many sources name it, and the first event that does.

    Aggregated per source first, so a hot image is a few rows before any join.
    """
    order = F.struct(F.col("ts").isNull().alias("a"), F.col("ts").alias("b"),
                     F.col("source_record_id").alias("c"), F.col("event_id").alias("d"))
    per_source = events.filter(X.is_absolute("executable")).groupBy(
        *SCOPE, "executable", "source").agg(
            F.count("*").alias("n"), F.min(order).alias("o"),
            F.min_by(_event_reference(events), order).alias("event"))
    return per_source.groupBy(*SCOPE, "executable").agg(
        F.count("*").cast("int").alias("source_count"), F.sum("n").alias("events"),
        F.min_by("event", "o").alias("event"), F.min_by("source", "o").alias("source"))


def referenced_paths(events: DataFrame) -> DataFrame:
    """Distinct absolute images named by events, with when each was first named."""
    return events.filter(X.is_absolute("executable")).groupBy(
        *SCOPE, F.col("executable").alias("path")).agg(
            F.min("ts").alias("first_named"), F.count("*").alias("events"))


def observe_artifacts(events: DataFrame, selected: DataFrame, inventory: DataFrame,
                      digests: DataFrame) -> DataFrame:
    """Paths that were selected or named, with what a file inventory says about each.

    A digest that was taken is kept, whatever the file's size.

    ``selected(investigation_id, endpoint_id, path)``,
    ``inventory(endpoint_id, path, type, size_bytes, modified, readable)``,
    ``digests(endpoint_id, path, algorithm, hash)``.
    """
    named = referenced_paths(events).select(*SCOPE, X.normalize_path("path").alias("path"),
                                            F.lit(2).alias("_from"))
    chosen = selected.select(*SCOPE, X.normalize_path("path").alias("path"),
                             F.lit(1).alias("_from"))
    wanted = named.unionByName(chosen).groupBy(*SCOPE, "path").agg(F.min("_from").alias("_from"))
    files = inventory.withColumn("path", X.normalize_path("path")).groupBy(
        "endpoint_id", "path").agg(*[F.max(c).alias(c) for c in (
            "type", "size_bytes", "modified", "readable")])
    sums = digests.withColumn("path", X.normalize_path("path")).groupBy(
        "endpoint_id", "path").agg(F.max_by("hash", F.struct("algorithm", "hash")).alias("hash"),
                                   F.max("algorithm").alias("hash_algorithm"))
    seen = wanted.join(files, ["endpoint_id", "path"], "left").join(
        sums, ["endpoint_id", "path"], "left")
    status = (F.when(F.col("type").isNull(), V.MISSING)
              .when(~F.coalesce("readable", F.lit(True)), V.PERMISSION_DENIED)
              .when(F.col("type") != "file", V.NOT_A_FILE)
              .otherwise(V.COLLECTED))
    ready = seen.withColumn("collection_status", status).withColumn(
        "filename", X.path_basename("path"))
    hashed = F.col("collection_status") == V.COLLECTED
    return ready.select(
        *SCOPE, "path", "filename", X.path_extension("filename").alias("extension"),
        F.when(F.col("_from") == 1, "selected path").otherwise(
            "named by execution evidence").alias("source"),
        "collection_status", "size_bytes", "modified",
        F.when(hashed, F.col("hash")).alias("hash"),
        F.when(hashed, F.col("hash_algorithm")).alias("hash_algorithm"),
        X.filename_indicators("filename").alias("indicators"),
        X.notable_location("path").alias("notable_location"))


def merge_artifacts(*tables: DataFrame) -> DataFrame:
    """First record per (case, host, path), in the order the tables are given.

    ``truncated`` is true if any record of the path was, and ``warnings`` (arrays)
    are those of all its records, each once, where the tables have these columns.
    """
    from .ordering import first_per_key
    tagged = [t.withColumn("_table", F.lit(i)) for i, t in enumerate(tables)]
    merged = union_sources(*tagged)
    tie = [F.col(c) for c in ("collection_order", "source", "hash") if c in merged.columns]
    keys = [*SCOPE, "path"]
    first = first_per_key(merged, keys, [F.col("_table"), *tie]).drop("_table")
    gathered = {"truncated": F.coalesce(F.bool_or("truncated"), F.lit(False)),
                "warnings": F.array_sort(F.array_distinct(F.flatten(F.collect_set("warnings"))))} \
        if "warnings" in merged.columns else {
            "truncated": F.coalesce(F.bool_or("truncated"), F.lit(False))}
    gathered = {c: a for c, a in gathered.items() if c in merged.columns}
    if not gathered:
        return first
    over_all = merged.groupBy(*keys).agg(*[a.alias(c) for c, a in gathered.items()])
    return first.drop(*gathered).join(over_all, keys).select(*first.columns)


def artifact_status_counts(artifacts: DataFrame, *, selected="selected path") -> DataFrame:
    """Per (case, status): observations, and how many were selected or only named by evidence."""
    chosen = F.col("source").eqNullSafe(selected)
    return artifacts.groupBy("investigation_id", "collection_status").agg(
        F.count("*").alias("n"), F.count_if(chosen).alias("selected"),
        F.count_if(~chosen).alias("referenced"))


def _named_artifacts(events, artifacts) -> DataFrame:
    known = unique_artifacts(artifacts)
    extra = [c for c in ("reference", "filename") if c in known.columns]
    look = known.select(*SCOPE, "npath", "collection_status", "hash", "hash_algorithm",
                        *[F.col(c).alias(f"artifact_{c}") for c in extra])
    rows = image_sources(events).withColumn("npath", X.normalize_path("executable"))
    rows = rows.join(look, [*SCOPE, "npath"])
    if "artifact_reference" not in rows.columns:
        rows = rows.withColumn("artifact_reference", F.col("executable"))
    return rows.withColumn("notable_location", X.notable_location("npath")).withColumn(
        "artifact_reference", F.coalesce("artifact_reference", "executable"))


def missing_artifacts(events: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Images an event names that were not there, one row per path."""
    return _named_artifacts(events, artifacts).filter(
        F.col("collection_status") == V.MISSING).select(
            *SCOPE, F.col("executable").alias("path"), "source", "event",
            (F.col("source_count") > 1).alias("corroborated"))


def artifact_findings(events: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Missing images, images in writable places, images matched by a hashed artifact."""
    # Three rules read one row per image; it is written once, or each rule's filter would aggregate the events anew.
    rows = checkpoint(_named_artifacts(events, artifacts))
    path, base = F.col("executable"), X.path_basename("executable")
    several = F.col("source_count") > 1
    confidence = F.when(several, V.CORROBORATED).otherwise(V.SINGLE_SOURCE)
    event = cite("execution_event", F.col("event"), source=F.col("source"))
    artifact = cite("artifact", F.col("artifact_reference"), path=path, hash=F.col("hash"),
                    detail=F.col("collection_status"))
    hashed = F.coalesce(F.col("hash"), F.lit("")) != ""
    missing = finding(
        rows.filter(F.col("collection_status") == V.MISSING),
        "execution_artifact_missing", V.MEDIUM,
        F.concat(F.lit("Image named by execution evidence is absent: "), base),
        F.concat(F.col("source"), F.lit(" names "), path,
                 F.lit("; nothing is there now. Upgrades, uninstalls and clean-up look the same.")),
        confidence=confidence, classification=V.INFERRED, references=[event, artifact],
        corroborated=several, action="Look for a package operation around that time",
        unknowns=("why the file is absent",), subject=path)
    unusual = finding(
        rows.filter(X.in_notable_location("executable")),
        "unusual_execution_location", V.MEDIUM,
        F.concat(F.lit("Execution from a writable or temporary location: "), base),
        F.concat(path, F.lit(" is under "), F.col("notable_location"),
                 F.lit(", which any user can write to. Installers and builds run from there too.")),
        confidence=V.OBSERVED_DIRECTLY, classification=V.INFERRED, references=[event, artifact],
        triage=V.POTENTIALLY_HARMFUL, corroborated=hashed | several,
        action="Review the artifact, its digest and the records around it",
        unknowns=("how the file got there",), subject=path)
    matched = finding(
        rows.filter((F.col("collection_status") == V.COLLECTED) & hashed),
        "execution_artifact_matched", V.INFO,
        F.concat(F.lit("Execution evidence matched by a present artifact: "), base),
        F.concat(path, F.lit(" exists with "), F.col("hash_algorithm"), F.lit(" "), F.col("hash"),
                 F.lit(". The digest is of the bytes there now.")),
        confidence=confidence, classification=V.OBSERVED, references=[event, artifact],
        triage=V.NOT_HARMFUL, subject=path)
    return union_sources(missing, unusual, matched)


def _artifact_reference(artifacts):
    return (F.coalesce(F.col("reference"), F.col("path")) if "reference" in artifacts.columns
            else F.col("path"))


def indicator_findings(artifacts: DataFrame) -> DataFrame:
    """One finding per filename indicator of each artifact."""
    ready = artifacts if "indicators" in artifacts.columns else artifacts.withColumn(
        "indicators", X.filename_indicators("filename"))
    rows = ready.withColumn("i", F.explode("indicators"))
    warning = F.col("i.level") == "warning"
    return finding(
        rows, "suspicious_filename", F.when(warning, V.MEDIUM).otherwise(V.INFO),
        F.concat(F.col("i.label"), F.lit(": "), F.col("filename")),
        F.concat(F.col("i.detail"), F.lit(" in "), F.col("path"),
                 F.lit(". This describes the name only.")),
        confidence=V.OBSERVED_DIRECTLY, classification=V.INFERRED,
        triage=F.when(warning, V.POTENTIALLY_HARMFUL).otherwise(V.NEEDS_REVIEW),
        references=[cite("artifact", _artifact_reference(artifacts), path=F.col("path"),
                         hash=F.col("hash"))], subject=F.col("path"))


def integrity_findings(artifacts: DataFrame) -> DataFrame:
    """Changed digests, and structural checks that did not pass.

    Reads ``history_status`` (from the ledger) and ``integrity_status``.
    """
    reference = cite("artifact", _artifact_reference(artifacts), path=F.col("path"),
                     hash=F.col("hash"))
    changed = finding(
        artifacts.filter(F.col("history_status") == "altered"),
        "artifact_hash_changed", V.HIGH,
        F.concat(F.lit("Artifact changed since it was last hashed: "), F.col("filename")),
        F.concat(F.col("path"), F.lit(" has another digest than before. Updates do this too.")),
        confidence=V.OBSERVED_DIRECTLY, classification=V.OBSERVED, references=[reference],
        corroborated=True, action="Compare with the expected version of this software",
        unknowns=("what changed the file",), subject=F.col("path"))
    serious = F.col("integrity_status") == "critical"
    broken = finding(
        artifacts.filter(F.col("integrity_status").isin("warning", "critical")),
        "integrity_anomaly", F.when(serious, V.HIGH).otherwise(V.MEDIUM),
        F.concat(F.lit("Structural check reported "), F.col("integrity_status"), F.lit(": "),
                 F.col("filename")),
        F.concat(F.col("path"), F.lit(" does not match the layout its suffix implies.")),
        confidence=V.OBSERVED_DIRECTLY, classification=V.OBSERVED, references=[reference],
        subject=F.col("path"))
    return union_sources(changed, broken)


def telemetry_limitations(sources: DataFrame) -> DataFrame:
    """One per source that was not readable, and one where none was."""
    denied = F.col("status") == V.PERMISSION_DENIED
    unread = finding(
        sources.filter(F.col("status") != V.AVAILABLE), "telemetry_unavailable",
        F.when(denied, V.MEDIUM).otherwise(V.LOW),
        F.concat(F.lit("Source unavailable: "), F.col("name"), F.lit(" ("), F.col("status"),
                 F.lit(")")),
        F.concat(F.col("detail"), F.lit(". What only it would have recorded is not here.")),
        confidence=V.OBSERVED_DIRECTLY, classification=V.UNAVAILABLE,
        references=[cite("telemetry_source", F.col("name"), detail=F.col("status"))],
        subject=F.col("name"))
    none = sources.groupBy("investigation_id").agg(
        F.count_if(F.col("status") == V.AVAILABLE).alias("n"),
        F.sort_array(F.collect_set(F.struct("name", "status"))).alias("all")).filter("n = 0")
    blind = finding(
        none, "no_historical_telemetry", V.HIGH, "No historical execution telemetry was available",
        "No source could be read, so what ran before collection cannot be established.",
        confidence=V.OBSERVED_DIRECTLY, classification=V.UNAVAILABLE,
        references=F.transform("all", lambda s: cite("telemetry_source", s["name"],
                                                     detail=s["status"])))
    return union_sources(unread, blind)


def completeness_limitations(flags: DataFrame, events: DataFrame, artifacts: DataFrame) -> DataFrame:
    """What bounds and gaps a collection had.

    ``flags(investigation_id, execution_truncated, artifacts_truncated, processes_truncated)``.
    """
    undated = events.filter(F.col("ts").isNull()).groupBy("investigation_id").agg(
        F.count("*").alias("undated"))
    denied = artifacts.filter(F.col("collection_status") == V.PERMISSION_DENIED).groupBy(
        "investigation_id").agg(F.count("*").alias("denied"))
    facts = flags.join(undated, "investigation_id", "left").join(
        denied, "investigation_id", "left")
    count = lambda c: F.col(c).cast("string")                        # noqa: E731

    def item(when, category, severity, title, about):
        return F.when(when, F.struct(F.lit(category).alias("category"),
                                     F.lit(severity).alias("severity"), title.alias("title"),
                                     F.lit(about).alias("about")))
    rows = facts.withColumn("i", F.explode(F.array_compact(F.array(
        item(F.col("execution_truncated"), "collection_truncated", V.MEDIUM,
             F.lit("Historical execution collection was truncated"), "execution_history"),
        item(F.col("undated") > 0, "undated_evidence", V.LOW,
             F.concat(count("undated"), F.lit(" execution records carry no timestamp")),
             "execution_history"),
        item(F.col("artifacts_truncated"), "collection_truncated", V.MEDIUM,
             F.lit("Artifact collection was truncated"), "artifact_collection"),
        item(F.col("denied") > 0, "permission_gap", V.MEDIUM,
             F.concat(count("denied"), F.lit(" artifacts could not be read")),
             "artifact_collection"),
        item(F.col("processes_truncated"), "collection_truncated", V.LOW,
             F.lit("Current process snapshot was truncated"), "process_snapshot")))))
    return finding(
        rows, F.col("i.category"), F.col("i.severity"), F.col("i.title"), F.col("i.title"),
        confidence=V.OBSERVED_DIRECTLY, classification=V.UNAVAILABLE,
        references=[cite("collection", F.col("i.about"))], subject=F.col("i.about"))


def correlate(events: DataFrame, artifacts: DataFrame, sources: DataFrame | None = None, *,
              flags: DataFrame | None = None):
    """``(findings, limitations, links)``. Limitations are kept apart from findings."""
    if "history_status" not in artifacts.columns:
        artifacts = artifacts.withColumn("history_status", F.lit(None).cast("string"))
    if "integrity_status" not in artifacts.columns:
        artifacts = artifacts.withColumn("integrity_status", F.lit(None).cast("string"))
    found = all_findings(union_sources(
        artifact_findings(events, artifacts), indicator_findings(artifacts),
        integrity_findings(artifacts)))
    gaps = [] if sources is None else [telemetry_limitations(sources)]
    gaps += [] if flags is None else [completeness_limitations(flags, events, artifacts)]
    limits = union_sources(*gaps) if gaps else found.limit(0).drop("reference")
    return found, limits, link_events_artifacts(events, artifacts)


def link_statistics(links: DataFrame) -> DataFrame:
    return links.groupBy("investigation_id").agg(
        F.count_if("artifact_present").alias("with_artifact"),
        F.count_if(~F.col("artifact_present")).alias("without_artifact"))


# --- drivers and memory ----------------------------------------------------------
def verify_drivers(drivers: DataFrame, reference: DataFrame | None) -> DataFrame:
    """Each driver against a known-abused list, by digest, else by Windows file name.

    ``reference(id, category, name, sha256)`` holds one row per name or digest.
    """
    null = F.lit(None).cast("string")
    if reference is None:
        return drivers.select("*", F.lit(V.UNKNOWN).alias("risk_status"),
                              null.alias("matched_on"), F.lit("none").alias("risk_confidence"),
                              null.alias("reference_id"))
    ready = drivers.withColumn("_digest", F.nullif(F.lower(F.coalesce("sha256", F.lit(""))),
                                                   F.lit("")))
    ready = ready.withColumn("_name", F.lower(F.coalesce("name", F.lit(""))))
    windows = F.endswith(F.col("_name"), F.lit(".sys")) | F.endswith(
        F.col("_name"), F.lit(".exe")) | (F.coalesce("kind", F.lit("")) == "windows_driver")
    ready = ready.withColumn("_windows", F.when(windows, F.nullif("_name", F.lit(""))))
    by_hash = reference.filter("sha256 IS NOT NULL").groupBy(
        F.lower("sha256").alias("_digest")).agg(F.max("id").alias("_by_hash"))
    by_name = reference.filter("name IS NOT NULL").groupBy(
        F.lower("name").alias("_windows")).agg(F.min("id").alias("_by_name"))
    joined = ready.join(by_hash, "_digest", "left").join(by_name, "_windows", "left")
    hit, named = F.col("_by_hash").isNotNull(), F.col("_by_name").isNotNull()
    return joined.select(
        *drivers.columns,
        F.when(hit | named, V.MATCHED).when(F.col("_digest").isNull(), V.UNKNOWN).otherwise(
            V.NOT_MATCHED).alias("risk_status"),
        F.when(hit, "sha256").when(named, "filename").alias("matched_on"),
        F.when(hit, "high").when(named, "low").when(F.col("_digest").isNull(), "none").otherwise(
            "medium").alias("risk_confidence"),
        F.coalesce("_by_hash", "_by_name").alias("reference_id"))


def driver_findings(verified: DataFrame, *, reference_available=True) -> DataFrame:
    if not reference_available:
        rows = verified.select("investigation_id").distinct()
        return finding(
            rows, "driver_reference_unavailable", V.INFO,
            "Loaded drivers were not compared with the known-abused list",
            "The list could not be read, so an absence of driver findings means nothing here.",
            confidence=V.QUALIFIED, classification=V.UNAVAILABLE,
            references=[cite("detection_rule", "DRV-003")],
            action="Restore the list and run the comparison again")
    rows = verified.filter(F.col("risk_status") == V.MATCHED)
    exact = F.col("risk_confidence") == "high"
    name = F.coalesce("name", "path", F.lit("unnamed driver"))
    return finding(
        rows, "known_abused_driver_present", F.when(exact, V.HIGH).otherwise(V.MEDIUM),
        F.concat(F.lit("A driver on the known-abused list is loaded: "), name),
        F.concat(name, F.when(exact, F.lit(" matches by SHA-256. "))
                 .otherwise(F.lit(" matches by file name only. ")),
                 F.lit("Presence is established, abuse is not.")),
        confidence=F.when(exact, V.OBSERVED_DIRECTLY).otherwise(V.SINGLE_SOURCE),
        classification=V.CURRENT_OBSERVATION,
        triage=F.when(exact, V.POTENTIALLY_HARMFUL).otherwise(V.NEEDS_REVIEW),
        corroborated=exact, action="Check its signature, when it was loaded and by what",
        unknowns=("whether it was loaded for its intended purpose",),
        references=[cite("detection_rule", F.when(exact, "DRV-001").otherwise("DRV-002")),
                    cite("driver", name, path=F.col("path"), hash=F.col("sha256"))],
        subject=F.concat_ws("|", name, "sha256"))


def memory_orphans(processes: DataFrame) -> DataFrame:
    """Processes whose parent is not in the same image."""
    present = processes.select("image", F.col("pid").alias("parent_pid")).filter(
        "parent_pid IS NOT NULL").distinct()
    expected = list(V.EXPECTED_ORPHANS)
    candidates = processes.filter(
        F.col("parent_pid").isNotNull() & (F.col("parent_pid") != 0)
        & ~F.lower(F.coalesce("process_name", F.lit(""))).isin(expected))
    return candidates.join(present, ["image", "parent_pid"], "left_anti")


def memory_findings(processes: DataFrame, images: DataFrame) -> DataFrame:
    """Orphans, plus a note for images that came from a fixture or gave nothing.

    ``images(investigation_id, image, provenance)``.
    """
    absent = finding(
        images.filter(F.col("provenance") == V.UNAVAILABLE), "memory_not_analysed", V.INFO,
        "No memory image was analysed", "Nothing here rests on memory.",
        confidence=V.QUALIFIED, classification=V.UNAVAILABLE,
        references=[cite("detection_rule", "MEM-002")], subject=F.col("image"))
    fixture = finding(
        images.filter(F.col("provenance") == "FIXTURE"), "memory_findings_from_fixture", V.INFO,
        "Memory findings come from a fixture", "They show the analysis path, not a host.",
        confidence=V.OBSERVED_DIRECTLY, classification=V.INFERRED, triage=V.NOT_HARMFUL,
        references=[cite("detection_rule", "MEM-003")], subject=F.col("image"))
    usable = images.filter(F.col("provenance") != V.UNAVAILABLE).select(
        "investigation_id", "image", "provenance")
    rows = memory_orphans(processes).drop("investigation_id", "provenance").join(usable, "image")
    pid = F.col("pid").cast("string")
    orphan = finding(
        rows, "memory_orphan_process", V.LOW,
        F.concat(F.lit("A process has no parent in the image: "), F.col("process_name")),
        F.concat(F.col("process_name"), F.lit(" (pid "), pid, F.lit(") names parent "),
                 F.col("parent_pid").cast("string"), F.lit(", which is not in the image.")),
        confidence=V.SINGLE_SOURCE,
        classification=F.when(F.col("provenance") == "FIXTURE", V.INFERRED).otherwise(
            V.HISTORICAL_EVIDENCE),
        action="Compare with execution evidence from the same period",
        unknowns=("why the parent is absent",),
        references=[cite("detection_rule", "MEM-001"),
                    cite("memory_process", F.concat(F.lit("pid-"), pid), path=F.col("image"))],
        subject=F.concat(F.col("image"), F.lit("|"), F.lpad(pid, 12, "0")))
    return union_sources(absent, fixture, orphan)


def top_processes(processes: DataFrame, *, n=60) -> DataFrame:
    """Per host, the processes with the most memory; unknown last."""
    return first_rows(processes, ["endpoint_id"],
                      [F.col("memory_percent").desc_nulls_last(), F.col("pid")], n, "rank")


def first_platform_with_rows(rows: DataFrame) -> DataFrame:
    """Per image, the rows of the first platform (fixed order) whose listing is not empty."""
    order = F.lit(len(V.PLATFORM_ORDER))
    for rank, name in reversed(list(enumerate(V.PLATFORM_ORDER))):
        order = F.when(F.col("platform") == name, F.lit(rank)).otherwise(order)
    chosen = rows.groupBy("image").agg(F.min(order).alias("_best"))
    return rows.withColumn("_best", order).join(chosen, ["image", "_best"]).drop("_best")

