"""Links between kinds of source on one host: downloads, removable media, copies.

A link is an ordering or a match of two observations and nothing more.
"""

from pyspark.sql import Column, DataFrame, functions as F

from .. import functions as X
from .. import vocab as V
from .findings import cite, finding
from .ordering import first_per_key

SCOPE = ["investigation_id", "endpoint_id"]


def _paths(events: DataFrame) -> Column:
    line = F.col("command_line") if "command_line" in events.columns else F.lit(None).cast("string")
    return X.paths_named_by_event(F.col("executable"), F.col("full_command_line"), line)


def paths_in_events(events: DataFrame) -> DataFrame:
    """Per (host, path): how often events name it and the first event that does.

    Paths are counted on the map side, so a path a third of all events name is
    one row per task before it is joined to anything.
    """
    reference = (F.coalesce(F.col("reference"), F.col("event_id"))
                 if "reference" in events.columns else F.col("event_id"))
    order = F.struct(F.col("ts").isNull().alias("a"), F.col("ts").alias("b"),
                     F.col("source_record_id").alias("c"), F.col("event_id").alias("d"))
    named = events.select(
        *SCOPE, order.alias("o"), F.struct(
            reference.alias("event"), "source", "execution_confirmed", "ts").alias("first"),
        F.explode(_paths(events)).alias("path"))
    return named.groupBy(*SCOPE, "path").agg(
        F.count("*").alias("mentions"), F.min_by("first", "o").alias("first"))


def named_paths(records: DataFrame) -> DataFrame:
    """``(group_id, case, host, path)``: which activities name which paths, each once."""
    return records.select("group_id", *SCOPE, F.explode(_paths(records)).alias("path")).distinct()


def link_downloads(downloads: DataFrame, artifacts: DataFrame, events: DataFrame, *,
                   max_hours: float = V.DOWNLOAD_TO_EXECUTION_HOURS) -> DataFrame:
    """Downloads whose exact path is later an artifact or named by an event.

    A known gap above ``max_hours`` drops the link; negative and unknown gaps stay.
    """
    known = first_per_key(
        artifacts.select(*SCOPE, F.col("path").alias("target_path"), "hash",
                         F.col("reference" if "reference" in artifacts.columns else "path")
                         .alias("artifact"), "collection_order", "collection_status"),
        [*SCOPE, "target_path"], [F.col("collection_order")]).select(
            *SCOPE, "target_path", "artifact", F.col("hash").alias("artifact_hash"))
    wanted = downloads.filter(F.coalesce("target_path", F.lit("")) != "")
    named = paths_in_events(events).withColumnRenamed("path", "target_path")
    joined = wanted.join(known, [*SCOPE, "target_path"], "left").join(
        named, [*SCOPE, "target_path"], "left")
    gap = X.gap_hours("downloaded_at", "first.ts")
    return joined.filter(
        (F.col("artifact").isNotNull() | F.col("first").isNotNull())
        & ~F.coalesce(gap > max_hours, F.lit(False))).select(
            *downloads.columns, "artifact", "artifact_hash",
            F.col("first.event").alias("event"), F.col("first.source").alias("event_source"),
            F.coalesce("first.execution_confirmed", F.lit(False)).alias("execution_confirmed"),
            gap.alias("gap_hours"))


def download_findings(links: DataFrame) -> DataFrame:
    ran, there = F.col("event").isNotNull(), F.col("artifact").isNotNull()
    confirmed = ran & F.col("execution_confirmed")
    base = X.path_basename("target_path")
    gap = F.col("gap_hours")
    when = (F.when(gap.isNull(), "after")
            .when(gap >= 1, F.concat(F.lit("about "), F.format_number(gap, 1), F.lit(" hours after")))
            .otherwise(F.concat(F.lit("about "), (gap * 60).cast("bigint").cast("string"),
                                F.lit(" minutes after"))))
    return finding(
        links, F.when(ran, "download_executed").otherwise("download_present"),
        F.when(confirmed, V.MEDIUM).otherwise(V.LOW),
        F.concat(F.when(ran, F.lit("A downloaded file was run: "))
                 .otherwise(F.lit("A downloaded file is present: ")), base),
        F.when(ran, F.concat(F.col("target_path"), F.lit(" was downloaded from "),
                             F.coalesce("url", F.lit("an unrecorded URL")),
                             F.lit(" and named by execution evidence "), when, F.lit(" it.")))
        .otherwise(F.concat(F.col("target_path"), F.lit(" was downloaded and is present."))),
        confidence=F.when(ran & there, V.OBSERVED_DIRECTLY).otherwise(V.SINGLE_SOURCE),
        classification=V.HISTORICAL_EVIDENCE,
        triage=F.when(confirmed, V.POTENTIALLY_HARMFUL).otherwise(V.NEEDS_REVIEW),
        corroborated=ran & there, action="Check the download source and compare the digest",
        unknowns=("what the file does", "whether one person did both"),
        references=[
            cite("browser_download", F.coalesce("url", "target_path"), path=F.col("target_path")),
            F.when(there, cite("artifact", F.col("artifact"), path=F.col("target_path"),
                               hash=F.col("artifact_hash"))),
            F.when(ran, cite("execution_event", F.col("event"), source=F.col("event_source")))],
        subject=F.concat_ws("|", "target_path", "url"))


def _scope(mounts: DataFrame) -> list[str]:
    """Case and host, or the host alone where mounts were listed outside any case."""
    return [c for c in SCOPE if c in mounts.columns]


def _under_mounts(paths: DataFrame, mounts: DataFrame) -> DataFrame:
    """Rows of ``paths`` per mount they lie under: explode ancestors, join on equality."""
    scope = _scope(mounts)
    points = mounts.select(*scope, F.col("mount_point").alias("_up")).distinct()
    spread = paths.withColumn("_up", F.explode(X.path_ancestors("path")))
    return spread.join(points, [*scope, "_up"]).withColumnRenamed("_up", "mount_point")


def media_touches(mounts: DataFrame, events: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Per mount: event mentions of, and artifacts at, paths under it."""
    scope = _scope(mounts)
    keys = [*scope, "mount_point"]
    touched = _under_mounts(paths_in_events(events).select(
        *scope, "path", "mentions", F.col("first.event").alias("event")), mounts)
    touched = touched.groupBy(*keys).agg(
        F.sum("mentions").alias("touched"), F.min("event").alias("event"))
    written = _under_mounts(artifacts.groupBy(*scope, "path").agg(
        F.count("*").alias("n")), mounts).groupBy(*keys).agg(
            F.count("*").alias("written"), F.min("path").alias("artifact"))
    return (mounts.join(touched, keys, "left").join(written, keys, "left")
            .withColumn("touched", F.coalesce("touched", F.lit(0)))
            .withColumn("written", F.coalesce("written", F.lit(0)))
            .filter("touched > 0 OR written > 0"))


def media_copies(mounts: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Per (mount, digest): files inside, files elsewhere on the host, one example of each.

    Counts are multiplied, never paired, so a digest that a third of all files
    share costs one row per directory it is labelled with.
    """
    scope = _scope(mounts)
    files = artifacts.filter(F.coalesce("hash", F.lit("")) != "").groupBy(
        *scope, "path").agg(F.min("hash").alias("hash"))
    placed = _under_mounts(files, mounts)
    inside = placed.groupBy(*scope, "mount_point", "hash").agg(
        F.count("*").alias("inside"), F.min("path").alias("target"))
    deepest = placed.groupBy(*scope, "path").agg(
        F.max_by("mount_point", F.length("mount_point")).alias("_label"))
    labelled = files.join(deepest, [*scope, "path"], "left").groupBy(
        *scope, "hash", F.coalesce("_label", F.lit("")).alias("_label")).agg(
            F.count("*").alias("n"), F.min("path").alias("least"))
    apart = (F.col("_label") != F.col("mount_point")) & ~F.startswith(
        F.col("_label"), F.concat("mount_point", F.lit("/")))
    return (inside.join(labelled, [*scope, "hash"]).filter(apart)
            .groupBy(*scope, "mount_point", "hash", "inside", "target")
            .agg(F.sum("n").alias("outside"), F.min("least").alias("source"))
            .withColumn("pairs", F.col("inside") * F.col("outside")))


def removable_media_findings(mounts: DataFrame, events: DataFrame, artifacts: DataFrame,
                             usb_events: DataFrame | None = None) -> DataFrame:
    """One finding per mount with activity; high and corroborated when copies exist."""
    copies = media_copies(mounts, artifacts).groupBy(*_scope(mounts), "mount_point").agg(
        F.sum("pairs").alias("pairs"), F.min(F.struct("target", "source")).alias("pair"))
    rows = media_touches(mounts, events, artifacts).join(
        copies, [*_scope(mounts), "mount_point"], "left")
    if usb_events is not None:
        first = usb_events.filter(F.col("action") == "connected").groupBy("endpoint_id").agg(
            F.min_by("serial", "ts").alias("serial"), F.min("ts").alias("attached_at"))
        rows = rows.join(first, "endpoint_id", "left")
    else:
        rows = rows.withColumn("serial", F.lit(None).cast("string")).withColumn(
            "attached_at", F.lit(None).cast("timestamp"))
    copied = F.coalesce(F.col("pairs") > 0, F.lit(False))
    count = lambda c: F.col(c).cast("string")                        # noqa: E731
    return finding(
        rows, "removable_media_activity", F.when(copied, V.HIGH).otherwise(V.MEDIUM),
        F.concat(F.lit("Activity involving removable media at "), F.col("mount_point")),
        F.concat(count("touched"), F.lit(" mentions and "), count("written"),
                 F.lit(" files under "), F.col("mount_point"),
                 F.when(copied, F.concat(F.lit("; same digest at "), F.col("pair.source"),
                                         F.lit(" and "), F.col("pair.target"))).otherwise("")),
        confidence=F.when(copied, V.OBSERVED_DIRECTLY).otherwise(V.SINGLE_SOURCE),
        classification=V.HISTORICAL_EVIDENCE,
        triage=F.when(copied, V.POTENTIALLY_HARMFUL).otherwise(V.NEEDS_REVIEW),
        corroborated=copied, action="Find out what the files hold and who may take them",
        unknowns=("what was on the device before", "where the device went"),
        references=[
            cite("removable_device", F.coalesce("device", "mount_point"), path=F.col("mount_point"),
                 detail=F.col("serial")),
            F.when(F.col("event").isNotNull(), cite("execution_event", F.col("event"))),
            F.when(F.col("artifact").isNotNull(), cite("artifact", F.col("artifact"),
                                                       path=F.col("artifact")))],
        subject=F.col("mount_point"))
