"""Correlation, findings, cross-source links, fleet, ledger."""

from ... import vocab as V
from ...operators import correlate as C
from ...operators import cross_source as S
from ...operators import findings as R
from ...operators import fleet as FL
from ...operators import ledger as L
from ..oracle import UNIQUE_ARTIFACTS, npath, view_sql
from ..registry import query
from .common import F, evidence, events, table
from .identity import _STATUS, sources

_ABS = r"(starts_with(executable, '/') OR regexp_matches(executable, '^[A-Za-z]:[\\/]'))"
_EA = ["exec_events", "artifacts"]
# One row per named image: its first event, source count, and the artifact there.
NAMED = ("named", f"""
SELECT i.*, a.collection_status, a.hash, a.path AS artifact_path FROM (
  SELECT investigation_id, endpoint_id, executable, count(DISTINCT source) AS source_count,
    max(CASE WHEN rn = 1 THEN event_id END) AS event, max(CASE WHEN rn = 1 THEN source END) AS source
  FROM (SELECT *, row_number() OVER (PARTITION BY investigation_id, endpoint_id, executable
    ORDER BY ts ASC NULLS LAST, source_record_id, event_id) AS rn FROM exec_events WHERE {_ABS})
  GROUP BY ALL) i JOIN uniq_art a ON a.investigation_id = i.investigation_id AND a.endpoint_id = i.endpoint_id AND a.npath = {npath('i.executable')}""")
_FWD = f"lower({npath('executable')})"
_NOTABLE = " OR ".join(f"contains({_FWD}, '{p}')" for p in (
    "/tmp/", "/var/tmp/", "/dev/shm/", "/run/shm/", "/temp/", "/appdata/local/temp/",
    "/downloads/", "/users/public/", "/programdata/", "/$recycle.bin/"))
FINDINGS = ("art_findings", f"""
SELECT *, CASE WHEN triage LIKE 'NOT_HARMFUL%' THEN 'PRIORITY_3'
   WHEN triage = 'POTENTIALLY_HARMFUL' THEN CASE WHEN corroborated THEN 'PRIORITY_1' ELSE 'PRIORITY_2' END
   WHEN corroborated THEN 'PRIORITY_2' ELSE 'PRIORITY_3' END AS priority FROM (
SELECT investigation_id, endpoint_id, 'execution_artifact_missing' AS category, 'medium' AS severity,
  executable AS subject, event, 'NEEDS_REVIEW' AS triage, source_count > 1 AS corroborated FROM named WHERE collection_status = 'MISSING'
UNION ALL SELECT investigation_id, endpoint_id, 'unusual_execution_location', 'medium', executable, event, 'POTENTIALLY_HARMFUL',
  coalesce(hash <> '', false) OR source_count > 1 FROM named WHERE {_NOTABLE}
UNION ALL SELECT investigation_id, endpoint_id, 'execution_artifact_matched', 'info', executable, event,
  'NOT_HARMFUL_ON_AVAILABLE_EVIDENCE', false FROM named WHERE collection_status = 'COLLECTED' AND hash <> '')""")
_BASE = "regexp_extract(path, '[^/]*$', 0)"
_EXT = ", ".join(f"'{e}'" for e in V.NOTABLE_EXTENSIONS)
_SPOOF = ", ".join(f"'{e}'" for e in V.SPOOFED_EXTENSIONS)
INDICATORS = ("ind_findings", f"""
SELECT investigation_id, endpoint_id, 'suspicious_filename' AS category, path AS subject, level,
  CASE WHEN level = 'warning' THEN 'medium' ELSE 'info' END AS severity,
  CASE WHEN level = 'warning' THEN 'POTENTIALLY_HARMFUL' ELSE 'NEEDS_REVIEW' END AS triage,
  CASE WHEN level = 'warning' THEN 'PRIORITY_2' ELSE 'PRIORITY_3' END AS priority FROM (
  SELECT *, unnest(list_filter([CASE WHEN len(parts) >= 2 AND '.' || parts[-1] IN ({_EXT}) THEN 'info' END,
    CASE WHEN len(parts) >= 3 AND '.' || parts[-1] IN ({_EXT}) AND '.' || parts[-2] IN ({_SPOOF}) THEN 'warning' END],
    lambda x: x IS NOT NULL)) AS level FROM (SELECT *, string_split(lower({_BASE}), '.') AS parts FROM artifacts))""")


@query("link_events_artifacts", view_sql(_EA, f"""
SELECT e.event_id AS execution_event_id, coalesce(a.collection_status = 'COLLECTED', false) AS artifact_present, a.hash AS artifact_hash
FROM exec_events e LEFT JOIN uniq_art a ON a.investigation_id = e.investigation_id AND a.endpoint_id = e.endpoint_id AND a.npath = {npath('e.executable')}
WHERE {_ABS}""", extra=(UNIQUE_ARTIFACTS,)))
def _(spark, sf):
    return C.link_events_artifacts(events(spark, sf), evidence(spark, sf, "artifacts")).select(
        "execution_event_id", "artifact_present", "artifact_hash")


@query("link_statistics", view_sql(_EA, f"""
SELECT e.investigation_id, count(*) FILTER (a.collection_status = 'COLLECTED') AS with_artifact,
  count(*) FILTER (a.collection_status IS DISTINCT FROM 'COLLECTED') AS without_artifact
FROM exec_events e LEFT JOIN uniq_art a ON a.investigation_id = e.investigation_id AND a.endpoint_id = e.endpoint_id AND a.npath = {npath('e.executable')}
WHERE {_ABS} GROUP BY ALL""", extra=(UNIQUE_ARTIFACTS,)))
def _(spark, sf):
    return C.link_statistics(C.link_events_artifacts(
        events(spark, sf), evidence(spark, sf, "artifacts")))


@query("referenced_paths", view_sql(["exec_events"], f"""
SELECT investigation_id, endpoint_id, executable AS path, min(ts) AS first_named, count(*) AS events FROM exec_events
WHERE {_ABS} GROUP BY ALL"""))
def _(spark, sf):
    return C.referenced_paths(events(spark, sf))


@query("missing_artifacts", view_sql(_EA, """
SELECT investigation_id, endpoint_id, executable AS path, source, event, source_count > 1 AS corroborated FROM named
WHERE collection_status = 'MISSING'""", extra=(UNIQUE_ARTIFACTS, NAMED)))
def _(spark, sf):
    return C.missing_artifacts(events(spark, sf), evidence(spark, sf, "artifacts"))


@query("artifact_findings", view_sql(_EA, """
SELECT endpoint_id, category, severity, subject, event, triage, corroborated, priority FROM art_findings""",
       extra=(UNIQUE_ARTIFACTS, NAMED, FINDINGS)))
def _(spark, sf):
    return C.artifact_findings(events(spark, sf), evidence(spark, sf, "artifacts")).select(
        "endpoint_id", "category", "severity", "subject",
        F.element_at("evidence_references", 1)["id"].alias("event"), "triage", "corroborated",
        "priority")


@query("indicator_findings", view_sql(_EA, """
SELECT endpoint_id, subject, severity, triage, priority, count(*) AS n FROM ind_findings GROUP BY ALL""",
       extra=(INDICATORS,)))
def _(spark, sf):
    return C.indicator_findings(evidence(spark, sf, "artifacts")).groupBy(
        "endpoint_id", "subject", "severity", "triage", "priority").agg(F.count("*").alias("n"))


def checked_artifacts(spark, sf):
    """Artifacts with a ledger comparison and a structural check derived from their fields."""
    rows = evidence(spark, sf, "artifacts")
    return rows.withColumn("history_status", F.when(F.col("hash").isNull(), F.lit(None)).when(
        F.substring("hash", 1, 1) == "a", "altered").otherwise("unchanged")).withColumn(
        "integrity_status", F.when(F.col("size_bytes") < 100, "warning").when(
            F.endswith("path", F.lit(".pdf")) & (F.substring("hash", 1, 1) == "0"), "critical"))


@query("integrity_findings", view_sql(["artifacts"], """
SELECT endpoint_id, 'artifact_hash_changed' AS category, 'high' AS severity, path AS subject, 'PRIORITY_2' AS priority
FROM artifacts WHERE hash LIKE 'a%'
UNION ALL SELECT endpoint_id, 'integrity_anomaly', CASE WHEN size_bytes < 100 THEN 'medium' ELSE 'high' END, path, 'PRIORITY_3'
FROM artifacts WHERE size_bytes < 100 OR (path LIKE '%.pdf' AND hash LIKE '0%')"""))
def _(spark, sf):
    return C.integrity_findings(checked_artifacts(spark, sf)).select(
        "endpoint_id", "category", "severity", "subject", "priority")


@query("telemetry_limitations", view_sql(["exec_events"], f"""
SELECT investigation_id, 'telemetry_unavailable' AS category, 'low' AS severity, name AS subject FROM ({_STATUS}) WHERE status <> 'AVAILABLE'"""))
def _(spark, sf):
    return C.telemetry_limitations(sources(events(spark, sf))).select(
        "investigation_id", "category", "severity", "subject")


@query("completeness_limitations", view_sql(_EA, """
SELECT investigation_id, 'undated_evidence' AS category, CAST(count(*) AS VARCHAR) || ' execution records carry no timestamp' AS title
FROM exec_events WHERE ts IS NULL GROUP BY ALL
UNION ALL SELECT investigation_id, 'permission_gap', CAST(count(*) AS VARCHAR) || ' artifacts could not be read' FROM artifacts
WHERE collection_status = 'PERMISSION_DENIED' GROUP BY ALL
UNION ALL SELECT DISTINCT investigation_id, 'collection_truncated', 'Artifact collection was truncated' FROM artifacts"""))
def _(spark, sf):
    arts = evidence(spark, sf, "artifacts")
    flags = arts.select("investigation_id").distinct().select(
        "investigation_id", F.lit(False).alias("execution_truncated"),
        F.lit(True).alias("artifacts_truncated"), F.lit(False).alias("processes_truncated"))
    return C.completeness_limitations(flags, events(spark, sf), arts).select(
        "investigation_id", "category", "title")


_CORRELATED = (UNIQUE_ARTIFACTS, NAMED, FINDINGS, INDICATORS, ("found", """
SELECT investigation_id, endpoint_id, category, severity, triage, priority, subject FROM art_findings
UNION ALL SELECT investigation_id, endpoint_id, category, severity, triage, priority, subject FROM ind_findings"""))


@query("correlate", view_sql(_EA, """
SELECT investigation_id, priority, category, triage, count(*) AS n, min(rank) AS first_rank, max(rank) AS last_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY investigation_id ORDER BY priority,
    CASE triage WHEN 'POTENTIALLY_HARMFUL' THEN 0 WHEN 'NEEDS_REVIEW' THEN 1 ELSE 2 END, category, endpoint_id, subject) AS rank FROM found)
GROUP BY ALL""", extra=_CORRELATED))
def _(spark, sf):
    found, _, _ = C.correlate(events(spark, sf), evidence(spark, sf, "artifacts"))
    rank = F.regexp_extract("reference", "[0-9]+", 0).cast("bigint")
    return found.groupBy("investigation_id", "priority", "category", "triage").agg(
        F.count("*").alias("n"), F.min(rank).alias("first_rank"), F.max(rank).alias("last_rank"))


@query("finding_statistics", view_sql(_EA, """
SELECT investigation_id, facet, value, count(*) AS findings FROM (
  SELECT investigation_id, 'severity' AS facet, severity AS value FROM found UNION ALL
  SELECT investigation_id, 'category', category FROM found UNION ALL
  SELECT investigation_id, 'triage', triage FROM found UNION ALL
  SELECT investigation_id, 'priority', priority FROM found) GROUP BY ALL""", extra=_CORRELATED))
def _(spark, sf):
    arts = evidence(spark, sf, "artifacts")
    return R.finding_statistics(C.union_sources(
        C.artifact_findings(events(spark, sf), arts), C.indicator_findings(arts)))


@query("findings_with_citations", view_sql(_EA, """
SELECT endpoint_id, category, subject, 2 AS citations FROM art_findings
UNION ALL SELECT endpoint_id, category, subject, 1 FROM ind_findings""", extra=_CORRELATED))
def _(spark, sf):
    found, _, _ = C.correlate(events(spark, sf), evidence(spark, sf, "artifacts"))
    return R.findings_with_citations(found, R.finding_evidence(found)).select(
        "endpoint_id", "category", "subject", F.col("citations").cast("int").alias("citations"))


@query("merge_artifacts", view_sql(["artifacts"], """
SELECT investigation_id, endpoint_id, path, src_table, hash FROM (SELECT *, row_number() OVER (PARTITION BY investigation_id, endpoint_id, path ORDER BY src_table, collection_order) AS rn FROM (
  SELECT *, 'selected' AS src_table FROM artifacts WHERE path LIKE '/home/%' UNION ALL SELECT *, 'z' FROM artifacts)) WHERE rn = 1"""))
def _(spark, sf):
    rows = evidence(spark, sf, "artifacts")
    chosen = rows.filter(F.startswith("path", F.lit("/home/"))).withColumn(
        "src_table", F.lit("selected"))
    return C.merge_artifacts(chosen, rows.withColumn("src_table", F.lit("z"))).select(
        "investigation_id", "endpoint_id", "path", "src_table", "hash")


@query("observe_artifacts", view_sql(_EA, f"""
, inv AS (SELECT endpoint_id, {npath('path')} AS path, max(size_bytes) AS size_bytes,
    max(CASE WHEN collection_status <> 'PERMISSION_DENIED' THEN 1 ELSE 0 END) AS readable
    FROM artifacts WHERE collection_status <> 'MISSING' GROUP BY ALL),
wanted AS (SELECT investigation_id, endpoint_id, path, min(f) AS f FROM (
    SELECT DISTINCT investigation_id, endpoint_id, {npath('executable')} AS path, 2 AS f FROM exec_events WHERE {_ABS}
    UNION ALL SELECT DISTINCT investigation_id, endpoint_id, {npath('path')}, 1 FROM artifacts WHERE path LIKE '/srv/%') GROUP BY ALL)
SELECT w.investigation_id, w.endpoint_id, w.path, CASE f WHEN 1 THEN 'selected path' ELSE 'named by execution evidence' END AS source,
  CASE WHEN i.path IS NULL THEN 'MISSING' WHEN readable = 0 THEN 'PERMISSION_DENIED' ELSE 'COLLECTED' END AS collection_status,
  CASE WHEN readable = 1 THEN h.hash END AS hash
FROM wanted w LEFT JOIN inv i USING (endpoint_id, path) LEFT JOIN (
  SELECT endpoint_id, {npath('path')} AS path, max(hash) AS hash FROM artifacts WHERE hash IS NOT NULL GROUP BY ALL) h USING (endpoint_id, path)"""))
def _(spark, sf):
    arts = evidence(spark, sf, "artifacts")
    inventory = arts.filter("collection_status <> 'MISSING'").select(
        "endpoint_id", "path", F.lit("file").alias("type"), "size_bytes",
        F.lit(None).cast("timestamp").alias("modified"),
        (F.col("collection_status") != "PERMISSION_DENIED").alias("readable"))
    digests = arts.filter("hash IS NOT NULL").select(
        "endpoint_id", "path", F.col("hash_algorithm").alias("algorithm"), "hash")
    chosen = arts.filter(F.startswith("path", F.lit("/srv/"))).select(
        "investigation_id", "endpoint_id", "path")
    return C.observe_artifacts(events(spark, sf), chosen, inventory, digests).select(
        "investigation_id", "endpoint_id", "path", "source", "collection_status", "hash")


@query("artifact_status_counts", view_sql(["artifacts"], """
SELECT investigation_id, collection_status, count(*) AS n,
  count(*) FILTER (source = 'src3') AS selected, count(*) FILTER (source <> 'src3') AS referenced
FROM artifacts GROUP BY ALL"""))
def _(spark, sf):
    return C.artifact_status_counts(evidence(spark, sf, "artifacts"), selected="src3")


# --- drivers and memory ------------------------------------------------------------
def drivers(spark, sf):
    part = table(spark, sf, "part")
    return part.select(
        F.concat(F.lit("host-"), (F.col("p_partkey") % 16).cast("string")).alias("endpoint_id"),
        F.concat(F.lit("inv-"), (F.col("p_partkey") % 4).cast("string")).alias("investigation_id"),
        F.concat(F.translate("p_name", " ", "_"), F.when(F.col("p_size") > 20, ".sys").otherwise(
            "")).alias("name"), F.lit("kernel_module").alias("kind"),
        F.lit(None).cast("string").alias("path"),
        F.when(F.col("p_size") % 5 != 0, F.sha2("p_type", 256)).alias("sha256"))


def risk(spark, sf):
    part = table(spark, sf, "part")
    names = part.filter("p_brand = 'Brand#7'").select(
        F.concat(F.lit("n-"), "p_name").alias("id"), F.lit("abused").alias("category"),
        F.concat(F.translate("p_name", " ", "_"), F.lit(".sys")).alias("name"),
        F.lit(None).cast("string").alias("sha256")).distinct()
    digests = part.filter("p_type = 'PROMO'").select(
        F.concat(F.lit("d-"), "p_type").alias("id"), F.lit("abused").alias("category"),
        F.lit(None).cast("string").alias("name"), F.sha2("p_type", 256).alias("sha256")).distinct()
    return names.unionByName(digests)


_DRIVERS = ("""WITH d AS (SELECT 'host-' || CAST(p_partkey % 16 AS VARCHAR) AS endpoint_id, 'inv-' || CAST(p_partkey % 4 AS VARCHAR) AS investigation_id,
  replace(p_name, ' ', '_') || CASE WHEN p_size > 20 THEN '.sys' ELSE '' END AS name,
  CASE WHEN p_size % 5 <> 0 THEN sha256(p_type) END AS sha256 FROM part),
v AS (SELECT *, CASE WHEN sha256 IN (SELECT sha256(p_type) FROM part WHERE p_type = 'PROMO') THEN 'sha256'
   WHEN name LIKE '%.sys' AND name IN (SELECT replace(p_name, ' ', '_') || '.sys' FROM part WHERE p_brand = 'Brand#7') THEN 'filename' END AS matched_on FROM d)
""")


@query("verify_drivers", _DRIVERS + """
SELECT endpoint_id, name, sha256, matched_on, CASE WHEN matched_on IS NOT NULL THEN 'MATCHED' WHEN sha256 IS NULL THEN 'UNKNOWN' ELSE 'NOT_MATCHED' END AS risk_status,
  count(*) AS n FROM v GROUP BY ALL""")
def _(spark, sf):
    return C.verify_drivers(drivers(spark, sf), risk(spark, sf)).groupBy(
        "endpoint_id", "name", "sha256", "matched_on", "risk_status").agg(F.count("*").alias("n"))


@query("driver_findings", _DRIVERS + """
SELECT endpoint_id, CASE matched_on WHEN 'sha256' THEN 'high' ELSE 'medium' END AS severity,
  CASE matched_on WHEN 'sha256' THEN 'DRV-001' ELSE 'DRV-002' END AS rule,
  CASE matched_on WHEN 'sha256' THEN 'PRIORITY_2' ELSE 'PRIORITY_3' END AS priority, count(*) AS n
FROM v WHERE matched_on IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    return C.driver_findings(C.verify_drivers(drivers(spark, sf), risk(spark, sf))).groupBy(
        "endpoint_id", "severity", F.element_at("evidence_references", 1)["id"].alias("rule"),
        "priority").agg(F.count("*").alias("n"))


def memory(spark, sf):
    rows = evidence(spark, sf, "base")
    return rows.select(
        F.concat(F.lit("img-"), (F.col("u") % 16).cast("string")).alias("image"),
        F.when(F.col("event_id") % 2 == 0, "linux").otherwise("windows").alias("platform"),
        F.col("event_id").alias("pid"),
        F.when(F.col("k") < 5, F.lit(0)).when(F.col("k") < 8, F.lit(None)).otherwise(
            F.col("event_id") - F.col("u") % 16 * 0 - F.col("k") * 16).alias("parent_pid"),
        F.when(F.col("k") == 50, "systemd").otherwise(F.col("event_type")).alias("process_name"))


_MEMORY = """WITH m AS (SELECT 'img-' || CAST(user_id % 16 AS VARCHAR) AS image, event_id AS pid, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k,
  event_type FROM events),
p AS (SELECT image, pid, CASE WHEN k < 5 THEN 0 WHEN k < 8 THEN NULL ELSE pid - k * 16 END AS parent_pid,
  CASE WHEN k = 50 THEN 'systemd' ELSE event_type END AS process_name FROM m)
"""


@query("memory_orphans", _MEMORY + """
SELECT image, pid, parent_pid, process_name FROM p WHERE parent_pid IS NOT NULL AND parent_pid <> 0 AND process_name <> 'systemd'
  AND NOT EXISTS (SELECT 1 FROM p q WHERE q.image = p.image AND q.pid = p.parent_pid)""")
def _(spark, sf):
    return C.memory_orphans(memory(spark, sf)).select("image", "pid", "parent_pid", "process_name")


@query("memory_findings", _MEMORY + """
, o AS (SELECT image FROM p WHERE parent_pid IS NOT NULL AND parent_pid <> 0 AND process_name <> 'systemd'
  AND NOT EXISTS (SELECT 1 FROM p q WHERE q.image = p.image AND q.pid = p.parent_pid)),
i AS (SELECT DISTINCT image, CASE image WHEN 'img-3' THEN 'FIXTURE' WHEN 'img-5' THEN 'UNAVAILABLE' ELSE 'REAL' END AS provenance FROM m)
SELECT category, classification, count(*) AS n FROM (
  SELECT 'memory_orphan_process' AS category, CASE provenance WHEN 'FIXTURE' THEN 'INFERRED' ELSE 'HISTORICAL_EVIDENCE' END AS classification
  FROM o JOIN i USING (image) WHERE provenance <> 'UNAVAILABLE'
  UNION ALL SELECT 'memory_findings_from_fixture', 'INFERRED' FROM i WHERE provenance = 'FIXTURE'
  UNION ALL SELECT 'memory_not_analysed', 'UNAVAILABLE' FROM i WHERE provenance = 'UNAVAILABLE') GROUP BY ALL""")
def _(spark, sf):
    procs = memory(spark, sf)
    images = procs.select("image").distinct().select(
        F.lit("inv-0").alias("investigation_id"), "image", F.when(
            F.col("image") == "img-3", "FIXTURE").when(F.col("image") == "img-5", "UNAVAILABLE")
        .otherwise("REAL").alias("provenance"))
    return C.memory_findings(procs, images).groupBy("category", "classification").agg(
        F.count("*").alias("n"))


@query("first_platform_with_rows", _MEMORY + """
SELECT image, CASE WHEN has_linux THEN 'linux' ELSE 'windows' END AS platform,
  CASE WHEN has_linux THEN n_linux ELSE n_windows END AS n FROM (
  SELECT image, bool_or(pid % 2 = 0) AS has_linux, count(*) FILTER (pid % 2 = 0) AS n_linux, count(*) FILTER (pid % 2 <> 0) AS n_windows
  FROM p GROUP BY ALL)""")
def _(spark, sf):
    return C.first_platform_with_rows(memory(spark, sf)).groupBy("image", "platform").agg(
        F.count("*").alias("n"))


@query("top_processes", """
SELECT endpoint_id, pid, rank FROM (SELECT 'host-' || CAST(user_id % 16 AS VARCHAR) AS endpoint_id, event_id AS pid,
  row_number() OVER (PARTITION BY user_id % 16 ORDER BY CASE WHEN value > 1 THEN value END DESC NULLS LAST, event_id) AS rank FROM events)
WHERE rank <= 60""")
def _(spark, sf):
    rows = table(spark, sf, "events").select(
        F.concat(F.lit("host-"), (F.col("user_id") % 16).cast("string")).alias("endpoint_id"),
        F.col("event_id").alias("pid"), F.when(F.col("value") > 1, F.col("value")).alias(
            "memory_percent"))
    return C.top_processes(rows).select("endpoint_id", "pid", "rank")


# --- downloads and removable media ---------------------------------------------------
_TRI = ["exec_events", "artifacts", "downloads"]
_LINKS = (("mentions", """
SELECT * FROM (SELECT investigation_id, endpoint_id, path, event_id, source, execution_confirmed, ts, row_number() OVER (
  PARTITION BY investigation_id, endpoint_id, path ORDER BY ts ASC NULLS LAST, source_record_id, event_id) AS rn,
  count(*) OVER (PARTITION BY investigation_id, endpoint_id, path) AS mentions FROM (
  SELECT *, unnest(list_filter(string_split_regex(concat_ws(' ', executable, full_command_line), '\\s+'),
    lambda x: starts_with(x, '/') AND length(x) > 1)) AS path FROM exec_events)) WHERE rn = 1"""),
    ("raw_art", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY investigation_id, endpoint_id, path ORDER BY collection_order) AS rn FROM artifacts) WHERE rn = 1"""),
    ("dl", """
SELECT d.*, a.path AS artifact, m.event_id AS event, coalesce(m.execution_confirmed, false) AS execution_confirmed,
  (epoch_us(m.ts) - epoch_us(d.downloaded_at)) / 3600000000.0 AS gap
FROM downloads d LEFT JOIN raw_art a ON a.investigation_id = d.investigation_id AND a.endpoint_id = d.endpoint_id AND a.path = d.target_path
LEFT JOIN mentions m ON m.investigation_id = d.investigation_id AND m.endpoint_id = d.endpoint_id AND m.path = d.target_path
WHERE (a.path IS NOT NULL OR m.event_id IS NOT NULL) AND NOT coalesce((epoch_us(m.ts) - epoch_us(d.downloaded_at)) / 3600000000.0 > 24, false)"""))


@query("link_downloads", view_sql(_TRI, """
SELECT page_id, artifact, event, execution_confirmed, round(gap, 6) AS gap FROM dl""", extra=_LINKS))
def _(spark, sf):
    return S.link_downloads(*(evidence(spark, sf, n) for n in ("downloads", "artifacts")),
                            events(spark, sf)).select(
        "page_id", "artifact", "event", "execution_confirmed",
        F.round("gap_hours", 6).alias("gap"))


@query("download_findings", view_sql(_TRI, """
SELECT endpoint_id, CASE WHEN event IS NOT NULL THEN 'download_executed' ELSE 'download_present' END AS category,
  CASE WHEN event IS NOT NULL AND execution_confirmed THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN event IS NOT NULL AND execution_confirmed THEN CASE WHEN artifact IS NOT NULL THEN 'PRIORITY_1' ELSE 'PRIORITY_2' END
       WHEN event IS NOT NULL AND artifact IS NOT NULL THEN 'PRIORITY_2' ELSE 'PRIORITY_3' END AS priority, count(*) AS n
FROM dl GROUP BY ALL""", extra=_LINKS))
def _(spark, sf):
    links = S.link_downloads(*(evidence(spark, sf, n) for n in ("downloads", "artifacts")),
                             events(spark, sf))
    return S.download_findings(links).groupBy("endpoint_id", "category", "severity", "priority").agg(
        F.count("*").alias("n"))


def mounts(spark, sf):
    return evidence(spark, sf, "artifacts").select("investigation_id", "endpoint_id").distinct(
    ).withColumn("mount_point", F.explode(F.array(*[F.lit(p) for p in (
        "/media/usb0", "/media/usb1", "/media")]))).withColumn("device", F.lit("/dev/sdb1"))


_MOUNTS = ("mnt", """SELECT DISTINCT investigation_id, endpoint_id, unnest(['/media/usb0', '/media/usb1', '/media']) AS mount_point
FROM artifacts""")
_FILES = ("files", "SELECT investigation_id, endpoint_id, path, min(hash) AS hash FROM artifacts WHERE hash <> '' GROUP BY ALL")
_COPIES = ("copies", """
SELECT i.investigation_id, i.endpoint_id, m.mount_point, i.hash, count(DISTINCT i.path) AS inside, min(i.path) AS target,
  count(DISTINCT o.path) AS outside, min(o.path) AS source, count(DISTINCT i.path) * count(DISTINCT o.path) AS pairs
FROM mnt m JOIN files i ON i.investigation_id = m.investigation_id AND i.endpoint_id = m.endpoint_id AND starts_with(i.path, m.mount_point || '/')
JOIN files o ON o.investigation_id = i.investigation_id AND o.endpoint_id = i.endpoint_id AND o.hash = i.hash AND NOT starts_with(o.path, m.mount_point || '/')
GROUP BY ALL""")
_TOUCH = ("touch", """
SELECT m.investigation_id, m.endpoint_id, m.mount_point,
  (SELECT coalesce(sum(mentions), 0) FROM mentions x WHERE x.investigation_id = m.investigation_id AND x.endpoint_id = m.endpoint_id AND starts_with(x.path, m.mount_point || '/')) AS touched,
  (SELECT count(DISTINCT path) FROM artifacts a WHERE a.investigation_id = m.investigation_id AND a.endpoint_id = m.endpoint_id AND starts_with(a.path, m.mount_point || '/')) AS written
FROM mnt m""")


@query("media_touches", view_sql(_EA, """
SELECT * FROM touch WHERE touched > 0 OR written > 0""", extra=(_LINKS[0], _MOUNTS, _TOUCH)))
def _(spark, sf):
    return S.media_touches(mounts(spark, sf), events(spark, sf),
                           evidence(spark, sf, "artifacts")).select(
        "investigation_id", "endpoint_id", "mount_point", "touched", "written")


@query("media_copies", view_sql(_EA, "SELECT * FROM copies", extra=(_MOUNTS, _FILES, _COPIES)))
def _(spark, sf):
    return S.media_copies(mounts(spark, sf), evidence(spark, sf, "artifacts"))


@query("removable_media_findings", view_sql(_EA, """
SELECT t.investigation_id, t.endpoint_id, t.mount_point AS subject, CASE WHEN c.pairs > 0 THEN 'high' ELSE 'medium' END AS severity,
  CASE WHEN c.pairs > 0 THEN CASE WHEN touched > 0 AND written > 0 THEN 'PRIORITY_1' ELSE 'PRIORITY_2' END ELSE 'PRIORITY_3' END AS priority
FROM touch t LEFT JOIN (SELECT investigation_id, endpoint_id, mount_point, sum(pairs) AS pairs FROM copies GROUP BY ALL) c
  USING (investigation_id, endpoint_id, mount_point) WHERE touched > 0 OR written > 0""",
       extra=(_LINKS[0], _MOUNTS, _FILES, _COPIES, _TOUCH)))
def _(spark, sf):
    return S.removable_media_findings(mounts(spark, sf), events(spark, sf),
                                      evidence(spark, sf, "artifacts")).select(
        "investigation_id", "endpoint_id", "subject", "severity", "priority")


@query("all_findings", view_sql(_TRI, """
SELECT investigation_id, count(*) AS findings, count(*) AS highest, count(*) FILTER (g = 1) AS downloads FROM (
  SELECT investigation_id, 0 AS g FROM found UNION ALL SELECT investigation_id, 1 FROM dl) GROUP BY ALL""",
       extra=(*_CORRELATED, *_LINKS)))
def _(spark, sf):
    arts, evs = evidence(spark, sf, "artifacts"), events(spark, sf)
    first = C.union_sources(C.artifact_findings(evs, arts), C.indicator_findings(arts))
    links = S.link_downloads(evidence(spark, sf, "downloads"), arts, evs)
    return R.all_findings(first, S.download_findings(links)).groupBy("investigation_id").agg(
        F.count("*").alias("findings"),
        F.max(F.regexp_extract("reference", "[0-9]+", 0).cast("bigint")).alias("highest"),
        F.count_if(F.col("category").startswith("download_")).alias("downloads"))


# --- fleet ------------------------------------------------------------------------------
def fleet_results(spark, sf):
    docs, pages = table(spark, sf, "documents"), table(spark, sf, "pages")
    rows = evidence(spark, sf, "base")
    return {
        "artifacts": docs.select(F.col("source").alias("endpoint_id"), F.sha2(
            "text", 256).alias("hash"), F.col("doc_id").cast("string").alias("path")),
        "downloads": pages.select(
            F.concat(F.lit("src"), (F.col("page_id") % 20).cast("string")).alias("endpoint_id"),
            F.concat(F.lit("/d/file"), (F.col("page_id") % 40).cast("string")).alias("target_path"),
            "url"),
        "connections": rows.select(
            F.concat(F.lit("src"), (F.col("u") % 20).cast("string")).alias("endpoint_id"),
            F.concat(F.when(F.col("k") < 5, "127.0.0.1").when(F.col("k") < 10, F.concat(
                F.lit("169.254.1."), F.col("k").cast("string"))).otherwise(F.concat(
                    F.lit("10."), F.col("k").cast("string"), F.lit("."),
                    (F.col("v") % 50).cast("string"), F.lit(".7"))), F.lit(":443")).alias(
                        "remote_address")),
        "drivers": rows.select(
            F.concat(F.lit("src"), (F.col("u") % 20).cast("string")).alias("endpoint_id"),
            F.concat(F.lit("drv"), F.col("k").cast("string")).alias("name"),
            F.lit(None).cast("string").alias("sha256"), F.when(
                F.col("k") == 7, "MATCHED").otherwise("UNKNOWN").alias("risk_status")),
        "devices": rows.select(
            F.concat(F.lit("src"), (F.col("u") % 20).cast("string")).alias("endpoint_id"),
            F.when(F.col("k") < 20, "00000000").when(F.col("k") < 40, F.concat(
                F.lit("0000:00:1"), F.col("k").cast("string"))).otherwise(F.concat(
                    F.lit("SN"), (F.col("v") * 1000 + F.col("k")).cast("string"))).alias("serial"),
            F.lit("Acme").alias("vendor"), F.col("event_type").alias("product"),
            F.when(F.col("k") < 90, "removable").otherwise("fixed").alias("removable")),
    }


_OBS = """WITH b AS (SELECT user_id AS u, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k, CAST(floor(value) AS BIGINT) AS v, event_type FROM events),
obs AS (
  SELECT source AS endpoint_id, 'file_hash' AS kind, sha256(text) AS key, false AS abused FROM documents
  UNION ALL SELECT 'src' || CAST(page_id % 20 AS VARCHAR), 'download', 'file' || CAST(page_id % 40 AS VARCHAR) || ' from ' || regexp_extract(url, '//([^/]*)', 1), false FROM pages
  UNION ALL SELECT 'src' || CAST(u % 20 AS VARCHAR), 'remote_address', '10.' || CAST(k AS VARCHAR) || '.' || CAST(v % 50 AS VARCHAR) || '.7', false FROM b WHERE k >= 10
  UNION ALL SELECT 'src' || CAST(u % 20 AS VARCHAR), 'driver', 'drv' || CAST(k AS VARCHAR), k = 7 FROM b
  UNION ALL SELECT 'src' || CAST(u % 20 AS VARCHAR), 'usb_device', 'Acme ' || event_type || ' [SN' || CAST(v * 1000 + k AS VARCHAR) || ']', false FROM b
    WHERE k >= 40 AND k < 90 AND length('SN' || CAST(v * 1000 + k AS VARCHAR)) >= 6),
tot AS (SELECT count(DISTINCT source) AS n FROM documents),
g AS (SELECT kind, key, count(DISTINCT endpoint_id) AS endpoint_count, count(*) AS observations, bool_or(abused) AS notable FROM obs GROUP BY ALL),
c AS (SELECT kind, key, endpoint_count, observations, round(endpoint_count / n, 3) AS prevalence, endpoint_count = n AS ubiquitous, notable FROM g, tot WHERE endpoint_count >= 2)
"""


def _hosts(spark, sf):
    return table(spark, sf, "documents").select(F.col("source").alias("endpoint_id"))


@query("fleet_observables", _OBS + """
SELECT kind, count(*) AS observations, count(DISTINCT key) AS keys, count(DISTINCT endpoint_id) AS hosts FROM obs GROUP BY ALL""")
def _(spark, sf):
    return FL.fleet_observables(fleet_results(spark, sf)).groupBy("kind").agg(
        F.count("*").alias("observations"), F.countDistinct("key").alias("keys"),
        F.countDistinct("endpoint_id").alias("hosts"))


@query("fleet_correlation", _OBS + """
SELECT * FROM c WHERE NOT (kind = 'driver' AND ubiquitous AND NOT notable)""")
def _(spark, sf):
    return FL.fleet_correlation(FL.fleet_observables(fleet_results(spark, sf)), _hosts(spark, sf))


@query("fleet_correlation_page", _OBS + """
SELECT kind, key FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY notable DESC, prevalence, key) AS rn FROM c
  WHERE NOT (kind = 'driver' AND ubiquitous AND NOT notable)) WHERE rn <= 50""")
def _(spark, sf):
    return FL.fleet_correlation(FL.fleet_observables(fleet_results(spark, sf)), _hosts(spark, sf),
                                top_per_kind=50).select("kind", "key")


@query("suppressed_observables", _OBS + """
SELECT kind, count(*) AS suppressed FROM c WHERE kind = 'driver' AND ubiquitous AND NOT notable GROUP BY ALL""")
def _(spark, sf):
    return FL.suppressed_observables(FL.fleet_observables(fleet_results(spark, sf)),
                                     _hosts(spark, sf))


@query("observable_endpoints", _OBS + """
SELECT kind, key, endpoint_id, count(*) AS observations FROM obs GROUP BY ALL""")
def _(spark, sf):
    return FL.observable_endpoints(FL.fleet_observables(fleet_results(spark, sf))).drop(
        "known_abused")


@query("endpoint_names", view_sql(["exec_events"], """
SELECT event_id, CASE WHEN n.n_nationkey < 12 THEN n.n_name ELSE endpoint_id END AS endpoint
FROM exec_events LEFT JOIN nation n ON endpoint_id = 'host-' || CAST(n.n_nationkey AS VARCHAR)"""))
def _(spark, sf):
    names = table(spark, sf, "nation").select(
        F.concat(F.lit("host-"), F.col("n_nationkey").cast("string")).alias("endpoint_id"),
        F.when(F.col("n_nationkey") < 12, F.col("n_name")).otherwise("").alias("name"))
    return FL.endpoint_names(evidence(spark, sf, "exec_events"), names).select(
        "event_id", "endpoint")


def tasks(spark, sf):
    orders = table(spark, sf, "orders")
    status = F.element_at(F.array(*[F.lit(s) for s in (
        "queued", "dispatched", "succeeded", "failed", "abandoned")]),
        (F.col("o_orderkey") % 5 + 1).cast("int"))
    return orders.select(
        F.concat(F.lit("host-"), (F.col("o_custkey") % 40).cast("string")).alias("endpoint_id"),
        F.col("o_orderkey").alias("id"), status.alias("status"),
        (F.col("o_custkey") % 4 + 1).alias("attempts"), F.lit(3).alias("max_attempts"),
        F.col("o_orderdate").cast("timestamp").alias("dispatched_at"))


_TASKS = """WITH t AS (SELECT 'host-' || CAST(o_custkey % 40 AS VARCHAR) AS endpoint_id, o_orderkey AS id,
  ['queued','dispatched','succeeded','failed','abandoned'][CAST(o_orderkey % 5 + 1 AS INT)] AS status,
  o_custkey % 4 + 1 AS attempts, o_orderdate AS dispatched_at FROM orders)
"""


@query("endpoint_task_counts", _TASKS + """
SELECT endpoint_id, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'dispatched') AS dispatched,
 count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed,
 count(*) FILTER (status = 'abandoned') AS abandoned FROM t GROUP BY ALL""")
def _(spark, sf):
    return FL.endpoint_task_counts(tasks(spark, sf))


@query("sweep_tasks", _TASKS + """
SELECT id, CASE WHEN status = 'dispatched' AND dispatched_at <= TIMESTAMP '1998-01-01' - INTERVAL 300 SECOND
  THEN CASE WHEN attempts >= 3 THEN 'abandoned' ELSE 'queued' END ELSE status END AS new_status FROM t""")
def _(spark, sf):
    return FL.sweep_tasks(tasks(spark, sf), "1998-01-01 00:00:00").select("id", "new_status")


@query("endpoint_health", """
SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'revoked' WHEN last_seen IS NULL THEN 'never_seen'
  WHEN last_seen < TIMESTAMP '1998-01-01' - INTERVAL 300 SECOND THEN 'stale' ELSE 'healthy' END AS state
FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_seen FROM orders GROUP BY ALL) ON o_custkey = c_custkey""")
def _(spark, sf):
    last = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("o_orderdate").cast("timestamp").alias("last_seen"))
    rows = table(spark, sf, "customer").join(last, "c_custkey", "left").withColumn(
        "status", F.when(F.col("c_mktsegment") == "MACHINERY", "revoked").otherwise("active"))
    return FL.endpoint_health(rows, "1998-01-01 00:00:00").select("c_custkey", "state")


# --- ledger and cases ---------------------------------------------------------------------
@query("hash_history", view_sql(["ledger"], """
SELECT endpoint_id, path, seq, size_bytes, CASE WHEN ph IS NULL THEN 'first_recorded' WHEN pa <> algorithm THEN 'algorithm_mismatch'
  WHEN ph = hash THEN 'unchanged' ELSE 'altered' END AS status, ph AS previous_hash, count(*) AS n FROM (
  SELECT *, lag(hash) OVER w AS ph, lag(algorithm) OVER w AS pa FROM ledger
  WINDOW w AS (PARTITION BY endpoint_id, path ORDER BY ts, seq, hash, algorithm, size_bytes)) GROUP BY ALL"""))
def _(spark, sf):
    return L.hash_history(evidence(spark, sf, "ledger")).groupBy(
        "endpoint_id", "path", "seq", "size_bytes", "status", "previous_hash").agg(
            F.count("*").alias("n"))


@query("trim_history", view_sql(["ledger"], """
SELECT endpoint_id, path, seq, size_bytes FROM (SELECT *, row_number() OVER (PARTITION BY endpoint_id, path
  ORDER BY ts DESC, seq DESC, hash DESC, algorithm DESC, size_bytes DESC) AS rn FROM ledger) WHERE rn <= 20"""))
def _(spark, sf):
    return L.trim_history(evidence(spark, sf, "ledger"), keep=20).select(
        "endpoint_id", "path", "seq", "size_bytes")


@query("latest_hash", view_sql(["ledger"], """
SELECT endpoint_id, path, hash, algorithm, ts FROM (SELECT *, row_number() OVER (PARTITION BY endpoint_id, path
  ORDER BY ts DESC, seq DESC, hash DESC, algorithm DESC, size_bytes DESC) AS rn FROM ledger) WHERE rn = 1"""))
def _(spark, sf):
    return L.latest_hash(evidence(spark, sf, "ledger"))


def registrations(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 9 != 4, F.sha2("text", 256)).alias(
            "sha256"), F.concat(F.lit("/evidence/"), F.col("doc_id").cast("string")).alias("path"),
        F.timestamp_seconds(F.lit(1700000000) + F.col("n_chars")).alias("registered_at"))


@query("supersedes", """
SELECT doc_id AS id, CASE WHEN sha IS NOT NULL THEN lag(doc_id) OVER (PARTITION BY sha ORDER BY n_chars, doc_id) END AS supersedes
FROM (SELECT *, CASE WHEN doc_id % 9 <> 4 THEN sha256(text) END AS sha FROM documents)""")
def _(spark, sf):
    return L.supersedes(registrations(spark, sf)).select("id", "supersedes")


_VERIFY = """SELECT doc_id AS id, CASE WHEN doc_id % 13 = 2 THEN 'MISSING' WHEN doc_id % 13 = 3 THEN 'UNVERIFIED'
  WHEN doc_id % 9 = 4 THEN 'VERIFIED' WHEN doc_id % 13 = 5 THEN 'MISMATCH' ELSE 'VERIFIED' END AS verification_state FROM documents"""


def verified(spark, sf):
    docs = table(spark, sf, "documents")
    kind = F.col("doc_id") % 13
    seen = docs.filter(kind != 2).select(
        F.concat(F.lit("/evidence/"), F.col("doc_id").cast("string")).alias("path"),
        F.when(kind == 5, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(
            F.sha2("text", 256)).alias("sha256"), (kind != 3).alias("readable"))
    return L.verify_evidence(registrations(spark, sf), seen)


@query("verify_evidence", _VERIFY)
def _(spark, sf):
    return verified(spark, sf).select("id", "verification_state")


@query("verified_sources_only", f"""SELECT id, verification_state NOT IN ('MISMATCH', 'MISSING') AS usable FROM ({_VERIFY})""")
def _(spark, sf):
    good, refused = L.verified_sources_only(verified(spark, sf))
    return good.select("id", F.lit(True).alias("usable")).unionByName(
        refused.select("id", F.lit(False).alias("usable")))


@query("verify_package", """
SELECT 'f' || CAST(doc_id AS VARCHAR) AS name, CASE WHEN doc_id % 10 = 1 THEN 'missing' WHEN doc_id % 10 = 2 THEN 'mismatched'
  WHEN doc_id % 10 = 3 THEN 'unlisted' ELSE 'verified' END AS state FROM documents""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("name"),
        (F.col("doc_id") % 10).alias("r"), F.sha2("text", 256).alias("sha256"))
    found = docs.filter("r <> 1").withColumn("sha256", F.when(
        F.col("r") == 2, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    return L.verify_package(docs.filter("r <> 3"), found)


@query("package_verdict", """
SELECT count(*) FILTER (doc_id % 10 NOT IN (1, 3)) AS files_checked, count(*) FILTER (doc_id % 10 = 1) AS missing,
  count(*) FILTER (doc_id % 10 = 2) AS mismatched, false AS verified FROM documents""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("name"),
        (F.col("doc_id") % 10).alias("r"), F.sha2("text", 256).alias("sha256"))
    found = docs.filter("r <> 1").withColumn("sha256", F.when(
        F.col("r") == 2, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    return L.package_verdict(L.verify_package(docs.filter("r <> 3"), found))


@query("assessment_vs_machine", """
WITH c AS (SELECT o_custkey % 200 AS s, o_orderdate AS ts, o_orderstatus AS category, o_orderpriority AS priority FROM orders),
a AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey % 200 AS s, l_shipdate AS at_ts FROM lineitem)
SELECT a.id, a.s AS subject, any_value(a.at_ts) AS created_at, (SELECT max(category || '/' || priority) FROM c WHERE c.s = a.s AND c.ts = (
  SELECT max(ts) FROM c c2 WHERE c2.s = a.s AND c2.ts <= a.at_ts)) AS machine FROM a GROUP BY a.id, a.s, a.at_ts""")
def _(spark, sf):
    line, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    scope = [F.lit("inv-0").alias("investigation_id"), F.lit("activity").alias("subject_type")]
    made = line.select(*scope, (F.col("l_partkey") % 200).cast("string").alias("subject_id"),
                       (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
                       F.col("l_shipdate").cast("timestamp").alias("created_at")).distinct()
    stood = orders.select(*scope, (F.col("o_custkey") % 200).cast("string").alias("subject_id"),
                          F.col("o_orderdate").cast("timestamp").alias("ts"),
                          F.col("o_orderstatus").alias("category"),
                          F.col("o_orderpriority").alias("priority"))
    return L.assessment_vs_machine(made, stood).select(
        "id", F.col("subject_id").cast("bigint").alias("subject"), "created_at",
        F.concat_ws("/", "machine_classification", "machine_priority").alias("m")).withColumn(
            "machine", F.nullif("m", F.lit(""))).drop("m")


@query("list_latest", """
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC""")
def _(spark, sf):
    rows = table(spark, sf, "orders").withColumnRenamed("o_orderdate", "created_at").withColumnRenamed(
        "o_orderkey", "id")
    return L.list_latest(rows, o_orderstatus="F").select(F.col("id").alias("o_orderkey"))


@query("filter_list", """
SELECT c_custkey FROM customer WHERE (c_name ILIKE '%mer#0000000_1%' ESCAPE '!' AND contains(lower(c_name), 'r#000000011')) AND c_mktsegment = 'MACHINERY'""")
def _(spark, sf):
    rows = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_name").alias("title"), F.lit("laptop").alias("device"),
        F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("status"))
    return L.filter_list(rows, "r#000000011", "MACHINERY").select("c_custkey")


@query("executions_with_reports", """
SELECT o_orderkey AS id, r.doc_id AS report_id FROM orders LEFT JOIN documents r ON r.doc_id * 3 = o_orderkey""")
def _(spark, sf):
    reports = table(spark, sf, "documents").select(
        (F.col("doc_id") * 3).alias("execution_id"), F.col("doc_id").alias("id"),
        F.col("lang").alias("status"))
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return L.executions_with_reports(runs, reports).select("id", "report_id")


@query("completion_status", """
SELECT o_custkey AS investigation_id, CASE WHEN bool_or(o_orderpriority = '1-URGENT') THEN 'cancelled'
  WHEN bool_or(o_orderstatus = 'P') THEN 'partially_completed' ELSE 'completed' END AS status FROM orders GROUP BY ALL""")
def _(spark, sf):
    return L.completion_status(table(spark, sf, "orders").select(
        F.col("o_custkey").alias("investigation_id"),
        (F.col("o_orderpriority") == "1-URGENT").alias("cancelled"),
        (F.col("o_orderstatus") == "P").alias("failed"), F.lit(False).alias("incomplete")))


@query("collector_versions", """
WITH s AS (SELECT lang AS collector, max(CASE WHEN n_chars > 300 THEN CAST(n_chars AS VARCHAR) END) AS v FROM documents WHERE lang <> 'de' GROUP BY ALL),
x AS (SELECT lang AS collector, min('log-' || source) AS v FROM documents GROUP BY ALL)
SELECT x.collector, coalesce(s.v, x.v) AS version FROM x LEFT JOIN s USING (collector)""")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    at = F.lit("2024-01-01").cast("timestamp").alias("ts")
    steps = docs.filter("lang <> 'de'").select(F.col("lang").alias("collector"), at, F.when(
        F.col("n_chars") > 300, F.col("n_chars").cast("string")).alias("version"))
    runs = docs.select(F.col("lang").alias("collector"), at,
                       F.concat(F.lit("log-"), "source").alias("version"))
    return L.collector_versions(steps, runs)


@query("case_counts", """
SELECT c_custkey AS investigation_id, c_nationkey AS case_id, count(DISTINCT o_orderkey) AS evidence, count(DISTINCT e.event_id) AS findings
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN events e ON e.user_id = c_custkey GROUP BY ALL""")
def _(spark, sf):
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("investigation_id"),
                                               F.col("c_nationkey").alias("case_id"))
    held = table(spark, sf, "orders").select(F.col("o_custkey").alias("investigation_id"))
    found = table(spark, sf, "events").select(F.col("user_id").alias("investigation_id"))
    return L.case_counts(cust, held, found)


@query("latest_per", """
SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def _(spark, sf):
    return L.latest_per(table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), ["o_custkey"],
        [F.col("o_orderdate"), F.col("o_orderkey")]).drop("o_orderdate")


@query("latest_assessment", """
SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def _(spark, sf):
    return L.latest_per(table(spark, sf, "events").select(
        "user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"],
        [F.col("ts"), F.col("event_id")]).select("user_id", "event_id")


