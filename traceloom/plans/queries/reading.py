"""Predicates, search, timeline, threads, recognition, narrative and briefs."""

from ... import vocab as V
from ...operators import activity as A
from ...operators import correlate as C
from ...operators import narrative as N
from ...operators import predicates as P
from ...operators import recognize as G
from ...operators import search as Q
from ...operators import search_index as I
from ...operators import threads as H
from ...operators import timeline as M
from ...operators.events import assign_event_references
from ...session import new_folder
from ..oracle import INDEPENDENT_THREADS, INSTALLS_SQL, npath, scored_sql, view_sql
from ..registry import query
from .common import F, X, classified, evidence, events, joined, ranked, table
from .identity import sources
from .links import _CORRELATED, fleet_results


def compared(field, operator, value):
    return {"type": "comparison", "field": field, "operator": operator, "value": value}


_TREE = {"type": "or", "operands": [
    {"type": "and", "operands": [compared("COMMAND", "CONTAINS", "CURL"),
                                 {"type": "not", "operand": compared("USER", "EQUALS", "user7")}]},
    compared("PATH", "STARTS", "/tmp/"), compared("PROCESS", "ONEOF", ["CRON", "git"]),
    compared("SOURCE", "ENDS", "log"), compared("COMMAND", "MATCHES", r"run[0-9]+\.py"),
    compared("URL", "CONTAINS", "never")]}


@query("select_where", view_sql(["exec_events"], r"""
SELECT event_id FROM exec_events WHERE
  (coalesce(contains(lower(full_command_line), 'curl'), false) AND NOT coalesce(lower("user") = 'user7', false))
  OR coalesce(starts_with(lower(executable), '/tmp/'), false)
  OR coalesce(lower(process_name) IN ('cron', 'git'), false) OR coalesce(lower(executable) IN ('cron', 'git'), false)
  OR lower(source) LIKE '%log' OR lower(evidence_kind) LIKE '%log'
  OR coalesce(regexp_matches(full_command_line, 'run[0-9]+\.py'), false)"""))
def _(spark, sf):
    return P.select_where(evidence(spark, sf, "exec_events"), [_TREE]).select("event_id")


@query("field_candidates", view_sql(["exec_events"], """
SELECT endpoint_id, "user", count(*) AS n FROM exec_events WHERE lower("user") = 'user12' GROUP BY ALL"""))
def _(spark, sf):
    """A nested ``records`` array contributes its fields."""
    rows = evidence(spark, sf, "exec_events").withColumn("records", F.array(F.struct(
        F.col("user").alias("user"), F.col("event_id").alias("event_id")))).withColumnRenamed(
            "user", "who")
    return P.select_where(rows, [compared("USER", "EQUALS", "User12")]).groupBy(
        "endpoint_id", F.col("who").alias("user")).agg(F.count("*").alias("n"))


@query("search_files", view_sql(["artifacts"], """
SELECT endpoint_id, path, collection_order FROM artifacts WHERE contains(lower(regexp_extract(path, '[^/]*$', 0)), 'setup9')"""))
def _(spark, sf):
    from ...sources.host import file_inventory, search_files
    return search_files(file_inventory(evidence(spark, sf, "artifacts")), " SETUP9").select(
        "endpoint_id", "path", "collection_order")


@query("list_directory", view_sql(["artifacts"], """
SELECT path, collection_order FROM artifacts WHERE starts_with(path, '/tmp/') AND NOT contains(substr(path, 6), '/')
ORDER BY lower(regexp_extract(path, '[^/]*$', 0)), path, collection_order"""))
def _(spark, sf):
    from ...sources.host import file_inventory, list_directory
    return list_directory(file_inventory(evidence(spark, sf, "artifacts")), "/tmp").select("path", "collection_order")


# --- search and selection over surfaces --------------------------------------------
def surfaces(spark, sf):
    rows = classified(spark, sf)
    return {"activity": A.activity_groups(rows), "activity_records": A.activity_records(rows),
            "artifact": evidence(spark, sf, "artifacts"),
            "browser download": evidence(spark, sf, "downloads"),
            "network": fleet_results(spark, sf)["connections"]}


_MORE = ("artifacts", "downloads")
_NET = """(SELECT '10.' || CAST(k AS VARCHAR) || '.' || CAST(v % 50 AS VARCHAR) || '.7' || ':443' AS remote_address, k FROM base
 WHERE k >= 10)"""


_FOUND = scored_sql("groups", f"""
SELECT 'activity' AS kind, coalesce(full_command_line, executable, process_name) AS label,
  concat_ws(',', CASE WHEN contains(lower(full_command_line), 'staged1') THEN 'command' END,
    CASE WHEN contains(lower(coalesce(full_command_line, executable, process_name)), 'staged1') THEN 'normalized command' END,
    CASE WHEN contains(lower(executable), 'staged1') THEN 'executable' END,
    CASE WHEN contains(lower(process_name), 'staged1') THEN 'process name' END) AS matched, count(*) AS n
FROM groups WHERE contains(lower(concat_ws(' ', full_command_line, executable, process_name)), 'staged1') GROUP BY ALL
UNION ALL SELECT 'artifact', path, 'path,filename', count(*) FROM artifacts WHERE contains(path, 'staged1') GROUP BY ALL
UNION ALL SELECT 'browser download', target_path, 'download path', count(*) FROM downloads WHERE contains(target_path, 'staged1') GROUP BY ALL
UNION ALL SELECT 'network', remote_address, 'remote address', count(*) FROM {_NET} WHERE contains(remote_address, 'staged1') GROUP BY ALL""",
                    "downloads")


@query("search_evidence", _FOUND)
def _(spark, sf):
    found = Q.search_evidence(surfaces(spark, sf), " Staged1 ")
    return found.groupBy("kind", "label", joined("matched_fields").alias("matched")).agg(
        F.count("*").alias("n"))


@query("search_index", _FOUND)
def _(spark, sf):
    folder = new_folder(spark, "index")
    I.write_search_index(surfaces(spark, sf), folder)
    found = I.search_index(spark, folder, " Staged1 ")
    return found.groupBy("kind", "label", joined("matched_fields").alias("matched")).agg(
        F.count("*").alias("n"))


@query("search_counts", scored_sql("groups", """
SELECT kind, count(*) AS hits FROM (
  SELECT 'activity' AS kind FROM groups g WHERE endpoint_id = 'host-11' OR contains(lower(concat_ws(' ', full_command_line, executable, process_name)), 'host-11')
  UNION ALL SELECT 'artifact' FROM artifacts WHERE endpoint_id = 'host-11') GROUP BY ALL"""))
def _(spark, sf):
    return Q.search_counts(Q.search_evidence(surfaces(spark, sf), "host-11",
                                             kinds=["activity", "artifact"]))


@query("cap_per_kind", scored_sql("groups", """
SELECT kind, least(count(*), 20) AS shown, count(*) > 20 AS truncated FROM (
  SELECT 'artifact' AS kind FROM artifacts WHERE contains(path, 'setup')
  UNION ALL SELECT 'browser download' FROM downloads WHERE contains(target_path, 'setup') OR contains(lower(url), 'setup')) GROUP BY ALL""", "downloads"))
def _(spark, sf):
    found = Q.search_evidence(surfaces(spark, sf), "setup", kinds=["artifact", "browser download"],
                              per_kind=20)
    return found.groupBy("kind").agg(F.count("*").alias("shown"),
                                     F.bool_or("truncated").alias("truncated"))


@query("select_surfaces", scored_sql("groups", """
SELECT kind, label, count(*) AS n FROM (
  SELECT 'activity' AS kind, coalesce(full_command_line, executable, process_name) AS label FROM groups g
  WHERE starts_with(executable, '/tmp/') OR EXISTS (SELECT 1 FROM scored s WHERE s.investigation_id = g.investigation_id
    AND s.endpoint_id = g.endpoint_id AND s.akey = g.akey AND (s."user" = 'user33' OR starts_with(s.executable, '/tmp/')))
  UNION ALL SELECT 'artifact', path FROM artifacts WHERE starts_with(path, '/tmp/')) GROUP BY ALL"""))
def _(spark, sf):
    tables = surfaces(spark, sf)
    wanted = {"type": "or", "operands": [compared("PATH", "STARTS", "/TMP/"),
                                         compared("USER", "EQUALS", "user33")]}
    return Q.select_surfaces({k: tables[k] for k in (
        "activity", "activity_records", "artifact")}, [wanted]).groupBy("kind", "label").agg(
            F.count("*").alias("n"))


# --- timeline -------------------------------------------------------------------------
def dated_artifacts(spark, sf):
    return evidence(spark, sf, "artifacts").withColumn("modified", F.when(
        F.col("collection_status") == "COLLECTED",
        F.timestamp_seconds(F.lit(1704067200) + F.col("collection_order") * 97)))


_TIMELINE = ("tl", """
SELECT investigation_id, endpoint_id, evidence_kind AS kind, ts, coalesce(full_command_line, executable, process_name) AS title,
  event_id AS reference_id FROM exec_events
UNION ALL SELECT investigation_id, endpoint_id, 'ARTIFACT_OBSERVATION', CASE WHEN collection_status = 'COLLECTED' THEN
  TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * CAST(collection_order * 97 AS INT) END, filename || ' last modified', path FROM artifacts""")


def timeline(spark, sf, **options):
    return M.build_timeline(events(spark, sf), dated_artifacts(spark, sf), **options)


@query("build_timeline", view_sql(["exec_events", "artifacts"], """
SELECT investigation_id, kind, ts, title, reference_id, count(*) AS n FROM tl GROUP BY ALL""", extra=(_TIMELINE,)))
def _(spark, sf):
    return timeline(spark, sf).groupBy("investigation_id", "kind", "ts", "title",
                                       "reference_id").agg(F.count("*").alias("n"))


@query("newest_timeline", view_sql(["exec_events", "artifacts"], """
SELECT investigation_id, kind, ts, reference_id FROM (SELECT *, row_number() OVER (PARTITION BY investigation_id
  ORDER BY ts DESC NULLS LAST, kind, title, reference_id, endpoint_id) AS n FROM tl) WHERE n <= 1000""", extra=(_TIMELINE,)))
def _(spark, sf):
    return timeline(spark, sf, newest=1000).select("investigation_id", "kind", "ts",
                                                   "reference_id")


@query("timeline_statistics", view_sql(["exec_events", "artifacts"], """
SELECT investigation_id, kind, count(*) AS entries, count(*) FILTER (ts IS NULL) AS undated FROM tl GROUP BY ALL""", extra=(_TIMELINE,)))
def _(spark, sf):
    return M.timeline_statistics(timeline(spark, sf))


@query("significant_events", scored_sql("groups", """
SELECT investigation_id, kind, ts, position FROM (SELECT *, row_number() OVER (PARTITION BY investigation_id
  ORDER BY ts ASC NULLS LAST, kind, title) AS position FROM (
  SELECT investigation_id, evidence_kind AS kind, coalesce(last_seen, first_seen) AS ts, coalesce(full_command_line, executable, process_name) AS title
  FROM groups WHERE priority IN ('PRIORITY_1', 'PRIORITY_2')
  UNION ALL SELECT investigation_id, 'FINDING', NULL, subject FROM found WHERE triage NOT LIKE 'NOT_HARMFUL%'
  UNION ALL SELECT investigation_id, 'ARTIFACT_OBSERVATION', NULL, filename || ' named by evidence but absent' FROM artifacts WHERE collection_status = 'MISSING'))""",
       extra=_CORRELATED[1:]))
def _(spark, sf):
    groups = A.activity_groups(classified(spark, sf))
    arts = dated_artifacts(spark, sf)
    found, _, _ = C.correlate(events(spark, sf), arts)
    return M.significant_events(groups, found, arts).select("investigation_id", "kind", "ts",
                                                           "position")


# --- threads --------------------------------------------------------------------------
def _thread_sql(select):
    return scored_sql("ranked", select, extra=INDEPENDENT_THREADS)


def thread_inputs(spark, sf):
    """Ranked activities, and the records of the same events, which need no scores."""
    return ranked(spark, sf), A.activity_records(events(spark, sf))


@query("group_tokens", _thread_sql("""
SELECT investigation_id, token, count(*) AS activities FROM tok GROUP BY ALL"""))
def _(spark, sf):
    return H.group_tokens(A.activity_groups(classified(spark, sf))).groupBy(
        "investigation_id", "token").agg(F.count("*").alias("activities"))


@query("rare_tokens", _thread_sql("""
SELECT investigation_id, token, count(*) AS df FROM tok GROUP BY ALL HAVING count(*) BETWEEN 2 AND 8"""))
def _(spark, sf):
    return H.rare_tokens(H.group_tokens(A.activity_groups(classified(spark, sf))), max_df=V.TOKEN_MAX_DF).groupBy(
        "investigation_id", "token").agg(F.max("df").alias("df"))


def group_keys(groups):
    """What tells an activity apart in words, as the SQL has it."""
    return groups.select("group_id", F.concat("investigation_id", "endpoint_id", "evidence_kind", F.lit("\u0001"),
                                              "activity_key").alias("key"))


def by_key(pairs, groups):
    """``a`` and ``b`` by their keys, the lesser first."""
    keys = group_keys(groups)
    named = pairs.join(keys.select(F.col("group_id").alias("a"), F.col("key").alias("x")), "a").join(
        keys.select(F.col("group_id").alias("b"), F.col("key").alias("y")), "b")
    return named.withColumns({"a": F.least("x", "y"), "b": F.greatest("x", "y")}).drop("x", "y")


@query("candidate_pairs", _thread_sql("""
SELECT a.investigation_id, a.token, a.gid AS a, b.gid AS b FROM rare a JOIN rare b
  ON a.investigation_id = b.investigation_id AND a.token = b.token AND a.gid < b.gid"""))
def _(spark, sf):
    groups = A.activity_groups(classified(spark, sf))
    return by_key(H.candidate_pairs(H.rare_tokens(H.group_tokens(groups), max_df=V.TOKEN_MAX_DF)), groups)


@query("linked", _thread_sql("""
SELECT investigation_id, a, b, reason FROM edges"""))
def _(spark, sf):
    groups, records = thread_inputs(spark, sf)
    pairs = H.candidate_pairs(H.rare_tokens(H.group_tokens(groups), max_df=V.TOKEN_MAX_DF))
    return by_key(H.linked(pairs, groups, records), groups)


_ID = """md5(investigation_id || chr(2) || endpoint_id || chr(2) || evidence_kind || chr(2)
  || substr(akey, length(evidence_kind) + 2))"""
_CHAINS = (
    ("ids", f"SELECT gid, {_ID} AS id, cmd, first_seen, last_seen FROM named_groups"),
    ("words", f"""
SELECT t.investigation_id, t.token, i.id, {INSTALLS_SQL.replace('cmd', 'i.cmd')} AND contains(lower(i.cmd), t.token) AS inst,
  i.gid, first_seen, last_seen FROM tok t JOIN ids i USING (gid)
JOIN (SELECT investigation_id, token FROM tok GROUP BY ALL HAVING count(*) >= 2) m
  ON m.investigation_id = t.investigation_id AND m.token = t.token"""),
    ("moments", """
SELECT DISTINCT investigation_id, token, id, m FROM (SELECT *, unnest([first_seen, last_seen]) AS m FROM words) WHERE m IS NOT NULL"""),
    ("beside", """
SELECT investigation_id, token, x, id AS y, false AS inst FROM (
  SELECT *, lag(id) OVER w AS x, epoch_us(m) - epoch_us(lag(m) OVER w) AS gap FROM moments
  WINDOW w AS (PARTITION BY investigation_id, token ORDER BY m, id)) WHERE gap <= 1800000000 AND x <> id
UNION ALL SELECT investigation_id, token, x, id, false FROM (
  SELECT *, lag(id) OVER w AS x, line - lag(line) OVER w AS gap FROM words JOIN spots USING (gid) WHERE line IS NOT NULL
  WINDOW w AS (PARTITION BY investigation_id, token, file ORDER BY line, id)) WHERE gap <= 12 AND x <> id
UNION ALL SELECT w.investigation_id, w.token, f.x, w.id, true FROM words w JOIN (
  SELECT investigation_id, token, min(id) AS x FROM words WHERE inst GROUP BY ALL) f
  ON f.investigation_id = w.investigation_id AND f.token = w.token WHERE w.id <> f.x"""))


@query("chained", scored_sql("ranked", """
SELECT investigation_id, least(x, y) AS a, greatest(x, y) AS b, min(CASE WHEN inst
  THEN 'one installs or fetches ' || chr(39) || token || chr(39) || ' and another uses it'
  ELSE 'recorded close together and both reference ' || chr(39) || token || chr(39) END) AS reason
FROM beside GROUP BY ALL""", extra=(*INDEPENDENT_THREADS[:4], *_CHAINS)))
def _(spark, sf):
    groups, records = thread_inputs(spark, sf)
    return H.chained(H.rare_tokens(H.group_tokens(groups)), groups, records)


@query("connected", _thread_sql("""
SELECT investigation_id, investigation_id || endpoint_id || akey AS node, root FROM roots"""))
def _(spark, sf):
    groups, records = thread_inputs(spark, sf)
    pairs = H.candidate_pairs(H.rare_tokens(H.group_tokens(groups), max_df=V.TOKEN_MAX_DF))
    found = H.connected(H.linked(pairs, groups, records)).join(
        group_keys(groups).withColumnRenamed("group_id", "node"), "node")
    least = found.groupBy("root").agg(F.min("key").alias("least"))
    return found.join(least, "root").select("investigation_id", F.col("key").alias("node"),
                                            F.col("least").alias("root"))


@query("threads", _thread_sql("""
SELECT r.investigation_id, size, count(*) AS components, sum(records) AS records FROM (
  SELECT investigation_id, root, count(*) AS size, sum(occurrences) AS records FROM roots JOIN ranked USING (investigation_id, endpoint_id, akey) GROUP BY ALL) r
GROUP BY ALL"""))
def _(spark, sf):
    found, _ = H.threads(*thread_inputs(spark, sf), max_df=V.TOKEN_MAX_DF)
    return found.groupBy("investigation_id", "root").agg(
        F.sum("activity_count").alias("size"), F.sum("record_count").alias("records")).groupBy(
            "investigation_id", "size").agg(F.count("*").alias("components"),
                                            F.sum("records").alias("records"))


_TITLE_CASE = "CASE shape " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in V.THREAD_TITLES.items()) + " END"


@query("describe_threads", _thread_sql(f"""
SELECT d.investigation_id, thread_number, shape, {_TITLE_CASE} AS title, activity_count, record_count, execution, priority,
  CASE category_rank WHEN 0 THEN 'POTENTIALLY_HARMFUL' WHEN 1 THEN 'NEEDS_REVIEW' ELSE 'NOT_HARMFUL_ON_AVAILABLE_EVIDENCE' END AS category,
  s.sources, commands, coalesce(shared_terms, '') AS shared_terms
FROM described d JOIN told_sources s ON s.root = d.root AND s.piece = d.piece
LEFT JOIN shared h ON h.root = d.root AND h.piece = d.piece"""))
def _(spark, sf):
    found, _ = H.threads(*thread_inputs(spark, sf), max_df=V.TOKEN_MAX_DF)
    return found.select("investigation_id", "thread_number", "shape", "title", "activity_count",
                        "record_count", "execution", "priority", "category",
                        joined("sources").alias("sources"), joined("commands", " | ").alias(
                            "commands"), joined("shared_terms").alias("shared_terms"))


@query("thread_counts", _thread_sql("""
SELECT investigation_id, count(*) AS total, count(*) FILTER (class = 'priority_1') AS priority_1,
  count(*) FILTER (class = 'priority_2') AS priority_2, count(*) FILTER (class = 'noteworthy') AS noteworthy,
  count(*) FILTER (class = 'routine') AS routine, least(count(*) FILTER (class <> 'routine'), 6) AS printed FROM (
  SELECT *, CASE WHEN priority = 'PRIORITY_1' THEN 'priority_1' WHEN priority = 'PRIORITY_2' THEN 'priority_2'
    WHEN shape = 'install_then_use' OR (confirmed > 0 AND activity_count >= 3) THEN 'noteworthy' ELSE 'routine' END AS class
  FROM described) GROUP BY investigation_id"""))
def _(spark, sf):
    found, _ = H.threads(*thread_inputs(spark, sf), max_df=V.TOKEN_MAX_DF)
    return H.thread_counts(H.select_reported_threads(found))


# --- recognition ------------------------------------------------------------------------
VENDORS = (
    {"name": "App Zero", "path_contains": "/app0/", "marker": "bin/run", "confidence": "HIGH"},
    {"name": "Apps", "path_contains": "/opt/app", "marker": None, "confidence": "MODERATE"},
    {"name": "Server data", "path_contains": "/srv/", "marker": "missing/marker"},
)


def recognition_inputs(spark, sf):
    arts = evidence(spark, sf, "artifacts")
    parts = table(spark, sf, "part")
    hosts = arts.select("endpoint_id").distinct()
    owned = parts.select(
        F.concat(F.lit("host-"), (F.col("p_partkey") % 16).cast("string")).alias("endpoint_id"),
        F.concat(F.lit("/usr/bin//bin"), (F.col("p_partkey") % 15).cast("string")).alias("path"),
        F.col("p_brand").alias("package"))
    details = parts.groupBy(
        F.concat(F.lit("host-"), (F.col("p_partkey") % 16).cast("string")).alias("endpoint_id"),
        F.col("p_brand").alias("package")).agg(
            F.max("p_size").cast("string").alias("version"), F.lit("admin").alias("section"),
            F.max("p_name").alias("description"))
    inventory = arts.select("endpoint_id", "path").distinct()
    links = hosts.select("endpoint_id", F.lit("/usr/sbin/cron").alias("path"),
                         F.lit("/usr/bin/bin3").alias("target"))
    return dict(package_paths=owned.withColumn("path", G.fold_path("path")), packages=details,
                vendors=VENDORS, inventory=inventory, links=links)


def recognized(spark, sf):
    arts = evidence(spark, sf, "artifacts").select("endpoint_id", "path")
    images = evidence(spark, sf, "exec_events").filter("executable IS NOT NULL").select(
        "endpoint_id", F.col("executable").alias("path"))
    return G.recognize(arts.unionByName(images), **recognition_inputs(spark, sf))


_FOLD = "regexp_replace(replace({0}, chr(92), '/'), '/{{2,}}', '/', 'g')"
_RECOGNIZED = (
    ("owned", """SELECT 'host-' || CAST(p_partkey % 16 AS VARCHAR) AS endpoint_id, '/usr/bin/bin' || CAST(p_partkey % 15 AS VARCHAR) AS path,
  min(p_brand) AS package FROM part GROUP BY ALL"""),
    ("details", """SELECT 'host-' || CAST(p_partkey % 16 AS VARCHAR) AS endpoint_id, p_brand AS package, CAST(max(p_size) AS VARCHAR) AS version FROM part GROUP BY ALL"""),
    ("wanted", f"""SELECT DISTINCT endpoint_id, {_FOLD.format('p')} AS path FROM (SELECT endpoint_id, path AS p FROM artifacts
  UNION ALL SELECT endpoint_id, executable FROM exec_events WHERE executable IS NOT NULL)"""),
    ("recog", """
SELECT w.endpoint_id, w.path, o.package IS NOT NULL OR v.name IS NOT NULL OR l.package IS NOT NULL AS recognized,
  coalesce(o.package, v.name, l.package) AS recognized_name,
  CASE WHEN o.package IS NOT NULL THEN d.version WHEN v.name IS NOT NULL THEN NULL ELSE ld.version END AS version,
  CASE WHEN o.package IS NOT NULL THEN 'HIGH' WHEN v.name = 'App Zero' THEN 'HIGH' WHEN v.name = 'Apps' THEN 'MODERATE' WHEN l.package IS NOT NULL THEN 'HIGH'
    WHEN starts_with(w.path, '/tmp/') THEN 'NONE' WHEN starts_with(w.path, '/usr/bin/') OR starts_with(w.path, '/usr/sbin/') THEN 'LOW' ELSE 'NONE' END AS confidence,
  CASE WHEN o.package IS NULL AND v.name IS NULL AND l.package IS NOT NULL THEN w.path END AS resolved_from
FROM wanted w LEFT JOIN owned o ON o.endpoint_id = w.endpoint_id AND o.path = w.path
LEFT JOIN details d ON d.endpoint_id = w.endpoint_id AND d.package = o.package
LEFT JOIN (SELECT endpoint_id, path, CASE WHEN contains(path, '/app0/') AND EXISTS (SELECT 1 FROM artifacts a WHERE a.endpoint_id = x.endpoint_id AND a.path = '/opt/app0/bin/run')
   THEN 'App Zero' WHEN contains(path, '/opt/app') THEN 'Apps' END AS name FROM wanted x) v ON v.endpoint_id = w.endpoint_id AND v.path = w.path
LEFT JOIN owned l ON l.endpoint_id = w.endpoint_id AND w.path = '/usr/sbin/cron' AND l.path = '/usr/bin/bin3'
LEFT JOIN details ld ON ld.endpoint_id = w.endpoint_id AND ld.package = l.package"""))


@query("recognize", view_sql(["exec_events", "artifacts"], "SELECT * FROM recog", extra=_RECOGNIZED))
def _(spark, sf):
    return recognized(spark, sf).select("endpoint_id", "path", "recognized", "recognized_name",
                                        "version", "confidence", "resolved_from")


@query("match_vendors", view_sql(["exec_events", "artifacts"], """
SELECT recognized_name, count(*) AS n FROM recog WHERE recognized_name IN ('App Zero', 'Apps', 'Server data') GROUP BY ALL""", extra=_RECOGNIZED))
def _(spark, sf):
    given = recognition_inputs(spark, sf)
    paths = evidence(spark, sf, "artifacts").select("endpoint_id", "path").unionByName(
        evidence(spark, sf, "exec_events").filter("executable IS NOT NULL").select(
            "endpoint_id", F.col("executable").alias("path"))).select(
                "endpoint_id", G.fold_path("path").alias("path")).distinct().withColumn(
                    "candidate", F.col("path"))
    first = G.match_vendors(paths, list(VENDORS), given["inventory"]).groupBy(
        "endpoint_id", "path").agg(F.min_by("recognized_name", "ord").alias("recognized_name"))
    return first.groupBy("recognized_name").agg(F.count("*").alias("n"))


@query("match_snaps", view_sql(["exec_events"], """
SELECT event_id, r.r_name AS recognized_name FROM exec_events
JOIN region r ON CAST(pid % 7 AS INT) = r.r_regionkey"""))
def _(spark, sf):
    rows = evidence(spark, sf, "exec_events").select(
        "endpoint_id", "event_id", F.concat(F.lit("/snap/s"), (F.col("pid") % 7).cast("string"),
                                            F.lit("/current/bin/x")).alias("path"))
    hosts = rows.select("endpoint_id").distinct()
    names = table(spark, sf, "region").select(F.array_agg(F.struct(
        F.concat(F.lit("s"), F.col("r_regionkey").cast("string")).alias("name"),
        F.col("r_name").alias("title"), F.lit("1").alias("version"),
        F.lit("/snap/meta").alias("meta_path"))).alias("a"))
    snaps = hosts.select("endpoint_id", F.inline(names.scalar()))
    look = rows.select("endpoint_id", "path").distinct().withColumn("candidate", F.col("path"))
    found = G.match_snaps(look, snaps).select("endpoint_id", "path", "recognized_name")
    return rows.join(found, ["endpoint_id", "path"]).select("event_id", "recognized_name")


@query("recognized_software", view_sql(["exec_events", "artifacts"], f"""
SELECT e.investigation_id, r.recognized_name AS name, r.confidence, count(*) AS occurrences FROM exec_events e
JOIN recog r ON r.endpoint_id = e.endpoint_id AND r.path = {_FOLD.format('e.executable')} WHERE r.recognized GROUP BY ALL""", extra=_RECOGNIZED))
def _(spark, sf):
    return G.recognized_software(G.attach_recognition(events(spark, sf), recognized(spark, sf)))


# --- narrative ------------------------------------------------------------------------------
def narrative_inputs(spark, sf):
    evs, arts = events(spark, sf), evidence(spark, sf, "artifacts")
    ranks, status = ranked(spark, sf), sources(evs)
    found, limits, _ = C.correlate(evs, arts, status)
    top = A.leads(ranks)
    counts = N.record_counts(ranks, arts, found, limits, top)
    return ranks, status, found, limits, top, counts


_COUNTS = ("counts", """
SELECT g.*, a.artifacts, f.findings, 1 AS collection_limitations FROM (
  SELECT investigation_id, count(*) AS distinct_activity,
    sum(occurrences) FILTER (execution_confirmed) AS confirmed,
    coalesce(sum(occurrences) FILTER (priority = 'PRIORITY_1'), 0) AS p1,
    coalesce(sum(occurrences) FILTER (priority = 'PRIORITY_2'), 0) AS p2,
    coalesce(sum(occurrences) FILTER (priority = 'PRIORITY_3'), 0) AS p3,
    sum(occurrences) FILTER (evidence_kind = 'COMMAND_HISTORY') AS typed,
    count(DISTINCT CASE WHEN priority IN ('PRIORITY_1', 'PRIORITY_2') THEN evidence_kind || priority || array_to_string(list_sort(list_filter(
      string_split(signals, ','), lambda x: x IN ('remote_content_to_interpreter', 'download_to_writable_location', 'encoded_powershell',
      'execution_from_writable_location', 'image_absent_after_execution', 'installer_shaped_source'))), ',') END) AS leads FROM groups GROUP BY ALL) g
JOIN (SELECT investigation_id, count(*) AS artifacts FROM artifacts GROUP BY ALL) a USING (investigation_id)
JOIN (SELECT investigation_id, count(*) AS findings FROM found GROUP BY ALL) f USING (investigation_id)""")


@query("record_counts", scored_sql("groups", """
SELECT investigation_id, distinct_activity, confirmed AS execution_confirmed_records, p1 AS priority_1, p2 AS priority_2, p3 AS priority_3,
  typed AS command_history_records, artifacts, findings, collection_limitations FROM counts""",
                                   extra=(*_CORRELATED[1:], _COUNTS)))
def _(spark, sf):
    return narrative_inputs(spark, sf)[-1].select(
        "investigation_id", "distinct_activity", "execution_confirmed_records", "priority_1",
        "priority_2", "priority_3", "command_history_records", "artifacts", "findings",
        "collection_limitations")


@query("conclusion", scored_sql("ranked", """
SELECT investigation_id, CASE WHEN p1 > 0 THEN CAST(p1 AS VARCHAR) || ' records are ranked investigate-first.' ELSE 'Nothing combined enough signals to rank investigate-first.' END
  || CASE WHEN p2 > 0 THEN ' ' || CAST(p2 AS VARCHAR) || ' records across ' || CAST(leads AS VARCHAR) || ' distinct pattern' || CASE WHEN leads = 1 THEN '' ELSE 's' END || ' warrant review.' ELSE '' END
  || ' The remaining ' || CAST(p3 AS VARCHAR) || ' records are informational.'
  || ' process accounting (NOT_ENABLED) could not be read.' AS conclusion FROM counts""", extra=(*_CORRELATED[1:], _COUNTS)))
def _(spark, sf):
    _, status, _, _, _, counts = narrative_inputs(spark, sf)
    return N.conclusion(counts, status)


@query("summary_text", scored_sql("ranked", """
, more AS (SELECT investigation_id, sum(CASE WHEN evidence_kind = 'EXECUTION_EVIDENCE' THEN occurrences ELSE 0 END) AS ran,
  sum(CASE WHEN evidence_kind = 'SESSION_EVENT' THEN occurrences ELSE 0 END) AS opened,
  sum(CASE WHEN category = 'POTENTIALLY_HARMFUL' THEN occurrences ELSE 0 END) AS harmful,
  sum(CASE WHEN category = 'NEEDS_REVIEW' THEN occurrences ELSE 0 END) AS review,
  sum(CASE WHEN category NOT IN ('POTENTIALLY_HARMFUL', 'NEEDS_REVIEW') THEN occurrences ELSE 0 END) AS calm FROM groups GROUP BY ALL),
names AS (SELECT string_agg(name, ', ' ORDER BY name) AS names FROM (SELECT DISTINCT source AS name FROM exec_events))
SELECT investigation_id, 'Collected from ' || names || '. ' || CAST(ran AS BIGINT) || ' execution-source, ' || CAST(coalesce(typed, 0) AS BIGINT)
  || ' command-history and ' || CAST(opened AS BIGINT) || ' session records cover ' || distinct_activity || ' distinct activities. '
  || CAST(coalesce(confirmed, 0) AS BIGINT) || ' records establish execution. ' || CAST(p1 AS BIGINT) || ' investigate first, ' || CAST(p2 AS BIGINT)
  || ' merit review, ' || CAST(p3 AS BIGINT) || ' are informational. ' || CAST(harmful AS BIGINT) || ' carry a concern signal, '
  || CAST(review AS BIGINT) || ' are uncertain, ' || CAST(calm AS BIGINT) || ' show nothing of concern. ' || findings || ' findings over '
  || artifacts || ' artifacts; ' || collection_limitations || ' collection limitations.' AS summary
FROM counts JOIN more USING (investigation_id) CROSS JOIN names""", extra=(*_CORRELATED[1:], _COUNTS)))
def _(spark, sf):
    _, status, _, _, _, counts = narrative_inputs(spark, sf)
    return N.summary_text(counts, status)


@query("case_summary")
def _(spark, sf):
    ranks, status, found, limits, top, counts = narrative_inputs(spark, sf)
    refs = A.lead_references(ranks, A.activity_records(assign_event_references(events(spark, sf))))
    ids = refs.join(top.select("investigation_id", "evidence_kind", "priority", "pattern",
                               "lead_id"), ["investigation_id", "evidence_kind", "priority",
                                            "pattern"]).select(
        "investigation_id", "priority", "lead_id", F.col("reference").alias("id"))
    return N.case_summary(counts, status, top, ids, found, limits).withColumn(
        "evidence_ids", joined("evidence_ids"))


@query("lead_references", scored_sql("ranked", """
, m AS (SELECT *, array_to_string(list_sort(list_filter(string_split(signals, ','), lambda x: x IN (
    'remote_content_to_interpreter', 'download_to_writable_location', 'encoded_powershell',
    'execution_from_writable_location', 'image_absent_after_execution', 'installer_shaped_source'))), ',') AS pattern
  FROM ranked WHERE priority IN ('PRIORITY_1', 'PRIORITY_2'))
SELECT investigation_id, evidence_kind, priority, pattern, sum(occurrences) AS cited FROM m GROUP BY ALL"""))
def _(spark, sf):
    rows = assign_event_references(events(spark, sf))
    refs = A.lead_references(ranked(spark, sf), A.activity_records(rows))
    return refs.groupBy("investigation_id", "evidence_kind", "priority",
                        joined("pattern").alias("pattern")).agg(F.count("*").alias("cited"))


@query("report_limitations", view_sql(["exec_events", "artifacts"], """
SELECT e.investigation_id, 7 + 1 + 1 + 1 + 1 AS statements, u || ' records carry no time.' AS undated FROM (
  SELECT investigation_id, CAST(count(*) FILTER (ts IS NULL) AS VARCHAR) AS u FROM exec_events GROUP BY ALL) e"""))
def _(spark, sf):
    arts = evidence(spark, sf, "artifacts").groupBy("investigation_id").agg(
        F.count_if(F.col("collection_status") == "MISSING").alias("missing_artifacts"))
    facts = events(spark, sf).groupBy("investigation_id").agg(
        F.count_if(F.col("ts").isNull()).alias("undated")).join(arts, "investigation_id").select(
        "*", F.lit(5).alias("available"), F.lit(False).alias("execution_truncated"),
        F.lit(False).alias("processes_truncated"), F.lit(False).alias("command_lines_collected"))
    rows = N.report_limitations(facts)
    return rows.groupBy("investigation_id").agg(
        F.count("*").cast("int").alias("statements"), F.max(F.when(
            F.col("statement").endswith("carry no time."), F.col("statement"))).alias("undated"))


def brief_tables(spark, sf):
    return {"groups": ranked(spark, sf), "records": A.activity_records(events(spark, sf)),
            "artifacts": evidence(spark, sf, "artifacts"),
            "downloads": evidence(spark, sf, "downloads")}


@query("briefs_activity", scored_sql("groups", """
SELECT investigation_id, coalesce(full_command_line, executable, process_name) AS label, category, priority,
  CASE WHEN execution_confirmed THEN 'CONFIRMED' ELSE 'NOT ESTABLISHED' END AS execution_state,
  CASE WHEN execution_confirmed THEN sources ELSE '' END AS execution_sources, least(occurrences, 12) AS cited FROM groups"""))
def _(spark, sf):
    return N.briefs(brief_tables(spark, sf), "activity").select(
        "investigation_id", "label", "category", "priority", "execution_state",
        joined("execution_sources").alias("execution_sources"),
        F.size("evidence_ids").cast("bigint").alias("cited"))


@query("briefs_execution_event", scored_sql("groups", """
SELECT s.event_id AS subject_id, g.category, g.priority FROM scored s JOIN groups g
ON s.investigation_id = g.investigation_id AND s.endpoint_id = g.endpoint_id AND s.akey = g.akey"""))
def _(spark, sf):
    return N.briefs(brief_tables(spark, sf), "execution_event").select(
        "subject_id", "category", "priority")


@query("briefs_artifact", view_sql(["exec_events", "artifacts", "downloads"], f"""
, m AS (SELECT investigation_id, endpoint_id, path, count(*) AS naming FROM (SELECT investigation_id, endpoint_id, unnest(list_filter(string_split_regex(concat_ws(' ', executable, full_command_line), '\\s+'),
    lambda x: starts_with(x, '/') AND length(x) > 1)) AS path FROM exec_events) GROUP BY ALL),
u AS (SELECT * FROM (SELECT *, {npath('path')} AS np, row_number() OVER (PARTITION BY investigation_id, endpoint_id, {npath('path')} ORDER BY collection_order) AS rn FROM artifacts) WHERE rn = 1),
d AS (SELECT DISTINCT investigation_id, endpoint_id, target_path FROM downloads)
SELECT u.endpoint_id || ' ' || u.path AS subject, CAST(coalesce(naming, 0) AS VARCHAR) AS naming,
  1 + CASE WHEN naming IS NULL THEN 1 ELSE 0 END + CASE WHEN d.target_path IS NULL THEN 1 ELSE 0 END AS unknown
FROM u LEFT JOIN m ON m.investigation_id = u.investigation_id AND m.endpoint_id = u.endpoint_id AND m.path = u.path LEFT JOIN d ON d.investigation_id = u.investigation_id AND d.endpoint_id = u.endpoint_id AND d.target_path = u.path"""))
def _(spark, sf):
    tables = brief_tables(spark, sf)
    marked = tables["artifacts"].withColumn("reference", F.concat_ws(" ", "endpoint_id", "path"))
    tables["artifacts"] = marked
    return N.briefs(tables, "artifact").select(
        F.col("subject_id").alias("subject"),
        F.regexp_extract("summary", r"; ([0-9]+) record", 1).alias("naming"),
        F.size("unknown").alias("unknown"))


@query("briefs_finding", view_sql(["exec_events", "artifacts"], """
SELECT category, priority, count(*) AS n FROM (SELECT triage AS category, priority FROM found) GROUP BY ALL""", extra=_CORRELATED))
def _(spark, sf):
    found, _, _ = C.correlate(events(spark, sf), evidence(spark, sf, "artifacts"))
    return N.briefs({"findings": found}, "finding").groupBy("category", "priority").agg(
        F.count("*").alias("n"))


@query("briefs_thread", _thread_sql(f"""
, why AS (SELECT r.root AS component, min(e.reason) AS reason FROM edges e
  JOIN (SELECT investigation_id || endpoint_id || akey AS gid, root FROM roots) r ON r.gid = e.a GROUP BY ALL),
ran AS (SELECT p.root, p.piece, string_agg(DISTINCT s.source, ',' ORDER BY s.source) AS sources FROM placed p
  JOIN scored s ON s.investigation_id = p.investigation_id AND s.endpoint_id = p.endpoint_id AND s.akey = p.akey
  WHERE s.execution_confirmed GROUP BY p.root, p.piece),
component AS (SELECT DISTINCT root, component FROM placed)
SELECT d.investigation_id, 'THREAD-' || lpad(CAST(thread_number AS VARCHAR), 3, '0') AS subject_id, {_TITLE_CASE} AS label,
  CASE category_rank WHEN 0 THEN 'POTENTIALLY_HARMFUL' WHEN 1 THEN 'NEEDS_REVIEW' ELSE 'NOT_HARMFUL_ON_AVAILABLE_EVIDENCE' END AS category,
  priority, CASE WHEN ran.sources IS NULL THEN 'NOT ESTABLISHED' ELSE 'CONFIRMED' END AS execution_state,
  coalesce(ran.sources, '') AS execution_sources,
  {_TITLE_CASE} || '. ' || reason || '. ' || activity_count || ' activities, ' || CAST(record_count AS BIGINT) || ' record(s).' AS summary
FROM described d JOIN component c ON c.root = d.root JOIN why ON why.component = c.component
LEFT JOIN ran ON ran.root = d.root AND ran.piece = d.piece"""))
def _(spark, sf):
    tables = brief_tables(spark, sf)
    tables["threads"], tables["thread_members"] = H.threads(tables["groups"], tables["records"],
                                                            max_df=V.TOKEN_MAX_DF)
    return N.briefs(tables, "thread").select(
        "investigation_id", "subject_id", "label", "category", "priority", "execution_state",
        joined("execution_sources").alias("execution_sources"), "summary")


@query("briefs_lead", scored_sql("ranked", """
, m AS (SELECT *, array_to_string(list_sort(list_filter(string_split(signals, ','), lambda x: x IN (
    'remote_content_to_interpreter', 'download_to_writable_location', 'encoded_powershell',
    'execution_from_writable_location', 'image_absent_after_execution', 'installer_shaped_source'))), ',') AS pattern
  FROM ranked WHERE priority IN ('PRIORITY_1', 'PRIORITY_2')),
l AS (SELECT investigation_id, evidence_kind, priority, pattern, count(*) AS activities, sum(occurrences) AS records,
  bool_or(execution_confirmed) AS ran, min(activity_rank) AS r FROM m GROUP BY ALL)
SELECT investigation_id, 'LEAD-' || lpad(CAST(n AS VARCHAR), 3, '0') AS subject_id, priority,
  CASE WHEN ran THEN 'CONFIRMED' ELSE 'NOT ESTABLISHED' END AS execution_state, least(activities, 12) AS cited FROM (
  SELECT *, row_number() OVER (PARTITION BY investigation_id ORDER BY priority, records DESC, r) AS n FROM l)"""))
def _(spark, sf):
    tables = brief_tables(spark, sf)
    tables["leads"] = A.leads(tables["groups"])
    tables["lead_members"] = A.lead_members(tables["groups"])
    return N.briefs(tables, "lead").select(
        "investigation_id", "subject_id", "priority", "execution_state",
        F.size("evidence_ids").cast("bigint").alias("cited"))


@query("suggested_review", view_sql(["artifacts"], """
SELECT collection_order, 1 + CASE WHEN size_bytes > 300 THEN 1 ELSE 0 END + CASE WHEN size_bytes > 900 THEN 1 ELSE 0 END AS steps FROM artifacts"""))
def _(spark, sf):
    return evidence(spark, sf, "artifacts").select("collection_order", F.size(X.suggested_review(
        F.lit(False), F.lit(None).cast("string"), (F.col("size_bytes") > 300).cast("int"),
        (F.col("size_bytes") > 900).cast("int"))).alias("steps"))
