"""SQL pieces the oracle queries share. They restate the rules independently in SQL."""

from .. import vocab as V
from .views import with_views


def npath(x: str) -> str:
    text = f"replace({x}, chr(92), '/')"
    folded = f"(substr({text}, 1, 2) || regexp_replace(substr({text}, 3), '/{{2,}}', '/', 'g'))"
    return (f"(CASE WHEN {x} IS NULL OR {x} = '' THEN '' "
            f"WHEN length({folded}) > 1 AND {folded} LIKE '%/' "
            f"THEN coalesce(nullif(rtrim({folded}, '/'), ''), '/') ELSE {folded} END)")


UNIQUE_ARTIFACTS = ("uniq_art", f"""
SELECT * FROM (SELECT *, {npath('path')} AS npath, row_number() OVER (
  PARTITION BY investigation_id, endpoint_id, {npath('path')} ORDER BY collection_order) AS rn FROM artifacts)
WHERE rn = 1""")

IMAGES = ("images", f"""
SELECT investigation_id, endpoint_id, {npath('executable')} AS npath,
       count(DISTINCT source) AS source_count
FROM exec_events WHERE executable <> '' GROUP BY ALL""")

_SYS = " OR ".join(f"starts_with(fwd, '{p}')" for p in (
    "/usr/bin/", "/usr/sbin/", "/usr/lib/", "/usr/libexec/", "/lib/", "/lib64/", "/bin/",
    "/sbin/", "/usr/share/", "c:/windows/", "c:/program files/", "c:/program files (x86)/"))
_WRITABLE = ("/appdata/local/temp/", "/$recycle.bin/", "/users/public/", "/downloads/",
             "/var/tmp/", "/dev/shm/", "/run/shm/", "/temp/", "/tmp/")
_WRITABLE_CASE = "CASE " + " ".join(
    f"WHEN contains(fwd, '{p}') THEN '{p.strip('/')}'" for p in _WRITABLE) + " END"
_ROUTINE = (
    (r"(sudo\s+)?(apt|apt-get|aptitude|dnf|yum|zypper|pacman|snap|flatpak)\b", "package management"),
    (r"(sudo\s+)?(pip3?|pipx|npm|yarn|pnpm|cargo|gem|go)\s+(install|add|update|upgrade|ci|build|test|run)\b",
     "language package management"),
    (r"(sudo\s+)?systemctl\s+(status|is-active|list-units|show|enable|disable|start|stop|restart)\b",
     "service management"),
    (r"(ls|ll|cd|pwd|clear|exit|echo|cat|less|more|head|tail|which|whoami|date|df|du|free|uname|man|"
     r"history|grep|find|ps|top|htop|nano|vim|vi|code)\b", "shell navigation and inspection"),
    (r"git\s+(clone|pull|fetch|status|log|diff|add|commit|push|checkout|branch|remote|init|stash|"
     r"merge|rebase)\b", "version control"),
    (r"(sudo\s+)?(mkdir|cp|mv|rm|touch|chmod|chown|ln|tar|unzip|zip)\b", "routine file management"),
    (r"(sudo\s+)?(docker|podman|kubectl|make|cmake|gradle|mvn|flutter|dart)\b",
     "development tooling"),
)
_ROUTINE_CASE = "CASE " + " ".join(
    rf"WHEN regexp_matches(cmd, '(?i)^\s*{p}') THEN '{d}'" for p, d in _ROUTINE) + " END"
_INTERP = (r"(?i)(^|/|\\)(python[\d.]*|perl|ruby|node|deno|php|bash|sh|zsh|dash|powershell(\.exe)?|"
           r"pwsh(\.exe)?|cscript\.exe|wscript\.exe|mshta\.exe)$")

FACTS = ("facts", f"""
SELECT *, {_WRITABLE_CASE} AS writable, ({_SYS}) AS sys,
  {_ROUTINE_CASE} AS routine,
  regexp_matches(cmd, '(?i)\\b(curl|wget|iwr|invoke-webrequest)\\b[^|]*\\|\\s*(sudo\\s+)?(bash|sh|zsh|dash|python3?|perl|ruby|node|powershell|pwsh)\\b')
    OR regexp_matches(cmd, '(?i)\\b(bash|sh|python3?|node|perl|ruby)\\s+<\\(\\s*(curl|wget)') AS piped,
  regexp_matches(cmd, '(?i)https://[^\\s|''"]*/(install|setup|get)(\\.sh|\\.ps1|)(\\?[^\\s|''"]*)?([\\s|''"]|$)') AS installer,
  regexp_matches(cmd, '(?i)\\b(curl|wget)\\b.*?(-O|-o|--output|>)\\s*["'']?(/tmp/|/var/tmp/|/dev/shm/|\\S*\\\\temp\\\\)') AS fetched,
  regexp_matches(cmd, '(?i)\\b(powershell|pwsh)\\b[^|]*\\s-(e|en|enc|encodedcommand)\\b') AS encoded,
  regexp_matches(process_name, '{_INTERP}') OR regexp_matches(image, '{_INTERP}') AS interp
FROM (
  SELECT e.*, coalesce(full_command_line, '') AS cmd, coalesce(executable, '') AS image,
    lower(replace(coalesce(executable, ''), chr(92), '/')) AS fwd,
    coalesce(i.source_count, 1) AS source_count,
    a.collection_status AS artifact_status, a.hash AS artifact_hash, a.path AS artifact_path
  FROM exec_events e
  LEFT JOIN images i ON i.investigation_id = e.investigation_id
    AND i.endpoint_id = e.endpoint_id AND i.npath = {npath('e.executable')} AND e.executable <> ''
  LEFT JOIN uniq_art a ON a.investigation_id = e.investigation_id AND a.endpoint_id = e.endpoint_id
    AND a.npath = {npath('e.executable')} AND e.executable <> '')""")

RATED = ("rated", """
SELECT *, piped OR fetched OR encoded OR writable IS NOT NULL AS concern,
  CASE WHEN evidence_kind = 'SESSION_EVENT' THEN 0 ELSE
    (CASE WHEN piped THEN 3 ELSE 0 END) + (CASE WHEN fetched THEN 2 ELSE 0 END)
  + (CASE WHEN encoded THEN 3 ELSE 0 END) + (CASE WHEN writable IS NOT NULL THEN 3 ELSE 0 END)
  + (CASE WHEN writable IS NOT NULL AND artifact_status = 'MISSING' THEN 1 ELSE 0 END)
  + (CASE WHEN piped OR fetched OR encoded OR writable IS NOT NULL THEN
      (CASE WHEN execution_confirmed THEN 1 ELSE 0 END)
    + (CASE WHEN source_count > 1 THEN 2 ELSE 0 END)
    + (CASE WHEN artifact_status = 'COLLECTED' AND artifact_hash <> '' THEN 2 ELSE 0 END)
    - (CASE WHEN piped AND installer THEN 1 ELSE 0 END) ELSE 0 END)
  - (CASE WHEN routine IS NOT NULL THEN 3 ELSE 0 END)
  - (CASE WHEN sys AND writable IS NULL THEN (CASE WHEN interp THEN 1 ELSE 3 END) ELSE 0 END)
  - (CASE WHEN systemd_unit <> '' THEN 2 ELSE 0 END)
  - (CASE WHEN evidence_kind = 'COMMAND_HISTORY' THEN 1 ELSE 0 END) END AS score,
  CASE WHEN evidence_kind = 'SESSION_EVENT' THEN '' ELSE concat_ws(',',
    CASE WHEN piped THEN 'remote_content_to_interpreter' END,
    CASE WHEN fetched THEN 'download_to_writable_location' END,
    CASE WHEN encoded THEN 'encoded_powershell' END,
    CASE WHEN writable IS NOT NULL THEN 'execution_from_writable_location' END,
    CASE WHEN writable IS NOT NULL AND artifact_status = 'MISSING' THEN 'image_absent_after_execution' END,
    CASE WHEN (piped OR fetched OR encoded OR writable IS NOT NULL) AND execution_confirmed THEN 'execution_confirmed' END,
    CASE WHEN (piped OR fetched OR encoded OR writable IS NOT NULL) AND source_count > 1 THEN 'corroborated_across_sources' END,
    CASE WHEN (piped OR fetched OR encoded OR writable IS NOT NULL) AND artifact_status = 'COLLECTED' AND artifact_hash <> '' THEN 'artifact_correlated' END,
    CASE WHEN piped AND installer THEN 'installer_shaped_source' END,
    CASE WHEN routine IS NOT NULL THEN 'routine_command' END,
    CASE WHEN sys AND writable IS NULL THEN 'system_location' END,
    CASE WHEN systemd_unit <> '' THEN 'managed_system_service' END,
    CASE WHEN evidence_kind = 'COMMAND_HISTORY' THEN 'command_history_only' END) END AS signals
FROM facts""")

SCORED = ("scored", """
SELECT *, CASE WHEN evidence_kind = 'SESSION_EVENT' THEN 'PRIORITY_3' WHEN score >= 4 THEN 'PRIORITY_1'
               WHEN score >= 1 THEN 'PRIORITY_2' ELSE 'PRIORITY_3' END AS priority,
  CASE category WHEN 'POTENTIALLY_HARMFUL' THEN 0 WHEN 'NEEDS_REVIEW' THEN 1 ELSE 2 END AS category_rank,
  CASE category WHEN 'POTENTIALLY_HARMFUL' THEN 'NEEDS_ATTENTION' WHEN 'NEEDS_REVIEW' THEN 'FOR_REVIEW'
       ELSE 'ROUTINE_RECOGNIZED' END AS presentation,
  evidence_kind || chr(1) || coalesce(full_command_line, chr(1) || 'exe:' || coalesce(executable, process_name)) AS akey
FROM (SELECT *, CASE WHEN evidence_kind = 'SESSION_EVENT' THEN 'NOT_HARMFUL_ON_AVAILABLE_EVIDENCE'
    WHEN concern THEN 'POTENTIALLY_HARMFUL' WHEN routine IS NOT NULL OR (sys AND NOT interp)
    THEN 'NOT_HARMFUL_ON_AVAILABLE_EVIDENCE' ELSE 'NEEDS_REVIEW' END AS category FROM rated)""")

# One row per activity; rn orders the records of an activity, un by urgency.
GROUPS = ("groups", """
SELECT investigation_id, endpoint_id, evidence_kind, akey,
  count(*) AS occurrences, count(*) FILTER (ts IS NULL) AS undated_occurrences,
  min(ts) AS first_seen, max(ts) AS last_seen, bool_or(execution_confirmed) AS execution_confirmed,
  max(full_command_line) AS full_command_line,
  max(CASE WHEN rn = 1 THEN executable END) AS executable,
  max(CASE WHEN rn = 1 THEN process_name END) AS process_name,
  max(CASE WHEN rn = 1 THEN command_reconstruction_status END) AS command_reconstruction_status,
  max(CASE WHEN un = 1 THEN score END) AS score, max(CASE WHEN un = 1 THEN category END) AS category,
  max(CASE WHEN un = 1 THEN category_rank END) AS category_rank,
  max(CASE WHEN un = 1 THEN priority END) AS priority,
  max(CASE WHEN un = 1 THEN presentation END) AS presentation,
  max(CASE WHEN un = 1 THEN signals END) AS signals,
  max(CASE WHEN un = 1 THEN routine END) AS routine,
  string_agg(DISTINCT source, ',' ORDER BY source) AS sources
FROM (SELECT *, row_number() OVER (PARTITION BY investigation_id, endpoint_id, akey
        ORDER BY ts ASC NULLS LAST, source_record_id, event_id) AS rn,
      row_number() OVER (PARTITION BY investigation_id, endpoint_id, akey
        ORDER BY priority, category_rank, ts ASC NULLS LAST, source_record_id, event_id) AS un
      FROM scored)
GROUP BY ALL""")

RANKED = ("ranked", """
SELECT *, coalesce(full_command_line, executable, process_name) AS label,
  row_number() OVER (PARTITION BY investigation_id ORDER BY priority, score DESC, category_rank,
  execution_confirmed DESC, last_seen DESC NULLS LAST, endpoint_id, akey) AS activity_rank
FROM groups""")

_LAYERS = {"scored": 5, "groups": 6, "ranked": 7}
_ALL = (UNIQUE_ARTIFACTS, IMAGES, FACTS, RATED, SCORED, GROUPS, RANKED)


_COMMON = ", ".join(f"'{w}'" for w in V.COMMON_WORDS)
TOKENS_SQL = f"""
list_sort(list_distinct(list_concat(
  list_transform(regexp_extract_all(cmd, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])https?://([^/\\s:|''"]+)', 1), lambda h: lower(h)),
  list_concat(list_filter(whole, lambda t: length(t) >= 4 AND t NOT IN ({_COMMON})),
    list_filter(flatten(list_transform(list_filter(whole, lambda t: length(t) >= 4 AND t NOT IN ({_COMMON})),
      lambda t: string_split_regex(t, '[-_.]'))),
      lambda t: length(t) >= 4 AND t NOT IN ({_COMMON}) AND NOT regexp_matches(t, '^[0-9]+$'))))))"""


def tokens_from(relation):
    """SELECT with a ``tokens`` list from a relation with cmd and image columns."""
    return f"""
SELECT *, {TOKENS_SQL} AS tokens FROM (
  SELECT *, list_transform(flatten(list_transform(list_append(list_filter(string_split_regex(cmd, '\\s+'),
      lambda w: NOT starts_with(w, '-')), regexp_extract(image, '[^/]*$', 0)),
    lambda w: regexp_extract_all(w, '[A-Za-z][A-Za-z0-9_.+-]{{2,}}'))),
    lambda t: regexp_replace(lower(t), '^[._-]+|[._-]+$', '', 'g')) AS whole FROM {relation})"""


INSTALLS_SQL = (r"regexp_matches(cmd, '(?i)\b(install|add|clone|setup\.py|pip3?\s+install|npm\s+i(nstall)?|"
                r"cargo\s+install|go\s+install|gem\s+install|snap\s+install|flatpak\s+install|"
                r"make\s+install)\b')")


def _thread_layers():
    installs = INSTALLS_SQL
    minutes = lambda x, y: f"abs(epoch_us(a.{x}) - epoch_us(b.{y})) <= 1800000000"
    return (
        ("named_groups", """
SELECT *, coalesce(full_command_line, '') AS cmd, coalesce(executable, process_name, '') AS image,
  investigation_id || endpoint_id || akey AS gid FROM ranked WHERE full_command_line IS NOT NULL OR executable IS NOT NULL"""),
        ("tok", f"SELECT investigation_id, gid, cmd, unnest(tokens) AS token FROM ({tokens_from('named_groups')})"),
        ("rare", """
SELECT t.* FROM tok t JOIN (SELECT investigation_id, token FROM tok GROUP BY ALL HAVING count(*) BETWEEN 2 AND 8)
USING (investigation_id, token)"""),
        ("spots", """
SELECT DISTINCT investigation_id || endpoint_id || akey AS gid, endpoint_id || regexp_replace(source_record_id, ':[0-9]+$', '') AS file,
  CAST(regexp_extract(source_record_id, ':([0-9]+)$', 1) AS BIGINT) AS line FROM scored"""),
        ("edges", f"""
SELECT investigation_id, x AS a, y AS b, min(CASE WHEN inst THEN 'one installs or fetches ' || chr(39) || token || chr(39) || ' and another uses it'
  ELSE 'recorded close together and both reference ' || chr(39) || token || chr(39) END) AS reason FROM (
  SELECT p.investigation_id, p.gid AS x, q.gid AS y, p.token AS token,
    ({installs.replace('cmd', 'a.cmd')} AND contains(lower(a.cmd), p.token)) OR ({installs.replace('cmd', 'b.cmd')} AND contains(lower(b.cmd), p.token)) AS inst,
    coalesce({minutes('first_seen', 'first_seen')} OR {minutes('first_seen', 'last_seen')} OR {minutes('last_seen', 'first_seen')} OR {minutes('last_seen', 'last_seen')}, false)
    OR EXISTS (SELECT 1 FROM spots m JOIN spots n ON m.file = n.file AND abs(m.line - n.line) <= 12 WHERE m.gid = p.gid AND n.gid = q.gid) AS near
  FROM rare p JOIN rare q ON p.investigation_id = q.investigation_id AND p.token = q.token AND p.gid < q.gid
  JOIN named_groups a ON a.gid = p.gid JOIN named_groups b ON b.gid = q.gid)
WHERE inst OR near GROUP BY ALL"""),
        ("both_ways", "SELECT investigation_id, a, b FROM edges UNION SELECT investigation_id, b, a FROM edges"),
        ("reach(investigation_id, a, b)", """
SELECT investigation_id, a, a FROM both_ways UNION SELECT r.investigation_id, r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b"""),
        ("roots", """
SELECT n.investigation_id, n.endpoint_id, n.akey, r.root FROM (SELECT a, min(b) AS root FROM reach GROUP BY ALL) r JOIN named_groups n ON n.gid = r.a"""),
        # Threads: members in reading order, in pieces of even size; the least hashed key names the component.
        ("hashed", """
SELECT n.*, r.root AS component, md5(n.investigation_id || chr(2) || n.endpoint_id || chr(2) || n.evidence_kind || chr(2)
  || substr(n.akey, length(n.evidence_kind) + 2)) AS hid
FROM roots r JOIN named_groups n USING (investigation_id, endpoint_id, akey)"""),
        ("placed", f"""
SELECT *, CAST(floor((position - 1) * ceil(size / {V.THREAD_MAX_MEMBERS}.0) / size) AS BIGINT) AS piece FROM (
  SELECT *, min(hid) OVER (PARTITION BY component) AS root, count(*) OVER (PARTITION BY component) AS size,
    row_number() OVER (PARTITION BY component ORDER BY priority, first_seen ASC NULLS LAST, activity_rank) AS position,
    {installs} AS inst, string_split(signals, ',') AS names FROM hashed)"""),
        ("shared", """
SELECT investigation_id, root, piece, string_agg(token, ',' ORDER BY token) AS shared_terms FROM (
  SELECT *, row_number() OVER (PARTITION BY investigation_id, root, piece ORDER BY token) AS n FROM (
    SELECT p.investigation_id, p.root, p.piece, t.token FROM (
      SELECT *, count(*) OVER (PARTITION BY root, piece) AS all_members FROM placed) p JOIN tok t ON t.gid = p.gid
    GROUP BY p.investigation_id, p.root, p.piece, t.token, p.all_members HAVING count(*) = p.all_members))
WHERE n <= 6 GROUP BY investigation_id, root, piece"""),
        ("told_sources", """
SELECT root, piece, string_agg(DISTINCT s, ',' ORDER BY s) AS sources FROM (
  SELECT root, piece, unnest(string_split(sources, ',')) AS s FROM placed) GROUP BY ALL"""),
        ("described", """
SELECT *, row_number() OVER (PARTITION BY investigation_id ORDER BY priority, record_count DESC, root, piece) AS thread_number,
  CASE WHEN all_piped THEN 'remote_installer' WHEN installs AND uses THEN 'install_then_use' WHEN writable THEN 'unusual_execution'
       WHEN session THEN 'session' WHEN service THEN 'system_service' ELSE 'related_activity' END AS shape,
  CASE WHEN confirmed = 0 THEN 'not established' WHEN confirmed = activity_count THEN 'confirmed for all' ELSE 'confirmed for some' END AS execution
FROM (SELECT investigation_id, root, piece, count(*) AS activity_count, sum(occurrences) AS record_count,
    bool_and(list_contains(names, 'remote_content_to_interpreter')) AS all_piped, bool_or(inst) AS installs,
    bool_or(NOT inst AND cmd <> '') AS uses, bool_or(list_contains(names, 'execution_from_writable_location')) AS writable,
    bool_and(evidence_kind = 'SESSION_EVENT') AS session,
    bool_and(evidence_kind = 'EXECUTION_EVIDENCE' AND category = 'NOT_HARMFUL_ON_AVAILABLE_EVIDENCE') AS service,
    min(priority) AS priority, min(category_rank) AS category_rank, count(*) FILTER (execution_confirmed) AS confirmed,
    string_agg(label, ' | ' ORDER BY position) AS commands FROM placed GROUP BY investigation_id, root, piece) body"""),
    )


INDEPENDENT_THREADS = _thread_layers()


def scored_sql(upto: str, select: str, *more_views, extra=()) -> str:
    """Oracle text: the evidence views, the scoring layers up to ``upto``, then a select."""
    views = [v for v in ("exec_events", "artifacts") + more_views]
    text = with_views(*views, dialect="duckdb", extra=(*_ALL[:_LAYERS[upto]], *extra)) + select
    return text.replace("WITH ", "WITH RECURSIVE ", 1) if "reach(" in text else text


def view_sql(views, select: str, extra=()) -> str:
    return with_views(*views, dialect="duckdb", extra=extra) + select
