"""Scalar functions over whole tables."""

from ... import vocab as V
from ..oracle import npath, tokens_from, view_sql
from ..registry import query
from .common import F, X, evidence, joined, table

_BASE = f"regexp_extract({npath('p')}, '[^/]*$', 0)"
_DIR = (f"CASE WHEN NOT contains({npath('p')}, '/') THEN '' ELSE "
        f"coalesce(nullif(regexp_replace({npath('p')}, '/[^/]*$', ''), ''), '/') END")


def paths(spark, sf):
    return evidence(spark, sf, "paths")


@query("normalize_path", view_sql(["paths"], f"SELECT p, {npath('p')} AS npath FROM paths"))
def _(spark, sf):
    return paths(spark, sf).select("p", X.normalize_path("p").alias("npath"))


@query("is_absolute", view_sql(["paths"], r"""
SELECT p, coalesce(starts_with(p, '/') OR starts_with(p, chr(92) || chr(92))
  OR regexp_matches(p, '^[A-Za-z]:[\\/]'), false) AS is_absolute FROM paths"""))
def _(spark, sf):
    return paths(spark, sf).select("p", X.is_absolute("p").alias("is_absolute"))


@query("path_parts", view_sql(["paths"], f"""
SELECT p, {_BASE} AS base, {_DIR} AS dir,
  p IS NOT NULL AND {npath('p')} = {npath("replace(p, '/', chr(92))")} AS same FROM paths"""))
def _(spark, sf):
    return paths(spark, sf).select(
        "p", X.path_basename("p").alias("base"), X.path_dirname("p").alias("dir"),
        X.same_path("p", F.translate("p", "/", "\\")).alias("same"))


_LOW = "lower(p)"
_FWD = "lower(replace(p, chr(92), '/'))"


def _longest(fragments):
    shown = sorted(fragments, key=lambda f: -len(f[0]))
    return "CASE " + " ".join(f"WHEN contains({_FWD}, '{n}') THEN '{t}'" for n, t in shown) + " END"


_TRANSIENT = _longest([(t.replace("\\", "/"), t.replace("\\", "/").strip("/"))
                       for t in V.TRANSIENT_DIRECTORIES])
_NOTABLE = _longest([(t.replace("\\", "/"), t.strip("\\/")) for t in V.NOTABLE_LOCATIONS])
_SYSTEM = " OR ".join([f"starts_with({_FWD}, '{p}')" for p in V.SYSTEM_DIRECTORIES]
                      + [f"starts_with({_LOW}, '{p}')" for p in V.WINDOWS_SYSTEM_DIRECTORIES])


@query("locations", view_sql(["paths"], f"""
SELECT p, coalesce({_SYSTEM}, false) AS in_system, {_TRANSIENT} AS transient_at, {_NOTABLE} AS notable
FROM paths"""))
def _(spark, sf):
    return paths(spark, sf).select(
        "p", X.in_system_location("p").alias("in_system"),
        X.transient_location("p").alias("transient_at"), X.notable_location("p").alias("notable"))


_NAMES = ", ".join(f"'{n}'" for n in V.INTERPRETERS)


@query("interpreters", view_sql(["exec_events"], rf"""
SELECT process_name, executable,
  coalesce(regexp_matches(process_name, '(?i)(^|/|\\)(python[\d.]*|perl|ruby|node|deno|php|bash|sh|zsh|dash|powershell(\.exe)?|pwsh(\.exe)?|cscript\.exe|wscript\.exe|mshta\.exe)$'), false)
  OR coalesce(regexp_matches(executable, '(?i)(^|/|\\)(python[\d.]*|perl|ruby|node|deno|php|bash|sh|zsh|dash|powershell(\.exe)?|pwsh(\.exe)?|cscript\.exe|wscript\.exe|mshta\.exe)$'), false) AS is_interpreter,
  CASE WHEN lower(process_name) IN ({_NAMES}) THEN process_name
       WHEN lower(regexp_extract(executable, '[^/\\]*$', 0)) IN ({_NAMES})
       THEN regexp_extract(executable, '[^/\\]*$', 0) END AS interpreter, count(*) AS n
FROM exec_events GROUP BY ALL"""))
def _(spark, sf):
    return evidence(spark, sf, "exec_events").groupBy(
        "process_name", "executable",
        X.is_interpreter("executable", "process_name").alias("is_interpreter"),
        X.interpreter_for("process_name", "executable").alias("interpreter")).agg(
            F.count("*").alias("n"))


_ENV = (r"(?i)(^|[^\p{L}\p{N}_])([A-Z0-9_]*(?:PASSWORD|PASSWD|TOKEN|SECRET|APIKEY|API_KEY|CREDENTIAL)"
        r"[A-Z0-9_]*)(=)(" + V.NWS + "+)")
_MASK = (f"regexp_replace(regexp_replace(text, '{V.SECRET_ARGUMENT}', '\\1\\2[redacted]', 'g'), "
         f"'{_ENV}', '\\1\\2\\3[redacted]', 'g')")
_TEXTS = ("texts", """SELECT id, text FROM messages UNION ALL
SELECT event_id, full_command_line FROM exec_events WHERE full_command_line IS NOT NULL""")


def texts(spark, sf):
    commands = evidence(spark, sf, "exec_events").filter("full_command_line IS NOT NULL").select(
        F.col("event_id").alias("id"), F.col("full_command_line").alias("text"))
    return evidence(spark, sf, "messages").unionByName(commands)


@query("redact_command_line", view_sql(["messages", "exec_events"], f"""
SELECT id, md5({_MASK}) AS masked, {_MASK} <> text AS was_redacted FROM texts""", extra=(_TEXTS,)))
def _(spark, sf):
    return texts(spark, sf).withColumn("m", X.redact_command_line("text")).select(
        "id", F.md5("m.text").alias("masked"), F.col("m.was_redacted").alias("was_redacted"))


_W = r"[\p{L}\p{N}_]"
_NW = r"[^\p{L}\p{N}_]"
_S = r"[\p{L}\p{N}_.@+-]+"
_URLS = rf"regexp_replace(text, '(?i)(^|{_NW})[a-z][a-z0-9+.-]*://{V.NWS}+', '\1URL', 'g')"
_PATHS = rf"regexp_replace({_URLS}, '(^|[^\p{{L}}\p{{N}}_.-])(?:/{_S})+/({_S})/?', '\1\2', 'g')"
_OUT = rf"regexp_replace({_PATHS}, '\p{{Nd}}?>>?&?\p{{Nd}}?', ' redirect ', 'g')"
_IN = rf"regexp_replace({_OUT}, '(^|{_NW})<($|{_NW})', '\1 redirect \2', 'g')"
_IN = rf"regexp_replace({_IN}, '(^|{_NW})<($|{_NW})', '\1 redirect \2', 'g')"
_NORMAL = (rf"nullif(trim(regexp_replace(translate({_IN}, '\"''', '  '), '{V.WS}+', ' ', 'g')), '')")


@query("normalize_for_search", view_sql(["messages", "exec_events"], f"""
SELECT id, md5({_NORMAL}) AS reduced, length({_NORMAL}) AS n FROM texts""", extra=(_TEXTS,)))
def _(spark, sf):
    return texts(spark, sf).withColumn("r", X.normalize_for_search("text")).select(
        "id", F.md5("r").alias("reduced"), F.length("r").alias("n"))


@query("describe_command", view_sql(["exec_events"], """
SELECT event_id, full_command_line,
  CASE WHEN coalesce(full_command_line, executable, process_name) IS NOT NULL THEN source END AS command_source,
  CASE WHEN full_command_line IS NOT NULL THEN 'EXACT' WHEN coalesce(executable, process_name) IS NOT NULL
       THEN 'EXECUTABLE_ONLY' ELSE 'NOT_AVAILABLE' END AS status,
  CASE WHEN full_command_line IS NOT NULL THEN 'STRONG' WHEN coalesce(executable, process_name) IS NOT NULL THEN 'WEAK' END AS strength,
  CASE WHEN full_command_line IS NULL THEN source || ' names the program but not its arguments' END AS reason
FROM exec_events"""))
def _(spark, sf):
    rows = evidence(spark, sf, "exec_events").withColumn("c", X.describe_command(
        "full_command_line", "executable", "process_name", "source"))
    return rows.select(
        "event_id", "c.full_command_line", "c.command_source",
        F.col("c.command_reconstruction_status").alias("status"),
        F.col("c.command_evidence_strength").alias("strength"),
        X.command_unavailable_reason(F.col("c.command_reconstruction_status"), "source").alias(
            "reason"))


_EXT = ", ".join(f"'{e}'" for e in V.NOTABLE_EXTENSIONS)
_SPOOF = ", ".join(f"'{e}'" for e in V.SPOOFED_EXTENSIONS)


@query("filename_indicators", view_sql(["paths"], f"""
, f AS (SELECT DISTINCT lower({_BASE}) AS name FROM paths WHERE p IS NOT NULL),
e AS (SELECT name, string_split(name, '.') AS parts FROM f)
SELECT name, concat_ws(',', CASE WHEN len(parts) >= 2 AND '.' || parts[-1] IN ({_EXT}) THEN 'info' END,
  CASE WHEN len(parts) >= 3 AND '.' || parts[-1] IN ({_EXT}) AND '.' || parts[-2] IN ({_SPOOF}) THEN 'warning' END,
  CASE WHEN starts_with(name, '.') AND length(name) > 1 THEN 'info' END) AS levels FROM e"""))
def _(spark, sf):
    return paths(spark, sf).filter("p IS NOT NULL").select(
        F.lower(X.path_basename("p")).alias("name")).distinct().select(
        "name", joined(F.transform(X.filename_indicators("name"), lambda i: i["level"])).alias(
            "levels"))


@query("epoch_times", view_sql(["base"], """
SELECT event_id, seen_at AS filetime, seen_at AS chrome, seen_at AS firefox,
  CAST(event_id % 3 = 0 AS INT) AS unset FROM base"""))
def _(spark, sf):
    rows = evidence(spark, sf, "base").withColumn("us", F.unix_micros("seen_at"))
    offset = F.lit(11644473600000000)
    unset = F.col("event_id") % 3 == 0
    return rows.select(
        "event_id", X.filetime_to_ts((F.col("us") + offset) * 10).alias("filetime"),
        X.chrome_time_to_ts(F.col("us") + offset).alias("chrome"),
        X.firefox_time_to_ts("us").alias("firefox"),
        X.filetime_to_ts(F.when(unset, 0).otherwise(1)).isNull().cast("int").alias("unset"))


@query("rot13", view_sql(["messages"], """
SELECT id, md5(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz',
  'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm')) AS turned, true AS back FROM messages"""))
def _(spark, sf):
    turned = X.rot13("text")
    return evidence(spark, sf, "messages").select(
        "id", F.md5(turned).alias("turned"), (X.rot13(turned) == F.col("text")).alias("back"))


@query("parse_numbers", view_sql(["base"], """
SELECT event_id, event_id * 7 + v AS from_hex, v AS from_text, CAST(NULL AS BIGINT) AS from_word,
  'corp' || chr(92) || 'u' || CAST(u AS VARCHAR) AS account, 'u' || CAST(u AS VARCHAR) AS bare,
  sha256(CAST(v AS VARCHAR)) AS sha256 FROM base"""))
def _(spark, sf):
    rows = evidence(spark, sf, "base")
    who = F.concat(F.lit("u"), F.col("u").cast("string"))
    digest = F.sha2(F.col("v").cast("string"), 256)
    return rows.select(
        "event_id",
        X.parse_int_any_base(F.concat(F.lit("0x"), F.hex(F.col("event_id") * 7 + F.col("v")))).alias(
            "from_hex"),
        X.parse_int_any_base(F.col("v").cast("string")).alias("from_text"),
        X.parse_int_any_base(F.col("event_type")).alias("from_word"),
        X.account_name(F.lit("corp"), who).alias("account"),
        X.account_name(F.lit(None).cast("string"), who).alias("bare"),
        X.extract_sha256(F.concat(F.lit("MD5=00,SHA256="), F.upper(digest))).alias("sha256"))


@query("download_keys", view_sql(["downloads"], """
SELECT page_id, regexp_extract(url, '//([^/]*)', 1) AS origin,
  regexp_extract(target_path, '[^/]*$', 0) || ' from ' || regexp_extract(url, '//([^/]*)', 1) AS key
FROM downloads"""))
def _(spark, sf):
    return evidence(spark, sf, "downloads").select(
        "page_id", X.url_origin("url").alias("origin"),
        X.download_key("target_path", "url").alias("key"))


@query("hex_le_to_ipv4", """
SELECT l_orderkey, l_linenumber, l_partkey, concat_ws('.', CAST(l_partkey % 256 AS VARCHAR), CAST(l_suppkey % 256 AS VARCHAR),
  CAST(l_orderkey % 256 AS VARCHAR), CAST(l_linenumber AS VARCHAR)) AS address FROM lineitem""")
def _(spark, sf):
    two = lambda c: F.lpad(F.hex(F.col(c).cast("bigint") % 256), 2, "0")
    text = F.concat(two("l_linenumber"), two("l_orderkey"), two("l_suppkey"), two("l_partkey"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", X.hex_le_to_ipv4(text).alias("address"))


@query("paths_named_by_event", view_sql(["exec_events"], """
SELECT event_id, len(w) AS n, array_to_string(w, ' ') AS words FROM (
  SELECT event_id, list_filter(string_split_regex(concat_ws(' ', executable, full_command_line), '\\s+'),
    lambda x: starts_with(x, '/') AND length(x) > 1) AS w FROM exec_events)"""))
def _(spark, sf):
    none = F.lit(None).cast("string")
    return evidence(spark, sf, "exec_events").withColumn("w", X.paths_named_by_event(
        "executable", "full_command_line", none)).select(
        "event_id", F.size("w").alias("n"), joined("w", " ").alias("words"))


@query("distinctive_tokens", view_sql(["exec_events", "messages"], f"""
, src AS (SELECT event_id AS id, coalesce(full_command_line, '') AS cmd, coalesce(executable, process_name, '') AS image FROM exec_events
  UNION ALL SELECT id, text, '' FROM messages)
SELECT id, len(tokens) AS n, md5(array_to_string(tokens, ' ')) AS digest FROM ({tokens_from('src')})"""))
def _(spark, sf):
    none = F.lit(None).cast("string")
    rows = evidence(spark, sf, "exec_events").select(
        F.col("event_id").alias("id"), "full_command_line", "executable", "process_name")
    more = evidence(spark, sf, "messages").select(
        "id", F.col("text").alias("full_command_line"), none.alias("executable"),
        none.alias("process_name"))
    return rows.unionByName(more).withColumn("t", F.array_sort(X.distinctive_tokens(
        "full_command_line", "executable", "process_name"))).select(
            "id", F.size("t").alias("n"), F.md5(joined("t", " ")).alias("digest"))


@query("history_line", view_sql(["exec_events"], """
SELECT event_id, CASE WHEN source_record_id LIKE '%:%' THEN CAST(regexp_extract(source_record_id, ':([0-9]+)$', 1) AS BIGINT) END AS line,
  regexp_replace(source_record_id, ':[0-9]+$', '') AS file FROM exec_events"""))
def _(spark, sf):
    return evidence(spark, sf, "exec_events").select(
        "event_id", X.history_line("source_record_id").alias("line"),
        X.history_file("source_record_id").alias("file"))


@query("gap_hours", """
SELECT o_orderkey, round((epoch_us(TIMESTAMP '1998-01-01 12:30:00') - epoch_us(o_orderdate)) / 3600000000.0, 6) AS gap FROM orders""")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.round(X.gap_hours(
        F.col("o_orderdate").cast("timestamp"), F.lit("1998-01-01 12:30:00").cast("timestamp")),
        6).alias("gap"))


@query("validate_digest", view_sql(["ledger"], """
SELECT algorithm, count(*) AS n, count(*) FILTER (length(hash) = CASE algorithm WHEN 'SHA256' THEN 64 ELSE 40 END
  AND size_bytes >= 0) AS valid, 0 AS zoneless FROM ledger GROUP BY ALL"""))
def _(spark, sf):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return evidence(spark, sf, "ledger").groupBy("algorithm").agg(
        F.count("*").alias("n"),
        F.count_if(X.validate_digest("algorithm", "hash", "size_bytes",
                                     F.concat(stamp, F.lit("+00:00")))).alias("valid"),
        F.count_if(X.validate_digest("algorithm", "hash", "size_bytes", stamp)).alias("zoneless"))


@query("content_digests", view_sql(["contents"], """
SELECT doc_id, sha256(content) AS sha256, md5(content) AS md5, sha1(content) AS sha1,
  CASE WHEN hex(content) LIKE '455646090D0AFF00%' THEN 'ewf' WHEN starts_with(hex(content), '414646') THEN 'aff' ELSE 'raw' END AS container
FROM contents"""))
def _(spark, sf):
    return evidence(spark, sf, "contents").select(
        "doc_id", X.content_digest("content").alias("sha256"),
        X.content_digest("content", "MD5").alias("md5"),
        X.content_digest("content", "SHA1").alias("sha1"),
        X.container_format("content").alias("container"))


@query("structural_check", view_sql(["contents"], """
SELECT doc_id, CASE WHEN octet_length(content) = 0 THEN 'warning'
  WHEN ext IN ('.jpg', '.jpeg') THEN CASE WHEN regexp_matches(hex(content), 'FFD9(00)*$') THEN 'ok' ELSE 'warning' END
  WHEN ext = '.png' THEN 'ok'
  WHEN ext = '.pdf' THEN CASE WHEN contains(right(text, 2048), '%%EOF') THEN 'ok' ELSE 'warning' END
  ELSE 'unknown' END AS status FROM contents"""))
def _(spark, sf):
    return evidence(spark, sf, "contents").select(
        "doc_id", X.structural_check("content", "ext")["status"].alias("status"))


@query("finding_priority", view_sql(["artifacts"], """
, c AS (SELECT collection_order AS id, CASE collection_order % 3 WHEN 0 THEN 'POTENTIALLY_HARMFUL' WHEN 1 THEN 'NEEDS_REVIEW' ELSE 'NOT_HARMFUL_ON_AVAILABLE_EVIDENCE' END AS triage,
  hash IS NOT NULL AS both_kinds, size_bytes > 500 AS corroborated FROM artifacts)
SELECT id, CASE WHEN triage LIKE 'NOT%' THEN 'PRIORITY_3'
  WHEN triage = 'POTENTIALLY_HARMFUL' THEN CASE WHEN both_kinds AND corroborated THEN 'PRIORITY_1' ELSE 'PRIORITY_2' END
  WHEN corroborated THEN 'PRIORITY_2' ELSE 'PRIORITY_3' END AS priority,
  CASE WHEN both_kinds THEN 'EXECUTION HISTORY' ELSE 'ARTIFACTS' END AS step FROM c"""))
def _(spark, sf):
    order = F.col("collection_order")
    triage = F.when(order % 3 == 0, V.POTENTIALLY_HARMFUL).when(
        order % 3 == 1, V.NEEDS_REVIEW).otherwise(V.NOT_HARMFUL)
    kinds = F.when(F.col("hash").isNotNull(), F.array(F.lit("execution_event"), F.lit(
        "artifact"))).otherwise(F.array(F.lit("artifact")))
    return evidence(spark, sf, "artifacts").select(
        order.alias("id"), X.finding_priority(triage, kinds, F.col("size_bytes") > 500).alias(
            "priority"), X.finding_source_step(kinds).alias("step"))


@query("in_window", view_sql(["exec_events"], """
SELECT event_id FROM exec_events WHERE ts BETWEEN (SELECT max(ts) FROM events) - INTERVAL 168 HOUR AND (SELECT max(ts) FROM events)"""))
def _(spark, sf):
    end = evidence(spark, sf, "base").agg(F.max("seen_at").cast("timestamp").alias("end")).first()["end"]
    return evidence(spark, sf, "exec_events").filter(X.in_window("ts", X.resolve_window(end=end))).select("event_id")


@query("task_states", view_sql(["base"], """
, t AS (SELECT event_id, 1 + k % 4 AS attempts, v % 3 = 0 AS ok FROM base)
SELECT event_id, CASE WHEN ok THEN 'succeeded' WHEN attempts >= 3 THEN 'abandoned' ELSE 'queued' END AS status,
  CASE WHEN NOT ok AND attempts < 3 THEN CASE attempts WHEN 1 THEN 30 WHEN 2 THEN 120 ELSE 600 END END AS delay FROM t"""))
def _(spark, sf):
    ok = F.col("v") % 3 == 0
    state = X.next_task_state(ok, F.when(ok, F.lit("{}")), (1 + F.col("k") % 4), F.lit(V.MAX_ATTEMPTS))
    return evidence(spark, sf, "base").withColumn("s", state).select(
        "event_id", "s.status", F.col("s.delay_seconds").alias("delay"))


@query("execution_states", view_sql(["exec_events"], """
SELECT endpoint_id, coalesce(executable, process_name) AS image,
  CASE WHEN bool_or(execution_confirmed) THEN 'CONFIRMED' ELSE 'NOT ESTABLISHED' END AS state,
  coalesce(string_agg(DISTINCT CASE WHEN execution_confirmed THEN source END, ',' ORDER BY CASE WHEN execution_confirmed THEN source END), '') AS sources
FROM exec_events GROUP BY ALL"""))
def _(spark, sf):
    rows = evidence(spark, sf, "exec_events").groupBy(
        "endpoint_id", F.coalesce("executable", "process_name").alias("image")).agg(
            F.collect_set(F.when(F.col("execution_confirmed"), F.col("source"))).alias("c"),
            F.collect_set("evidence_kind").alias("k"))
    return rows.withColumn("s", X.execution_state("c", "k")).select(
        "endpoint_id", "image", "s.state", joined("s.sources").alias("sources"))


@query("provenance_statement", view_sql(["contents"], """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Read by vol from the image at /img/' || CAST(doc_id AS VARCHAR) || ', SHA-256 ' || sha256(content) || '; the image was not changed.'
  WHEN 1 THEN 'From a recorded or made-up fixture; says nothing about a real machine.'
  ELSE 'No memory evidence; its absence supports no conclusion.' END AS statement FROM contents"""))
def _(spark, sf):
    kind = F.when(F.col("doc_id") % 3 == 0, "REAL").when(F.col("doc_id") % 3 == 1, "FIXTURE").otherwise(
        "UNAVAILABLE")
    return evidence(spark, sf, "contents").select("doc_id", X.provenance_statement(
        kind, F.lit("vol"), F.concat(F.lit("/img/"), F.col("doc_id").cast("string")),
        X.content_digest("content")).alias("statement"))
