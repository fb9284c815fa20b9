"""Evidence views over the given tables, as SQL text that Spark and DuckDB both read.

The given tables hold no host evidence, so each view derives one evidence table
from whole tables. A few functions differ between the two dialects; they are
written as ``{name}`` and filled in per dialect.
"""

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import spread, tune

DIALECT = {
    "spark": {"sha256": "sha2({0}, 256)", "micros": "unix_micros(CAST({0} AS TIMESTAMP))",
              "bytes": "CAST({0} AS BINARY)"},
    "duckdb": {"sha256": "sha256({0})", "micros": "epoch_us({0})",
               "bytes": "encode({0})"},
}

# k: the number inside props, 0..99; q and r spread hosts and names.
_BASE = """
SELECT event_id, ts AS seen_at, user_id AS u, event_type,
       CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k,
       CAST(floor(value) AS BIGINT) AS v
FROM events
"""

VIEWS = {
    "base": _BASE,
    # Process starts, typed commands and sessions of sixteen hosts, each of them in several of four cases.
    # Records of one source share ids across cases.
    "exec_raw": """
SELECT 'inv-' || CAST((u + CAST(floor(event_id / 2) AS BIGINT)) % 4 AS STRING) AS investigation_id,
       'host-' || CAST(u % 16 AS STRING) AS endpoint_id,
       CAST(event_id AS STRING) AS event_id,
       CASE WHEN k % 17 = 0 THEN NULL ELSE seen_at END AS ts,
       CASE event_type WHEN 'click' THEN 'bash history' WHEN 'view' THEN 'systemd journal'
            WHEN 'purchase' THEN 'kernel audit log' WHEN 'error' THEN 'Sysmon Event 1'
            ELSE 'login sessions (wtmp)' END AS source,
       CASE event_type WHEN 'click' THEN 'COMMAND_HISTORY' WHEN 'signup' THEN 'SESSION_EVENT'
            ELSE 'EXECUTION_EVIDENCE' END AS evidence_kind,
       event_type IN ('view', 'purchase', 'error') AS execution_confirmed,
       CASE WHEN event_type IN ('click', 'error') THEN
         CASE WHEN k < 10 THEN 'curl -fsSL https://get' || CAST(u % 7 AS STRING) || '.example.com/install.sh | sh'
              WHEN k < 18 THEN 'curl https://x' || CAST(u AS STRING) || '.example/i' || CAST(k AS STRING) || '.sh | bash'
              WHEN k < 26 THEN 'wget -O /tmp/pkg' || CAST(u AS STRING) || '.bin https://files.example.org/pkg' || CAST(k AS STRING)
              WHEN k < 34 THEN 'powershell -enc SQBFAFgA' || CAST(u AS STRING)
              WHEN k < 46 THEN 'sudo apt update'
              WHEN k < 56 THEN 'pip install tool' || CAST(u AS STRING) || '-cli'
              WHEN k < 66 THEN 'tool' || CAST(u AS STRING) || '-cli --target host' || CAST(k AS STRING) || ' --token s3cr3t' || CAST(u AS STRING)
              WHEN k < 76 THEN 'python3 /home/u' || CAST(u AS STRING) || '/run' || CAST(k AS STRING) || '.py > /tmp/out' || CAST(u AS STRING)
              WHEN k < 86 THEN 'export API_TOKEN=' || CAST(event_id AS STRING)
              WHEN k < 93 THEN 'git clone https://code.example.net/team' || CAST(u % 11 AS STRING) || '/proj' || CAST(k AS STRING)
              ELSE 'ls -la /media/usb' || CAST(u % 3 AS STRING) || '/data' || CAST(k AS STRING) END
         END AS full_command_line,
       CASE WHEN event_type IN ('view', 'purchase', 'error') THEN
         CASE WHEN k < 20 THEN '/usr/bin/bin' || CAST(k AS STRING)
              WHEN k < 35 THEN '/usr/sbin//cron'
              WHEN k < 50 THEN '/tmp/staged' || CAST(u % 9 AS STRING)
              WHEN k < 60 THEN '/opt/app' || CAST(k % 5 AS STRING) || '/bin/run'
              WHEN k < 70 THEN 'C:' || chr(92) || 'Windows' || chr(92) || 'System32' || chr(92) || 'svc' || CAST(k AS STRING) || '.exe'
              WHEN k < 80 THEN 'C:' || chr(92) || 'Users' || chr(92) || 'Public' || chr(92) || 'drop' || CAST(u % 6 AS STRING) || '.exe'
              WHEN k < 90 THEN '/usr/bin/python3'
              ELSE '/home/u' || CAST(u AS STRING) || '/Downloads/setup' || CAST(k AS STRING) || '.sh' END
         END AS executable,
       CASE event_type WHEN 'click' THEN '/home/u' || CAST(u % 16 AS STRING) || '/.bash_history:' || CAST(CAST(floor(event_id / 8) AS BIGINT) AS STRING)
            ELSE 'rec:' || CAST(CAST(floor(event_id / 3) AS BIGINT) AS STRING) END AS source_record_id,
       CASE WHEN event_type = 'signup' THEN NULL ELSE 'user' || CAST(u AS STRING) END AS user,
       CASE WHEN event_type = 'view' AND k BETWEEN 20 AND 34 THEN 'cron.service' END AS systemd_unit,
       v AS pid
FROM base
""",
    "exec_events": """
SELECT *, CASE WHEN evidence_kind = 'SESSION_EVENT' THEN 'session_open'
               WHEN executable IS NULL THEN regexp_extract(full_command_line, '^[^ ]+', 0)
               ELSE regexp_extract(executable, '[^/' || chr(92) || chr(92) || ']*$', 0) END AS process_name,
       CASE WHEN full_command_line IS NOT NULL THEN 'EXACT'
            WHEN executable IS NOT NULL THEN 'EXECUTABLE_ONLY'
            ELSE 'NOT_AVAILABLE' END AS command_reconstruction_status
FROM exec_raw
""",
    # Files seen on the same hosts; digests are of whole document texts.
    "artifact_raw": """
SELECT 'host-' || CAST(doc_id % 16 AS STRING) AS endpoint_id,
       'inv-' || CAST((doc_id + CAST(floor(doc_id / 48) AS BIGINT)) % 4 AS STRING) AS investigation_id,
       doc_id AS collection_order, CAST(floor(doc_id / 16) AS BIGINT) AS r, source AS src,
       {sha256(text)} AS digest, n_chars AS size_bytes, doc_id % 11 AS s, doc_id
FROM documents
""",
    "artifact_paths": """
SELECT *, CASE r % 7
         WHEN 0 THEN '/usr/bin/bin' || CAST(r % 20 AS STRING)
         WHEN 1 THEN '/tmp/staged' || CAST(r % 9 AS STRING)
         WHEN 2 THEN '/media/usb' || CAST(r % 3 AS STRING) || '/copy' || CAST(doc_id AS STRING) || '.pdf'
         WHEN 3 THEN '/home/u' || CAST(doc_id % 150 AS STRING) || '/Downloads/setup' || CAST(90 + r % 10 AS STRING) || '.sh'
         WHEN 4 THEN 'C:/Users/Public/drop' || CAST(r % 6 AS STRING) || '.exe'
         WHEN 5 THEN '/srv/' || src || '/doc' || CAST(doc_id AS STRING) || '.pdf.exe'
         ELSE '/opt/app' || CAST(r % 5 AS STRING) || '/bin/run' END AS path
FROM artifact_raw
""",
    "artifacts": """
SELECT investigation_id, endpoint_id, collection_order, path,
       regexp_extract(path, '[^/]*$', 0) AS filename, size_bytes,
       CASE WHEN s = 3 THEN 'MISSING' WHEN s = 7 THEN 'PERMISSION_DENIED' ELSE 'COLLECTED' END AS collection_status,
       CASE WHEN s IN (3, 7) THEN NULL ELSE digest END AS hash,
       CASE WHEN s IN (3, 7) THEN NULL ELSE 'SHA256' END AS hash_algorithm,
       src AS source
FROM artifact_paths
""",
    # Page fetches as downloads; targets share spellings with executables.
    "downloads": """
SELECT 'host-' || CAST(page_id % 16 AS STRING) AS endpoint_id,
       'inv-' || CAST((page_id + CAST(floor(page_id / 32) AS BIGINT)) % 4 AS STRING) AS investigation_id, page_id, url,
       CASE CAST(floor(page_id / 16) AS BIGINT) % 4
         WHEN 0 THEN '/home/u' || CAST(page_id % 150 AS STRING) || '/Downloads/setup' || CAST(90 + page_id % 10 AS STRING) || '.sh'
         WHEN 1 THEN '/tmp/staged' || CAST(page_id % 9 AS STRING)
         WHEN 2 THEN '/opt/app' || CAST(page_id % 5 AS STRING) || '/bin/run'
         ELSE '/home/u' || CAST(page_id % 150 AS STRING) || '/Downloads/page' || CAST(page_id AS STRING) || '.html' END AS target_path,
       (SELECT min(ts) FROM events) + INTERVAL 1 HOUR * CAST(page_id % 700 AS INT) AS downloaded_at
FROM pages
""",
    # Path spellings: images, artifact paths, and the same written other ways.
    "paths": """
SELECT DISTINCT p FROM (
  SELECT executable AS p FROM exec_raw UNION ALL SELECT path FROM artifact_paths
  UNION ALL SELECT '/srv//' || src || '///doc' || CAST(doc_id AS STRING) || '/' FROM artifact_raw
  UNION ALL SELECT chr(92) || chr(92) || 'nas' || CAST(doc_id % 16 AS STRING) || chr(92) || src || chr(92) || 'a' || CAST(r AS STRING) || '.dll' FROM artifact_raw
  UNION ALL SELECT 'rel/' || src || '/.hidden' || CAST(r AS STRING) FROM artifact_raw
  UNION ALL SELECT 'D:/data/' || src || '.TXT.exe' FROM artifact_raw
  UNION ALL SELECT 'C:' || chr(92) || 'Users' || chr(92) || 'u' || CAST(r AS STRING) || chr(92) || 'AppData' || chr(92) || 'Local' || chr(92) || 'Temp' || chr(92) || 'x.ps1' FROM artifact_raw)
""",
    # Whole texts.
    "messages": """
SELECT 'd' || CAST(doc_id AS STRING) AS id, text FROM documents
UNION ALL SELECT 'c' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING), text FROM conversations
""",
    # Byte contents: whole texts, some wrapped in file markers or image headers.
    "contents": """
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' WHEN 2 THEN '.pdf' WHEN 3 THEN '.e01' WHEN 4 THEN '.jpeg' ELSE '.bin' END AS ext,
  CASE doc_id % 6
    WHEN 0 THEN unhex('FFD8FF') || {bytes(text)} || unhex('FFD90000')
    WHEN 1 THEN unhex('89504E470D0A1A0A') || {bytes(text)} || unhex('49454E44AE426082')
    WHEN 2 THEN {bytes('%PDF-1.4 ')} || {bytes(text)}
    WHEN 3 THEN unhex('455646090D0AFF00') || {bytes(text)}
    WHEN 4 THEN unhex('FFD8FF') || {bytes(text)}
    ELSE {bytes(text)} END AS content, text
FROM documents
""",
    # Digest observations per file over time.
    "ledger": """
SELECT 'host-' || CAST(l_suppkey % 16 AS STRING) AS endpoint_id,
       '/srv/data/part' || CAST(l_partkey AS STRING) AS path,
       CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 'SHA1' ELSE 'SHA256' END AS algorithm,
       {sha256(CAST(CAST(floor(l_quantity / 10) AS BIGINT) AS STRING))} AS hash,
       CAST(floor(l_extendedprice) AS BIGINT) AS size_bytes, l_shipdate AS ts,
       l_orderkey * 10 + l_linenumber AS seq
FROM lineitem
""",
}

NEEDS = {
    "base": (), "exec_raw": ("base",), "exec_events": ("exec_raw",), "artifact_raw": (),
    "artifact_paths": ("artifact_raw",), "artifacts": ("artifact_paths",), "downloads": (),
    "ledger": (), "paths": ("exec_raw", "artifact_paths"), "messages": (), "contents": (),
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _fill(text: str, dialect: str) -> str:
    for name, pattern in DIALECT[dialect].items():
        while "{" + name + "(" in text:
            start = text.index("{" + name + "(")
            end = text.index(")}", start)
            inside = text[start + len(name) + 2:end]
            text = text[:start] + pattern.format(inside) + text[end + 2:]
    return text


def _chain(names, order=None):
    order = [] if order is None else order
    for name in names:
        _chain(NEEDS[name], order)
        if name not in order:
            order.append(name)
    return order


def with_views(*names: str, dialect: str, extra=()) -> str:
    """A ``WITH`` clause that defines the named views and whatever they build on."""
    parts = [f"{n} AS ({_fill(VIEWS[n], dialect)})" for n in _chain(names)]
    parts += [f"{name} AS ({_fill(text, dialect)})" for name, text in extra]
    return "WITH " + ",\n".join(parts) + "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def evidence(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One evidence view over the parquet tables of a folder."""
    tune(spark)
    sources = [f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in TABLES
               if t in _used_tables(name)]
    chain = with_views(name, dialect="spark")[len("WITH "):]
    df = spark.sql("WITH " + ",\n".join(sources) + ",\n" + chain + f"SELECT * FROM {name}")
    for column, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(column, df[column].cast("timestamp"))
    return spread(df)


def _used_tables(name) -> set:
    text = " ".join(VIEWS[n] for n in _chain([name]))
    return {t for t in TABLES if re.search(rf"\bFROM {t}\b", text)}
