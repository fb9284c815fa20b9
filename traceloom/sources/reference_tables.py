"""Package, snap, layout and driver reference tables, the hash ledger, endpoint results."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import functions as X
from .. import vocab as V
from ..operators.recognize import fold_path
from .lines import ENDPOINT_IN_PATH, read_lines, scope


def package_ownership(lines: DataFrame) -> DataFrame:
    """Lines of ``<package>.list`` files to (path, package); the first owner by name wins.

    ``curl:amd64.list`` may be stored as ``curl%3Aamd64.list``: file systems refuse colons.
    """
    base = X.path_basename("file")
    rows = lines.filter((F.col("value") != "") & (F.col("value") != "/.")).select(
        *scope(lines), fold_path("value").alias("path"), F.regexp_replace(
            base, r"((:|%(25)?3[Aa]).*)?\.list\z", "").alias("package"))
    return rows.groupBy(*scope(lines), "path").agg(F.min("package").alias("package"))


def read_package_ownership(spark: SparkSession, path) -> DataFrame:
    return package_ownership(read_lines(spark, path, numbered=False))


def package_status(blocks: DataFrame) -> DataFrame:
    """``blocks(endpoint_id, value)``: one status block each; continuation lines are ignored."""
    def field(name):
        return F.nullif(F.trim(F.regexp_extract("value", rf"(?im)^{name}[ \t]*:([^\r\n]*)", 1)),
                        F.lit(""))
    return blocks.filter(F.trim("value") != "").select(
        *scope(blocks), field("package").alias("package"), field("version").alias("version"),
        field("maintainer").alias("origin"), field("section").alias("section"),
        field("description").alias("description"), field("status").alias("status")).filter(
            "package IS NOT NULL")


def read_package_status(spark: SparkSession, path) -> DataFrame:
    """Blank-line separated blocks, split by the reader."""
    raw = spark.read.option("lineSep", "\n\n").option("recursiveFileLookup", "true").text(path)
    return package_status(raw.select(
        F.regexp_extract(F.col("_metadata.file_path"), ENDPOINT_IN_PATH, 1).alias("endpoint_id"),
        "value"))


def snap_metadata(lines: DataFrame) -> DataFrame:
    """Top-level ``key: value`` lines per snap file."""
    top = lines.filter(F.col("value").rlike(r"^[^ \t\-][^:]*:")).select(
        *scope(lines), "file", "line_no",
        F.lower(F.trim(F.regexp_extract("value", r"^([^:]*):(.*)\z", 1))).alias("key"),
        F.trim(F.regexp_extract("value", r"^([^:]*):(.*)\z", 2)).alias("text"))
    at = [*scope(lines), "file"]
    last = lambda k: F.nullif(F.max_by("text", F.when(
        F.col("key") == k, F.col("line_no"))), F.lit(""))
    wide = top.groupBy(*at).agg(*[F.when(F.count_if(F.col("key") == k) > 0, last(k)).alias(k)
                                  for k in ("name", "title", "version", "summary")])
    folder = F.element_at(F.split("file", "/"), -4)
    named = wide.withColumn("name", F.coalesce("name", folder))
    return named.select(*scope(lines), "name", F.coalesce("title", "name").alias("title"),
                        "version", "summary", F.col("file").alias("meta_path"))


def vendor_layouts(documents: DataFrame) -> DataFrame:
    """Layout descriptors in file order, from JSON documents in ``value``."""
    schema = ("name string, version string, entries array<struct<name:string,category:string,"
              "path_contains:string,marker:string,version_json_key:string,version_regex:string,"
              "confidence:string>>")
    return documents.select(F.from_json("value", schema).alias("d")).select(
        F.posexplode("d.entries").alias("ord", "e")).select("ord", "e.*")


def risk_reference(documents: DataFrame) -> DataFrame:
    """Known-abused drivers, one row per name and per digest."""
    schema = ("source string, entries array<struct<id:string,category:string,mitre_id:string,"
              "names:array<string>,sha256:array<string>>>")
    entries = documents.select(F.from_json("value", schema).alias("d")).select(
        F.inline("d.entries"))
    none = F.lit(None).cast("string")
    names = entries.select("id", "category", F.explode("names").alias("name"),
                           none.alias("sha256"))
    digests = entries.select("id", "category", none.alias("name"),
                             F.explode("sha256").alias("sha256"))
    return names.unionByName(digests).withColumn("name", F.lower("name")).withColumn(
        "sha256", F.lower("sha256"))


def hash_ledger(documents: DataFrame, *, strict=True) -> DataFrame:
    """``documents(endpoint_id, value)``: ``{path: [observation, …]}`` to rows.

    One bad observation makes its whole document untrusted: ``strict`` fails the
    job, otherwise the document's rows are left out and kept by ``ledger_rejects``.
    """
    rows = _ledger_rows(documents)
    if strict:
        checked = F.assert_true("_ok", F.lit("a hash ledger holds an invalid observation"))
        rows = rows.filter(checked.isNull())
    else:
        bad = rows.filter("NOT _ok").select("_doc").distinct()
        rows = rows.join(bad, "_doc", "left_anti")
    return rows.filter("path IS NOT NULL").select(
        *scope(documents), "path", "algorithm", "hash", "size_bytes",
        F.col("timestamp").alias("timestamp_text"), X.parse_timestamp("timestamp").alias("ts"),
        F.col("at").alias("seq"))


def _ledger_rows(documents: DataFrame) -> DataFrame:
    schema = "map<string,array<struct<algorithm:string,hash:string,size_bytes:bigint,timestamp:string>>>"
    parsed = documents.withColumn("_doc", F.xxhash64(*documents.columns)).withColumn(
        "m", F.from_json("value", schema))
    paths = parsed.select("*", F.explode_outer("m").alias("path", "history"))
    rows = paths.select(*scope(documents), "_doc", "path", "m", "history",
                        F.posexplode_outer("history").alias("at", "o")).select(
        *scope(documents), "_doc", "path", "at", "o.*", F.col("m").isNotNull().alias("_map"),
        (F.coalesce(F.size("m"), F.lit(0)) == 0).alias("_empty"))
    valid = X.validate_digest("algorithm", "hash", "size_bytes", "timestamp")
    return rows.withColumn("_ok", F.col("_map") & (F.col("_empty") | (
        (F.coalesce("path", F.lit("")) != "") & valid)))


def ledger_rejects(documents: DataFrame) -> DataFrame:
    return _ledger_rows(documents).filter("NOT _ok").groupBy(*scope(documents)).agg(
        F.count("*").alias("bad_observations"))


RESULT_SCHEMAS = {
    "NETWORK": ("connections", "array<struct<remote_address:string,remote_port:int,"
                               "process_name:string,status:string>>"),
    "DRIVERS": ("drivers", "array<struct<name:string,sha256:string,"
                           "verification:struct<risk_status:string>>>"),
    "BROWSER": ("downloads", "array<struct<url:string,target_path:string,profile:string>>"),
    "USB": ("devices", "array<struct<serial:string,vendor:string,product:string,"
                       "removable:string>>"),
}
_ARTIFACTS = "array<struct<path:string,hash:string,sha256:string>>"


def endpoint_results(tasks: DataFrame) -> dict[str, DataFrame]:
    """Per-source tables from ``tasks(endpoint_id, source, status, result JSON)``.

    Only succeeded tasks whose result is an object contribute.
    """
    good = tasks.filter((F.col("status") == V.SUCCEEDED)
                        & F.startswith(F.ltrim("result"), F.lit("{")))
    out = {"endpoints": good.select("endpoint_id", "source").distinct()}
    for source, (name, schema) in RESULT_SCHEMAS.items():
        rows = good.filter(F.col("source") == source).select("endpoint_id", F.inline(F.from_json(
            "result", f"struct<{name}:{schema}>")[name]))
        if name == "drivers":
            rows = rows.withColumn("risk_status", F.col("verification.risk_status"))
        out[name] = rows
    out["artifacts"] = good.select("endpoint_id", F.inline(F.from_json(
        "result", f"struct<artifacts:{_ARTIFACTS}>")["artifacts"])).select(
            "endpoint_id", "path", F.coalesce("sha256", "hash").alias("hash"))
    return out
