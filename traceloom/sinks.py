"""Writing evidence tables, packages, narratives and briefs."""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .sources.ranges import read_file_digests

_COMMITS = ("run_id string, attempt string, name string, folder string, rows long, partitioned boolean, columns string, "
            "committed_at timestamp")


def write_evidence_tables(tables: dict[str, DataFrame], path: str, *, run_id: str) -> str:
    """The tables of a run, all visible at once; returns the id of this attempt.

    Each table becomes a parquet folder of its own under the attempt, partitioned by investigation. Readers find tables
    through the commit log at ``path/commits``, to which one file is added after the last table: an attempt that fails
    on the way is never seen, and a run that is written again replaces the one before it in one step. The rebalance
    hint evens out files: a large investigation becomes several files and many small ones share tasks.
    """
    root, attempt = path.rstrip("/"), uuid.uuid4().hex
    entries, spark = [], None
    for name, df in tables.items():
        spark = df.sparkSession
        folder = f"tables/run_id={run_id}/{attempt}/{name}"
        partitioned = "investigation_id" in df.columns
        if partitioned:
            df.hint("rebalance", "investigation_id").write.partitionBy("investigation_id").parquet(f"{root}/{folder}")
        else:
            df.hint("rebalance").write.parquet(f"{root}/{folder}")
        rows = _stored(spark, f"{root}/{folder}", df.schema).count()
        entries.append((run_id, attempt, name, folder, rows, partitioned, df.schema.json()))
    if spark is not None:
        log = spark.createDataFrame(entries, _COMMITS.rsplit(",", 1)[0]).withColumn("committed_at", F.current_timestamp())
        log.coalesce(1).write.mode("append").parquet(f"{root}/commits")
    return attempt


def _stored(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(folder).select(*schema.names)


def committed_tables(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """The commit log's rows of the newest attempt of each run, or of one."""
    log = spark.read.schema(_COMMITS).parquet(f"{path.rstrip('/')}/commits")
    if run_id is not None:
        log = log.filter(F.col("run_id") == run_id)
    newest = log.groupBy("run_id").agg(F.max_by("attempt", F.struct("committed_at", "attempt")).alias("attempt"))
    return log.join(newest, ["run_id", "attempt"])


def read_evidence_table(spark: SparkSession, path: str, run_id: str, name: str) -> DataFrame:
    """A table of a run's newest committed attempt, also where it has no rows."""
    found = committed_tables(spark, path, run_id).filter(F.col("name") == name).collect()
    if not found:
        raise ValueError(f"run {run_id!r} has no committed table {name!r}")
    return _stored(spark, f"{path.rstrip('/')}/{found[0]['folder']}", StructType.fromJson(json.loads(found[0]["columns"])))


def package_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(name, bytes, sha256)`` of every data file now under a package, each read in blocks, whatever its size."""
    return read_file_digests(spark, f"{path.rstrip('/')}/data", pattern="part-*").select(
        F.regexp_extract("path", r"/data/(.*)\z", 1).alias("name"), "bytes", "sha256")


def write_package(surfaces: dict[str, DataFrame], path: str, *, records_per_file=500_000) -> None:
    """JSON per surface (events split by kind), then a manifest of sizes and digests.

    Files are bounded so that each can be read back by one task.
    """
    root = path.rstrip("/")
    spark = None
    for name, df in surfaces.items():
        spark = df.sparkSession
        writer = df.write.mode("overwrite").option("maxRecordsPerFile", records_per_file)
        if "evidence_kind" in df.columns:
            writer = writer.partitionBy("evidence_kind")
        writer.json(f"{root}/data/{name}")
    if spark is not None:
        package_digests(spark, root).write.mode("overwrite").parquet(f"{root}/manifest")


def write_narrative(statements: DataFrame, path: str, *, report_id: str) -> None:
    """Replaces the rows of one report and leaves the others."""
    statements.withColumn("report_id", F.lit(report_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("report_id").parquet(path)


def write_briefs(briefs: DataFrame, path: str) -> None:
    briefs.write.mode("append").partitionBy("subject_type").parquet(path)
