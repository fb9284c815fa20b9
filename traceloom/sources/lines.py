"""Collected text files as numbered lines, without reading any file in one piece."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

ENDPOINT_IN_PATH = r"endpoint=([^/]+)"
PATH_ON_HOST = r"endpoint=[^/]+(/.*)\z"


def host_path(path):
    """The path on the host a collected file came from; ``dot_name`` stands for ``.name``."""
    on_host = F.coalesce(F.nullif(F.regexp_extract(path, PATH_ON_HOST, 1), F.lit("")), F.col(path))
    return F.regexp_replace(on_host, r"/dot_([^/]*)\z", "/.$1")


def read_lines(spark: SparkSession, path, *, numbered=True) -> DataFrame:
    """``(endpoint_id, file, line_no, value)`` of files laid out as ``…/endpoint=<id>/…``.

    Spark skips files whose names begin with a dot, so ``.bash_history`` is
    collected as ``dot_bash_history`` and gets its own name back here.

    A large file is read in blocks by many tasks. Lines are in order within a
    block, so a line's number is its place in the block plus the lines in the
    blocks before it; only block sizes cross the shuffle ordered.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(path).select(
        "value", F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_block"))
    marked = raw.withColumn("_seq", F.monotonically_increasing_id())
    placed = marked.select(
        F.regexp_extract("_path", ENDPOINT_IN_PATH, 1).alias("endpoint_id"),
        host_path("_path").alias("file"), "_path", "_block", "_seq", "value")
    if not numbered:
        return placed.select("endpoint_id", "file", F.col("_seq").alias("line_no"), "value")
    sizes = placed.groupBy("_path", "_block").agg(F.min("_seq").alias("_low"),
                                                  F.count("*").alias("_n"))
    before = Window.partitionBy("_path").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = sizes.select("_path", "_block", "_low", F.coalesce(
        F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(offsets, ["_path", "_block"]).select(
        "endpoint_id", "file",
        (F.col("_before") + F.col("_seq") - F.col("_low") + 1).alias("line_no"), "value")


def sliced(lines: DataFrame, group, *, size=100_000) -> DataFrame:
    """Slice marks from line numbers, for the ordered operators: no sort, even slices."""
    return lines.withColumn("_part", F.floor(F.col("line_no") / size)).withColumn(
        "_at", F.col("line_no"))


def scope(df: DataFrame) -> list[str]:
    return [c for c in ("investigation_id", "endpoint_id") if c in df.columns]


def once(df: DataFrame, keep, columns: dict) -> DataFrame:
    """``keep`` and new columns, each computed once a row however often it is read.

    Expressions of a plain projection are copied to wherever they are read, filters included; those of a generator are not.
    """
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*keep, F.inline(F.array(made)))


def words(value="value"):
    """A line split on blanks, without empty words."""
    return F.filter(F.split(F.trim(F.col(value)), r"\s+"), lambda w: w != "")


def all_of(conditions):
    return reduce(lambda a, b: a & b, conditions)
