"""Lines that many documents share are dropped, from all but one of them.

Explode normalised lines, hash them, count distinct documents per hash, drop lines over the threshold and
reassemble each text by position. DataFrame functions only.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, id_or_none, key128, whole_text

MIN_CHARS, MIN_DOCS = 40, 5
#: A line that most documents hold is spread over so many tasks where the lines meet their counts.
SALTS = 16


def line_key(line: Column) -> Column:
    """The normalised line: white space stripped at both ends, A-Z lowered."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def shared_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """``(h1, h2, keep)`` of each line found in ``min_docs`` documents or more; ``keep`` is the largest id.

    One row per line and document first, so that the second grouping adds up counts before it shuffles.
    """
    return (lines.groupBy("h1", "h2", "d").agg(F.count(F.lit(1)).alias("copies"))
            .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("keep"))
            .filter(F.col("n") >= min_docs).select("h1", "h2", "keep"))


def drop_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                      doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` with the text less its shared lines, and ``_n_lines``, ``_n_dropped`` (long).

    A null text counts as empty and comes back empty: one empty line. Null ids count together as one document
    that is smaller than any other. Rows that repeat an id are one document: a line is dropped from all of them
    or from none. A line repeated inside the document that keeps it stays each time. An empty table gives an
    empty result. Extra columns pass, whatever their names; names that begin with ``_dl_`` are reserved.
    """
    rows = docs.select(id_or_none(doc_id).alias("d"), F.xxhash64(whole_text(text)).alias("t"),
                       F.posexplode(F.split(whole_text(text), "\n", -1)).alias("pos", "line"))
    rows = rows.filter(F.char_length(F.btrim("line", F.lit(SPACES))) >= min_chars)
    first, second = key128(line_key(F.col("line")))
    # dealt out by line and document, which no hot line upsets; both uses below read this one shuffle
    lines = rows.select("d", "t", "pos", first.alias("h1"), second.alias("h2")).repartition("h1", "h2", "d")
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))
    shared = shared_lines(lines, min_docs).withColumn("salt", salts)
    gone = (lines.withColumn("salt", F.pmod(F.xxhash64("d", "pos"), F.lit(SALTS)).cast("int"))
            .join(shared, ["h1", "h2", "salt"]).filter(F.col("d") != F.col("keep"))
            .groupBy("d", "t").agg(F.collect_set("pos").alias("_dl_gone"))
            .select(F.col("d").alias("_dl_d"), F.col("t").alias("_dl_t"), "_dl_gone"))
    own = docs.withColumns({"_dl_id": id_or_none(doc_id), "_dl_hash": F.xxhash64(whole_text(text))})
    joined = own.join(gone, (F.col("_dl_id") == F.col("_dl_d")) & (F.col("_dl_hash") == F.col("_dl_t")), "left")
    split = F.split(whole_text(text), "\n", -1)
    rest = F.array_except(F.sequence(F.lit(0), F.size("_dl_lines") - 1), F.col("_dl_gone"))
    kept = F.when(F.col("_dl_gone").isNull(), whole_text(text)).otherwise(
        F.array_join(F.transform(rest, lambda i: F.element_at("_dl_lines", i + 1)), "\n"))
    result = joined.withColumn("_dl_lines", split).withColumns({
        text: kept, "_n_lines": F.size("_dl_lines").cast("long"),
        "_n_dropped": F.coalesce(F.size("_dl_gone"), F.lit(0)).cast("long")})
    return result.drop("_dl_id", "_dl_hash", "_dl_d", "_dl_t", "_dl_gone", "_dl_lines")


def op1_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_shared_lines(docs).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.sha2("text", 256).alias("kept_sha256"))


def oracle(documents: str = "documents") -> str:
    """The kept text of every document, as DuckDB SQL."""
    return f"""
    WITH lines AS (
      SELECT doc_id, u.pos AS pos, u.line AS line FROM (
        SELECT doc_id, unnest(list_zip(range(len(string_split(coalesce(text, ''), chr(10)))),
                                       string_split(coalesce(text, ''), chr(10)))) AS z FROM {documents}) AS s,
        LATERAL (SELECT z[1] AS pos, z[2] AS line) AS u),
    keyed AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12)
        || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
    shared AS (SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= {MIN_CHARS}
               GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
    marked AS (SELECT keyed.*, shared.k IS NOT NULL AND keyed.doc_id <> shared.keep AS gone
               FROM keyed LEFT JOIN shared ON keyed.k = shared.k)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
           coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept
    FROM marked GROUP BY doc_id"""


ORACLE = (f"SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, "
          f"sha256(kept) AS kept_sha256 FROM ({oracle()}) AS kept_texts")
