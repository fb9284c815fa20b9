"""The corpus pipeline: stages that each apply one operator of ``traceloom.llm`` to what the stage before kept.

Quality rules reject documents, line dedup shortens texts, near-dedup keeps the first document of each class, the
secret scan masks what it finds, and packing lays the token ids of what is left into sequences. A row is told from
others by its id and its text, so rows that repeat both share a fate; a null id is an id of its own.
"""

from pyspark.sql import functions as F

from traceloom.llm.common import id_or_none, whole_text
from traceloom.llm.line_dedup import drop_shared_lines
from traceloom.llm.minhash import first_of_classes
from traceloom.llm.packing import pack
from traceloom.llm.quality_rules import apply_rules
from traceloom.llm.secrets import find_secrets, masked
from traceloom.session import written


def _with_text(docs, text):
    """``docs`` with another text, and its length where the table has one."""
    out = docs.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.char_length("text").cast(kind))
    return out


def quality_rules(spark, docs, sf_dir):
    """Documents that the rules reject go."""
    kept = (apply_rules(docs).filter("kept")
            .select(id_or_none().alias("_qr_d"), F.col("t").alias("_qr_t"), F.col("host").alias("_qr_h")).distinct())
    own = docs.withColumns({"_qr_id": id_or_none(), "_qr_hash": F.xxhash64(whole_text()),
                            "_qr_host": F.coalesce(F.col("source").cast("string"), F.lit(""))})
    same = ((F.col("_qr_id") == F.col("_qr_d")) & (F.col("_qr_hash") == F.col("_qr_t"))
            & (F.col("_qr_host") == F.col("_qr_h")))
    return own.join(kept, same, "left_semi").select(*docs.columns)


def line_dedup(spark, docs, sf_dir):
    """Lines that many documents share go, but from one of them; documents left without a word go with them."""
    rest = _with_text(drop_shared_lines(docs), F.col("text")).select(*docs.columns)
    return rest.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def near_dedup(spark, docs, sf_dir):
    """One row stays of each class, that with the smallest id, or with the smallest digest where none has one."""
    return first_of_classes(docs)


def secret_scan(spark, docs, sf_dir):
    """Secrets are masked; every document stays."""
    return _with_text(find_secrets(docs), masked(whole_text(), F.col("_spans"))).select(*docs.columns)


def packing(spark, docs, sf_dir):
    """Pieces of sequences, with their ids."""
    return pack(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup),
          ("secret scan", secret_scan), ("packing", packing)]

#: SQL can say neither near-duplicates nor token ids; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The pieces that the stages make of ``documents``; each stage reads what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
