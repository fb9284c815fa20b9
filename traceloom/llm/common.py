"""Shared by the operators: reading tables, text and row keys."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that count as white space (words are what stands between them), and the letters that are lowered.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: What a null doc_id counts as where rows are grouped by it.
NO_ID = -(2 ** 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def id_or_none(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))


def words_of(text: str) -> list[bytes]:
    """The words of a text as UTF-8: ``bytes.split`` takes just the characters of ``SPACES`` as white space."""
    return text.encode().split()


def key128(value: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a value, compared together."""
    return F.xxhash64(value), F.xxhash64(F.lit(1), value)


def ascii_lower(value: Column) -> Column:
    """A-Z lowered and nothing else; ``lower`` says the same of values that are all ASCII."""
    return (F.when(F.octet_length(value) == F.char_length(value), F.lower(value))
            .otherwise(F.translate(value, UPPER, LOWER)))
