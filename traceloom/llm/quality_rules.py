"""Quality rules: measures of each text, and lines that too many documents of a host share.

Lines are normalised and hashed, and the distinct documents that hold one are counted per host. Lines above the
limit are taken out of all of them but one, and documents that lose most of their text that way are rejected. Copies
of the text that keeps a line keep it too, so a text that is merely copied does not lose its lines; copies are left to
the near-duplicate stage.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, id_or_none, key128, whole_text, words_of
from .line_dedup import line_key

#: A line is above the limit if so many documents of a host hold it, however large the host is.
MIN_DOCS = 10
#: A document is depleted if less than this share of its lines' characters is left.
MIN_LEFT = 0.2
#: Fixed values of the base rules.
MIN_WORDS, MAX_REPEATED, SPAN = 20, 30, 8
SYMBOLS = "#*$%&|<>"
SALTS = 16
_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], span: int = SPAN) -> int:
    """Words that stand in a window of ``span`` words which occurs twice or more in the text."""
    if len(words) <= span:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    n = len(words) - span + 1
    mixed = np.zeros(n, np.uint64)
    for i in range(span):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[i:i + n]
    ordered = np.sort(mixed)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(mixed, twice)).tolist()
    windows = [tuple(words[i:i + span]) for i in at]                 # equal hashes are only a hint
    times = Counter(windows)
    edges = np.zeros(len(words) + 1, np.int64)
    for i, window in zip(at, windows, strict=True):
        if times[window] > 1:
            edges[i] += 1
            edges[i + span] -= 1
    return int((np.cumsum(edges) > 0).sum())


def measures(text: str) -> tuple[int, int, int, int, int]:
    words = words_of(text)
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(words))


def _own_host(host: str):
    return F.coalesce(F.col(host).cast("string"), F.lit(""))


def text_measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """``(doc_id, t, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)`` of every row; ``t`` hashes the text."""
    schema = "doc_id long, t long, host string, " + ", ".join(f"{m} long" for m in _MEASURES)
    names = ["doc_id", "t", "host", *_MEASURES]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [measures(t) for t in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2),
                     *[pa.array([row[i] for row in found], pa.int64()) for i in range(len(_MEASURES))]], names=names)

    whole = whole_text(text)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(whole).alias("t"),
                       _own_host(host).alias("host"), whole.alias("text")).mapInArrow(run, schema)


def lost_characters(docs: DataFrame, min_docs: int, doc_id: str, text: str, host: str) -> DataFrame:
    """``(host, d, t, lost)`` of the documents that hold lines above the limit: characters lost.

    Rows that repeat host, id and text lose the same lines each, so their sum is divided by their number.
    """
    own = docs.select(_own_host(host).alias("host"), id_or_none(doc_id).alias("d"),
                      F.xxhash64(whole_text(text)).alias("t"), whole_text(text).alias("text"))
    stripped = F.btrim("line", F.lit(SPACES))
    rows = own.select("host", "d", "t", F.explode(F.split("text", "\n", -1)).alias("line"))
    first, second = key128(line_key(F.col("line")))
    chars = F.char_length(stripped)
    lines = (rows.filter(chars > 0).select("host", "d", "t", first.alias("h1"), second.alias("h2"),
                                           chars.cast("long").alias("chars")).repartition("host", "h1", "h2", "t"))
    held = lines.select("host", "h1", "h2", "t", "d").distinct()
    counted = held.groupBy("host", "h1", "h2").agg(F.count(F.lit(1)).alias("n"),
                                                   F.min(F.struct("d", "t")).alias("first"))
    above = (counted.filter(F.col("n") >= min_docs)
             .select("host", "h1", "h2", F.col("first.t").alias("holder"))
             .withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))))
    hits = (lines.withColumn("salt", F.pmod(F.xxhash64("d"), F.lit(SALTS)).cast("int"))
            .join(above, ["host", "h1", "h2", "salt"]).filter(F.col("t") != F.col("holder")))
    repeats = own.groupBy("host", "d", "t").agg(F.count(F.lit(1)).alias("repeats")).filter("repeats > 1")
    return (hits.groupBy("host", "d", "t").agg(F.sum("chars").alias("sum")).join(repeats, ["host", "d", "t"], "left")
            .select("host", "d", "t", F.expr("sum div coalesce(repeats, 1L)").alias("lost")))


def apply_rules(docs: DataFrame, min_docs: int = MIN_DOCS, min_left: float = MIN_LEFT, doc_id: str = "doc_id",
                text: str = "text", host: str = "source") -> DataFrame:
    """One row per document: its measures, ``lost_chars``, ``base_failed`` and ``kept``, with ``t``, the text's hash.

    A null text has no words and fails. Null hosts are one host (``host`` is then empty), null ids one document; rows
    that repeat an id with the same text at a host count once and are judged alike. Hosts with fewer than ``min_docs``
    documents lose nothing. An empty table gives an empty result. Extra columns are ignored.
    """
    lost = lost_characters(docs, min_docs, doc_id, text, host).select(
        F.col("host").alias("_host"), F.col("d").alias("_d"), F.col("t").alias("_t"), "lost")
    own = text_measures(docs, doc_id, text, host)
    joined = own.join(lost, (F.col("host") == F.col("_host")) & (id_or_none("doc_id") == F.col("_d"))
                      & (F.col("t") == F.col("_t")), "left")
    lost_chars = F.coalesce("lost", F.lit(0))
    failed = ((F.col("n_words") < MIN_WORDS)
              | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
    # what lines hold besides words is the white space between them: at most one character in two
    left = F.col("word_chars") + F.col("n_words") - lost_chars
    depleted = left < F.lit(min_left) * (F.col("word_chars") + F.col("n_words"))
    return joined.select("doc_id", "t", "host", *_MEASURES, lost_chars.alias("lost_chars"), failed.alias("base_failed"),
                         (~failed & ~depleted).alias("kept"))


def op6_quality_rules(spark, sf_dir):
    return apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", *_MEASURES, "base_failed", "kept")
