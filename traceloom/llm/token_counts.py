"""What a corpus holds under every context limit, from an exact histogram of encoded lengths.

Documents are counted by length once. Suffix sums over the lengths then answer totals, quantiles and truncated totals
for every limit L: documents longer than L contribute L, the others their length. The sums run in two levels, over
blocks of lengths and inside each, so that no single task sorts all lengths.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .tokens import token_lengths

BLOCK = 1024


def length_histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """``(n_tokens, n_docs)``: one row per length that occurs. Null lengths count as 0."""
    return (lengths.groupBy(F.coalesce(F.col(length).cast("long"), F.lit(0)).alias("n_tokens"))
            .agg(F.count(F.lit(1)).alias("n_docs")))


def suffix_sums(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """``histogram`` with what documents of at least each length hold, and the answers at that limit.

    * ``docs_at_least``, ``tokens_at_least``: documents of this length or more, and their tokens.
    * ``total_docs``, ``total_tokens``: of the whole corpus.
    * ``truncated_tokens``: the corpus' tokens with every document cut to ``n_tokens``.
    * ``docs_up_to``: documents of this length or less; the q-quantile of lengths is the smallest ``n_tokens`` with
      ``docs_up_to >= q * total_docs``.

    An empty histogram stays empty.
    """
    rows = histogram.withColumns({"tokens": F.col("n_tokens") * F.col("n_docs"),
                                  "block": F.floor(F.col("n_tokens") / block)})
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    # as many rows as the longest text has blocks
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy()
    above = blocks.select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_above"),
                          F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_above"),
                          F.sum("d").over(everywhere).alias("total_docs"),
                          F.sum("t").over(everywhere).alias("total_tokens"))
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc())
    found = rows.join(above, "block").withColumns({
        "docs_at_least": F.col("d_above") + F.sum("n_docs").over(inside),
        "tokens_at_least": F.col("t_above") + F.sum("tokens").over(inside)})
    more = F.col("docs_at_least") - F.col("n_docs")
    return found.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least", "total_docs", "total_tokens",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("tokens") + F.col("n_tokens") * more)
        .alias("truncated_tokens"), (F.col("total_docs") - more).alias("docs_up_to"))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row ``(docs_over long, truncated_tokens long)`` for any limit, also one that no text has exactly."""
    over: Column = F.col("n_tokens") > limit
    return sums.agg(F.coalesce(F.sum(F.when(over, F.col("n_docs"))), F.lit(0)).alias("docs_over"),
                    F.coalesce(F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs")), F.lit(0))
                    .alias("truncated_tokens"))


def length_quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row ``(n_tokens long)``: the smallest length that a share ``q`` of documents does not exceed."""
    return sums.filter(F.col("docs_up_to") >= F.lit(q) * F.col("total_docs")).agg(
        F.min("n_tokens").alias("n_tokens"))


def op7_token_counts(spark, sf_dir):
    """Lengths by the 50k byte-level vocabulary; a null or empty text has length 0.

    The histogram is written, as both levels of sums read it and texts are to be encoded once.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_sums(written(length_histogram(token_lengths(docs))))
