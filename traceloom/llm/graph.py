"""Connected components of links between documents, by contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` of every node of ``links (a long, b long)``; nodes that hang together share a label.

    In each round a node moves to its first neighbour, or stays if it comes first itself, in an order by hashes;
    links between nodes that have moved to the same place vanish. Whatever the ids are, a constant share of the nodes
    goes per round. Each round is a table in the checkpoint folder, so lineage stays short.
    """
    links = written(links.select("a", "b").filter("a <> b").distinct())
    labels = None
    while True:
        both = links.union(links.select("b", "a"))
        first = F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("node")))
        here = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("node"))
        moves = written(both.groupBy("a").agg(first.alias("first"))
                        .select("a", F.least(here, F.col("first")).getField("node").alias("to")))
        if labels is None:
            labels = moves.select(F.col("a").alias("node"), F.col("to").alias("label"))
        else:
            then = moves.select(F.col("a").alias("label"), "to")
            labels = labels.join(then, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        at = moves.select(F.col("a").alias("b"), F.col("to").alias("b_to"))
        moved = links.join(moves, "a").join(at, "b").select(F.col("to").alias("a"), F.col("b_to").alias("b"))
        links = written(moved.filter("a <> b").distinct())
        if links.isEmpty():
            return written(labels)
