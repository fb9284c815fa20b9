"""SimHash near-duplicates by a hierarchical index in Gray order.

Fingerprints are sorted by Gray rank, an order in which neighbours share long runs of bits. Sixteen neighbours form a
node, sixteen nodes a node above it, and so on; a node keeps the bits that all below it have and those that any has.
Where all of one node have a bit that none of another has, every pair below them differs in it. These differences add
up, and once they are more than the limit the two groups are left whole. Pairs of nodes are followed from the top down.

Two fingerprints that differ in three bits agree in one of four quarters. The index therefore holds each fingerprint
four times, turned so that another quarter comes first, and only those with the same first quarter are compared.
The order is cut into leaves of one row each; a quarter with so many fingerprints that it spans several leaves gets
upper nodes of its own, which Spark joins level by level, and leaves that may hold links meet in a grouped job.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import written
from .common import table
from .graph import components

SHINGLE, BITS, DISTANCE = 3, 64, 3
#: Fixed value: the seed of the hash.
SEED = 42
#: Three differing bits leave one of so many parts as it is.
TURNS = DISTANCE + 1
PART = BITS // TURNS
#: Fingerprints of a leaf, children of a node, and pairs of nodes opened together.
LEAF, FAN, AT_ONCE = 32_768, 16, 4096
_HASHES = 1 << 16
_LEAF = "turn int, first long, low long, high long, any_bits long, all_bits long, ranks binary"


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a whole text; 0 without words."""
    from xxhash import xxh64_intdigest
    words = (text or "").encode().lower().split()                   # bytes: A-Z and the contract's white space only
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(SHINGLE, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths)[:len(words) - size + 1].tolist()
    ends = ends[size - 1:].tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(begins), _HASHES):
        part = range(at, min(at + _HASHES, len(begins)))
        hashes = np.fromiter((xxh64_intdigest(joined[begins[i]:ends[i]], SEED) for i in part), "<u8", len(part))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(begins), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id long, print long)`` of every row, the fingerprint as a signed long."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                prints = np.array([fingerprint(t) for t in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints.view(np.int64))],
                                                 names=["doc_id", "print"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, print long")


# --- the index -----------------------------------------------------------------------

def gray_rank(code):
    """The place of a code (Column) in Gray order, as a signed long that sorts like the unsigned rank."""
    for by in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, by))
    return code.bitwiseXOR(F.lit(-2 ** 63))


def turned(prints: DataFrame) -> DataFrame:
    """``(turn, rank)``: each distinct fingerprint in ``TURNS`` rotations, by its Gray rank."""
    code = F.element_at(F.array(*[
        F.shiftleft("print", PART * t).bitwiseOR(F.shiftrightunsigned("print", BITS - PART * t)) if t else F.col("print")
        for t in range(TURNS)]), F.col("turn") + 1)
    return (prints.withColumn("turn", F.explode(F.array(*[F.lit(t) for t in range(TURNS)])))
            .select("turn", gray_rank(code).alias("rank")))


def _codes(ranks: np.ndarray) -> np.ndarray:
    return ranks ^ (ranks >> np.uint64(1))


def _prints(codes: np.ndarray, turn: int) -> np.ndarray:
    by = np.uint64(PART * turn)
    back = (codes >> by) | (codes << np.uint64(BITS - PART * turn)) if turn else codes
    return back.view(np.int64)


def leaves(prints: DataFrame, leaf: int = LEAF) -> DataFrame:
    """The index's lowest nodes, one row each: ``leaf`` fingerprints at most that follow one another in Gray order.

    ``low`` and ``high`` are the first and the last quarter in it, ``first`` its first rank (which names it).
    """
    def rows(turn, ranks):
        for at in range(0, len(ranks), leaf):
            part = ranks[at:at + leaf]
            codes = _codes(part)
            quarter = (part[[0, -1]] >> np.uint64(BITS - PART)).astype(np.int64)
            bits = np.array([np.bitwise_or.reduce(codes), np.bitwise_and.reduce(codes)], np.uint64).view(np.int64)
            yield [turn, int((part[:1] ^ np.uint64(2 ** 63)).view(np.int64)[0]), int(quarter[0]), int(quarter[1]),
                   int(bits[0]), int(bits[1]), part.astype("<u8").tobytes()]

    def cut(batches):
        kept = {}
        for batch in batches:
            turns = batch.column(0).to_numpy()
            ranks = batch.column(1).to_numpy().view(np.uint64) ^ np.uint64(2 ** 63)
            for turn in np.unique(turns).tolist():
                held = np.concatenate([kept.pop(turn, ranks[:0]), ranks[turns == turn]])
                full = len(held) // leaf * leaf
                kept[turn] = held[full:]
                out = list(rows(turn, held[:full]))
                if out:
                    yield _leaf_batch(out)
        out = [row for turn, ranks in sorted(kept.items()) for row in rows(turn, ranks)]
        if out:
            yield _leaf_batch(out)

    ordered = turned(prints).repartitionByRange("turn", "rank").sortWithinPartitions("turn", "rank")
    return ordered.mapInArrow(cut, _LEAF)


def _leaf_batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.int64()] * 5, pa.binary()]
    names = [c.split()[0] for c in _LEAF.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


class Tree:
    """Nodes over fingerprints in Gray order; level 0 are the fingerprints themselves."""

    def __init__(self, ranks: np.ndarray, fan: int = FAN, height: int = 1):
        self.fan, codes = fan, _codes(ranks)
        quarter = (ranks >> np.uint64(BITS - PART)).astype(np.int32)
        self.levels = [(codes, codes, quarter, quarter)]            # bits that any has, that all have; first, last quarter
        while len(self.levels) <= height or len(self.levels[-1][0]) > 1:
            some, every, low, high = self.levels[-1]
            at = np.arange(0, len(some), fan)
            self.levels.append((np.bitwise_or.reduceat(some, at), np.bitwise_and.reduceat(every, at),
                                low[at], np.maximum.reduceat(high, at)))


def close_pairs(ranks: np.ndarray, others: np.ndarray | None = None, fan: int = FAN, distance: int = DISTANCE):
    """Places ``(i, j)``, chunk by chunk, of fingerprints of one quarter that differ in ``distance`` bits at most.

    ``i`` counts in ``ranks`` and ``j`` in ``others``, which follow ``ranks`` in order; without ``others`` both count
    in ``ranks``, with ``i < j``.
    """
    same = others is None
    left = Tree(ranks, fan)
    right = left if same else Tree(others, fan, len(left.levels) - 1)
    if len(right.levels) > len(left.levels):
        left = Tree(ranks, fan, len(right.levels) - 1)
    children, todo = np.arange(fan), [(len(left.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        level, a, b = todo.pop()
        if len(a) > AT_ONCE:
            todo += [(level, a[at:at + AT_ONCE], b[at:at + AT_ONCE]) for at in range(0, len(a), AT_ONCE)]
            continue
        if not level:
            yield a, b
            continue
        level -= 1
        some, every, low, high = left.levels[level]
        some_, every_, low_, high_ = right.levels[level]
        a = np.repeat(a[:, None] * fan + children, fan, axis=1).ravel()
        b = np.tile(b[:, None] * fan + children, (1, fan)).ravel()
        there = (a < len(some)) & (b < len(some_)) & ((a + (level == 0) <= b) if same else True)
        a, b = a[there], b[there]
        there = (low_[b] <= high[a]) & (low[a] <= high_[b])
        a, b = a[there], b[there]
        apart = (every[a] & ~some_[b]) | (every_[b] & ~some[a])
        there = np.bitwise_count(apart) <= distance
        if there.any():
            todo.append((level, a[there], b[there]))


def _joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``labels``, the least place of each component, after links ``(a, b)``."""
    while True:
        one, two = labels[a], labels[b]
        apart = one != two
        if not apart.any():
            return labels
        a, b, one, two = a[apart], b[apart], one[apart], two[apart]
        np.minimum.at(labels, np.maximum(one, two), np.minimum(one, two))
        while (labels[labels] != labels).any():
            labels = labels[labels]


def _forest(turn: int, ranks: np.ndarray, others: np.ndarray | None, fan: int) -> pa.Table:
    """Links ``(a, b)`` that hang together what the close pairs of one or two leaves hang together."""
    every = ranks if others is None else np.concatenate([ranks, others])
    labels, shift = np.arange(len(every)), 0 if others is None else len(ranks)
    for i, j in close_pairs(ranks, others, fan):
        labels = _joined(labels, i, j + shift)
    linked = np.flatnonzero(labels != np.arange(len(every)))
    prints = _prints(_codes(every), turn)
    return pa.table({"a": pa.array(prints[linked]), "b": pa.array(prints[labels[linked]])})


def leaf_pairs(index: DataFrame, fan: int = FAN, distance: int = DISTANCE) -> DataFrame | None:
    """``(turn, first_a, first_b)``: different leaves that share a quarter and may hold links; None where none do.

    Upper nodes of each quarter are followed from its root: a pair of nodes is opened if the differences that all
    below them share leave room for a link.
    """
    quarter = ["turn", "quarter"]
    held = index.withColumn("quarter", F.explode(F.array_distinct(F.array("low", "high"))))
    sizes = held.groupBy(*quarter).agg(F.count("*").alias("n")).filter("n > 1")
    most = sizes.agg(F.max("n")).first()[0]
    if most is None:
        return None
    order = Window.partitionBy(*quarter).orderBy("first")
    base = written(held.join(sizes, quarter, "left_semi").select(
        *quarter, "first", "any_bits", "all_bits", (F.row_number().over(order) - 1).cast("long").alias("node")))
    levels = [base.drop("first")]
    while fan ** (len(levels) - 1) < most:
        levels.append(levels[-1].groupBy(*quarter, F.floor(F.col("node") / fan).alias("node")).agg(
            F.expr("bit_or(any_bits)").alias("any_bits"), F.expr("bit_and(all_bits)").alias("all_bits")))
    pairs = levels.pop().select(*quarter, F.col("node").alias("a"), F.col("node").alias("b"))

    def side(nodes, name):
        return nodes.select(*quarter, F.floor(F.col("node") / fan).alias(name), F.col("node").alias(f"next_{name}"),
                            F.col("any_bits").alias(f"any_{name}"), F.col("all_bits").alias(f"all_{name}"))

    def only(one, other):
        return F.col(f"all_{one}").bitwiseAND(F.bitwise_not(f"any_{other}"))

    while levels:
        nodes = levels.pop()
        apart = F.bit_count(only("a", "b").bitwiseOR(only("b", "a")))
        further = "next_a <= next_b" if levels else "next_a < next_b"
        pairs = written(pairs.join(side(nodes, "a"), [*quarter, "a"]).join(side(nodes, "b"), [*quarter, "b"])
                        .filter(F.expr(further) & (apart <= distance))
                        .select(*quarter, F.col("next_a").alias("a"), F.col("next_b").alias("b")))
    place = base.select(*quarter, "node", "first")
    named = (pairs.join(place.select(*quarter, F.col("node").alias("a"), F.col("first").alias("first_a")), [*quarter, "a"])
             .join(place.select(*quarter, F.col("node").alias("b"), F.col("first").alias("first_b")), [*quarter, "b"]))
    return named.select("turn", "first_a", "first_b").distinct()


def links(prints: DataFrame, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """Links ``(a long, b long)`` between distinct fingerprints: enough of them to hang together all that are close."""
    index = written(leaves(prints, leaf))

    def own(batches):
        for batch in batches:
            for turn, ranks in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from _forest(turn, np.frombuffer(ranks.as_buffer(), "<u8"), None, fan).to_batches()

    def between(key: tuple[pa.Scalar, ...], pair: pa.Table) -> pa.Table:
        turn = key[0].as_py()
        one, two = [np.frombuffer(r, "<u8") for _, r in sorted(zip(pair.column("first").to_pylist(),
                                                                   pair.column("ranks").to_pylist()))]
        return _forest(turn, one, two, fan)

    inside = index.select("turn", "ranks").mapInArrow(own, "a long, b long")
    pairs = leaf_pairs(index, fan)
    if pairs is None:
        return inside
    ends = pairs.withColumn("first", F.explode(F.array("first_a", "first_b")))
    met = ends.join(index.select("turn", "first", "ranks"), ["turn", "first"])
    return inside.union(met.select("turn", "first_a", "first_b", "first", "ranks")
                        .groupBy("turn", "first_a", "first_b").applyInArrow(between, "a long, b long"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", leaf: int = LEAF,
                    fan: int = FAN) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row of ``docs``.

    A null or empty text has fingerprint zero, which links like any other; rows that repeat have one fingerprint and
    are one node. ``component_id`` is the smallest doc_id that can be reached, null ids aside; it is null where no row
    of the component has an id. An empty table gives an empty result; other columns are not read.
    """
    rows = written(fingerprints(docs, doc_id, text))
    nodes = written(rows.groupBy("print").agg(F.min("doc_id").alias("first_id")))
    labels = components(links(nodes.select("print"), leaf, fan))
    placed = nodes.join(labels.withColumnRenamed("node", "print"), "print", "left").select(
        "print", "first_id", F.coalesce("label", "print").alias("label"))
    least = placed.groupBy("label").agg(F.min("first_id").alias("component_id"))
    homes = placed.join(least, "label").select("print", "component_id")
    return rows.join(homes, "print").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), BITS // 4, "0").alias("fingerprint"), "component_id")


def op13_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
