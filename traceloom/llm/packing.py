"""Documents packed into windows of a context length by the sum-of-squares rule.

Online: each document goes to the fill level that makes the sum of the squared counts of partly filled windows
smallest, told from an array of counts by level. Each Spark partition packs its own rows as they come, so nothing is
shuffled and no task holds more than its open windows. Documents longer than a window are cut into full windows and a
rest, and the rest is placed. When a partition ends, the emptiest open windows are cut up to fill the fullest, which
leaves one; its ids are cut at powers of two, where sequences need no padding.
"""

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_tree import vocabulary_path
from .tokens import encoder, little_endian

WINDOW, END_ID = 2048, 1
#: Open windows a task holds at most; beyond it they fill each other up, as at the end of a partition.
MAX_OPEN = 4096
PIECE = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
         "ids binary")


class SumOfSquares:
    """Open windows by level. A piece is ``(doc_id, start, ids as bytes, doc_tokens)``, four bytes an id."""

    def __init__(self, size: int = WINDOW, max_open: int = MAX_OPEN):
        self.size, self.max_open = size, max_open
        self.counts = np.zeros(size + 1, np.int64)           # the level array
        self.open = [[] for _ in range(size + 1)]            # windows by level, each a list of pieces
        self.n_open = 0

    def level_for(self, n: int) -> int:
        """The level whose windows take ``n`` ids at the least sum of squares; 0 is a new window.

        From level h to h+n the sum changes by 2(N[h+n] - N[h] + 1), from h to a full window by 1 - 2 N[h], and a
        new window adds 2 N[n] + 1. Of equal changes the fullest window is taken, a new one last.
        """
        size, counts = self.size, self.counts
        best, at = (2 * int(counts[n]) + 1 if n < size else 0), 0
        if n < size:
            change = 2 * (counts[n + 1:size] - counts[1:size - n] + 1)
            change[counts[1:size - n] == 0] = np.iinfo(np.int64).max
            if len(change):
                back = int(np.argmin(change[::-1]))
                level = len(change) - back
                if change[level - 1] <= best:
                    best, at = int(change[level - 1]), level
            if counts[size - n] and 1 - 2 * int(counts[size - n]) <= best:
                at = size - n
        return at

    def put(self, piece) -> list:
        """Place a piece shorter than a window; returns the windows that are full now."""
        n = len(piece[2]) // 4
        level = self.level_for(n)
        window = self.open[level].pop() if level else []
        if level:
            self.counts[level] -= 1
            self.n_open -= 1
        window.append(piece)
        if level + n == self.size:
            return [window]
        self.open[level + n].append(window)
        self.counts[level + n] += 1
        self.n_open += 1
        if self.n_open <= self.max_open:
            return []
        full, rest = self.settle()
        if rest:
            level = sum(len(p[2]) for p in rest) // 4
            self.open[level].append(rest)
            self.counts[level] += 1
            self.n_open += 1
        return full

    def settle(self) -> tuple[list, list]:
        """Empty all levels: the emptiest windows are cut up to fill the fullest. Full windows, and what is left."""
        windows = [w for level in self.open for w in level]              # emptiest first
        self.open, self.n_open = [[] for _ in range(self.size + 1)], 0
        self.counts[:] = 0
        full, give = [], []
        low, high = 0, len(windows) - 1
        while low <= high:
            window = windows[high]
            room = self.size - sum(len(p[2]) for p in window) // 4
            while room and (give or low < high):
                if not give:
                    give, low = windows[low][::-1], low + 1
                doc_id, start, ids, total = give.pop()
                if len(ids) > 4 * room:
                    give.append((doc_id, start + room, ids[4 * room:], total))
                    ids = ids[:4 * room]
                window.append((doc_id, start, ids, total))
                room -= len(ids) // 4
            if room:
                return full, window
            full.append(window)
            high -= 1
        return full, give[::-1]


def powers_of_two(window: list) -> list[list]:
    """The pieces of a window cut into sequences whose lengths are powers of two, largest first."""
    left, sequences = sum(len(p[2]) for p in window) // 4, []
    pieces = window[::-1]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        sequences.append([])
        while room:
            doc_id, start, ids, total = pieces.pop()
            if len(ids) > 4 * room:
                pieces.append((doc_id, start + room, ids[4 * room:], total))
                ids = ids[:4 * room]
            sequences[-1].append((doc_id, start, ids, total))
            room -= len(ids) // 4
    return sequences


@lru_cache(maxsize=1)
def _schema(with_ids: bool) -> pa.Schema:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    fields = [pa.field(n, pa.int64()) for n in names]
    return pa.schema(fields + [pa.field("ids", pa.binary())] if with_ids else fields)


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, max_open: int = MAX_OPEN,
         with_ids: bool = True, path: str | None = None, doc_id: str = "doc_id",
         text: str = "text") -> DataFrame:
    """One row per piece: which ids of which document stand where in which sequence.

    A document's ids are those of its whole text and ``end_id``; a null or empty text is ``end_id`` alone. Every id
    stands in exactly one piece. ``ids`` (left out on request) holds the piece's ids, unsigned 32-bit little-endian.
    ``sequence_id`` is the partition's number and a count; rows that repeat an id, or have none, are packed like
    others and can only be told apart by where they stand. An empty table has no pieces. Extra columns are ignored.
    """
    path = path or vocabulary_path()

    def run(batches):
        encode, packer = encoder(path), SumOfSquares(window, max_open)
        numbers = iter(range(TaskContext.get().partitionId() << 32, 1 << 63))
        rows = []

        def emit(sequence):
            number, offset = next(numbers), 0
            for own, start, ids, total in sequence:
                length = len(ids) // 4
                rows.append((own, start, length, zlib.crc32(ids), total, number, offset, ids))
                offset += length

        def flushed():
            schema = _schema(with_ids)
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=False)], schema=schema)
            rows.clear()
            return batch

        for batch in batches:
            own_ids = batch.column(0).cast(pa.int64()).to_pylist()
            for at in range(0, batch.num_rows, 256):
                for own, t in zip(own_ids[at:at + 256], batch.column(1).slice(at, 256).to_pylist(), strict=True):
                    coded = encode(t) if t else []
                    coded.append(end_id)
                    total, ids = len(coded), little_endian(coded)
                    cut = total - total % window
                    for start in range(0, cut, window):
                        emit([(own, start, ids[4 * start:4 * (start + window)], total)])
                    if total > cut:
                        for full in packer.put((own, cut, ids[4 * cut:], total)):
                            emit(full)
                if len(rows) >= 1024:
                    yield flushed()
        full, rest = packer.settle()
        for sequence in full + powers_of_two(rest):
            emit(sequence)
        if rows:
            yield flushed()

    schema = PIECE if with_ids else PIECE.removesuffix(", ids binary")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text).mapInArrow(run, schema)


def op3_packing(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
