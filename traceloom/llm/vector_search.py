"""Exact top-k inner products by columnar branch and bound.

Vectors are held in slabs in vertical layout, one row of memory per dimension. Scores of a block of queries are
accumulated dimension block by dimension block; what the dimensions still to come can add is bounded by the mass
(norm) that remains on both sides, and candidates whose bound stays below the k-th best score so far are compacted
away. Groups of queries meet slabs of candidates in a grouped job, so a task holds one of each and goes through the
group block by block. Every vector travels once per group of queries, every query once per slab, as small integers.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import written

TOP_K, SCALE, EVERY = 20, 64, 20
#: Rows of a slab of candidates and of a group of queries, and of a block inside it; columns looked at together, and
#: dimensions of a step.
SLAB, QUERIES, BLOCK, COLUMNS, STEP = 32_768, 8192, 512, 4096, 16
_BLOB = "part long, ids binary, numbers binary, cells binary, dims int, kind string"


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id long, x array<double>, number long)``; ``number`` tells rows apart, also those that share a ``vec_id``.

    Null ids, null or empty vectors and vectors that hold nulls, NaN or infinities take no part.
    """
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    fits = F.forall("x", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)) & ~F.isnan(v))
    return written(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x"))
                   .filter(F.col("vec_id").isNotNull() & (F.size("x") > 0) & fits)
                   .withColumn("number", F.monotonically_increasing_id()))


def _blobs(vectors: DataFrame, parts: int, scale: int) -> DataFrame:
    """Vectors dealt into ``parts``, each one row: ids, numbers, and cells in vertical layout.

    A cell is the floor of ``scale`` times a component, held in as few bytes as the part needs.
    """
    def build(part: pa.Table) -> pa.Table:
        x = part.column("x").combine_chunks()
        width = np.diff(x.offsets.to_numpy())
        dims, most = int(width.max()), np.finfo(float).max
        matrix = np.zeros((len(width), dims))                       # shorter vectors go on in zeros
        with np.errstate(over="ignore"):
            matrix[np.arange(dims)[None, :] < width[:, None]] = np.clip(
                np.floor(x.flatten().to_numpy(zero_copy_only=False) * scale), -most, most)
        high = np.abs(matrix).max()
        kind = next((k for k, bits in (("<i2", 15), ("<i4", 31)) if high < 2 ** bits), "<f8")
        ids, numbers = (part.column(c).to_numpy().astype("<i8") for c in ("vec_id", "number"))
        order = np.lexsort((numbers, ids))
        return pa.table({"part": pa.array([part.column("part")[0].as_py()], pa.int64()),
                         "ids": pa.array([ids[order].tobytes()], pa.binary()),
                         "numbers": pa.array([numbers[order].tobytes()], pa.binary()),
                         "cells": pa.array([np.ascontiguousarray(matrix[order].T).astype(kind).tobytes()], pa.binary()),
                         "dims": pa.array([dims], pa.int32()), "kind": pa.array([kind])})

    dealt = vectors.withColumn("part", F.pmod(F.xxhash64("number"), F.lit(parts)).cast("long"))
    return dealt.select("part", "vec_id", "x", "number").groupBy("part").applyInArrow(build, _BLOB)


def _read(blob: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, numbers = (np.frombuffer(blob[c], "<i8") for c in ("ids", "numbers"))
    return ids, numbers, np.frombuffer(blob["cells"], blob["kind"]).reshape(blob["dims"], len(ids)).astype(float)


def _exact_scores(q: np.ndarray, c: np.ndarray, high: float) -> np.ndarray:
    """Scores where floats are not exact; one that no long holds stops at its end."""
    if high < 2 ** 62:
        return q.T.astype(np.int64) @ c.astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(q.T) @ whole(c), -2 ** 63, 2 ** 63 - 1)


class BranchAndBound:
    """The k best candidates of each of a block of queries; ``queries`` and candidates are (dimensions, rows)."""

    def __init__(self, query_ids: np.ndarray, query_numbers: np.ndarray, queries: np.ndarray, k: int, step: int = STEP):
        self.ids, self.numbers, self.queries, self.k, self.step = query_ids, query_numbers, queries, k, step
        self.best = [np.empty((3, 0), np.int64) for _ in query_ids]                # scores, ids, numbers
        self.floor = np.full(len(query_ids), -np.inf)

    def offer(self, ids: np.ndarray, numbers: np.ndarray, cells: np.ndarray) -> None:
        dims = max(len(self.queries), len(cells))
        q = np.pad(self.queries, ((0, dims - len(self.queries)), (0, 0)))
        c = np.pad(cells, ((0, dims - len(cells)), (0, 0)))
        high = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * dims
        if high >= 2 ** 52:
            scores = _exact_scores(q, c, high)
            for at in range(len(self.ids)):
                self.take(at, ids, numbers, scores[at].astype(np.int64))
            return
        order = np.argsort(-(c ** 2).sum(1), kind="stable")      # dimensions of most mass first
        q, c = q[order], c[order]
        cuts = range(0, dims, self.step)
        q_left = [np.sqrt((q[e + self.step:] ** 2).sum(0)) for e in cuts]
        for start in range(0, len(ids), COLUMNS):
            own, own_numbers, part = (a[..., start:start + COLUMNS] for a in (ids, numbers, c))
            if np.isneginf(self.floor).any():
                scores = q.T @ part
                for at in range(len(self.ids)):
                    self.take(at, own, own_numbers, scores[at].astype(np.int64))
                continue
            c_left = [np.sqrt((part[e + self.step:] ** 2).sum(0)) for e in cuts]
            first = q[:self.step].T @ part[:self.step]
            bound = first + np.outer(q_left[0], c_left[0])
            for at in range(len(self.ids)):
                alive = np.flatnonzero(bound[at] >= self.floor[at] - 0.5)
                score = first[at, alive]
                for n, e in list(enumerate(cuts))[1:]:
                    if not len(alive):
                        break
                    score = score + q[e:e + self.step, at] @ part[e:e + self.step, alive]
                    keep = score + q_left[n][at] * c_left[n][alive] >= self.floor[at] - 0.5
                    alive, score = alive[keep], score[keep]
                if len(alive):
                    self.take(at, own[alive], own_numbers[alive], np.rint(score).astype(np.int64))

    def take(self, at: int, ids: np.ndarray, numbers: np.ndarray, scores: np.ndarray) -> None:
        """Merge candidates into the best of query ``at``: larger scores first, then smaller ids."""
        new = np.stack([scores, ids, numbers])[:, numbers != self.numbers[at]]
        if new.shape[1] > 4 * self.k:
            least = np.partition(new[0], new.shape[1] - self.k)[new.shape[1] - self.k]
            new = new[:, new[0] >= least]
        both = np.concatenate([self.best[at], new], axis=1)
        self.best[at] = both[:, np.lexsort((both[2], both[1], ~both[0]))[:self.k]]
        if self.best[at].shape[1] == self.k:
            self.floor[at] = float(self.best[at][0, -1])

    def table(self) -> pa.Table:
        sizes = [b.shape[1] for b in self.best]
        scores, ids, numbers = np.concatenate(self.best, axis=1)
        return pa.table({"query_id": pa.array(np.repeat(self.ids, sizes), pa.int64()),
                         "query_number": pa.array(np.repeat(self.numbers, sizes), pa.int64()),
                         "vec_id": pa.array(ids, pa.int64()), "number": pa.array(numbers, pa.int64()),
                         "score": pa.array(scores, pa.int64())})


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int = TOP_K, scale: int = SCALE, slab: int = SLAB,
                       group: int = QUERIES, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best candidates of each query, or all if there are fewer.

    Both inputs are rows of one table of :func:`usable`. A query's own row is no candidate of its own; another row of
    the same id is, and rows that repeat a query's id are queries each. Equal scores go to the smaller id. Scores that
    no long holds stop at its end. No vectors or no queries give no rows.
    """
    n, m = vectors.count(), queries.count()
    slabs, groups = max(1, -(-n // slab)), max(1, -(-m // group))
    held = ("ids", "numbers", "cells", "dims", "kind")
    left = (_blobs(queries, groups, scale).select(F.col("part").alias("qg"), *held)
            .withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1)))))
    right = (_blobs(vectors, slabs, scale).select(F.col("part").alias("slab"), *held)
             .withColumn("qg", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))))
    columns = ("query_id", "query_number", "vec_id", "number", "score")

    def search(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        if not ours.num_rows or not theirs.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in columns})
        ids, numbers, cells = _read(ours.to_pylist()[0])
        candidates, found = _read(theirs.to_pylist()[0]), []
        for at in range(0, len(ids), block):
            part = BranchAndBound(*(a[..., at:at + block] for a in (ids, numbers, cells)), k)
            part.offer(*candidates)
            found.append(part.table())
        return pa.concat_tables(found)

    keys = [F.col("qg").cast("long"), F.col("slab").cast("long")]
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        search, ", ".join(f"{c} long" for c in columns))
    best = Window.partitionBy("query_number").orderBy(F.col("score").desc(), "vec_id", "number")
    return (pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op8_top_k(spark, sf_dir):
    vectors = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_inner_products(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


ORACLE = f"""
    WITH cells AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
                   FROM embeddings),
    scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                      CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
               FROM cells AS q JOIN cells AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {TOP_K}"""
