"""Ranked lexical search over a length-stratified index.

A document's length enters its score through one number, the normaliser ``m``. Documents of equal ``m`` are a stratum;
within it the impact of a term depends on its frequency ``tf`` alone, so it is computed once per ``tf``. Postings lie
by term, then stratum, then falling ``tf``: the first of a term and stratum is the most the term can add there, and
the sum of these firsts, weighted, bounds the score of every document of the stratum. A query visits strata by falling
bound and ends when the next bound is below its k-th best score. Everything is 64-bit integers, so bounds are exact.

Documents are cut into shards of bounded size as they are read, each with an index of its own; blocks of queries are
copied to the shards and meet them in a grouped job. Counts over the corpus come before, from the same term vectors.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import written
from .common import LOWER, UPPER, table

TOP_K = 10
#: Fixed values of the score: the normaliser is BASE + SLOPE * n / mean n, the impact SCALE * tf / (A * tf + B * m).
BASE, SLOPE, SCALE, A, B, WEIGHT = 10, 90, 1_000_000_000, 1000, 8, 1000
#: Postings and documents of a shard at most (a longer text is a shard of its own), and queries of a block.
POSTINGS, DOCUMENTS, QUERIES = 1 << 20, 16_384, 4096
#: Strata visited at first; twice as many each time after.
FIRST = 8
_SEQ = 1 << 20
_VECTOR = "shard long, doc_id long, n long, terms array<long>, counts array<long>"
#: What is no part of a term becomes a blank: ASCII but for letters and digits. A-Z are lowered, other bytes stay.
_BYTES = bytes(c if c >= 128 or chr(c).isdigit() or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32
               for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a whole text in order, as UTF-8."""
    return (text or "").encode().translate(_BYTES).split()


def _vector(text: str | None) -> tuple[int, list[int], list[int]]:
    """Number of terms; hashes of the distinct ones, and how often each stands in the text."""
    from collections import Counter
    from xxhash import xxh3_64_intdigest
    terms = terms_of(text)
    counts = Counter(terms)
    return len(terms), [xxh3_64_intdigest(t) for t in counts], list(counts.values())


def _lists(values: list[list[int]], kind) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum([len(v) for v in values])].astype(np.int32)
    flat = np.fromiter((x for v in values for x in v), kind, offsets[-1])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def term_vectors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", postings: int = POSTINGS,
                 documents: int = DOCUMENTS) -> DataFrame:
    """``(shard, doc_id, n, terms, counts)`` of every row: how many terms, the distinct ones by hash, their counts.

    Rows that follow one another share a shard until it holds ``postings`` or ``documents``. A term is held by its
    64-bit hash: of a billion words, one meets another's with probability 0.03, and one of a query far less.
    """
    def run(batches):
        first, seq, held, rows = TaskContext.get().partitionId() * _SEQ, 0, 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                shards, sizes, terms, counts = [], [], [], []
                for t in part.column(1).to_pylist():
                    n, own, times = _vector(t)
                    if rows and (held + len(own) > postings or rows >= documents):
                        seq, held, rows = seq + 1, 0, 0
                    held, rows = held + len(own), rows + 1
                    shards.append(first + seq)
                    sizes.append(n)
                    terms.append(own)
                    counts.append(times)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shards, pa.int64()), part.column(0), pa.array(sizes, pa.int64()),
                     _lists(terms, np.uint64), _lists(counts, np.int64)], names=["shard", "doc_id", "n", "terms", "counts"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _VECTOR)


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``(item_id, term)``, each distinct term of an item once; rows that share an id are one item."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), _lists([_vector(t)[1] for t in part.column(1).to_pylist()], np.uint64)],
                    names=["item_id", "terms"])

    made = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).mapInArrow(
        run, "item_id long, terms array<long>")
    return made.select("item_id", F.explode("terms").alias("term")).distinct()


class StratifiedIndex:
    """The index of one shard over the terms that are asked for."""

    def __init__(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, documents: int, terms: int):
        """``n``: terms of each document; postings ``(doc, term, tf)``; documents and terms of the whole corpus."""
        lengths, at = np.unique(n, return_inverse=True)
        m = np.array([BASE + SLOPE * int(x) * documents // terms for x in lengths], np.int64)
        self.m, stratum = np.unique(m, return_inverse=True)
        stratum = stratum[at][doc]                                                # of each posting
        order = np.lexsort((-tf, stratum, term))
        self.doc, term, stratum, tf = doc[order], term[order], stratum[order], tf[order]
        seen, back = np.unique(np.stack([stratum, tf]), axis=1, return_inverse=True)   # one impact per stratum and tf
        self.impact = (SCALE * seen[1] // (A * seen[1] + B * self.m[seen[0]]))[back.ravel()]
        new = np.r_[True, (term[1:] != term[:-1]) | (stratum[1:] != stratum[:-1])] if len(term) else np.zeros(0, bool)
        self.start = np.flatnonzero(new)
        self.end = np.r_[self.start[1:], len(term)].astype(np.int64)
        self.stratum, self.term, self.most = stratum[self.start], term[self.start], self.impact[self.start]
        self.scores = np.zeros(len(n), np.int64)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, key: np.ndarray):
        """``(documents, scores)``: the ``k`` best, larger scores first and then by ``key``; scores are above 0."""
        low, high = np.searchsorted(self.term, terms), np.searchsorted(self.term, terms, "right")
        groups, weight = _ranges(low, high), np.repeat(weights, high - low)
        bound = np.zeros(len(self.m), np.int64)
        np.add.at(bound, self.stratum[groups], weight * self.most[groups])
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        found, scores, at, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, FIRST
        while at < len(order) and (len(found) < k or bound[order[at]] >= scores[-1]):
            visit = np.zeros(len(self.m), bool)
            visit[order[at:at + step]] = True
            here = visit[self.stratum[groups]]
            start, end = self.start[groups[here]], self.end[groups[here]]
            postings = _ranges(start, end)
            doc = self.doc[postings]
            np.add.at(self.scores, doc, np.repeat(weight[here], end - start) * self.impact[postings])
            doc = np.unique(doc)
            new = self.scores[doc]
            self.scores[doc] = 0
            keep = new > 0
            if len(found) == k:
                keep &= new >= scores[-1]
            found, scores = np.r_[found, doc[keep]], np.r_[scores, new[keep]]
            top = np.lexsort((key[found], -scores))[:k]
            found, scores = found[top], scores[top]
            at, step = at + step, 2 * step
        return found, scores


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The whole numbers of all ranges, one range after the other."""
    size = end - start
    return np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(size) else start


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    lists = column.combine_chunks()
    return np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()


def ranked(vectors: DataFrame, terms: DataFrame, k: int = TOP_K, block: int = QUERIES) -> DataFrame:
    """``(item_id, rank, doc_id, score)`` for rows of :func:`term_vectors` (a written table) and :func:`item_terms`."""
    whole = vectors.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms"),
                        F.max(F.col("shard") % _SEQ).alias("seq"), F.max(F.floor(F.col("shard") / _SEQ)).alias("part")).first()
    asked = terms.select("term").distinct()
    df = (vectors.select(F.explode("terms").alias("term")).join(asked, "term", "left_semi")
          .groupBy("term").agg(F.count("*").alias("df")))
    documents, total = whole["documents"], whole["terms"] or 0
    ratio = F.lit(float(2 * documents + 2)) / (2 * F.col("df") + 1).cast("double")
    weighted = terms.join(df, "term").select("item_id", "term", F.floor(F.lit(float(WEIGHT)) * F.log(ratio)).alias("w"))
    items = written(weighted.groupBy("item_id").agg(F.collect_list(F.struct("term", "w")).alias("x"))
                    .select("item_id", F.col("x.term").alias("terms"), F.col("x.w").alias("weights")))
    blocks = max(1, -(-items.count() // block))
    shards = vectors.select("shard").distinct()
    right = (items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks).cast("long")))
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(whole["part"] or 0).cast("int"))))
             .withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(whole["seq"] or 0).cast("int"))))
             .withColumn("shard", F.col("part") * F.lit(_SEQ).cast("long") + F.col("seq")).join(shards, "shard", "left_semi"))
    left = vectors.filter("n > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def search(docs: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"item_id": [], "doc_id": [], "score": []}
        if docs.num_rows and queries.num_rows:
            sizes, own = _flat(docs.column("terms"))
            doc = np.repeat(np.arange(docs.num_rows), sizes)
            asks, theirs = _flat(queries.column("terms"))
            words, theirs = np.unique(theirs, return_inverse=True)
            place = np.minimum(np.searchsorted(words, own), len(words) - 1)
            hit = words[place] == own
            index = StratifiedIndex(docs.column("n").to_numpy(), doc[hit], place[hit],
                                    _flat(docs.column("counts"))[1][hit], documents, total)
            ids = docs.column("doc_id").combine_chunks()
            plain, none = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
            key = np.empty(len(plain), np.int64)
            key[np.lexsort((plain, none))] = np.arange(len(plain))              # null ids come last
            weights, ends = _flat(queries.column("weights"))[1], np.cumsum(asks)
            for item, begin, end in zip(queries.column("item_id").to_pylist(), ends - asks, ends):
                found, scores = index.best(theirs[begin:end], weights[begin:end], k, key)
                out["item_id"] += [item] * len(found)
                out["doc_id"] += ids.take(pa.array(found)).to_pylist()
                out["score"] += scores.tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    keys = ["shard", "block"]
    best = (left.groupBy(*keys).cogroup(right.groupBy(*keys))
            .applyInArrow(search, "item_id long, doc_id long, score long"))
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))


def search(docs: DataFrame, items: DataFrame, k: int = TOP_K, postings: int = POSTINGS, documents: int = DOCUMENTS,
           block: int = QUERIES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents above 0 of each item, or all if there are fewer.

    Null and empty texts hold no terms and are found by nothing; an item without terms that occur finds nothing.
    Equal scores go by doc_id, null ids last. Each row of ``docs`` is a document, also where rows repeat; rows of
    ``items`` that share an id (or have none) are one item. Empty tables give no rows; other columns are not read.
    """
    return ranked(written(term_vectors(docs, postings=postings, documents=documents)), written(item_terms(items)), k, block)


def op12_lexical_search(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = (f"unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))")
ORACLE = f"""
    WITH rows AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
    postings AS (SELECT r, term, count(*) AS tf FROM (SELECT r, {_TERMS} AS term FROM rows) GROUP BY r, term),
    sizes AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM postings GROUP BY r),
    whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
    normal AS (SELECT r, {BASE} + ({SLOPE} * n * docs) // terms AS m FROM sizes, whole),
    weights AS (SELECT term, CAST(floor({WEIGHT} * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
                FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), whole),
    asked AS (SELECT DISTINCT item_id, {_TERMS} AS term FROM benchmark),
    scored AS (SELECT item_id, r, CAST(sum(w * (({SCALE} * tf) // ({A} * tf + {B} * m))) AS BIGINT) AS score
               FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN normal USING (r) GROUP BY item_id, r),
    placed AS (SELECT item_id, doc_id, score,
                      row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
               FROM scored JOIN rows USING (r) WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM placed WHERE rank <= {TOP_K}"""
