"""Ranked search against brute force over all documents, and the index's bounds."""

import math
import random
import re

import numpy as np
import pytest

from corpus_samples import COLUMNS, long_text
from traceloom.llm import lexical_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEM = "item_id long, text string, doc_id long, shard string"


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k=10):
    counts = [{t: own.count(t) for t in set(own)} for own in (terms(t) for _, t in docs)]
    sizes = [sum(c.values()) for c in counts]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = {}
    for c in counts:
        for t in c:
            df[t] = df.get(t, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, own in asked.items():
        found = []
        for (d, _), c, n in zip(docs, counts, sizes):
            if n:
                m = 100 - 90 + 90 * n * n_docs // total
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                            * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
                if score > 0:
                    found.append((-score, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def rows(found):
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_terms():
    for t in ["Ab-c_d9 É\xa0x y İ\x00z", "", None, "__", "a" * 5000, "\U0001f600 ok"]:
        assert [x.decode() for x in S.terms_of(t)] == terms(t)


@pytest.mark.parametrize("postings, documents, block", [(60, 7, 3), (S.POSTINGS, S.DOCUMENTS, S.QUERIES)])
def test_as_brute_force(spark, few_docs, postings, documents, block):
    docs = [(r["doc_id"], r["text"]) for r in few_docs.collect()]
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    found = S.search(few_docs, items, postings=postings, documents=documents, block=block)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(found) == brute(docs, [(r["item_id"], r["text"]) for r in items.collect()])


def test_odd_rows_ties_and_long_texts(spark, odd_docs, no_docs):
    many = [(100 - i, "tie of equal words") for i in range(30)] + [(None, "tie words"), (None, "tie words")]
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()] + many
    table = spark.createDataFrame([(d, t, "en", "s", 1, "x") for d, t in docs], COLUMNS)
    items = [(1, "TIE of words, tie"), (2, None), (3, ""), (4, "unknownword"), (None, "text"), (None, "second row id"),
             (5, long_text(1)), (6, "äé SS İstanbul kelvin"), (6, "same"), (6, "same")]
    asked = spark.createDataFrame([(i, t, 7, "x") for i, t in items], ITEM)
    for k in (1, 10):
        assert rows(S.search(table, asked, k=k, postings=40, documents=5)) == brute(docs, items, k)
    assert rows(S.search(no_docs, asked)) == [] == rows(S.search(table, asked.limit(0)))
    nothing = spark.createDataFrame([(1, None), (2, ""), (3, "--")], "doc_id long, text string")
    assert rows(S.search(nothing, asked)) == []


def test_strata_are_left_out_by_their_bounds():
    rng = random.Random(3)
    n = np.array([rng.randint(1, 4000) for _ in range(3000)])
    doc, term, tf = [], [], []
    for d in range(3000):
        for t in rng.sample(range(40), rng.randint(1, 12)):
            doc.append(d)
            term.append(t)
            tf.append(rng.randint(1, 2))
    index = S.StratifiedIndex(n, np.array(doc), np.array(term), np.array(tf), 3000, int(n.sum()))
    assert len(np.unique(index.m)) == len(index.m) < 3000
    visited = []
    plain = np.add.at

    class Counting:
        @staticmethod
        def at(scores, docs, values):
            visited.append(len(docs))
            plain(scores, docs, values)

    terms_, weights = np.arange(6), np.array([9, 8, 7, 3, 2, 1])
    S.np.add, kept = Counting, S.np.add
    try:
        found, scores = index.best(terms_, weights, 5, np.arange(3000))
    finally:
        S.np.add = kept
    want = np.zeros(3000, np.int64)
    m = S.BASE + S.SLOPE * n * 3000 // int(n.sum())
    for d, t, f in zip(doc, term, tf):
        if t < 6:
            want[d] += weights[t] * (S.SCALE * f // (S.A * f + S.B * m[d]))
    order = np.lexsort((np.arange(3000), -want))[:5]
    assert found.tolist() == order.tolist() and scores.tolist() == want[order].tolist()
    assert sum(visited[1:]) < 0.5 * sum(t < 6 for t in term)      # the first call sums the bounds
