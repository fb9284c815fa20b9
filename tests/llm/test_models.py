"""Language-model scores and quality posteriors against brute force and on held-out rows."""

import itertools
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from traceloom.llm.hmm import ROW_GROUPS, Chunk, Hmm, _listed, chunks, score_texts
from traceloom.llm.quality_model import classify, evidence, fit, site_posteriors
from traceloom.session import written

from corpus_samples import COLUMNS


def _held(own):
    return own is None or zlib.crc32(str(own).encode()) % 10 == 0


def _words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in lowered.translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if w]


def _base(rows):
    counts = Counter()
    for own, text in rows:
        if not _held(own):
            counts.update([*_words(text), None])
    total, scale = counts.total(), counts.total() + 0.1 * (len(counts) + 1)
    out = []
    for own, text in rows:
        tokens = [*_words(text), None]
        out.append((own, _held(own), len(tokens), sum(counts[t] > 0 for t in tokens), total,
                    sum(math.log10((counts[t] + 0.1) / scale) for t in tokens)))
    return out


def _key(r):
    return (r[0] is None, r[0] or 0, r[2], r[5])


@pytest.mark.parametrize("hashed, at_once", [(32_768, 1_000_000), (16, 5000)])
def test_base_scores_as_brute_force(few_docs, odd_docs, no_docs, hashed, at_once):
    for docs in (few_docs, odd_docs):
        want = sorted(_base([(r["doc_id"], r["text"]) for r in docs.collect()]), key=_key)
        rows = score_texts(docs, hashed=hashed, rounds=1, at_once=at_once).collect()
        got = sorted([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"])
                      for r in rows], key=_key)
        for a, b in zip(want, got, strict=True):
            assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
    assert score_texts(no_docs).count() == 0


def _by_paths(model, sequence):
    """The probability of a sequence as the sum over all paths of states."""
    k = len(model.initial)
    return sum(model.initial[p[0]] * model.emits[sequence[0], p[0]] * math.prod(
        model.moves[a, b] * model.emits[s, b] for a, b, s in zip(p, p[1:], sequence[1:], strict=False))
        for p in itertools.product(range(k), repeat=len(sequence)))


def _random_model(rng, k=3, symbols=5):
    a, b, c = rng.random(k), rng.random((k, k)), rng.random((symbols, k))
    return Hmm(a / a.sum(), b / b.sum(1, keepdims=True), c / c.sum(0))


def test_forward_and_expected_counts_as_all_paths():
    rng = np.random.default_rng(1)
    model = _random_model(rng)
    sequences = [rng.integers(0, 5, n) for n in (1, 2, 5, 6, 6, 3)]
    exact = [_by_paths(model, s) for s in sequences]
    assert 10 ** model.log10_likelihoods(sequences) == pytest.approx(exact, rel=1e-10)
    first, pairs, emitted = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for s, total in zip(sequences, exact, strict=True):
        for p in itertools.product(range(3), repeat=len(s)):
            w = model.initial[p[0]] * math.prod(model.emits[x, q] for x, q in zip(s, p, strict=True)) * math.prod(
                model.moves[a, b] for a, b in zip(p, p[1:], strict=False)) / total
            first[p[0]] += w
            for a, b in zip(p, p[1:], strict=False):
                pairs[a, b] += w
            for x, q in zip(s, p, strict=True):
                emitted[x, q] += w
    got = model.expected(sequences)
    for a, b in zip((first, pairs, emitted), got, strict=True):
        assert a == pytest.approx(b, rel=1e-9)


def test_training_raises_the_likelihood_and_held_out_scores(spark, few_docs):
    rng = np.random.default_rng(3)
    data = [rng.integers(0, 40, n).astype("<u2") for n in rng.integers(1, 60, 50)]
    df = spark.createDataFrame([(s.tobytes(),) for s in data], "classes binary").repartition(3)
    model, last = Hmm.started(np.bincount(np.concatenate(data), minlength=40) / 1500, 3), -math.inf
    for _ in range(4):
        now = model.log10_likelihoods(data).sum()
        assert now > last
        last, model = now, model.trained(df)
    rows = [r for r in score_texts(few_docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def _forward_backward(start, moves, emits):
    """Likelihood and (state, transition) probabilities of one sequence, step by step."""
    alpha, beta = [start * emits[0]], [np.ones(len(start))]
    for e in emits[1:]:
        alpha.append(alpha[-1] @ moves * e)
    for e in emits[:0:-1]:
        beta.append(moves @ (e * beta[-1]))
    beta.reverse()
    p = alpha[-1].sum()
    pairs = sum((np.outer(a, e * b) * moves / p for a, e, b in zip(alpha, emits[1:], beta[1:], strict=False)),
                np.zeros((len(start), len(start))))
    return p, [a * b / p for a, b in zip(alpha, beta, strict=True)], pairs


@pytest.mark.parametrize("hashed", [1000, 5])
def test_scores_as_brute_force(spark, hashed):
    """The whole of the model, recomputed word by word: tied rounds, the untied round, and each text's score."""
    rng, k = random.Random(8), 4
    vocabulary = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(40)], k=rng.randint(0, 25))))
            for i in range(60)] + [(5, "W1 w2"), (None, "never seen w1"), (61, None)]
    texts = [[*_words(t), ""] for _, t in rows]
    training = [t for t, (own, _) in zip(texts, rows, strict=True) if not _held(own)]
    counts = Counter(w for t in training for w in t)
    classes = {w: zlib.crc32(w.encode()) % hashed for t in texts for w in t}
    tied = Hmm.started(np.full(hashed, 1 / hashed), k)
    start, moves, emits = tied.initial, tied.moves, tied.emits
    for last in (False, False, True):
        first, pairs, by_class = np.ones(k), np.ones((k, k)), np.full(emits.shape, 0.1)
        by_word = {w: np.zeros(k) for w in counts}
        for t in training:
            _, states, edges = _forward_backward(start, moves, [emits[classes[w]] for w in t])
            first, pairs = first + states[0], pairs + edges
            for w, s in zip(t, states, strict=True):
                by_class[classes[w]] += s
                by_word[w] += s
        start, moves = first / first.sum(), pairs / pairs.sum(1, keepdims=True)
        if not last:
            emits = by_class / by_class.sum(0)
    dealt = sum(by_word.values()) / counts.total()
    mass = {w: (by_word[w] + 2 * dealt) / (c + 2) * (c + 0.1) for w, c in counts.items()}
    unseen = 0.1 * dealt
    total = sum(mass.values()) + unseen
    assert np.allclose(sum(mass.values()) / total + unseen / total, 1)                # each state's emissions add up
    want = sorted((own is None, own or 0, math.log10(
        _forward_backward(start, moves, [mass.get(w, unseen) / total for w in t])[0]))
        for (own, _), t in zip(rows, texts, strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["score"])
                 for r in score_texts(docs, hashed=hashed, rounds=2, at_once=100).collect())
    for a, b in zip(want, got, strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-9)


def test_a_chunk_is_packed_and_worked_on_in_runs(spark):
    """What a task holds of a chunk: rows of packed bytes, few in a row group, and recursions over a part of it."""
    texts = [" ".join(f"word{w % 977}" for w in range(i, i + 20 + 4000 * (i % 2))) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = chunks(docs).toArrow()
    chunk, tied = Chunk(rows.to_batches()[0]), Hmm.started(np.full(32_768, 1 / 32_768), 4)
    assert rows.num_rows == 1 and rows.nbytes < 1_000_000 < sum(map(len, chunk.texts)) * 4
    assert _listed(rows["letters"][0], rows["ends"][0]).to_pylist().index("") == chunk.texts[0][-1]
    tracemalloc.start()
    first, pairs, counts, emitted = chunk.expected(tied)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 50e6
    own = Hmm(tied.initial, tied.moves, tied.emits[chunk.classes])
    for part, whole in zip((first, pairs, emitted), own.expected(chunk.training), strict=True):
        assert np.allclose(part, whole, rtol=1e-9)
    assert counts.sum() == sum(map(len, chunk.training))
    assert np.allclose(chunk.log10_likelihoods(own), own.log10_likelihoods(chunk.texts), rtol=1e-12)
    small = written(chunks(docs, at_once=20_000), **ROW_GROUPS | {"parquet.block.size": 10_000})
    groups = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in small.inputFiles()]
    assert sum(g.num_row_groups for g in groups) > 3
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def _labelled(spark, n=600):
    rng, docs, labels = random.Random(6), [], []
    for i in range(n):
        good, host = rng.random() < 0.7, f"h{i % 3 if i % 2 else i % 40}"
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 90))]
        if not good:
            words = [w.upper() + rng.choice(["!!", "$$$", "###"]) for w in words]
        docs.append((i, " ".join(words), "en", host, 1, "x"))
        labels.append((i, int(good)))
    return spark.createDataFrame(docs, COLUMNS), labels


def test_quality_on_held_out_labels(spark, odd_docs, no_docs):
    docs, labels = _labelled(spark)
    known = spark.createDataFrame(labels[::2], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in classify(docs, known).collect()}
    assert len(kept) == 600
    assert sum(kept[i] == bool(y) for i, y in labels[1::2]) / 300 > 0.97
    nothing = known.limit(0)
    assert all(r["kept"] for r in classify(docs, nothing).collect())
    both = odd_docs.unionByName(docs)
    assert classify(both, known.union(spark.createDataFrame([(None, 1), (1, None), (0, 1)], known.schema))).count() \
        == both.count()
    assert classify(no_docs, known).count() == 0


def test_site_rates_shrink(spark):
    """A site's rate lies between its own mean and its parent's, nearer the parent's the fewer documents it has."""
    rng, rows = random.Random(1), []
    for host, n, lean in (("large", 400, 2.0), ("other", 400, -1.0), ("small", 3, -2.0), (None, 1, 0.0)):
        rows += [(len(rows) + i, host, "p" if i % 2 else None, rng.gauss(lean, 0.5)) for i in range(n)]
    found = site_posteriors(spark.createDataFrame(rows, "doc_id long, host string, path string, evidence double"))
    got = {r["doc_id"]: r for r in found.collect()}
    assert len(got) == len(rows)

    def mean(host):
        p = [1 / (1 + math.exp(-e)) for _, h, _, e in rows if h == host]
        return sum(p) / len(p)

    overall = sum(1 / (1 + math.exp(-e)) for *_, e in rows) / len(rows)
    rate = {r[1]: got[r[0]]["host_rate"] for r in rows}
    for host in ("large", "other", "small"):
        assert min(mean(host), overall) <= rate[host] <= max(mean(host), overall)
    assert abs(rate["large"] - mean("large")) < 0.02 < abs(rate["small"] - mean("small"))
    assert got[0]["posterior"] > 1 / (1 + math.exp(-got[0]["evidence"]))


def test_quality_of_the_tables(few_docs, spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    own = few_docs.selectExpr("doc_id", "source AS host", "lang AS path", "text")
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    train, test = labels.filter("doc_id % 2 = 0"), {d: q for d, q in quality.items() if d % 2}
    kept = {r["doc_id"]: r["kept"] for r in site_posteriors(evidence(own, fit(own, train))).collect()}
    assert np.mean([kept[d] == bool(q) for d, q in test.items()]) > 0.85
