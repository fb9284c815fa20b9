"""The pipeline against the brute-force version of each stage, on the rows the stage before kept."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np

from test_bpe_and_packing import PATH, _check_pieces
from test_lines import _brute, _rows, _windows
from test_near_duplicates import _ids_and_texts, brute_classes
from test_secrets_and_search import _base

from traceloom.llm.secrets import MASK
from traceloom.llm.tokens import encoder


def _stages(spark, docs):
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, None))
        out.append(docs)
    return out


def test_stages_as_brute_force(spark, few_docs):
    rules, lines, near, scan, packed = _stages(spark, few_docs)
    own = {r["doc_id"]: r for r in few_docs.collect()}
    failed = {d for d, r in own.items() if (m := _windows(r["text"]))[0] < 20 or 100 * m[1] > 30 * m[0]}
    kept = dict(_rows(rules))
    assert not set(kept) & failed and all(kept[d] == own[d]["text"] for d in kept)
    assert set(kept) >= {d for d in own if d not in failed}          # no line is above the limits in so few documents
    want = {d: t for (d, _, _, t), _ in _brute(list(kept.items())).items() if t.split()}
    assert dict(_rows(lines)) == want
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())
    classes = brute_classes(list(want.items()))
    assert dict(_rows(near)) == {d: want[d] for d in set(classes.values())}
    left = dict(_rows(scan))
    assert set(left) == set(dict(_rows(near)))
    for d, text in left.items():
        assert (MASK in text) >= bool(_base(want[d])) and not _base(text)
    assert _check_pieces(packed.collect(), list(left.items())) == 0
    for stage in (rules, lines, near, scan):
        assert stage.columns == few_docs.columns and stage.dtypes == few_docs.dtypes


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    ids = np.concatenate([np.frombuffer(bytes(r["ids"]), "<u4") for r in rows])
    assert sum(r["length"] for r in rows) == len(ids) and encoder(PATH)("a")


def test_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        out = _stages(spark, docs)
        assert all(s.columns == docs.columns for s in out[:-1])
    # a repeated row stays once; different texts of one id both stay
    near = corpus_pipeline.near_dedup(spark, odd_docs, None)
    assert Counter(r["doc_id"] for r in near.collect()) == Counter([1, 2, None, 6, 7, 7, 8, 9])


def test_near_dedup_as_brute_force_over_rows(spark, odd_docs):
    """Ids that repeat or are missing, over texts that are alike or not: of each class of texts one row stays, no other goes."""
    rng = random.Random(6)
    words = [f"w{n}" for n in range(500)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(12)]
    texts += [t + " more" for t in texts[:6]] + ["", " "]
    rows = [(rng.choice([None, *range(8)]), rng.choice(texts)) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], odd_docs.schema)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, None).collect()]
    label = brute_classes(list(enumerate(texts)))
    classes = {}
    for i, t in rows:
        classes.setdefault(label[texts.index(t)], set()).add((i is None, i))
    want = sorted((c, i is None, i or 0) for c, ids in classes.items() for _, i in [min(ids, key=lambda x: (x[0], x[1] or 0))])
    assert sorted((label[texts.index(t)], i is None, i or 0) for i, t in kept) == want


def test_near_dedup_keeps_each_class_of_null_ids(spark, odd_docs):
    texts, near, rows = _ids_and_texts()
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], odd_docs.schema)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, None).collect()]
    assert len(kept) == 7                                            # one row of each class, also where ids repeat
    assert {(i, texts[i - 1]) for i in (1, 2, 3)} | {(None, texts[4])} <= set(kept)
    assert sum(i is None and t in (texts[3], near[3]) for i, t in kept) == 1
    for n in (5, 6):
        assert sum(t in (texts[n], near[n]) for _, t in kept) == 1
