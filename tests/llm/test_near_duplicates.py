"""Near-duplicates, their signatures and the components they hang together in, against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np

from traceloom.llm.graph import components
from traceloom.llm.minhash import near_duplicates, shingles, signatures

from corpus_samples import COLUMNS


def _bag(text, size=5):
    words = [w for w in text.translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if w]
    if not words:
        return Counter()
    return Counter(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1)))


def brute_classes(rows, threshold=0.8):
    """{id: smallest id of its class} for ``(id, text)`` rows with ids that do not repeat."""
    bags, holders = {d: _bag(t or "") for d, t in rows}, defaultdict(list)
    parent = {d: d for d in bags}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = sorted((root(a), root(b)))
        parent[b] = a

    empty = [d for d, b in bags.items() if not b]
    for d in empty[1:]:
        join(empty[0], d)
    for d, bag in bags.items():
        seen = Counter()
        for s, n in bag.items():
            for other in holders[s]:
                seen[other] += min(n, bags[other][s])
            holders[s].append(d)
        for other, both in seen.items():
            if both >= threshold * (bag.total() + bags[other].total() - both) - 1e-9:
                join(d, other)
    return {d: root(d) for d in bags}


def _found(docs, **kw):
    return {r["doc_id"]: r["class_id"] for r in near_duplicates(docs, **kw).collect()}


def test_signatures_are_unbiased():
    rng, off = np.random.default_rng(0), []
    for _ in range(120):
        h = np.unique(rng.integers(0, 1 << 63, 60).astype(np.uint64))
        a = rng.integers(1, 40, len(h))
        b = np.where(rng.random(len(h)) < 0.6, a, rng.integers(0, 40, len(h)))
        s = signatures([(h, a), (h[b > 0], b[b > 0])], 512)
        off.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.006 and np.std(off) < 0.03


def test_shingles_count():
    h, n = shingles("a b c d e a b c d e")
    assert len(h) == 5 and sorted(n.tolist()) == [1, 1, 1, 1, 2]
    assert shingles("a b")[1].tolist() == [1] and len(shingles(" \n")[0]) == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (7, 9), (9, 7)]
    links += [(10_000 + rng.randrange(400), 10_000 + rng.randrange(400)) for _ in range(250)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            parent[root(a)] = root(b)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got) == set(parent)
    assert len({(got[x], root(x)) for x in got}) == len(set(got.values())) == len({root(x) for x in got})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_planted_groups(spark, odd_docs):
    rng = random.Random(3)

    def text(n):
        return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))

    def edited(words, n):
        words = words.split()
        for _ in range(n):
            words[rng.randrange(len(words))] = f"e{rng.randrange(9999)}"
        return " ".join(words)

    base, passage, chain = text(300), text(80), [text(200)]
    for _ in range(6):                                              # a chain whose ends are not alike
        chain.append(edited(chain[-1], 3))
    texts = [base] * 40 + [edited(base, rng.randrange(1, 5)) for _ in range(120)] + chain
    texts += [f"{text(100)} {passage} {text(100)}" for _ in range(40)] + [text(250) for _ in range(60)]
    texts += ["a b", "a b", "a c", "", " ", "x " * 300, "x " * 250, "x " * 200]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    found = _found(spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], COLUMNS))
    assert found == brute_classes(rows)


def test_as_brute_force(few_docs):
    rows = [(r["doc_id"], r["text"]) for r in few_docs.collect()]
    assert _found(few_docs.repartition(5)) == brute_classes(rows)


def test_odd_rows(odd_docs, no_docs):
    rows = near_duplicates(odd_docs).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd_docs.collect())
    got = {r["doc_id"]: r["class_id"] for r in rows}
    assert got[2] == got[3] == got[4] == 2 and got[None] is None and got[6] == 6 and got[7] == 7
    assert near_duplicates(no_docs).count() == 0


def _ids_and_texts():
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(8)]
    near = [t + " end" for t in texts]
    rows = [(None, t) for t in texts[:5]] + [(n + 1, texts[n]) for n in range(3)]      # copies of null-id rows
    rows += [(None, near[3]), (None, texts[4]), (7, texts[5]), (7, texts[6]), (8, near[6]), (9, near[5])]
    return texts, near, rows


def test_contents_are_linked_whatever_their_ids(spark):
    texts, near, rows = _ids_and_texts()
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], COLUMNS)
    got = Counter((r["doc_id"], r["class_id"]) for r in near_duplicates(docs.repartition(3)).collect())
    assert got == Counter({(None, 1): 1, (None, 2): 1, (None, 3): 1, (None, None): 4, (1, 1): 1, (2, 2): 1, (3, 3): 1,
                           (7, 7): 2, (8, 7): 1, (9, 7): 1})
