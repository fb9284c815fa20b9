"""SimHash components against brute force over all pairs."""

import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from corpus_samples import COLUMNS, long_text
from traceloom.llm import simhash as S


def brute_print(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in words.translate({c: 32 for c in range(9, 14)}).split(" ") if w]
    made = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in made]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Least label of each place, by following all pairs at most three bits apart."""
    codes = np.array(prints, np.uint64)
    label = np.arange(len(codes))
    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes ^ codes[i]) <= 3):
            a, b = label[i], label[j]
            if a != b:
                label[label == max(a, b)] = min(a, b)
    return label


def some_prints(n, seed):
    """Random fingerprints, chains and clouds of them, and many that share a quarter."""
    rng = random.Random(seed)
    out = {rng.getrandbits(64) for _ in range(n // 3)} | {0, 2 ** 64 - 1, 1}
    for _ in range(n // 60):
        at = rng.getrandbits(64)
        for _ in range(20):
            out.add(at)
            for _ in range(rng.randint(1, 5)):
                at ^= 1 << rng.randrange(64)
    top = rng.getrandbits(16) << 48
    out |= {top | rng.getrandbits(9) << 30 | rng.getrandbits(6) for _ in range(n // 3)}
    return sorted(out)


@pytest.mark.parametrize("fan", [2, 5, 16])
def test_tree_finds_all_pairs_of_a_quarter(fan):
    codes = np.array(some_prints(900, fan), np.uint64)
    ranks = codes.copy()
    for by in (1, 2, 4, 8, 16, 32):
        ranks ^= ranks >> np.uint64(by)
    order = np.argsort(ranks)
    codes, ranks = codes[order], ranks[order]
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes))
            if int(codes[i] ^ codes[j]).bit_count() <= 3 and codes[i] >> np.uint64(48) == codes[j] >> np.uint64(48)}
    assert {(int(i), int(j)) for a, b in S.close_pairs(ranks, fan=fan) for i, j in zip(a, b)} == want
    cut = len(codes) // 3
    found = {(int(i), int(j) + cut) for a, b in S.close_pairs(ranks[:cut], ranks[cut:], fan) for i, j in zip(a, b)}
    assert found == {(i, j) for i, j in want if i < cut <= j}


@pytest.mark.parametrize("leaf, fan", [(8, 2), (50, 16), (S.LEAF, S.FAN)])
def test_links_hang_together_what_is_close(spark, leaf, fan):
    prints = some_prints(600, leaf)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    made = spark.createDataFrame([(p,) for p in signed], "print long")
    links = [(r["a"], r["b"]) for r in S.links(made, leaf, fan).collect()]
    parent = {p: p for p in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    label = brute_components(prints)
    groups = {}
    for p, at in zip(signed, label):
        groups.setdefault(at, set()).add(root(p))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def check(docs, rows):
    prints = [brute_print(t) for _, t in rows]
    label = brute_components(prints)
    least = {}
    for (d, _), at in zip(rows, label):
        least.setdefault(at, []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    want = sorted(((d, f"{p:016x}", least[at]) for (d, _), p, at in zip(rows, prints, label)), key=str)
    found = [tuple(r) for r in S.near_duplicates(docs).collect()]
    assert sorted(found, key=str) == want


def test_documents_as_brute_force(spark, few_docs, odd_docs, no_docs):
    check(few_docs, [(r["doc_id"], r["text"]) for r in few_docs.collect()])
    check(odd_docs, [(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    check(no_docs, [])


def test_copies_short_texts_and_ties(spark):
    base = long_text(5, 400)
    texts = [base, base.upper(), base + " x", base.replace("e", "E"), "One", "one", "one two", "ONE\vtwo", None, "",
             "a b c d", "İ Ä K", base * 30]
    rows = [(50 - i, t) for i, t in enumerate(texts)] + [(None, base), (None, "alone here")]
    check(spark.createDataFrame([(d, t, "en", "s", 1, "x") for d, t in rows], COLUMNS), rows)
    clash = spark.createDataFrame([(1, base, 7, "a"), (2, base, 8, "b")],
                                  "doc_id long, text string, print long, label string")
    check(clash, [(1, base), (2, base)])
