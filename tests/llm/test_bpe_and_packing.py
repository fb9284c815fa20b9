"""Encoding, decoding, packing and token counts against the libraries and brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from traceloom.llm import bpe_tree
from traceloom.llm.packing import SumOfSquares, pack
from traceloom.llm.token_counts import length_histogram, length_quantile, suffix_sums, truncated_total
from traceloom.llm.tokens import encoder, token_lengths

from corpus_samples import long_text

PATH = P.path("byte_bpe_50k.tiktoken")
HARD = ["", "a", "'", "''re we're 're", "x" * 3000, "ab" * 2000 + " " * 700 + "cd" * 900, "  \n\n \t x  y  z ",
        "Äöü" * 700, "1234567890" * 300, "\U0001f600" * 500, "日本語の文章" * 400, "don't can't I'll we've they'd " * 90,
        "<|endoftext|> is text", "a\x1c!\x1c!b " * 50, "!!'s?!'re" * 300, "thththt" * 900]


@pytest.fixture(scope="module")
def reference():
    import tiktoken
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_tree.read_ranks(PATH),
                             special_tokens={}).encode_ordinary


def test_tree_equals_the_library(monkeypatch, reference):
    codec = bpe_tree.TreeCodec(PATH, P.PATTERN)
    for leaf, piece in ((8192, 128), (64, 16), (7, 3)):
        monkeypatch.setattr(bpe_tree, "LEAF_CHARS", leaf)
        monkeypatch.setattr(bpe_tree, "LEAF_BYTES", piece)
        for text in [*HARD, long_text(3, 3000)]:
            ids = codec.encode(text)
            assert ids == reference(text), (leaf, text[:40])
            assert codec.decode(ids) == text.encode()


def test_fast_encoder_equals_both_libraries(reference):
    from tokenizers import Tokenizer
    other = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    for text in HARD:
        assert encoder(PATH)(text) == reference(text) == other.encode(text, add_special_tokens=False).ids


def test_round_trips(odd_docs, few_docs, no_docs, reference):
    for docs in (odd_docs, few_docs):
        texts = Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
        want = Counter()
        for (own, text), n in texts.items():
            ids = reference(text)
            want[(own, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                  hashlib.sha256(text.encode()).hexdigest())] += n
        assert Counter(map(tuple, bpe_tree.round_trips(docs).collect())) == want
    coded = bpe_tree.encode_texts(odd_docs)
    assert Counter((r["doc_id"], bytes(r["bytes"]).decode()) for r in bpe_tree.decode_ids(coded).collect()) == Counter(
        (r["doc_id"], r["text"] or "") for r in odd_docs.collect())
    assert bpe_tree.round_trips(no_docs).count() == 0


def _check_pieces(rows, docs, window=2048):
    """Every id in one piece, sequences gapless and full but for powers of two."""
    want = Counter()
    for own, text in docs:
        ids = np.array([*encoder(PATH)(text or ""), 1], "<u4")
        want[(own, ids.tobytes())] += 1
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append(r)
        by_doc[r["doc_id"]].append(r)
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] > 0
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    for (own, ids), n in want.items():
        if sum(k == own for k, _ in want) == 1 and n == 1:
            pieces = sorted(by_doc[own], key=lambda r: r["start"])
            assert b"".join(bytes(r["ids"]) for r in pieces) == ids
            assert [r["start"] for r in pieces] == [0, *np.cumsum([r["length"] for r in pieces])[:-1].tolist()]
            assert {r["doc_tokens"] for r in pieces} == {len(ids) // 4}
    assert sum(r["length"] for r in rows) == sum(n * len(ids) // 4 for (_, ids), n in want.items())
    return padding


def test_packing(odd_docs, few_docs, no_docs):
    for docs in (odd_docs, few_docs, few_docs.repartition(7)):
        texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert _check_pieces(pack(docs).collect(), texts) == 0
        assert _check_pieces(pack(docs, window=512, max_open=8).collect(), texts, 512) == 0
    assert pack(no_docs).count() == 0


def _squares(counts, size):
    return sum(v * v for h, v in counts.items() if 0 < h < size)


def test_level_is_the_one_of_the_least_sum_of_squares():
    rng, size = np.random.default_rng(5), 16
    packer, windows = SumOfSquares(size, 10_000), Counter()
    for n in rng.integers(1, size, 400).tolist():
        def after(level, n=n):
            then = Counter(windows)
            then[level] -= 1
            then[level + n] += 1
            return _squares(then, size)
        allowed = [0] + [h for h in range(1, size - n + 1) if windows[h] > 0]
        level = packer.level_for(n)
        assert level in allowed and after(level) == min(map(after, allowed))
        packer.put((0, 0, b"\0\0\0\0" * n, n))
        if level:
            windows[level] -= 1
        windows[level + n] += 1
        assert [windows[h] for h in range(1, size)] == packer.counts[1:size].tolist()


def test_token_counts(odd_docs, few_docs, no_docs):
    for docs in (odd_docs, few_docs):
        lengths = sorted(len(encoder(PATH)(r["text"] or "")) for r in docs.collect())
        sums = suffix_sums(length_histogram(token_lengths(docs)), block=64)
        rows = {r["n_tokens"]: r for r in sums.collect()}
        assert {n: r["n_docs"] for n, r in rows.items()} == Counter(lengths)
        for n, r in rows.items():
            assert r["docs_at_least"] == sum(x >= n for x in lengths) and r["total_docs"] == len(lengths)
            assert r["tokens_at_least"] == sum(x for x in lengths if x >= n) and r["total_tokens"] == sum(lengths)
            assert r["truncated_tokens"] == sum(min(x, n) for x in lengths)
            assert r["docs_up_to"] == sum(x <= n for x in lengths)
        for limit in (0, 1, 77, 500, 10 ** 6):
            assert tuple(truncated_total(sums, limit).first()) == (
                sum(x > limit for x in lengths), sum(min(x, limit) for x in lengths))
        for q in (0.0, 0.5, 0.9, 1.0):
            assert length_quantile(sums, q).first()[0] == lengths[max(0, -(-int(q * 100) * len(lengths) // 100) - 1)]
    assert suffix_sums(length_histogram(token_lengths(no_docs))).count() == 0
