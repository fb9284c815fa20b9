"""Byte-level BPE as a monoid: halves are encoded alone and joined at their boundary.

Encoding a text is a tree reduction. Leaves are short stretches of text; two neighbours are joined by encoding
anew a window around their boundary that grows until nothing outside it can change. Two facts bound the window:

* Between texts: a match of the splitting pattern never runs on over a *seam*, a place where the class of the
  character (letter, digit, space, other) changes and the left one is no space and no apostrophe (which can open a
  contraction); what stands right of a seam is matched alike whatever stands left of it. So the window grows to the
  first seam on either side, and nothing outside it can change.
* Inside one long match: a row of tokens is the encoding of its bytes exactly if each two neighbours encode to
  themselves (the first merge over a token's edge would also happen between those two alone). So the window grows
  until its outer tokens and their neighbours outside hold.

Decoding maps ids to bytes and concatenates up the same tree.
"""

import base64
import hashlib
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LEAF_CHARS = 8192     # texts up to this length are leaves
LEAF_BYTES = 128      # single matches up to this length are merged at once
SPLIT_LIKE = "byte_bpe_50k.tiktoken"


def vocabulary_path(name: str = SPLIT_LIKE) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class TreeCodec:
    """Encoder and decoder for one rank file and splitting pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken
        self.ranks = read_ranks(path)
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.leaf = tiktoken.Encoding("leaf", pat_str=pattern, mergeable_ranks=self.ranks,
                                      special_tokens={}).encode_ordinary
        self.matches = regex.compile(pattern).findall
        self.classes = regex.compile(r"(\p{L})|(\p{N})|(\s)|(.)", regex.DOTALL)

    # -- one match ----------------------------------------------------------------------------------------
    def merge(self, piece: bytes) -> list[int]:
        """Merge the lowest-ranked neighbours, leftmost first, until none is in the vocabulary."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        ranks, n = self.ranks, len(piece)
        parts = [piece[i:i + 1] for i in range(n)]                 # by where they start; merged ones are empty
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(ranks[piece[i:i + 2]], i, 2) for i in range(n - 1) if piece[i:i + 2] in ranks]
        heapify(queue)
        while queue:
            _, at, size = heappop(queue)
            other = after[at]
            if not parts[at] or other >= n or len(parts[at]) + len(parts[other]) != size:
                continue                                           # one of the two has been merged since
            parts[at], parts[other] = parts[at] + parts[other], b""
            after[at] = after[other]
            if after[at] < n:
                before[after[at]] = at
            for left, right in ((before[at], at), (at, after[at])):
                if left >= 0 and right < n and (both := parts[left] + parts[right]) in ranks:
                    heappush(queue, (ranks[both], left, len(both)))
        return [ranks[p] for p in parts if p]

    @lru_cache(maxsize=1 << 16)                                                       # noqa: B019
    def holds(self, left: int, right: int) -> bool:
        return self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]

    def encode_match(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF_BYTES:
            return self.merge(piece)
        middle = len(piece) // 2
        return self.join_tokens(self.encode_match(piece[:middle]), self.encode_match(piece[middle:]))

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of both, from their encodings."""
        a, b = min(1, len(left)), min(1, len(right))
        while left and right:
            inside = b"".join(self.bytes_of[i] for i in left[len(left) - a:] + right[:b])
            tokens = self.merge(inside)
            ok_left = a == len(left) or self.holds(left[len(left) - a - 1], tokens[0])
            ok_right = b == len(right) or self.holds(tokens[-1], right[b])
            if ok_left and ok_right:
                return left[:len(left) - a] + tokens + right[b:]
            a, b = (a if ok_left else min(2 * a, len(left))), (b if ok_right else min(2 * b, len(right)))
        return left or right

    # -- texts ---------------------------------------------------------------------------------------------
    def seam(self, left: str, right: str) -> bool:
        """Whether no match can run on from ``left`` (one character) to ``right``."""
        a, b = (self.classes.match(c).lastindex for c in (left, right))
        return a != b and a != 3 and left != "'"

    def encode(self, text: str) -> list[int]:
        if len(text) <= LEAF_CHARS:
            return self.leaf(text)
        middle = len(text) // 2
        return self.join(text[:middle], self.encode(text[:middle]), text[middle:], self.encode(text[middle:]))

    def join(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
        """Encode the window between the last seam of ``left`` and the first of ``right`` anew."""
        start, end = len(left) - 1, 1
        while start > 0 and not self.seam(left[start - 1], left[start]):
            start -= 1
        while end < len(right) and not self.seam(right[end - 1], right[end]):
            end += 1
        tail, head = self.window(left[start:]), self.window(right[:end])
        inside = self.window(left[start:] + right[:end])
        return left_ids[:len(left_ids) - len(tail)] + inside + right_ids[len(head):]

    def window(self, text: str) -> list[int]:
        """As a leaf; a match too long for one becomes a tree of its own."""
        if len(text) <= LEAF_CHARS:
            return self.leaf(text)
        return [i for m in self.matches(text) for i in self.encode_match(m.encode())]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_CHARS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> TreeCodec:
    return TreeCodec(path, pattern)


def _pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


def encode_texts(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>)`` of every row; a null text is empty and an empty text has no ids.

    Each row is encoded alone, so repeated rows and repeated or null ids pass as they are.
    """
    path, pattern = path or vocabulary_path(), _pattern()

    def run(batches):
        encode = codec(path, pattern).encode
        for batch in batches:
            for part in _parts(batch):
                yield pa.RecordBatch.from_arrays(
                    [part[0].cast(pa.int64()), pa.array([encode(t or "") for t in part[1].to_pylist()],
                                                        pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(doc_id, text).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(coded: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, bytes binary)`` of rows of :func:`encode_texts`; null ids decode to nothing."""
    path, pattern = path or vocabulary_path(), _pattern()

    def run(batches):
        decode = codec(path, pattern).decode
        for batch in batches:
            for part in _parts(batch):
                yield pa.RecordBatch.from_arrays(
                    [part[0].cast(pa.int64()), pa.array([decode(i or []) for i in part[1].to_pylist()],
                                                        pa.binary())], names=["doc_id", "bytes"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def _parts(batch, most: int = 512):
    """Slices of a batch, so that what Python holds of it at once stays small."""
    for at in range(0, batch.num_rows, most):
        yield batch.slice(at, most)


def round_trips(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of the ids and of the bytes they decode to, one row per document, in one pass."""
    path, pattern = path or vocabulary_path(), _pattern()
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()),
                           T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        tree = codec(path, pattern)
        decimal = [str(i) for i in range(len(tree.bytes_of))].__getitem__
        for batch in batches:
            for part in _parts(batch):
                sizes, coded, decoded = [], [], []
                for t in part[1].to_pylist():
                    ids = tree.encode(t or "")
                    sizes.append(len(ids))
                    coded.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(tree.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part[0].cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(coded, pa.string()),
                     pa.array(decoded, pa.string())], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op2_byte_bpe(spark, sf_dir):
    return round_trips(spark.read.parquet(f"{sf_dir}/documents.parquet"))
