"""Token ids of whole texts by a public byte-level BPE vocabulary.

``tokenizers`` with byte_bpe_50k.json and ``tiktoken`` with the rank file of the same vocabulary give the same ids
(the tests compare them); the latter is five times as fast and is used here. Strings that spell a special token are
ordinary text.
"""

import re
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe_tree import read_ranks, vocabulary_path

#: Two white space characters in a row, by a class at least as wide as the pattern's.
_RUN = re.compile(r"\s\s")


@lru_cache(maxsize=2)
def encoder(path: str):
    """``text -> list of ids``. Without two spaces in a row the pattern's look-ahead says nothing and is left out."""
    import public_tokenizers
    import tiktoken
    ranks, pattern = read_ranks(path), public_tokenizers.PATTERN
    plain = pattern.replace(r"\s+(?!\S)|", "")
    whole = tiktoken.Encoding("whole", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    fast = tiktoken.Encoding("fast", pat_str=plain, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: whole(text) if _RUN.search(text) else fast(text)


def little_endian(ids: list[int]) -> bytes:
    """Unsigned 32-bit ids, low byte first."""
    import sys
    words = array("I", ids)
    if sys.byteorder == "big":
        words.byteswap()
    return words.tobytes()


def token_lengths(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``(n_tokens long)`` of every row; a null or empty text has none."""
    path = path or vocabulary_path()

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for at in range(0, batch.num_rows, 512)
                     for t in batch.column(0).slice(at, 512).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], names=["n_tokens"])

    return docs.select(text).mapInArrow(run, "n_tokens long")
