"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies; a parameter of every operator here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: White space and words as byte-level BPE vocabularies of this kind cut them (a fixed value of the vocabulary).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def encoding(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, path: str = VOCABULARY, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_tokens, *extra). Null and empty texts have 0 tokens. Only numbers come back."""
    keep = {c: docs.schema[c].dataType.simpleString() for c in extra}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), *(b.column(c) for c in extra)], names=["doc_id", "n_tokens", *extra])

    return docs.select(F.col("doc_id").cast("long"), "text", *extra).mapInArrow(count, ", ".join(["doc_id long, n_tokens long", *(f"{c} {t}" for c, t in keep.items())]))
