"""Sizes of texts in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public vocabularies are; every operator takes another path as a parameter.
VOCABULARY = os.environ.get("STRATALOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: How byte-level BPE of this vocabulary cuts a text into words (fixed value of the public tokenizer).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` and ``n_tokens`` (bigint) for every row; null and empty texts have 0 tokens.

    Whole texts, one pass over Arrow batches; the vocabulary is loaded once a Python worker. ``keep`` columns are
    renamed inside, so any names are safe.
    """
    inner = [f"_k{i}" for i in range(len(keep))]
    rows = df.select(*[F.col(c).alias(a) for c, a in zip(keep, inner, strict=True)], F.col(text).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column("_t").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in inner], pa.array(n, pa.int64())], names=[*inner, "n_tokens"])

    schema = rows.drop("_t").schema.add("n_tokens", T.LongType())
    return rows.mapInArrow(run, schema).select(*[F.col(a).alias(c) for c, a in zip(keep, inner, strict=True)], "n_tokens")
