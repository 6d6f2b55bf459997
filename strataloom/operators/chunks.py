"""Overlapping byte pieces of a text, for inputs with a size limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def pieces(body: bytes, limit: int = 2000, overlap: int = 256, search: int = 512) -> list[bytes]:
    """Pieces of at most ``limit`` bytes that end after the last line end of their last ``search`` bytes, or between two
    characters; each begins ``overlap`` bytes before the end of the one before."""
    whole = lambda at, step: next(p for p in range(at, at + 4 * step, step) if p >= len(body) or body[p] & 0xC0 != 0x80)
    out, at = [], 0
    while len(body) - at > limit:
        line = body.rfind(b"\n", at + limit - search, at + limit)
        end = line + 1 if line >= 0 else whole(at + limit, -1)
        out.append(body[at:end])
        at = whole(end - overlap, 1)
    return [*out, body[at:]] if body else []


def exploded(df: DataFrame, keys: list[str], text: str, limit: int = 2000, overlap: int = 256, search: int = 512) -> DataFrame:
    """``(keys, chunk_ix, piece)`` of every text that is not null or empty; short ones are one piece."""
    rows = df.where(df[text].isNotNull()).select(*keys, df[text].alias("_text"))
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField("chunk_ix", T.IntegerType()), T.StructField("piece", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, ix, out = [], [], []
            for i, t in enumerate(b.column("_text").to_pylist()):
                p = pieces(t.encode("utf-8"), limit, overlap, search)
                take += [i] * len(p)
                ix += range(len(p))
                out += [x.decode("utf-8") for x in p]
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(k).take(at) for k in keys] + [pa.array(ix, pa.int32()), pa.array(out, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
