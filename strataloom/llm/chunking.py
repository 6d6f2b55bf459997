"""Cutting oversized texts at natural boundaries with an overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Strength of a cut by what stands before it; a cut inside a character has 0, before any other character 1.
LINES = {"line": 2}
PROSE = {"paragraph": 5, "line": 4, "sentence": 3, "space": 2}


def strengths(data: np.ndarray, levels: dict[str, int]) -> np.ndarray:
    """Strength of the cut before each byte."""
    out = ((data & 0xC0) != 0x80).astype(np.int64)
    before = np.empty_like(data)
    before[0], before[1:] = 0, data[:-1]
    start = out == 1
    if "space" in levels:
        out[start & ((before == 32) | (before == 9))] = levels["space"]
    if "sentence" in levels:
        end = np.zeros(len(data), bool)
        end[2:] = ((data[:-2] == 46) | (data[:-2] == 33) | (data[:-2] == 63)) & (data[1:-1] == 32)
        out[start & end] = levels["sentence"]
    if "line" in levels:
        out[before == 10] = levels["line"]
    if "paragraph" in levels:
        blank = np.zeros(len(data), bool)
        blank[2:] = (data[:-2] == 10) & (data[1:-1] == 10)
        out[blank] = levels["paragraph"]
    return out


class RangeMaximum:
    """Sparse table over keys (strength, position): the rightmost strongest cut in any window, in constant time.

    Level k holds the maximum over 2**k cuts; only levels up to the window asked for are built, each from the one below,
    and only the level that answers windows of that width is kept.
    """

    def __init__(self, strength: np.ndarray, width: int):
        self.width = width
        self.level = max(0, int(width).bit_length() - 1)
        self.shift = 1 << max(1, int(len(strength)).bit_length())
        top = strength * self.shift + np.arange(len(strength), dtype=np.int64)
        for k in range(self.level):
            step = 1 << k
            if step < len(top):
                wider = top.copy()
                np.maximum(top[:-step], top[step:], out=wider[:-step])
                top = wider
        self.top = top

    def best(self, first: int, last: int) -> int:
        """Position of the strongest cut in first..last (both included, ``width`` cuts), the rightmost on a tie."""
        a = self.top[first]
        b = self.top[max(first, last - (1 << self.level) + 1)]
        return int(max(a, b)) % self.shift


def cut_points(strength: np.ndarray, limit: int, window: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces (start, end) of one text of ``len(strength)`` bytes."""
    n = len(strength)
    if n <= limit:
        return [(0, n)]
    index, start, out = RangeMaximum(strength, window), 0, []
    while n - start > limit:
        end = index.best(start + limit - window + 1, start + limit)
        out.append((start, end))
        start = end - overlap
        while strength[start] == 0:
            start += 1
    out.append((start, n))
    return out


def split_batches(limit: int, window: int, overlap: int, levels: dict[str, int], carry: list[str]):
    """A function for mapInArrow over (carry..., body binary): adds pieces, a list of (start, end); null body, null."""
    piece = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = batch.column("body")
            texts = [np.frombuffer(x.as_buffer(), np.uint8) if x.is_valid else None for x in body]
            pieces: list = [None] * len(texts)
            for i, t in enumerate(texts):
                if t is not None and len(t):
                    pieces[i] = [{"start": a, "end": b} for a, b in cut_points(strengths(t, levels), limit, window, overlap)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carry] + [pa.array(pieces, piece)], names=[*carry, "pieces"])

    return run


def split_oversized(
    df: DataFrame, key: str, text: str, version: str | None = None, limit: int = 2000, window: int = 512, overlap: int = 256, levels: dict[str, int] | None = None
) -> DataFrame:
    """``(key, chunk_ix, start_byte, end_byte)`` of every text of more than ``limit`` UTF-8 bytes.

    The rest goes whole if it fits; otherwise the piece ends at the strongest cut among the last ``window`` of its
    ``limit`` bytes, the rightmost on a tie; the next piece starts ``overlap`` bytes before that end, moved forward to
    the start of a character. Of repeated keys the row with the greatest ``version`` counts (ties: greatest hash of the
    text). Null and short texts give no rows; a null key is a key like any other. Only long texts travel to Python, in
    Arrow batches; pieces, not texts, are shuffled. Every text is read whole.
    """
    if not 4 <= overlap + 4 <= limit - window or window < 4:
        raise ValueError("needs window >= 4 and overlap + window + 4 <= limit, so that every piece advances")
    pieces = T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()))
    rows = df.select(
        F.col(key).alias("k"),
        (F.col(version) if version else F.lit(0)).alias("v"),
        F.xxhash64(text).alias("h"),
        F.when(F.octet_length(text) > limit, F.col(text).cast("binary")).alias("body"),
    )
    long = rows.where("body is not null")
    cut = long.mapInArrow(split_batches(limit, window, overlap, levels or LINES, ["k", "v", "h"]), rows.drop("body").schema.add("pieces", pieces))
    both = cut.unionByName(rows.where("body is null").select("k", "v", "h", F.lit(None).cast(pieces).alias("pieces")))
    last = both.groupBy("k").agg(F.max_by("pieces", F.struct("v", "h")).alias("pieces"))
    return last.select(F.col("k").alias(key), F.posexplode("pieces").alias("chunk_ix", "p")).select(
        key, "chunk_ix", F.col("p.start").alias("start_byte"), F.col("p.end").alias("end_byte")
    )
