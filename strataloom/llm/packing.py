"""Filling containers of fixed capacity: hierarchical residual packing.

Every partition packs its own items best-fit, decreasing. Bins filled to ``FULL`` of the capacity are emitted; all
underfull ones travel on as single items, are dealt into as many partitions as their number asks for, and packed
best-fit again, until one partition holds what is left. A partition sees about ``ITEMS`` items in every round, however
many there are; dealt by a fresh hash, it sees the same mix of loads as the whole. So a round in which the number of bins
falls by less than ``GAIN`` shows that what is left does not combine (bins more than half full, say), and ends the tree.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.tokens import VOCABULARY, token_counts
from strataloom.runtime import Scratch

#: Items a partition holds on average, in every round; bins filled to this share are emitted; least share of its items
#: by which a round reduces their number if another is to follow.
ITEMS, FULL, GAIN = 40_000, 0.995, 0.01


class BestFit:
    """Open bins sorted by free space; an item goes into the fullest bin that still holds it."""

    def __init__(self, capacity: int):
        self.capacity, self.free, self.loads, self.of = capacity, [], [], []

    def add(self, size: int) -> int:
        at = bisect.bisect_left(self.free, (size, -1))
        if at < len(self.free):
            space, b = self.free.pop(at)
        else:
            space, b = self.capacity, len(self.loads)
            self.loads.append(0)
        self.loads[b] += size
        if space > size:
            bisect.insort(self.free, (space - size, b))
        return b


def pack_partition(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin of each item and load of each bin, best-fit decreasing; ties keep the order given."""
    bins, out = BestFit(capacity), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        out[i] = bins.add(sizes[i])
    return out, bins.loads


def _round(capacity: int, level: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "item"], ascending=[False, True], kind="stable")
        part = int(pdf["part"].iloc[0])
        at, loads = pack_partition(pdf["size"].tolist(), capacity)
        base = (level << 56) | (part << 28)
        return pd.DataFrame({"item": pdf["item"], "bin": [base + b for b in at], "load": [loads[b] for b in at], "open": [loads[b] < FULL * capacity for b in at]})

    return run


def pack(items: DataFrame, scratch: Scratch, capacity: int, n: int, each: int = ITEMS) -> DataFrame:
    """``(item, bin, load)`` for n items (item bigint unique, size bigint in 1..capacity).

    Bins are numbered by round, partition and order of opening. Underfull bins of a round are the items of the next one;
    membership is resolved by joining the rounds back to front.
    """
    schema = "item bigint, bin bigint, load bigint, open boolean"
    level, rounds = 0, []
    current = items.select("item", F.col("size").cast("bigint").alias("size"))
    while True:
        parts = max(1, -(-n // each))
        dealt = current.withColumn("part", F.pmod(F.xxhash64(F.lit(level), "item"), F.lit(parts)).cast("int"))
        done = scratch.cut(dealt.groupBy("part").applyInPandas(_round(capacity, level), schema), "round")
        rounds.append(done)
        if parts == 1:
            break
        current = scratch.cut(done.where("open").groupBy(F.col("bin").alias("item")).agg(F.first("load").alias("size")), "open")
        left = current.count()
        if not left or left > (1 - GAIN) * n:
            break
        n, level = left, level + 1
    found = rounds.pop().select("item", "bin", "load")
    while rounds:
        here = rounds.pop()
        later = found.select(F.col("item").alias("b0"), F.col("bin").alias("b1"), F.col("load").alias("l1"))
        carried = here.where("open").join(later, F.col("bin") == F.col("b0")).select("item", F.col("b1").alias("bin"), F.col("l1").alias("load"))
        found = here.where("not open").select("item", "bin", "load").unionByName(carried)
    return found


def pack_documents(
    documents: DataFrame, key: str, text: str, capacities: DataFrame, capacity: str, vocabulary: str = VOCABULARY, items: int = ITEMS
) -> DataFrame:
    """``(key, piece_ix, n_tokens, container_id, capacity, load)``: the containers of all texts.

    capacities: a few rows of allowed sizes (read to the driver: it is the list of container kinds, not data); null or
    non-positive ones are left out, none at all is an error. A text of more tokens than the largest capacity is cut
    into full pieces and a rest, every other one stays whole. Filling goes by the largest capacity; a container that
    ends with less becomes the smallest kind that holds it. Null, empty and zero-token texts take no room and are left
    out; repeated keys must have been reduced; a null key is left out.
    """
    spark = documents.sparkSession
    sizes = sorted(int(r[0]) for r in capacities.select(capacity).where(F.col(capacity) > 0).distinct().collect())
    if not sizes:
        raise ValueError("no container has a positive capacity")
    largest = sizes[-1]
    scratch = Scratch(spark, "packing")
    counted = token_counts(documents.where(F.col(key).isNotNull() & (F.octet_length(text) > 0)), text, [key], vocabulary)
    counted = scratch.cut(counted.where("n_tokens > 0").select(F.col(key).alias("k"), "n_tokens"), "sizes")
    pieces = counted.select(
        "k", F.posexplode(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / largest).cast("int"))).alias("piece_ix", "_i"), "n_tokens"
    ).select("k", "piece_ix", F.least(F.lit(largest), F.col("n_tokens") - F.col("piece_ix").cast("bigint") * largest).alias("size"))
    pieces = scratch.cut(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")
    placed = pack(pieces.select("item", "size"), scratch, largest, pieces.count(), items)
    kind = F.lit(largest)
    for c in reversed(sizes[:-1]):
        kind = F.when(F.col("load") <= c, c).otherwise(kind)
    return pieces.join(placed, "item").select(
        F.col("k").alias(key), "piece_ix", F.col("size").alias("n_tokens"), F.col("bin").alias("container_id"), kind.alias("capacity"), "load"
    )
