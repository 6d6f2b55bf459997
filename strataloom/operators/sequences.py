"""Ordered operators: windows, runs, epochs, look-ahead and folds with resets.

Every operator sorts each group by explicit columns and reads it as a stream; frames are bounded or running, so no task
holds a group in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sliding_windows(df: DataFrame, group: list[str], order: list[str], value: str, low: int = 3, high: int = 12) -> DataFrame:
    """``(group..., start, width, items)``: every window of low..high consecutive values; start counts from 1."""
    w = W.partitionBy(*group).orderBy(*order)
    ahead = F.collect_list(F.coalesce(F.col(value).cast("string"), F.lit(""))).over(w.rowsBetween(0, high - 1))
    rows = df.select(*group, F.row_number().over(w).alias("start"), ahead.alias("_next"))
    widths = F.explode(F.sequence(F.lit(low), F.least(F.size("_next"), F.lit(high))))
    return rows.where(F.size("_next") >= low).select(*group, "start", widths.alias("width"), "_next").select(*group, "start", "width", F.slice("_next", F.lit(1), F.col("width")).alias("items"))


def islands(df: DataFrame, group: list[str], order: list[str], starts: Column, out: str = "run") -> DataFrame:
    """Add a run number to each row: a new run begins where ``starts`` (may use lag over the order) is true or null."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn("_new", F.coalesce(starts, F.lit(True)).cast("int")).withColumn(out, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def previous(column: str, group: list[str], order: list[str]) -> Column:
    return F.lag(column).over(W.partitionBy(*group).orderBy(*order))


def following(column: str, group: list[str], order: list[str]) -> Column:
    return F.lead(column).over(W.partitionBy(*group).orderBy(*order))


def sized_by_neighbours(df: DataFrame, group: list[str], order: list[str], structured: Column, size: Column, alone: int = 15, beside: int = 9) -> DataFrame:
    """Structured rows of at least ``alone`` in size, or ``beside`` next to another structured row of their group."""
    w = W.partitionBy(*group).orderBy(*order)
    rows = df.withColumn("_s", F.coalesce(structured, F.lit(False)))
    near = F.coalesce(F.lag("_s").over(w), F.lit(False)) | F.coalesce(F.lead("_s").over(w), F.lit(False))
    return rows.withColumn("_near", near).where(F.col("_s") & (size >= F.when(F.col("_near"), beside).otherwise(alone))).drop("_s", "_near")


def since_last(df: DataFrame, group: list[str], order: list[str], invalidates: Column, same: list[str], occurrence: int = 2) -> DataFrame:
    """The ``occurrence``-th row with equal ``same`` columns since the last row that invalidates; with its epoch."""
    epochs = islands(df, group, order, invalidates & F.lit(True), "epoch").where(~F.coalesce(invalidates, F.lit(False)))
    n = F.row_number().over(W.partitionBy(*group, "epoch", *same).orderBy(*order))
    return epochs.withColumn("_n", n).where(F.col("_n") == occurrence).drop("_n")


def next_matching(df: DataFrame, group: list[str], order: list[str], matches: Column, value: str) -> Column:
    """``value`` of the nearest later row that matches; null if none follows."""
    w = W.partitionBy(*group).orderBy(*order).rowsBetween(1, W.unboundedFollowing)
    return F.first(F.when(matches, F.col(value)), ignorenulls=True).over(w)


def nth_occurrence(df: DataFrame, same: list[str], order: list[str], n: int) -> DataFrame:
    """The n-th row with equal ``same`` columns. At most n rows of each leave a task before the shuffle."""
    w = W.partitionBy(*same).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).where(F.col("_n") == n).drop("_n")


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the first by order."""
    return nth_occurrence(df, keys, order, 1)


def newest(df: DataFrame, keys: list[str], order: list[Column], keep: int) -> DataFrame:
    """The first ``keep`` rows of each key by ``order``."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= keep).drop("_n")


def cut_at_caps(df: DataFrame, group: list[str], order: list[str], size: str, most_items: int, most_size: int) -> DataFrame:
    """Add ``unit`` (from 1 in each group): rows in order, cut before a row that would exceed either cap.

    The next cut depends on where the last one fell, so this is a fold; rows stream through Arrow batches sorted by
    group and order with two numbers of state. A row larger than the cap is a unit of its own. Null sizes count 0.
    """
    rows = df.withColumn("_key", F.to_json(F.struct(*group))).withColumn("_size", F.coalesce(F.col(size).cast("bigint"), F.lit(0)))
    schema = T.StructType([f for f in rows.schema.fields if f.name != "_size"]).add("unit", T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, unit, items, total = None, 0, 0, 0
        for b in batches:
            out = []
            for k, s in zip(b.column("_key").to_pylist(), b.column("_size").to_pylist(), strict=True):
                if k != key:
                    key, unit, items, total = k, 1, 0, 0
                elif items == most_items or total + s > most_size:
                    unit, items, total = unit + 1, 0, 0
                items, total = items + 1, total + s
                out.append(unit)
            names = [n for n in b.schema.names if n != "_size"]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [pa.array(out, pa.int32())], names=[*names, "unit"])

    return rows.repartition("_key").sortWithinPartitions("_key", *order).mapInArrow(run, schema).drop("_key")


def running_batches(df: DataFrame, order: list[str], size: str, most_items: int, most_size: int, per_lane: int = 100_000) -> DataFrame:
    """Length-ordered batches within count and size caps: ``lane`` and ``unit`` name a batch.

    Rows are dealt into ranges by size, as many as their number asks for, so a batch holds rows of like size; each lane is
    cut on its own.
    """
    lanes = max(1, -(-df.count() // per_lane))
    ranged = df.repartitionByRange(lanes, *order).withColumn("lane", F.spark_partition_id())
    return cut_at_caps(ranged, ["lane"], order, size, most_items, most_size)
