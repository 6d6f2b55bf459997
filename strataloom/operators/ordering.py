"""Ranks and running totals over groups of any size.

A window function puts a whole group into one task. These operators spread a group over range partitions instead: each
partition sorts its own stretch, a small table of per-partition totals gives every stretch its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.runtime import Scratch


def running_total(df: DataFrame, scratch: Scratch, group: list[str], order: list[Column], weight: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over the rows of the same group that sort before this one; 0 for the first."""
    return running(df, scratch, group, order, weight, out, "sum").withColumn(out, F.coalesce(out, F.lit(0)))


def running(df: DataFrame, scratch: Scratch, group: list[str], order: list[Column], value: str, out: str, how: str) -> DataFrame:
    """Add ``out``: the sum, max or min of ``value`` over the rows of the same group that sort before this one, or null.

    ``order`` must make the rows of a group distinct. One range shuffle of ``df``; the offsets have one row for each
    group and partition that meet. Nulls in ``group`` form a group of their own. An empty input stays empty.
    """
    return running_all(df, scratch, group, order, {out: (value, how)})


def running_all(df: DataFrame, scratch: Scratch, group: list[str], order: list[Column], outs: dict[str, tuple[str, str]]) -> DataFrame:
    """As ``running``, for several values of the same group and order at once: out -> (value, sum, max or min)."""
    ranged = df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("_part", F.spark_partition_id())
    ranged = scratch.cut(ranged, "ranged")  # a second look must see the same partitions
    folds = {"sum": F.sum, "max": F.max, "min": F.min}
    both = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": lambda a, b: F.coalesce(F.greatest(a, b), a, b), "min": lambda a, b: F.coalesce(F.least(a, b), a, b)}
    each = list(enumerate(outs.items()))
    totals = ranged.groupBy("_part", *group).agg(*[folds[how](value).alias(f"_all{i}") for i, (_, (value, how)) in each])
    # Few rows a group: a group meets at most as many partitions as it fills.
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], *[folds[how](f"_all{i}").over(before).alias(f"_off{i}") for i, (_, (_, how)) in each]
    )
    on = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = W.partitionBy("_part", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    for i, (_, (value, how)) in each:
        ranged = ranged.withColumn(f"_in{i}", folds[how](value).over(inside))
    joined = ranged.join(offsets, on)
    for i, (out, (_, how)) in each:
        joined = joined.withColumn(out, both[how](F.col(f"_off{i}"), F.col(f"_in{i}")))
    return joined.drop("_part", "_p", *[f"_g{i}" for i in range(len(group))], *[f"_{k}{i}" for i, _ in each for k in ("off", "in")])


def keep_best(df: DataFrame, keys: list[str], order: list[Column], columns: list[str] | None = None) -> DataFrame:
    """One row for each key: the one with the greatest ``order``. Partial aggregation, no sort of whole groups."""
    rest = [c for c in (columns or df.columns) if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])
