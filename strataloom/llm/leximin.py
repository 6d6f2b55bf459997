"""One ranking from several scores of different scale: leximin over percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.operators.ordering import running_total
from strataloom.runtime import Scratch

#: Percentiles are compared to so many digits, so that equal means count as ties however they were added up.
DIGITS = 12


def leximin_vectors(df: DataFrame, item: str, group: str, signals: dict[str, int]) -> DataFrame:
    """``(item, group, vector, scored)``: each item's percentiles in ascending order.

    signals: column -> 1 (higher is stronger) or -1 (lower is stronger). A percentile is the mid-rank of the value among
    the scored values of its group and signal, so only the order of the values matters. Null and NaN count as not
    scored: the place is filled with the mean of the item's own percentiles, which neither helps nor harms it. An item
    without any score gets a vector of -1 and sorts last. Rows with a null item or group are left out. Repeated items
    must have been reduced before. Ties share a percentile; other columns are ignored, whatever their names.

    Distinct values are counted first (with map-side combining), so a hot group or a signal with few values costs no
    more than its distinct values; their running totals are taken over range partitions, never in one task.
    """
    scratch = Scratch(df.sparkSession, "leximin")
    scores = [
        F.struct(F.lit(i).alias("s"), F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double") * sign).alias("v"))
        for i, (c, sign) in enumerate(signals.items())
    ]
    long = (
        df.where(F.col(item).isNotNull() & F.col(group).isNotNull())
        .select(F.col(item).alias("i"), F.col(group).alias("g"), F.explode(F.array(*scores)).alias("x"))
        .select("i", "g", "x.s", (F.col("x.v") + F.lit(0.0)).alias("v"))  # -0.0 and 0.0 are one value
    )
    long = scratch.cut(long, "long")
    counts = long.where("v is not null").groupBy("g", "s", "v").agg(F.count("*").alias("n"))
    ranked = running_total(counts, scratch, ["g", "s"], [F.col("v")], "n", "before")
    sizes = counts.groupBy("g", "s").agg(F.sum("n").alias("total"))
    at = (
        ranked.join(sizes, ["g", "s"])
        .select("g", "s", "v", ((F.col("before") + F.col("n") / 2) / F.col("total")).alias("p"))
    )
    scored = long.join(at, ["g", "s", "v"], "left").groupBy("i", "g").agg(F.sort_array(F.collect_list("p")).alias("p"))
    k = len(signals)
    mean = F.aggregate("p", F.lit(0.0), lambda a, x: a + x) / F.size("p")
    vector = F.when(F.size("p") == 0, F.array_repeat(F.lit(-1.0), k)).otherwise(
        F.array_sort(F.transform(F.concat("p", F.array_repeat(mean, F.lit(k) - F.size("p"))), lambda x: F.round(x, DIGITS)))
    )
    return scored.select(F.col("i").alias(item), F.col("g").alias(group), vector.alias("vector"), F.size("p").alias("scored"))


def leximin_top(vectors: DataFrame, item: str, group: str, limits: DataFrame, limit: str) -> DataFrame:
    """The first ``limit`` items of each group in leximin order, with ``place`` from 1; ties go to the smaller item.

    limits: one row a group. Its largest limit bounds the window, so every task keeps only that many rows a group
    before the shuffle. Groups without a row in ``limits`` or with a limit below 1 or null give nothing.
    """
    most = limits.agg(F.max(limit)).first()[0] or 0
    w = W.partitionBy(group).orderBy(F.col("vector").desc(), F.col(item).asc())
    top = vectors.withColumn("place", F.row_number().over(w)).where(F.col("place") <= int(most))
    return top.join(limits.select(group, limit), group).where(F.col("place") <= F.col(limit)).select(group, item, "place")


def leximin_order(vectors: DataFrame, item: str, group: str) -> DataFrame:
    """The whole order of every group: ``place`` from 1, over range partitions, so a group may be of any size."""
    scratch = Scratch(vectors.sparkSession, "leximin")
    one = vectors.withColumn("_one", F.lit(1).cast("long"))
    placed = running_total(one, scratch, [group], [F.col("vector").desc(), F.col(item).asc()], "_one", "_before")
    return placed.select(group, item, (F.col("_before") + 1).alias("place"), "scored")
