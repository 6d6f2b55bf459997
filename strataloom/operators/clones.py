"""Exact clones: rows with the same key, each tied to one source instead of to every other copy."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.operators.ordering import running_all
from strataloom.runtime import Scratch


def clone_sources(df: DataFrame, key: str, package: str, start: str, end: str, order: list[str], keep: list[str] | None = None) -> DataFrame:
    """Every later row of a key with ``source_*`` columns of the one source it is tied to.

    In input order, a row takes from the rows before it with the same key, first of its own package: the one that ends
    first if that is before it starts, else the one that starts last if that is after it ends; failing that, the first
    row of another package. n copies give at most n - 1 rows, and no row meets another: what is needed are running
    minima over the order, taken over range partitions, so a class may hold any share of the rows. Rows without a key
    take no part. Keys are compared by their SHA-256. ``order`` must make rows distinct; ``keep`` names further columns
    to return.
    """
    scratch = Scratch(df.sparkSession, "clones")
    names = list(dict.fromkeys([package, start, end, *order]))
    rest = [c for c in keep or [] if c not in names]
    rows = df.where(F.col(key).isNotNull()).select(F.sha2(F.col(key), 256).alias("_d"), *names, *rest)
    often = rows.groupBy("_d").agg(F.count("*").alias("_n"), F.min_by(package, F.struct(*order)).alias("_head")).where("_n > 1").drop("_n")
    rows = rows.join(often, "_d")
    ident, tie, by = F.struct(*names), F.struct(*order), [F.col(c) for c in order]
    place = lambda *first: F.struct(*first, tie.alias("o"), ident.alias("r"))
    rows = rows.withColumn("_v1", place()).withColumn("_v2", F.when(~F.col(package).eqNullSafe(F.col("_head")), place()))
    rows = running_all(rows, scratch, ["_d"], by, {"_first": ("_v1", "min"), "_second": ("_v2", "min")}).drop("_v1", "_v2")
    rows = rows.withColumn("_v1", place(F.col(end).alias("e"))).withColumn("_v2", place((-F.col(start)).alias("s")))
    rows = running_all(rows, scratch, ["_d", package], by, {"_ends": ("_v1", "min"), "_starts": ("_v2", "min")})
    source = (
        F.when(F.col("_ends.e") < F.col(start), F.col("_ends.r"))
        .when(-F.col("_starts.s") > F.col(end), F.col("_starts.r"))
        .when(~F.col("_head").eqNullSafe(F.col(package)), F.col("_first.r"))
        .otherwise(F.col("_second.r"))
    )
    out = rows.withColumn("_s", source).where("_s is not null")
    return out.select(*names, *rest, *[F.col("_s")[c].alias(f"source_{c}") for c in names])


def repeated_only(df: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Rows whose key occurs at least ``least`` times; keys are counted before any costly work on the rows."""
    often = df.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") >= least).select(key)
    return df.join(often, key, "left_semi")


def class_sizes(df: DataFrame, key: str, least: int = 2) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(F.sha2(F.col(key), 256).alias("digest")).agg(F.count("*").alias("copies")).where(F.col("copies") >= least)


def uncovered(df: DataFrame, group: list[str], order: list[Column], start: str, end: str) -> DataFrame:
    """Rows in order, without those whose span lies in the span of an earlier row that was kept.

    Being covered passes on: what a dropped row covers is covered by what covered it. So a row is kept unless any earlier
    row covers it, which a stream over the group can tell from the kept spans alone; they never nest upwards, so only
    spans that still matter are held. Rows of a group stream through Arrow batches in order.
    """
    rows = df.withColumn("_key", F.to_json(F.struct(*group))).withColumn("_rank", F.struct(*order))
    cols = [c for c in rows.columns if c != "_rank"]
    schema = T.StructType([rows.schema[c] for c in cols if c != "_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import bisect

        key, starts, ends = None, [], []  # kept spans by start; ends grow with starts, as nested ones are not needed
        for b in batches:
            take = []
            for i, (k, s, e) in enumerate(zip(b.column("_key").to_pylist(), b.column(start).to_pylist(), b.column(end).to_pylist(), strict=True)):
                if k != key:
                    key, starts, ends = k, [], []
                if s is None or e is None:
                    take.append(i)
                    continue
                at = bisect.bisect_right(starts, s)
                if at and ends[at - 1] >= e:
                    continue
                take.append(i)
                until = at
                while until < len(starts) and ends[until] <= e:
                    until += 1
                starts[at:until], ends[at:until] = [s], [e]
            names = [n for n in b.schema.names if n not in ("_key", "_rank")]
            yield pa.RecordBatch.from_arrays([b.column(n).take(pa.array(take, pa.int64())) for n in names], names=names)

    return rows.repartition("_key").sortWithinPartitions("_key", "_rank").drop("_rank").mapInArrow(run, schema)
