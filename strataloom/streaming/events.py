"""Structured Streaming forms: windows with late data, idempotent batches, results kept up to date as rows arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strataloom.operators.incremental import MODULE, IncrementalTable, file_sums, refresh_changed_files
from strataloom.operators.ordering import keep_best
from strataloom.runtime import Scratch


#: Parts by module in which a stream keeps its arrivals, so that the files of some buckets are read without the others.
SLOTS = 256


def files_stream(spark: SparkSession, path: str, schema: StructType, per_batch: int = 4) -> DataFrame:
    """New Parquet files under a path, or one file of its folder, as a stream; a bounded number a batch."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return read.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return read.parquet(path)


def windowed(stream: DataFrame, time: str, width: str, late: str, keys: list[str], *aggs: Column, slide: str | None = None) -> DataFrame:
    """Aggregates over event-time windows; rows later than ``late`` behind the newest are dropped with their state."""
    t = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    w = F.window("_t", width, slide) if slide else F.window("_t", width)
    return t.groupBy(w.alias("_w"), *keys).agg(*aggs).select(F.col("_w.start").cast("timestamp_ntz").alias("start"), *keys, *[_name(a) for a in aggs])


def _name(a: Column) -> str:
    return a._jc.toString().rsplit(" AS ", 1)[-1].strip("`")


def sessions(stream: DataFrame, time: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Counts over sessions that end after ``gap`` without a row."""
    t = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    g = t.groupBy(F.session_window("_t", gap).alias("_w"), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("_w.start").cast("timestamp_ntz").alias("start"), *keys, "n")


def first_of_key(stream: DataFrame, time: str, late: str, keys: list[str]) -> DataFrame:
    """Repeated rows dropped within ``late``: state is kept for as long as a repetition may come."""
    return stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark(keys).drop("_t")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what has arrived, then stop; started again with the same checkpoint, it goes on where it was."""
    (stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()).awaitTermination()


def each_batch(stream: DataFrame, out: str, checkpoint: str, make: Callable[[DataFrame], DataFrame]) -> None:
    """Write make(batch) for every batch as a partition of its own: a batch that is repeated replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        _replace(make(batch).withColumn("batch", F.lit(number)), out, "batch")

    (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()).awaitTermination()


def updates(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Write the groups that each batch changed, with their new values, as a partition of the batch's own.

    A batch costs what it touches, not all groups so far; state behind the watermark is dropped. ``latest`` gives the
    groups as they stand.
    """

    def write(batch: DataFrame, number: int) -> None:
        _replace(batch.withColumn("batch", F.lit(number)), out, "batch")

    (stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()).awaitTermination()


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The last values of every group that ``updates`` wrote."""
    return keep_best(spark.read.parquet(out), keys, [F.col("batch")]).drop("batch")


def changed_files_stream(spark: SparkSession, arrivals: DataFrame, runs: DataFrame, folder: str) -> IncrementalTable:
    """Keep the table of changed files up to date: each batch of arrivals is kept once, then the table refreshed.

    A batch costs its own rows and those of the buckets it touches: fingerprints are sums, so only the batch is hashed and
    added to what earlier batches left, and arrivals lie in slots of whole buckets. A batch that is repeated replaces
    what it wrote.
    """
    store = IncrementalTable(spark, f"{folder}/changes")
    seen, kept = f"{folder}/files", f"{folder}/sums"

    def step(batch: DataFrame, number: int) -> None:
        slot = F.pmod(F.xxhash64(*MODULE), F.lit(SLOTS)).cast("int")
        rows = batch.withColumn("batch", F.lit(number)).withColumn("slot", slot)
        _replace(rows.hint("rebalance", "slot"), seen, "slot", "batch")
        _replace(file_sums(batch).withColumn("batch", F.lit(number)), kept, "batch")
        whole = spark.read.parquet(kept).groupBy(*MODULE, "source").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
        files = spark.read.parquet(seen)

        def pick(todo: list[int]) -> DataFrame:
            slots = {b % SLOTS for b in todo} if store.buckets >= SLOTS else {s for s in range(SLOTS) if s % store.buckets in set(todo)}
            return files.where(F.col("slot").isin(sorted(slots)) & store.bucket(*MODULE).isin(todo))

        refresh_changed_files(store, files, runs, of_files=whole, pick=pick)

    (arrivals.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()).awaitTermination()
    return store


def _replace(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def scratch_folder(spark: SparkSession, label: str) -> str:
    return Scratch(spark, label).path("stream")
