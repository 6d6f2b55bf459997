"""Queries by Structured Streaming over what has arrived, against their batch meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators.incremental import CHANGES
from strataloom.plans.incremental_queries import SQL as INCREMENTAL
from strataloom.plans.registry import registrar
from strataloom.runtime import table
from strataloom.streaming import events as S

QUERIES, SQL, query = registrar()


def _events(spark: SparkSession, d: str) -> DataFrame:
    return S.files_stream(spark, f"{d}/events.parquet", table(spark, d, "events").schema)


@query("select time_bucket(interval 6 hour, ts) as start, event_type, count(*) n, round(sum(value), 4) total from events group by all")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Counts and sums of events in windows of 6 hours, by kind."""
    w = S.windowed(_events(spark, d), "ts", "6 hours", _span(spark, d), ["event_type"], F.count("*").alias("n"), F.sum("value").alias("total"))
    out = S.scratch_folder(spark, "windows")
    S.updates(w, f"{out}/data", f"{out}/checkpoint")
    return S.latest(spark, f"{out}/data", ["start", "event_type"]).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("select event_id, user_id from events where event_type = 'purchase'")
def stream_batches(spark: SparkSession, d: str) -> DataFrame:
    """Purchases, each batch written once however often it is tried."""
    out = S.scratch_folder(spark, "batches")
    S.each_batch(_events(spark, d), f"{out}/data", f"{out}/checkpoint", lambda b: b.where("event_type = 'purchase'").select("event_id", "user_id"))
    return spark.read.parquet(f"{out}/data").select("event_id", "user_id")


def _span(spark: SparkSession, d: str) -> str:
    """A lateness no event exceeds, in whatever order files come: the time from the first to the last, and a day."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    days = table(spark, d, "events").agg(F.ceil((F.max(micros) - F.min(micros)) / 86_400_000_000)).first()[0]
    return f"{(days or 0) + 1} days"


@query("select distinct event_id from events")
def stream_first_of_key(spark: SparkSession, d: str) -> DataFrame:
    out = S.scratch_folder(spark, "first")
    S.run_available(S.first_of_key(_events(spark, d), "ts", _span(spark, d), ["event_id"]).select("event_id"), f"{out}/data", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/data")


@query(INCREMENTAL["p2_found"])
def stream_changed_files(spark: SparkSession, d: str) -> DataFrame:
    """The changed files of problem 2, kept up to date by a stream of arrivals."""
    arrivals = S.files_stream(spark, f"{d}/source_files.parquet", table(spark, d, "source_files").schema)
    store = S.changed_files_stream(spark, arrivals, table(spark, d, "scan_runs"), S.scratch_folder(spark, "changed"))
    return store.read(CHANGES).select("run_id", "file_path")
