"""Queries on new and changed source files (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators.incremental import CHANGES, IncrementalTable, refresh_changed_files
from strataloom.plans.sql_text import CANONICAL_PATH
from strataloom.runtime import Scratch, table

COLUMNS = ["run_id", "file_path"]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The first refresh of an empty table: every bucket is new."""
    store = IncrementalTable(spark, Scratch(spark, "found").path("changes"))
    refresh_changed_files(store, table(spark, d, "source_files"), table(spark, d, "scan_runs"))
    return store.read(CHANGES).select(COLUMNS)


def p2_resumed(spark: SparkSession, d: str) -> DataFrame:
    """Two thirds of the arrivals first, then a run that fails after writing, then all, but for one row of scan_runs with
    a time in the wrong one of two columns, then the row as it is, which must touch one bucket: the same result."""
    store = IncrementalTable(spark, Scratch(spark, "resumed").path("changes"))
    files, runs = table(spark, d, "source_files"), table(spark, d, "scan_runs")
    span = files.agg(F.min("arrived_at").alias("a"), F.max("arrived_at").alias("b")).first()
    if span["a"] is not None:
        cut = span["a"] + (span["b"] - span["a"]) * 2 / 3
        early = files.where(F.col("arrived_at") <= F.lit(cut)), runs.where(F.col("finished_at") <= F.lit(cut))
        refresh_changed_files(store, *early)
        try:
            refresh_changed_files(store, files, runs, fail="before_commit")
        except RuntimeError:
            pass
    open_run = runs.where("started_at is not null and finished_at is null").agg(F.min("run_id")).first()[0]
    if open_run is not None:
        this = F.col("run_id") == F.lit(open_run)
        moved = runs.withColumns({"finished_at": F.when(this, F.col("started_at")).otherwise(F.col("finished_at")), "started_at": F.when(~this, F.col("started_at"))})
        refresh_changed_files(store, files, moved)
        touched = refresh_changed_files(store, files, runs)
        if len(touched) != 1:
            raise RuntimeError(f"{len(touched)} buckets were recomputed for one changed row")
    else:
        refresh_changed_files(store, files, runs)
    return store.read(CHANGES).select(COLUMNS)


_SQL = f"""
with r as (
  select distinct run_id, repo, module_dir, started_at, finished_at from scan_runs
  where status = 'ok' and source_digest is not null and finished_at is not null
), b as (
  select x.run_id, max_by(y.run_id, (y.finished_at, y.run_id)) base from r x
  join r y on x.repo = y.repo and x.module_dir = y.module_dir and y.finished_at <= x.started_at and y.run_id <> x.run_id
  group by 1
), s as (
  select f.run_id, {CANONICAL_PATH('file_path')} p, max_by(lower(sha256), (arrived_at, obs_id)) h
  from source_files f join r using (run_id) where sha256 is not null and arrived_at <= finished_at group by 1, 2
)
select s.run_id, s.p file_path from s join b using (run_id)
left join s q on q.run_id = b.base and q.p = s.p where q.h is null or q.h <> s.h
"""
QUERIES = {"p2_found": p2_found, "p2_resumed": p2_resumed}
SQL = {"p2_found": _SQL, "p2_resumed": _SQL}
