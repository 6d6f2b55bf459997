"""Two states of a table: what changed, what can be restored, and whether results still hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.operators.ordering import keep_best, running_total
from strataloom.runtime import Scratch


def changed(now: DataFrame, before: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of now without an equal row, by ``columns``, in before. Nulls are values."""
    on = None
    b = before.select(*[F.col(c).alias(f"_{c}") for c in columns]).distinct()
    for c in columns:
        e = F.col(c).eqNullSafe(F.col(f"_{c}"))
        on = e if on is None else on & e
    return now.join(b, on, "left_anti")


def restored(matches: DataFrame, changed_ids: DataFrame, existing: DataFrame, left: str, right: str) -> DataFrame:
    """Earlier matches whose ends both still exist and have not changed."""
    gone = changed_ids.select(F.col(changed_ids.columns[0]).alias("_i")).distinct()
    there = existing.select(F.col(existing.columns[0]).alias("_i")).distinct()
    out = matches
    for side in (left, right):
        out = out.join(gone, F.col(side) == F.col("_i"), "left_anti").join(there, F.col(side) == F.col("_i"), "left_semi")
    return out


def carried_over(now: DataFrame, before: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """now with ``columns`` filled from the row of before with equal keys where they are null."""
    b = keep_best(before.select(*keys, *columns), keys, [F.xxhash64(*columns)]).select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    out = now.join(b, keys, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_{c}"))).drop(f"_{c}")
    return out


def reused_files(now: DataFrame, before: DataFrame, path: str, digest: str, within: list[str]) -> DataFrame:
    """``(within..., path, source, how)``: which earlier file each file's results come from, each used once.

    The same path with the same digest first ("same"); then moved files of the same ``within`` with the same digest
    ("moved"), paired in order of path; the rest are "new". One to one on both sides.
    """
    n = now.select(*within, F.col(path).alias("path"), F.col(digest).alias("digest")).distinct()
    b = before.select(*within, F.col(path).alias("source"), F.col(digest).alias("digest")).distinct()
    same = n.join(b, [*within, "digest"]).where("path = source").select(*within, "path", "source", "digest")
    free_n = n.join(same.select(*within, "path"), [*within, "path"], "left_anti")
    free_b = b.join(same.select(*within, "source"), [*within, "source"], "left_anti")
    rank = lambda c: F.row_number().over(W.partitionBy(*within, "digest").orderBy(c))
    moved = free_n.withColumn("_r", rank("path")).join(free_b.withColumn("_r", rank("source")), [*within, "digest", "_r"], "left")
    return same.select(*within, "path", "source", F.lit("same").alias("how")).unionByName(
        moved.select(*within, "path", "source", F.when(F.col("source").isNull(), "new").otherwise("moved").alias("how"))
    )


def overlay(base: DataFrame, delta: DataFrame, key: str, value: str, deleted: str) -> DataFrame:
    """base with upserts and deletions of delta."""
    d = delta.select(F.col(key).alias("_k"), F.col(value).alias("_v"), F.col(deleted).alias("_d"))
    out = base.select(key, value).join(d, F.col(key) == F.col("_k"), "full_outer")
    return out.where("not coalesce(_d, false)").select(F.coalesce(key, "_k").alias(key), F.when(F.col("_k").isNotNull(), F.col("_v")).otherwise(F.col(value)).alias(value))


def facts_match(cached: DataFrame, current: DataFrame, owner: str, keys: list[str], value: str) -> DataFrame:
    """``(owner, holds)``: do all facts an owner recorded, absent ones (null) included, equal the current ones?"""
    c = current.select(*keys, F.col(value).alias("_now"))
    return cached.join(c, keys, "left").groupBy(owner).agg(F.bool_and(F.col(value).eqNullSafe(F.col("_now"))).alias("holds"))


def _row(columns: list[str]) -> Column:
    """MD5 of a row: every value behind its length in characters, nulls as a mark of their own, so no two rows share a text."""
    text = [F.col(c).cast("string") for c in columns]
    return F.md5(F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]))


def digest(df: DataFrame, columns: list[str], group: list[str]) -> DataFrame:
    """``(group..., digest, rows)``: SHA-256 of order-free sums of row hashes and the number of rows. Equal multisets of
    rows have equal digests; no rows are gathered, so a group may be of any size."""
    row = _row(columns)
    half = lambda a: F.conv(F.substring(row, a, 15), 16, 10).cast("decimal(38,0)")
    b = df.groupBy(*group).agg(F.sum(half(1)).alias("_x"), F.sum(half(16)).alias("_y"), F.count("*").alias("rows"))
    text = F.concat_ws(":", F.col("_x").cast("string"), F.col("_y").cast("string"), F.col("rows").cast("string"))
    return b.select(*group, F.sha2(text, 256).alias("digest"), "rows")


def table_digest(df: DataFrame, columns: list[str], buckets: int = 256) -> DataFrame:
    """One row ``(digest, rows)`` over a table of any size: SHA-256 of the digests of hash buckets, each of which is an
    order-free sum of its rows' 128-bit MD5 halves. Equal multisets of rows have equal digests."""
    row = _row(columns)
    half = lambda a: F.conv(F.substring(row, a, 15), 16, 10).cast("decimal(38,0)")
    b = df.groupBy(F.conv(F.substring(row, 31, 2), 16, 10).cast("int").alias("b")).agg(F.sum(half(1)).alias("x"), F.sum(half(16)).alias("y"), F.count("*").alias("n"))
    text = F.concat_ws(":", F.col("b").cast("string"), F.col("x").cast("string"), F.col("y").cast("string"), F.col("n").cast("string"))
    return b.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(text)), "\n"), 256).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def sorted_digest(df: DataFrame, columns: list[str], chunk: int = 4096) -> DataFrame:
    """One row ``(digest, rows)``: SHA-256 over the rows in order, as a tree: ``chunk`` rows in order of ``columns`` make one
    digest, so many digests the next, until one is left. Places come from running counts over range partitions; no task
    holds more than a chunk. Nulls sort first; equal rows may stand in any order, as they are the same."""
    scratch = Scratch(df.sparkSession, "digest")
    text = [F.col(c).cast("string") for c in columns]
    row = F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])
    level = df.select(row.alias("t"), F.lit(1).cast("bigint").alias("one"), F.lit(0).alias("all"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], F.monotonically_increasing_id().alias("id"))
    level = scratch.cut(level, "rows")
    n = total = level.count()
    order = [F.col(f"c{i}") for i in range(len(columns))] + [F.col("id")]
    while True:
        placed = running_total(level, scratch, ["all"], order, "one", "before")
        part = placed.groupBy(F.floor(F.col("before") / chunk).alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("before", "t"))), lambda x: x["t"]), "\n").alias("t"))
        level = scratch.cut(part.select(F.sha2("t", 256).alias("t"), F.lit(1).cast("bigint").alias("one"), F.lit(0).alias("all"), "id"), "level")
        order, n = [F.col("id")], -(-n // chunk)
        if n <= 1:
            break
    return level.select(F.col("t").alias("digest"), F.lit(total).cast("bigint").alias("rows")) if total else df.sparkSession.range(1).select(F.sha2(F.lit(""), 256).alias("digest"), F.lit(0).cast("bigint").alias("rows"))


def recorded(lookups: DataFrame, facts: DataFrame, owner: str, keys: list[str], value: str) -> DataFrame:
    """``(owner, keys..., value)``: what every owner found when it looked facts up, once each; null where there was none. Kept
    with the owner's results, ``facts_match`` tells later whether they still hold."""
    return lookups.select(owner, *keys).distinct().join(facts.select(*keys, value), keys, "left").select(owner, *keys, value)


def repointed(findings: DataFrame, reuse: DataFrame, within: list[str], file: str) -> DataFrame:
    """The findings of reused files under their new path. reuse: (within..., path, source) of ``reused_files``; findings of
    files that are not reused are left out, as their files are analysed anew."""
    r = reuse.where("source is not null").select(*within, F.col("source").alias(file), F.col("path").alias("_path"))
    return findings.join(r, [*within, file]).withColumn(file, F.col("_path")).drop("_path")


def attest(stamp: DataFrame, current: DataFrame, same: list[str], at_least: dict[str, Column] | None = None) -> DataFrame:
    """One row ``(status)``: holds, missing, or the first of ``same`` that differs. stamp and current have one row."""
    s = stamp.select(*[F.col(c).alias(f"_{c}") for c in same], F.lit(True).alias("_there"))
    out = current.select(*same).join(s, F.lit(True), "left")
    status = F.when(F.col("_there").isNull(), "missing")
    for c in same:
        status = status.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), f"{c} differs")
    for name, ok in (at_least or {}).items():
        status = status.when(~ok, name)
    return out.select(status.otherwise("holds").alias("status"))


def replayable(findings: DataFrame, ends: list[tuple[str, str]], current: DataFrame, identity: str, hash_: str, group: list[str]) -> DataFrame:
    """All or nothing: the findings of each group, if both ends of every one of them have the hash they had."""
    now = current.select(F.col(identity).alias("_i"), F.col(hash_).alias("_h")).distinct()
    ok = findings
    for i, (name, h) in enumerate(ends):
        n = now.select(F.col("_i").alias(f"_i{i}"), F.col("_h").alias(f"_h{i}"), F.lit(True).alias(f"_ok{i}"))
        ok = ok.join(n, (F.col(name) == F.col(f"_i{i}")) & (F.col(h) == F.col(f"_h{i}")), "left")
    valid = ok.withColumn("_all", F.expr(" and ".join(f"coalesce(_ok{i}, false)" for i in range(len(ends)))))
    good = valid.groupBy(*group).agg(F.bool_and("_all").alias("ok")).where("ok").select(*group)
    return findings.join(good, group, "left_semi")


def unused(df: DataFrame, touched: str, now: Column, known: Column, unused_days: int = 30, unknown_days: int = 7) -> DataFrame:
    """Entries to prune: known ones not touched for unused_days, others for unknown_days."""
    limit = F.when(known, F.make_dt_interval(F.lit(unused_days))).otherwise(F.make_dt_interval(F.lit(unknown_days)))
    return df.where(F.col(touched) < now - limit)
