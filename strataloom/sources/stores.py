"""Stored intermediate results: vectors, snapshots, entries, stamps and reports."""

from __future__ import annotations

import json
import struct
import time
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.operators.ordering import keep_best
from strataloom.runtime import delete

#: First bytes of a vector record unless others are given; then dimensions as u32 and values as f32, both little-endian.
MAGIC = b"SLV1"


def encode_vectors(df: DataFrame, key: str, vec: str, magic: bytes = MAGIC) -> DataFrame:
    """``(key, record)``: normalised vectors as binary records; unusable ones (empty, zero, not finite) are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, out = [], []
            for i, v in enumerate(b.column(vec).to_pylist()):
                x = np.asarray(v if v is not None and None not in v else [], np.float64)
                n = np.sqrt((x * x).sum()) if len(x) else 0.0
                if np.isfinite(n) and n > 0:
                    keep.append(i)
                    out.append(magic + struct.pack("<I", len(x)) + (x / n).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(keep, pa.int64())), pa.array(out, pa.binary())], names=[key, "record"])

    rows = df.select(key, vec)
    return rows.mapInArrow(run, T.StructType([rows.schema[key], T.StructField("record", T.BinaryType())]))


def decode_vectors(df: DataFrame, key: str, record: str = "record", most: int = 65536, magic: bytes = MAGIC) -> DataFrame:
    """``(key, vec)`` of valid records; a wrong mark, length or number of dimensions makes a record absent."""
    rows = df.select(key, record)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, out = [], []
            for i, r in enumerate(b.column(record).to_pylist()):
                if r is None or len(r) < 8 or r[:4] != magic:
                    continue
                n = struct.unpack("<I", r[4:8])[0]
                if not 0 < n <= most or len(r) != 8 + 4 * n:
                    continue
                x = np.frombuffer(r, "<f4", offset=8)
                if np.isfinite(x).all() and x.any():
                    keep.append(i)
                    out.append(x.tolist())
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(keep, pa.int64())), pa.array(out, pa.list_(pa.float32()))], names=[key, "vec"])

    return rows.mapInArrow(run, T.StructType([rows.schema[key], T.StructField("vec", T.ArrayType(T.FloatType()))]))


class Snapshots:
    """Numbered snapshots of a table as gzip JSON or Parquet under one folder; the newest ``keep`` stay.

    A snapshot counts once its schema file is written, which comes last, so a failed write is never read.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 16, schema_version: int = 1, form: str = "json"):
        self.spark, self.path, self.keep, self.version, self.form = spark, path.rstrip("/"), keep, schema_version, form

    def _fs(self):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return p, p(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        p, fs = self._fs()
        if not fs.exists(p(self.path)):
            return []
        done = [s.getPath().getName() for s in fs.listStatus(p(self.path))]
        return sorted(int(n[1:-5]) for n in done if n.startswith("s") and n.endswith(".meta"))

    def write(self, df: DataFrame, policy: dict, digest: str | None = None) -> int:
        """Store a snapshot; digest names the state of the sources it was made from."""
        number = (self.numbers() or [0])[-1] + 1
        w = df.write.mode("overwrite")
        w.option("compression", "gzip").json(f"{self.path}/s{number}") if self.form == "json" else w.parquet(f"{self.path}/s{number}")
        meta = {"version": self.version, "policy": policy, "schema": df.schema.json(), "rows": self.read_raw(number, df.schema).count(), "digest": digest}
        write_text(self.spark, f"{self.path}/s{number}.meta", json.dumps(meta))
        for old in self.numbers()[: -self.keep]:
            delete(self.spark, f"{self.path}/s{old}.meta")
            delete(self.spark, f"{self.path}/s{old}")
        return number

    def read_raw(self, number: int, schema) -> DataFrame:
        r = self.spark.read.schema(schema)
        return r.json(f"{self.path}/s{number}") if self.form == "json" else r.parquet(f"{self.path}/s{number}")

    def latest(self, policy: dict, digest: str | None = None) -> DataFrame | None:
        """The snapshot made from sources with this digest, else the newest; of this schema version and policy only, and
        whole. Others are ignored, never migrated."""
        metas = {n: json.loads(read_text(self.spark, f"{self.path}/s{n}.meta")) for n in self.numbers()}  # at most ``keep``
        fits = [n for n, m in metas.items() if m.get("version") == self.version and m.get("policy") == policy]
        for number in sorted(fits, key=lambda n: (digest is not None and metas[n].get("digest") == digest, n), reverse=True):
            meta = metas[number]
            df = self.read_raw(number, T.StructType.fromJson(json.loads(meta["schema"])))
            if df.count() == meta["rows"]:
                return df
        return None


class Entries:
    """Keyed entries, appended as Parquet with the time they were written; the last one of a key counts.

    Times of use lie in a table of their own beside them: every ``get`` notes the keys it found, so that ``prune`` goes by
    the last use, not by the last write. Both are in the folder of a generation, whose number one small file holds.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return p, p(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str) -> str:
        return f"{self.path}/g{read_text(self.spark, f'{self.path}/generation') or 0}/{name}"

    def put(self, df: DataFrame, key: str) -> None:
        df.withColumn("_key", F.col(key).cast("string")).withColumn("_used", F.current_timestamp()).write.mode("append").parquet(self._at("entries"))

    def get(self, keys: DataFrame, key: str, touch: bool = True) -> DataFrame:
        """The entries of these keys; which of them are missing is an anti-join for the caller. Only entries asked for are
        reduced to the last one of their key. With ``touch`` the use is noted."""
        e = self.spark.read.parquet(self._at("entries"))
        e = e.join(keys.select(F.col(key).cast("string").alias("_key")).distinct(), "_key", "left_semi")
        if touch:
            e.select("_key").distinct().withColumn("_used", F.current_timestamp()).write.mode("append").parquet(self._at("uses"))
        return keep_best(e, ["_key"], [F.col("_used")]).drop("_key", "_used")

    def used(self) -> DataFrame:
        """``(key, used)``: when each entry was last written or read."""
        p, fs = self._fs()
        times = self.spark.read.parquet(self._at("entries")).select("_key", "_used")
        if fs.exists(p(self._at("uses"))):
            times = times.unionByName(self.spark.read.parquet(self._at("uses")))
        return times.groupBy(F.col("_key").alias("key")).agg(F.max("_used").alias("used"))

    def prune(self, now: datetime, known: Column | None = None, unused_days: int = 30, unknown_days: int = 7, every: timedelta = timedelta(days=1)) -> bool:
        """Drop entries not used for so long; returns whether it was done: at most once in ``every``, by one caller at a time.

        known: a condition on ``key`` for entries that are kept for unused_days, others for unknown_days. What stays is
        written as the next generation, which then takes effect at once. A lock older than an hour counts as left behind.
        """
        from strataloom.operators.deltas import unused

        p, fs = self._fs()
        lock, last = p(f"{self.path}/lock"), read_text(self.spark, f"{self.path}/pruned")
        if last and now - datetime.fromisoformat(last) < every or not fs.exists(p(self._at("entries"))):
            return False
        if fs.exists(lock) and time.time() - fs.getFileStatus(lock).getModificationTime() / 1000 > 3600:
            fs.delete(lock, False)
        if fs.exists(lock):
            return False
        fs.create(lock, False).close()
        try:
            old = unused(self.used(), "used", F.lit(now), F.lit(True) if known is None else known, unused_days, unknown_days).select(F.col("key").alias("_key"))
            number = int(read_text(self.spark, f"{self.path}/generation") or 0)
            for name in ("entries", "uses"):
                if fs.exists(p(self._at(name))):
                    self.spark.read.parquet(self._at(name)).join(old, "_key", "left_anti").write.mode("overwrite").parquet(f"{self.path}/g{number + 1}/{name}")
            write_text(self.spark, f"{self.path}/generation", str(number + 1))
            delete(self.spark, f"{self.path}/g{number}")
            write_text(self.spark, f"{self.path}/pruned", now.isoformat())
        finally:
            fs.delete(lock, False)
        return True


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: written beside its place, then renamed over it in one step."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    p, conf = hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    part = f"{path}.{uuid.uuid4().hex}.part"
    out = p(path).getFileSystem(conf).create(p(part), True)
    out.write(bytearray(text.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = spark.sparkContext._jvm.java.lang.Enum.valueOf(spark.sparkContext._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), "OVERWRITE")
    hadoop.fs.FileContext.getFileContext(p(path).toUri(), conf).rename(p(part), p(path), over)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file, or None if there is none."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p(path)):
        return None
    return "\n".join(r[0] for r in spark.read.option("wholetext", "true").text(path).collect())


def write_stamp(spark: SparkSession, path: str, stamp: dict, clean: bool) -> bool:
    """Write the stamp if all checks were clean."""
    if clean:
        write_text(spark, path, json.dumps(stamp, sort_keys=True))
    return clean


def read_stamp(spark: SparkSession, path: str) -> dict:
    """The stamp; missing, an empty one; without a schema number, an error."""
    text = read_text(spark, path)
    if text is None:
        return {}
    stamp = json.loads(text)
    if not stamp.get("schema"):
        raise ValueError("the stamp has no schema number")
    return stamp


def text_report(rows: DataFrame) -> Iterator[str]:
    """Lines of the report of ``findings.report``: a header a kind, then its findings. Streams from the executors."""
    kind = None
    for r in rows.orderBy("kind", "place").toLocalIterator():
        if r["kind"] != kind:
            kind = r["kind"]
            fix = f" - {r['fix']}" if "fix" in r.asDict() and r["fix"] else ""
            yield f"{kind} ({r['n']}){fix}"
        yield r["text"]
